import random

import public_tokenizers
import pytest
import tiktoken
from brute import sha

from evenkeel.llm import bpe, queries

RANKS = bpe.read_ranks(None, public_tokenizers.path("byte_bpe_50k.tiktoken"))
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "  a", "a ", "a  b", "a\n b", "a \nb", "a \n b", "a\tb", " x 　y", "x" * 3000, "don't we'll 'S 12345 ²½Ⅷ一",
       "\x1c\x1d \x1f a\x00b", "<|endoftext|> é́ ñ 日本語 🙂👩‍👩‍👧", "a" + " " * 500 + "b", "\r\n\r\n x y\u0085z", "= == === ."]


def test_minimal_perfect_hash():
    table = bpe.PerfectHash(RANKS)
    assert all(table.get(k) == v for k, v in RANKS.items())
    assert table.n == len(RANKS) and None not in table.keys
    assert table.get(b"no such piece at all") == -1 and bpe.PerfectHash({}).get(b"a") == -1


def test_encoder_equals_plain_library():
    random.seed(5)
    letters = "ab é\n \t'sñZ0９.,$日  \x1f🙂"
    texts = ODD + ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(4000)]
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for t in texts:
        assert encoder.encode(t) == PLAIN.encode_ordinary(t), repr(t)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 4)
    memory = bpe.Memory(lambda k: b"x" * len(k))
    for k in ("a", "bb", "ccc", "dddd", "a", "eeeee", "y" * 200):
        assert memory[k] == b"x" * len(k)
        assert len(memory) <= 2 and len(memory.old) <= 2


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (None, ""), (3, "a b"), (3, "a b")] + [(9, t) for t in ODD]])
def test_rows_round_trip(spark, rows):
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, ids int, decoded string")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(encoded, RANKS).collect()
    want = sorted((str(d), tuple(PLAIN.encode_ordinary(t or "")), (t or "").encode()) for d, t in rows)
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in got) == want


def test_query(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op3_byte_bpe"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d, t in rows:
        ids = PLAIN.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert got[d].decoded_sha256 == sha((t or "").encode())


def test_words_are_merged_once():
    """A word is remembered whether it came alone or before a sign, and takes one place in one memory; ids are those of the parts."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b" ab": 258}
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    merged, merge = [], encoder.merge
    encoder.merge = lambda data: (merged.append(data), merge(data))[1]
    text = "x abcab, abcab abcab. abcab"
    assert encoder.encode(text) == [120] + [258, 99, 256, 44] + [258, 99, 256] + [258, 99, 256, 46] + [258, 99, 256]
    assert merged == [b" abcab"] and " abcab" not in encoder.pieces
