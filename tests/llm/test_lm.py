import math
from collections import Counter

import numpy as np
import pytest
from brute import LOWER, WORDS, remainder

from evenkeel.llm import lm, ngrams, queries

END = object()


def tokens(text):
    return [*WORDS.findall((text or "").translate(LOWER)), END]


def base_scores(rows, train):
    c = Counter(t for _, text in train for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for d, text in rows:
        ts = tokens(text)
        out.append((d, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)))
    return out


def same(got, want):
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert got == sorted((str(d), t, k, n, round(b, 6)) for d, t, k, n, b in want)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op7_lm_scores"](spark, sf).collect()
    same(got, base_scores(rows, [r for r in rows if remainder(r[0], 5) != 1]))
    assert all(r.held_out == (remainder(r.doc_id, 5) == 1) and r.score <= 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("head", [0, 2, 1000])
def test_odd_rows(spark, head):
    rows = [(1, "a b A"), (1, "a b A"), (2, None), (3, ""), (4, "zz a zz"), (5, "a " * 50_000), (None, "b\x1fc é"), (7, "q q r")]
    docs = spark.createDataFrame([(*r, 1, "u") for r in rows], "doc_id long, text string, uid int, word string")
    train = docs.where("doc_id <> 4 or doc_id is null")
    got = lm.score(docs, train, bits=1 << 20, head=head).collect()
    same(got, base_scores(rows, [r for r in rows if r[0] != 4]))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm.score(docs.limit(0), train, bits=1 << 20).collect() == []
    same(lm.score(docs, train.limit(0), bits=1 << 20).collect(), base_scores(rows, []))


def test_filter_has_every_level_and_few_strangers(spark):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = rng.integers(1, 500, len(keys))
    rows = [(0, ngrams.pack(keys), counts.astype(np.int64).tobytes())]
    packed = spark.createDataFrame(rows, "seg int, keys binary, counts binary")
    bloom = lm.Filter(lm.build_filter(packed, packed.limit(0), 1, 1 << 22))
    levels = bloom.levels(keys)
    assert (levels >= lm.level_of(counts)).all() and (levels == lm.level_of(counts)).mean() > 0.9
    assert (bloom.levels(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.05


def test_packing_and_sums():
    keys = np.array([0, 1, 5, 2**63, 2**64 - 1], np.uint64)
    assert (ngrams.unpack(ngrams.pack(keys)) == keys).all() and len(ngrams.unpack(ngrams.pack(keys[:0]))) == 0
    k, c = ngrams.summed(np.array([3, 1, 3], np.uint64), np.array([1, 2, 5]))
    assert k.tolist() == [1, 3] and c.tolist() == [2, 6]
    levels = {1: (100, 100), 2: (10, 20), 64: (3, 300)}
    assert [ngrams.floor_for(levels, most) for most in (2, 3, 13, 112, 113)] == [128, 64, 2, 2, 1]


def test_counts_of_many_partitions(spark, monkeypatch):
    docs = spark.createDataFrame([(f"w{i % 50} w{i % 7}",) for i in range(500)], "text string").repartition(9)
    memory = ngrams.word_hashes

    def reader():
        words = memory()
        return lambda batch: words.array([w for t in batch.column("text").to_pylist() for w in t.encode().split()])

    counted = ngrams.count_keys(docs, 64, reader)
    keys, counts = ngrams.frequent(counted, 1)
    want = Counter(f"w{i % 50}" for i in range(500)) + Counter(f"w{i % 7}" for i in range(500))
    assert sorted(counts.tolist()) == sorted(want.values()) and len(keys) == len(want)


def model_scores(rows, train):
    """Scores by plain counts put to their levels, with no filter between."""
    c, p = Counter(), Counter()
    for _, text in train:
        ts = tokens(text)
        c.update(ts)
        p.update(zip([END, *ts], ts))
    n, v = sum(c.values()), len(c)
    exact = {t for t, _ in c.most_common(lm.HEAD_WORDS)}
    assert len(exact) == v
    level = lambda x: 0 if not x else 1 if x == 1 else 2 ** (math.floor(math.log2(x)) + 0.5)
    rest = 1 - sum(x - lm.DISCOUNT for x in p.values()) / max(n, 1)
    out = {}
    for d, text in rows:
        ts, total = tokens(text), 0.0
        for a, b in zip([END, *ts], ts):
            single = (c[b] + 0.5) / (n + 0.5 * (v + 1))
            seen = max(min(level(p[a, b]), c[b]) - lm.DISCOUNT, 0) / c[a] if c[a] else 0.0
            total += math.log10(min(seen + (rest if c[a] else 1.0) * single, 1.0))
        out[d] = total, len(ts)
    return out


def gaps(got, want):
    return np.array([abs(r.score - want[r.doc_id][0]) / want[r.doc_id][1] for r in got])


def test_scores_by_brute_force_whether_or_not_the_filter_holds_all(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    train = docs.where("crc32(cast(doc_id as string)) % 5 <> 1")
    want = model_scores(rows, [r for r in rows if remainder(r[0], 5) != 1])
    whole = gaps(lm.score(docs, train).collect(), want)
    assert whole.max() < 1e-3 and np.median(whole) < 1e-9
    # a fraction of the bits that all entries need: most words and pairs are probed where they lie; blocks no smaller than usual
    monkeypatch.setattr(lm, "BLOCKS", 32)
    bits = 1 << 17
    split = lm.score(docs, train, bits=bits)
    apart = gaps(split.collect(), want)
    assert apart.mean() < 0.005 and apart.max() < 0.1
    same(split.collect(), base_scores(rows, [r for r in rows if remainder(r[0], 5) != 1]))


def test_odd_rows_beyond_the_broadcast_filter(spark):
    rows = [(1, "a b A"), (1, "a b A"), (2, None), (3, ""), (4, "zz a zz"), (None, "b\x1fc é"), (7, "q q r")]
    rows += [(10 + i, f"w{i} x{i} y{i}") for i in range(3000)]
    docs = spark.createDataFrame([(*r, 1, "u") for r in rows], "doc_id long, text string, uid int, more string")
    got = lm.score(docs, docs, bits=1 << 15).collect()
    same(got, base_scores(rows, rows))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_bits_follow_the_entries():
    assert lm.filter_bits(10, 1 << 29) == lm.LEAST_BITS
    assert 0 <= lm.filter_bits(10_000_000, 1 << 29) - 100_000_000 < 8 * lm.BLOCKS
    assert lm.filter_bits(10**9, 1 << 29) == 1 << 29
