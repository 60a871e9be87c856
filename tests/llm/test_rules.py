from collections import Counter

import numpy as np
from brute import WORDS
from pyspark.sql import functions as F

from evenkeel.llm import ngrams, queries, rules


def signals(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(inside), failed


def digest(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op8_quality_rules"](spark, sf).collect()
    assert {r.doc_id: digest(r) for r in got} == {d: signals(r.text) for d, r in docs.items()}
    assert all(not (r.kept and r.base_failed) for r in got)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    kept = [r.kept for r in got if r.doc_id in good and not r.base_failed]
    assert sum(kept) >= 0.98 * len(kept)


def test_band_rejects_strange_words(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(8)]
    rows = [(i, " ".join(rng.choice(vocabulary, 40)), "en") for i in range(200)]
    rows += [(900, " ".join(f"zq{rng.integers(10**9)}" for _ in range(300)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in rules.judge(docs, ["doc_id"], vocabulary=8).collect()}
    fine = [r for r in got.values() if not r.base_failed]
    assert not got[900].base_failed and not got[900].kept
    assert sum(not r.kept for r in fine) <= 2


def test_model_is_a_distribution(spark):
    docs = spark.createDataFrame([("a b a c a b d",), ("b a b",), ("c c e",), ("a b",), ("f a b c",)], "text string")
    model = rules.fit(docs, vocabulary=50)
    size = len(model.words) + 1  # words and the other word; the start never follows
    for before in range(size + 1):
        ids = np.arange(1, size + 1)
        p = 10 ** model.log10(ids, np.full(size, before))
        assert abs(p.sum() - 1) < 1e-6


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "a b c d e f g h i j", "en"), (3, "a b c d e f g h i j", "en"), (4, "x y " * 30_000, None),
            (5, " \n\n \n", "en"), (6, "é ñ\n é ñ\né ñ\né ñ\n#|<", "es"), (None, "one two\x1fthree four five six seven eight nine ten eleven", "en")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, lang string, n_words int, bin string")
    got = rules.judge(docs, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), *digest(r)) for r in got) == sorted((str(d), *signals(t)) for d, t, _ in rows)
    assert rules.judge(docs.limit(0), ["doc_id"]).collect() == []


def test_segments_are_even():
    seg = ngrams.segment_of(np.arange(100_000, dtype=np.uint64), 64)
    assert np.bincount(seg, minlength=64).max() < 3 * 100_000 / 64


def test_columns_of_any_name(spark):
    rows = [(i, f"word{i} " * 12, 1) for i in range(5)] + [(5, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `my col` int").withColumn("lang", F.lit("en"))
    packed = docs.select(F.struct("*").alias("row"), "text", "lang")
    got = rules.judge(packed, ["row"]).select("row.*")
    assert got.columns == docs.columns and got.count() == 6
    assert rules.judge(docs, ["doc_id", "my col"]).columns[:2] == ["doc_id", "my col"]
