import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import LOWER

from evenkeel.llm import phrases as P
from evenkeel.llm import queries


def brute(rows, least=100, top=2000, longest=5):
    """Rows of ``collocations`` from (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for j in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + j]) for i in range(len(words) - j + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in good.items():
            for j in range(2, len(p)):
                gone |= {q for q in (p[i : i + j] for i in range(len(p) - j + 1)) if q in good and 100 * a >= 100 * good[q]}
        ranked = []
        for p, a in good.items():
            if p not in gone:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def random_rows(seed, n, words=30):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" if i % 5 else f"Wé{i}" for i in range(words)]
    rows = []
    for k in range(n):
        picks = np.minimum(rng.zipf(1.4, rng.integers(0, 60)) - 1, words - 1)
        text = "".join(vocabulary[p] + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " "], p=[.6, .1, .1, .05, .05, .05, .05]) for p in picks)
        rows.append((["a", "b", None, "und"][k % 4], text + rng.choice(["", " the very same passage of words here"])))
    return rows


@pytest.mark.parametrize("sieved", [0, 1, 2, 3, 5])
def test_equals_counting_all(spark, sieved):
    rows = [*random_rows(1, 300), (None, None), ("a", ""), ("a", " .. \x0b"), ("c", "x x x x x x x x")]
    docs = spark.createDataFrame([(lang, t, "z", 1) for lang, t in rows], "lang string, text string, phrase string, n int").repartition(5)
    assert got(P.collocations(docs, 5, 25, sieved=sieved)) == brute(rows, 5, 25)


def test_slices_of_any_size(spark, monkeypatch):
    rows = random_rows(2, 120)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    want = got(P.collocations(docs, 4, 50))
    monkeypatch.setattr(P, "SLICE_WORDS", 40)
    monkeypatch.setattr(P, "HELD_WORDS", 60)
    assert got(P.collocations(docs, 4, 50)) == want == brute(rows, 4, 50)


def test_ties_repeats_and_long_texts(spark):
    rows = [("a", "p q r s t u v " * 2000), *[("a", "x y")] * 300, *[("a", "y, x")] * 300, *[("b", "k l m")] * 100]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert got(P.collocations(docs)) == brute(rows)
    assert got(P.collocations(docs, top=3)) == brute(rows, top=3)


def test_products_beyond_64_bits(spark):
    """Counts are taken from words of a slice, so large ones are made by hand."""
    df = spark.createDataFrame([(10**13, 10**14, 10**13, 10**12)], "a long, n long, l long, r long")
    assert df.select(P.floored_score()).first()[0] == 1000 * 10**13 * 10**14 // (10**13 * 10**12)


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert got(P.collocations(docs)) == []


def test_query(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.QUERIES["op12_phrase_collocations"](spark, sf)) == brute(rows)
