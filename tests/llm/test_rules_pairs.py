import os

import numpy as np
import pytest
import xxhash

from evenkeel.llm import common, ngrams, rules


@pytest.mark.parametrize("pairs", [0, 40])
def test_pairs_outside_the_broadcast_count(spark, monkeypatch, pairs):
    monkeypatch.setattr(ngrams, "HELD", 300)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{w}" for w in np.minimum(rng.geometric(0.1, 30), 60)), "en") for i in range(60)]
    rows += [rows[0], (98, "", "en"), (99, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted((r.doc_id, r.kept, round(r.surprise, 9)) for r in rules.judge(docs, ["doc_id"], vocabulary=20).collect())
    got = sorted((r.doc_id, r.kept, round(r.surprise, 9)) for r in rules.judge(docs, ["doc_id"], vocabulary=20, pairs=pairs).collect())
    assert [g[:2] for g in got] == [w[:2] for w in whole]
    assert np.allclose([g[2] for g in got], [w[2] for w in whole], rtol=0, atol=2e-9)


@pytest.mark.parametrize("vocabulary", [0, 1, 50, 799, 800, 2000])
def test_vocabulary_cuts_inside_a_count(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(ngrams, "LEVELS", 2)
    monkeypatch.setattr(ngrams, "BINS", 3)
    monkeypatch.setattr(ngrams, "LEAST_SEGMENTS", 4)
    counts = {f"w{i}": 1 if i < 600 else 3 + i % 90 for i in range(800)}
    words = [w for w, n in counts.items() for _ in range(n)]
    docs = spark.createDataFrame([(" ".join(words[i::40]),) for i in range(40)], "text string")
    model = rules.fit(docs, vocabulary=vocabulary)
    h = xxhash.xxh64_intdigest
    want = sorted(counts, key=lambda w: (-counts[w], h(w)))[:vocabulary]
    assert model.words.tolist() == sorted(map(h, want))


def test_counts_of_words_are_deleted_once_read(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(f"w{i} w{i % 7} w{i % 3} w{i}",) for i in range(40)], "text string")
    assert rules.fit_all(docs, vocabulary=5, pairs=0)[1] is not None
    assert len(os.listdir(tmp_path)) == 1


def test_asked_keys_travel_whole():
    rng = np.random.default_rng(3)
    for keys in (rng.integers(0, 2**64, 100, np.uint64), np.zeros(0, np.uint64)):
        assert (ngrams.from_planes(ngrams.planes(keys)) == keys).all()
        assert (ngrams.unpack(ngrams.pack(keys)) == keys).all()
