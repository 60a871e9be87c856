import pytest
from brute import remainder

from evenkeel.llm import langid, queries


def test_query_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op4_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_backoff_goes_from_words_to_shorter_grams():
    rows = [("a", 0, "foo", 5), ("b", 0, "bar", 5), ("a", 5, "_foox", 1), ("b", 2, "rz", 3), ("a", 1, "q", 1)]
    m = langid.Model(rows)
    best = lambda w: m.langs[int(m.word(w).argmax())]
    assert best("foo") == "a" and best("bar") == "b"
    assert best("fooxy") == "a"  # a five-gram is known
    assert best("arz") == "b"  # only a two-gram is
    assert best("q") == "a" and not m.word("$").any()
    assert langid.runs("Foo12bar_x²") == ["foo", "bar", "x²"] and langid.runs("²1 $") == []


@pytest.mark.parametrize("fit_rows", [1, 50])
def test_odd_rows(spark, fit_rows):
    rows = [(1, "the cat sat", "en"), (1, "the cat sat", "en"), (2, "el gato negro", "es"), (3, None, "en"), (4, "", "es"),
            (5, "123 $$", None), (6, "el " * 50_000, None), (None, "THE CAT", "en")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, gram string, n int")
    model = langid.fit(docs, fit_rows=fit_rows)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[3].score == 0
    if fit_rows == 50:
        assert by[6].lang_pred == "es" and by[None].lang_pred == "en" and by[1].lang_pred == "en"
    empty = docs.limit(0)
    assert langid.predict(empty, langid.fit(empty)).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
