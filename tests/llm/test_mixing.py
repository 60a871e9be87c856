from collections import defaultdict

import duckdb
import pytest
from brute import WORDS, mixing_targets

from evenkeel.llm import mixing, queries


def check(rows, got):
    """rows: (doc_id, text, source); got: mix() rows."""
    size = lambda t: len(WORDS.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = mixing_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.mix_size == size(r.text) and r.mix_source_size == sizes[r.source] and 0 <= r.mix_copies <= 2
        assert r.mix_target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        taken[r.source] += r.mix_size * r.mix_copies
        largest[r.source] = max(largest[r.source], r.mix_size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = mixing.mix(docs).collect()
    check(rows, got)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    assert mixing.repeated(docs).count() == sum(r.mix_copies for r in got)
    assert mixing.repeated(docs).columns == docs.columns


@pytest.mark.parametrize("rows", [
    [], [(1, None, None)], [(1, "", "a"), (2, None, "a")],
    [(1, "a b", "a"), (1, "a b", "a"), (2, "c", None), (None, "d e f", "Z"), (4, "x " * 5000, "é"), (5, "  \x1f", "")],
])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(d, t, s, 1, 2, 3) for d, t, s in rows],
                                 "doc_id long, text string, source string, size int, key int, mix_copies int")
    got = mixing.mix(docs).collect()
    if rows:
        check(rows, got)
    assert len(got) == len(rows)


def test_sql_gives_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    res = con.execute(queries.ORACLE["op9_source_mixing"])
    names = [c[0] for c in res.description]
    got = queries.QUERIES["op9_source_mixing"](spark, sf).select(*names).collect()
    rounded = lambda rows: sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in rows)
    assert rounded(got) == rounded(res.fetchall())


def test_rows_that_share_an_id_or_have_none(spark):
    """The cut may fall between rows of one id, of none, and between rows that are alike."""
    text = lambda n: " ".join(["w"] * n)
    rows = [(7, text(5), "x", i) for i in range(100)]
    rows += [(None, text(1 + i % 9), "y", i) for i in range(90)]
    rows += [(8, text(1 + i % 4), "z", i) for i in range(60)]
    rows += [(i, text(50), None, i) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    found = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r.text, r.source or "", r.n) for r in found) == sorted((d or 0, t, s or "", n) for d, t, s, n in rows)
    for source in ("x", "y", "z", None):
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.mix_size * r.mix_copies for r in mine) - mine[0].mix_target) <= max(r.mix_size for r in mine)
        assert all(0 <= r.mix_copies <= 2 for r in mine)
