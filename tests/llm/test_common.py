import os

import pytest

from evenkeel.llm import common


def tables(spark):
    folder = common.shared_folder(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith("stored-")} if os.path.isdir(folder) else set()


def test_settled_leaves_one_table(spark):
    before = tables(spark)

    def inner():
        return common.stored(spark.range(10)).where("id > 3")

    def outer():
        few = common.settled(spark, inner)
        assert len(tables(spark) - before) == 1
        return common.stored(few.where("id < 8")).union(common.stored(spark.range(0)))

    got = common.settled(spark, outer)
    assert len(tables(spark) - before) == 1
    assert sorted(r.id for r in got.collect()) == [4, 5, 6, 7]


def test_a_failed_build_closes_its_list(spark):
    with pytest.raises(ZeroDivisionError):
        common.settled(spark, lambda: 1 // 0)
    kept = common.stored(spark.range(3))
    common.settled(spark, lambda: spark.range(2))
    assert kept.count() == 3


def test_discard(spark):
    before = tables(spark)
    common.discard(common.stored(spark.range(3)), common.stored(spark.range(0)))
    assert tables(spark) == before


def test_whole_texts_go_to_python_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def largest(docs):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

        return docs.mapInArrow(run, "n long").agg(F.max("n")).first()[0]

    rows = spark.range(0, 6000, 1, 1).select(F.col("id").alias("n"), F.repeat(F.lit("text "), 1000).alias("text"))
    own = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "6000000")
        assert common.in_small_batches(rows) is rows and spark.conf.get(key) == "6000000"
        spark.conf.unset(key)
        assert largest(rows) == 6000
        assert 400 < largest(common.in_small_batches(rows)) < 2000
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def rooted(pairs):
    """The smallest node reachable, per node that has a link to another."""
    root = {x: x for a, b in pairs if a != b for x in (a, b)}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("hub", [1, 5, 1000])
def test_components_with_and_without_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    star = [(-3, k) for k in range(100, 140)] + [(k, 500) for k in range(120, 160)]
    chain = [(k, k + 1) for k in range(1000, 1012)]
    pairs = star + chain + [(2000, 2001), (2001, 2000), (2000, 2001), (7, 7), (2100, 2000)]
    got = common.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == rooted(pairs) and len(got) == len(rooted(pairs))
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_star_makes_no_rows_but_its_edges(spark, monkeypatch):
    """Nothing is spread over salts, and a hub's edges are not brought together."""
    monkeypatch.setattr(common, "HUB", 20)
    edges = spark.createDataFrame([(1, k) for k in range(2, 50)] + [(k, 1) for k in range(2, 50)], "a long, b long")
    star = common._star(edges, "a", "b")
    assert sorted(map(tuple, star.collect())) == sorted((r.a, r.b, 2 if r.a == 1 else 1) for r in edges.collect())
    plan = star._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("strategy=broadcast") == 2
