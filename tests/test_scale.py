"""Results do not depend on partitioning, and hot groups neither break nor change them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import balance as B
from evenkeel.operators import cluster, metrics, neighbours, quantiles, rank


def brute_knn(data, k):
    """data: (id, group, vector) -> id -> ids of the k nearest others of the group."""
    out = {}
    for i, g, v in data:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j)
                   for j, h, w in data if h == g and j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def hot_copies(n=240, seed=3):
    """A third of the rows are one and the same point; the rest lie on a small grid (many ties)."""
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        v = [1.0, 1.0, 1.0] if i % 3 == 0 else [float(x) for x in rng.integers(0, 5, 3)]
        data.append((i, "a" if i % 5 else "b", v))
    return data


@pytest.mark.parametrize("block_rows", [2048, 8])
def test_knn_matches_brute_force_with_hot_copies(spark, block_rows):
    data = hot_copies()
    df = spark.createDataFrame(data, "row_id long, g string, features array<double>").repartition(5)
    got = {r["row_id"]: [n["id"] for n in r["neighbours"]]
           for r in neighbours.knn(df, None, ["g"], 4, block_rows=block_rows).collect()}
    assert got == brute_knn(data, 4)


def wave_rows(clustered: bool, n=3000, width=6):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, width))
    if clustered:
        x = x * 0.05 + rng.normal(size=(40, width))[rng.integers(0, 40, n)]
    return x


@pytest.mark.parametrize("clustered", [True, False])
def test_knn_in_waves(spark, clustered, monkeypatch):
    x = wave_rows(clustered)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    visited = []

    def run(waves):
        monkeypatch.setattr(neighbours, "WAVES", waves)
        counts = []
        out = neighbours.knn(df, None, [], 4, block_rows=40, visited=counts).collect()
        visited.append(counts)
        return {r["row_id"]: [n["id"] for n in r["neighbours"]] for r in out}

    assert run((2, 8, 32)) == run(()) == {i: w.tolist() for i, w in enumerate(want)}
    waves, at_once = visited
    assert len(at_once) == 1 and sum(waves) < at_once[0]
    if clustered:  # a vector needs a few of 75 cells
        assert sum(waves) < 8 * len(x)


def test_knn_waves_do_not_depend_on_partitions(spark):
    x = wave_rows(True, 600)
    rows = [(i % 2, i, v.tolist()) for i, v in enumerate(x)]
    seen = []
    for n in (1, 5, 33):
        df = spark.createDataFrame(rows, "g int, row_id long, features array<double>").repartition(n)
        seen.append(sorted((r["row_id"], tuple(n["id"] for n in r["neighbours"]))
                           for r in neighbours.knn(df, None, ["g"], 3, block_rows=12).collect()))
    assert seen[0] == seen[1] == seen[2]


def test_knn_between_two_tables(spark):
    data = hot_copies(90)
    df = spark.createDataFrame(data, "row_id long, g string, features array<double>")
    left, right = df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1")
    got = {r["row_id"]: [n["id"] for n in r["neighbours"]] for r in neighbours.knn(left, right, [], 2, block_rows=6).collect()}
    for i, _, v in data:
        if i % 2 == 0:
            d = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, _, w in data if j % 2)
            assert got[i] == [j for _, j in d[:2]]


@pytest.mark.parametrize("parts,task_rows", [(1, 500_000), (7, 500_000), (16, 20)])
def test_split_and_folds_do_not_depend_on_partitions(spark, parts, task_rows):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    df = df.repartition(parts)
    one = rank.stratified_split(df, "label", "row_id", task_rows=task_rows).where("split = 'test'")
    ids = sorted(r[0] for r in one.select("row_id").collect())
    assert len(ids) == 200
    base = rank.stratified_split(df.coalesce(1), "label", "row_id").where("split = 'test'")
    assert ids == sorted(r[0] for r in base.select("row_id").collect())
    f = rank.stratified_folds(df, "label", "row_id", 4, task_rows=task_rows).groupBy("label", "fold").count().collect()
    assert len(f) == 8 and all(abs(r["count"] - (334 if r["label"] else 666) / 4) < 1 for r in f)


def test_sample_with_many_groups_ranks_instead_of_broadcasting(spark, monkeypatch):
    df = spark.range(600).select("id", (F.col("id") % 50).alias("g"))
    q = rank.group_sizes(df, ["g"]).withColumn("quota", F.lit(3))
    few = sorted(map(tuple, rank.sample_exact(df, ["g"], "id", q).collect()))
    monkeypatch.setattr(rank, "try_rows", lambda _: None)
    assert sorted(map(tuple, rank.sample_exact(df, ["g"], "id", q).collect())) == few and len(few) == 150


def test_hot_value_quantiles(spark):
    values = [5.0] * 700 + [float(i) for i in range(1000)] + [1e6 + i for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    probs = [0.01, 0.25, 0.5, 0.9, 0.999]
    got = quantiles.exact_quantiles(df, ["x"], probs, task_rows=50, accuracy=200)[0]
    assert got == pytest.approx(list(np.quantile(values, probs)))


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_areas_do_not_depend_on_ranges(spark, ranges):
    rng = np.random.default_rng(1)
    s = np.where(rng.random(2000) < 0.4, 0.5, rng.random(2000).round(2))
    y = (rng.random(2000) < s).astype(int)
    df = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y_true int, score double")
    got = metrics.area_under_curves(df, [], ranges=ranges).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert got["roc_auc"] == pytest.approx(auc)


def test_fits_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (80, 4)) for c in (0, 3, 6)])
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "row_id long, features array<double>")
    a, b = (cluster.choose_k(df.repartition(n), 2, 5, n_init=3)[0] for n in (1, 9))
    assert a.k == b.k == 3 and np.allclose(np.sort(a.centers, 0), np.sort(b.centers, 0))


def test_linear_silhouette_equals_definition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (60, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>").repartition(4)
    model = cluster.fit_kmeans(df, [3], n_init=1)[0]
    lab = ((x[:, None, :] - model.centers[None]) ** 2).sum(2).argmin(1)
    d = ((x[:, None, :] - x[None]) ** 2).sum(2)
    s = []
    for i in range(60):
        own = lab == lab[i]
        a = d[i, own].sum() / max(own.sum() - 1, 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
    assert cluster.silhouettes(df, [model])[0] == pytest.approx(np.mean(s))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_moves_no_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 9 == 0).cast("int").alias("label"))
    out = rank.stratified_split(df, "label", "row_id")
    assert "hashpartitioning" not in plan_of(out) and "SinglePartition" not in plan_of(out)
    kept = B.random_undersample(df)
    assert "hashpartitioning" not in plan_of(kept) and "SinglePartition" not in plan_of(kept)


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 40").select("l_tax")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan_of(df)


def test_rank_keeps_groups_spread(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") >= 0, "hot").alias("g"))
    out = rank.hash_rank(df, ["g"], "id", rank.row_key("id", 1))
    assert sorted(r["rank"] for r in out.collect()) == list(range(3000))
    assert "SinglePartition" not in plan_of(out)


def test_many_copies_of_one_base_are_cut_in_runs(spark):
    df = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0])], "row_id long, label int, features array<double>")
    quotas = spark.createDataFrame([(0, 2, 200_001)], "label int, n long, quota long")
    bases = B.smote_bases(df, ["label"], quotas)
    per = {r["row_id"]: (r["n"], r["low"], r["high"]) for r in bases.groupBy("row_id").agg(
        F.countDistinct("copy").alias("n"), F.min("copy").alias("low"), F.max("copy").alias("high")).collect()}
    assert sorted(per.values()) == [(100_000, 1, 100_000), (100_001, 1, 100_001)]


@pytest.mark.parametrize("ranges", [None, 1, 3, 40])
def test_thin_roc_curve(spark, ranges):
    """Only inner points on a line go; cut into score ranges or not, the same points and the same area."""
    rng = np.random.default_rng(11)
    rows = [("a", int(rng.random() < 0.3), float(rng.integers(0, 60))) for _ in range(400)]
    rows += [("b", 1, float(i)) for i in range(20)] + [("b", 0, float(i)) for i in range(20)] + [("c", 1, 0.5), ("d", 0, 0.1), ("d", 1, 0.2)]
    df = spark.createDataFrame(rows, "g string, y_true int, score double").repartition(3)
    got = {}
    for r in metrics.roc_curve(df, ["g"], ranges=ranges, thin=True).collect():
        got.setdefault(r["g"], []).append((r["threshold"], r["fpr"], r["tpr"]))
    for g in "abcd":
        own = [(y, s) for h, y, s in rows if h == g]
        scores = sorted({s for _, s in own}, reverse=True)
        tps = np.cumsum([sum(y for y, t in own if t == s) for s in scores])
        fps = np.cumsum([sum(1 - y for y, t in own if t == s) for s in scores])
        keep = np.ones(len(scores), bool)
        if len(scores) > 2:
            keep[1:-1] = (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0)
        share = lambda x: None if not x[-1] else x
        want = [(s, None if share(fps) is None else fps[i] / fps[-1], None if share(tps) is None else tps[i] / tps[-1])
                for i, s in enumerate(scores) if keep[i]]
        assert sorted((p for p in got[g] if p[0] is not None), reverse=True) == want
        assert [p[1:] for p in got[g] if p[0] is None] == [(0.0, 0.0)]
    line = sorted((p[1], p[2]) for p in got["a"])
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(line, line[1:]))
    full = metrics.area_under_curves(df.where("g = 'a'"), ["g"]).first()["roc_auc"]
    assert area == pytest.approx(full) and len(got["b"]) == 3


def test_given_ranges_grow_with_a_key(spark, monkeypatch):
    """A curve with a given number of ranges is cut further where a key has more rows than a task should sort."""
    df = spark.range(400).select((F.col("id") % 3 == 0).cast("int").alias("y_true"), ((F.col("id") * 37) % 401 / 7).alias("score"),
                                 F.when(F.col("id") < 390, "large").otherwise("few").alias("k"))
    curve = lambda **o: sorted(map(str, metrics.roc_curve(df, ["k"], **o).collect()))
    want = [curve(ranges=1), curve(ranges=1, thin=True)]
    cuts = lambda: {r._k.k: len(r._cuts) for r in metrics._score_cuts(df, ["k"], "score", 2).collect()}
    assert cuts() == {"large": 1, "few": 1}
    monkeypatch.setattr(metrics, "RANGE_ROWS", 20)
    assert cuts()["large"] == 19
    assert [curve(ranges=2), curve(ranges=2, thin=True)] == want
