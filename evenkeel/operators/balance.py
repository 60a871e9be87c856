"""Class rebalancing: quotas, under- and over-sampling, and the four methods.

Rows carry ``row_id BIGINT``, ``label``, ``features ARRAY<DOUBLE>``. Results add where a
row comes from: ``is_synthetic``, ``parent_id``, ``neighbour_id``, ``lambda``, ``copy``
(0 for an original; (row_id, copy) is unique). No stage gathers a class or a cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.hashing import hash_key, hash_pick, hash_uniform
from evenkeel.functions.numeric import half_even, half_even_to, lerp
from evenkeel.operators import cluster as C
from evenkeel.operators.neighbours import knn
from evenkeel.operators.rank import (
    DRAW_RUN, cut_rows, group_sizes, largest_remainder, row_key, sample_exact, sample_replacement,
)
from evenkeel.operators.small import bounded_rows, local, local_frame, same

SEED = 42
TRACE = {"is_synthetic": "boolean", "parent_id": "long", "neighbour_id": "long",
         "lambda": "double", "copy": "long"}

#: Parameter presets per scenario.
PRESETS = {
    "binary_classification": {"max_clusters_maj": 8, "max_clusters_min": 6, "k_smote": 3, "min_cluster_obs": 5},
    "multiclass_small": {"max_clusters_maj": 6, "max_clusters_min": 4, "k_smote": 2, "min_cluster_obs": 3},
    "multiclass_large": {"max_clusters_maj": 10, "max_clusters_min": 8, "k_smote": 5, "min_cluster_obs": 5},
}


# ---- class statistics and quotas ------------------------------------------------------

def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return group_sizes(df, [label])


def majority_minority(sizes: DataFrame, label: str = "label") -> DataFrame:
    """One row: the two most frequent labels, their counts, and all rows.

    Equal counts: the smaller label is the majority, so the two always differ.
    """
    order = Window.orderBy(F.desc("n"), F.asc(label))
    ranked = sizes.withColumn("_r", F.row_number().over(order))
    pick = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    return ranked.agg(
        pick(1, label).alias("majority"), pick(2, label).alias("minority"),
        pick(1, "n").alias("n_majority"), pick(2, "n").alias("n_minority"), F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("classes"),
    )


def imbalance_ratio(sizes: DataFrame) -> DataFrame:
    ratio = F.max("n") / F.min("n")
    return sizes.agg(ratio.alias("ratio"), half_even_to(ratio, 2).alias("ratio_2"))


def class_quota(total: Column, classes: int = 2) -> Column:
    """Rows every class should end with."""
    return F.floor(total / classes).cast("long")


def even_quotas(sizes: DataFrame, total: int, majority: bool) -> DataFrame:
    """Cluster quotas, half-even: kept rows of a majority cluster, new rows of a minority one."""
    share = half_even(F.col("weight") * F.lit(float(total)) / 2)
    quota = F.least(share, F.col("n")) if majority else F.greatest(share - F.col("n"), F.lit(0))
    return sizes.withColumn("quota", quota.cast("long"))


def truncated_quotas(sizes: DataFrame, target: int) -> DataFrame:
    """Cluster quotas, truncated but at least 1."""
    return sizes.withColumn(
        "quota", F.greatest(F.lit(1).cast("long"), F.floor(F.col("weight") * F.lit(float(target))).cast("long")))


def recommended_params(df: DataFrame, label: str = "label", scenario: str = "auto") -> DataFrame:
    """Preset for a table: two classes, else fewer or more than 1000 rows."""
    stats = df.agg(F.count_distinct(label).alias("classes"), F.count(F.lit(1)).alias("n"))
    auto = (F.when(F.col("classes") == 2, "binary_classification")
            .when(F.col("n") < 1000, "multiclass_small").otherwise("multiclass_large"))
    named = stats.withColumn("scenario", auto if scenario == "auto" else F.lit(
        scenario if scenario in PRESETS else "binary_classification"))
    out = named
    for p in ("max_clusters_maj", "max_clusters_min", "k_smote", "min_cluster_obs"):
        value = F.lit(None).cast("int")
        for s, preset in PRESETS.items():
            value = F.when(F.col("scenario") == s, preset[p]).otherwise(value)
        out = out.withColumn(p, value)
    return out


# ---- building blocks -------------------------------------------------------------------

def as_original(df: DataFrame) -> DataFrame:
    null = {"parent_id": F.lit(None), "neighbour_id": F.lit(None), "lambda": F.lit(None)}
    return df.select("*", *[
        (F.lit(False) if c == "is_synthetic" else F.lit(0) if c == "copy" else null[c]).cast(t).alias(c)
        for c, t in TRACE.items()])


def undersample(df: DataFrame, by: list[str], quotas: DataFrame, seed: int = SEED, id_col: str = "row_id") -> DataFrame:
    """Exactly ``quota`` original rows per group, without replacement."""
    return sample_exact(df, by, id_col, quotas, seed, "under")


def random_undersample(df: DataFrame, label: str = "label", seed: int = SEED, id_col: str = "row_id") -> DataFrame:
    """Majority rows cut to min(N // 2, size); other classes stay whole."""
    quotas = class_under_quotas(class_counts(df, label), label)
    return undersample(df, [label], quotas, seed, id_col)


def class_under_quotas(sizes: DataFrame, label: str = "label") -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())
    first = F.row_number().over(Window.orderBy(F.desc("n"), F.asc(label))) == 1
    return sizes.withColumn("quota", F.when(
        first, F.least(class_quota(total), F.col("n"))).otherwise(F.col("n")).cast("long"))


def duplicate(df: DataFrame, by: list[str], quotas: DataFrame, seed: int = SEED, id_col: str = "row_id") -> DataFrame:
    """``quota`` extra copies per group, drawn with replacement."""
    drawn = sample_replacement(df, by, id_col, quotas, seed, "dup")
    return drawn.select(
        *df.columns, F.lit(True).alias("is_synthetic"), F.col(id_col).cast("long").alias("parent_id"),
        F.col(id_col).cast("long").alias("neighbour_id"), F.lit(0.0).alias("lambda"),
        (F.col("draw") + 1).cast("long").alias("copy"))


def smote_bases(df: DataFrame, by: list[str], quotas: DataFrame, mode: str = "allocated",
                seed: int = SEED, id_col: str = "row_id") -> DataFrame:
    """Which row is the base of which new row: ``by``, ``id_col``, ``copy`` (from 1).

    ``allocated``: every row gets floor(quota / n) and the rows of lowest hash one more;
    map-only. ``uniform``: independent draws with replacement, looked up by exact rank.
    """
    if mode == "uniform":
        drawn = sample_replacement(df.select(*by, id_col), by, id_col, quotas, seed, "base")
        return drawn.select(*by, id_col, (F.col("draw") + 1).alias("copy"))
    if mode != "allocated":
        raise ValueError(f"unknown mode: {mode}")
    spark, key = df.sparkSession, row_key(id_col, seed, "base")
    q = [(*[r[c] for c in by], r["n"], r["quota"]) for r in bounded_rows(quotas.select(*by, "n", "quota")) if r["quota"] > 0]
    cuts, schema = cut_rows(df, by, id_col, [(*g, n, m % n) for *g, n, m in q], key)
    found = {tuple(g): (k, i) for *g, _, k, i in cuts}
    plan = local_frame(
        spark, [(*g, m // n, *found.get(tuple(g), (None, None))) for *g, n, m in q],
        T.StructType([*[df.schema[c] for c in by], T.StructField("each", T.LongType()),
                      schema["cut_key"], schema["cut_id"]]))
    extra = F.coalesce((key < F.col("r.cut_key")) | (
        (key == F.col("r.cut_key")) & (F.struct(F.col(id_col)) <= F.col("r.cut_id"))), F.lit(False))
    copies = F.col("r.each") + F.when(extra, 1).otherwise(0)
    last = F.floor((F.col("_m") - 1) / DRAW_RUN).cast("long")
    runs = (
        df.alias("l").join(F.broadcast(plan).alias("r"), same(by))
        .select(*[F.col(f"l.{c}") for c in (*by, id_col)], copies.cast("long").alias("_m"))
        .where(F.col("_m") > 0)
        .select(*by, id_col, "_m", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_run"))
    )
    if any(m // n >= DRAW_RUN for *_, n, m in q):  # runs of one row are made in tasks of their own
        runs = runs.repartition(*by, id_col, "_run")
    first = F.col("_run") * DRAW_RUN
    return runs.select(*by, id_col, F.explode(F.sequence(first + 1, F.least(F.col("_m"), first + DRAW_RUN))).alias("copy"))


def smote(df: DataFrame, by: list[str], quotas: DataFrame, k: int = 5, mode: str = "allocated",
          seed: int = SEED, id_col: str = "row_id", features: str = "features") -> DataFrame:
    """``quota`` new rows per group, each on the segment from a row to one of its k neighbours.

    Neighbours come from the same group, at most size - 1 of them; groups of fewer than
    two rows give none. Only rows that became a base look up their neighbours.
    """
    quotas = local(quotas.where((F.col("n") >= 2) & (F.col("quota") > 0)))
    rows = df.alias("l").join(F.broadcast(quotas).alias("r"), same(by), "left_semi")
    bases = smote_bases(rows, by, quotas, mode, seed, id_col)
    near = knn(rows.select(*by, id_col, features), None, by, k, id_col, features)
    draw = lambda part: hash_key(seed, F.lit(part), *[F.col(f"b.{c}") for c in by],
                                 F.col(f"b.{id_col}"), F.col("b.copy"))
    ids = F.col("n.neighbours")
    picks = bases.alias("b").join(near.alias("n"), same([*by, id_col], "b", "n")).select(
        *[F.col(f"b.{c}") for c in by], F.col(f"b.{id_col}").alias("_base"), F.col("b.copy").alias("copy"),
        F.get(ids, hash_pick(draw("pick"), F.size(ids)).cast("int"))["id"].alias("_near"),
        hash_uniform(draw("lambda")).alias("lambda"))
    with_base = picks.alias("p").join(
        rows.alias("a"), same(by, "p", "a") & (F.col("p._base") == F.col(f"a.{id_col}"))
    ).select("p._base", "p._near", "p.lambda", "p.copy",
             *[F.col(f"a.{c}").alias(c) for c in df.columns])
    far = rows.select(*[F.col(c).alias(f"_f_{c}") for c in by], F.col(id_col).alias("_far_id"),
                      F.col(features).alias("_far"))
    cond = F.col("_near") == F.col("_far_id")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    made = with_base.join(far, cond)
    return made.select(
        *[lerp(F.col(features), F.col("_far"), F.col("lambda")).alias(c) if c == features else F.col(c)
          for c in df.columns],
        F.lit(True).alias("is_synthetic"), F.col("_base").cast("long").alias("parent_id"),
        F.col("_near").cast("long").alias("neighbour_id"), "lambda", "copy")


def centroid_undersample(df: DataFrame, by: list[str], quotas: DataFrame, seed: int = SEED,
                         id_col: str = "row_id", features: str = "features") -> DataFrame:
    """Exactly ``quota`` representatives per block: sampled pivots, each replaced by the mean
    of the rows nearest to it. The pivot itself always belongs to its own mean.
    """
    pivots = sample_exact(df, by, id_col, quotas, seed, "pivot")
    rest = df.alias("l").join(pivots.select(*by, id_col).alias("r"), same([*by, id_col]), "left_anti")
    near = knn(rest, pivots, by, 1, id_col, features)
    home = near.select(*by, F.col(id_col), F.get("neighbours", F.lit(0))["id"].alias("_pivot"))
    members = rest.alias("l").join(home.alias("r"), same([*by, id_col])).select(
        *[F.col(f"l.{c}") for c in by], "r._pivot", F.col(f"l.{features}").alias(features))
    members = members.unionByName(pivots.select(*by, F.col(id_col).alias("_pivot"), features))
    means = C.mean_by(members, [*by, "_pivot"], features, "_mean")
    keep = [c for c in df.columns if c != features]
    return (
        pivots.select(*keep).alias("l")
        .join(means.alias("r"), same(by) & (F.col(f"l.{id_col}") == F.col("r._pivot")))
        .select(*[F.col("r._mean").alias(c) if c == features else F.col(f"l.{c}") for c in df.columns],
                F.lit(True).alias("is_synthetic"), F.col(f"l.{id_col}").cast("long").alias("parent_id"),
                F.lit(None).cast("long").alias("neighbour_id"), F.lit(None).cast("double").alias("lambda"),
                F.lit(0).cast("long").alias("copy"))
    )


def hybrid_quotas(sizes: DataFrame, target: int, k: int) -> DataFrame:
    """Branch per cluster: keep (sample down), copy (too small for k neighbours), grow (SMOTE)."""
    q = truncated_quotas(sizes, target)
    branch = (F.when(F.col("quota") <= F.col("n"), "keep")
              .when(F.col("n") < k + 1, "copy").otherwise("grow"))
    return q.withColumn("branch", branch)


def balance_per_cluster(df: DataFrame, cluster: str, target: int, k: int = 3, seed: int = SEED,
                        mode: str = "allocated", id_col: str = "row_id") -> DataFrame:
    """Every cluster to its truncated share of ``target``: sampled down, duplicated or grown.

    Growing clusters keep all originals and get exactly quota - size new rows.
    """
    q = local(hybrid_quotas(C.cluster_sizes(df, cluster), target, k))
    kept = undersample(df, [cluster], q, seed, id_col)
    more = q.withColumn("quota", F.greatest(F.col("quota") - F.col("n"), F.lit(0)))
    out = as_original(kept)
    if q.where(F.col("branch") == "copy").head(1):
        out = out.unionByName(duplicate(df, [cluster], more.where(F.col("branch") == "copy"), seed, id_col))
    if q.where(F.col("branch") == "grow").head(1):
        out = out.unionByName(smote(df, [cluster], more.where(F.col("branch") == "grow"), k, mode, seed, id_col))
    return out


# ---- the four methods --------------------------------------------------------------------

def _classes(df: DataFrame, label: str) -> dict:
    stats = bounded_rows(majority_minority(class_counts(df, label), label))[0].asDict()
    if stats["classes"] != 2:  # a further class would be lost
        raise ValueError(f"binary labels expected, got {stats['classes']} classes")
    return stats


def balance_unbalanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Baseline: the training rows as they are."""
    return as_original(df)


def balance_smote(df: DataFrame, label: str = "label", k: int = 5, seed: int = SEED,
                  mode: str = "allocated", id_col: str = "row_id") -> DataFrame:
    """N // 2 rows per class: majority sampled down, minority grown. Two classes only."""
    s = _classes(df, label)
    target = s["total"] // 2
    sizes = [(s["majority"], s["n_majority"]), (s["minority"], s["n_minority"])]
    sizes = local_frame(df.sparkSession, sizes, df.select(label, F.lit(0).cast("long").alias("n")).schema)
    kept = undersample(df, [label], sizes.withColumn(
        "quota", F.least(F.lit(target).cast("long"), F.col("n"))), seed, id_col)
    need = sizes.where(F.col(label) == F.lit(s["minority"])).withColumn(
        "quota", F.greatest(F.lit(target).cast("long") - F.col("n"), F.lit(0)))
    return as_original(kept).unionByName(smote(df, [label], need, k, mode, seed, id_col))


def balance_csbboost(df: DataFrame, label: str = "label", k: int = 5, k_range_major=(2, 10),
                     k_range_minor=(2, 10), n_init: int = 10, seed: int = SEED,
                     mode: str = "allocated", id_col: str = "row_id") -> DataFrame:
    """Clustered under-sampling of the majority, per-cluster SMOTE of the minority. Two classes only."""
    s = _classes(df, label)
    major = df.where(F.col(label) == F.lit(s["majority"]))
    minor = df.where(F.col(label) == F.lit(s["minority"]))
    m_major, _ = C.choose_k(major, *k_range_major, id_col=id_col, n_init=n_init, seed=seed)
    m_minor, _ = C.choose_k(minor, *k_range_minor, id_col=id_col, n_init=n_init, seed=seed)
    major, minor = m_major.assign(major), m_minor.assign(minor)
    q_major = local(even_quotas(C.cluster_sizes(major), s["total"], majority=True))
    q_minor = local(even_quotas(C.cluster_sizes(minor), s["total"], majority=False))
    out = as_original(undersample(major, ["cluster"], q_major, seed, id_col)).unionByName(as_original(minor))
    if q_minor.where(F.col("quota") > 0).head(1):
        out = out.unionByName(smote(minor, ["cluster"], q_minor, k, mode, seed, id_col))
    return out


def balance_hcbou(df: DataFrame, label: str = "label", max_clusters_maj: int = 8,
                  max_clusters_min: int = 6, k_smote: int = 3, min_cluster_obs: int = 5,
                  n_init: int = 10, seed: int = SEED, mode: str = "allocated",
                  id_col: str = "row_id") -> DataFrame:
    """Majority to N // 2 centroids, minority clustered and balanced cluster by cluster. Two classes only."""
    s = _classes(df, label)
    target = s["total"] // 2
    major = df.where(F.col(label) == F.lit(s["majority"]))
    minor = df.where(F.col(label) == F.lit(s["minority"]))
    blocks = min(max_clusters_maj, s["n_majority"])
    major = C.fit_kmeans(major, [blocks], id_col, n_init=1, max_iter=20, seed=seed)[0].assign(major)
    wanted = min(target, s["n_majority"])
    q_major = largest_remainder(C.cluster_sizes(major).drop("weight"), F.lit(wanted), ["cluster"])
    reps = centroid_undersample(major, ["cluster"], local(q_major), seed, id_col)
    model, _ = C.choose_k(minor, 2, max_clusters_min, min_cluster_obs, id_col, n_init=n_init,
                          max_iter=1000, seed=seed)
    minor = model.assign(minor)
    if model.k > 1:
        sizes = C.cluster_sizes(minor)
        centers = local_frame(df.sparkSession, [(i, list(map(float, c))) for i, c in enumerate(model.centers)],
                              "cluster int, center array<double>")
        minor = C.relabel(minor, C.merge_small_clusters(sizes, centers, min_cluster_obs))
    grown = balance_per_cluster(minor, "cluster", target, k_smote, seed, mode, id_col)
    return reps.unionByName(grown)


def class_cluster_quotas(df: DataFrame, label: str = "label", cluster: str = "cluster", k: int = 3) -> DataFrame:
    """(label, cluster, n, quota, branch): rows that each cluster of each class ends with, for any number of classes.

    Classes share the rows evenly, the larger ones taking what is over, ties to the smaller label. Clusters share their
    class's rows by size with largest remainders, so both levels add up exactly. Branches: ``shrink`` to centroids,
    ``keep``, ``copy`` where a cluster has too few rows for k neighbours, else ``grow``.
    """
    sizes = df.groupBy(label, cluster).agg(F.count(F.lit(1)).alias("n"))
    classes = sizes.groupBy(label).agg(F.sum("n").alias("size"))
    everything = Window.partitionBy()
    total, number = F.sum("size").over(everything), F.count(F.lit(1)).over(everything)
    over = F.row_number().over(Window.orderBy(F.desc("size"), F.asc(label))) <= total % number
    targets = classes.withColumn("target", class_quota(total, number) + F.when(over, 1).otherwise(0))
    sizes = sizes.alias("l").join(targets.alias("r"), same([label])).select("l.*", "r.target")
    quotas = largest_remainder(sizes, F.col("target"), [cluster], [label]).drop("target")
    branch = (F.when(F.col("quota") < F.col("n"), "shrink").when(F.col("quota") == F.col("n"), "keep")
              .when(F.col("n") < k + 1, "copy").otherwise("grow"))
    return quotas.withColumn("branch", branch)


def balance_classes(df: DataFrame, label: str = "label", cluster: str = "cluster", k: int = 3, seed: int = SEED,
                    mode: str = "allocated", id_col: str = "row_id") -> DataFrame:
    """Every class to its even share of the rows, given clusters inside each class; any number of classes.

    (class, cluster) is one key of the plan: all clusters of all classes shrink, grow or are copied in the same jobs,
    so their number does not grow with the classes. Shrinking replaces rows by means of their nearest, growing keeps
    all originals. A NULL label or cluster is one of its own. An empty table stays empty.
    """
    by = [label, cluster]
    q = local(class_cluster_quotas(df, label, cluster, k))
    part = lambda *b: q.where(F.col("branch").isin(*b))
    rows = lambda *b: df.alias("l").join(F.broadcast(part(*b)).alias("r"), same(by), "left_semi")
    more = lambda b: part(b).withColumn("quota", F.col("quota") - F.col("n"))
    here = {r["branch"] for r in bounded_rows(q.select("branch").distinct())}
    out = as_original(rows("keep", "copy", "grow"))
    if "shrink" in here:
        out = out.unionByName(centroid_undersample(rows("shrink"), by, part("shrink"), seed, id_col))
    if "copy" in here:
        out = out.unionByName(duplicate(rows("copy"), by, more("copy"), seed, id_col))
    if "grow" in here:
        out = out.unionByName(smote(rows("grow"), by, more("grow"), k, mode, seed, id_col))
    return out


METHODS = {"unbalanced": balance_unbalanced, "csbboost": balance_csbboost,
           "hcbou": balance_hcbou, "smote": balance_smote}


def balance(df: DataFrame, method: str, **options) -> DataFrame:
    """Rebalanced training rows; the label keeps its input name in every method."""
    if method not in METHODS:
        raise ValueError(f"unknown balancing method: {method}")
    out = METHODS[method](df, **options)
    return out.drop("cluster") if "cluster" not in df.columns else out


def permuted(df: DataFrame, id_col: list[str], seed: int = SEED) -> DataFrame:
    """Rows in a random but repeatable order, for ordered exports."""
    return df.orderBy(hash_key(seed, F.lit("order"), *id_col), *id_col)
