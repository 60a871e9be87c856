"""Registered queries over the driver tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import balance as B
from evenkeel.operators import bayes, cluster, metrics, neighbours, prep, quantiles, rank, report, scale, tuning
from evenkeel.functions import half_even, half_even_to, hash_key, hash_uniform
from evenkeel.operators.small import local, local_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


# ---- inputs --------------------------------------------------------------------------------

def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """row_id, label (1 for the rare class), cluster, features."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("label"),
        F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("features"))


def toxic(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return prep.join_labels(docs, table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"), "n_chars", "lang", "source", "quality")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Scores of three rules for one target, keyed like stored results."""
    li = table(spark, d, "lineitem")
    rule = lambda name, col, cut: F.struct(
        F.lit(name).alias("model"), F.col(col).alias("score"), (F.col(col) >= cut).cast("int").alias("y_pred"))
    return li.select(
        F.col("l_linenumber").cast("string").alias("dataset"),
        prep.label_lookup(F.col("l_returnflag"), {"A": "csbboost", "N": "hcbou", "R": "smote"}).alias("balancing_method"),
        prep.label_lookup(F.col("l_linestatus"), {"F": "standard", "O": "robust"}).alias("scaler_type"),
        (F.col("l_tax") >= 0.06).cast("int").alias("y_true"),
        F.explode(F.array(rule("svm", "l_quantity", 25), rule("naive_bayes_gaussian", "l_extendedprice", 30000),
                          rule("decision_tree", "l_discount", 0.05))).alias("m"),
    ).select("dataset", "balancing_method", "scaler_type", "m.model", "y_true", "m.y_pred", "m.score")


KEYS = ["dataset", "balancing_method", "scaler_type", "model"]
_K = ", ".join(KEYS)

_SCORED = """scored AS (
 SELECT CAST(l_linenumber AS VARCHAR) AS dataset,
  CASE l_returnflag WHEN 'A' THEN 'csbboost' WHEN 'N' THEN 'hcbou' WHEN 'R' THEN 'smote' ELSE l_returnflag END AS balancing_method,
  CASE l_linestatus WHEN 'F' THEN 'standard' WHEN 'O' THEN 'robust' ELSE l_linestatus END AS scaler_type,
  m.model, CAST(l_tax >= 0.06 AS INT) AS y_true, CAST(m.score >= m.cut AS INT) AS y_pred, m.score
 FROM lineitem, LATERAL (VALUES ('svm', l_quantity, 25.0::DOUBLE), ('naive_bayes_gaussian', l_extendedprice, 30000.0::DOUBLE),
  ('decision_tree', l_discount, 0.05::DOUBLE)) AS m(model, score, cut))"""
_CONF = _SCORED + f""", conf AS (SELECT {_K},
  count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
  count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn
 FROM scored GROUP BY ALL)"""
_RATES = _CONF + """, rates AS (SELECT *, tp + fn AS p, tn + fp AS n, tp + tn + fp + fn AS total,
  (fp + fn) / (tp + tn + fp + fn)::DOUBLE AS error, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy,
  coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS fpr,
  coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tn / nullif(fp + tn, 0)::DOUBLE, 0) AS specificity,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM conf)"""
_POINTS = _SCORED + f""", pts AS (SELECT {_K}, score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM scored GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER (PARTITION BY {_K}) AS np, sum(neg) OVER (PARTITION BY {_K}) AS nn FROM pts
  WINDOW w AS (PARTITION BY {_K} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
_AUC = _POINTS + f""", areas AS (SELECT {_K},
  sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / nullif(any_value(np) * any_value(nn), 0)::DOUBLE AS roc_auc,
  sum(pos * (tp / (tp + fp)::DOUBLE + coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0)::DOUBLE, 1)) / 2)
   / nullif(any_value(np), 0)::DOUBLE AS pr_auc FROM cum GROUP BY ALL)"""
_EMB = """emb AS (SELECT vec_id AS row_id, CAST(label = 0 AS INT) AS label, label AS cluster,
  embedding::DOUBLE[] AS features FROM embeddings)"""
_DIMS = _EMB + """, dims AS (SELECT row_id, label, cluster, unnest(range(len(features)))::INT AS dim,
  unnest(features) AS x FROM emb)"""
_TOXIC = """toxic AS (SELECT doc_id AS row_id, toxic AS label, n_chars, lang, source, quality
  FROM documents JOIN labels USING (doc_id))"""
_U32 = "(('0x' || substr({0}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_U52 = "(('0x' || substr({0}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return half_even_to(c.cast("double"), 6) + F.lit(0.0)


def q6(expr: str) -> str:
    return f"(round_even(({expr})::DOUBLE * 1000000, 0) / 1000000 + 0.0)"


def dims(df: DataFrame, features: str = "features") -> DataFrame:
    return df.select("*", F.posexplode(features).alias("dim", "value")).drop(features).withColumn(
        "value", r6("value"))


# ---- preparation -----------------------------------------------------------------------------

@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_projection(spark, d):
    return prep.numeric_projection(table(spark, d, "orders"))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def numeric_restricted(spark, d):
    return prep.numeric_projection(table(spark, d, "customer"), restricted=True)


@query("SELECT doc_id, quality, CAST(toxic AS INT) AS label, n_chars FROM documents JOIN labels USING (doc_id)")
def drop_cast_target(spark, d):
    docs = prep.join_labels(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    return prep.cast_target(prep.drop_if_present(docs, ["lang", "source", "text", "not_there"]), "toxic")


@query("SELECT o_totalprice, o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def schema_alignment(spark, d):
    test = prep.class_filter(table(spark, d, "orders"), "o_orderstatus", "F")
    return prep.align(test, ["o_totalprice", "o_custkey", "o_orderkey"])


@query("""SELECT o_orderkey, o_orderstatus, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INT AS label_code FROM orders""")
def label_encode(spark, d):
    return prep.label_codes(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'Buggy' WHEN 'view' THEN 'No-Buggy' ELSE event_type END AS shown,
 'ev_' || event_type AS event_key FROM events""")
def label_lookup(spark, d):
    return table(spark, d, "events").select(
        "event_id", prep.label_lookup(F.col("event_type"), {"error": "Buggy", "view": "No-Buggy"}).alias("shown"),
        report.config_key(F.lit("ev"), "event_type").alias("event_key"))


@query(f"""SELECT o_orderkey, round_even(o_totalprice / 1000, 0)::BIGINT AS even, round_even(o_totalprice / 1000, 2) AS even_2,
 floor(o_totalprice / 2)::BIGINT AS halved, trunc(o_totalprice * 0.3)::BIGINT AS cut,
 greatest(1000, least(o_totalprice, 200000)) AS clamped, abs(o_totalprice - 150000) AS off,
 CAST(o_orderkey AS VARCHAR) AS as_text, CAST(o_orderstatus = 'F' AS INT) AS is_f,
 {_U32.format("md5('42|' || o_orderkey)")} AS uniform FROM orders""")
def scalar_functions(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", half_even(price / 1000).alias("even"), half_even_to(price / 1000, 2).alias("even_2"),
        F.floor(price / 2).alias("halved"), (price * F.lit(0.3)).cast("long").alias("cut"),
        F.greatest(F.lit(1000.0), F.least(price, F.lit(200000.0))).alias("clamped"),
        F.abs(price - 150000).alias("off"), F.col("o_orderkey").cast("string").alias("as_text"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_f"),
        hash_uniform(hash_key(42, "o_orderkey")).alias("uniform"))


# ---- class statistics, splits, samples ---------------------------------------------------------

@query(f"WITH {_TOXIC} SELECT label, count(*) AS n FROM toxic GROUP BY label")
def class_counts(spark, d):
    return B.class_counts(toxic(spark, d))


@query(f"""WITH {_TOXIC}, c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS r FROM toxic GROUP BY label)
 SELECT max(label) FILTER (r = 1) AS majority, max(label) FILTER (r = 2) AS minority, max(n) FILTER (r = 1) AS n_majority,
  max(n) FILTER (r = 2) AS n_minority, sum(n)::BIGINT AS total, count(*) AS classes FROM c""")
def majority_minority(spark, d):
    return B.majority_minority(B.class_counts(toxic(spark, d)))


@query(f"""WITH {_TOXIC}, c AS (SELECT count(*) AS n FROM toxic GROUP BY label)
 SELECT {q6('max(n) / min(n)::DOUBLE')} AS ratio, round_even(max(n) / min(n)::DOUBLE, 2) AS ratio_2 FROM c""")
def imbalance_ratio(spark, d):
    return B.imbalance_ratio(B.class_counts(toxic(spark, d))).select(r6("ratio").alias("ratio"), "ratio_2")


@query(f"""WITH {_EMB} SELECT count(DISTINCT cluster) AS classes, count(*) AS n,
 CASE WHEN count(DISTINCT cluster) = 2 THEN 'binary_classification' WHEN count(*) < 1000 THEN 'multiclass_small' ELSE 'multiclass_large' END AS scenario,
 CASE WHEN count(DISTINCT cluster) = 2 THEN 8 WHEN count(*) < 1000 THEN 6 ELSE 10 END AS max_clusters_maj,
 CASE WHEN count(DISTINCT cluster) = 2 THEN 6 WHEN count(*) < 1000 THEN 4 ELSE 8 END AS max_clusters_min,
 CASE WHEN count(DISTINCT cluster) = 2 THEN 3 WHEN count(*) < 1000 THEN 2 ELSE 5 END AS k_smote,
 CASE WHEN count(DISTINCT cluster) = 2 THEN 5 WHEN count(*) < 1000 THEN 3 ELSE 5 END AS min_cluster_obs FROM emb""")
def recommended_params(spark, d):
    return B.recommended_params(vectors(spark, d), "cluster")


def _split_sql(rel: str, label: str, key: str, out: str) -> str:
    return f"""c AS (SELECT {label} AS lab, count(*) AS n FROM {rel} GROUP BY 1),
 tot AS (SELECT ceil(0.2::DOUBLE * sum(n)) AS t, sum(n) AS nn FROM c),
 e AS (SELECT lab, n, t, t * n / nn AS exact FROM c, tot),
 q AS (SELECT lab, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, lab)
   <= t - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM e),
 {out} AS (SELECT r.*, CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY md5('42|split|' || {key}), {key}) <= quota
   THEN 'test' ELSE 'train' END AS split FROM {rel} r JOIN q ON q.lab = r.{label})"""


@query("WITH " + _split_sql("orders", "o_orderstatus", "o_orderkey", "s") + " SELECT o_orderkey, o_orderstatus, split FROM s")
def stratified_split(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return rank.stratified_split(orders, "o_orderstatus", "o_orderkey")


@query(f"WITH {_TOXIC}, " + _split_sql("toxic", "label", "row_id", "s") +
       " SELECT label, split, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM s GROUP BY ALL")
def split_counts(spark, d):
    return rank.stratified_split(toxic(spark, d), "label", "row_id").groupBy("label", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT o_orderkey, o_orderstatus, (ntile(3) OVER (PARTITION BY o_orderstatus ORDER BY md5('42|fold|' || o_orderkey), o_orderkey) - 1)::INT AS fold FROM orders""")
def stratified_folds(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return rank.stratified_folds(orders, "o_orderstatus", "o_orderkey", 3)


@query("SELECT o_orderkey, o_orderstatus, (ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::INT AS fold FROM orders")
def ordered_folds(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return rank.stratified_folds(orders, "o_orderstatus", "o_orderkey", 5, shuffle=False)


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "value")


@query("""WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|pick|' || event_id), event_id) AS rn,
 count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, event_type, value FROM r WHERE rn <= n // 10""")
def sample_exact(spark, d):
    ev = _events(spark, d)
    quotas = rank.group_sizes(ev, ["event_type"]).withColumn("quota", F.floor(F.col("n") / 10))
    return rank.sample_exact(ev, ["event_type"], "event_id", quotas, 42, "pick")


@query("""WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|pick|' || event_id), event_id) - 1 AS rk,
 count(*) OVER (PARTITION BY event_type) AS n FROM events),
 dr AS (SELECT event_type, n, unnest(range(n // 4)) AS draw FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)),
 p AS (SELECT event_type, draw, floor(""" + _U52.format("md5('42|pickdraw|' || event_type || '|' || draw)") + """ * n)::BIGINT AS pick FROM dr)
 SELECT event_id, event_type, value, draw FROM p JOIN r USING (event_type) WHERE pick = rk""")
def sample_replacement(spark, d):
    ev = _events(spark, d)
    draws = rank.group_sizes(ev, ["event_type"]).withColumn("quota", F.floor(F.col("n") / 4))
    return rank.sample_replacement(ev, ["event_type"], "event_id", draws, 42, "pick")


@query("""SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|rank|' || event_id), event_id) - 1 AS rank FROM events""")
def hash_rank(spark, d):
    ev = _events(spark, d).drop("value")
    return rank.hash_rank(ev, ["event_type"], "event_id", rank.row_key("event_id", 42, "rank"))


@query("""WITH r AS (SELECT l_returnflag, l_linestatus, l_linenumber, md5('{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus ||
 '","l_linenumber":' || l_linenumber || '}') AS h FROM lineitem)
 SELECT l_returnflag, l_linestatus, l_linenumber, row_number() OVER (ORDER BY h) - 1 AS row_id FROM r""")
def content_row_ids(spark, d):
    return rank.row_ids(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query(f"""WITH {_TOXIC}, c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS r, sum(count(*)) OVER () AS nn FROM toxic GROUP BY label),
 k AS (SELECT t.*, row_number() OVER (PARTITION BY t.label ORDER BY md5('42|under|' || row_id), row_id) AS rn,
  CASE WHEN r = 1 THEN least(nn // 2, n) ELSE n END AS quota FROM toxic t JOIN c USING (label))
 SELECT row_id, label, n_chars FROM k WHERE rn <= quota""")
def undersample_majority(spark, d):
    return B.random_undersample(toxic(spark, d)).select("row_id", "label", "n_chars")


# ---- clusters ------------------------------------------------------------------------------------

_SIZES = """sz AS (SELECT cluster, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS weight, sum(count(*)) OVER () AS nn FROM emb GROUP BY cluster)"""


@query(f"WITH {_EMB}, {_SIZES} SELECT cluster, n, {q6('weight')} AS weight, (n < nn / 10) AS below, min(n) OVER () < nn / 10 AS any_below FROM sz")
def cluster_sizes(spark, d):
    from pyspark.sql import Window

    whole = Window.partitionBy()
    sizes = cluster.cluster_sizes(vectors(spark, d))
    limit = F.sum("n").over(whole) / 10
    return sizes.select("cluster", "n", r6("weight").alias("weight"), (F.col("n") < limit).alias("below"),
                        (F.min("n").over(whole) < limit).alias("any_below"))


@query(f"""WITH {_EMB}, {_SIZES} SELECT cluster, n, least(round_even(weight * nn::DOUBLE / 2, 0), n)::BIGINT AS kept,
 greatest(round_even(weight * (nn * 3)::DOUBLE / 2, 0) - n, 0)::BIGINT AS added FROM sz""")
def cluster_quota_even(spark, d):
    v = vectors(spark, d)
    sizes, n = cluster.cluster_sizes(v), v.count()
    kept = B.even_quotas(sizes, n, True).select("cluster", "n", F.col("quota").alias("kept"))
    return kept.join(B.even_quotas(sizes, 3 * n, False).select("cluster", F.col("quota").alias("added")), "cluster")


@query(f"""WITH {_EMB}, {_SIZES} SELECT cluster, n, greatest(1, floor(weight * (nn * 2)::DOUBLE))::BIGINT AS quota,
 CASE WHEN greatest(1, floor(weight * (nn * 2)::DOUBLE)) <= n THEN 'keep' WHEN n < 49 THEN 'copy' ELSE 'grow' END AS branch FROM sz""")
def cluster_quota_trunc(spark, d):
    v = vectors(spark, d)
    return B.hybrid_quotas(cluster.cluster_sizes(v), 2 * v.count(), 48).select("cluster", "n", "quota", "branch")


@query(f"""WITH {_EMB}, m AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n, count(*) OVER () AS n_ma,
  row_number() OVER (PARTITION BY cluster ORDER BY md5('42|under|' || row_id), row_id) AS rn FROM emb WHERE label = 0)
 SELECT row_id, cluster FROM m WHERE rn <= least(round_even((n / n_ma::DOUBLE) * (SELECT count(*) FROM emb)::DOUBLE / 2, 0), n)""")
def clustered_undersample(spark, d):
    v = vectors(spark, d)
    major = prep.class_filter(v, "label", 0)
    quotas = B.even_quotas(cluster.cluster_sizes(major), v.count(), True)
    return B.undersample(major, ["cluster"], quotas).select("row_id", "cluster")


def _centers(v: DataFrame):
    rows = local(cluster.mean_by(v, ["cluster"])).collect()
    return [r["center"] for r in sorted(rows, key=lambda r: r["cluster"])]


_CENTERS = """cen AS (SELECT cluster, dim, avg(x) AS m FROM dims GROUP BY ALL),
 dist AS (SELECT d.row_id, c.cluster, sum((d.x - c.m) ** 2) AS d2 FROM dims d JOIN cen c USING (dim) GROUP BY ALL),
 near AS (SELECT row_id, arg_min(cluster, d2) AS cluster FROM dist GROUP BY row_id)"""


@query(f"WITH {_DIMS}, {_CENTERS} SELECT row_id, (cluster - (SELECT min(cluster) FROM cen))::INT AS nearest FROM near")
def assign_nearest(spark, d):
    v = vectors(spark, d)
    return cluster.assign_nearest(v, _centers(v), name="nearest").select("row_id", "nearest")


@query(f"""WITH {_DIMS}, {_CENTERS} SELECT n.cluster::INT AS cluster, d.dim, count(*) AS n, {q6('avg(d.x)')} AS value
 FROM near n JOIN dims d USING (row_id) GROUP BY ALL""")
def lloyd_step(spark, d):
    v = vectors(spark, d)
    return dims(cluster.lloyd_step(v.drop("cluster"), _centers(v)), "center")


def _lloyd_sql(steps: int) -> str:
    """CTEs of ``steps`` assign-and-average steps from c0; a centre without rows stays."""
    out = []
    for i in range(steps):
        out.append(f"""d{i} AS (SELECT d.row_id, c.cluster, sum((d.x - c.m) ** 2) AS d2 FROM dims d JOIN c{i} c USING (dim) GROUP BY ALL),
 a{i} AS (SELECT row_id, arg_min(cluster, struct_pack(d := d2, c := cluster)) AS cluster, min(d2) AS d2 FROM d{i} GROUP BY row_id),
 m{i} AS (SELECT a.cluster, d.dim, avg(d.x) AS m, count(*) AS n FROM a{i} a JOIN dims d USING (row_id) GROUP BY ALL),
 c{i + 1} AS (SELECT c.cluster, c.dim, coalesce(m.m, c.m) AS m, coalesce(m.n, 0) AS n FROM c{i} c LEFT JOIN m{i} m USING (cluster, dim))""")
    return ", ".join(out)


@query(f"""WITH {_DIMS}, c0 AS (SELECT (row_number() OVER (PARTITION BY dim ORDER BY row_id) - 1)::INT AS cluster, dim, x AS m
  FROM dims WHERE row_id < 5), {_lloyd_sql(3)}, cost AS (SELECT sum(d2) AS cost FROM a2)
 SELECT cluster, dim, {q6('m')} AS value, {q6('cost')} AS cost FROM c3, cost""")
def kmeans_fixed_start(spark, d):
    """Three steps from the five vectors of smallest id."""
    v = vectors(spark, d)
    first = [r["features"] for r in v.where("row_id < 5").orderBy("row_id").limit(5).collect()]
    found = cluster.settle(v, [first], max_iter=3, tol=0.0)[0]
    rows = [(i, center.tolist(), found.cost) for i, center in enumerate(found.centers)]
    return dims(local_frame(spark, rows, "cluster int, center array<double>, cost double"), "center").withColumn("cost", r6("cost"))


@query(f"""WITH {_DIMS}, {_SIZES}, cen AS (SELECT cluster, dim, avg(x) AS m FROM dims GROUP BY ALL),
 pair AS (SELECT a.cluster, b.cluster AS other, sqrt(sum((a.m - b.m) ** 2)) AS dd FROM cen a JOIN cen b USING (dim)
  JOIN sz sb ON sb.cluster = b.cluster WHERE sb.n >= sb.nn / 10 GROUP BY ALL),
 best AS (SELECT cluster, arg_min(other, dd) AS other FROM pair GROUP BY cluster)
 SELECT s.cluster, CASE WHEN s.n < s.nn / 10 THEN coalesce(b.other, s.cluster) ELSE s.cluster END AS merged
 FROM sz s LEFT JOIN best b USING (cluster)""")
def merge_small_clusters(spark, d):
    v = vectors(spark, d)
    centers = cluster.mean_by(v, ["cluster"]).select("cluster", "center")
    return cluster.merge_small_clusters(cluster.cluster_sizes(v), centers, -(-v.count() // 10))


@query(f"""WITH {_EMB}, n AS (SELECT cluster, count(*) AS n FROM emb GROUP BY 1),
 pair AS (SELECT a.row_id, a.cluster, b.cluster AS other, sum(list_distance(a.features, b.features)) AS t FROM emb a, emb b GROUP BY ALL),
 ab AS (SELECT p.row_id, p.cluster, max(CASE WHEN other = p.cluster AND n > 1 THEN t / (n - 1) END) AS a,
  min(CASE WHEN other <> p.cluster THEN t / n END) AS b FROM pair p JOIN n ON n.cluster = p.other GROUP BY ALL)
 SELECT row_id, cluster, {q6('coalesce((b - a) / nullif(greatest(a, b), 0), 0)')} AS silhouette FROM ab""")
def silhouette_exact(spark, d):
    out = cluster.silhouette_exact(vectors(spark, d))
    return out.select("row_id", "cluster", r6("silhouette").alias("silhouette"))


# ---- neighbours and resampling ---------------------------------------------------------------------

def _knn_sql(group: str, k: int, where: str = "") -> str:
    return f"""nn AS (SELECT * FROM (SELECT a.row_id, b.row_id AS neighbour, list_distance(a.features, b.features) AS distance,
  row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.features, b.features), b.row_id) AS rank
  FROM emb a JOIN emb b ON a.{group} = b.{group} AND a.row_id <> b.row_id {where}) WHERE rank <= {k})"""


@query(f"WITH {_EMB}, {_knn_sql('cluster', 5)} SELECT row_id, cluster, rank, neighbour, {q6('distance')} AS distance FROM nn JOIN emb USING (row_id)")
def knn_within_class(spark, d):
    near = neighbours.knn(vectors(spark, d), None, ["cluster"], 5)
    return near.select("row_id", "cluster", F.posexplode("neighbours").alias("p", "n")).select(
        "row_id", "cluster", (F.col("p") + 1).cast("long").alias("rank"), F.col("n.id").alias("neighbour"),
        r6("n.distance").alias("distance"))


def _smote_sql(group: str, k: int, quota: str, where: str, mode: str = "allocated") -> str:
    """CTE ``syn``: parent_id, neighbour_id, lambda, copy and both feature lists."""
    if mode == "allocated":
        bases = f"""b AS (SELECT row_id, g, unnest(range(1, 1 + (quota // n + CASE WHEN rn <= quota % n THEN 1 ELSE 0 END)::BIGINT)) AS copy FROM
   (SELECT m.row_id, m.{group} AS g, q.n, q.quota, row_number() OVER (PARTITION BY m.{group} ORDER BY md5('42|base|' || m.row_id), m.row_id) AS rn
    FROM mi m JOIN q ON q.g = m.{group} WHERE q.n >= 2))"""
    else:
        pick = _U52.format("md5('42|basedraw|' || g || '|' || draw)")
        bases = f"""dr AS (SELECT g, n, unnest(range(quota)) AS draw FROM q WHERE n >= 2),
  rk AS (SELECT row_id, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY md5('42|base|' || row_id), row_id) - 1 AS rk FROM mi),
  b AS (SELECT rk.row_id, p.g, draw + 1 AS copy FROM (SELECT *, floor({pick} * n)::BIGINT AS pick FROM dr) p JOIN rk ON rk.g = p.g AND rk.rk = p.pick)"""
    key = "b.g || '|' || b.row_id || '|' || b.copy"
    return f"""mi AS (SELECT * FROM emb {where}), q AS (SELECT {group} AS g, count(*) AS n, {quota} AS quota FROM mi GROUP BY 1),
  {bases}, {_knn_sql(group, k, "WHERE a.row_id IN (SELECT row_id FROM mi) AND b.row_id IN (SELECT row_id FROM mi)")},
  lst AS (SELECT row_id, list(neighbour ORDER BY rank) AS ids FROM nn GROUP BY 1),
  pk AS (SELECT b.row_id AS parent_id, b.g, b.copy, ids[1 + floor({_U52.format(f"md5('42|pick|' || {key})")} * len(ids))::BIGINT] AS neighbour_id,
    {_U32.format(f"md5('42|lambda|' || {key})")} AS lam FROM b JOIN lst USING (row_id)),
  syn AS (SELECT parent_id, neighbour_id, g, copy, lam, x.features AS xs, y.features AS ys FROM pk JOIN emb x ON x.row_id = parent_id JOIN emb y ON y.row_id = neighbour_id)"""


_SYN_DIMS = f"""SELECT parent_id, neighbour_id, copy, {q6('lam')} AS "lambda", dim, {q6('x + lam * (y - x)')} AS value FROM
 (SELECT parent_id, neighbour_id, copy, lam, unnest(range(len(xs)))::INT AS dim, unnest(xs) AS x, unnest(ys) AS y FROM syn)"""


def _syn_dims(made: DataFrame) -> DataFrame:
    return dims(made.select("parent_id", "neighbour_id", "copy", r6("lambda").alias("lambda"), "features"))


def _grow(spark, d, mode):
    v = vectors(spark, d)
    minor = prep.class_filter(v, "label", 1)
    quotas = rank.group_sizes(minor, ["label"]).withColumn("quota", F.lit(v.count() // 2).cast("long") - F.col("n"))
    return _syn_dims(B.smote(minor, ["label"], quotas, 5, mode))


_HALF = "(SELECT count(*) FROM emb) // 2 - count(*)"


@query(f"WITH {_EMB}, {_smote_sql('label', 5, _HALF, 'WHERE label = 1')} {_SYN_DIMS}")
def smote_interpolate(spark, d):
    return _grow(spark, d, "allocated")


@query(f"WITH {_EMB}, {_smote_sql('label', 5, _HALF, 'WHERE label = 1', 'uniform')} {_SYN_DIMS}")
def smote_uniform(spark, d):
    return _grow(spark, d, "uniform")


@query(f"""WITH {_EMB}, {_smote_sql('cluster', 5, "(greatest(round_even((count(*) / (SELECT count(*) FROM emb)::DOUBLE) * (SELECT count(*) * 3 FROM emb)::DOUBLE / 2, 0) - count(*), 0))::BIGINT", '')} {_SYN_DIMS}""")
def smote_per_cluster(spark, d):
    v = vectors(spark, d)
    quotas = B.even_quotas(cluster.cluster_sizes(v), 3 * v.count(), majority=False)
    return _syn_dims(B.smote(v, ["cluster"], quotas, 5))


_TOTAL_ROWS = f"""SELECT label, is_synthetic, parent_id, neighbour_id, copy, row_id, {q6('total')} AS total FROM out"""


def _row_totals(out: DataFrame, *more: str) -> DataFrame:
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return out.select("label", *more, "is_synthetic", "parent_id", "neighbour_id", "copy", "row_id", r6(total).alias("total"))


@query(f"""WITH {_EMB}, {_smote_sql('label', 5, _HALF, 'WHERE label = 1')},
 out AS (SELECT label, false AS is_synthetic, NULL::BIGINT AS parent_id, NULL::BIGINT AS neighbour_id, 0 AS copy, row_id, list_sum(features) AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|under|' || row_id), row_id) AS rn FROM emb)
  WHERE label = 1 OR rn <= (SELECT count(*) FROM emb) // 2
 UNION ALL SELECT 1, true, parent_id, neighbour_id, copy, parent_id, list_sum(xs) + lam * (list_sum(ys) - list_sum(xs)) FROM syn) {_TOTAL_ROWS}""")
def balance_smote(spark, d):
    return _row_totals(B.balance_smote(vectors(spark, d)))


@query(f"""WITH {_EMB}, {_smote_sql('cluster', 48, "CASE WHEN count(*) >= 49 THEN greatest(1, floor((count(*) / (SELECT count(*) FROM emb)::DOUBLE) * (SELECT count(*) * 2 FROM emb)::DOUBLE))::BIGINT - count(*) ELSE 0 END", '')},
 cq AS (SELECT cluster, count(*) AS n, greatest(1, floor((count(*) / (SELECT count(*) FROM emb)::DOUBLE) * (SELECT count(*) * 2 FROM emb)::DOUBLE))::BIGINT - count(*) AS more FROM emb GROUP BY 1 HAVING count(*) < 49),
 cd AS (SELECT cluster, n, unnest(range(more)) AS draw FROM cq),
 cp AS (SELECT cluster, draw, floor({_U52.format("md5('42|dupdraw|' || cluster || '|' || draw)")} * n)::BIGINT AS pick FROM cd),
 ck AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('42|dup|' || row_id), row_id) - 1 AS rk FROM emb),
 out AS (SELECT label, false AS is_synthetic, NULL::BIGINT AS parent_id, NULL::BIGINT AS neighbour_id, 0 AS copy, row_id, list_sum(features) AS total FROM emb
 UNION ALL SELECT label, true, row_id, row_id, draw + 1, row_id, list_sum(features) FROM cp JOIN ck ON ck.cluster = cp.cluster AND ck.rk = cp.pick
 UNION ALL SELECT CAST(g = 0 AS INT), true, parent_id, neighbour_id, copy, parent_id, list_sum(xs) + lam * (list_sum(ys) - list_sum(xs)) FROM syn) {_TOTAL_ROWS}""")
def balance_per_cluster_hybrid(spark, d):
    v = vectors(spark, d)
    return _row_totals(B.balance_per_cluster(v, "cluster", 2 * v.count(), 48))


@query(f"""WITH {_EMB}, cq AS (SELECT cluster, count(*) AS n FROM emb GROUP BY 1), cd AS (SELECT cluster, n, unnest(range(n // 2)) AS draw FROM cq),
 cp AS (SELECT cluster, draw, floor({_U52.format("md5('42|dupdraw|' || cluster || '|' || draw)")} * n)::BIGINT AS pick FROM cd),
 ck AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('42|dup|' || row_id), row_id) - 1 AS rk FROM emb)
 SELECT ck.cluster, row_id AS parent_id, draw + 1 AS copy FROM cp JOIN ck ON ck.cluster = cp.cluster AND ck.rk = cp.pick""")
def random_duplicate(spark, d):
    v = vectors(spark, d).select("row_id", "cluster")
    quotas = rank.group_sizes(v, ["cluster"]).withColumn("quota", F.floor(F.col("n") / 2))
    return B.duplicate(v, ["cluster"], quotas).select("cluster", "parent_id", "copy")


@query(f"""WITH {_DIMS}, rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('42|pivot|' || row_id), row_id) AS rn, count(*) OVER (PARTITION BY cluster) AS n FROM emb),
 pv AS (SELECT * FROM rk WHERE rn <= n // 2), nr AS (SELECT r.row_id, arg_min(p.row_id, (list_distance(r.features, p.features), p.row_id)) AS pv_id
  FROM rk r JOIN pv p USING (cluster) WHERE r.rn > r.n // 2 GROUP BY 1), mem AS (SELECT row_id, pv_id FROM nr UNION ALL SELECT row_id, row_id FROM pv)
 SELECT d.cluster, pv_id AS parent_id, dim, {q6('avg(x)')} AS value FROM mem JOIN dims d USING (row_id) GROUP BY ALL""")
def centroid_undersample(spark, d):
    v = vectors(spark, d)
    quotas = rank.group_sizes(v, ["cluster"]).withColumn("quota", F.floor(F.col("n") / 2))
    return dims(B.centroid_undersample(v, ["cluster"], quotas).select("cluster", "parent_id", "features"))


def _three_classes(spark, d):
    """Three classes of about 60, 30 and 10 percent, and clusters inside them."""
    v = vectors(spark, d)
    return v.withColumn("label", F.when(F.col("cluster") < 6, 0).when(F.col("cluster") < 9, 1).otherwise(2))


@query(f"""WITH {_EMB}, v AS (SELECT *, CASE WHEN cluster < 6 THEN 0 WHEN cluster < 9 THEN 1 ELSE 2 END AS class FROM emb),
 c AS (SELECT class, count(*) AS size, count(*) OVER () AS classes, sum(count(*)) OVER ()::BIGINT AS total, row_number() OVER (ORDER BY count(*) DESC, class) AS place FROM v GROUP BY class),
 t AS (SELECT class, size, total // classes + (place <= total % classes)::INT AS target FROM c),
 s AS (SELECT v.class, cluster, count(*) AS n, target, (target * count(*))::DOUBLE / size AS exact FROM v JOIN t ON v.class = t.class GROUP BY v.class, cluster, target, size),
 f AS (SELECT *, floor(exact)::BIGINT AS base FROM s),
 q AS (SELECT *, base + (row_number() OVER (PARTITION BY class ORDER BY exact - base DESC, cluster) <= target - sum(base) OVER (PARTITION BY class))::INT AS quota FROM f),
 b AS (SELECT *, CASE WHEN quota < n THEN 'shrink' WHEN quota = n THEN 'keep' WHEN n < 4 THEN 'copy' ELSE 'grow' END AS branch FROM q)
 SELECT class AS label, cluster, n, quota::BIGINT AS quota, branch FROM b""")
def class_cluster_quotas(spark, d):
    return B.class_cluster_quotas(_three_classes(spark, d))


@query(f"""WITH {_EMB}, v AS (SELECT *, CASE WHEN cluster < 6 THEN 0 WHEN cluster < 9 THEN 1 ELSE 2 END AS class FROM emb),
 c AS (SELECT class, count(*) AS size, count(*) OVER () AS classes, sum(count(*)) OVER ()::BIGINT AS total, row_number() OVER (ORDER BY count(*) DESC, class) AS place FROM v GROUP BY class),
 t AS (SELECT class, size, total // classes + (place <= total % classes)::INT AS target FROM c),
 s AS (SELECT v.class, cluster, count(*) AS n, target, (target * count(*))::DOUBLE / size AS exact FROM v JOIN t ON v.class = t.class GROUP BY v.class, cluster, target, size),
 f AS (SELECT *, floor(exact)::BIGINT AS base FROM s),
 q AS (SELECT *, base + (row_number() OVER (PARTITION BY class ORDER BY exact - base DESC, cluster) <= target - sum(base) OVER (PARTITION BY class))::INT AS quota FROM f),
 p AS (SELECT v.*, q.n, q.quota, row_number() OVER (PARTITION BY v.class, v.cluster ORDER BY md5('42|pivot|' || row_id), row_id) AS rn
  FROM v JOIN q ON v.class = q.class AND v.cluster = q.cluster),
 o AS (SELECT class, cluster, row_id AS origin, 0 AS copy, quota < n AS made, 1 AS rows FROM p WHERE quota >= n OR rn <= quota),
 g AS (SELECT class, cluster, sum(greatest(quota - n, 0))::BIGINT AS rows FROM q GROUP BY ALL)
 SELECT class AS label, cluster, count(*) AS originals, sum(made::INT)::BIGINT AS centroids, sum(origin)::BIGINT AS origin_sum, any_value(g.rows) AS new_rows
 FROM o JOIN g USING (class, cluster) GROUP BY class, cluster""")
def balance_classes(spark, d):
    out = B.balance_classes(_three_classes(spark, d))
    first, centroid = F.col("copy") == 0, F.col("is_synthetic") & F.col("neighbour_id").isNull()
    return out.groupBy("label", "cluster").agg(
        F.count_if(first).alias("originals"), F.count_if(first & centroid).alias("centroids"),
        F.sum(F.when(first, F.col("row_id"))).alias("origin_sum"), F.count_if(~first).alias("new_rows"))


# ---- scaling -----------------------------------------------------------------------------------------

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", *LI)


@query("WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in LI) + " FROM lineitem) SELECT l_orderkey, "
       + ", ".join(f"{q6(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in LI) + " FROM lineitem, s")
def standard_scale(spark, d):
    li = _li(spark, d)
    out = scale.fit_standard(li, LI).apply_columns(li, LI)
    return out.select("l_orderkey", *[r6(c).alias(c) for c in LI])


_ROBUST = "s AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}, coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1) AS s_{c}" for c in LI) + " FROM lineitem)"


@query(f"WITH {_ROBUST} SELECT l_orderkey, " + ", ".join(f"{q6(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in LI) + " FROM lineitem, s")
def robust_scale(spark, d):
    li = _li(spark, d)
    out = scale.fit_robust(li, LI).apply_columns(li, LI)
    return out.select("l_orderkey", *[r6(c).alias(c) for c in LI])


@query(f"WITH {_ROBUST} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {q6(f'm_{c}')} AS center, {q6(f's_{c}')} AS scale FROM s" for c in LI))
def robust_statistics(spark, d):
    fitted = scale.fit_robust(_li(spark, d), LI, task_rows=1000)
    return fitted.to_frame(spark, LI).select("feature", r6("center").alias("center"), r6("scale").alias("scale"))


@query(f"WITH {_DIMS}, " + _split_sql("emb", "label", "row_id", "sp") + f""", t AS (SELECT d.*, s.split FROM dims d JOIN sp s USING (row_id)),
 st AS (SELECT dim, avg(x) AS m, coalesce(nullif(stddev_pop(x), 0), 1) AS s FROM t WHERE split = 'train' GROUP BY dim)
 SELECT row_id, dim, {q6('(x - m) / s')} AS value FROM t JOIN st USING (dim) WHERE split = 'test'""")
def scale_apply_test(spark, d):
    sp = rank.stratified_split(vectors(spark, d), "label", "row_id")
    fitted = scale.fit_standard_vector(sp.where("split = 'train'"))
    return dims(fitted.apply_vector(sp.where("split = 'test'")).select("row_id", "features"))


# ---- naive Bayes ----------------------------------------------------------------------------------------

_GNB = """mom AS (SELECT label, dim, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM dims GROUP BY ALL),
 eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT var_pop(x) AS v FROM dims GROUP BY dim)),
 nb AS (SELECT label, dim, m, v + e AS v, n / (SELECT count(*) FROM emb)::DOUBLE AS prior FROM mom, eps)"""


@query(f"WITH {_DIMS}, {_GNB} SELECT label, {q6('prior')} AS prior, dim, {q6('m')} AS mean, {q6('v')} AS var FROM nb")
def gnb_fit(spark, d):
    fitted = bayes.fit(vectors(spark, d)).to_frame(spark)
    return fitted.select("label", r6("prior").alias("prior"),
                         F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "z")).select(
        "label", "prior", "dim", r6("z.mean").alias("mean"), r6("z.var").alias("var"))


@query(f"""WITH {_DIMS}, {_GNB}, ll AS (SELECT row_id, nb.label, ln(any_value(prior)) - 0.5 * sum(ln(2 * pi() * nb.v) + (x - m) ** 2 / nb.v) AS l
  FROM dims JOIN nb USING (dim) GROUP BY ALL),
 pr AS (SELECT row_id, max(l) FILTER (label = 1) AS l1, max(l) FILTER (label = 0) AS l0 FROM ll GROUP BY row_id)
 SELECT row_id, CAST(l1 > l0 AS INT) AS y_pred, {q6('1 / (1 + exp(l0 - l1))')} AS score FROM pr""")
def gnb_predict(spark, d):
    v = vectors(spark, d)
    return bayes.predict(v, bayes.fit(v)).select("row_id", "y_pred", r6("score").alias("score"))


SMOOTHINGS = [1e-9, 1e-8, 1e-7, 1e-6, 1e-5, 1e-4]
_GNB_CV = """fd AS (SELECT row_id, label, (ntile(3) OVER (PARTITION BY label ORDER BY md5('42|fold|' || row_id), row_id) - 1)::INT AS fold FROM emb),
 gr AS (SELECT * FROM (VALUES (0, 1e-9), (1, 1e-8), (2, 1e-7), (3, 1e-6), (4, 1e-5), (5, 1e-4)) AS g(grid_index, s)),
 fx AS (SELECT d.row_id, d.label, dim, x, fold FROM dims d JOIN fd USING (row_id)), fs AS (SELECT unnest(range(3))::INT AS fold),
 mom AS (SELECT fs.fold, label, dim, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM fs JOIN fx ON fx.fold <> fs.fold GROUP BY ALL),
 mv AS (SELECT fold, max(v) AS mv FROM (SELECT fs.fold, dim, var_pop(x) AS v FROM fs JOIN fx ON fx.fold <> fs.fold GROUP BY ALL) GROUP BY fold),
 ll AS (SELECT fx.row_id, fx.label AS truth, fx.fold, grid_index, mom.label, ln(any_value(mom.n)) - 0.5 * sum(ln(mom.v + s * mv) + (x - m) ** 2 / (mom.v + s * mv)) AS l
  FROM fx JOIN mom ON mom.fold = fx.fold AND mom.dim = fx.dim JOIN mv ON mv.fold = fx.fold, gr GROUP BY ALL),
 pr AS (SELECT row_id, truth, fold, grid_index, arg_max(label, l) AS p FROM ll GROUP BY ALL),
 cv AS (SELECT grid_index, fold, avg(CAST(p = 1 AS INT)) AS cv_score FROM pr WHERE truth = 1 GROUP BY ALL)"""


def _gnb_cv(spark, d):
    return bayes.grid_search(rank.stratified_folds(vectors(spark, d), "label", "row_id", 3), SMOOTHINGS)


@query(f"WITH {_DIMS}, {_GNB_CV} SELECT grid_index::INT AS grid_index, fold, {q6('cv_score')} AS cv_score FROM cv")
def gnb_grid_cv(spark, d):
    return _gnb_cv(spark, d).select("grid_index", "fold", r6("cv_score").alias("cv_score"))


@query(f"""WITH {_DIMS}, {_GNB_CV}, mean AS (SELECT grid_index, avg(cv_score) AS sc FROM cv GROUP BY 1)
 SELECT grid_index::INT AS grid_index, {q6('sc')} AS best_cv_score FROM mean ORDER BY sc DESC, grid_index LIMIT 1""")
def best_params(spark, d):
    return report.best_params(_gnb_cv(spark, d), []).select("grid_index", r6("best_cv_score").alias("best_cv_score"))


@query(f"""WITH {_EMB} SELECT model, n_combinations, 3 AS cv_folds, n_combinations * 3 AS total_fits, (SELECT count(*) FROM emb) AS n_samples,
 (SELECT max(len(features)) FROM emb)::INT AS n_features FROM (VALUES ('svm', 72::BIGINT), ('naive_bayes_gaussian', 6::BIGINT), ('decision_tree', 160::BIGINT)) AS g(model, n_combinations)""")
def search_accounting(spark, d):
    from evenkeel.operators import tuning

    sizes = {m: tuning.nominal_size(m) for m in tuning.GRIDS}
    return report.search_accounting(vectors(spark, d), sizes, 3)


# ---- metrics ------------------------------------------------------------------------------------------------

@query(f"WITH {_CONF} SELECT * FROM conf")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(scored(spark, d), KEYS)


_RATE_COLS = ["error", "accuracy", "fpr", "precision", "recall", "specificity", "f1"]


@query(f"WITH {_RATES} SELECT {_K}, p, n, total, " + ", ".join(f"{q6(c)} AS {c}" for c in _RATE_COLS)
       + f", {q6('recall')} AS tpr, {q6('recall')} AS sensitivity FROM rates")
def derived_rates(spark, d):
    out = metrics.derived_rates(metrics.confusion_matrix(scored(spark, d), KEYS))
    return out.select(*KEYS, "p", "n", "total", *[r6(c).alias(c) for c in [*_RATE_COLS, "tpr", "sensitivity"]])


@query(f"WITH {_RATES} SELECT {_K}, " + ", ".join(f"{q6(c)} AS {c}" for c in ("accuracy", "precision", "recall", "f1")) + " FROM rates")
def basic_metrics(spark, d):
    out = metrics.basic_metrics(scored(spark, d), KEYS)
    return out.select(*KEYS, *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"""WITH {_RATES} SELECT count(*) AS violations FROM rates WHERE abs(accuracy - (1 - error)) >= 1e-10
 OR abs(specificity - CASE WHEN n = 0 THEN 0 ELSE 1 - fpr END) >= 1e-10 OR abs(accuracy - (p - fn + n - fp) / total::DOUBLE) >= 1e-10""")
def metric_identities(spark, d):
    rates = metrics.derived_rates(metrics.confusion_matrix(scored(spark, d), KEYS))
    return metrics.identity_violations(rates).agg(F.count(F.lit(1)).alias("violations"))


@query(f"WITH {_POINTS} SELECT {_K}, score AS threshold, {q6('fp / nn')} AS fpr, {q6('tp / np')} AS tpr FROM cum UNION ALL SELECT DISTINCT {_K}, NULL, 0.0, 0.0 FROM cum")
def roc_curve(spark, d):
    out = metrics.roc_curve(scored(spark, d), KEYS)
    return out.select(*KEYS, "threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query(f"""WITH {_POINTS}, seq AS (SELECT *, lag(score) OVER s AS up, lead(pos) OVER s AS pos2, lead(neg) OVER s AS neg2 FROM cum
  WINDOW s AS (PARTITION BY {_K} ORDER BY score DESC))
 SELECT {_K}, score AS threshold, {q6('fp / nn')} AS fpr, {q6('tp / np')} AS tpr FROM seq
 WHERE up IS NULL OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg UNION ALL SELECT DISTINCT {_K}, NULL, 0.0, 0.0 FROM cum""")
def roc_curve_thin(spark, d):
    out = metrics.roc_curve(scored(spark, d), KEYS, ranges=4, thin=True)
    return out.select(*KEYS, "threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query(f"WITH {_POINTS} SELECT {_K}, score AS threshold, {q6('tp / (tp + fp)')} AS precision, {q6('tp / np')} AS recall FROM cum UNION ALL SELECT DISTINCT {_K}, NULL, 1.0, 0.0 FROM cum")
def pr_curve(spark, d):
    out = metrics.pr_curve(scored(spark, d), KEYS)
    return out.select(*KEYS, "threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(f"WITH {_AUC} SELECT {_K}, {q6('roc_auc')} AS roc_auc FROM areas")
def roc_auc(spark, d):
    return metrics.area_under_curves(scored(spark, d), KEYS).select(*KEYS, r6("roc_auc").alias("roc_auc"))


_EVENT_AUC = _AUC.replace(_SCORED, """scored AS (SELECT 'all' AS dataset, '' AS balancing_method, '' AS scaler_type, '' AS model,
  CAST(event_type = 'error' AS INT) AS y_true, value AS score FROM events)""")


@query(f"WITH {_EVENT_AUC} SELECT {q6('roc_auc')} AS roc_auc, {q6('pr_auc')} AS pr_auc FROM areas")
def pr_auc(spark, d):
    ev = table(spark, d, "events").select((F.col("event_type") == "error").cast("int").alias("y_true"), F.col("value").alias("score"))
    return metrics.area_under_curves(ev, []).select(r6("roc_auc").alias("roc_auc"), r6("pr_auc").alias("pr_auc"))


_REPORT = _SCORED + f""", cc AS (SELECT {_K}, y_true AS c, count(*) AS s FROM scored GROUP BY ALL), pc AS (SELECT {_K}, y_pred AS c, count(*) AS s FROM scored GROUP BY ALL),
 hc AS (SELECT {_K}, y_true AS c, count(*) AS s FROM scored WHERE y_true = y_pred GROUP BY ALL),
 per AS (SELECT {_K}, c, coalesce(cc.s, 0) AS support, coalesce(pc.s, 0) AS predicted, coalesce(hc.s, 0) AS hits
  FROM cc FULL JOIN pc USING ({_K}, c) FULL JOIN hc USING ({_K}, c)),
 pm AS (SELECT *, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall,
  coalesce(2 * hits / nullif(predicted + support, 0)::DOUBLE, 0) AS f1 FROM per)"""


@query(f"""WITH {_REPORT}, al AS (
 SELECT {_K}, CASE c WHEN 0 THEN 'No-Buggy' ELSE 'Buggy' END AS entry, precision, recall, f1, support FROM pm
 UNION ALL SELECT {_K}, 'accuracy', NULL, NULL, sum(hits) / sum(support)::DOUBLE, sum(support) FROM pm GROUP BY ALL
 UNION ALL SELECT {_K}, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pm GROUP BY ALL
 UNION ALL SELECT {_K}, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM pm GROUP BY ALL)
 SELECT {_K}, entry, {q6('precision')} AS precision, {q6('recall')} AS recall, {q6('f1')} AS f1, support::BIGINT AS support FROM al""")
def classification_report(spark, d):
    out = metrics.classification_report(scored(spark, d), KEYS, names={0: "No-Buggy", 1: "Buggy"})
    return out.select(*KEYS, "entry", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


_OVR = f"""{_DIMS}, {_CENTERS}, pr AS (SELECT e.row_id, e.cluster AS y, n.cluster AS p FROM emb e JOIN near n USING (row_id)),
 cl AS (SELECT DISTINCT y AS cls FROM pr), au AS (SELECT cls, coalesce((count(*) FILTER (y = cls AND p = cls) / count(*) FILTER (y = cls)::DOUBLE
  + count(*) FILTER (y <> cls AND p <> cls) / nullif(count(*) FILTER (y <> cls), 0)::DOUBLE) / 2, 0.5) AS auc FROM pr, cl GROUP BY cls)"""


def _multi(spark, d):
    v = vectors(spark, d)
    return cluster.assign_nearest(v, _centers(v), name="y_pred").select(F.col("cluster").alias("y_true"), "y_pred")


@query(f"WITH {_OVR} SELECT cls, {q6('auc')} AS auc FROM au")
def ovr_auc_by_class(spark, d):
    return metrics.ovr_auc_by_class(_multi(spark, d), []).select("cls", r6("auc").alias("auc"))


@query(f"WITH {_OVR} SELECT {q6('avg(auc)')} AS ovr_auc FROM au")
def ovr_auc(spark, d):
    return metrics.ovr_auc(_multi(spark, d), []).select(r6("ovr_auc").alias("ovr_auc"))


# ---- results ----------------------------------------------------------------------------------------------------

def evaluated(spark, d):
    """Stored-style records of every configuration, evaluated in one job."""
    return report.stored_names(metrics.evaluate(scored(spark, d), KEYS))


_EVAL = _RATES + "," + _AUC[len(_SCORED) + 1:] + f", ev AS (SELECT {_K}, tp AS TP, fp AS FP, fn AS FN, tn AS TN, f1 AS F1_Score, precision AS \"Precision\", recall AS Recall, specificity AS Especificidad, error AS Error, roc_auc AS ROC_AUC, pr_auc AS PR_AUC FROM rates JOIN areas USING ({_K}))"
_RND = ["F1_Score", "Precision", "Recall", "Especificidad", "Error", "ROC_AUC", "PR_AUC"]
_RND_SQL = ", ".join(f'{q6(chr(34) + c + chr(34))} AS "{c}"' for c in _RND)


def _rounded(df):
    return df.select(*[r6(c).alias(c) if c in (*_RND, "score") else F.col(c) for c in df.columns])


@query(f"WITH {_EVAL} SELECT {_K}, TP, FP, FN, TN, {_RND_SQL} FROM ev")
def config_metrics(spark, d):
    return _rounded(evaluated(spark, d).select(*KEYS, "TP", "FP", "FN", "TN", *_RND))


_LABEL_SQL = "CASE model WHEN 'svm' THEN 'SVM' WHEN 'naive_bayes_gaussian' THEN 'Naive Bayes Gaussiano' WHEN 'decision_tree' THEN 'Árbol de Decisión' ELSE model END"


@query(f"WITH {_EVAL} SELECT {_K}, {_LABEL_SQL} AS model_label, TP::DOUBLE AS TP, FP::DOUBLE AS FP, FN::DOUBLE AS FN, TN::DOUBLE AS TN, {_RND_SQL} FROM ev")
def core_table(spark, d):
    return _rounded(report.core_table(evaluated(spark, d)))


_GAPS_SQL = "CASE WHEN dataset IN ('1', '2') THEN NULL ELSE Especificidad END"


@query(f"WITH {_EVAL} SELECT {_K}, {q6('Especificidad')} AS Especificidad, {q6('Error')} AS Error FROM (SELECT * REPLACE ({_GAPS_SQL} AS Especificidad) FROM ev) WHERE Especificidad >= 0.2 AND Error <= 0.6")
def pathology_filter(spark, d):
    gap = F.when(F.col("dataset") == "1", F.lit(None).cast("double")).when(F.col("dataset") == "2", F.lit(float("nan")))
    rows = evaluated(spark, d).withColumn("Especificidad", gap.otherwise(F.col("Especificidad")))
    return _rounded(report.pathology_filter(rows).select(*KEYS, "Especificidad", "Error"))


_SCORE = "0.4 * Recall + 0.4 * F1_Score + 0.2 * coalesce(PR_AUC, 0)"


@query(f"WITH {_EVAL} SELECT {_K}, {q6(_SCORE)} AS score FROM ev")
def composite_score(spark, d):
    return _rounded(report.composite_score(evaluated(spark, d)).select(*KEYS, "score"))


_TOPN = f""", tn AS (SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY dataset ORDER BY {_SCORE} DESC NULLS LAST,
  list_position(['unbalanced', 'csbboost', 'hcbou', 'smote'], balancing_method), list_position(['standard', 'robust'], scaler_type),
  list_position(['svm', 'naive_bayes_gaussian', 'decision_tree'], model))::INT AS rank FROM ev WHERE Especificidad >= 0.2 AND Error <= 0.6)"""


@query(f"WITH {_EVAL} {_TOPN} SELECT dataset, balancing_method, scaler_type, {_LABEL_SQL} AS model_label, {q6('score')} AS score, rank FROM tn WHERE rank <= 3")
def topn_per_group(spark, d):
    top = report.top_table(report.core_table(evaluated(spark, d)))
    return _rounded(top.select("dataset", "balancing_method", "scaler_type", "model_label", "score", "rank"))


@query(f"""WITH {_EVAL} SELECT {_K}, {q6(_SCORE)} AS score FROM ev ORDER BY dataset, {_SCORE} DESC NULLS LAST,
  list_position(['unbalanced', 'csbboost', 'hcbou', 'smote'], balancing_method), list_position(['standard', 'robust'], scaler_type),
  list_position(['svm', 'naive_bayes_gaussian', 'decision_tree'], model) LIMIT 5""")
def ranked_head(spark, d):
    out = report.head(report.ranked(report.composite_score(evaluated(spark, d))), 5)
    return _rounded(out.select(*KEYS, "score"))


@query(f"""WITH {_EVAL} SELECT dataset, balancing_method, scaler_type, model, {q6('F1_Score')} AS f1, {q6('ROC_AUC')} AS auc, TN AS tn00, TP AS tp11 FROM ev""")
def config_summary(spark, d):
    nested = report.config_summary(evaluated(spark, d))
    return nested.select("dataset", "balancing_method", "scaler_type", F.explode("models").alias("model", "m")).select(
        "dataset", "balancing_method", "scaler_type", "model", r6("m.F1_Score").alias("f1"), r6("m.ROC_AUC").alias("auc"),
        F.get(F.get("m.confusion_matrix", F.lit(0)), F.lit(0)).alias("tn00"), F.get(F.get("m.confusion_matrix", F.lit(1)), F.lit(1)).alias("tp11"))


_GRID_SQL = """cfg AS (SELECT dataset, balancing_method, scaler_type, model FROM (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS dataset FROM lineitem),
 (SELECT unnest(['unbalanced', 'csbboost', 'hcbou', 'smote']) AS balancing_method), (SELECT unnest(['standard', 'robust']) AS scaler_type),
 (SELECT unnest(['svm', 'naive_bayes_gaussian', 'decision_tree']) AS model))"""


def _configs(spark, d):
    return report.configurations(table(spark, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("dataset")))


@query(f"WITH {_GRID_SQL} SELECT *, balancing_method || '_' || scaler_type AS config_key FROM cfg")
def config_grid(spark, d):
    return _configs(spark, d).withColumn("config_key", report.config_key())


@query("""SELECT dataset, (c * 80 + d * 16 + l * 4 + s)::INT AS grid_index, ['gini', 'entropy'][c + 1] AS criterion,
  ['3', '5', '10', '20', NULL][d + 1] AS max_depth, ['1', '2', '4', '8'][l + 1] AS min_samples_leaf, ['2', '5', '10', '20'][s + 1] AS min_samples_split
  FROM (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS dataset FROM lineitem), range(2) a(c), range(5) b(d), range(4) e(l), range(4) f(s)""")
def param_grid(spark, d):
    grid = [F.struct(F.lit(i).alias("grid_index"), *[F.lit(None if v is None else str(v)).cast("string").alias(k) for k, v in p.items()])
            for i, p in enumerate(tuning.combinations("decision_tree"))]
    datasets = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("dataset")).distinct()
    return datasets.select("dataset", F.inline(F.array(*grid)))


@query(f"""WITH {_EVAL} SELECT {_K}, {_LABEL_SQL} AS model_label, {q6('F1_Score')} AS F1_Score,
  '[[' || TN || ',' || FP || '],[' || FN || ',' || TP || ']]' AS confusion_matrix FROM ev""")
def wide_table(spark, d):
    return _rounded(report.wide_table(evaluated(spark, d)).select(*KEYS, "model_label", "F1_Score", "confusion_matrix"))


@query(f"WITH {_GRID_SQL}, {_SCORED} SELECT * FROM cfg ANTI JOIN scored USING ({_K})")
def missing_configs(spark, d):
    return report.missing(_configs(spark, d), scored(spark, d))


_DONE = f""", done AS (SELECT {_K}, CASE WHEN f1 >= 0.4 THEN {q6('f1')} END AS best_params FROM rates)"""


def _done(spark, d):
    rates = metrics.derived_rates(metrics.confusion_matrix(scored(spark, d), KEYS))
    return rates.select(*KEYS, F.when(F.col("f1") >= 0.4, r6("f1")).alias("best_params"))


@query(f"WITH {_GRID_SQL}, {_RATES} {_DONE} SELECT cfg.* FROM cfg ANTI JOIN (SELECT * FROM done WHERE best_params IS NOT NULL) USING ({_K})")
def todo_configs(spark, d):
    return report.todo(_configs(spark, d), _done(spark, d))


@query(f"WITH {_GRID_SQL}, {_RATES} {_DONE} SELECT {_K}, best_params FROM cfg JOIN done USING ({_K})")
def configs_with_params(spark, d):
    return report.with_best_params(_configs(spark, d), _done(spark, d))


# ---- trees and kernels --------------------------------------------------------------------------------------------

def _gini(p: str, n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE 1 - ({p} / ({n})::DOUBLE) ** 2 - (({n} - {p}) / ({n})::DOUBLE) ** 2 END)"


_CUTS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, unnest([quantile_cont({c}, 0.25), quantile_cont({c}, 0.5), quantile_cont({c}, 0.75)]) AS threshold FROM lineitem"
    for c in LI[:3])
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS x, CAST(l_tax >= 0.06 AS INT) AS y FROM lineitem" for c in LI[:3])
_GAIN = f"{_gini('p', 'n')} - nl / n::DOUBLE * {_gini('pl', 'nl')} - (n - nl) / n::DOUBLE * {_gini('(p - pl)', '(n - nl)')}"


@query(f"""WITH cut AS ({_CUTS}), lg AS ({_LONG}),
 agg AS (SELECT feature, threshold, count(*) AS n, sum(y) AS p, count(*) FILTER (x <= threshold) AS nl, coalesce(sum(y) FILTER (x <= threshold), 0) AS pl
  FROM lg JOIN (SELECT DISTINCT * FROM cut) c USING (feature) GROUP BY ALL)
 SELECT feature, threshold, {q6(_GAIN)} AS gini_gain FROM agg""")
def split_impurity(spark, d):
    from evenkeel.operators import trees

    li = table(spark, d, "lineitem").select(*LI[:3], (F.col("l_tax") >= 0.06).cast("int").alias("label"))
    cuts = quantiles.exact_quantiles(li, LI[:3], [0.25, 0.5, 0.75])
    out = trees.split_gains(li, {c: sorted(set(v)) for c, v in zip(LI[:3], cuts)})
    return out.select("feature", "threshold", r6("gini_gain").alias("gini_gain"))


_SPLIT = f"round_even((nl * {_gini('pl', 'nl')} + (n - nl) * {_gini('(p - pl)', '(n - nl)')}) / n::DOUBLE * 1e12, 0)"


def _level_sql(name: str, rows: str, by: str) -> str:
    """CTEs: candidate sums of the nodes ``by`` in ``rows`` (row_id, path) and their best split, lowest feature and cut on ties."""
    return f"""s{name} AS (SELECT path, c.dim, c.t, count(*) AS n, sum(label) AS p, count(*) FILTER (x <= t) AS nl,
  coalesce(sum(label) FILTER (x <= t), 0) AS pl FROM {rows} JOIN dims USING (row_id) JOIN c USING (dim) GROUP BY ALL),
 b{name} AS (SELECT path, dim, t FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {_SPLIT}, dim, t) AS place
  FROM s{name} WHERE nl > 0 AND nl < n AND p > 0 AND p < n AND length(path) = {by}) WHERE place = 1),
 a{name} AS (SELECT row_id, path || CASE WHEN x <= t THEN 'L' ELSE 'R' END AS path
  FROM {rows} JOIN b{name} USING (path) JOIN dims USING (row_id, dim))"""


_EIGHTHS = ", ".join(str(i / 8) for i in range(1, 8))


@query(f"""WITH {_DIMS}, c AS (SELECT DISTINCT dim, unnest(q) AS t FROM (SELECT dim, quantile_disc(x, [{_EIGHTHS}]) AS q FROM dims GROUP BY dim)),
 a AS (SELECT row_id, '' AS path FROM emb), {_level_sql('1', 'a', '0')}, {_level_sql('2', 'a1', '1')},
 every AS (SELECT * FROM a UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2), cut AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2)
 SELECT path, any_value(cut.dim)::INT AS feature, any_value(cut.t) AS threshold, count(*) FILTER (label = 0) AS n0,
  count(*) FILTER (label = 1) AS n1 FROM every JOIN emb USING (row_id) LEFT JOIN cut USING (path) GROUP BY path""")
def tree_two_levels(spark, d):
    """Root, its children and theirs, of a tree over eighths of each feature."""
    from evenkeel.operators import trees

    return trees.paths(spark, trees.fit_trees(vectors(spark, d), [trees.TreeSpec(max_depth=2)], max_bins=8)[0])


_W = "sqrt(-2 * ln(greatest({u1}, 1 / 8589934592.0::DOUBLE))) * cos(2 * pi() * greatest({u2}, 1 / 8589934592.0::DOUBLE))".format(
    u1=_U32.format("md5('42|rff|' || j || '|' || i || '|1')"), u2=_U32.format("md5('42|rff|' || j || '|' || i || '|2')"))


@query(f"""WITH {_DIMS}, gm AS (SELECT 1 / (64 * var_pop(x)) AS g FROM dims), w AS (SELECT j::INT AS j, i::INT AS i, {_W} AS w
  FROM (SELECT unnest(range(16)) AS j), (SELECT unnest(range(64)) AS i)),
 b AS (SELECT j::INT AS j, 2 * pi() * {_U32.format("md5('42|rff|' || j || '|b')")} AS b FROM (SELECT unnest(range(16)) AS j)),
 dot AS (SELECT row_id, j, sum(x * w) AS s FROM dims JOIN w ON w.i = dims.dim GROUP BY ALL)
 SELECT row_id, j AS dim, {q6('sqrt(2 / 16.0::DOUBLE) * cos(sqrt(2 * g) * s + b)')} AS value FROM dot JOIN b USING (j), gm""")
def rff_map(spark, d):
    from evenkeel.operators import svm

    v = vectors(spark, d)
    width, variance = svm.entry_variance(v)
    mapped = svm.rff_map(v.select("row_id", "features"), svm.gamma_value("scale", width, variance), 16, width=width)
    return dims(mapped.select("row_id", F.col("mapped").alias("features")))


# ---- fitted models and whole runs: no SQL counterpart ----------------------------------------------------------------

def _scaled(spark, d):
    sp = rank.stratified_split(vectors(spark, d), "label", "row_id")
    fitted = scale.fit_standard_vector(sp.where("split = 'train'"))
    return fitted.apply_vector(sp.where("split = 'train'")), fitted.apply_vector(sp.where("split = 'test'"))


def _model_metrics(spark, d, name, params):
    from evenkeel.operators import models

    train, test = _scaled(spark, d)
    pred = models.predict(test, models.fit(train, name, params)).withColumnRenamed("label", "y_true")
    return metrics.evaluate(pred, []).drop("confusion_matrix")


@query()
def linear_svc(spark, d):
    return _model_metrics(spark, d, "svm", {"C": 1.0, "kernel": "linear"})


@query()
def rff_svc(spark, d):
    return _model_metrics(spark, d, "svm", {"C": 10.0, "kernel": "rbf", "gamma": "scale"})


@query()
def decision_tree(spark, d):
    return _model_metrics(spark, d, "decision_tree", {"max_depth": 5, "min_samples_split": 5, "criterion": "entropy"})


@query()
def kmeans_choose_k(spark, d):
    _, scores = cluster.choose_k(prep.class_filter(vectors(spark, d), "label", 0), 2, 10)
    return local_frame(spark, [(s["k"], s["silhouette"], s["cost"], s["smallest"]) for s in scores],
                       "k int, silhouette double, cost double, smallest long")


def _balance_counts(spark, d, method):
    return B.balance(vectors(spark, d).drop("cluster"), method).groupBy("label", "is_synthetic").agg(
        F.count(F.lit(1)).alias("n"))


@query()
def csbboost(spark, d):
    return _balance_counts(spark, d, "csbboost")


@query()
def hcbou(spark, d):
    return _balance_counts(spark, d, "hcbou")


def _search(spark, d, name):
    from evenkeel.operators import tuning

    folded = rank.stratified_folds(_scaled(spark, d)[0], "label", "row_id", 3)
    return tuning.scores_frame(spark, tuning.fold_scores(folded, name))


@query()
def svm_grid_cv(spark, d):
    return _search(spark, d, "svm")


@query()
def tree_grid_cv(spark, d):
    return _search(spark, d, "decision_tree")


@query()
def leak_free_run(spark, d):
    from evenkeel.plans import flow

    rows = rank.stratified_split(vectors(spark, d).drop("cluster"), "label", "row_id").withColumn(
        "dataset", F.lit("embeddings"))
    small = {"svm": {"C": [1.0, 10.0], "kernel": ["linear"], "gamma": ["scale"]},
             "decision_tree": {"max_depth": [5], "min_samples_split": [2], "min_samples_leaf": [1, 4], "criterion": ["gini"]}}
    table_, _, _ = flow.run(rows, ["unbalanced", "smote"], ["standard"], grids=small)
    return table_.drop("confusion_matrix", "training_time_seconds")
