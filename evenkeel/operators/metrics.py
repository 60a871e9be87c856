"""Exact classification metrics for any number of configurations in one job.

Every function takes ``keys`` (configuration columns, may be empty) and returns one
row, or one curve, per key. Scores are first collapsed to distinct (key, score) rows;
cumulative counts run per key, or per (key, score range) for keys beyond RANGE_ROWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.numeric import nan_to_null, safe_divide
from evenkeel.operators.small import bounded_rows, local_frame, same, small

COUNTS = ["tp", "tn", "fp", "fn"]
#: Most rows of one key that one task accumulates; larger keys are cut into ranges.
RANGE_ROWS = 1_000_000
MAX_RANGES = 1_024
#: Most cut scores of all keys together; they are broadcast.
MAX_CUTS = 1_000_000
#: Cuts are looked up in blocks of this many.
CUT_BLOCK = 32


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def confusion_matrix(
    pred: DataFrame, keys: list[str], label: str = "y_true", predicted: str = "y_pred"
) -> DataFrame:
    """tp, tn, fp, fn of a 0/1 label per key, in one pass with map-side partial sums."""
    y, p = F.col(label), F.col(predicted)
    return pred.groupBy(*keys).agg(
        _count_if((y == 1) & (p == 1)).alias("tp"), _count_if((y == 0) & (p == 0)).alias("tn"),
        _count_if((y == 0) & (p == 1)).alias("fp"), _count_if((y == 1) & (p == 0)).alias("fn"),
    )


def derived_rates(counts: DataFrame) -> DataFrame:
    """Totals and rates from tp, tn, fp, fn; a zero denominator gives 0."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    total = tp + tn + fp + fn
    recall = safe_divide(tp, tp + fn)
    fpr = safe_divide(fp, tn + fp)
    return counts.select(
        "*",
        (tp + fn).alias("p"), (tn + fp).alias("n"), total.alias("total"),
        safe_divide(fp + fn, total).alias("error"),
        safe_divide(tp + tn, total).alias("accuracy"),
        recall.alias("tpr"), fpr.alias("fpr"),
        safe_divide(tp, tp + fp).alias("precision"),
        recall.alias("recall"), recall.alias("sensitivity"),
        safe_divide(tn, tn + fp).alias("specificity"),
        safe_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def basic_metrics(pred: DataFrame, keys: list[str], label="y_true", predicted="y_pred") -> DataFrame:
    """accuracy, precision, recall, f1."""
    rates = derived_rates(confusion_matrix(pred, keys, label, predicted))
    return rates.select(*keys, "accuracy", "precision", "recall", "f1")


def identity_violations(rates: DataFrame, tol: float = 1e-10) -> DataFrame:
    """Rows whose rates contradict each other; empty for correct input."""
    off = lambda a, b: F.abs(a - b) >= tol
    return rates.where(
        off(F.col("accuracy"), 1 - F.col("error")) | off(F.col("tpr"), F.col("recall"))
        | off(F.col("tpr"), F.col("sensitivity")) | off(F.col("specificity"), 1 - F.col("fpr"))
    )


def _key(keys: list[str]) -> Column:
    """Configuration columns as one struct: never NULL itself, so plain equality joins keep a
    partitioning that groupings and windows made, and NULL keys still meet."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def score_counts(pred: DataFrame, keys: list[str], label="y_true", score="score") -> DataFrame:
    """Positives and negatives per distinct (key, score); ties collapse here, map-side first."""
    s = nan_to_null(F.col(score).cast("double"))
    return (
        pred.select(_key(keys).alias("_k"), F.col(label).cast("int").alias("_y"), s.alias("score"))
        .where(F.col("score").isNotNull() & F.col("_y").isNotNull())
        .groupBy("_k", "score")
        .agg(F.sum("_y").cast("long").alias("pos"), F.sum(1 - F.col("_y")).cast("long").alias("neg"))
    )


def _score_cuts(pred: DataFrame, keys: list[str], score: str, ranges: int | None) -> DataFrame | None:
    """Scores that cut keys beyond RANGE_ROWS into ranges of about that size; None if no key is.

    ``ranges``: every key is cut into so many at least.
    """
    s = nan_to_null(F.col(score).cast("double"))
    rows = pred.select(_key(keys).alias("_k"), s.alias("score")).where(F.col("score").isNotNull())
    counted = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    if ranges is not None and ranges > 1:
        most, keys_ = counted.agg(F.max("n"), F.count(F.lit(1))).first()
        by_size = min(MAX_RANGES, MAX_CUTS // max(keys_, 1), -(-(most or 0) // RANGE_ROWS))
        ranges = max(ranges, by_size)
    if ranges is None:
        sizes = counted.where(F.col("n") > RANGE_ROWS)
        large = bounded_rows(sizes, MAX_CUTS)
        if not large:
            return None
        ranges = min(MAX_RANGES, MAX_CUTS // len(large), -(-max(r["n"] for r in large) // RANGE_ROWS))
        hot = local_frame(pred.sparkSession, [(r["_k"],) for r in large], sizes.select("_k").schema)
        rows = rows.join(F.broadcast(hot), "_k", "left_semi")
    if ranges <= 1:
        return None
    cuts = rows.groupBy("_k").agg(F.percentile_approx(
        "score", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)).alias("_cuts"))
    marks = F.filter("_cuts", lambda c, i: i % CUT_BLOCK == CUT_BLOCK - 1)
    return small(cuts.select("_k", F.array_sort(F.array_distinct("_cuts")).alias("_cuts"))
                 .withColumn("_marks", marks))


def _range_of(score: Column) -> Column:
    """How many cuts lie below a score: whole blocks first, then inside one block."""
    blocks = F.size(F.filter("r._marks", lambda c: c < score))
    rest = F.slice("r._cuts", blocks * CUT_BLOCK + 1, F.lit(CUT_BLOCK))
    at = blocks * CUT_BLOCK + F.size(F.filter(rest, lambda c: c < score))
    return F.when(F.col("r._cuts").isNull(), 0).otherwise(at)


def _cumulative(pred: DataFrame, keys: list[str], label: str, score: str, ranges: int | None) -> DataFrame:
    """_k, score, pos, neg and tp, fp: positives and negatives at or above each score; ``next``: pos and neg of the next lower score.

    A key with more rows than one task should sort is cut into score ranges; each range is
    one window partition, and the totals of the ranges above are added to it. The offsets
    join on the window's own partitioning, so the rows are not exchanged again.
    """
    counts = score_counts(pred, keys, label, score)
    cuts = _score_cuts(pred, keys, score, ranges)
    if cuts is None:
        w = Window.partitionBy("_k").orderBy(F.desc("score")).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        after = F.lead(F.struct("pos", "neg")).over(Window.partitionBy("_k").orderBy(F.desc("score")))
        return counts.select("*", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), after.alias("next"))
    parts = counts.alias("l").join(cuts.alias("r"), F.col("l._k") == F.col("r._k"), "left").select(
        F.struct("l._k", _range_of(F.col("l.score")).alias("part")).alias("_p"), "l.score", "l.pos", "l.neg")
    # the first point of a range is carried to the end of the range above
    totals = parts.groupBy("_p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                                     F.max_by(F.struct("pos", "neg"), "score").alias("first"))
    above = Window.partitionBy("_p._k").orderBy(F.desc("_p.part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_p", F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("n0"),
        F.lead("first").over(Window.partitionBy("_p._k").orderBy(F.desc("_p.part"))).alias("carried"))
    w = Window.partitionBy("_p").orderBy(F.desc("score")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    after = F.lead(F.struct("pos", "neg")).over(Window.partitionBy("_p").orderBy(F.desc("score")))
    running = parts.select("*", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), after.alias("next"))
    return running.join(offsets, "_p").select(
        F.col("_p._k").alias("_k"), "score", "pos", "neg",
        (F.col("tp") + F.col("p0")).alias("tp"), (F.col("fp") + F.col("n0")).alias("fp"),
        F.coalesce("next", "carried").alias("next"))


def _with_totals(curve: DataFrame, counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("_k").agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return curve.join(totals, "_k")


def _unkey(keys: list[str]) -> list[Column]:
    return [F.col("_k").getField(c).alias(c) for c in keys]


def _curve(pred, keys, label, score, ranges, x: str, y: str, start: tuple[float, float], thin: bool = False) -> DataFrame:
    counts = score_counts(pred, keys, label, score)
    points = _with_totals(_cumulative(pred, keys, label, score, ranges), counts)
    if thin:  # inner points whose step is that of the next one lie on a line between their neighbours
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bends = (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
        points = points.where(first | F.col("next").isNull() | bends)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    value = {"fpr": F.try_divide(fp, F.col("_N").cast("double")), "tpr": F.try_divide(tp, F.col("_P").cast("double")),
             "recall": F.try_divide(tp, F.col("_P").cast("double")), "precision": safe_divide(tp, tp + fp)}
    out = points.select(*_unkey(keys), F.col("score").alias("threshold"), value[x].alias(x), value[y].alias(y))
    first = counts.groupBy("_k").agg(F.count(F.lit(1)).alias("_c")).select(
        *_unkey(keys), F.lit(None).cast("double").alias("threshold"),
        F.lit(start[0]).alias(x), F.lit(start[1]).alias(y))
    return out.unionByName(first)


def roc_curve(pred: DataFrame, keys: list[str], label="y_true", score="score", ranges=None, thin: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score; the origin has a NULL threshold.

    ``thin`` leaves out inner points that repeat the step before the next one: the area stays the same. The
    first and the last score stay. Exact whether or not a key is cut into score ranges.
    """
    return _curve(pred, keys, label, score, ranges, "fpr", "tpr", (0.0, 0.0), thin)


def pr_curve(pred: DataFrame, keys: list[str], label="y_true", score="score", ranges=None) -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end point (1, 0)."""
    return _curve(pred, keys, label, score, ranges, "precision", "recall", (1.0, 0.0))


def area_under_curves(pred: DataFrame, keys: list[str], label="y_true", score="score", ranges=None) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (trapezoids from (recall 0, precision 1)).

    Each point knows its predecessor: tp - pos, fp - neg. So both areas are one sum over
    the cumulative counts. With one class only, roc_auc is NULL; without positives both.
    """
    curve = _cumulative(pred, keys, label, score, ranges)
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    before = tp - pos
    prec = tp / (tp + fp)
    prev = F.coalesce(F.try_divide(before, before + fp - neg), F.lit(1.0))
    sums = curve.groupBy("_k").agg(
        F.sum(neg * (before + pos / 2)).alias("_roc"), F.sum(pos * (prec + prev) / 2).alias("_pr"),
        F.sum("pos").cast("double").alias("_P"), F.sum("neg").cast("double").alias("_N"),
    )
    return sums.select(
        *_unkey(keys),
        F.try_divide(F.col("_roc"), F.col("_P") * F.col("_N")).alias("roc_auc"),
        F.try_divide(F.col("_pr"), F.col("_P")).alias("pr_auc"),
    )


def evaluate(pred: DataFrame, keys: list[str], label="y_true", predicted="y_pred", score="score") -> DataFrame:
    """Full metric record per key: counts, rates, both areas and the 2x2 matrix."""
    rates = derived_rates(confusion_matrix(pred, keys, label, predicted)).withColumn(
        "confusion_matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp")))
    if score not in pred.columns:
        return rates.withColumn("roc_auc", F.lit(None).cast("double")).withColumn(
            "pr_auc", F.lit(None).cast("double"))
    areas = area_under_curves(pred, keys, label, score)
    return rates.alias("l").join(areas.alias("r"), same(keys), "left").select(
        "l.*", "r.roc_auc", "r.pr_auc")


def class_counts_ovr(pred: DataFrame, keys: list[str], label="y_true", predicted="y_pred") -> DataFrame:
    """Per key and class: support, predicted count, hits, total (any number of classes)."""
    cells = pred.groupBy(
        *keys, F.col(label).cast("int").alias("_y"), F.col(predicted).cast("int").alias("_p")
    ).agg(F.count(F.lit(1)).alias("_n"))
    n, zero = F.col("_n"), F.lit(0).cast("long")
    sides = cells.select(*keys, "_n", F.explode(F.array(
        F.struct(F.col("_y").alias("cls"), n.alias("support"), zero.alias("predicted"),
                 F.when(F.col("_y") == F.col("_p"), n).otherwise(zero).alias("hits")),
        F.struct(F.col("_p").alias("cls"), zero.alias("support"), n.alias("predicted"),
                 zero.alias("hits")),
    )).alias("s"))
    per = sides.groupBy(*keys, F.col("s.cls").alias("cls")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")])
    return per.withColumn("total", F.sum("support").over(Window.partitionBy(*keys)))


def classification_report(
    pred: DataFrame, keys: list[str], label="y_true", predicted="y_pred",
    names: dict[int, str] | None = None,
) -> DataFrame:
    """Long report: one row per class, then ``accuracy``, ``macro avg``, ``weighted avg``."""
    per = class_counts_ovr(pred, keys, label, predicted)
    name = F.col("cls").cast("string")
    for value, text in (names or {}).items():
        name = F.when(F.col("cls") == value, text).otherwise(name)
    per = per.select(
        *keys, name.alias("entry"),
        safe_divide(F.col("hits"), F.col("predicted")).alias("precision"),
        safe_divide(F.col("hits"), F.col("support")).alias("recall"),
        safe_divide(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "hits",
    )
    w = F.col("support")
    stats = ("precision", "recall", "f1")
    total = per.groupBy(*keys).agg(
        *[F.avg(c).alias(f"macro_{c}") for c in stats],
        *[safe_divide(F.sum(F.col(c) * w), F.sum(w)).alias(f"weighted_{c}") for c in stats],
        safe_divide(F.sum("hits"), F.sum("support")).alias("acc"), F.sum("support").alias("support"),
    )
    none = F.lit(None).cast("double")
    rows = total.select(*keys, "support", F.explode(F.array(
        F.struct(F.lit("accuracy").alias("entry"), none.alias("precision"), none.alias("recall"),
                 F.col("acc").alias("f1")),
        *[F.struct(F.lit(f"{m} avg").alias("entry"), *[F.col(f"{m}_{c}").alias(c) for c in stats])
          for m in ("macro", "weighted")],
    )).alias("s"))
    return per.drop("hits").unionByName(rows.select(*keys, "s.*", "support"))


def ovr_auc_by_class(pred: DataFrame, keys: list[str], label="y_true", predicted="y_pred") -> DataFrame:
    """One-vs-rest AUC of hard labels per actual class: (TPR + TNR) / 2; 0.5 if a side is empty."""
    per = class_counts_ovr(pred, keys, label, predicted).where(F.col("support") > 0)
    hits, support, predicted_, total = (
        F.col(c).cast("double") for c in ("hits", "support", "predicted", "total"))
    tnr = F.try_divide(total - support - predicted_ + hits, total - support)
    return per.select(
        *keys, F.col("cls"), F.coalesce((hits / support + tnr) / 2, F.lit(0.5)).alias("auc"))


def ovr_auc(pred: DataFrame, keys: list[str], label="y_true", predicted="y_pred", average="macro") -> DataFrame:
    """Mean one-vs-rest AUC per key, or (``average=None``) a class -> AUC map."""
    per = ovr_auc_by_class(pred, keys, label, predicted)
    if average == "macro":
        return per.groupBy(*keys).agg(F.avg("auc").alias("ovr_auc"))
    return per.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("cls", "auc"))).alias("ovr_auc"))
