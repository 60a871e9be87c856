"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame functions only.

A source's target is min(cap, weight * level), where the cap is ``max_epochs`` times its size
and the level is the one at which the targets add up to the budget: the fixed point of
"clamp what is above, share the excess by weight, repeat". Sources, of which there are few
against documents, are sorted by cap / weight, so the level is a closed form over running sums.

A target of r times the source's size takes every document floor(r) times, and once more the
documents that come first in a seeded hash order, until their words reach the rest. The cut
is found in two steps: sums per (source, hash bucket), then an exact order inside the one
bucket per source that the cut falls into. No source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import hash_key
from evenkeel.llm.common import stored
from evenkeel.operators.small import local_frame, try_rows

#: Hash digits of a bucket: 16^3 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``sizes`` (source, source_size, one row per source) with ``target``.

    Weights repeat over the sources in code point order, null last. The budget is ``share`` of
    all sizes. Empty sources get 0. A budget above all caps ends at the caps.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    rows = rows.select(
        "*",
        F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)).alias("full"),
        F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("budget"))
    # the level if exactly the sources before this one are full; valid for the first that stays below its cap
    level = (F.col("budget") - F.coalesce("full", F.lit(0.0))) / F.col("open")
    rows = rows.withColumn("level", F.when(level <= F.col("ratio"), level))
    rows = rows.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("ratio"))).over(everything))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), "cap")).alias("target"))


def mix(docs: DataFrame, seed: int = 42, share: float = 1.5, max_epochs: int = 2,
        weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Columns of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    ``mix_copies`` is how often the mix repeats the document: 0 to ``max_epochs``. Null sources
    form one source; a null text has size 0. Rows without an id are ordered by their text; rows that share
    an id by size, then text; rows that share both are counted, so that the cut may fall between them, and
    may swap places. Other columns pass through under any name; columns of the four new names are replaced.
    The words a source takes miss its target by less than its largest document at the cut.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    tie = F.xxhash64("doc_id", "text")
    key = hash_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("no id "), tie.cast("string"))))
    rows = docs.select(F.struct("*").alias("row"), F.col("source"), word_count(F.col("text")).alias("size"), key.alias("key"), tie.alias("tie"))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    slim = rows.drop("row")
    buckets = stored(slim.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goal = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), share, max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", whole.cast("int"))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    steps = buckets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    steps = steps.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(F.col("source")), "right")
    goal = steps.groupBy("source", "source_size", "target", "whole").agg(
        F.min_by(F.struct("bucket", "before", "rest"), F.when(F.expr("before < rest and before + words >= rest"), F.col("bucket"))).alias("cut"))
    goal = _planned(goal.select(F.col("source").alias("s"), "source_size", "target", "whole", "cut"))
    same = F.col("source").eqNullSafe(F.col("s"))
    inside = slim.join(goal, same & (F.col("bucket") == F.col("cut.bucket")))
    running = Window.partitionBy("source", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("cut.before") + F.sum("size").over(running))
    # a document is taken while its middle lies below the cut; rows that are alike are taken in number
    taken = (F.col("upto") - F.col("size") / 2 <= F.col("cut.rest")).cast("int")
    alike = inside.groupBy(F.col("source").alias("l"), "key", "size", "tie").agg(F.sum(taken).alias("n"), F.count(F.lit(1)).alias("of"))
    last = alike.where("n > 0").groupBy("l").agg(F.max(F.struct("key", "size", "tie", "n", "of")).alias("last"))
    goal = _planned(goal.join(last, F.col("s").eqNullSafe(F.col("l")), "left").drop("l"))
    place = F.struct("key", "size", "tie")
    edge = F.struct("last.key", "last.size", "last.tie")
    upto_edge = F.coalesce(place <= edge, F.lit(False))
    extra = F.when(F.col("cut").isNull(), 0).when(F.col("bucket") < F.col("cut.bucket"), 1).when(
        (F.col("bucket") == F.col("cut.bucket")) & upto_edge, 1).otherwise(0)
    out = rows.join(goal, same).withColumn("extra", extra)
    if not goal.where("last.n < last.of").isEmpty():  # the cut falls between rows that are alike: only these are numbered
        at_edge = F.coalesce((F.col("bucket") == F.col("cut.bucket")) & (place == edge) & (F.col("last.n") < F.col("last.of")), F.lit(False))
        number = F.row_number().over(Window.partitionBy("source", "key", "size", "tie").orderBy("tie"))
        cut = out.where(at_edge).withColumn("number", number).withColumn("extra", (F.col("number") <= F.col("last.n")).cast("int")).drop("number")
        out = out.where(~at_edge).unionByName(cut)
    return out.select(
        "row.*", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), (F.col("whole") + F.col("extra")).cast("int").alias("mix_copies"))


def _planned(goal: DataFrame) -> DataFrame:
    """Rows of sources: broadcast while they are few, else stored and joined by a shuffle that AQE splits."""
    rows = try_rows(goal)
    if rows is None:
        return stored(goal)
    return F.broadcast(local_frame(goal.sparkSession, rows, goal.schema))


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document of ``docs`` as often as ``mix`` says, columns unchanged."""
    rows = mix(docs, **settings).where("mix_copies > 0")
    rows = rows.select(F.struct(*docs.columns).alias("row"), F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return rows.select("row.*")
