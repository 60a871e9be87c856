"""Exact ranks, exact-size samples, stratified splits and folds.

``df.sample`` is a coin flip per row, and one ``row_number`` over a class puts the
class into one task. Here a sample of exactly n rows is "all rows whose hash is at
most the n-th smallest": the n-th smallest is found by narrowing hash prefixes
(one small aggregate per level), and the sample itself is then a map-only filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.hashing import hash_key, hash_pick
from evenkeel.operators.small import bounded_rows, local_frame, same, try_rows

#: Hash digits fixed per narrowing level: 16^3 buckets.
DIGITS = 3
#: Hash digits of the window partitions of a full ranking: 16^4 per group.
RANK_DIGITS = 4
#: Most rows one task ranks directly.
TASK_ROWS = 500_000
#: Copies of one row that a task numbers.
COPY_RUN = 100_000
#: Sorts after every hex digest.
_ABOVE_ALL = "~"


def _ids(id_col: str | list[str]) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def row_key(id_col: str | list[str], seed: int, salt: str = "") -> Column:
    """Shuffling key of a row."""
    salts = [F.lit(salt)] if salt else []
    return hash_key(seed, *salts, *_ids(id_col))


def ordered_key(id_col: str) -> Column:
    """Key that keeps the order of a non-negative integer id, for unshuffled folds."""
    return F.lpad(F.hex(F.col(id_col).cast("long")), 16, "0")


def group_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def rank_cuts(
    df: DataFrame,
    by: list[str],
    id_col: str | list[str],
    ranks: DataFrame | list[tuple],
    key: Column,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(key, id) found at given 1-based ranks of each group.

    ``ranks``: rows (group columns, ``n`` = group size, ``rank``), class-level, as a frame or
    as driver rows. Returns a local frame: group columns, ``rank``, ``cut_key``, ``cut_id``
    (struct of the id columns). Ranks at or past the group size get a cut above every key;
    ranks below 1 get none.
    """
    rows, schema = cut_rows(df, by, id_col, ranks, key, task_rows)
    return local_frame(df.sparkSession, rows, schema)


def cut_rows(df, by, id_col, ranks, key, task_rows=TASK_ROWS) -> tuple[list[tuple], T.StructType]:
    """``rank_cuts`` as driver rows and their schema."""
    spark = df.sparkSession
    ids = _ids(id_col)
    keyed = df.select(*by, F.struct(*ids).alias("_id"), key.alias("_key"))
    groups = [keyed.schema[c] for c in by]
    cut_schema = T.StructType([*groups, T.StructField("rank", T.LongType()),
                               T.StructField("cut_key", T.StringType()), _renamed(keyed.schema["_id"], "cut_id")])
    edge_schema = T.StructType([*groups, T.StructField("rank", T.LongType()),
                                T.StructField("prefix", T.StringType()), T.StructField("left", T.LongType())])
    cuts, edges, largest = [], [], 0
    if isinstance(ranks, DataFrame):
        ranks = [tuple(r) for r in bounded_rows(ranks.select(*by, "n", "rank"))]
    for *group, n, at in ranks:
        if at is None or at < 1:
            continue
        if at >= n:
            cuts.append((*group, int(at), _ABOVE_ALL, None))
        else:
            edges.append((*group, int(at), "", int(at)))
            largest = max(largest, n)
    digits = 0
    while edges and largest > task_rows and digits < 30:
        # Count rows per bucket below the prefixes still open, then step into one bucket each.
        frame = F.broadcast(local_frame(spark, edges, edge_schema))
        open_ = F.broadcast(frame.select(*by, "prefix").distinct())
        counts = (
            keyed.alias("l")
            .join(open_.alias("r"), same(by) & (F.substring("l._key", 1, digits) == F.col("r.prefix")))
            .groupBy(*[F.col(f"l.{c}") for c in by], F.col("r.prefix"),
                     F.substring("l._key", 1, digits + DIGITS).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        w = Window.partitionBy(*by, "prefix").orderBy("bucket")
        counts = counts.withColumn("below", F.sum("n").over(w) - F.col("n"))
        steps = bounded_rows(
            counts.alias("l")
            .join(frame.alias("r"), same(by) & (F.col("l.prefix") == F.col("r.prefix")))
            .where((F.col("l.below") < F.col("r.left"))
                   & (F.col("r.left") <= F.col("l.below") + F.col("l.n")))
            .select(*[F.col(f"l.{c}") for c in by], "r.rank", "l.bucket",
                    (F.col("r.left") - F.col("l.below")).alias("left"), "l.n")
        )
        edges = [(*[r[c] for c in by], r["rank"], r["bucket"], r["left"]) for r in steps]
        largest = max(r["n"] for r in steps)
        digits += DIGITS
    if edges:
        frame = F.broadcast(local_frame(spark, edges, edge_schema))
        w = Window.partitionBy(*by, "_prefix").orderBy("_key", "_id")
        ranked = keyed.withColumn("_prefix", F.substring("_key", 1, digits))
        if digits:
            open_ = F.broadcast(frame.select(*by, "prefix").distinct())
            ranked = ranked.alias("l").join(
                open_.alias("r"), same(by) & (F.col("l._prefix") == F.col("r.prefix")), "left_semi")
        ranked = ranked.withColumn("_rank", F.row_number().over(w))
        found = (
            ranked.alias("l")
            .join(frame.alias("r"), same(by) & (F.col("l._prefix") == F.col("r.prefix"))
                  & (F.col("l._rank") == F.col("r.left")))
            .select(*[F.col(f"l.{c}") for c in by], "r.rank", F.col("l._key").alias("cut_key"),
                    F.col("l._id").alias("cut_id"))
        )
        cuts += [tuple(r) for r in bounded_rows(found)]
    return cuts, cut_schema


def _renamed(field: T.StructField, name: str) -> T.StructField:
    return T.StructField(name, field.dataType)


def _at_most(key: Column, ids: list[str], cut_key: Column, cut_id: Column) -> Column:
    return (key < cut_key) | ((key == cut_key) & (F.struct(*[F.col(c) for c in ids]) <= cut_id))


def hash_rank(
    df: DataFrame, by: list[str], id_col: str | list[str], key: Column, name: str = "rank"
) -> DataFrame:
    """0-based exact rank of every row in its group by (key, id).

    Window partitions are (group, key prefix); the offsets of the prefixes join on the
    same columns, so the rows are exchanged once and no task ever holds a whole group.
    """
    ids = _ids(id_col)
    # One struct key is never NULL, so the join below is a plain equality on the window's
    # partitioning; null-safe equality on columns would exchange the rows a second time.
    keyed = df.select("*", key.alias("_key")).withColumn(
        "_g", F.struct(*by, F.substring("_key", 1, RANK_DIGITS).alias("_bucket")))
    counts = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[F.col("_g").getField(c) for c in by]).orderBy(F.col("_g").getField("_bucket"))
    below = counts.select("_g", (F.sum("_n").over(before) - F.col("_n")).alias("_below"))
    w = Window.partitionBy("_g").orderBy("_key", *ids)
    ranked = keyed.withColumn("_rn", F.row_number().over(w))
    return ranked.join(below, "_g").select(
        *df.columns, (F.col("_rn") - 1 + F.col("_below")).cast("long").alias(name))


def row_ids(df: DataFrame, name: str = "row_id", copy_run: int = COPY_RUN) -> DataFrame:
    """Rows with ids 0 to N - 1 in order of the md5 of their content (as JSON); a column of that name is replaced.

    The ids of a content are a range, and equal rows are interchangeable, so ids do not depend on files, splits or
    partitions. Only contents are ranked, never rows: copies are counted before the shuffle, ranges are placed by window
    partitions of hash prefixes, and rows are made again from the counts, ``copy_run`` copies at a time in any task.
    NULL, empty text and NaN are contents of their own. Columns may have any names, and any types but maps.
    """
    df = df.drop(name)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    content = df.select(
        F.struct(F.md5(F.to_json(row, {"ignoreNullFields": "false"})).alias("h"),
                 F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("x")).alias("key"), row.alias("row"))
    counts = content.groupBy("key").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n")).withColumn(
        "bucket", F.substring("key.h", 1, RANK_DIGITS))
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("all"))
    below = sums.select("bucket", (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("below"))
    w = Window.partitionBy("bucket").orderBy("key")
    placed = counts.withColumn("at", F.sum("n").over(w) - F.col("n")).join(below, "bucket").select(
        "row", "n", (F.col("at") + F.col("below")).alias("start"))
    runs = placed.select("row", "n", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(copy_run).cast("long"))).alias("first"))
    often = runs.where(F.col("n") > copy_run).repartition("start", "first")
    spread = runs.where(F.col("n") <= copy_run).unionByName(often)
    last = F.least(F.col("first") + copy_run, F.col("n")) - 1
    rows = spread.select("row", F.explode(F.sequence(F.col("start") + F.col("first"), F.col("start") + last)).alias("id"))
    return rows.select("row.*", F.col("id").alias(name))


def sample_exact(
    df: DataFrame,
    by: list[str],
    id_col: str | list[str],
    quotas: DataFrame,
    seed: int = 42,
    salt: str = "",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Exactly ``quota`` rows per group without replacement (all rows if the group is smaller).

    ``quotas``: group columns, ``n`` (group size), ``quota``. Groups it lacks are dropped.
    """
    key = row_key(id_col, seed, salt)
    ranks = quotas.select(*by, "n", F.col("quota").cast("long").alias("rank"))
    few = try_rows(ranks.select(*by, "n", "rank"))
    if few is None:  # too many groups to broadcast: rank every row instead
        ranked = hash_rank(df, by, id_col, key, "_rank")
        return (ranked.alias("l").join(ranks.alias("r"), same(by))
                .where(F.col("l._rank") < F.col("r.rank"))
                .select(*[F.col(f"l.{c}") for c in df.columns]))
    cuts = rank_cuts(df, by, id_col, [tuple(r) for r in few], key, task_rows)
    return (
        df.alias("l").join(F.broadcast(cuts).alias("r"), same(by))
        .where(_at_most(key, _ids(id_col), F.col("r.cut_key"), F.col("r.cut_id")))
        .select(*[F.col(f"l.{c}") for c in df.columns])
    )


def largest_remainder(sizes: DataFrame, total: Column, by: list[str], within: list[str] = ()) -> DataFrame:
    """Whole-number quotas in proportion to ``n``, adding up to ``total`` in each ``within`` group;
    ties by group order. ``sizes`` is class-level.
    """
    everything = Window.partitionBy(*within)
    exact = total * F.col("n") / F.sum("n").over(everything)
    base = sizes.withColumn("_exact", exact.cast("double")).withColumn(
        "quota", F.floor("_exact").cast("long"))
    spare = (total - F.sum("quota").over(everything)).cast("long")
    order = everything.orderBy(F.desc(F.col("_exact") - F.col("quota")), *by)
    return (
        base.withColumn("_spare", spare)
        .withColumn("quota", F.col("quota")
                    + F.when(F.row_number().over(order) <= F.col("_spare"), 1).otherwise(0))
        .drop("_exact", "_spare")
    )


def split_quotas(sizes: DataFrame, label: str, test_share: float, within: list[str] = ()) -> DataFrame:
    """Test rows per class: ceil(share * N) in all, by largest remainder."""
    whole = F.sum("n").over(Window.partitionBy(*within))
    return largest_remainder(sizes, F.ceil(F.lit(float(test_share)) * whole), [label], within)


def stratified_split(
    df: DataFrame,
    label: str,
    id_col: str | list[str],
    test_share: float = 0.2,
    seed: int = 42,
    within: list[str] = (),
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Adds ``split`` = train/test with exact class quotas. The rows are not shuffled.

    ``within``: columns (a dataset name) whose every value is split on its own, in the same job.
    """
    by = [*within, label]
    quotas = split_quotas(group_sizes(df, by), label, test_share, within)
    ranks = quotas.select(*by, "n", F.col("quota").alias("rank"))
    key = row_key(id_col, seed, "split")
    cuts = rank_cuts(df, by, id_col, ranks, key, task_rows)
    in_test = F.coalesce(
        _at_most(key, _ids(id_col), F.col("r.cut_key"), F.col("r.cut_id")), F.lit(False))
    return (
        df.alias("l").join(F.broadcast(cuts).alias("r"), same(by), "left")
        .select(*[F.col(f"l.{c}") for c in df.columns],
                F.when(in_test, "test").otherwise("train").alias("split"))
    )


def stratified_folds(
    df: DataFrame,
    label: str,
    id_col: str | list[str],
    k: int = 3,
    seed: int = 42,
    shuffle: bool = True,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Adds ``fold`` in 0..k-1; per class the fold sizes differ by at most one row.

    ``shuffle=False`` cuts each class into contiguous runs of the integer id instead.
    """
    spark = df.sparkSession
    ids = _ids(id_col)
    key = row_key(ids, seed, "fold") if shuffle else ordered_key(ids[0])
    sizes = bounded_rows(group_sizes(df, [label]))
    ends = {r[label]: [f * (r["n"] // k) + min(f, r["n"] % k) for f in range(1, k)] for r in sizes}
    # Fewer rows than folds: several folds end at the same rank, which one cut marks.
    ranks = [(r[label], r["n"], e) for r in sizes for e in sorted(set(ends[r[label]]))]
    field = df.schema[label]
    cuts, schema = cut_rows(df, [label], ids, ranks, key, task_rows)
    at = {(c, end): {"cut_key": k, "cut_id": i} for c, end, k, i in cuts}
    cut_type = T.StructType([schema["cut_key"], schema["cut_id"]])
    marks = local_frame(
        spark, [(c, [at.get((c, e)) for e in es]) for c, es in ends.items()],
        T.StructType([field, T.StructField("cuts", T.ArrayType(cut_type))]))
    after = F.filter(
        "r.cuts",
        lambda c: ~F.coalesce(
            _at_most(key, ids, c["cut_key"], c["cut_id"]), F.lit(False)))
    return (
        df.alias("l").join(F.broadcast(marks).alias("r"), same([label]))
        .select(*[F.col(f"l.{c}") for c in df.columns],
                F.coalesce(F.size(after), F.lit(0)).cast("int").alias("fold"))
    )


def sample_replacement(
    df: DataFrame,
    by: list[str],
    id_col: str | list[str],
    draws: DataFrame,
    seed: int = 42,
    salt: str = "",
) -> DataFrame:
    """``quota`` rows per group with replacement; adds ``draw`` (0-based draw number).

    Draw d takes the row of rank floor(u * n), u hashed from (group, d). ``draws``:
    group columns, ``n``, ``quota``. Both sides of the join are keyed by (group, rank).
    """
    key = row_key(id_col, seed, salt)
    ranked = hash_rank(df, by, id_col, key, "_rank")
    picks = numbered_draws(draws, by).withColumn(
        "_pick", hash_pick(hash_key(seed, F.lit(f"{salt}draw"), *by, "draw"), "n"))
    return (
        picks.alias("d").join(
            ranked.alias("l"), same(by, "d", "l") & (F.col("d._pick") == F.col("l._rank")))
        .select(*[F.col(f"l.{c}") for c in df.columns], "d.draw")
    )


#: Draws made per generated row range, so a huge quota is spread over many tasks.
DRAW_RUN = 65_536


def numbered_draws(draws: DataFrame, by: list[str]) -> DataFrame:
    """One row per draw 0..quota-1, made in runs that are spread over the cluster."""
    runs = draws.where(F.col("quota") > 0).select(
        *by, "n", "quota",
        F.explode(F.sequence(F.lit(0).cast("long"),
                             F.floor((F.col("quota") - 1) / DRAW_RUN).cast("long"))).alias("_run"))
    runs = runs.repartition(*[F.col(c) for c in by], F.col("_run"))
    return runs.select(
        *by, "n",
        F.explode(F.sequence(
            F.col("_run") * DRAW_RUN,
            F.least(F.col("quota") - 1, F.col("_run") * DRAW_RUN + DRAW_RUN - 1).cast("long"),
        )).alias("draw"))
