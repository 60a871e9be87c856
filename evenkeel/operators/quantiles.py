"""Exact quantiles (linear interpolation) without sorting or gathering a column.

``percentile`` keeps every distinct value of a column in one task. Up to ``task_rows``
values that is fine and used as is; beyond, mergeable sketches bracket each target, the
brackets are verified by counting, and only the few values inside are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.small import local_frame

TASK_ROWS = 100_000
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float],
    task_rows: int = TASK_ROWS, accuracy: int = ACCURACY,
) -> list[list[float]]:
    """Quantiles per column, NULLs ignored; one list per column in the order of ``probs``."""
    wide = df.selectExpr(*[f"cast(`{c}` AS double) AS c{i}" for i, c in enumerate(cols)])
    sizes = list(wide.selectExpr(*[f"count({c}) AS {c}" for c in wide.columns]).first())
    if max(sizes, default=0) <= task_rows:
        shares = ", ".join(f"{float(p)!r}D" for p in probs)
        row = wide.selectExpr(*[f"percentile({c}, array({shares})) AS {c}" for c in wide.columns]).first()
        return [list(v) if v is not None else [float("nan")] * len(probs) for v in row]

    slots = []
    for i, n in enumerate(sizes):
        for p in probs:
            at = (n - 1) * p
            slots.append({"col": f"c{i}", "n": n, "at": at, "lo_i": math.floor(at), "hi_i": math.ceil(at),
                          "lo": None, "hi": None, "below": 0, "inside": n, "open": n > task_rows})
    while any(s["open"] for s in slots):
        _narrow(wide, [s for s in slots if s["open"]], task_rows, accuracy)
    one = {id(s) for s in slots if s["lo"] is not None and s["lo"] == s["hi"]}  # a single value left
    rest = [(j, s) for j, s in enumerate(slots) if s["n"] > 0 and id(s) not in one]
    found = _pick(wide, rest) if rest else {}
    out: list[list[float]] = [[] for _ in cols]
    for j, s in enumerate(slots):
        if s["n"] == 0:
            value = float("nan")
        elif id(s) in one:
            value = s["lo"]
        else:
            lo, hi = found[j, s["lo_i"]], found[j, s["hi_i"]]
            value = lo + (hi - lo) * (s["at"] - s["lo_i"])
        out[j // len(probs)].append(value)
    return out


def _inside(s: dict):
    c = F.col(s["col"])
    cond = c.isNotNull()
    if s["lo"] is not None:
        cond = cond & (c >= s["lo"])
    if s["hi"] is not None:
        cond = cond & (c <= s["hi"])
    return cond


def _narrow(wide: DataFrame, slots: list[dict], task_rows: int, accuracy: int) -> None:
    """One round: sketch inside the brackets, then keep new brackets that counts confirm."""
    margin = 2.0 / accuracy
    wanted: dict[tuple, list[float]] = {}  # one sketch serves all slots of a column and bracket
    places = []
    for s in slots:
        span = max(s["inside"] - 1, 1)
        shares = wanted.setdefault((s["col"], s["lo"], s["hi"]), [])
        places.append(((s["col"], s["lo"], s["hi"]), len(shares)))
        shares += [max((s["lo_i"] - s["below"]) / span - margin, 0.0),
                   min((s["hi_i"] - s["below"]) / span + margin, 1.0)]
    row = wide.agg(*[
        F.percentile_approx(F.when(_inside({"col": c, "lo": lo, "hi": hi}), F.col(c)), shares, accuracy)
        for (c, lo, hi), shares in wanted.items()]).first()
    sketch = dict(zip(wanted, row))
    brackets = [(sketch[k][i], sketch[k][i + 1]) for k, i in places]
    tries = []
    for s, (lo, hi) in zip(slots, brackets):
        tries.append({**s, "lo": lo, "hi": hi})
    counts = list(wide.agg(*[
        agg for t in tries for agg in (
            F.count(F.when(F.col(t["col"]) < t["lo"], 1)), F.count(F.when(_inside(t), 1)))]).first())
    for k, (s, t) in enumerate(zip(slots, tries)):
        below, inside = counts[2 * k], counts[2 * k + 1]
        holds = below <= s["lo_i"] and s["hi_i"] < below + inside
        shrinks = inside * 2 <= s["inside"]
        if holds:
            s.update(lo=t["lo"], hi=t["hi"], below=below, inside=inside)
        # A bracket that stopped shrinking holds few distinct values with many copies each.
        s["open"] = holds and shrinks and inside > task_rows


def _pick(wide: DataFrame, slots: list[tuple[int, dict]]) -> dict[tuple[int, int], float]:
    entries = F.array(*[
        F.when(_inside(s), F.struct(F.lit(j).alias("slot"), F.col(s["col"]).alias("value")))
        for j, s in slots])
    values = (
        wide.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
        .groupBy("e.slot", "e.value").agg(F.count(F.lit(1)).alias("n"))
    )
    spark = wide.sparkSession
    wanted = local_frame(
        spark, [(j, i, i - s["below"]) for j, s in slots for i in {s["lo_i"], s["hi_i"]}],
        "slot int, at long, need long")
    w = Window.partitionBy("slot").orderBy("value")
    hits = (
        values.withColumn("upto", F.sum("n").over(w))
        .join(F.broadcast(wanted), "slot")
        .where((F.col("upto") - F.col("n") <= F.col("need")) & (F.col("need") < F.col("upto")))
        .select("slot", "at", "value").collect()
    )
    return {(r["slot"], r["at"]): r["value"] for r in hits}
