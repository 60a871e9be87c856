"""Decision trees: a whole grid of them grown level by level in shared passes.

Features are cut into at most ``max_bins`` bins at data quantiles and kept as one byte
each. A pass sums class histograms of the open nodes of *all* trees; nodes that several
trees reach by the same splits are counted once, and a tree cut at depth d is the first d
levels of the unlimited one, so a depth grid costs a single tree. At most NODE_BATCH nodes
are open per pass, which bounds what tasks hold.

Histograms are summed in a shuffle and split choices made where they lie: a task has one
node, and one split per node and rule reaches the driver. Only passes whose partial counts are
few altogether skip the shuffle. A node of at most ``LOCAL_ROWS`` rows is not opened in passes:
one shuffle brings its rows together and a task grows all that lies below it, so passes
do not multiply with the rows. A grid is scored there as well, and its lower nodes never leave the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.functions.kernels import list_column, matrix
from evenkeel.functions.numeric import safe_divide
from evenkeel.operators.passes import hold, sum_rows
from evenkeel.operators.scale import unpack, vector_width
from evenkeel.operators.small import bounded_rows, local_frame

#: Nodes whose histograms one pass collects.
NODE_BATCH = 512
#: Histogram cells (partitions x nodes x cells) up to which the driver adds partial counts and chooses;
#: beyond, executors do both. The splits are the same.
DRIVER_CELLS = 200_000
#: Rows up to which one task grows the rest of a node's trees.
LOCAL_ROWS = 8192


def impurity(pos: Column, n: Column, criterion: str = "gini") -> Column:
    """Gini or entropy (bits) of a node with ``pos`` positives among ``n`` rows."""
    p = safe_divide(pos, n)
    if criterion == "gini":
        return F.when(n == 0, 0.0).otherwise(1 - p * p - (1 - p) * (1 - p))
    if criterion == "entropy":
        part = lambda q: F.when(q <= 0, 0.0).otherwise(-q * F.log2(q))
        return F.when(n == 0, 0.0).otherwise(part(p) + part(1 - p))
    raise ValueError(f"unknown criterion: {criterion}")


def split_gains(df: DataFrame, thresholds: dict[str, list[float]], label: str = "label") -> DataFrame:
    """feature, threshold, left size, gini_gain, entropy_gain for x <= threshold.

    Rows are not multiplied by candidates: every candidate is two sums of one aggregate.
    """
    cands = [(c, t) for c, ts in thresholds.items() for t in ts]
    y = F.col(label).cast("long")
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("p"),
        *[e for i, (c, t) in enumerate(cands) for e in (
            F.coalesce(F.sum(F.when(F.col(c) <= t, 1)), F.lit(0)).alias(f"n{i}"),
            F.coalesce(F.sum(F.when(F.col(c) <= t, y)), F.lit(0)).alias(f"p{i}"))])
    rows = sums.select("n", "p", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(float(t)).alias("threshold"),
                 F.col(f"n{i}").alias("nl"), F.col(f"p{i}").alias("pl"))
        for i, (c, t) in enumerate(cands)])).alias("s")).select("n", "p", "s.*")
    n, p, nl, pl = (F.col(c) for c in ("n", "p", "nl", "pl"))

    def gain(kind):
        return (impurity(p, n, kind) - safe_divide(nl, n) * impurity(pl, nl, kind)
                - safe_divide(n - nl, n) * impurity(p - pl, n - nl, kind))

    return rows.select("feature", "threshold", F.col("nl").alias("left"),
                       gain("gini").alias("gini_gain"), gain("entropy").alias("entropy_gain"))


@dataclass(frozen=True)
class TreeSpec:
    """Growth rule of one tree; ``fold`` is left out of its training rows (None: all rows)."""

    criterion: str = "gini"
    min_split: int = 2
    min_leaf: int = 1
    fold: int | None = None
    max_depth: int | None = None


@dataclass
class Tree:
    """Nodes in arrays; ``x[feature] <= threshold`` goes left, a leaf points to itself."""

    spec: TreeSpec
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray  # nodes x 2

    def levels(self, x: np.ndarray):
        """Node of every row after 0, 1, 2, ... splits, until nothing moves."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            yield at
            go_left = x[rows, self.feature[at]] <= self.threshold[at]
            new = np.where(go_left, self.left[at], self.right[at])
            if (new == at).all():
                return
            at = new

    def probability(self, x: np.ndarray) -> np.ndarray:
        for depth, at in enumerate(self.levels(x)):
            if depth == self.spec.max_depth:
                break
        return self.counts[at, 1] / self.counts[at].sum(1)


@dataclass
class _Node:
    fold: int | None
    parent: int | None
    feature: int = 0
    cut: int = 0
    left: bool = True
    counts: tuple[float, float] | None = None
    best: dict = field(default_factory=dict)  # rule -> (feature, cut) or None


class _Growth:
    """All nodes of all trees; equal paths are one node."""

    def __init__(self, specs: list[TreeSpec]):
        self.nodes: list[_Node] = []
        self.index: dict[tuple, int] = {}
        self.roots = [self.child(s.fold, None, 0, 0, True) for s in specs]
        self.splits: list[dict[int, tuple]] = [{} for _ in specs]  # per tree: node -> (feature, cut, left, right)
        self.open: list[set[int]] = [{r} for r in self.roots]
        self.local: dict[int, tuple[int, list[int]]] = {}  # node that a task grows on -> (depth, trees)

    def child(self, fold, parent, feature, cut, left) -> int:
        key = (fold, parent, feature, cut, left)
        if key not in self.index:
            self.index[key] = len(self.nodes)
            self.nodes.append(_Node(fold, parent, feature, cut, left))
        return self.index[key]

    def lineage(self, wanted: list[int]) -> list[tuple]:
        """The wanted nodes and their ancestors, parents first."""
        need, todo = set(), list(wanted)
        while todo:
            i = todo.pop()
            if i is not None and i not in need:
                need.add(i)
                todo.append(self.nodes[i].parent)
        return [(i, n.fold, n.parent, n.feature, n.cut, n.left) for i in sorted(need) for n in (self.nodes[i],)]


def _rows_of(lineage: list[tuple], bins: np.ndarray, fold: np.ndarray, held: bool = False) -> dict[int, np.ndarray]:
    """Training rows of each node; ``held``: rows of the left-out fold that come to it."""
    rows: dict[int, np.ndarray] = {}
    for i, f, parent, feature, cut, left in lineage:
        if parent is None:
            rows[i] = np.arange(len(fold)) if f is None else np.nonzero((fold == f) == held)[0]
        else:
            up = rows[parent]
            rows[i] = up[(bins[up, feature] <= cut) == left]
    return rows


def bin_cuts(df: DataFrame, features: str = "features", max_bins: int = 64) -> list[list[float]]:
    """Candidate thresholds per feature: distinct data quantiles, all sketched in one pass."""
    wide = unpack(df, vector_width(df, features), features)
    shares = ", ".join(f"{i / max_bins!r}D" for i in range(1, max_bins))
    row = wide.selectExpr(*[f"percentile_approx({c}, array({shares}), 10000) AS {c}" for c in wide.columns]).first()
    return [sorted(set(v)) for v in row]


def _binned(df: DataFrame, cuts: list[list[float]], label: str, features: str, fold: str | None) -> DataFrame:
    @F.arrow_udf("binary")
    def to_bytes(v: pa.Array) -> pa.Array:
        x = matrix(v)
        out = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
        offsets = np.arange(0, (len(x) + 1) * out.shape[1], out.shape[1], dtype=np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])

    return df.select(F.col(label).cast("int").alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
                     to_bytes(F.col(features).cast("array<double>")).alias("bins"))


def _bytes(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), width)


def _histograms(rows: DataFrame, growth: _Growth, batch: list[int], width: int, bins: int) -> DataFrame:
    """(cell, n): partial class counts; a cell is (place in ``batch``, feature, bin, class) as one number."""
    lineage = growth.lineage(batch)
    size = width * bins * 2
    offsets = np.arange(width, dtype=np.int64) * bins * 2

    def run(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _bytes(b.column("bins"), width)
            y = b.column("y").to_numpy(zero_copy_only=False)
            cell = offsets + x.astype(np.int64) * 2 + y[:, None]
            at = _rows_of(lineage, x, b.column("fold").to_numpy(zero_copy_only=False))
            for k, node in enumerate(batch):
                if len(at[node]):
                    part = np.bincount(cell[at[node]].ravel(), minlength=size).astype(np.float64)
                    acc[k] = part if k not in acc else acc[k] + part
        if acc:  # deep nodes hold few rows: only cells with rows are sent
            cells = [k * size + np.nonzero(h)[0] for k, h in acc.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cells)), pa.array(np.concatenate([h[h > 0] for h in acc.values()]))],
                names=["cell", "n"])

    return rows.mapInArrow(run, "cell long, n double")


def _splits(parts: DataFrame, count: int, width: int, bins: int, partitions: int, rules_of) -> list[tuple[tuple[float, float], dict]]:
    """Class counts and best split per rule of the first ``count`` nodes; ``rules_of(place, counts)`` names the rules."""
    size = width * bins * 2
    if partitions * count * size <= DRIVER_CELLS:
        table = parts.toArrow()
        out = np.zeros(count * size)
        if table.num_rows:
            np.add.at(out, table.column("cell").to_numpy(), table.column("n").to_numpy())
        hists = out.reshape(count, width, bins, 2)
        counts = [tuple(map(float, h[0].sum(0))) for h in hists]
        return [(c, _choose(h, rules) if (rules := rules_of(k, c)) else {}) for k, (c, h) in enumerate(zip(counts, hists))]

    def chosen(part: pa.Table) -> pa.Table:
        cell, n = part.column("cell").to_numpy(), part.column("n").to_numpy()
        node = int(cell[0] // size)
        hist = np.zeros(size)
        hist[cell % size] = n
        hist = hist.reshape(width, bins, 2)
        counts = tuple(map(float, hist[0].sum(0)))
        rules = rules_of(node, counts)
        found = [(node, *counts, None, None, None, None)]
        found += [(node, *counts, *rule, *at) for rule, at in (_choose(hist, rules) if rules else {}).items()]
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        names = ["node", "n0", "n1", "kind", "leaf", "feature", "cut"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

    cells = parts.groupBy("cell").agg(F.sum("n").alias("n"))
    best = cells.groupBy(F.floor(F.col("cell") / size).alias("_n")).applyInArrow(
        chosen, "node int, n0 double, n1 double, kind string, leaf int, feature int, cut int")
    out: list[tuple] = [((0.0, 0.0), {}) for _ in range(count)]
    for r in best.toArrow().to_pylist():
        out[r["node"]] = (r["n0"], r["n1"]), out[r["node"]][1]
        if r["kind"] is not None:
            out[r["node"]][1][r["kind"], r["leaf"]] = (r["feature"], r["cut"])
    return out


def _node_impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    n = counts.sum(-1, keepdims=True)
    p = counts / np.maximum(n, 1)
    if criterion == "gini":
        return 1.0 - (p * p).sum(-1)
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(-1)


def _scores(hist: np.ndarray, rules: set[tuple[str, int]]) -> dict:
    """Per (criterion, min_leaf) that some split keeps: lowest impurity after it, rounded, and its place in features x cuts."""
    left = hist.cumsum(1)[:, :-1, :]
    total = hist[0].sum(0)
    right = total - left
    nl, nr = left.sum(-1), right.sum(-1)
    out = {}
    for criterion in {c for c, _ in rules}:
        after = (nl * _node_impurity(left, criterion) + nr * _node_impurity(right, criterion)) / total.sum()
        for kind, leaf in rules:
            if kind == criterion:
                score = np.round(np.where((nl >= leaf) & (nr >= leaf), after, np.inf), 12)
                best = int(np.argmin(score))
                if np.isfinite(score.ravel()[best]):
                    out[kind, leaf] = (float(score.ravel()[best]), best)
    return out


def _choose(hist: np.ndarray, rules: set[tuple[str, int]]) -> dict:
    """Best (feature, cut) per (criterion, min_leaf): largest gain, lowest feature and cut on ties."""
    return {rule: divmod(at, hist.shape[1] - 1) for rule, (_, at) in _scores(hist, rules).items()}


def _grow(rows: DataFrame, specs: list[TreeSpec], partitions: int, width: int, bins: int) -> _Growth:
    """The nodes above those that a task can grow on (``local``)."""
    growth = _Growth(specs)
    depth = 0
    while any(growth.open):
        users: dict[int, list[int]] = {}
        for t, nodes in enumerate(growth.open):
            for i in nodes:
                users.setdefault(i, []).append(t)
        level = sorted(users)
        for s in range(0, len(level), NODE_BATCH):
            batch = level[s:s + NODE_BATCH]
            wants = [{(specs[t].criterion, specs[t].min_leaf, specs[t].min_split) for t in users[node]
                      if specs[t].max_depth is None or depth < specs[t].max_depth} for node in batch]

            def rules_of(k, counts, wants=wants):
                return {(c, leaf) for c, leaf, split in wants[k] if min(counts) > 0 and sum(counts) >= split}

            parts = _histograms(rows, growth, batch, width, bins)
            for node, (counts, best) in zip(batch, _splits(parts, len(batch), width, bins, partitions, rules_of)):
                growth.nodes[node].counts, growth.nodes[node].best = counts, best
        for t, nodes in enumerate(growth.open):
            nxt, spec = set(), specs[t]
            for i in nodes:
                node = growth.nodes[i]
                best = node.best.get((spec.criterion, spec.min_leaf))
                grows = (best is not None and min(node.counts) > 0 and sum(node.counts) >= spec.min_split
                         and (spec.max_depth is None or depth < spec.max_depth))
                if grows and sum(node.counts) <= LOCAL_ROWS:
                    growth.local.setdefault(i, (depth, []))[1].append(t)
                elif grows:
                    pair = [growth.child(spec.fold, i, *best, side) for side in (True, False)]
                    growth.splits[t][i] = (*best, *pair)
                    nxt.update(pair)
            growth.open[t] = nxt
        depth += 1
    return growth


def _below(x: np.ndarray, y: np.ndarray, bins: int, specs: dict[int, TreeSpec], depth: int, held: np.ndarray):
    """Grows trees on the rows ``x``, ``y`` of a node. Yields per tree and node: tree, place, depth, counts, the split
    (feature, cut, left, right) or None, and how many rows of ``held`` come there. A place is a node's number in its tree."""
    width = x.shape[1]
    size = width * bins * 2
    cell = np.arange(width, dtype=np.int64) * bins * 2 + x.astype(np.int64) * 2 + y[:, None]
    next_place = dict.fromkeys(specs, 1)
    todo = [(np.arange(len(y)), np.arange(len(held)), depth, dict.fromkeys(specs, 0))]
    while todo:
        rows, out, depth, places = todo.pop()
        n1 = int(y[rows].sum())
        counts = float(len(rows) - n1), float(n1)
        wants = [t for t in places if min(counts) > 0 and len(rows) >= specs[t].min_split
                 and (specs[t].max_depth is None or depth < specs[t].max_depth)]
        best = {}
        if wants:
            hist = np.bincount(cell[rows].ravel(), minlength=size).astype(np.float64).reshape(width, bins, 2)
            best = _choose(hist, {(specs[t].criterion, specs[t].min_leaf) for t in wants})
        sides: dict[tuple[int, int], tuple[dict, dict]] = {}
        for t, place in places.items():
            at = best.get((specs[t].criterion, specs[t].min_leaf)) if t in wants else None
            if at is None:
                yield t, place, depth, counts, None, len(out)
                continue
            low = next_place[t]
            next_place[t] += 2
            yield t, place, depth, counts, (*at, low, low + 1), len(out)
            lows, highs = sides.setdefault(at, ({}, {}))
            lows[t], highs[t] = low, low + 1
        for (feature, cut), pair in sides.items():
            goes, comes = x[rows, feature] <= cut, held[out, feature] <= cut
            todo += [(rows[goes], out[comes], depth + 1, pair[0]), (rows[~goes], out[~comes], depth + 1, pair[1])]


def _in_tasks(growth: _Growth, specs: list[TreeSpec], rows: DataFrame, held: DataFrame | None, width: int, bins: int,
              use, schema: str) -> DataFrame:
    """Rows of ``use(node, grown)`` for each node of ``growth.local``; ``grown`` is what ``_below`` yields."""
    local = {i: (depth, {t: specs[t] for t in trees}) for i, (depth, trees) in growth.local.items()}
    lineage = growth.lineage(sorted(local))
    wanted = sorted(local)

    def route(is_held: bool):
        def run(batches):
            for b in batches:
                if b.num_rows == 0:
                    continue
                at = _rows_of(lineage, _bytes(b.column("bins"), width), b.column("fold").to_numpy(zero_copy_only=False), is_held)
                for i in wanted:
                    if len(at[i]):
                        some = b.select(["y", "bins"]).take(pa.array(at[i]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at[i]), i, np.int64)), pa.array(np.full(len(at[i]), is_held)), *some.columns],
                            names=["node", "held", "y", "bins"])
        return run

    def grow(part: pa.Table) -> pa.Table:
        node = part.column("node")[0].as_py()
        is_held = part.column("held").to_numpy()
        x, y = _bytes(part.column("bins"), width), part.column("y").to_numpy()
        depth, trees = local[node]
        found = use(depth, _below(x[~is_held], y[~is_held], bins, trees, depth, x[is_held]))
        return pa.Table.from_pylist([{"node": node, **f} for f in found], schema=names)

    kinds = "node long, held boolean, y int, bins binary"
    routed = rows.mapInArrow(route(False), kinds)
    if held is not None:
        routed = routed.union(held.mapInArrow(route(True), kinds))
    schema = "node long, " + schema
    names = to_arrow_schema(T._parse_datatype_string(schema))
    # few bytes may be much work: the number of tasks follows the nodes
    tasks = min(len(local), 8 * rows.sparkSession.sparkContext.defaultParallelism)
    return routed.repartition(tasks, "node").groupBy("node").applyInArrow(grow, schema)


def fit_trees(df: DataFrame, specs: list[TreeSpec], label: str = "label", features: str = "features",
              fold: str | None = None, max_bins: int = 64) -> list[Tree]:
    """All trees together. ``min_split``, ``min_leaf`` and unlimited depth hold exactly."""
    if max_bins > 256:
        raise ValueError("at most 256 bins fit into a byte")
    cuts = bin_cuts(df, features, max_bins)
    width, bins = len(cuts), max(len(c) for c in cuts) + 1
    rows, _, partitions = hold(_binned(df, cuts, label, features, fold), rows_per_core=10_000)

    def use(depth, grown):
        nodes: dict[int, list[tuple]] = {}
        for t, place, _, counts, split, _ in grown:
            nodes.setdefault(t, []).append((place, *counts, *(split or (0, 0, place, place))))
        for t, found in nodes.items():
            yield {"tree": t, **{c: list(v) for c, v in zip(("n0", "n1", "feature", "cut", "left", "right"), list(zip(*sorted(found)))[1:])}}

    try:
        growth = _grow(rows, specs, partitions, width, bins)
        lower: dict[tuple[int, int], dict] = {}
        if growth.local:
            found = _in_tasks(growth, specs, rows, None, width, bins, use,
                              "tree int, n0 array<double>, n1 array<double>, feature array<int>, cut array<int>, "
                              "left array<int>, right array<int>")
            for batch in found.toArrow().to_batches():
                for r in batch.to_pylist():
                    lower[r["tree"], r["node"]] = r
        return [_compact(growth, t, s, cuts, lower)[0] for t, s in enumerate(specs)]
    finally:
        rows.unpersist()


def grid_recalls(train: DataFrame, valid: DataFrame, specs: list[TreeSpec], depths: list[int | None], label: str = "label",
                 features: str = "features", fold: str | None = None, max_bins: int = 64) -> list[dict[int | None, float]]:
    """``recalls`` on ``valid`` of the trees of ``train``, scored where their nodes are grown."""
    cuts = bin_cuts(train, features, max_bins)
    width, bins = len(cuts), max(len(c) for c in cuts) + 1
    rows, _, partitions = hold(_binned(train, cuts, label, features, fold), rows_per_core=10_000)
    places = range(len(depths))

    def use(base, grown):
        hits: dict[int, list[float]] = {}
        for t, _, depth, (n0, n1), split, held in grown:
            mine = hits.setdefault(t, [0.0] * (len(depths) + 1))
            if n1 > n0 and held:
                for k in places:
                    d = depths[k]
                    if (d is None and split is None) or (d is not None and d > base and (d == depth or split is None and d > depth)):
                        mine[k] += held
        return ({"at": t, "values": v} for t, v in hits.items())

    try:
        growth = _grow(rows, specs, partitions, width, bins)
        top = [_compact(growth, t, s, cuts, None) for t, s in enumerate(specs)]
        sums = _hits(valid, [t for t, _ in top], depths, label, features, fold, [p for _, p in top])
        if growth.local:
            held = _binned(valid.where(F.col(label) == 1), cuts, label, features, fold)
            found = _in_tasks(growth, specs, rows, held, width, bins, use, "at int, values array<double>").drop("node")
            sums = sums + sum_rows(found, len(growth.local), len(specs), len(depths) + 1)
        return _shares(sums, depths)
    finally:
        rows.unpersist()


def _compact(growth: _Growth, t: int, spec: TreeSpec, cuts: list[list[float]], lower: dict | None) -> tuple[Tree, dict[int, int]]:
    """The tree, and the depth of those of its nodes that go on in a task if ``lower`` has none of it."""
    order, place = [growth.roots[t]], {growth.roots[t]: 0}
    for i in order:
        for c in growth.splits[t].get(i, ())[2:]:
            place[c] = len(order)
            order.append(c)
    mine = [i for i in order if i in growth.local and t in growth.local[i][1]]
    ends = {place[i]: growth.local[i][0] for i in mine}
    size = len(order) + sum(len(lower[t, i]["left"]) - 1 for i in mine) if lower is not None else len(order)
    feature, threshold, counts = np.zeros(size, np.int64), np.zeros(size), np.zeros((size, 2))
    left, right = np.arange(size), np.arange(size)
    for i in order:
        counts[place[i]] = growth.nodes[i].counts
        if i in growth.splits[t]:
            f, cut, lo, hi = growth.splits[t][i]
            at = place[i]
            feature[at], threshold[at] = f, cuts[f][cut]
            left[at], right[at] = place[lo], place[hi]
    start = len(order)
    for i in mine if lower is not None else ():
        part = lower[t, i]
        # place 0 is the node itself, the others follow each other
        to = np.concatenate(([place[i]], np.arange(start, start + len(part["left"]) - 1)))
        start += len(to) - 1
        feature[to], left[to], right[to] = part["feature"], to[part["left"]], to[part["right"]]
        threshold[to] = [cuts[f][c] if l != k else 0.0 for k, (f, c, l) in enumerate(zip(part["feature"], part["cut"], part["left"]))]
        counts[to] = np.column_stack([part["n0"], part["n1"]])
    return Tree(spec, feature, threshold, left, right, counts), ends


def predict(df: DataFrame, tree: Tree, features: str = "features") -> DataFrame:
    """Adds ``y_pred`` and ``score`` (share of class 1 in the leaf). Map-only."""
    @F.arrow_udf("double")
    def share(v: pa.Array) -> pa.Array:
        return pa.array(tree.probability(matrix(v)))

    out = df.withColumn("score", share(F.col(features).cast("array<double>")))
    return out.withColumn("y_pred", (F.col("score") > 0.5).cast("int"))


def recalls(df: DataFrame, trees: list[Tree], depths: list[int | None], label: str = "label",
            features: str = "features", fold: str | None = None) -> list[dict[int | None, float]]:
    """Per tree: recall on its left-out fold when cut at each depth; one pass for all of them."""
    return _shares(_hits(df, trees, depths, label, features, fold, [{}] * len(trees)), depths)


def _shares(sums: np.ndarray, depths: list[int | None]) -> list[dict[int | None, float]]:
    return [{d: float(row[j] / row[-1]) if row[-1] else 0.0 for j, d in enumerate(depths)} for row in sums]


def _hits(df: DataFrame, trees: list[Tree], depths: list[int | None], label: str, features: str, fold: str | None,
          ends: list[dict[int, int]]) -> np.ndarray:
    """Per tree: positives found at each depth, then all. Below the nodes of ``ends`` (place -> depth) nothing counts."""
    rows = df.where(F.col(label) == 1).select(
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
        F.col(features).cast("array<double>").alias("x"))

    def hits(batches):
        acc = np.zeros((len(trees), len(depths) + 1))
        for b in batches:
            if b.num_rows == 0:
                continue
            x, at_fold = matrix(b.column("x")), b.column("fold").to_numpy(zero_copy_only=False)
            for i, tree in enumerate(trees):
                part = x if tree.spec.fold is None else x[at_fold == tree.spec.fold]
                if not len(part):
                    continue
                positive = tree.counts[:, 1] > tree.counts[:, 0]
                steps = list(tree.levels(part))
                for j, d in enumerate(depths):
                    counted = positive.copy()
                    counted[[k for k, at in ends[i].items() if d is None or d > at]] = False
                    acc[i, j] += int(counted[steps[-1 if d is None else min(d, len(steps) - 1)]].sum())
                acc[i, -1] += len(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(trees), dtype=np.int32)), list_column(acc)], names=["at", "values"])

    return sum_rows(rows.mapInArrow(hits, "at int, values array<double>"), rows.rdd.getNumPartitions(), len(trees), len(depths) + 1)


def paths(spark, tree: Tree) -> DataFrame:
    """path, feature, threshold, n0, n1 per node: ``path`` has an L or R a step from the root; leaves have no feature."""
    rows, todo = [], [(0, "")]
    while todo:
        i, path = todo.pop()
        inner = tree.left[i] != i
        rows.append((path, int(tree.feature[i]) if inner else None, float(tree.threshold[i]) if inner else None,
                     int(tree.counts[i, 0]), int(tree.counts[i, 1])))
        todo += [(int(tree.left[i]), path + "L"), (int(tree.right[i]), path + "R")] if inner else []
    return local_frame(spark, rows, "path string, feature int, threshold double, n0 long, n1 long")


def to_frame(spark, tree: Tree) -> DataFrame:
    """The nodes of a tree as a table: what a fitted tree is stored as."""
    return local_frame(
        spark, [(i, int(tree.feature[i]), float(tree.threshold[i]), int(tree.left[i]), int(tree.right[i]),
                 float(tree.counts[i, 0]), float(tree.counts[i, 1])) for i in range(len(tree.left))],
        "node int, feature int, threshold double, left int, right int, n0 double, n1 double")


def from_frame(df: DataFrame) -> Tree:
    rows = sorted(bounded_rows(df, 10_000_000), key=lambda r: r["node"])
    col = lambda c, kind: np.array([r[c] for r in rows], kind)
    return Tree(TreeSpec(), col("feature", np.int64), col("threshold", float), col("left", np.int64),
                col("right", np.int64), np.column_stack([col("n0", float), col("n1", float)]))
