"""Support-vector machines: many models trained in shared passes over one table.

All models of a grid (kernel width, cost, fold) are columns of one weight matrix; a pass
evaluates every loss and gradient, and a small quasi-Newton step per model runs on
weight-sized vectors. The hinge is smoothed over a short interval so that steps are
well defined. The RBF kernel is approximated by random Fourier features (Rahimi and
Recht, 2007); Spark has no kernel solver, and an exact one needs all pairs of rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.kernels import list_column, matrix
from evenkeel.operators.passes import hold, sum_rows
from evenkeel.operators.scale import moments
from evenkeel.operators.small import bounded_rows, local_frame

#: Width of the smoothed part of the hinge.
SMOOTHING = 0.02
#: Most rows whose feature maps a task holds at once.
MAP_ROWS = 1024


def gamma_value(spec: str | float, width: int, variance: float) -> float:
    """Kernel width: a number, ``auto`` = 1/p, or ``scale`` = 1/(p * variance of all entries)."""
    if spec == "auto":
        return 1.0 / width
    if spec == "scale":
        return 1.0 / (width * variance) if variance > 0 else 1.0
    return float(spec)


def entry_variance(df: DataFrame, features: str = "features") -> tuple[int, float]:
    """Row width, and the variance of all matrix entries taken together."""
    row = moments(df, [], features).first()
    mean, var = np.asarray(row["mean"]), np.asarray(row["var"])
    return len(mean), float(np.mean(var + mean**2) - np.mean(mean) ** 2)


def _unit(text: str) -> float:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2.0**32


def fourier_draws(size: int, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Standard normal directions (size x width) and phases, hashed from their positions."""
    u = np.array([[[max(_unit(f"{seed}|rff|{j}|{i}|{s}"), 2.0**-33) for s in (1, 2)] for i in range(width)]
                  for j in range(size)])
    g = np.sqrt(-2.0 * np.log(u[:, :, 0])) * np.cos(2 * np.pi * u[:, :, 1])
    b = np.array([2 * np.pi * _unit(f"{seed}|rff|{j}|b") for j in range(size)])
    return g, b


def fourier_features(x: np.ndarray, gamma: float, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(b)) * np.cos(np.sqrt(2.0 * gamma) * (x @ g.T) + b)


def rff_map(df: DataFrame, gamma: float, size: int = 256, seed: int = 42, features: str = "features",
            name: str = "mapped", width: int | None = None) -> DataFrame:
    """Adds the random Fourier features of every row; map-only."""
    g, b = fourier_draws(size, width or df.select(F.size(features)).first()[0], seed)

    @F.arrow_udf("array<double>")
    def mapped(v: pa.Array) -> pa.Array:
        return list_column(fourier_features(matrix(v), gamma, g, b))

    return df.withColumn(name, mapped(F.col(features).cast("array<double>")))


@dataclass(frozen=True)
class Spec:
    """One model: cost, kernel, and the fold left out of its training rows (None: all rows)."""

    cost: float
    gamma: float | None = None  # None: linear
    fold: int | None = None


@dataclass
class SvmModel:
    spec: Spec
    weights: np.ndarray
    intercept: float
    size: int = 0
    seed: int = 42

    def decision(self, x: np.ndarray) -> np.ndarray:
        if self.spec.gamma is not None:
            x = fourier_features(x, self.spec.gamma, *fourier_draws(self.size, x.shape[1], self.seed))
        return x @ self.weights + self.intercept


def to_frame(spark, models: list[SvmModel]) -> DataFrame:
    """Coefficients as a table: what a fitted model is stored as."""
    return local_frame(
        spark, [(float(m.spec.cost), m.spec.gamma, m.size, m.seed, m.weights.tolist(), float(m.intercept))
                for m in models],
        "cost double, gamma double, size int, seed int, weights array<double>, intercept double")


def from_frame(df: DataFrame) -> list[SvmModel]:
    return [SvmModel(Spec(r["cost"], r["gamma"]), np.asarray(r["weights"]), r["intercept"], r["size"], r["seed"])
            for r in bounded_rows(df)]


class _Pass:
    """Evaluates a set of linear models over all rows, grouped by feature map."""

    def __init__(self, width: int, size: int, seed: int):
        self.size, self.width = size, width
        self.g, self.b = fourier_draws(size, width, seed)

    def blocks(self, x: np.ndarray, specs: list[Spec]):
        """(positions of the models, their mapped rows) per distinct feature map; one map is held at a time."""
        by_map: dict[float | None, list[int]] = {}
        for i, s in enumerate(specs):
            by_map.setdefault(s.gamma, []).append(i)
        projected = None
        for gamma, at in by_map.items():
            if gamma is None:
                yield at, x
                continue
            projected = x @ self.g.T if projected is None else projected
            yield at, np.sqrt(2.0 / self.size) * np.cos(np.sqrt(2.0 * gamma) * projected + self.b)


def _pieces(batches):
    """Batches of at most MAP_ROWS rows: what a task holds does not follow the size of Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, MAP_ROWS):
            yield batch.slice(at, MAP_ROWS)


def _losses(run: _Pass, specs: list[Spec], weights: list[np.ndarray], wide: int,
            x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Per model: row count, loss sum, then the gradient sum (padded to one width)."""
    acc = np.zeros((len(specs), wide))
    for at, z in run.blocks(x, specs):
        w = np.stack([weights[i][:-1] for i in at], axis=1)
        c = np.array([weights[i][-1] for i in at])
        use = np.stack([np.ones(len(y)) if specs[i].fold is None else (fold != specs[i].fold) * 1.0
                        for i in at], axis=1)
        gap = 1.0 - y[:, None] * (z @ w + c)
        soft = (gap > 0) & (gap < SMOOTHING)
        loss = np.where(soft, gap**2 / (2 * SMOOTHING), np.maximum(gap - SMOOTHING / 2, 0.0) * (gap > 0))
        slope = -np.where(soft, gap / SMOOTHING, (gap > 0) * 1.0) * use * y[:, None]
        acc[at, 0] += use.sum(0)
        acc[at, 1] += (loss * use).sum(0)
        acc[at, 2:2 + z.shape[1]] += slope.T @ z
        acc[at, 2 + z.shape[1]] += slope.sum(0)
    return acc


def _evaluate(rows: DataFrame, run: _Pass, specs: list[Spec], weights: list[np.ndarray], partitions: int) -> np.ndarray:
    wide = 3 + max(len(w) for w in weights)

    def losses(batches):
        acc = np.zeros((len(specs), wide))
        for batch in _pieces(batches):
            acc += _losses(run, specs, weights, wide, matrix(batch.column("x")),
                           batch.column("y").to_numpy(zero_copy_only=False),
                           batch.column("fold").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(specs), dtype=np.int32)), list_column(acc)], names=["at", "values"])

    return sum_rows(rows.mapInArrow(losses, "at int, values array<double>"), partitions, len(specs), wide)


@dataclass
class _State:
    x: np.ndarray
    f: float = np.inf
    g: np.ndarray | None = None
    step: np.ndarray | None = None
    t: float = 1.0
    past: list = None
    done: bool = False
    tries: int = 0

    def trial(self) -> np.ndarray:
        return self.x if self.step is None else self.x + self.t * self.step

    def take(self, f: float, g: np.ndarray, tol: float) -> None:
        """Accepts or shortens the step (sufficient decrease), then sets the next one."""
        if self.step is not None and not f <= self.f + 1e-4 * self.t * float(self.step @ self.g):
            self.t *= 0.5
            self.tries += 1
            self.done = self.tries > 10
            return
        new = self.trial()
        if self.step is not None:
            s, y = new - self.x, g - self.g
            if s @ y > 1e-12:
                self.past = [*self.past[-9:], (s, y)]
            self.done = abs(self.f - f) <= tol * max(abs(f), 1e-12)
        self.x, self.f, self.g = new, f, g
        self.done = self.done or float(np.abs(g).max()) <= tol
        q, marks = g.copy(), []
        for s, y in reversed(self.past):
            a = (s @ q) / (s @ y)
            marks.append(a)
            q -= a * y
        if self.past:
            s, y = self.past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(self.past, reversed(marks)):
            q += (a - (y @ q) / (s @ y)) * s
        self.step, self.t, self.tries = -q, 1.0, 0


def _descend(specs: list[Spec], states: list[_State], evaluate, passes: int, tol: float) -> None:
    """Steps all models that still move; one evaluation serves all of them."""
    for _ in range(passes):
        live = [i for i, s in enumerate(states) if not s.done]
        if not live:
            return
        points = [states[i].trial() for i in live]
        sums = evaluate([specs[i] for i in live], points)
        for k, i in enumerate(live):
            n = max(sums[k, 0], 1.0)
            lam = 1.0 / (specs[i].cost * n)
            w = points[k].copy()
            w[-1] = 0.0
            g = sums[k, 2:2 + len(w)] / n + lam * w
            states[i].take(sums[k, 1] / n + 0.5 * lam * float(w @ w), g, tol)


def fit_svms(df: DataFrame, specs: list[Spec], label: str = "label", features: str = "features",
             fold: str | None = None, size: int = 256, max_passes: int = 30, tol: float = 1e-3,
             seed: int = 42) -> list[SvmModel]:
    """All models at once: minimises |w|^2 / (2 C n) + mean hinge, the intercept left free.

    Every step reads all rows, at every size of the table.
    """
    rows, _, partitions = hold(_training_rows(df, label, features, fold))
    try:
        width = rows.select(F.size("x")).first()[0]
        run = _Pass(width, size, seed)
        states = [_State(np.zeros((width if s.gamma is None else size) + 1), past=[]) for s in specs]
        _descend(specs, states, lambda live, points: _evaluate(rows, run, live, points, partitions),
                 max_passes, tol)
        return [SvmModel(s, st.x[:-1], float(st.x[-1]), 0 if s.gamma is None else size, seed)
                for s, st in zip(specs, states)]
    finally:
        rows.unpersist()


def _training_rows(df: DataFrame, label: str, features: str, fold: str | None) -> DataFrame:
    """y in {-1, 1}, x and fold."""
    return df.select((2 * F.col(label).cast("double") - 1).alias("y"), F.col(features).cast("array<double>").alias("x"),
                     (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))


def predict(df: DataFrame, model: SvmModel, features: str = "features") -> DataFrame:
    """Adds ``y_pred`` and ``score`` (decision value). Map-only."""
    @F.arrow_udf("double")
    def decision(v: pa.Array) -> pa.Array:
        return pa.array(model.decision(matrix(v)))

    out = df.withColumn("score", decision(F.col(features).cast("array<double>")))
    return out.withColumn("y_pred", (F.col("score") > 0).cast("int"))


def recalls(df: DataFrame, models: list[SvmModel], label: str = "label", features: str = "features",
            fold: str | None = None, size: int = 256, seed: int = 42) -> list[float]:
    """Recall of every model on its left-out fold (all rows if it has none), in one pass."""
    rows = _training_rows(df.where(F.col(label) == 1), label, features, fold)
    specs = [m.spec for m in models]
    width = next((len(m.weights) for m in models if m.spec.gamma is None), None)
    width = width or df.select(F.size(features)).first()[0]
    run = _Pass(width, size, seed)

    def hits(batches):
        acc = np.zeros((len(models), 2))
        for batch in _pieces(batches):
            x, at_fold = matrix(batch.column("x")), batch.column("fold").to_numpy(zero_copy_only=False)
            for at, z in run.blocks(x, specs):
                score = z @ np.stack([models[i].weights for i in at], axis=1) + [models[i].intercept for i in at]
                use = np.stack([np.ones(len(x), bool) if specs[i].fold is None else at_fold == specs[i].fold
                                for i in at], axis=1)
                acc[at, 0] += ((score > 0) & use).sum(0)
                acc[at, 1] += use.sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(models), dtype=np.int32)), list_column(acc)], names=["at", "values"])

    sums = sum_rows(rows.mapInArrow(hits, "at int, values array<double>"), rows.rdd.getNumPartitions(), len(models), 2)
    return [float(a / b) if b else 0.0 for a, b in sums]
