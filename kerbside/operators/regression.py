"""Regressions fitted from sums of products: mixtures, quantiles, rolling origins, vector targets."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbside.scratch import cut_lineage


def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least-norm solution of the normal equations; inputs that repeat each other share their weight."""
    scale = np.sqrt(np.maximum(np.diag(matrix), 0.0))
    scale[scale == 0] = 1.0
    found = np.linalg.lstsq(matrix / np.outer(scale, scale), (right.T / scale).T, rcond=1e-12)[0]
    return (found.T / scale).T


def dot(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of columns times numbers, in one order."""
    total = F.lit(0.0)
    for c, w in zip(columns, weights):
        total = total + c * F.lit(float(w))
    return total


def _products(columns: Sequence[Column], weight: Column | None = None) -> list[Column]:
    """Sums of the products of all pairs of columns, the upper triangle row by row."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return [F.sum(a * b if weight is None else weight * a * b) for a, b in pairs]


def _square(flat: Sequence[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


@dataclass
class Scaled:
    """Inputs brought to mean 0 and deviation 1, with a leading 1."""

    features: list[str]
    means: list[float]
    spreads: list[float]

    @classmethod
    def of(cls, rows: DataFrame, features: Sequence[str]) -> Scaled:
        found = rows.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop)]).first()
        if found[0] is None:
            raise ValueError("no rows to fit")
        return cls(list(features), [float(m) for m in found[::2]], [float(s) or 1.0 for s in found[1::2]])

    def columns(self) -> list[Column]:
        return [F.lit(1.0), *[(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.features, self.means, self.spreads)]]


def _complete(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return cut_lineage(rows.select(*dict.fromkeys([*features, label])).dropna())


# --- mixtures of regressions ---------------------------------------------------------------


@dataclass
class Mixture:
    """Normal regressions with shares; the label's density is the sum of theirs."""

    inputs: Scaled
    label: str
    shares: list[float]
    weights: list[list[float]]
    spreads: list[float]
    likelihoods: list[float] = field(default_factory=list)  # mean log likelihood before every round

    def _logs(self) -> list[Column]:
        """Log of share times density, one for each component."""
        z, y = self.inputs.columns(), F.col(self.label).cast("double")
        out = []
        for share, weights, spread in zip(self.shares, self.weights, self.spreads):
            off = (y - dot(z, weights)) / spread
            out.append(F.lit(math.log(share) - math.log(spread) - math.log(2 * math.pi) / 2) - off * off / 2)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds pred_mean and pred_std; with the label also log_density and the likeliest component (0 is the first)."""
        z = self.inputs.columns()
        means = [dot(z, w) for w in self.weights]
        mean = dot(means, self.shares)
        second = dot([m * m + s * s for m, s in zip(means, self.spreads)], self.shares)
        out = {"pred_mean": mean, "pred_std": F.sqrt(F.greatest(second - mean * mean, F.lit(0.0)))}
        if self.label in df.columns:
            logs = self._logs()
            top = F.greatest(*logs) if len(logs) > 1 else logs[0]
            total = dot([F.exp(x - top) for x in logs], [1.0] * len(logs))
            out |= {"log_density": top + F.log(total), "component": (F.array_position(F.array(*logs), top) - 1).cast("int")}
        return df.withColumns(out)


def mixture_regression(rows: DataFrame, features: Sequence[str], label: str, k: int = 3, rounds: int = 40, tolerance: float = 1e-5) -> Mixture:
    """Density of the label given the inputs, as a mixture of k regressions, by expectation maximisation.

    A round is one aggregate: every row's shares in the components are expressions, and their weighted sums of products
    are the components' normal equations, solved at the driver. The likelihood never falls; rounds end when it
    rises by less than ``tolerance``. Components begin as the one regression moved up and down by its deviation, so a
    fit can be repeated. Rows with a missing input or label are left out.
    """
    known = _complete(rows, features, label)
    inputs = Scaled.of(known, features)
    z = [*inputs.columns(), F.col(label).cast("double")]
    size = len(z)
    whole = known.agg(F.count("*"), *_products(z)).first()
    moments = _square(whole[1:], size)
    line = solve(moments[:-1, :-1], moments[:-1, -1])
    spread = math.sqrt(max(moments[-1, -1] - line @ moments[:-1, -1], 0.0) / whole[0]) or 1e-9
    shifts = [NormalDist().inv_cdf((i + 0.5) / k) for i in range(k)]
    weights = [[float(line[0] + spread * s), *map(float, line[1:])] for s in shifts]
    model = Mixture(inputs, label, [1 / k] * k, weights, [spread] * k)
    least = 1e-3 * spread
    for _ in range(rounds):
        logs = model._logs()
        top = F.greatest(*logs) if k > 1 else logs[0]
        staged = known.withColumns({f"_l{j}": x for j, x in enumerate(logs)} | {"_top": top})
        staged = staged.withColumn("_sum", dot([F.exp(F.col(f"_l{j}") - F.col("_top")) for j in range(k)], [1.0] * k))
        parts = staged.withColumns({f"_r{j}": F.exp(F.col(f"_l{j}") - F.col("_top")) / F.col("_sum") for j in range(k)})
        sums = parts.agg(F.avg(F.col("_top") + F.log("_sum")), *[p for j in range(k) for p in _products(z, F.col(f"_r{j}"))]).first()
        model.likelihoods.append(float(sums[0]))
        if len(model.likelihoods) > 1 and model.likelihoods[-1] - model.likelihoods[-2] < tolerance:
            break
        each = len(_products(z))
        for j in range(k):
            m = _square(sums[1 + j * each : 1 + (j + 1) * each], size)
            if m[0, 0] < 1e-9 * whole[0]:
                continue  # a component without rows stays as it is
            w = solve(m[:-1, :-1], m[:-1, -1])
            rest = m[-1, -1] - 2 * w @ m[:-1, -1] + w @ m[:-1, :-1] @ w
            model.weights[j], model.spreads[j] = w.tolist(), max(math.sqrt(max(rest, 0.0) / m[0, 0]), least)
            model.shares[j] = float(m[0, 0] / whole[0])
    return model


# --- quantile regression ----------------------------------------------------------------------


# Steps go beyond the parabola's lowest point; up to twice as far they don't rise above where they began.
STRETCH = 1.8


@dataclass
class Quantiles:
    inputs: Scaled
    levels: dict[str, float]
    weights: list[list[float]]
    losses: list[float] = field(default_factory=list)  # mean pinball loss over the levels before every round

    def transform(self, df: DataFrame, prefix: str = "pred_") -> DataFrame:
        """Adds a column for each level; crossing quantiles are put in order."""
        z = self.inputs.columns()
        found = F.array_sort(F.array(*[dot(z, w) for w in self.weights]))
        return df.withColumn("_q", found).select(*df.columns, *[F.col("_q")[i].alias(f"{prefix}{n}") for i, n in enumerate(self.levels)])


def quantile_regression(rows: DataFrame, features: Sequence[str], label: str, levels: dict[str, float], rounds: int = 60, tolerance: float = 2e-5) -> Quantiles:
    """Linear quantiles of the label: least mean pinball loss for every level (rising), found together.

    The loss is bounded from above by a parabola at every row, of weight 1 / (|residual| + e), so a round is one aggregate
    of weighted sums of products and one small system for each level, and the smoothed loss never rises. e falls from a tenth
    of the deviation to a thousandth. Rows with a missing input or label are left out.
    """
    known = _complete(rows, features, label)
    inputs = Scaled.of(known, features)
    z, y = inputs.columns(), F.col(label).cast("double")
    zy, size = [*z, y], len(z) + 1
    whole = known.agg(F.count("*"), *_products(zy)).first()
    moments = _square(whole[1:], size)
    line = solve(moments[:-1, :-1], moments[:-1, -1])
    spread = math.sqrt(max(moments[-1, -1] - line @ moments[:-1, -1], 0.0) / whole[0]) or 1e-9
    starts = [[float(line[0] + spread * NormalDist().inv_cdf(q)), *map(float, line[1:])] for q in levels.values()]
    model, e, ones = Quantiles(inputs, dict(levels), starts), spread / 10, moments[0, :-1]
    each = len(_products(zy))
    for _ in range(rounds):
        off = {f"_e{i}": y - dot(z, w) for i, w in enumerate(model.weights)}
        staged = known.withColumns(off)
        pinball = [F.avg(F.greatest(q * F.col(f"_e{i}"), (q - 1) * F.col(f"_e{i}"))) for i, q in enumerate(levels.values())]
        sums = staged.agg(*pinball, *[p for i in range(len(off)) for p in _products(zy, 1 / (F.abs(F.col(f"_e{i}")) + F.lit(e)))]).first()
        model.losses.append(sum(sums[: len(off)]) / len(off))
        done = len(model.losses) > 1 and abs(model.losses[-2] - model.losses[-1]) < tolerance * model.losses[-1]
        if done and e <= spread / 1000:
            break
        for i, q in enumerate(levels.values()):
            at = len(off) + i * each
            m = _square(sums[at : at + each], size)
            old = np.array(model.weights[i])
            step = solve(m[:-1, :-1], m[:-1, -1] + (2 * q - 1) * ones) - old
            model.weights[i] = (old + STRETCH * step).tolist()
        e = max(e / 2, spread / 1000) if done or len(model.losses) % 3 == 0 else e
    return model


# --- a model for every origin ------------------------------------------------------------------


def _solver(size: int):
    @F.pandas_udf("array<double>")
    def fit(flat: pd.Series) -> pd.Series:
        def one(sums):
            m = _square(sums, size)
            return solve(m[:-1, :-1], m[:-1, -1]).tolist()

        return flat.map(one)

    return fit


def rolling_origin(rows: DataFrame, features: Sequence[str], label: str, day: str = "day", history: int = 3) -> DataFrame:
    """(day, days, rows, weights): for every day the least squares fit on all earlier days; weights[0] is the constant's.

    Sums of products are aggregated once by day and then added up over days, so no history is read again. Days with fewer than
    ``history`` earlier days that have rows give no model. One row a day passes through one window.
    """
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(label).cast("double")]
    known = rows.dropna(subset=[*features, label, day])
    daily = known.groupBy(day).agg(F.array(*_products(z)).alias("_sums"))
    size = len(z) * (len(z) + 1) // 2
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    so_far = daily.select(day, F.count("*").over(before).alias("days"), F.array(*[F.sum(F.col("_sums")[i]).over(before) for i in range(size)]).alias("_all"))
    usable = so_far.where(F.col("days") >= history)
    return usable.select(day, "days", F.col("_all")[0].cast("bigint").alias("rows"), _solver(len(z))("_all").alias("weights"))


def backtest(rows: DataFrame, features: Sequence[str], label: str, day: str = "day", history: int = 3) -> DataFrame:
    """The rows of every day with the prediction of the model fitted on the days before."""
    models = rolling_origin(rows, features, label, day, history).select(day, "weights")
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        total = total + t * F.col("weights")[i]
    return rows.join(models, day).withColumn("prediction", total).drop("weights")


# --- vector targets --------------------------------------------------------------------------------


def vector_least_squares(rows: DataFrame, inputs: str, targets: str, ridge: float = 1e-6) -> np.ndarray:
    """Weights (one row for each target, the constant first) from one array column to another.

    Every task multiplies blocks of rows into one matrix of sums of products; a few tasks add up those of the others, and the
    driver solves. Rows with a missing entry are left out, as are those whose arrays are not as long as most; ``ridge`` times the
    mean square of the inputs keeps repeated inputs solvable.
    """
    x, y = F.col(inputs).cast("array<double>"), F.col(targets).cast("array<double>")
    whole = ~F.exists(x, lambda v: v.isNull()) & ~F.exists(y, lambda v: v.isNull())
    sent = rows.where(F.col(inputs).isNotNull() & F.col(targets).isNotNull() & whole).select(x.alias("x"), y.alias("y"))
    shape = sent.groupBy(F.size("x").alias("p"), F.size("y").alias("h")).count().orderBy(F.desc("count"), "p", "h").first()
    if shape is None:
        raise ValueError("no rows to fit")
    p, h = shape.p, shape.h
    size = 1 + p + h
    schema = "sums binary"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            a, b = (c.flatten().to_numpy().reshape(batch.num_rows, -1) for c in batch.columns)
            block = np.hstack([np.ones((batch.num_rows, 1)), a, b])
            total += block.T @ block
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = sent.where((F.size("x") == p) & (F.size("y") == h)).mapInArrow(multiply, schema)
    gram = sum(np.frombuffer(r.sums) for r in parts.repartition(8).mapInArrow(add, schema).collect()).reshape(size, size)
    left, right = gram[: 1 + p, : 1 + p].copy(), gram[: 1 + p, 1 + p :]
    left[range(1, 1 + p), range(1, 1 + p)] += ridge * np.trace(left[1:, 1:]) / max(p, 1)
    return solve(left, right).T


def vector_predictions(df: DataFrame, inputs: str, weights: np.ndarray, name: str = "predictions") -> DataFrame:
    """Adds the array of predictions from an array column, as one expression."""
    matrix = F.array(*[F.array(*map(F.lit, map(float, row))) for row in weights])
    x = F.concat(F.array(F.lit(1.0)), F.col(inputs).cast("array<double>"))
    product = F.transform(matrix, lambda row: F.aggregate(F.zip_with(x, row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return df.withColumn(name, product)
