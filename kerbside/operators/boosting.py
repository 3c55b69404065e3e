"""Boosted regression trees for three losses, stopped on validation rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from kerbside.scratch import cut_lineage

POWER = 1.55  # of the Tweedie variance
KEPT = 8  # trees applied to the rows before their sums are written anew
EXACT = 10_000  # distinct values of an input that are all told apart
FINE = 512  # ranges of an input with more of them
JOINED = 1_000_000  # rows that are fitted as they are; of more, those alike are joined


def _squared(y: Column, m: Column) -> tuple[Column, Column, Column]:
    return (m - y) * (m - y) / 2, m - y, F.lit(1.0)


def _logistic(y: Column, m: Column) -> tuple[Column, Column, Column]:
    p = 1 / (1 + F.exp(-m))
    return F.log1p(F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - y * m, p - y, F.greatest(p * (1 - p), F.lit(1e-9))


def _tweedie(y: Column, m: Column) -> tuple[Column, Column, Column]:
    low, high = F.exp((1 - POWER) * m), F.exp((2 - POWER) * m)
    return y * low / (POWER - 1) + high / (2 - POWER), high - y * low, (2 - POWER) * high + (POWER - 1) * y * low


# loss, first and second derivative of a label and its score
LOSSES = {"squared": _squared, "logistic": _logistic, "tweedie": _tweedie}
# score of a constant label, and label of a score
LINKS = {
    "squared": (lambda y: y, lambda m: m),
    "logistic": (lambda y: F.log(y / (1 - y)), lambda m: 1 / (1 + F.exp(-m))),
    "tweedie": (F.log, F.exp),
}


@dataclass
class Boosted:
    """Fitted trees; transform adds their prediction."""

    features: list[str]
    loss: str
    rate: float
    base: float
    trees: list = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # of the validation rows, after no tree, one, two, ...

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Rows with a prediction of the label's scale; those with a missing input are left out, as in the other models."""
        scored = _score(assembled(df, self.features), self.trees, F.lit(self.base), self.rate)
        return scored.select(*df.columns, LINKS[self.loss][1](F.col("_score")).alias(output))


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(df)


def _places(rows: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Values of each input that stand for those next to them: all where they are few, else quantiles."""
    number = lambda c: F.col(c).cast("double")
    several = rows.agg(*[F.approx_count_distinct(number(c), 0.02).alias(c) for c in features]).first()
    few = [c for c in features if several[c] <= EXACT]
    ranks = [i / FINE for i in range(FINE + 1)]
    found = rows.agg(*[F.collect_set(number(c)).alias(c) if c in few else F.percentile_approx(number(c), ranks, EXACT).alias(c) for c in features]).first()
    return {c: sorted(set(found[c] or [])) for c in features}


def _to_places(rows: DataFrame, places: dict[str, list[float]]) -> DataFrame:
    """Every input becomes the value that stands for it; the limits lie half-way, where a tree's cuts between two values lie."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = {c: np.array(v) for c, v in places.items()}
        limits = {c: (v[:-1] + v[1:]) / 2 for c, v in kept.items()}
        for batch in batches:
            yield batch.assign(**{c: v[np.searchsorted(limits[c], batch[c])] for c, v in kept.items()})

    plain = rows.select(*[F.col(c).cast("double").alias(c) if c in places else c for c in rows.columns])
    return plain.mapInPandas(nearest, plain.schema)


def cells(rows: DataFrame, features: Sequence[str], label: str, validation: str, by_label: bool = False) -> DataFrame:
    """Rows with a label and all inputs, those alike in one: (inputs, _held, _n, _y, _within), written to the shared folder.

    A tree's cuts lie between few ranges of an input, so rows whose inputs fall into the same fine ranges are one for it: how
    many they are (_n), the mean of their labels (_y) and the sum of squares around it (_within) say all that a loss
    linear or square in the label needs. Their number follows the ranges, not the rows, where the inputs are few; it never exceeds that of the
    rows. At most JOINED rows stay as they are, and the values of an input with at most EXACT of them are all told apart. The ranges are those of the rows that are fitted. With
    ``by_label`` only rows of equal labels are joined.
    """
    labelled = rows.where(F.col(label).isNotNull()).na.drop(subset=list(features))
    narrow = cut_lineage(labelled.select(*features, F.col(label).cast("double").alias("_y"), F.coalesce(F.col(validation), F.lit(False)).alias("_held")))
    if narrow.count() <= JOINED:
        return narrow.select(*features, "_held", F.lit(1.0).alias("_n"), "_y", F.lit(0.0).alias("_within"))
    places = _places(narrow.where(~F.col("_held")), features)
    if not all(places.values()):
        raise ValueError("no rows to fit")
    key = [*features, "_held", *(["_y"] if by_label else [])]
    many = F.count("*").cast("double").alias("_n")
    alike = _to_places(narrow, places).groupBy(*key)
    if by_label:
        return cut_lineage(alike.agg(many).select(*features, "_held", "_n", "_y", F.lit(0.0).alias("_within")))
    return cut_lineage(alike.agg(many, F.avg("_y").alias("_y"), (F.var_pop("_y") * F.count("*")).alias("_within")))


def _score(rows: DataFrame, trees: Sequence, start: Column, rate: float) -> DataFrame:
    """Adds _score: the start and the trees' answers."""
    kept, total = [c for c in rows.columns if c != "_score"], start
    for i, tree in enumerate(trees):
        rows = tree.copy().setPredictionCol(f"_tree{i}").transform(rows)
        total = total + rate * F.col(f"_tree{i}")
    return rows.select(*kept, total.alias("_score"))


def boost(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    validation: str,
    loss: str = "squared",
    rounds: int = 60,
    patience: int = 5,
    rate: float = 0.1,
    depth: int = 4,
    bins: int = 64,
    min_rows: int = 20,
    seed: int = 42,
) -> Boosted:
    """Newton boosting: every round fits a tree to the loss's slope over its curvature, weighted by the curvature.

    Rows whose column ``validation`` is true fit nothing; the trees up to the round with their least loss are kept, and
    rounds end when ``patience`` of them have brought no less. A weighted regression tree over binned features maximises the
    gain of the second-order loss and its leaves hold the Newton steps, so any loss with two derivatives is fitted by the same tree
    learner, whose histograms are aggregated by Spark. Rows alike are one with a weight (``cells``), which takes part in as many
    copies as the least leaf needs rows, sharing that weight: so a leaf has ``min_rows`` copies where it has as many rows.
    They are read from the shared folder; their scores are written anew every few rounds. Rows without a label, or with a missing input, are left out.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss}")
    copies = F.when(F.col("_held"), 1).otherwise(F.least(F.col("_n"), F.lit(max(min_rows, 1))))
    alike = cells(rows, features, label, validation).withColumn("_copies", copies.cast("int"))
    shared = alike.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    shares = [(F.col(c) / F.col("_copies")).alias(c) for c in ("_n", "_within")]
    narrow = cut_lineage(assembled(shared, features).select("_features", "_y", "_held", *shares))
    start = LINKS[loss][0](F.sum(F.col("_n") * F.col("_y")) / F.sum("_n")).alias("base")
    base = narrow.where(~F.col("_held")).agg(start).first()["base"]
    if base is None:
        raise ValueError("no rows to fit")
    model = Boosted(list(features), loss, rate, float(base))
    state, pending = narrow.withColumn("_score", F.lit(model.base)), []
    value, slope, curve = LOSSES[loss](F.col("_y"), F.col("_score"))

    def held_loss(scored: DataFrame) -> float:
        spread = F.col("_within") / 2 if loss == "squared" else F.lit(0.0)  # the other losses are linear in the label
        found = scored.where("_held").agg(F.sum(F.col("_n") * value + spread) / F.sum("_n")).first()[0]
        return float("inf") if found is None else float(found)

    model.losses.append(held_loss(state))
    learner = DecisionTreeRegressor(
        featuresCol="_features", labelCol="_step", weightCol="_curve", maxDepth=depth, maxBins=bins, minInstancesPerNode=min_rows, seed=seed
    )
    for _ in range(rounds):
        scored = _score(state, pending, F.col("_score"), rate)
        fitted = scored.where(~F.col("_held")).select("_features", (-slope / curve).alias("_step"), (F.col("_n") * curve).alias("_curve"))
        tree = learner.fit(fitted)
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == KEPT:
            state, pending = cut_lineage(_score(state, pending, F.col("_score"), rate)), []
        model.losses.append(held_loss(_score(state, pending, F.col("_score"), rate)))
        best = model.losses.index(min(model.losses))
        if tree.depth == 0 or len(model.losses) - 1 - best >= patience:
            break
    if model.losses[0] < float("inf"):  # without validation rows all trees stay
        model.trees = model.trees[: model.losses.index(min(model.losses))]
    return model


def _ensemble(learner, rows: DataFrame, features: Sequence[str], label: str, validation: str):
    """Fits Spark's own boosted trees, stopped where the validation rows no longer gain."""
    narrow = assembled(rows.where(F.col(label).isNotNull()), features)
    narrow = cut_lineage(narrow.select("_features", F.col(label).cast("double").alias("_y"), F.coalesce(F.col(validation), F.lit(False)).alias("_held")))
    return learner.setFeaturesCol("_features").setLabelCol("_y").setValidationIndicatorCol("_held").fit(narrow)


def boosted_gate(rows: DataFrame, features: Sequence[str], label: str, validation: str, rounds: int = 40, depth: int = 4, bins: int = 64, seed: int = 42):
    """Classifier of a 0/1 label by log loss; needs training and validation rows. Rows alike are one with a weight."""
    learner = GBTClassifier(predictionCol="_class", maxIter=rounds, stepSize=0.1, maxDepth=depth, maxBins=bins, seed=seed)
    learner = learner.setRawPredictionCol("_raw").setProbabilityCol("_probability").setWeightCol("_n")
    alike = cells(rows, features, label, validation, by_label=True)
    return learner.setFeaturesCol("_features").setLabelCol("_y").setValidationIndicatorCol("_held").fit(assembled(alike, features))


def boosted_regression(rows: DataFrame, features: Sequence[str], label: str, validation: str, rounds: int = 40, depth: int = 5, bins: int = 64, seed: int = 42):
    """Regression by squared error; needs training and validation rows."""
    learner = GBTRegressor(predictionCol="prediction", maxIter=rounds, stepSize=0.1, maxDepth=depth, maxBins=bins, seed=seed)
    return _ensemble(learner, rows, features, label, validation)
