"""Latency models over plan features: forests and boosted trees on log1p(latency), tail blends, calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-3
_IN, _LOG = "__features", "__log"


@dataclass
class Latency:
    """Parts of (model, feature positions or None for all, weight); predictions are averaged as latencies."""

    parts: list[tuple[object, list[int] | None, float]]
    calibration: object | None = None
    scale: float = 1.0

    def predict(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``predicted`` milliseconds."""
        out, terms, total = rows, [], sum(w for *_, w in self.parts)
        for k, (model, chosen, weight) in enumerate(self.parts):
            out = model.transform(out.withColumn(_IN, _vector(features, chosen))).withColumnRenamed("prediction", f"__p{k}").drop(_IN)
            terms.append(F.greatest(F.expm1(f"__p{k}"), F.lit(EPS)) * (weight / total))
        out = out.withColumn("predicted", sum(terms[1:], terms[0])).drop(*(f"__p{k}" for k in range(len(self.parts))))
        if self.calibration is not None:
            out = self.calibration.transform(out.withColumn(_LOG, F.log1p("predicted"))).withColumn("predicted", F.greatest(F.expm1("prediction"), F.lit(EPS))).drop(_LOG, "prediction")
        return out.withColumn("predicted", F.col("predicted") * self.scale) if self.scale != 1.0 else out


def _vector(features: str, chosen: list[int] | None) -> Column:
    return array_to_vector(F.array(*(F.col(features)[i] for i in chosen)) if chosen else F.col(features))


def _fit(estimator, rows: DataFrame, features: str, actual: str, chosen=None):
    data = rows.select(_vector(features, chosen).alias(_IN), F.log1p(actual).alias(_LOG))
    return estimator.setFeaturesCol(_IN).setLabelCol(_LOG).fit(data)


def forest(rows: DataFrame, features: str = "features", actual: str = "latency", trees: int = 100, depth: int = 8, seed: int = 0) -> Latency:
    return Latency([(_fit(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed), rows, features, actual), None, 1.0)])


def boosted(rows: DataFrame, features: str = "features", actual: str = "latency", rounds: int = 50, depth: int = 4, seed: int = 0) -> Latency:
    return Latency([(_fit(GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed), rows, features, actual), None, 1.0)])


def tree(rows: DataFrame, features: str = "features", actual: str = "latency", depth: int = 8, seed: int = 0) -> Latency:
    """One decision tree."""
    return Latency([(_fit(DecisionTreeRegressor(maxDepth=depth, seed=seed), rows, features, actual), None, 1.0)])


def random_trees(rows: DataFrame, features: str = "features", actual: str = "latency", trees: int = 100, depth: int = 10, bins: int = 8, seed: int = 0) -> Latency:
    """Trees over all rows that try one feature in three at a split and few thresholds of it: more random than a forest's, and not resampled."""
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, maxBins=bins, featureSubsetStrategy="onethird", bootstrap=False, seed=seed)
    return Latency([(_fit(model, rows, features, actual), None, 1.0)])


def tail_blend(rows: DataFrame, chosen: list[int], weight: float = 0.5, features: str = "features", actual: str = "latency", seed: int = 0) -> Latency:
    """A forest on some features and boosted trees on all."""
    first = _fit(RandomForestRegressor(numTrees=100, maxDepth=8, seed=seed), rows, features, actual, chosen)
    return Latency([(first, chosen, weight), (boosted(rows, features, actual, seed=seed).parts[0][0], None, 1 - weight)])


def calibrated(model: Latency, rows: DataFrame, features: str = "features", actual: str = "latency", how: str = "isotonic") -> Latency:
    """``isotonic``: a rising map of log latencies; ``scale``: the median ratio of actual to predicted."""
    got = model.predict(rows, features)
    if how == "scale":
        return Latency(model.parts, model.calibration, model.scale * (got.agg(F.percentile(F.col(actual) / F.col("predicted"), F.lit(0.5))).first()[0] or 1.0))
    if model.calibration is not None:
        raise ValueError("the model is calibrated already")
    data = got.select(F.log1p("predicted").alias("__x"), F.log1p(actual).alias(_LOG))
    return Latency(model.parts, IsotonicRegression(featuresCol=_LOG, labelCol="__y").fit(data.select(F.col("__x").alias(_LOG), F.col(_LOG).alias("__y"))), model.scale)
