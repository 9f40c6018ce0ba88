"""Models on Spark ML: power transform, out-of-fold stacking, and batch scoring of distinct sequences."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import shuffled_order
from .learners import extra_trees, ridge_by_penalty, support_vectors


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if abs(power) < 1e-9 else (F.pow(x + 1.0, F.lit(power)) - 1.0) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-9 else -(F.pow(1.0 - x, F.lit(2.0 - power)) - 1.0) / (2.0 - power)
    return F.when(x >= 0, up).otherwise(down)


POWERS = tuple(k / 4 for k in range(-8, 17))


def fit_powers(df: DataFrame, columns: list[str], powers: tuple[float, ...] = POWERS) -> dict[str, float]:
    """The likeliest power of each column on a grid: all columns and powers in one aggregate of one row."""
    sums = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        sums.append(F.avg(F.signum(x) * F.log1p(F.abs(x))).alias(f"j{i}"))
        sums += [F.var_pop(yeo_johnson(x, p)).alias(f"v{i}_{k}") for k, p in enumerate(powers)]
    row = df.agg(*sums).first()
    out = {}
    for i, c in enumerate(columns):
        like = [(-0.5 * math.log(v) + (p - 1) * row[f"j{i}"] if (v := row[f"v{i}_{k}"]) and v > 1e-12 else -math.inf, p) for k, p in enumerate(powers)]
        best = max(like)
        out[c] = best[1] if best[0] > -math.inf else 1.0
    return out


def powered(df: DataFrame, powers: dict[str, float]) -> DataFrame:
    return df.withColumns({c: yeo_johnson(F.col(c).cast("double"), p) for c, p in powers.items()})


def important_features(df: DataFrame, features: list[str], label: str, trees: int = 20, seed: int = 42) -> list[str]:
    """The features whose importance in a forest reaches the mean; all of them if none stands out."""
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df).select("_x", label)
    told = RandomForestRegressor(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=5, seed=seed).fit(rows).featureImportances.toArray()
    return [f for f, v in zip(features, told, strict=True) if v >= told.mean()] or features


class Stack:
    """Base learners, whose out-of-fold predictions feed a ridge regression with the penalty of the least left-out error.

    The base learners are support vectors on Fourier features, extremely randomised trees and boosted trees. Selection, power
    transform and scaling are fitted on the rows of ``fit`` alone, so no held-out row is ever seen."""

    def __init__(self, features: list[str], label: str, key: str, inner: int = 5, seed: int = 42, trees: int = 200, depth: int = 12, boosts: int = 150, size: int = 256, rounds: int = 25, select: bool = False):
        self.features, self.label, self.key, self.inner, self.seed = features, label, key, inner, seed
        self.trees, self.depth, self.boosts, self.size, self.rounds, self.select = trees, depth, boosts, size, rounds, select

    def prepared(self, df: DataFrame) -> DataFrame:
        """``df`` with the transformed and scaled features _z0, _z1, ..."""
        return df.withColumns({z: (yeo_johnson(F.col(c).cast("double"), self.powers[c]) - m) / s for z, (c, m, s) in self.scales.items()})

    def base(self, rows: DataFrame) -> list[Callable[[DataFrame], DataFrame]]:
        """Functions that add the columns _p0, _p1, _p2: the predictions of the learners fitted on ``rows``."""
        z = list(self.scales)
        vectors = support_vectors(rows, z, self.label, size=self.size, rounds=self.rounds, seed=self.seed)
        forest = extra_trees(rows, z, self.label, trees=self.trees, depth=self.depth, seed=self.seed)
        joined = VectorAssembler(inputCols=z, outputCol="_x", handleInvalid="skip")
        boosted = GBTRegressor(featuresCol="_x", labelCol=self.label, predictionCol="_p2", maxIter=self.boosts, stepSize=0.1, maxDepth=3, seed=self.seed).fit(joined.transform(rows))
        return [lambda df: df.withColumn("_p0", vectors.column()), lambda df: df.withColumn("_p1", forest.column()), lambda df: boosted.transform(joined.transform(df)).drop("_x")]

    def fit(self, train: DataFrame) -> Stack:
        if self.select:
            self.features = important_features(train, self.features, self.label, min(self.trees, 20), self.seed)
        self.powers = fit_powers(train, self.features)
        told = powered(train, self.powers).agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(self.features) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        self.scales = {f"_z{i}": (c, told[f"m{i}"], told[f"s{i}"] if told[f"s{i}"] and told[f"s{i}"] > 1e-12 else 1.0) for i, c in enumerate(self.features)}
        inner = F.pmod(F.conv(F.substring(shuffled_order(self.seed, F.col(self.key)), 1, 8), 16, 10).cast("long"), F.lit(self.inner))
        rows = self.prepared(train).select(self.key, self.label, *self.scales, inner.alias("_fold")).persist()
        meta = None
        for k in range(self.inner):
            held = rows.where(F.col("_fold") == k)
            for learner in self.base(rows.where(F.col("_fold") != k)):
                held = learner(held)
            meta = held if meta is None else meta.unionByName(held)
        self.meta, self.errors = ridge_by_penalty(meta, ["_p0", "_p1", "_p2"], self.label)
        self.models = self.base(rows)
        rows.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``."""
        out = self.prepared(df)
        for learner in self.models:
            out = learner(out)
        return out.withColumn("prediction", self.meta.column()).select(*df.columns, "prediction")


def out_of_fold(df: DataFrame, fold: str, folds: int, stack: Callable[[], Stack]) -> DataFrame:
    """Predictions of each row by the stack that was fitted without its fold."""
    out = None
    for k in range(folds):
        told = stack().fit(df.where(F.col(fold) != k)).predict(df.where(F.col(fold) == k))
        out = told if out is None else out.unionByName(told)
    return out


def scored_once(df: DataFrame, sequence: str, score: Callable[[pd.Series], pd.Series], name: str = "score") -> DataFrame:
    """Adds a batch scorer's value; each distinct sequence is scored once. The hook for foreign models."""

    @F.pandas_udf("double")
    def hook(batch: pd.Series) -> pd.Series:
        return score(batch)

    told = df.select(sequence).distinct().withColumn(name, hook(F.col(sequence)))
    return df.join(told, sequence, "left")


def ensemble_scored(df: DataFrame, sequence: str, scorers: list[Callable[[pd.Series], pd.Series]], name: str = "ensemble") -> DataFrame:
    """Adds struct<mean, sd, n> of the scores of several batch scorers; each distinct sequence is scored once by each.

    Null sequences have none. ``sd`` is the sample's, 0 for one scorer."""

    @F.pandas_udf("mean double, sd double, n int")
    def hook(batch: pd.Series) -> pd.DataFrame:
        told = pd.concat([s(batch).reset_index(drop=True) for s in scorers], axis=1).to_numpy(float)
        sd = told.std(axis=1, ddof=1) if len(scorers) > 1 else told[:, 0] * 0.0
        return pd.DataFrame({"mean": told.mean(axis=1), "sd": sd, "n": len(scorers)}).astype({"n": "int32"})

    told = df.where(F.col(sequence).isNotNull()).select(sequence).distinct().withColumn(name, hook.asNondeterministic()(F.col(sequence)))
    return df.join(told, sequence, "left")


def saved_models(spark: SparkSession, root: str) -> list[LinearRegressionModel]:
    """The linear models saved in the folders under a root, by name of folder."""
    from ..sources.tables import hadoop_path

    path, fs = hadoop_path(spark, root)
    return [LinearRegressionModel.load(p) for p in sorted(str(x.getPath()) for x in fs.listStatus(path) if x.isDirectory())]


def mean_prediction(df: DataFrame, models: list[LinearRegressionModel], features: str, name: str = "prediction") -> DataFrame:
    """Adds the mean of several models' predictions; no rows move."""
    out = df
    for i, m in enumerate(models):
        out = m.copy().setPredictionCol(f"_p{i}").transform(out)
    total = F.lit(0.0)
    for i in range(len(models)):
        total = total + F.col(f"_p{i}")
    return out.withColumn(name, total / max(len(models), 1)).drop(*(f"_p{i}" for i in range(len(models))))
