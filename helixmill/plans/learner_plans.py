"""Queries of the learners: penalties, repeated folds, extremely randomised trees, support vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..functions import statistics as T
from ..operators import folds as D
from ..operators import generator as G
from ..operators import learners as L
from ..operators.descriptors import describe
from ..sources.tables import kept
from .base import query, sequences

#: Seeds and folds of the repeated split, and the penalty of its fits.
SEEDS = tuple(range(42, 52))
FOLDS = 5
PENALTY = 1.0
GC_SQL = "x AS (SELECT sample_idx, lang, y, CAST(length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) AS DOUBLE) / length(seq) AS gc FROM s WHERE seq IS NOT NULL AND y IS NOT NULL)"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_idx, lang, y, 29 descriptors) of the sequences that have a measured value."""
    return describe(sequences(spark, sf_dir).where("seq is not null and y is not null")).select("sample_idx", "lang", "y", *Q.FEATURES)


@query(
    "l4_ridge_penalties",
    f"WITH {{S}}, {GC_SQL}, m AS (SELECT count(*) AS n, avg(gc) AS mx, avg(y) AS my, covar_pop(y, gc) * count(*) AS sxy, var_pop(gc) * count(*) AS sxx FROM x), a AS (SELECT k, pow(10, -2 + 5.0 * k / 19) AS penalty FROM (SELECT unnest(range(0, 20)) AS k)),"
    " e AS (SELECT k, penalty, avg(pow((y - my - (gc - mx) * sxy / (sxx + penalty)) / (1 - 1.0 / n - pow(gc - mx, 2) / (sxx + penalty)), 2)) AS error FROM x, m, a GROUP BY 1, 2)"
    " SELECT k::INT AS k, round(penalty, 6) AS penalty, round(error, 9) AS error, round(sxy / (sxx + penalty), 6) AS weight FROM e, m",
)
def l4_ridge_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared leave-one-out error of each of twenty penalties, and its weight, of a line on the GC share."""
    rows = sequences(spark, sf_dir).where("seq is not null and y is not null").select("y", Q.composition(F.col("seq"))["gc_content"].alias("gc"))
    rows = kept(rows, "rows")
    _, errors = L.ridge_by_penalty(rows, ["gc"], "y")
    told = L.moments(rows, ["gc"], "y")[0]
    out = [(k, p, e, float(L.ridge(told, ["gc"], p).weights[0])) for k, (p, e) in enumerate(errors.items())]
    return spark.createDataFrame(out, "k int, penalty double, error double, weight double").select("k", F.round("penalty", 6).alias("penalty"), F.round("error", 9).alias("error"), F.round("weight", 6).alias("weight"))


@query(
    "l5_repeated_folds",
    f"WITH {{S}}, {GC_SQL}, d AS (SELECT seed, sample_idx, y, gc, ((row_number() OVER (PARTITION BY seed, coalesce(lang, 'none') ORDER BY md5(seed || '|' || sample_idx), sample_idx) - 1) % {FOLDS})::INT AS fold FROM (SELECT *, unnest({list(SEEDS)}) AS seed FROM x)),"
    " g AS (SELECT a.seed, a.fold, covar_pop(b.y, b.gc) * count(*) / (var_pop(b.gc) * count(*) + 1.0) AS w, avg(b.y) AS my, avg(b.gc) AS mx FROM (SELECT DISTINCT seed, fold FROM d) a JOIN d b ON a.seed = b.seed AND a.fold <> b.fold GROUP BY 1, 2)"
    " SELECT d.seed, d.fold, count(*) AS n, round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) AS r2, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae FROM (SELECT d.*, my + w * (gc - mx) AS p FROM d JOIN g ON d.seed = g.seed AND d.fold = g.fold) d GROUP BY 1, 2",
)
def l5_repeated_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten seeds of five stratified folds: the metrics of each held-out fold, all fifty fits from one pass over the rows."""
    rows = sequences(spark, sf_dir).where("seq is not null and y is not null").select("sample_idx", F.coalesce("lang", F.lit("none")).alias("stratum"), "y", Q.composition(F.col("seq"))["gc_content"].alias("gc"))
    dealt = kept(D.stratified_folds(rows, "stratum", "sample_idx", list(SEEDS), FOLDS), "folds")
    told, _ = L.repeated_folds(dealt, ["gc"], "y", "seed", "fold", PENALTY)
    metrics = T.regression_metrics("y", "prediction")
    out = told.groupBy("seed", "fold").agg(F.count(F.lit(1)).alias("n"), *metrics)
    return out.select("seed", "fold", "n", *(F.round(c, 6).alias(c) for c in ("r2", "rmse", "mae")))


@query("l5_hybrid_folds")
def l5_hybrid_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean and deviation of each sequence's ten out-of-fold predictions by ridge fits on all 29 descriptors."""
    rows = described(spark, sf_dir).withColumn("stratum", F.coalesce("lang", F.lit("none")))
    dealt = kept(D.stratified_folds(rows, "stratum", "sample_idx", list(SEEDS), FOLDS), "folds")
    told, _ = L.repeated_folds(dealt, list(Q.FEATURES), "y", "seed", "fold", PENALTY)
    return told.groupBy("sample_idx").agg(F.round(F.avg("prediction"), 5).alias("mean"), F.round(F.stddev_samp("prediction"), 5).alias("sd"), F.count("prediction").alias("n"))


@query("l4_extra_trees")
def l4_extra_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of twenty extremely randomised trees on the 29 descriptors."""
    rows = kept(described(spark, sf_dir), "described")
    forest = L.extra_trees(rows, list(Q.FEATURES), "y", trees=20, depth=6)
    return rows.select("sample_idx", F.round("y", 6).alias("y"), F.round(forest.column(), 6).alias("prediction"))


@query("l4_support_vectors")
def l4_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of support vector regression with a radial kernel on the scaled descriptors."""
    rows = kept(described(spark, sf_dir), "described")
    told = rows.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(Q.FEATURES) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = rows.withColumns({c: (F.col(c) - told[f"m{i}"]) / (told[f"s{i}"] or 1.0) for i, c in enumerate(Q.FEATURES)})
    model = L.support_vectors(scaled, list(Q.FEATURES), "y", size=128)
    return scaled.select("sample_idx", F.round("y", 6).alias("y"), F.round(model.column(), 4).alias("prediction"))


CONTEXT_SQL = "WITH {S}, p AS (SELECT seq, unnest(range(1, length(seq) + 1)) AS p FROM s WHERE seq IS NOT NULL), k AS (SELECT seq, p, unnest(range(0, least(p - 1, 3) + 1)) AS k FROM p) SELECT substr(seq, (p - k)::INT, k::INT) AS context, substr(seq, p::INT, 1) AS letter, count(*) AS n FROM k GROUP BY 1, 2"


@query("l19_transition_counts", CONTEXT_SQL)
def l19_transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which letter follows each context of up to three letters, and how often."""
    return G.transition_counts(sequences(spark, sf_dir), "seq", 3)


@query("l19_generated_samples")
def l19_generated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve samples of the prompt of every twentieth sequence, its first ten letters, by the letters that follow each context."""
    rows = sequences(spark, sf_dir).where("seq is not null")
    model = G.letter_model(G.transition_counts(rows, "seq", 3), 3, temperature=0.8)
    prompts = rows.where("sample_idx % 20 = 0").select(F.col("sample_idx").alias("job_id"), F.substring("seq", 1, 10).alias("prompt"), F.lit(12).alias("n_samples"), (F.length("seq") - 10).alias("n_tokens"))
    return G.samples(prompts, model.generate).select("job_id", "sample_in_job", "generation_seed", "sequence", F.round("score", 6).alias("score"))
