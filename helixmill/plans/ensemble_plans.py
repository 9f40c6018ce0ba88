"""Queries of ensembles, saved models, candidate evaluation, starting populations and target profiles."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequence as Q
from ..functions import statistics as T
from ..functions import transforms as X
from ..functions import vectors as V
from ..operators import joins as J
from ..operators.descriptors import describe
from ..operators.models import ensemble_scored, mean_prediction, saved_models
from ..operators.mutation import point_mutants
from ..sources.tables import kept
from .base import query, sequences
from .contract_plans import folder
from .design_plans import stand_in_score
from .interpretation_plans import MUTANT_SQL

#: Members of the stand-in ensemble: each scales the stand-in score by its own factor.
MEMBERS = 50
FOLD_T = "list_sum(list_transform(range(1, length(seq) - 2), lambda j: CASE WHEN substr(seq, j, 4) = 'TTTT' THEN 1 ELSE 0 END))"
SCORE_SQL = f"(2.0 * (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) + 0.3 * {FOLD_T})"


@query(
    "l11_ensemble_scores",
    f"WITH {{S}}, m AS (SELECT sample_idx, {SCORE_SQL} * (1 + k / 100.0) AS v FROM s, (SELECT unnest(range(0, {MEMBERS})) AS k) WHERE seq IS NOT NULL) SELECT sample_idx, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*)::INT AS n FROM m GROUP BY sample_idx",
)
def l11_ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of fifty scorers; each distinct sequence is scored once."""
    scorers = [lambda s, k=k: pd.Series(stand_in_score(s.tolist()) * (1 + k / 100.0)) for k in range(MEMBERS)]
    rows = ensemble_scored(sequences(spark, sf_dir).where("seq is not null"), "seq", scorers)
    return rows.select("sample_idx", F.round("ensemble.mean", 6).alias("mean"), F.round("ensemble.sd", 6).alias("sd"), "ensemble.n")


@query("s5_saved_models", "WITH {S}, g AS (SELECT sample_idx % 3 AS k, regr_slope(pred, y) AS a, regr_intercept(pred, y) AS b FROM s WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY 1) SELECT sample_idx, round(avg(a * y + b), 4) AS prediction FROM s, g WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY sample_idx")
def s5_saved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of three folds, saved in folders, found again by listing them, and their mean prediction."""
    rows = sequences(spark, sf_dir).where("y is not null and pred is not null").select("sample_idx", "y", "pred")
    rows = VectorAssembler(inputCols=["y"], outputCol="x").transform(rows)
    root = folder(spark, "models")
    for k in range(3):
        LinearRegression(featuresCol="x", labelCol="pred", solver="normal").fit(rows.where(F.col("sample_idx") % 3 == k)).save(f"{root}/fold_{k}")
    return mean_prediction(rows, saved_models(spark, root), "x").select("sample_idx", F.round("prediction", 4).alias("prediction"))


MODELS = ((0.3, 2.0), (0.2, 1.5), (0.4, 2.5))


@query(
    "l9_ensemble_effects",
    f"WITH {{S}}, {MUTANT_SQL.split(' e AS ')[0]} t AS (SELECT sample_idx, p, alt, list_sum(list_transform(range(1, length(seq) - 2), lambda j: CASE WHEN substr(mutant, j, 4) = 'TTTT' THEN 1 ELSE 0 END)) - {FOLD_T} AS dt, (length(replace(replace(seq, 'G', ''), 'C', '')) - length(replace(replace(mutant, 'G', ''), 'C', ''))) / length(seq)::DOUBLE AS dg FROM m),"
    f" k AS (SELECT * FROM (VALUES {', '.join(str(x) for x in MODELS)}) v(a, b)), d AS (SELECT sample_idx, p, alt, avg(a * dt + b * dg) AS mean, stddev_samp(a * dt + b * dg) AS sd FROM t, k GROUP BY 1, 2, 3) SELECT p::INT AS position, alt, round(avg(mean), 6) AS mean_delta, round(avg(sd), 6) AS mean_sd, count(*) AS n FROM d GROUP BY 1, 2",
)
def l9_ensemble_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every substitution's paired difference by each of three models, its mean and deviation over them, by place and base."""
    s, m = F.col("seq"), F.col("mutant")
    runs = Q.overlapping_count(m, "TTTT") - Q.overlapping_count(s, "TTTT")
    gc = (Q.count_of(m, "G") + Q.count_of(m, "C") - Q.count_of(s, "G") - Q.count_of(s, "C")) / F.length(s)
    told = [a * runs + b * gc for a, b in MODELS]
    mean = sum(told[1:], told[0]) / len(told)
    rows = point_mutants(sequences(spark, sf_dir).where("seq is not null").select("sample_idx", "seq")).withColumn("d", F.array(*told)).withColumn("mean", mean)
    sd = F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / (len(told) - 1))
    return rows.withColumn("sd", sd).groupBy("position", "alt").agg(F.round(F.avg("mean"), 6).alias("mean_delta"), F.round(F.avg("sd"), 6).alias("mean_sd"), F.count(F.lit(1)).alias("n"))


SPACE = (("gc_content", 1.0), ("freq_A", 1.0), ("max_poly_t_run", 10.0), ("stem_length", 10.0))
POINT_SQL = ", ".join(f'round("{c}" / {w}, 9)' for c, w in SPACE)
APART = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(
    "l12_full_evaluation",
    "WITH {S}, {G}, {D}, r AS (SELECT min(y) AS lo, max(y) AS hi, min(seq_len) AS short, max(seq_len) AS long FROM d WHERE y IS NOT NULL AND sample_idx % 2 = 0), q AS (SELECT quantile_cont(gc_content, 0.5) AS c, quantile_cont(gc_content, 0.75) - quantile_cont(gc_content, 0.25) AS sc FROM d),"
    f" p AS (SELECT sample_idx, seq, lang, y, [{POINT_SQL}] AS x, gc_content, seq_len, stem_length, spacer_length, y + 0.02 * gc_content AS pred_y, 0.02 * gc_content AS pred_sd FROM d WHERE y IS NOT NULL AND seq IS NOT NULL),"
    f" nn AS (SELECT a.sample_idx, min({APART}) AS nn, min(CASE WHEN a.lang = b.lang THEN {APART} END) AS own FROM p a JOIN p b ON a.sample_idx <> b.sample_idx GROUP BY 1), k AS (SELECT seq, count(*) AS copies FROM p GROUP BY seq)"
    " SELECT p.sample_idx, round(pred_y, 6) AS pred_y, round(pred_sd, 6) AS pred_sd, round(1 - pow(10, -pred_y), 6) AS pred_te, round(pow(10, pred_y), 4) AS pred_strength, round(abs(1 - pow(10, -pred_y) - 0.9), 6) AS target_error, abs(1 - pow(10, -pred_y) - 0.9) <= 0.05 AS on_target, round(0.5 * abs(gc_content - c) / CASE WHEN sc > 1e-12 THEN sc ELSE 1 END, 6) AS rule_distance,"
    " round(nn, 5) AS nn_distance, round(own, 5) AS target_nn_distance, seq_len BETWEEN short AND long AS length_supported, stem_length > 0 AND spacer_length <> 15 AS structure_supported, pred_y BETWEEN lo AND hi AS prediction_supported, seq_len BETWEEN short AND long AND stem_length > 0 AND spacer_length <> 15 AND pred_y BETWEEN lo AND hi AS supported, copies = 1 AS is_novel FROM p JOIN nn ON nn.sample_idx = p.sample_idx JOIN k ON k.seq = p.seq, r, q",
)
def l12_full_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction with its deviation, target error, distance from rules and nearest neighbours, support and novelty of candidates."""
    rows = describe(sequences(spark, sf_dir).where("seq is not null and y is not null"))
    rows = kept(rows.select("sample_idx", "seq", "lang", "y", "gc_content", "seq_len", "stem_length", "spacer_length", F.array(*(F.round(F.col(c) / w, 9) for c, w in SPACE)).alias("x")), "candidates")
    natural = rows.where("sample_idx % 2 = 0").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.min("seq_len").alias("short"), F.max("seq_len").alias("long"))
    rule = T.quantiles(rows, "gc_content", {"c": 0.5, "low": 0.25, "high": 0.75})
    # three members of an ensemble, as expressions
    members = F.array(*(F.col("y") + k * 0.02 * F.col("gc_content") for k in (0, 1, 2)))
    mean = F.aggregate("members", F.lit(0.0), lambda a, x: a + x) / 3
    sd = F.sqrt(F.aggregate("members", F.lit(0.0), lambda a, x: a + (x - F.col("pred_y")) * (x - F.col("pred_y"))) / 2)
    told = rows.withColumn("members", members).withColumn("pred_y", mean).withColumn("pred_sd", sd)
    near = J.nearest(rows, rows, "sample_idx", "x", exclude_self=True)
    own = rows.where("lang is not null")
    own = J.nearest(own, own, "sample_idx", "x", exclude_self=True, block="lang", name="target_nn_distance")
    copies = rows.groupBy("seq").agg((F.count(F.lit(1)) == 1).alias("is_novel"))
    every = told.join(near, "sample_idx").join(own, "sample_idx", "left").join(copies, "seq").crossJoin(F.broadcast(natural.crossJoin(F.broadcast(rule))))
    te = X.y_to_te(F.col("pred_y"))
    scale = F.when(F.col("high") - F.col("low") > 1e-12, F.col("high") - F.col("low")).otherwise(1.0)
    length, structure, inside = F.col("seq_len").between(F.col("short"), F.col("long")), (F.col("stem_length") > 0) & (F.col("spacer_length") != Q.NO_SPACER), F.col("pred_y").between(F.col("lo"), F.col("hi"))
    return every.select(
        "sample_idx", F.round("pred_y", 6).alias("pred_y"), F.round("pred_sd", 6).alias("pred_sd"), F.round(te, 6).alias("pred_te"), F.round(X.y_to_strength(F.col("pred_y")), 4).alias("pred_strength"),
        F.round(F.abs(te - 0.9), 6).alias("target_error"), (F.abs(te - 0.9) <= 0.05).alias("on_target"), F.round(V.weighted_l1(F.col("gc_content"), F.col("c"), scale, F.lit(0.5)), 6).alias("rule_distance"),
        F.round("nn_distance", 5).alias("nn_distance"), F.round("target_nn_distance", 5).alias("target_nn_distance"), length.alias("length_supported"), structure.alias("structure_supported"), inside.alias("prediction_supported"), (length & structure & inside).alias("supported"), "is_novel",
    )


TARGETS = (2.0, 2.5, 3.0, 3.5, 9.0)


@query(
    "l15_initial_population",
    f"WITH {{S}}, t AS (SELECT unnest({list(TARGETS)})::DOUBLE AS target), x AS (SELECT target, sample_idx, seq, abs(y - target) AS off, sample_idx % 2 = 0 AND abs(y - target) <= 0.2 AS made FROM s, t WHERE y IS NOT NULL AND seq IS NOT NULL AND (sample_idx % 2 = 1 OR abs(y - target) <= 0.2)),"
    " o AS (SELECT *, row_number() OVER (PARTITION BY target, seq ORDER BY made DESC, off, sample_idx) AS c FROM x) SELECT target, sample_idx, made FROM o WHERE c = 1 QUALIFY row_number() OVER (PARTITION BY target ORDER BY made DESC, round(off, 9), sample_idx) <= 24",
)
def l15_initial_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 24 made sequences near each target; where they are fewer, natural ones, the nearest first, fill up."""
    rows = sequences(spark, sf_dir).where("y is not null and seq is not null").select("sample_idx", "seq", "y")
    many = rows.withColumn("target", F.explode(F.array(*map(F.lit, TARGETS)))).withColumn("off", F.abs(F.col("y") - F.col("target")))
    made = (F.col("sample_idx") % 2 == 0) & (F.col("off") <= 0.2)
    pool = many.withColumn("made", made).where(F.col("made") | (F.col("sample_idx") % 2 == 1))
    one = J.first_by(pool, ["target", "seq"], [F.desc("made"), "off", "sample_idx"])
    order = Window.partitionBy("target").orderBy(F.desc("made"), F.round("off", 9), "sample_idx")
    return one.withColumn("_r", F.row_number().over(order)).where("_r <= 24").select("target", "sample_idx", "made")


PROFILED = ("gc_content", "freq_A", "max_poly_t_run", "kmer_TTT")


@query(
    "l20_rule_profile",
    "WITH {S}, {G}, {D}, t AS (SELECT k::INT AS target_rank, 1.0 + k * 0.5 AS target_y FROM (SELECT unnest(range(0, 6)) AS k)), n AS (SELECT target_rank, sample_idx, round(exp(-2.0 * pow(y - target_y, 2)), 6) AS w, " + ", ".join(f'round("{c}", 9) AS "{c}"' for c in PROFILED) + " FROM d, t WHERE abs(y - target_y) <= 0.5),"
    " l AS (SELECT * FROM n UNPIVOT (value FOR feature IN (" + ", ".join(f'"{c}"' for c in PROFILED) + "))), g1 AS (SELECT target_rank, feature, value, sum(w)::DECIMAL(18, 6) AS w FROM l GROUP BY 1, 2, 3), c AS (SELECT *, sum(w) OVER (PARTITION BY target_rank, feature ORDER BY value) AS upto, sum(w) OVER (PARTITION BY target_rank, feature) AS total FROM g1), m AS (SELECT target_rank, feature, min(value) AS centre FROM c WHERE 2 * upto >= total GROUP BY 1, 2),"
    " h AS (SELECT target_rank, feature, abs(value - centre) AS value, sum(w)::DECIMAL(18, 6) AS w FROM l JOIN m USING (target_rank, feature) GROUP BY 1, 2, 3), e AS (SELECT *, sum(w) OVER (PARTITION BY target_rank, feature ORDER BY value) AS upto, sum(w) OVER (PARTITION BY target_rank, feature) AS total FROM h) SELECT e.target_rank, e.feature, round(any_value(centre), 6) AS centre, round(min(value), 6) AS spread FROM e JOIN m ON m.target_rank = e.target_rank AND m.feature = e.feature WHERE 2 * upto >= total GROUP BY 1, 2",
)
def l20_rule_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted median of each feature near each target, and the weighted median distance from it."""
    rows = describe(sequences(spark, sf_dir).where("seq is not null")).select("sample_idx", "y", *(F.round(c, 9).alias(c) for c in PROFILED))
    grid = spark.range(6).select(F.col("id").cast("int").alias("target_rank"), (1.0 + F.col("id") * 0.5).alias("target_y"))
    near = J.within_band(rows, F.broadcast(grid), "y", "target_y", 0.5)  # a grid of six
    weighed = near.withColumn("w", F.round(F.exp(-2.0 * F.pow(F.col("y") - F.col("target_y"), F.lit(2))), 6).cast("decimal(18,6)"))
    long = kept(weighed.select("target_rank", "w", *PROFILED), "neighbours").unpivot(["target_rank", "w"], list(PROFILED), "feature", "value")
    keys = ("target_rank", "feature")
    centre = kept(T.weighted_median(long, "value", "w", keys, "centre"), "centres")
    away = long.join(F.broadcast(centre), list(keys)).withColumn("away", F.abs(F.col("value") - F.col("centre")))  # targets times features
    return T.weighted_median(away, "away", "w", keys, "spread").join(centre, list(keys)).select(*keys, F.round("centre", 6).alias("centre"), F.round("spread", 6).alias("spread"))
