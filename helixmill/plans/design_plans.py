"""Queries of target planning, candidate evaluation, Pareto order, evolution, models and restartable runs."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..functions import statistics as T
from ..functions import transforms as X
from ..functions import vectors as V
from ..operators import folds as D
from ..operators import joins as J
from ..operators import pareto as P
from ..operators.descriptors import describe
from ..operators.models import Stack, out_of_fold, scored_once
from ..operators.search import evolve, generation_history
from ..sources.tables import checkpoint_root, kept
from .base import load, query, sequences
from .join_plans import vectors

#: Rows of a search's population, and designs that are kept of a target.
POPULATION = 96
FINAL = 30
POOL = "c AS (SELECT p_brand, p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part)"
FRONT_SQL = f"WITH RECURSIVE {POOL}, dom AS MATERIALIZED (SELECT x.p_partkey AS u, y.p_partkey AS v FROM c x JOIN c y ON x.p_brand = y.p_brand AND x.a <= y.a AND x.b <= y.b AND (x.a < y.a OR x.b < y.b)), r AS (SELECT p_partkey AS k, 0 AS d FROM c UNION SELECT v, d + 1 FROM r JOIN dom ON u = k), f AS (SELECT c.*, pareto_rank FROM c JOIN (SELECT k, max(d)::INT AS pareto_rank FROM r GROUP BY k) ON k = p_partkey)"
CROWD_SQL = (
    FRONT_SQL
    + ", g AS (SELECT *, count(*) OVER w AS n, max(a) OVER w - min(a) OVER w AS sa, max(b) OVER w - min(b) OVER w AS sb, lead(a) OVER wa AS la, lag(a) OVER wa AS ga, lead(b) OVER wb AS lb, lag(b) OVER wb AS gb FROM f WINDOW w AS (PARTITION BY p_brand, pareto_rank), wa AS (PARTITION BY p_brand, pareto_rank ORDER BY a, p_partkey), wb AS (PARTITION BY p_brand, pareto_rank ORDER BY b, p_partkey)),"
    " h AS (SELECT *, CASE WHEN n > 2 AND la IS NOT NULL AND ga IS NOT NULL AND lb IS NOT NULL AND gb IS NOT NULL THEN CASE WHEN sa > 0 THEN (la - ga) / sa ELSE 0 END + CASE WHEN sb > 0 THEN (lb - gb) / sb ELSE 0 END END AS crowding FROM g)"
)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of each brand; a search cuts its population after they are sorted."""
    return load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))


def ranked(df: DataFrame, block: str, order: list, most: int) -> DataFrame:
    """The first rows of each block; each task drops what can't be among them before the shuffle."""
    from pyspark.sql.window import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(block).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


@query("l13_pareto_fronts", FRONT_SQL + " SELECT p_partkey, pareto_rank FROM f")
def l13_pareto_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fronts(population(spark, sf_dir), "p_brand", ["a", "b"]).select("p_partkey", "pareto_rank")


@query("w5_crowding_distance", CROWD_SQL + " SELECT p_partkey, round(crowding, 6) AS crowding_distance FROM h")
def w5_crowding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.crowding(P.fronts(population(spark, sf_dir), "p_brand", ["a", "b"]), ["p_brand", "pareto_rank"], ["a", "b"], "p_partkey")
    return rows.select("p_partkey", F.round(X.null_if_not_finite(F.col("crowding_distance")), 6).alias("crowding_distance"))


@query("l14_pareto_order", CROWD_SQL + " SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY pareto_rank, crowding DESC NULLS FIRST, b, p_partkey)::INT AS pareto_position FROM h")
def l14_pareto_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.crowding(P.fronts(population(spark, sf_dir), "p_brand", ["a", "b"]), ["p_brand", "pareto_rank"], ["a", "b"], "p_partkey")
    return P.pareto_order(rows, "p_brand", "b", "p_partkey").select("p_partkey", "pareto_position")


@query("j14_skyline", "WITH p AS (SELECT p_partkey, p_brand, p_size AS a, p_retailprice AS b FROM part) SELECT x.p_partkey FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE x.p_brand = y.p_brand AND y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))")
def j14_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return P.skyline(rows, "p_brand", "p_partkey", ["a", "b"]).select("p_partkey")


UNIT_SQL = "u AS (SELECT vec_id, label, embedding[1]::DOUBLE AS w, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE)))) AS e FROM embeddings)"
APART_SQL = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(
    "t15_diverse_selection",
    f"WITH RECURSIVE {UNIT_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY w DESC, vec_id) AS k FROM u), r AS (SELECT DISTINCT label, 0::BIGINT AS k, []::DOUBLE[][] AS kept, []::BIGINT[] AS ids FROM v UNION ALL"
    f" SELECT r.label, v.k, CASE WHEN ok THEN list_append(kept, e) ELSE kept END, CASE WHEN ok THEN list_append(ids, vec_id) ELSE ids END FROM r JOIN v ON v.label = r.label AND v.k = r.k + 1, LATERAL (SELECT len(kept) < {FINAL} AND coalesce(list_min(list_transform(kept, lambda f: {APART_SQL.format(a='f', b='e')})) >= 1.2, true) AS ok)),"
    " l AS (SELECT label, ids FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC) = 1) SELECT label, unnest(ids) AS vec_id, unnest(range(1, len(ids) + 1))::INT AS pick FROM l",
)
def t15_diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 30 vectors of each target, from the largest first values on, at least 1.2 apart."""
    rows = vectors(spark, sf_dir).select("vec_id", "label", V.unit_vector(F.col("e")).alias("e"), (-F.get("e", 0)).alias("o"))
    return P.diverse(rows, "label", "vec_id", "e", ["o", "vec_id"], 1.2, FINAL)


@query(
    "t14_anchor_cover",
    f"WITH RECURSIVE {UNIT_SQL}, v AS (SELECT vec_id, label, e, round(w, 9) AS w, row_number() OVER (PARTITION BY label ORDER BY round(w, 9) DESC, vec_id) AS k FROM u), pairs AS MATERIALIZED (SELECT a.label, a.k AS a, b.k AS b, {APART_SQL.format(a='a.e', b='b.e')} AS d FROM v a JOIN v b ON a.label = b.label),"
    " r AS (SELECT DISTINCT label, 1::BIGINT AS n, [1]::BIGINT[] AS chosen FROM v UNION ALL SELECT label, n + 1, list_append(chosen, far) FROM (SELECT r.label, r.n, r.chosen, arg_max(q.b, q.near * 1e6 - q.b * 1e-7) AS far, max(q.near) AS most FROM r, LATERAL (SELECT b, min(d) AS near FROM pairs WHERE pairs.label = r.label AND list_contains(r.chosen, a) GROUP BY b) q GROUP BY r.label, r.n, r.chosen) WHERE most > 1.3 AND NOT list_contains(chosen, far)),"
    " l AS (SELECT label, chosen FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC) = 1), c AS (SELECT label, unnest(chosen) AS k, unnest(range(1, len(chosen) + 1))::INT AS anchor_rank FROM l) SELECT c.label, vec_id, w, anchor_rank FROM c JOIN v ON v.label = c.label AND v.k = c.k",
)
def t14_anchor_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each target within 1.3 of every one of its vectors."""
    rows = vectors(spark, sf_dir).select("vec_id", "label", V.unit_vector(F.col("e")).alias("e"), F.round(F.get("e", 0), 9).alias("w"), F.lit(1.3).alias("radius"))
    return P.cover(rows, "label", "vec_id", "e", "w", "radius")


@query(
    "l12_candidate_evaluation",
    "WITH {S}, {G}, {D}, q AS (SELECT quantile_cont(gc_content, 0.5) AS c, quantile_cont(gc_content, 0.75) - quantile_cont(gc_content, 0.25) AS sc, min(seq_len) AS lo, max(seq_len) AS hi FROM d)"
    " SELECT sample_idx, round(1 - pow(10, -least(y, 3)), 6) AS pred_te, round(abs(1 - pow(10, -least(y, 3)) - 0.9), 6) AS target_error, round(0.5 * abs(gc_content - c) / sc, 6) AS rule_distance, seq_len BETWEEN lo AND hi AND stem_length > 0 AND spacer_length <> 15 AS structure_supported FROM d, q",
)
def l12_candidate_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = describe(sequences(spark, sf_dir))
    own = Q.composition(F.col("seq"))
    natural = sequences(spark, sf_dir).select(own["gc_content"].alias("gc_content"), own["seq_len"].alias("seq_len"))
    ends = T.quantiles(natural, "gc_content", {"c": 0.5, "low": 0.25, "high": 0.75}).select("c", (F.col("high") - F.col("low")).alias("sc"))
    seen = natural.agg(F.min("seq_len").alias("lo"), F.max("seq_len").alias("hi")).crossJoin(F.broadcast(ends))  # rows of one
    te = X.y_to_te(F.least("y", F.lit(3.0)))
    supported = F.col("seq_len").between(F.col("lo"), F.col("hi")) & (F.col("stem_length") > 0) & (F.col("spacer_length") != Q.NO_SPACER)
    distance = V.weighted_l1(F.col("gc_content"), F.col("c"), F.col("sc"), F.lit(0.5))
    return rows.crossJoin(F.broadcast(seen)).select("sample_idx", F.round(te, 6).alias("pred_te"), F.round(F.abs(te - 0.9), 6).alias("target_error"), F.round(distance, 6).alias("rule_distance"), supported.alias("structure_supported"))


@query(
    "l20_target_plan",
    "WITH {S}, t AS (SELECT k::INT AS target_rank, 1.0 + k * 0.5 AS target_y FROM (SELECT unnest(range(0, 6)) AS k)), h AS (SELECT 0.9 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.349) * pow(count(*), -0.2) AS h FROM s), n AS (SELECT target_rank, target_y, sample_idx, exp(-0.5 * pow((y - target_y) / h, 2)) AS w FROM s, t, h WHERE abs(y - target_y) <= 0.5),"
    " a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY target_rank ORDER BY round(w, 9) DESC, sample_idx) <= 8), e AS (SELECT *, 256.0 * round(w, 9) / sum(round(w, 9)) OVER (PARTITION BY target_rank) AS e FROM a), f AS (SELECT *, floor(e) AS f, row_number() OVER (PARTITION BY target_rank ORDER BY round(e - floor(e), 9) DESC, sample_idx) AS r, 256 - sum(floor(e)) OVER (PARTITION BY target_rank) AS more FROM e)"
    " SELECT target_rank, sample_idx AS anchor_sample_idx, (f + (r <= more)::INT)::BIGINT AS n_samples FROM f",
)
def l20_target_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhood of each target, its eight heaviest anchors, and 256 samples dealt out by weight."""
    rows = sequences(spark, sf_dir).select("sample_idx", "y")
    grid = spark.range(6).select(F.col("id").cast("int").alias("target_rank"), (1.0 + F.col("id") * 0.5).alias("target_y"))
    near = J.within_band(rows, F.broadcast(grid), "y", "target_y", 0.5).crossJoin(F.broadcast(T.scales(rows, "y").select(F.col("bandwidth").alias("h"))))
    weighed = near.withColumn("w", F.round(F.exp(-0.5 * F.pow((F.col("y") - F.col("target_y")) / F.col("h"), F.lit(2))), 9))
    anchors = ranked(weighed, "target_rank", [F.desc("w"), "sample_idx"], 8)
    return D.largest_remainder(anchors, "w", 256, ["target_rank"], "sample_idx", "n_samples").select("target_rank", F.col("sample_idx").alias("anchor_sample_idx"), "n_samples")


@query(
    "l22_final_selection",
    f"WITH u AS (SELECT source AS target, text, n_chars, doc_id FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY target, text ORDER BY doc_id) = 1), n AS (SELECT * FROM d WHERE text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)) SELECT target, doc_id, row_number() OVER (PARTITION BY target ORDER BY abs(n_chars - 1000), doc_id)::INT AS final_rank FROM n QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs(n_chars - 1000), doc_id) <= {FINAL}",
)
def l22_final_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New texts of each target, the 30 nearest to its length."""
    from pyspark.sql.window import Window

    rows = load(spark, sf_dir, "documents").where("text is not null and source is not null").select(F.col("source").alias("target"), F.sha2("text", 256).alias("digest"), "doc_id", F.abs(F.col("n_chars") - 1000).alias("off"))
    known = load(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("digest"))
    one = rows.groupBy("target", "digest").agg(F.min_by(F.struct("doc_id", "off"), "doc_id").alias("x")).select("target", "digest", "x.*")
    new = one.join(known, "digest", "left_anti")
    return new.withColumn("final_rank", F.row_number().over(Window.partitionBy("target").orderBy("off", "doc_id"))).where(F.col("final_rank") <= FINAL).select("target", "doc_id", "final_rank")


@query("l22_final_report")
def l22_final_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the final selection of each brand: two pools, known names, first fronts, thinned to designs that lie apart."""
    rows = load(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b"), (F.col("p_size") > 3).alias("ok"))
    rows = rows.withColumn("v", F.array(F.col("a") / 50, F.col("b") / 2000))
    known = rows.where("p_partkey % 7 = 0")
    _, summary = P.final_selection([rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 = 1")], known, "p_brand", "p_name", ["a", "b"], "v", "ok", 0.05, FINAL)
    return summary.select(*summary.columns[:-2], F.round("best_a", 4).alias("best_a"), F.round("best_b", 4).alias("best_b"))


def stand_in_score(names: list[str]) -> np.ndarray:
    """GC share and T runs of sequences, as a stand-in for a trained model."""
    return np.array([2.0 * (s.count("G") + s.count("C")) / len(s) + 0.3 * sum(s[k : k + 4] == "TTTT" for k in range(len(s) - 3)) for s in names])


def stand_in_distance(names: list[str]) -> np.ndarray:
    return np.array([abs(s.count("A") / len(s) - 0.25) for s in names])


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, seed, sequence): the 96 sequences nearest to each target in measured value, natural ones as they are."""
    rows = sequences(spark, sf_dir).where("seq is not null and y is not null").select(F.col("seq").alias("sequence"), "y").groupBy("sequence").agg(F.min("y").alias("y"))
    grid = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(s).alias("seed")) for t in (0.8, 1.2, 1.6) for s in (1, 2))))
    many = rows.withColumn("_g", grid).select("sequence", "_g.target", "_g.seed", F.abs(F.col("y") - F.col("_g.target")).alias("off"))
    return ranked(many.withColumn("_b", F.struct("target", "seed")), "_b", ["off", "sequence"], POPULATION).drop("_b", "off")


@query("l18_evolution")
def l18_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for three targets with two seeds each: offspring with a hairpin and of natural length alone are taken up."""
    return evolve(starts(spark, sf_dir), stand_in_score, stand_in_distance)


@query("a29_generation_history")
def a29_generation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each generation of the searches tried and took up, the size of its first front and its best error."""
    return generation_history(starts(spark, sf_dir), stand_in_score, stand_in_distance)


STACKED = list(Q.FEATURES)


@query("l3_l5_stacked_predictions")
def l3_l5_stacked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of the stack on two stratified folds, with all fitting, selection included, inside the other fold."""
    rows = describe(sequences(spark, sf_dir).where("seq is not null and y is not null")).select("sample_idx", "y", "lang", *STACKED)
    dealt = D.stratified_folds(rows.withColumn("stratum", F.coalesce("lang", F.lit("none"))), "stratum", "sample_idx", [42], 2)
    dealt = kept(dealt.drop("stratum", "lang", "seed"), "folds")
    told = out_of_fold(dealt, "fold", 2, lambda: Stack(STACKED, "y", "sample_idx", inner=2, trees=10, depth=3, boosts=4, size=64, rounds=4, select=True))
    return told.select("sample_idx", F.round("y", 6).alias("y"), F.round("prediction", 6).alias("prediction"))


@query("l11_batch_scoring", "WITH {S} SELECT sample_idx, round(2.0 * (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) + 0.3 * list_sum(list_transform(range(1, length(seq) - 2), lambda j: CASE WHEN substr(seq, j, 4) = 'TTTT' THEN 1 ELSE 0 END)), 6) AS score FROM s")
def l11_batch_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_once(sequences(spark, sf_dir).where("seq is not null"), "seq", lambda s: pd.Series(stand_in_score(s.tolist())))
    return rows.select("sample_idx", F.round("score", 6).alias("score"))


@query("x2_incremental_run", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_id, any_value(event_type) AS event_type, any_value(value) AS value FROM events GROUP BY event_id) GROUP BY 1")
def x2_incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken up as files that come, twice; the second run finds nothing new."""
    from ..streaming.incremental import run_available

    root = f"{checkpoint_root(spark)}/events-{uuid.uuid4().hex}"
    for _ in range(2):
        run_available(spark, f"{sf_dir}/event[s].parquet", f"{root}/done", f"{root}/state", ["event_id"], lambda b: b.select("event_id", "event_type", "value"))
    return spark.read.parquet(f"{root}/done").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
