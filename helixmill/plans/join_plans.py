"""Queries of joins, unions, samples, folds and per-group picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as T
from ..functions import vectors as V
from ..operators import folds as D
from ..operators import joins as J
from .base import load, query, sequences

VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
SQUARE = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_doubles(F.col("embedding")).alias("e"))


@query("j1_lookup_join", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j1_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the planner broadcasts a side by its size alone
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    rows = load(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("j4_composite_key_join", "WITH a AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, l_partkey, max(l_tax) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT a.l_orderkey, a.l_partkey, round(a.quantity, 6) AS quantity, b.quantity AS quantity_other FROM a LEFT JOIN b USING (l_orderkey, l_partkey)")
def j4_composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"]
    a = rows.groupBy(*keys).agg(F.round(F.sum("l_quantity"), 6).alias("quantity"))
    b = rows.where("l_returnflag = 'R'").groupBy(*keys).agg(F.max("l_tax").alias("quantity_other"))
    return a.join(b, keys, "left")


@query("j6_group_presence", "WITH g AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY 1) SELECT o_orderkey, n_priorities FROM orders JOIN g USING (o_custkey)")
def j6_group_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.join(orders.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n_priorities")), "o_custkey").select("o_orderkey", "n_priorities")


@query("j9_j10_membership", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS returned FROM part")
def j9_j10_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return J.membership(load(spark, sf_dir, "part"), gone, ["p_partkey"], "returned").select("p_partkey", "returned")


@query("j10_remaining_work", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j10_remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import remaining

    return remaining(load(spark, sf_dir, "orders").select("o_orderkey"), load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("j12_correlated_pairs", f"WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(1, 65)) AS i, e FROM v) SELECT a.i::INT AS i, b.i::INT AS j, round(corr(a.e[a.i], b.e[b.i]), 6) AS r FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2 HAVING abs(corr(a.e[a.i], b.e[b.i])) >= 0.02")
def j12_correlated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = T.correlation_matrix(vectors(spark, sf_dir), "e", 64)
    return told.where(F.abs("r") >= 0.02).select("i", "j", F.round("r", 6).alias("r"))


@query("j15_nearest_other", f"WITH {VECTORS} SELECT a.vec_id, round(sqrt(min({SQUARE})), 6) AS nn_distance FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1")
def j15_nearest_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return J.nearest(rows, rows, "vec_id", "e", exclude_self=True).withColumn("nn_distance", F.round("nn_distance", 6))


@query("j16_nearest_in_target", f"WITH {VECTORS} SELECT a.vec_id, round(sqrt(min({SQUARE})), 6) AS nn_distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1")
def j16_nearest_in_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return J.nearest(rows, rows, "vec_id", "e", exclude_self=True, block="label").withColumn("nn_distance", F.round("nn_distance", 6))


@query("j17_band_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 2.5")
def j17_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.within_band(load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer"), "s_acctbal", "c_acctbal", 2.5).select("s_suppkey", "c_custkey")


@query("j18_consistency", "WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders), b AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT o_orderkey FROM a FULL JOIN b USING (o_orderkey) WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 1000")
def j18_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    b = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    return J.mismatches(a, b, ["o_orderkey"], ["v"], 1000.0)


@query("j19_plan_and_actual", "WITH a AS (SELECT o_orderpriority AS target, count(*) AS planned FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS target, count(*) AS made FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1) SELECT target, planned, coalesce(made, 0) AS made FROM a LEFT JOIN b USING (target)")
def j19_plan_and_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    # lines are counted by order before they meet the orders
    made = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n")).join(orders, "o_orderkey").groupBy(F.col("o_orderpriority").alias("target")).agg(F.sum("n").alias("made"))
    plan = orders.groupBy(F.col("o_orderpriority").alias("target")).agg(F.count(F.lit(1)).alias("planned"))
    return plan.join(made, "target", "left").select("target", "planned", F.coalesce("made", F.lit(0)).alias("made"))


@query("u1_u2_union_first", "WITH u AS (SELECT text, 0 AS source_rank, item_id AS id FROM benchmark UNION ALL SELECT text, 1, doc_id FROM documents UNION ALL SELECT text, 2, conv_id FROM conversations) SELECT md5(text) AS digest, source_rank, id FROM u WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY source_rank, id) = 1")
def u1_u2_union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (("benchmark", "item_id"), ("documents", "doc_id"), ("conversations", "conv_id"))
    frames = [load(spark, sf_dir, t).where("text is not null").select(F.md5("text").alias("digest"), F.col(k).alias("id")) for t, k in tables]
    return J.union_first(frames, ["digest"], ["id"]).select("digest", "source_rank", "id")


@query("u4_set_difference", "(SELECT l_partkey AS k, 'left' AS side FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_partkey, 'left' FROM lineitem WHERE l_discount > 0.09) UNION ALL (SELECT l_partkey, 'right' FROM lineitem WHERE l_discount > 0.09 EXCEPT SELECT l_partkey, 'right' FROM lineitem WHERE l_quantity > 49)")
def u4_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    a, b = rows.where("l_quantity > 49").select(F.col("l_partkey").alias("k")), rows.where("l_discount > 0.09").select(F.col("l_partkey").alias("k"))
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


@query("w4_first_by_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w4_first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.first_by(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("t3_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def t3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("t5_extremes_by_key", "SELECT p_brand, arg_min(p_partkey, p_retailprice * 1000000 + p_partkey) AS cheapest, arg_max(p_partkey, p_retailprice * 1000000 - p_partkey) AS dearest FROM part GROUP BY 1")
def t5_extremes_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("p_retailprice") * 1000000
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", order + F.col("p_partkey")).alias("cheapest"), F.max_by("p_partkey", order - F.col("p_partkey")).alias("dearest"))


@query("t7_stratified_sample", "SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('42|' || p_partkey), p_partkey) <= 3")
def t7_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stratified_sample(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 3, 42)


@query("t16_stratified_folds", "WITH {S}, x AS (SELECT sample_idx, coalesce(lang, 'none') AS stratum, unnest([42, 43, 44]) AS seed FROM s) SELECT seed, sample_idx, ((row_number() OVER (PARTITION BY seed, stratum ORDER BY md5(seed || '|' || sample_idx), sample_idx) - 1) % 5)::INT AS fold FROM x")
def t16_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).select("sample_idx", F.coalesce("lang", F.lit("none")).alias("stratum"))
    return D.stratified_folds(rows, "stratum", "sample_idx", [42, 43, 44]).select("seed", "sample_idx", "fold")


@query("t13_largest_remainder", "WITH e AS (SELECT p_brand, p_partkey, p_size, 100.0 * p_size / sum(p_size) OVER (PARTITION BY p_brand) AS e FROM part), f AS (SELECT *, floor(e) AS f FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(e - f, 9) DESC, p_partkey) AS r, 100 - sum(f) OVER (PARTITION BY p_brand) AS more FROM f) SELECT p_partkey, (f + (r <= more)::INT)::BIGINT AS allocated FROM r")
def t13_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.largest_remainder(load(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_size", 100, ["p_brand"], "p_partkey").select("p_partkey", "allocated")


@query(
    "t9_weighted_draws",
    "WITH w AS (SELECT n_regionkey, n_nationkey, (n_nationkey % 5 + 1) / sum(n_nationkey % 5 + 1) OVER (PARTITION BY n_regionkey) AS p FROM nation), i AS (SELECT *, sum(p) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS hi FROM w),"
    " d AS (SELECT r_regionkey, unnest(range(1, 21))::INT AS draw FROM region), u AS (SELECT *, ('0x' || substr(md5('7|' || r_regionkey || '|' || draw), 1, 8))::BIGINT / 4294967296.0 AS u FROM d) SELECT n_regionkey, draw, n_nationkey FROM u JOIN i ON r_regionkey = n_regionkey AND u >= hi - p AND u < hi",
)
def t9_weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") % 5 + 1).cast("double").alias("w"))
    return D.weighted_draws(rows, "w", 20, ["n_regionkey"], "n_nationkey", 7).select("n_regionkey", "draw", "n_nationkey")


@query(
    "t11_t12_joint_permutation",
    "WITH {S}, x AS (SELECT sample_idx, coalesce(lang, 'none') AS g, y, n_chars FROM s), a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sample_idx) AS n FROM x), b AS (SELECT g, y AS y_permuted, n_chars AS n_chars_permuted, row_number() OVER (PARTITION BY g ORDER BY md5('42|1|' || sample_idx), sample_idx) AS n FROM x)"
    " SELECT sample_idx, y_permuted, n_chars_permuted FROM a JOIN b USING (g, n)",
)
def t11_t12_joint_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).select("sample_idx", F.coalesce("lang", F.lit("none")).alias("g"), "y", "n_chars")
    return D.permuted(rows, "sample_idx", ["y", "n_chars"], ["g"], [42, 1]).select("sample_idx", "y_permuted", "n_chars_permuted")


@query("m5_m6_unit_vectors", f"WITH {VECTORS} SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS length, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first FROM v")
def m5_m6_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    return vectors(spark, sf_dir).select("vec_id", F.round(V.norm(e), 6).alias("length"), F.round(F.get(V.unit_vector(e), 0), 6).alias("first"))
