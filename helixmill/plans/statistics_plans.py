"""Queries of statistics: ranks, bins, adjusted p-values, metrics, profiles and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as T
from ..functions import transforms as X
from .base import load, query, sequences


@query("w1_w8_average_ranks", "WITH {S}, r AS (SELECT sample_idx, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS k FROM s) SELECT sample_idx, k::DOUBLE AS rank, round(k / count(*) OVER (), 9) AS percent FROM r")
def w1_w8_average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).select("sample_idx", "y")
    ranked = T.average_ranks(T.average_ranks(rows, "y", "rank"), "y", "percent", percent=True)
    return ranked.select("sample_idx", "rank", F.round("percent", 9).alias("percent"))


@query(
    "w2_benjamini_hochberg",
    "WITH p AS (SELECT p_partkey, least(p_retailprice / 10000, 1.0) AS p FROM part), r AS (SELECT p, count(*) OVER (ORDER BY p) AS upto, count(*) OVER () AS n FROM p), d AS (SELECT p, max(p * n / upto) AS raw FROM r GROUP BY p),"
    " q AS (SELECT p, least(min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM d) SELECT p_partkey, round(p.p, 9) AS p, round(q, 9) AS q FROM p JOIN q ON p.p = q.p",
)
def w2_benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", F.least(F.col("p_retailprice") / 10000, F.lit(1.0)).alias("p"))
    return T.benjamini_hochberg(rows, "p").select("p_partkey", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


METRICS = ", ".join(
    (
        "round(1 - avg((y - pred) ** 2) / var_pop(y), 6) AS r2",
        "round(corr(y, pred), 6) AS pearson_r",
        "round(sqrt(avg((y - pred) ** 2)), 6) AS rmse",
        "round(avg(abs(y - pred)), 6) AS mae",
    )
)


@query("a5_regression_metrics", f"WITH {{S}} SELECT lang, count(*) AS n, {METRICS} FROM s GROUP BY lang")
def a5_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *T.regression_metrics("y", "pred"))
    return rows.select("lang", "n", *(F.round(c, 6).alias(c) for c in ("r2", "pearson_r", "rmse", "mae")))


@query(
    "a5_spearman_by_language",
    "WITH {S}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY pred) + (count(*) OVER (PARTITION BY lang, pred) - 1) / 2.0 AS b FROM s WHERE lang IS NOT NULL) SELECT lang, round(corr(a, b), 6) AS spearman_r, count(*) AS n FROM r GROUP BY lang",
)
def a5_spearman_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spearman(sequences(spark, sf_dir).where("lang is not null"), "y", "pred", ("lang",)).withColumn("spearman_r", F.round("spearman_r", 6))


@query(
    "m15_quantile_bin_profile",
    "WITH {S}, e AS (SELECT list_distinct(quantile_cont(n_chars, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM s), b AS (SELECT s.*, greatest(len(list_filter(edges, lambda x: x < n_chars)) - 1, 0)::INT AS bin FROM s, e) SELECT bin, round(median(n_chars), 6) AS median_x, round(avg(y), 6) AS mean_y, round(avg(pred), 6) AS mean_pred, count(*) AS n FROM b GROUP BY bin",
)
def m15_quantile_bin_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.quantile_bins(sequences(spark, sf_dir), "n_chars", 5)
    return rows.groupBy("bin").agg(F.round(F.median("n_chars"), 6).alias("median_x"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.avg("pred"), 6).alias("mean_pred"), F.count(F.lit(1)).alias("n"))


@query("m15_equal_width_bins", "WITH v AS (SELECT p_partkey, (p_partkey % 101) / 100.0 AS x FROM part) SELECT greatest(ceil(round(x * 50, 9)) - 1, 0)::INT AS bin, count(*) AS n FROM v GROUP BY 1")
def m15_equal_width_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_partkey") % 101 / 100.0
    # edges and values are compared at nine digits
    edge = F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.round(i / 50.0, 9))
    return load(spark, sf_dir, "part").select(T.bin_of(F.round(x, 9), edge).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a22_weighted_median",
    "WITH g AS (SELECT p_brand, p_retailprice AS v, sum(p_size) AS w FROM part GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY v) AS upto, sum(w) OVER (PARTITION BY p_brand) AS total FROM g) SELECT p_brand, min(v) AS weighted_median FROM c WHERE upto >= 0.5 * total GROUP BY p_brand",
)
def a22_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.weighted_median(load(spark, sf_dir, "part"), "p_retailprice", "p_size", ("p_brand",))


@query(
    "a19_a21_scales",
    "SELECT p_brand, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 6) AS scale, round(0.9 * least(stddev_samp(p_retailprice), (quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25)) / 1.349) * pow(count(*), -0.2), 6) AS bandwidth FROM part GROUP BY p_brand HAVING count(*) > 1",
)
def a19_a21_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.scales(load(spark, sf_dir, "part"), "p_retailprice", ("p_brand",))
    return rows.where("n > 1").select("p_brand", F.round("scale", 6).alias("scale"), F.round("bandwidth", 6).alias("bandwidth"))


@query(
    "a23_kernel_weights",
    "WITH t AS (SELECT DISTINCT p_size AS target FROM part WHERE p_size <= 5), d AS (SELECT target, p_partkey, exp(-0.5 * pow((p_size - target) / 4.0, 2)) AS k FROM part, t WHERE abs(p_size - target) <= 12) SELECT target, p_partkey, round(k / sum(k) OVER (PARTITION BY target), 9) AS weight FROM d",
)
def a23_kernel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import within_band

    part = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    grid = part.select(F.col("p_size").alias("target")).where("target <= 5").distinct()
    near = within_band(part, grid, "p_size", "target", 12.0).withColumn("k", F.exp(-0.5 * F.pow((F.col("p_size") - F.col("target")) / 4.0, F.lit(2))))
    total = near.groupBy("target").agg(F.sum("k").alias("total"))  # summed before it meets the rows: a target may hold most
    return near.join(F.broadcast(total), "target").select("target", "p_partkey", F.round(F.col("k") / F.col("total"), 9).alias("weight"))


@query("a33_regression_lines", "WITH {S} SELECT lang, round(regr_slope(pred, y), 6) AS slope, round(regr_intercept(pred, y), 6) AS intercept FROM s GROUP BY lang")
def a33_regression_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).groupBy("lang").agg(F.round(F.regr_slope("pred", "y"), 6).alias("slope"), F.round(F.regr_intercept("pred", "y"), 6).alias("intercept"))


MEASURES = ("p_size", "p_retailprice")


@query(
    "a2_metric_summary",
    "WITH l AS (SELECT 'p_size' AS metric, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS low, max(v) AS high FROM l GROUP BY metric",
)
def a2_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = load(spark, sf_dir, "part").select(*(F.col(c).cast("double").alias(c) for c in MEASURES)).unpivot([], list(MEASURES), "metric", "v")
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))


@query(
    "a31_rank_correlation_pairs",
    "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS q, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS p, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS d FROM lineitem)"
    " SELECT 'discount' AS left_column, 'price' AS right_column, round(corr(d, p), 6) AS rho FROM r UNION ALL SELECT 'discount', 'quantity', round(corr(d, q), 6) FROM r UNION ALL SELECT 'price', 'quantity', round(corr(p, q), 6) FROM r",
)
def a31_rank_correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    names = sorted(rows.columns)
    for c in names:
        rows = T.average_ranks(rows, c, f"{c}_rank")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = rows.agg(*(F.round(F.corr(f"{a}_rank", f"{b}_rank"), 6).alias(f"{a}|{b}") for a, b in pairs))
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "rho")
    return long.select(F.split("pair", "[|]")[0].alias("left_column"), F.split("pair", "[|]")[1].alias("right_column"), "rho")


@query(
    "a10_interaction_grid",
    "WITH {S}, e AS (SELECT list_distinct(quantile_cont(n_chars, [0, 0.25, 0.5, 0.75, 1.0])) AS edges FROM s), b AS (SELECT greatest(len(list_filter(edges, lambda x: x < n_chars)) - 1, 0)::INT AS bin, coalesce(lang, 'none') AS lang, y FROM s, e),"
    " spine AS (SELECT * FROM (SELECT DISTINCT bin FROM b), (SELECT DISTINCT lang FROM b)) SELECT spine.bin, spine.lang, count(y) AS n, round(avg(y), 6) AS mean_y FROM spine LEFT JOIN b ON spine.bin = b.bin AND spine.lang = b.lang GROUP BY 1, 2",
)
def a10_interaction_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.quantile_bins(sequences(spark, sf_dir).withColumn("lang", F.coalesce("lang", F.lit("none"))), "n_chars", 4)
    cells = rows.groupBy("bin", "lang").agg(F.count("y").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))
    # every pair of the few labels, whether it has rows or not
    labels = cells.agg(F.collect_set("bin").alias("bins"), F.collect_set("lang").alias("langs"))
    spine = labels.select(F.explode("bins").alias("bin"), "langs").select("bin", F.explode("langs").alias("lang"))
    return spine.join(cells, ["bin", "lang"], "left").select("bin", "lang", F.coalesce("n", F.lit(0)).alias("n"), "mean_y")


@query(
    "a26_per_target_summary",
    "WITH v AS (SELECT label AS target, vec_id, embedding[1]::DOUBLE AS te FROM embeddings) SELECT target, count(*) AS n_total, count(*) FILTER (te BETWEEN 0 AND 1) AS n_valid, round(avg((te BETWEEN 0 AND 1)::INT), 6) AS coverage, round(median(te), 6) AS te_median, round(avg(te), 6) AS te_mean, round(quantile_cont(te, 0.25), 6) AS te_q25, round(quantile_cont(te, 0.75), 6) AS te_q75, round(min(te), 6) AS te_min, round(max(te), 6) AS te_max,"
    " round(median(abs(te - 0.1)), 6) AS median_abs_error, round(avg(abs(te - 0.1)), 6) AS mean_abs_error, round(avg((abs(te - 0.1) <= 0.05)::INT), 6) AS within_0p05, round(avg((abs(te - 0.1) <= 0.1)::INT), 6) AS within_0p10, count(DISTINCT round(te, 3)) AS n_distinct FROM v GROUP BY target",
)
def a26_per_target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").alias("target"), F.get("embedding", 0).cast("double").alias("te"))
    te, inside, error = F.col("te"), F.col("te").between(0, 1), F.abs(F.col("te") - 0.1)
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return rows.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(inside).alias("n_valid"), share(inside).alias("coverage"), F.round(F.median(te), 6).alias("te_median"), F.round(F.avg(te), 6).alias("te_mean"),
        F.round(F.percentile(te, F.lit(0.25)), 6).alias("te_q25"), F.round(F.percentile(te, F.lit(0.75)), 6).alias("te_q75"), F.round(F.min(te), 6).alias("te_min"), F.round(F.max(te), 6).alias("te_max"),
        F.round(F.median(error), 6).alias("median_abs_error"), F.round(F.avg(error), 6).alias("mean_abs_error"), share(error <= 0.05).alias("within_0p05"), share(error <= 0.1).alias("within_0p10"), F.count_distinct(F.round(te, 3)).alias("n_distinct"),
    )


@query(
    "a27_target_agreement",
    "WITH t AS (SELECT label, avg(embedding[1]::DOUBLE) AS a, avg(embedding[2]::DOUBLE) AS b FROM embeddings GROUP BY label), r AS (SELECT *, rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM t), p AS (SELECT avg((sign(x.a - y.a) = sign(x.b - y.b))::INT) AS c FROM t x JOIN t y ON x.label < y.label AND x.a <> y.a)"
    " SELECT round(avg(abs(a - b)), 6) AS mae, round(median(abs(a - b)), 6) AS medae, round(max(abs(a - b)), 6) AS max_error, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(corr(a, b), 6) AS pearson_r, round(corr(ra, rb), 6) AS spearman_r, round(any_value(p.c), 6) AS concordance FROM r, p",
)
def a27_target_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import concordance

    vectors = load(spark, sf_dir, "embeddings")
    means = vectors.groupBy("label").agg(F.avg(F.get("embedding", 0).cast("double")).alias("a"), F.avg(F.get("embedding", 1).cast("double")).alias("b"))
    error = F.abs(F.col("a") - F.col("b"))
    one = means.agg(F.round(F.avg(error), 6).alias("mae"), F.round(F.median(error), 6).alias("medae"), F.round(F.max(error), 6).alias("max_error"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"), F.round(F.corr("a", "b"), 6).alias("pearson_r"))
    # three tables of one row
    ranks = T.spearman(means, "a", "b").select(F.round("spearman_r", 6).alias("spearman_r"))
    pairs = concordance(means, "label", "a", "b").select(F.round("concordance", 6).alias("concordance"))
    return one.crossJoin(F.broadcast(ranks)).crossJoin(F.broadcast(pairs))


@query(
    "a32_kernel_density",
    "WITH x AS (SELECT embedding[1]::DOUBLE AS v FROM embeddings), h AS (SELECT stddev_samp(v) * pow(count(*), -0.2) AS h FROM x), g AS (SELECT unnest(range(0, 21)) / 10.0 - 1 AS point) SELECT point::DOUBLE AS point, round(avg(exp(-0.5 * pow((point - v) / h, 2)) / (h * sqrt(2 * pi()))), 6) AS density FROM g, x, h GROUP BY point",
)
def a32_kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "embeddings").select(F.get("embedding", 0).cast("double").alias("v"))
    width = x.agg((F.stddev_samp("v") * F.pow(F.count("v").cast("double"), F.lit(-0.2))).alias("h"))
    # the grid is an array beside each row, so the sums are partial in every task
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: k / 10.0 - 1)
    kernel = F.exp(-0.5 * F.pow((F.col("point") - F.col("v")) / F.col("h"), F.lit(2))) / (F.col("h") * F.sqrt(2 * F.pi()))
    return x.crossJoin(F.broadcast(width)).withColumn("point", F.explode(points)).groupBy("point").agg(F.round(F.avg(kernel), 6).alias("density"))


@query("t6_quantile_threshold", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= (SELECT quantile_cont(p_retailprice, 0.8) FROM part)")
def t6_quantile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    cut = T.quantiles(part, "p_retailprice", {"cut": 0.8})
    return part.crossJoin(F.broadcast(cut)).where(F.col("p_retailprice") >= F.col("cut")).select("p_partkey", "p_retailprice")


@query("a36_shared_range", "WITH r AS (SELECT min(v) AS low, max(v) AS high FROM (SELECT l_discount AS v FROM lineitem UNION ALL SELECT l_tax FROM lineitem)) SELECT low, CASE WHEN abs(high - low) < 1e-8 THEN low + 1e-6 ELSE high END AS high FROM r")
def a36_shared_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").agg(F.least(F.min("l_discount"), F.min("l_tax")).alias("low"), F.greatest(F.max("l_discount"), F.max("l_tax")).alias("high"))
    return rows.select("low", F.when(X.is_close(F.col("high"), F.col("low"), 0.0), F.col("low") + 1e-6).otherwise(F.col("high")).alias("high"))


@query("a24_a28_attempt_funnel", "SELECT o_orderpriority AS target, count(*) AS attempts, count(*) FILTER (o_totalprice > 100000) AS valid, count(*) - count(*) FILTER (o_totalprice > 100000) AS rejected, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_custkey END) AS unique_valid FROM orders GROUP BY 1")
def a24_a28_attempt_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("o_totalprice") > 100000
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("target")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"), F.count_distinct(F.when(ok, F.col("o_custkey"))).alias("unique_valid"))


@query("a39_uncertainty_association", "WITH {S}, v AS (SELECT abs(y - pred) AS e, abs(pred) AS u FROM s WHERE y IS NOT NULL AND pred IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS a, rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0 AS b FROM v) SELECT round(corr(a, b), 5) AS rho, count(*) AS n FROM r")
def a39_uncertainty_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).select(F.abs(F.col("y") - F.col("pred")).alias("e"), F.abs("pred").alias("u"))
    return T.spearman(rows, "e", "u", name="rho").select(F.round("rho", 5).alias("rho"), "n")
