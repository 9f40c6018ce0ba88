"""Queries of contracts, sources and sinks, group tables, pooling and geometry comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as Q
from ..functions import statistics as S
from ..functions import transforms as X
from ..functions import vectors as V
from ..operators import contracts as C
from ..operators import joins as J
from ..operators.descriptors import describe, with_geometry
from ..operators.folds import evenly_spaced, stratified_folds
from ..operators.hairpin import hairpin
from ..sources import tables as B
from .base import geometry_sql, load, query, sequences
from .join_plans import vectors


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared one."""
    return f"{B.checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


PART = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_brand", T.StringType()), T.StructField("p_retailprice", T.DoubleType())])


@query("s1_s2_csv_scan", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def s1_s2_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as CSV, its header sniffed, and read by a stated schema."""
    path = folder(spark, "csv")
    load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice").write.csv(path, header=True)
    C.require_order(B.header(spark, path), PART.names)
    return B.read_csv(spark, path, PART)


@query("s4_json_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s4_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "json")
    load(spark, sf_dir, "nation").write.json(path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@query("s6_s7_best_source", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def s6_s7_best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of CSVs in several folders, the one that holds the columns, is named so and has most rows."""
    root, part = folder(spark, "sources"), load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    part.coalesce(1).write.csv(f"{root}/full_parts", header=True)
    part.where("p_partkey % 2 = 0").coalesce(1).write.csv(f"{root}/half_parts", header=True)
    part.select("p_brand").coalesce(1).write.csv(f"{root}/old/parts", header=True)
    files = B.find_files(spark, root, "*.csv", ("old",)).select("path")
    paths = [r[0] for r in files.orderBy("path").collect()]  # files of a folder that this query wrote
    return B.read_csv(spark, B.best_source(spark, paths, PART.names, ["parts"]), PART)


@query("s9_folder_provenance", "SELECT o_orderkey, o_orderstatus AS source_folder FROM orders")
def s9_folder_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written to a folder for each status and read with the folder's name."""
    root = folder(spark, "targets")
    for status in ("F", "O", "P"):
        load(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select("o_orderkey").write.csv(f"{root}/{status}", header=True)
    rows = B.read_folders(spark, root, T.StructType([T.StructField("o_orderkey", T.LongType())]))
    return rows.select("o_orderkey", "source_folder")


@query("s8_s13_s14_cached_groups", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 4")
def s8_s13_s14_cached_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached table, and its keys that are complete; a table that is missing adds none."""
    path = folder(spark, "cache")
    load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").write.parquet(path)
    B.require_files(spark, [path])
    schema = spark.read.parquet(path).schema
    rows = B.optional(spark, path, schema).unionByName(B.optional(spark, f"{path}-more", schema))
    return B.complete(rows, ["l_orderkey"], 4)


@query("s15_manifest", "SELECT count(*) AS n, round(sum(p_retailprice), 2) AS total, NULL::DOUBLE AS undefined FROM part")
def s15_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a run as a JSON file, in which what JSON lacks is null, read again."""
    path = folder(spark, "manifest")
    row = load(spark, sf_dir, "part").agg(F.count(F.lit(1)), F.round(F.sum("p_retailprice"), 2)).first()
    B.write_manifest(spark, path, {"n": row[0], "total": row[1], "undefined": float("nan")})
    return B.read_json(spark, path, T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("undefined", T.DoubleType())]))


@query("w9_resume_offsets", "WITH d AS (SELECT o_orderstatus AS job, max(n) + 1 AS done FROM (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1) SELECT o_orderkey, (coalesce(done, 0) + row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::BIGINT AS sample_number FROM orders LEFT JOIN d ON o_orderstatus = job WHERE o_orderkey % 3 <> 0")
def w9_resume_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("job"))
    none = rows.select("job", F.lit(0).cast("long").alias("sample_number")).where("false")
    done = B.with_offsets(rows.where("o_orderkey % 3 = 0"), none, "job", "o_orderkey")
    return B.with_offsets(rows.where("o_orderkey % 3 <> 0"), done, "job", "o_orderkey").select("o_orderkey", "sample_number")


@query("f5_f15_strict_numbers", "SELECT event_id, value, (event_id % 100)::INT AS whole FROM events")
def f5_f15_strict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from their texts, and whole numbers from doubles; anything else raises."""
    rows = load(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("t"), (F.col("event_id") % 100).cast("double").alias("w"))
    return rows.select("event_id", C.strict_number(F.col("t")).alias("value"), C.whole_number(F.col("w")).alias("whole"))


@query("f16_f20_resolved_columns", "SELECT l_orderkey AS key, l_quantity AS amount, l_tax AS rate, l_linenumber FROM lineitem")
def f16_f20_resolved_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns found by alias, part of a name or tokens, a fallback chain, and named columns first."""
    rows = load(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_quantity", "l_tax")
    C.require_columns(rows, ["l_orderkey"])
    key, amount, rate = C.resolve_column(rows, ["L OrderKey"]), C.resolve_column(rows, ["quantity"]), C.resolve_column(rows, ["levy"], [{"l", "tax"}])
    named = rows.select("l_linenumber", F.col(rate).alias("rate"), C.first_existing(rows, ["amount", amount]).alias("amount"), F.col(key).alias("key"))
    return C.prioritised(named, ["key", "amount", "absent"])


@query("f21_alignment", "WITH a AS (SELECT o_orderkey AS k, count(*) AS l FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS r FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), j AS (SELECT * FROM a FULL JOIN b USING (k)) SELECT coalesce(sum(l), 0)::BIGINT AS n_left, coalesce(sum(r), 0)::BIGINT AS n_right, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (l > 1 OR r > 1) AS repeated, count(*) FILTER (r IS NULL OR l IS NULL OR l > 1 OR r > 1) = 0 AS aligned FROM j")
def f21_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    return C.alignment(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), lines, ["k"])


@query(
    "f23_plan_checks",
    "WITH {S}, p AS (SELECT sample_idx, CASE WHEN sample_idx % 11 = 0 THEN substr(seq, 1, 19) || 'N' ELSE substr(seq, 1, 20) END AS prompt, CASE WHEN sample_idx % 7 = 0 THEN 19 ELSE 20 END AS pl, length(seq) - CASE WHEN sample_idx % 13 = 0 THEN length(seq) ELSE 20 END AS n, length(seq) AS t FROM s WHERE seq IS NOT NULL)"
    " SELECT sample_idx, CASE WHEN length(prompt) = pl AND pl + n = t AND n > 0 AND regexp_full_match(prompt, '[ACGT]+') THEN 'PASS' ELSE concat_ws(';', CASE WHEN length(prompt) <> pl THEN 'prompt_length' END, CASE WHEN pl + n <> t THEN 'target_length' END, CASE WHEN n <= 0 THEN 'positive_tokens' END, CASE WHEN NOT regexp_full_match(prompt, '[ACGT]+') THEN 'prompt_dna' END) END AS reason FROM p",
)
def f23_plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("sample_idx"), F.col("seq")
    prompt = F.when(i % 11 == 0, F.concat(F.substring(s, 1, 19), F.lit("N"))).otherwise(F.substring(s, 1, 20))
    rows = sequences(spark, sf_dir).where("seq is not null").select("sample_idx", prompt.alias("prompt"), F.when(i % 7 == 0, 19).otherwise(20).alias("prompt_length"), (F.length(s) - F.when(i % 13 == 0, F.length(s)).otherwise(20)).alias("n_tokens"), F.length(s).alias("target_length"))
    return rows.select("sample_idx", C.reasons(C.plan_checks()).alias("reason"))


@query(
    "f31_saved_column",
    "WITH {S}, v AS (SELECT round(y, 3) AS saved, y, 1 - pow(10, -y) AS te, pow(10, y) AS strength FROM s WHERE y IS NOT NULL), r AS (SELECT 'model_y' AS reading, count(*) AS n, avg(abs(saved - y)) AS m, max(abs(saved - y)) AS x FROM v UNION ALL SELECT 'te', count(*), avg(abs(saved - te)), max(abs(saved - te)) FROM v UNION ALL SELECT 'strength', count(*), avg(abs(saved - strength)), max(abs(saved - strength)) FROM v)"
    " SELECT reading, n, round(m, 4) AS mean_abs, round(x, 4) AS max_abs, row_number() OVER (ORDER BY m)::INT AS rank FROM r",
)
def f31_saved_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("y")
    rows = sequences(spark, sf_dir).where("y is not null").select("y", F.round("y", 3).alias("saved"))
    told = C.saved_column_report(rows, "saved", {"te": X.y_to_te(y), "strength": X.y_to_strength(y), "model_y": y})
    return told.select("reading", "n", F.round("mean_abs", 4).alias("mean_abs"), F.round("max_abs", 4).alias("max_abs"), F.col("rank"))


@query(
    "f32_quality_rows",
    "WITH w AS (SELECT o_orderpriority AS target, count(*) AS n_rows, count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)) AS price, count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false)) AS status FROM orders GROUP BY 1) SELECT target, n_rows, 'price' AS \"check\", price AS n_failed FROM w UNION ALL SELECT target, n_rows, 'status', status FROM w",
)
def f32_quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "target")
    return C.quality_rows(rows, ["target"], {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")})


@query("f33_grid_differences", "WITH a AS (SELECT DISTINCT p_size + CASE WHEN p_size = 7 THEN 0.3 ELSE 1e-7 END AS v FROM part WHERE p_size <> 9), g AS (SELECT unnest(range(1, 61))::DOUBLE AS b) SELECT 'unexpected' AS side, v AS value FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE abs(v - b) <= 1e-6) UNION ALL SELECT 'missing', b FROM g WHERE NOT EXISTS (SELECT 1 FROM a WHERE abs(v - b) <= 1e-6)")
def f33_grid_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").where("p_size <> 9").select((F.col("p_size") + F.when(F.col("p_size") == 7, 0.3).otherwise(1e-7)).alias("v"))
    return C.grid_differences(rows, "v", spark.range(1, 61).select(F.col("id").cast("double").alias("b")), 1e-6)


@query("a1_duplicate_groups", "SELECT md5(text) AS digest, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, round(stddev_samp(doc_id), 6) AS sd_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def a1_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").where("text is not null").groupBy(F.md5("text").alias("digest"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.stddev_samp("doc_id"), 6).alias("sd_id")).where("n > 1")


SEEDS = (42, 43, 44)
NOISE_SQL = "(('0x' || substr(md5(seed || '|' || sample_idx), 1, 6))::BIGINT % 1000 - 500) / 5000.0"


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, fold, sample_idx, y, told): stand-in predictions of repeated stratified folds."""
    rows = sequences(spark, sf_dir).where("y is not null").select("sample_idx", "y", F.coalesce("lang", F.lit("none")).alias("stratum"))
    noise = (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("sample_idx").cast("string"))), 1, 6), 16, 10).cast("long") % 1000 - 500) / 5000.0
    return stratified_folds(rows, "stratum", "sample_idx", list(SEEDS)).select("seed", "fold", "sample_idx", "y", (F.col("y") + noise).alias("told"))


REPEATED_SQL = f"WITH {{S}}, x AS (SELECT sample_idx, y, coalesce(lang, 'none') AS stratum, unnest({list(SEEDS)}) AS seed FROM s WHERE y IS NOT NULL), o AS (SELECT seed, sample_idx, y, ((row_number() OVER (PARTITION BY seed, stratum ORDER BY md5(seed || '|' || sample_idx), sample_idx) - 1) % 5)::INT AS fold, y + {NOISE_SQL} AS told FROM x)"


@query("a3_a4_ensemble_mean_and_sd", REPEATED_SQL + " SELECT sample_idx, count(*) AS n, round(sum(told) / count(*), 6) AS mean, round(stddev_samp(told), 6) AS sd FROM o GROUP BY sample_idx")
def a3_a4_ensemble_mean_and_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over repeats of each row's out-of-fold predictions: sums and counts by row."""
    rows = repeated(spark, sf_dir).groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n"), (F.sum("told") / F.count(F.lit(1))).alias("mean"), F.stddev_samp("told").alias("sd"))
    return rows.select("sample_idx", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("a12_fold_table", REPEATED_SQL + ", m AS (SELECT seed, fold, round(sqrt(avg((y - told) ** 2)), 6) AS rmse FROM o GROUP BY 1, 2) SELECT seed, " + ", ".join(f"any_value(rmse) FILTER (fold = {k}) AS fold_{k}" for k in range(5)) + " FROM m GROUP BY seed")
def a12_fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeat's folds beside each other: a pivot of values that are there once."""
    error = F.col("y") - F.col("told")
    rows = repeated(spark, sf_dir).groupBy("seed", "fold").agg(F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"))
    wide = rows.groupBy("seed").pivot("fold", list(range(5))).agg(F.first("rmse"))
    return wide.select("seed", *(F.col(str(k)).alias(f"fold_{k}") for k in range(5)))


@query(
    "a22_weighted_mad",
    "WITH g AS (SELECT p_brand, p_retailprice AS v, sum(p_size) AS w FROM part GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY v) AS upto, sum(w) OVER (PARTITION BY p_brand) AS total FROM g), m AS (SELECT p_brand, min(v) AS centre FROM c WHERE upto >= 0.5 * total GROUP BY p_brand),"
    " h AS (SELECT p_brand, abs(p_retailprice - centre) AS v, sum(p_size) AS w FROM part JOIN m USING (p_brand) GROUP BY 1, 2), d AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY v) AS upto, sum(w) OVER (PARTITION BY p_brand) AS total FROM h) SELECT p_brand, round(min(v), 6) AS weighted_mad FROM d WHERE upto >= 0.5 * total GROUP BY p_brand",
)
def a22_weighted_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weighted_mad(load(spark, sf_dir, "part"), "p_retailprice", "p_size", ("p_brand",)).withColumn("weighted_mad", F.round("weighted_mad", 6))


@query(
    "a31_descriptor_matrix",
    "WITH {S}, {G}, {D}, l AS (SELECT sample_idx, feature, value FROM (SELECT sample_idx, " + ", ".join(f'round("{c}", 9) AS "{c}"' for c in Q.FEATURES) + " FROM d) UNPIVOT (value FOR feature IN (" + ", ".join(f'"{c}"' for c in Q.FEATURES) + ")))"
    ", r AS (SELECT sample_idx, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS k FROM l)"
    " SELECT a.feature AS left_column, b.feature AS right_column, CASE WHEN var_pop(a.k) > 0 AND var_pop(b.k) > 0 THEN round(corr(a.k, b.k), 6) END AS rho FROM r a JOIN r b ON a.sample_idx = b.sample_idx AND a.feature < b.feature GROUP BY 1, 2",
)
def a31_descriptor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of all pairs of the 29 descriptors: ranks by feature, then all pairs in one aggregate of one row."""
    rows = describe(sequences(spark, sf_dir).where("seq is not null")).select("sample_idx", *(F.round(c, 9).alias(c) for c in Q.FEATURES))
    long = B.kept(rows, "descriptors").unpivot(["sample_idx"], list(Q.FEATURES), "feature", "value")
    wide = S.average_ranks(long, "value", "rank", ("feature",)).groupBy("sample_idx").pivot("feature", list(Q.FEATURES)).agg(F.first("rank"))
    names = sorted(Q.FEATURES)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = B.kept(wide, "ranks").agg(*(S.correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    told = F.array(*(F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.round(f"c{i}", 6).alias("rho")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(told))


@query("a34_geometry_medians", "WITH {S}, {G}, r AS (SELECT lang, (loop_start - stem_start)::DOUBLE AS loop_offset, (hairpin_end - stem_start)::DOUBLE AS hairpin_size, (length(seq) - hairpin_end)::DOUBLE AS tail FROM s JOIN g USING (sample_idx)) SELECT lang, round_even(median(loop_offset), 0) AS loop_offset, round_even(median(hairpin_size), 0) AS hairpin_size, round_even(median(tail), 0) AS tail FROM r GROUP BY lang")
def a34_geometry_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of places relative to the stem, rounded half to even."""
    g = F.col("geom")
    rows = with_geometry(sequences(spark, sf_dir)).where(g.isNotNull())
    middle = lambda c, n: F.bround(F.median(c.cast("double")), 0).alias(n)
    return rows.groupBy("lang").agg(middle(g["loop_start"] - g["stem_start"], "loop_offset"), middle(g["hairpin_end"] - g["stem_start"], "hairpin_size"), middle(F.length("seq") - g["hairpin_end"], "tail"))


PLACES = ("stem_start", "stem_length", "loop_length", "hairpin_end")
GEOMETRIES_SQL = "WITH {S}, {G}, " + geometry_sql("h", 8, 12) + ", j AS (SELECT s.sample_idx, lang, " + ", ".join(f"coalesce(g.{c}, -1) AS a_{c}, coalesce(h.{c}, -1) AS b_{c}" for c in PLACES) + " FROM s LEFT JOIN g ON g.sample_idx = s.sample_idx LEFT JOIN h ON h.sample_idx = s.sample_idx)"


def geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_idx, lang, a, b): the stored geometry, here the one with free flanks, and the one computed anew."""
    rows = sequences(spark, sf_dir).select("sample_idx", "lang", "seq")
    stored = B.kept(rows.select("sample_idx", hairpin(F.col("seq"), 8, 12).alias("b")), "geometry")
    return with_geometry(rows, name="a").drop("seq").join(stored, "sample_idx")


def same_place(c: str) -> F.Column:
    return F.coalesce(F.col(f"a.{c}"), F.lit(-1)) == F.coalesce(F.col(f"b.{c}"), F.lit(-1))


@query("a37_geometry_match", GEOMETRIES_SQL + " SELECT lang, count(*) AS n, " + ", ".join(f"round(avg((a_{c} = b_{c})::INT), 6) AS {c}" for c in PLACES) + " FROM j GROUP BY lang")
def a37_geometry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows whose stored geometry is found again, by column."""
    return geometries(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(same_place(c).cast("int")), 6).alias(c) for c in PLACES))


@query("a37_geometry_mismatches", GEOMETRIES_SQL + " SELECT sample_idx, a_stem_start AS found_start, b_stem_start AS stored_start, a_stem_length AS found_length, b_stem_length AS stored_length FROM j WHERE " + " OR ".join(f"a_{c} <> b_{c}" for c in PLACES))
def a37_geometry_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = same_place(PLACES[0])
    for c in PLACES[1:]:
        same = same & same_place(c)
    place = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return geometries(spark, sf_dir).where(~same).select("sample_idx", place("a.stem_start").alias("found_start"), place("b.stem_start").alias("stored_start"), place("a.stem_length").alias("found_length"), place("b.stem_length").alias("stored_length"))


@query(
    "c22_c23_names",
    "SELECT c_custkey, regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '', 'g') AS name, 'te_' || replace(printf('%.2f', (c_custkey % 100) / 100.0), '.', 'p') AS label, round((c_custkey % 100) / 100.0, 2) AS target, printf('%02d:%02d:%02d', c_custkey // 3600, c_custkey % 3600 // 60, c_custkey % 60) AS duration, c_custkey % 2 = 0 AS flag FROM customer",
)
def c22_c23_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    label = X.target_label(F.round((key % 100) / 100.0, 2))
    flag = F.when(key % 4 == 0, " TRUE").when(key % 4 == 2, "yes").when(key % 4 == 1, "no").otherwise("0")
    rows = load(spark, sf_dir, "customer").select("c_custkey", X.safe_name(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("name"), label.alias("label"), X.duration(key).alias("duration"), X.parse_boolean(flag).alias("flag"))
    return rows.withColumn("target", X.label_target(F.col("label")))


@query("m3_convergence", "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT vec_id, round(CASE WHEN sign(a) = sign(b) AND a <> 0 THEN sqrt(abs(a * b)) ELSE 0 END, 6) AS convergence FROM v")
def m3_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.round(X.convergence(F.get("e", 0), F.get("e", 1)), 6).alias("convergence"))


@query(
    "j17_band_or_nearest",
    "WITH t AS (SELECT unnest([-900.0, 0.0, 5000.0, 20000.0]) AS target), n AS (SELECT target, s_suppkey FROM supplier, t WHERE abs(s_acctbal - target) <= 400), f AS (SELECT target FROM n GROUP BY 1 HAVING count(*) >= 5),"
    " r AS (SELECT target, s_suppkey FROM supplier, t WHERE target NOT IN (SELECT target FROM f) QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs(s_acctbal - target), s_suppkey) <= 5) SELECT target::DOUBLE AS target, s_suppkey, false AS fallback FROM n WHERE target IN (SELECT target FROM f) UNION ALL SELECT target::DOUBLE, s_suppkey, true FROM r",
)
def j17_band_or_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in (-900.0, 0.0, 5000.0, 20000.0)))).alias("target"))
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return J.band_or_nearest(rows, grid, "s_acctbal", "target", 400.0, 5, "s_suppkey").select("target", "s_suppkey", "fallback")


RULED = ("gc_content", "freq_A", "max_poly_t_run", "stem_length", "loop_length", "spacer_length", "stem_pairing_score", "positional_poly_t_score")


@query(
    "m7_rule_distance",
    "WITH {S}, {G}, {D}, q AS (SELECT " + ", ".join(f'quantile_cont("{c}", 0.5) AS c{i}, quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) AS s{i}, stddev_pop("{c}") AS d{i}' for i, c in enumerate(RULED)) + " FROM d) SELECT sample_idx, round(" + " + ".join(f'{(i + 1) / 10} * abs("{c}" - c{i}) / CASE WHEN s{i} > 1e-12 THEN s{i} WHEN d{i} > 1e-12 THEN d{i} ELSE 1 END' for i, c in enumerate(RULED)) + ", 6) AS rule_distance FROM d, q",
)
def m7_rule_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted distance of each row from a rule profile, summed over its features."""
    rows = B.kept(describe(sequences(spark, sf_dir)).select("sample_idx", *RULED), "descriptors")
    profile = None
    for i, c in enumerate(RULED):
        one = S.quantiles(rows, c, {f"c{i}": 0.5, f"l{i}": 0.25, f"h{i}": 0.75})
        profile = one if profile is None else profile.crossJoin(F.broadcast(one))  # rows of one
    spread = rows.agg(*(F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(RULED)))
    scale = lambda i: F.when(F.col(f"h{i}") - F.col(f"l{i}") > 1e-12, F.col(f"h{i}") - F.col(f"l{i}")).when(F.col(f"d{i}") > 1e-12, F.col(f"d{i}")).otherwise(1.0)
    total = V.weighted_l1_sum([(F.col(c), F.col(f"c{i}"), scale(i), F.lit((i + 1) / 10)) for i, c in enumerate(RULED)])
    return rows.crossJoin(F.broadcast(profile.crossJoin(F.broadcast(spread)))).select("sample_idx", F.round(total, 6).alias("rule_distance"))


@query(
    "m8_m9_pooled_vectors",
    "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT vec_id, k, list_slice(e, k * 8 + 1, k * 8 + 8) AS part FROM v, (SELECT unnest(range(0, 8)) AS k)), m AS (SELECT vec_id, j, avg(part[j]) AS p FROM t, (SELECT unnest(range(1, 9)) AS j) WHERE (vec_id + k) % 3 > 0 GROUP BY 1, 2), l AS (SELECT vec_id, j, avg(part[j]) AS p FROM t, (SELECT unnest(range(1, 9)) AS j) WHERE k IN (6, 7) GROUP BY 1, 2),"
    " u AS (SELECT vec_id, j AS dim, p FROM m UNION ALL SELECT vec_id, j + 8, p FROM l) SELECT vec_id, dim::INT AS dim, round(p, 6) AS value FROM u",
)
def m8_m9_pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked mean over eight token vectors, and the mean of the last two, end to end."""
    rows = vectors(spark, sf_dir).withColumn("tokens", V.parts(F.col("e"), 8, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.col("vec_id") + k) % 3 > 0)
    pooled = F.concat(V.masked_mean(F.col("tokens"), mask, 8), V.mean_of([F.get("tokens", 6), F.get("tokens", 7)]))
    return rows.select("vec_id", F.posexplode(pooled).alias("dim", "value")).select("vec_id", (F.col("dim") + 1).alias("dim"), F.round("value", 6).alias("value"))


@query(
    "m18_bias_and_error_bars",
    "SELECT label AS target, round(median(v) - label / 10.0, 6) AS bias, round(median(v) - quantile_cont(v, 0.25), 6) AS error_below, round(quantile_cont(v, 0.75) - median(v), 6) AS error_above FROM (SELECT label, embedding[1]::DOUBLE AS v FROM embeddings) GROUP BY label",
)
def m18_bias_and_error_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median's distance from each target, and the quartiles' from the median."""
    rows = vectors(spark, sf_dir).select(F.col("label").alias("target"), F.get("e", 0).alias("v"))
    q = S.quantiles(rows, "v", {"low": 0.25, "mid": 0.5, "high": 0.75}, ("target",))
    return q.select("target", F.round(F.col("mid") - F.col("target") / 10.0, 6).alias("bias"), F.round(F.col("mid") - F.col("low"), 6).alias("error_below"), F.round(F.col("high") - F.col("mid"), 6).alias("error_above"))


@query("t8_evenly_spaced", "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS p, count(*) OVER () AS n FROM part) SELECT p_partkey FROM r WHERE p IN (SELECT round_even(k * (n - 1) / 6.0, 0)::BIGINT FROM (SELECT unnest(range(0, 7)) AS k))")
def t8_evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evenly_spaced(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 7)


@query("a35_first_present", "SELECT doc_id, coalesce(nullif(lang, ''), nullif(source, ''), 'none') AS label FROM documents")
def a35_first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("lang", "source")))
    return rows.select("doc_id", C.first_existing(rows, ["label", "lang", "source"], F.lit("none")).alias("label"))
