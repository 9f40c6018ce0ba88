"""Queries over sequences: cleaning, descriptors, hairpins, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..functions import transforms as X
from ..operators.descriptors import annotate_regions, describe, external_scores, with_geometry
from .base import geometry_sql, query, rounded, rounded_sql, sequences

COMPOSITION = [*Q.FEATURE_GROUPS["Sequence composition"], *Q.FEATURE_GROUPS["3-mer motifs"]]


@query(
    "c1_sequence_composition",
    "WITH {S}, v AS (SELECT lang, (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / CAST(length(seq) AS DOUBLE) AS gc, coalesce(list_max(list_transform(regexp_extract_all(seq, 'T+'), lambda r: length(r))), 0) AS run FROM s)"
    " SELECT lang, count(*) AS n, round(avg(gc), 6) AS mean_gc, round(stddev_samp(gc), 6) AS sd_gc, max(run) AS longest_t_run FROM v GROUP BY lang",
)
def c1_sequence_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Q.composition(F.col("seq"))
    rows = sequences(spark, sf_dir).where(Q.is_dna(F.col("seq"))).select("lang", own["gc_content"].alias("gc"), own["max_poly_t_run"].cast("long").alias("run"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gc"), 6).alias("mean_gc"), F.round(F.stddev_samp("gc"), 6).alias("sd_gc"), F.max("run").alias("longest_t_run"))


@query("c2_c4_composition_features", "WITH {S}, {G}, {D} SELECT sample_idx, " + rounded_sql(COMPOSITION) + " FROM d")
def c2_c4_composition_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("sample_idx", *(F.round(c, 6).alias(n) for n, c in Q.composition(F.col("seq")).items()))


GEOMETRY = ["stem_start", "stem_length", "loop_length", "loop_start", "loop_end", "hairpin_end", "gu_count"]


@query("c5_hairpin_best", "WITH {S}, {G} SELECT sample_idx, " + ", ".join(GEOMETRY) + ", round(score, 6) AS score, round(pair_fraction, 6) AS pair_fraction, round(proximal_gc, 6) AS proximal_gc FROM g")
def c5_hairpin_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_geometry(sequences(spark, sf_dir)).where("geom is not null").select("sample_idx", "geom.*")
    return rows.select("sample_idx", *GEOMETRY, *rounded(["score", "pair_fraction", "proximal_gc"]))


@query("c7_c10_all_descriptors", "WITH {S}, {G}, {D} SELECT sample_idx, " + rounded_sql(list(Q.FEATURES)) + " FROM d")
def c7_c10_all_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(sequences(spark, sf_dir)).select("sample_idx", *rounded(list(Q.FEATURES)))


REGION_SQL = f"""WITH {{S}}, {geometry_sql('h', 8, 12)}, r AS (SELECT s.sample_idx, h.sample_idx IS NOT NULL AS eligible, CASE WHEN h.sample_idx IS NULL THEN 'no_context_compatible_hairpin' ELSE 'OK' END AS status,
  translate(substr(seq, stem_start - 7, 8), 'T', 'U') AS a_tract, translate(substr(seq, stem_start + 1, stem_length), 'T', 'U') AS first_half, translate(substr(seq, loop_start + 1, loop_length), 'T', 'U') AS loop,
  translate(substr(seq, loop_end + 1, stem_length), 'T', 'U') AS second_half, translate(substr(seq, hairpin_end + 1, 12), 'T', 'U') AS u_tract, score AS annotated_score FROM s LEFT JOIN h ON s.sample_idx = h.sample_idx)"""
REGIONS = ["eligible", "status", "a_tract", "first_half", "loop", "second_half", "u_tract", "annotated_score"]


@query("c17_region_annotation", REGION_SQL + " SELECT sample_idx, " + ", ".join(REGIONS) + " FROM r")
def c17_region_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate_regions(sequences(spark, sf_dir)).select("sample_idx", *REGIONS)


def share(letters: str, of: str, n: str) -> str:
    return " + ".join(f"(length({of}) - length(replace({of}, '{c}', '')))" for c in letters).join(("(", f") / CAST({n} AS DOUBLE)"))


def entropy_sql(of: str, n: str) -> str:
    parts = [share(c, of, n) for c in "ACGU"]
    total = "(" + " + ".join(parts) + ")"
    return "(" + " + ".join(f"CASE WHEN {p} > 0 THEN -({p} / {total}) * log2({p} / {total}) ELSE 0.0 END" for p in parts) + ")"


def changes_sql(of: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, length({of})), lambda j: CASE WHEN substr({of}, j, 1) <> substr({of}, j + 1, 1) THEN 1 ELSE 0 END)) AS DOUBLE)"


def clip_sql(x: str, low: float, high: float) -> str:
    return f"least(greatest(({x} - {low}) / CAST({high} - {low} AS DOUBLE), 0.0), 1.0)"


EXTERNAL_SQL = {
    "loop_size": clip_sql("length(loop)", 3, 16),
    "a_share_last6_a": share("A", "substr(a_tract, 3, 6)", "6"),
    "c_share_last6_a": share("C", "substr(a_tract, 3, 6)", "6"),
    "u_share_first10_u": share("U", "substr(u_tract, 1, 10)", "10"),
    "u_share_first6_u": share("U", "substr(u_tract, 1, 6)", "6"),
    "a_share_first6_u": share("A", "substr(u_tract, 1, 6)", "6"),
    "c_share_u": share("C", "u_tract", "12"),
    "stem_size": clip_sql("length(stem)", 6, 49),
    "gc_share_loop": share("GC", "loop", "length(loop)"),
    "entropy_a": clip_sql(entropy_sql("a_tract", "8"), 0, 2),
    "entropy_u": clip_sql(entropy_sql("u_tract", "12"), 0, 2),
    "entropy_stem": clip_sql(entropy_sql("stem", "length(stem)"), 0.998000884, 2),
    "changes_a": clip_sql(changes_sql("a_tract"), 0, 7),
    "changes_u": clip_sql(changes_sql("u_tract"), 0, 11),
    "changes_stem": clip_sql(changes_sql("stem"), 2, 34),
    "gc_prefix_stem": clip_sql("length(regexp_extract(stem, '^[GC]*'))", 0, 12),
}


@query("c18_c24_external_features", REGION_SQL + ", e AS (SELECT *, first_half || second_half AS stem FROM r WHERE eligible) SELECT sample_idx, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in EXTERNAL_SQL.items()) + " FROM e")
def c18_c24_external_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = external_scores(annotate_regions(sequences(spark, sf_dir)).where("eligible"))
    return rows.select("sample_idx", *rounded(list(EXTERNAL_SQL)))


@query(
    "f1_f7_clean_sequences",
    "WITH {S}, raw AS (SELECT sample_idx, CASE WHEN sample_idx % 11 = 0 THEN ' ' || lower(seq) || ' ' WHEN sample_idx % 13 = 0 THEN replace(seq, 'T', 'U') WHEN sample_idx % 17 = 0 THEN seq || 'N' WHEN sample_idx % 19 = 0 THEN '' ELSE seq END AS sequence, CASE WHEN sample_idx % 7 = 0 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) END AS efficiency FROM s),"
    " c AS (SELECT sample_idx, translate(upper(trim(sequence)), 'U', 'T') AS sequence, TRY_CAST(efficiency AS DOUBLE) AS efficiency FROM raw)"
    " SELECT CAST(row_number() OVER (ORDER BY sample_idx) - 1 AS VARCHAR) AS id, sequence, efficiency FROM c WHERE efficiency IS NOT NULL AND regexp_full_match(sequence, '[ACGT]+')",
)
def f1_f7_clean_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import clean_sequences

    i, s = F.col("sample_idx"), F.col("seq")
    dirty = F.when(i % 11 == 0, F.concat(F.lit(" "), F.lower(s), F.lit(" "))).when(i % 13 == 0, F.replace(s, F.lit("T"), F.lit("U"))).when(i % 17 == 0, F.concat(s, F.lit("N"))).when(i % 19 == 0, "").otherwise(s)
    raw = sequences(spark, sf_dir).select("sample_idx", dirty.alias("sequence"), F.when(i % 7 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("efficiency"))
    return clean_sequences(raw, order="sample_idx").select("id", "sequence", "efficiency")


@query(
    "f10_f13_target_transforms",
    "WITH {S}, v AS (SELECT sample_idx, (sample_idx % 101) / 100.0 AS te FROM s) SELECT sample_idx, CAST(te AS DOUBLE) AS te, CASE WHEN te < 1 THEN round(1 / (1 - te), 6) END AS strength, CASE WHEN te < 1 THEN round(-log10(1 - te), 6) END AS model_y,"
    " round(-log10(greatest(least(1 - te, 1.0), 0.0001)), 6) AS remaining, te < 1 AS finite_target, 'te_' || replace(printf('%.2f', te), '.', 'p') AS target_id FROM v",
)
def f10_f13_target_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    te = F.col("te")
    rows = sequences(spark, sf_dir).select("sample_idx", (F.col("sample_idx") % 101 / 100.0).alias("te"))
    return rows.select("sample_idx", "te", F.round(X.te_to_strength(te), 6).alias("strength"), F.round(X.te_to_y(te), 6).alias("model_y"), F.round(X.remaining_log(te * 100.0), 6).alias("remaining"), (te < 1).alias("finite_target"), X.target_label(te).alias("target_id"))


@query(
    "f12_design_regime",
    "WITH {S}, m AS (SELECT min(y) AS lo, max(y) AS hi FROM s), t AS (SELECT unnest(range(0, 11)) AS k) SELECT CAST(k AS INT) AS target_rank, CAST(k * 0.5 AS DOUBLE) AS target_model_y, k * 0.5 BETWEEN lo AND hi AS inside, CASE WHEN k * 0.5 BETWEEN lo AND hi THEN 'interpolative' ELSE 'extrapolative' END AS design_regime FROM t, m",
)
def f12_design_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sequences(spark, sf_dir).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    grid = spark.range(11).select(F.col("id").cast("int").alias("target_rank"), (F.col("id") * 0.5).alias("target_model_y"))
    inside = F.col("target_model_y").between(F.col("lo"), F.col("hi"))
    return grid.crossJoin(F.broadcast(seen)).select("target_rank", "target_model_y", inside.alias("inside"), F.when(inside, "interpolative").otherwise("extrapolative").alias("design_regime"))


@query(
    "f14_f34_anchor_coordinates",
    "WITH {S}, {G}, {D}, m AS (SELECT d.sample_idx, CAST(p AS INT) AS position, CAST(p - hairpin_end AS INT) AS relative_position, CASE WHEN spacer_length < 15 THEN CAST(spacer_length + 1 AS INT) END AS first_downstream_t, CAST(stem_start - hairpin_end AS INT) AS stem_relative, CAST(loop_start - hairpin_end AS INT) AS loop_relative FROM d, (SELECT unnest(range(0, 60)) AS p) WHERE has AND p < length(seq))"
    " SELECT * FROM m WHERE relative_position BETWEEN -30 AND 20",
)
def f14_f34_anchor_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = describe(sequences(spark, sf_dir)).where("geom is not null").withColumn("position", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)))
    end = F.col("geom.hairpin_end")
    spacer = F.col("spacer_length")
    out = rows.select("sample_idx", "position", (F.col("position") - end).alias("relative_position"), F.when(spacer < 15, (spacer + 1).cast("int")).alias("first_downstream_t"), (F.col("geom.stem_start") - end).alias("stem_relative"), (F.col("geom.loop_start") - end).alias("loop_relative"))
    return out.where(F.col("relative_position").between(-30, 20))


@query(
    "f23_f26_generation_qc",
    "WITH {S}, j AS (SELECT sample_idx, substr(seq, 1, 20) AS prompt, CASE WHEN sample_idx % 9 = 0 THEN 'A' || substr(seq, 2) WHEN sample_idx % 10 = 0 THEN seq || 'N' WHEN sample_idx % 12 = 0 THEN substr(seq, 1, length(seq) - 2) ELSE seq END AS sequence, length(seq) AS target_length, length(seq) - 20 AS n_tokens FROM s),"
    " q AS (SELECT *, regexp_full_match(sequence, '[ACGT]+') AS a, starts_with(sequence, prompt) AS b, regexp_full_match(substr(sequence, 21), '[ACGT]+') AS c, length(sequence) = target_length AS d, length(substr(sequence, 21)) = n_tokens AS e FROM j)"
    " SELECT sample_idx, a AND b AND c AND d AND e AS qc_pass, CASE WHEN a AND b AND c AND d AND e THEN 'PASS' ELSE concat_ws(';', CASE WHEN NOT a THEN 'invalid_sequence_dna' END, CASE WHEN NOT b THEN 'prompt_prefix_mismatch' END, CASE WHEN NOT c THEN 'invalid_continuation_dna' END, CASE WHEN NOT d THEN 'target_length_mismatch' END, CASE WHEN NOT e THEN 'continuation_length_mismatch' END) END AS qc_reason FROM q",
)
def f23_f26_generation_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.contracts import check_samples

    i, s = F.col("sample_idx"), F.col("seq")
    made = F.when(i % 9 == 0, F.concat(F.lit("A"), F.substring(s, 2, 100))).when(i % 10 == 0, F.concat(s, F.lit("N"))).when(i % 12 == 0, F.substring(s, F.lit(1), F.length(s) - 2)).otherwise(s)
    rows = sequences(spark, sf_dir).select("sample_idx", F.substring(s, 1, 20).alias("prompt"), made.alias("sequence"), F.length(s).alias("target_length"), (F.length(s) - 20).alias("n_tokens"))
    return check_samples(rows).select("sample_idx", "qc_pass", "qc_reason")


@query(
    "c13_m11_point_mutants",
    "WITH {S} SELECT sample_idx, CAST(p AS INT) AS position, substr(seq, CAST(p AS INT) + 1, 1) AS ref, alt, substr(seq, 1, CAST(p AS INT)) || alt || substr(seq, CAST(p AS INT) + 2) AS mutant, round(p / CAST(length(seq) - 1 AS DOUBLE), 6) AS normalized_position FROM s, (SELECT unnest(range(0, 60)) AS p), (SELECT unnest(['A','C','G','T']) AS alt) WHERE p < length(seq) AND alt <> substr(seq, CAST(p AS INT) + 1, 1)",
)
def c13_m11_point_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.mutation import point_mutants

    return point_mutants(sequences(spark, sf_dir)).select("sample_idx", "position", "ref", "alt", "mutant", F.round("normalized_position", 6).alias("normalized_position"))


@query(
    "c14_paired_stem_mutants",
    "WITH {S}, {G}, x AS (SELECT s.sample_idx, seq, stem_start + CAST(o AS INT) AS l, hairpin_end - 1 - CAST(o AS INT) AS r, bases FROM s JOIN g ON s.sample_idx = g.sample_idx, (SELECT unnest(range(0, 13)) AS o), (SELECT unnest(['AT','TA','GC','CG']) AS bases) WHERE o < stem_length),"
    " y AS (SELECT *, substr(seq, 1, l) || substr(bases, 1, 1) || substr(seq, l + 2, r - l - 1) || substr(bases, 2, 1) || substr(seq, r + 2) AS mutant FROM x) SELECT sample_idx, l AS \"left\", r AS \"right\", bases, mutant FROM y WHERE mutant <> seq",
)
def c14_paired_stem_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.mutation import paired_stem_mutants

    return paired_stem_mutants(with_geometry(sequences(spark, sf_dir))).select("sample_idx", "left", "right", "bases", "mutant")


@query(
    "l16_loop_and_tail_mutants",
    "WITH {S}, {G}, x AS (SELECT s.sample_idx, seq, loop_start, loop_end, hairpin_end FROM s JOIN g ON s.sample_idx = g.sample_idx), p AS (SELECT sample_idx, seq, 'loop' AS region, unnest(range(loop_start, loop_end)) AS p FROM x UNION ALL SELECT sample_idx, seq, 'tail', unnest(range(hairpin_end, least(hairpin_end + 15, length(seq)))) FROM x)"
    " SELECT sample_idx, region, p::INT AS position, alt, substr(seq, 1, p::INT) || alt || substr(seq, p::INT + 2) AS mutant FROM p, (SELECT unnest(['A', 'C', 'G', 'T']) AS alt) WHERE substr(seq, p::INT + 1, 1) <> alt AND (region = 'loop' OR alt = 'T')",
)
def l16_loop_and_tail_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a letter of the loop, and every change to T downstream of the hairpin."""
    from ..operators.mutation import loop_mutants, tail_mutants

    rows = with_geometry(sequences(spark, sf_dir))
    pick = lambda df, region: df.select("sample_idx", F.lit(region).alias("region"), "position", "alt", "mutant")
    return pick(loop_mutants(rows), "loop").unionByName(pick(tail_mutants(rows), "tail"))


@query(
    "c15_crossover",
    "WITH {S}, {G}, a AS (SELECT s.sample_idx, s.seq, loop_end, o.seq AS other FROM s JOIN g ON s.sample_idx = g.sample_idx JOIN s o ON o.sample_idx = s.sample_idx + 1) SELECT sample_idx, CASE WHEN loop_end > 0 AND loop_end < length(seq) AND loop_end < length(other) THEN substr(seq, 1, loop_end) || substr(other, loop_end + 1) END AS child FROM a",
)
def c15_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.mutation import crossover

    rows = sequences(spark, sf_dir).select("sample_idx", "seq")
    mates = rows.select((F.col("sample_idx") - 1).alias("sample_idx"), F.col("seq").alias("other"))
    pairs = with_geometry(rows.join(mates, "sample_idx")).where("geom is not null").withColumn("cut", F.col("geom.loop_end"))
    return crossover(pairs, "seq", "other", "cut").select("sample_idx", "child")


@query(
    "m14_spacer_buckets",
    "WITH {S}, {G}, {D} SELECT CASE WHEN spacer_length = 0 THEN '0 nt' WHEN spacer_length = 1 THEN '1 nt' WHEN spacer_length < 15 THEN '>=2 nt' END AS spacer_group, count(*) AS n, sum(CASE WHEN spacer_length = 15 THEN 1 ELSE 0 END)::BIGINT AS n_sentinel, round(avg(y), 6) AS mean_y FROM d GROUP BY 1",
)
def m14_spacer_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = describe(sequences(spark, sf_dir))
    return rows.groupBy(X.spacer_bucket(F.col("spacer_length"))[0].alias("spacer_group")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("spacer_length") == 15).alias("n_sentinel"), F.round(F.avg("y"), 6).alias("mean_y"))
