"""Queries of importance, associations, mutation effects and exported rules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..functions import statistics as T
from ..operators import importance as I  # noqa: E741
from ..operators.descriptors import describe
from ..operators.mutation import guided_choice, point_mutants
from ..sources.tables import kept
from .base import load, query, sequences

FEATURES = list(Q.FEATURES)
GROUPS = {**{g: list(fs) for g, fs in Q.FEATURE_GROUPS.items()}, **{f: [f] for f in FEATURES}}
PERMUTATIONS = 10
#: Weights of the stand-in scorer: fixed, of either sign, smaller for features of larger values.
WEIGHTS = {f: ((7 * i) % 11 - 5) / (100.0 if f in ("seq_len", "stem_pairing_score", "stem_polyT_interaction", "stem_polyT_coupling") else 10.0) for i, f in enumerate(FEATURES)}


def stand_in(c: dict[str, Column | np.ndarray]) -> Column | np.ndarray:
    """A fixed linear scorer over all descriptors, in place of a trained model."""
    total = 0.0
    for f, w in WEIGHTS.items():
        total = total + w * c[f]
    return total


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with their descriptors, at nine digits, so that ties don't hang on the last bit."""
    rows = describe(sequences(spark, sf_dir).where("seq is not null"))
    return rows.select("sample_idx", "y", "pred", *(F.round(f, 9).alias(f) for f in FEATURES))


NAMES = ", ".join(f'"{f}"' for f in FEATURES)
DESCRIBED_SQL = "WITH {S}, {G}, {D}, f AS MATERIALIZED (SELECT sample_idx, y, pred, " + ", ".join(f'round("{f}", 9) AS "{f}"' for f in FEATURES) + " FROM d WHERE seq IS NOT NULL)"


def score_sql(value: Callable[[str], str]) -> str:
    return " + ".join(f"({w}) * {value(f)}" for f, w in WEIGHTS.items())


def swapped_sql(f: str) -> str:
    names = ", ".join(f"'{g}'" for g, fs in GROUPS.items() if f in fs)
    return f'CASE WHEN g IN ({names}) THEN x."{f}" ELSE n."{f}" END'


DELTAS_SQL = (
    f"{DESCRIBED_SQL}, n AS (SELECT *, sample_idx % 5 AS fold, row_number() OVER (PARTITION BY sample_idx % 5 ORDER BY sample_idx) AS n FROM f),"
    f" c AS (SELECT * FROM (SELECT unnest([{', '.join(repr(g) for g in GROUPS)}]) AS g), (SELECT unnest(range(1, {PERMUTATIONS + 1})) AS p)),"
    " x AS (SELECT n.* EXCLUDE (n), g, p, row_number() OVER (PARTITION BY fold, g, p ORDER BY md5('42|' || g || '|' || p || '|' || sample_idx), sample_idx) AS n FROM n, c),"
    f" b2 AS (SELECT n.fold, x.g, x.p, n.y, {score_sql(lambda f: chr(110) + '.' + chr(34) + f + chr(34))} AS base, {score_sql(swapped_sql)} AS perm FROM n JOIN x ON n.fold = x.fold AND n.n = x.n),"
    " d2 AS (SELECT fold, g, p, sqrt(avg((y - perm) ** 2)) - sqrt(avg((y - base) ** 2)) AS delta FROM b2 GROUP BY 1, 2, 3), e AS (SELECT fold, g, avg(delta) AS d FROM d2 GROUP BY 1, 2)"
)


@query("l6_l7_permutation_importance", DELTAS_SQL + ' SELECT g AS "group", round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(median(d), 6) AS median FROM e GROUP BY g')
def l6_l7_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each of the 29 descriptors and of their five groups: five held-out folds, ten permutations each."""
    rows = kept(described(spark, sf_dir).select("sample_idx", (F.col("sample_idx") % 5).alias("fold"), "y", *FEATURES), "described")
    deltas = I.permutation_deltas(rows, "sample_idx", "fold", GROUPS, stand_in, FEATURES, "y", PERMUTATIONS, 42)
    return I.importance(deltas, "fold").select("group", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "median")))


RANKS = "rank() OVER (PARTITION BY feature ORDER BY {c}) + (count(*) OVER (PARTITION BY feature, {c}) - 1) / 2.0"
RHO = "CASE WHEN var_pop({0}) > 0 AND var_pop({1}) > 0 THEN corr({0}, {1}) END"
ASSOCIATIONS_SQL = f"{DESCRIBED_SQL}, l AS (SELECT * FROM f UNPIVOT (value FOR feature IN ({NAMES})) WHERE y IS NOT NULL AND pred IS NOT NULL), r AS (SELECT feature, {RANKS.format(c='value')} AS a, {RANKS.format(c='y')} AS b, {RANKS.format(c='pred')} AS c FROM l), h AS (SELECT feature, {RHO.format('a', 'b')} AS rho_actual, {RHO.format('a', 'c')} AS rho_oof, count(*) AS n FROM r GROUP BY feature)"


@query("l8_feature_associations", ASSOCIATIONS_SQL + " SELECT feature, round(rho_actual, 6) AS rho_actual, round(rho_oof, 6) AS rho_oof, n FROM h")
def l8_feature_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return associations(spark, sf_dir).select("feature", F.round("rho_actual", 6).alias("rho_actual"), F.round("rho_oof", 6).alias("rho_oof"), "n")


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = I.unpivoted(kept(described(spark, sf_dir), "described"), ["sample_idx", "y", "pred"], FEATURES)
    a = T.spearman(long, "value", "y", ("feature",), "rho_actual")
    b = T.spearman(long, "value", "pred", ("feature",), "rho_oof").drop("n")
    return a.join(b, "feature")


#: Student's distribution by Simpson's rule.
STUDENT_SQL = (
    ", t AS (SELECT *, n - 2 AS v, abs(rho_actual) * sqrt((n - 2) / (1 - rho_actual * rho_actual)) AS t FROM h WHERE rho_actual IS NOT NULL), s2 AS (SELECT feature, sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * k / 4000.0, 2) / v, -(v + 1) / 2.0)) * t / 12000.0 * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(v * pi()) AS half FROM t, (SELECT unnest(range(0, 4001)) AS k) GROUP BY feature, t, v),"
    " p AS (SELECT feature, 1 - 2 * half AS p FROM s2), u AS (SELECT p, p * (SELECT count(*) FROM p) / count(*) OVER (ORDER BY p) AS raw FROM p), q AS (SELECT p, least(min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM (SELECT p, min(raw) AS raw FROM u GROUP BY p))"
)


@query("l8_adjusted_associations", ASSOCIATIONS_SQL + STUDENT_SQL + " SELECT h.feature, round(rho_actual, 6) AS rho_actual, round(rho_oof, 6) AS rho_oof, n, round(p.p, 6) AS p, round(q.q, 6) AS q FROM h LEFT JOIN p ON p.feature = h.feature LEFT JOIN q ON q.p = p.p")
def l8_adjusted_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values by Student's t and their false-discovery adjustment."""
    rows = kept(associations(spark, sf_dir).withColumn("p", T.p_value(F.col("rho_actual"), F.col("n"))), "associations")
    return T.benjamini_hochberg(rows, "p").select("feature", "n", *(F.round(c, 6).alias(c) for c in ("rho_actual", "rho_oof", "p", "q")))


#: Features that speak for each mutation operator, and the score of the one that is guided by mutagenesis.
OPERATORS = {
    "paired_stem": ["stem_length", "stem_pairing_score", "gu_wobble_count", "loop_proximal_gc_pair_fraction", "stem_polyT_interaction", "compact_gc_hairpin_score"],
    "loop": ["loop_length", "loop_proximal_gc_pair_fraction"],
    "polyT": ["freq_T", "count_poly_t_4", "max_poly_t_run", "kmer_TTT", "positional_poly_t_score", "spacer_length", "stem_polyT_coupling", "polyT_spacer_proximity", "polyT_position_interaction"],
    "random": [*Q.FEATURE_GROUPS["Sequence composition"], *Q.FEATURE_GROUPS["3-mer motifs"]],
}
GUIDED = {"ism_guided": 0.25}
EVIDENCE_SQL = (
    DELTAS_SQL
    + ASSOCIATIONS_SQL.removeprefix(DESCRIBED_SQL)
    + STUDENT_SQL
    + f", pm AS (SELECT g AS feature, round(avg(d), 9) AS m FROM e WHERE g IN ({', '.join(repr(f) for f in FEATURES)}) GROUP BY g), ps AS (SELECT g AS feature, avg((round(delta, 9) > 0)::INT) AS st FROM d2 GROUP BY g), pr AS (SELECT feature, (rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / count(*) OVER () AS pct FROM pm),"
    " ev0 AS (SELECT h.feature, round(coalesce(pct, 0), 5) AS pi_percentile, round(coalesce(st, 0), 5) AS pi_stability, round(coalesce(CASE WHEN sign(rho_actual) = sign(rho_oof) THEN sqrt(abs(rho_actual * rho_oof)) END, 0), 5) AS association_convergence, round(1 - least(greatest(coalesce(q.q, 1), 0), 1), 5) AS fdr_support FROM h LEFT JOIN pr ON pr.feature = h.feature LEFT JOIN ps ON ps.feature = h.feature LEFT JOIN p ON p.feature = h.feature LEFT JOIN q ON q.p = p.p),"
    " ev AS (SELECT *, pow(pi_percentile * pi_stability * association_convergence * fdr_support, 0.25) AS evidence FROM ev0)"
)


def feature_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(described(spark, sf_dir).select("sample_idx", (F.col("sample_idx") % 5).alias("fold"), "y", *FEATURES), "described")
    deltas = kept(I.permutation_deltas(rows, "sample_idx", "fold", {f: [f] for f in FEATURES}, stand_in, FEATURES, "y", PERMUTATIONS, 42), "deltas")
    told = kept(associations(spark, sf_dir).withColumn("p", T.p_value(F.col("rho_actual"), F.col("n"))), "associations")
    return kept(I.evidence(deltas, T.benjamini_hochberg(told, "p")), "evidence")


@query("a18_feature_evidence", EVIDENCE_SQL + " SELECT feature, pi_percentile, pi_stability, association_convergence, fdr_support, round(evidence, 4) AS evidence FROM ev")
def a18_feature_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for each of the 29 descriptors: importance, its stability, association and its significance, in one score."""
    return feature_evidence(spark, sf_dir).withColumn("evidence", F.round("evidence", 4))


@query(
    "a17_operator_weights",
    EVIDENCE_SQL
    + ", ow AS (SELECT o, avg(coalesce(evidence, 0)) AS score FROM (VALUES "
    + ", ".join(f"('{o}', '{f}')" for o, fs in OPERATORS.items() for f in fs)
    + ") v(o, f) LEFT JOIN ev ON ev.feature = f GROUP BY o UNION ALL SELECT 'ism_guided', 0.25) SELECT o AS operator, round(score, 4) AS score, round(score / sum(score) OVER (), 4) AS weight FROM ow",
)
def a17_operator_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each mutation operator is drawn: the mean evidence of its features, as shares."""
    return I.operator_weights(feature_evidence(spark, sf_dir), OPERATORS, GUIDED).select("operator", F.round("score", 4).alias("score"), F.round("weight", 4).alias("weight"))


MUTANT_SQL = (
    "m AS (SELECT sample_idx, p, alt, seq, substr(seq, 1, p::INT) || alt || substr(seq, p::INT + 2) AS mutant FROM s, (SELECT unnest(range(0, 60)) AS p), (SELECT unnest(['A','C','G','T']) AS alt) WHERE p < length(seq) AND alt <> substr(seq, p::INT + 1, 1)),"
    " e AS (SELECT sample_idx, p, alt, 0.3 * (list_sum(list_transform(range(1, length(seq) - 2), lambda j: CASE WHEN substr(mutant, j, 4) = 'TTTT' THEN 1 ELSE 0 END)) - list_sum(list_transform(range(1, length(seq) - 2), lambda j: CASE WHEN substr(seq, j, 4) = 'TTTT' THEN 1 ELSE 0 END)))"
    " + 2 * (length(replace(replace(seq, 'G', ''), 'C', '')) - length(replace(replace(mutant, 'G', ''), 'C', ''))) / length(seq)::DOUBLE AS delta FROM m)"
)


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_idx, position, alt, delta): each mutant's score less its sequence's, worked out in its own row."""
    score = lambda s: 0.3 * Q.overlapping_count(s, "TTTT") + 2.0 * (Q.count_of(s, "G") + Q.count_of(s, "C")) / F.length(s)
    rows = point_mutants(sequences(spark, sf_dir).select("sample_idx", "seq"))
    return rows.select("sample_idx", "position", "alt", "mutant", (score(F.col("mutant")) - score(F.col("seq"))).alias("delta"))


@query("l9_a13_mutation_profile", f"WITH {{S}}, {MUTANT_SQL}, a AS (SELECT sample_idx, p, avg(abs(delta)) AS v FROM e GROUP BY 1, 2) SELECT p::INT AS position, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS sd, count(*) AS n, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem FROM a GROUP BY p")
def l9_a13_mutation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = effects(spark, sf_dir).withColumn("strength", F.abs("delta"))
    return I.two_stage_profile(rows, "sample_idx", "position", "strength").select("position", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "sem")))


@query("a11_base_by_position", f"WITH {{S}}, {MUTANT_SQL} SELECT p::INT AS position, " + ", ".join(f"round(avg(delta) FILTER (alt = '{b}'), 6) AS \"{b}\"" for b in "ACGT") + " FROM e GROUP BY p")
def a11_base_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects(spark, sf_dir).groupBy("position").pivot("alt", list("ACGT")).agg(F.round(F.avg("delta"), 6))


@query("l17_guided_choice", f"WITH {{S}}, {MUTANT_SQL} SELECT e.sample_idx, e.p::INT AS position, e.alt, round(e.delta, 6) AS delta FROM e JOIN s ON s.sample_idx = e.sample_idx QUALIFY row_number() OVER (PARTITION BY e.sample_idx ORDER BY (coalesce(sign(y - 3) = sign(delta) AND round(delta, 9) <> 0, false))::INT DESC, abs(round(delta, 9)) DESC, p, alt) = 1")
def l17_guided_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = sequences(spark, sf_dir).select("sample_idx", F.coalesce(F.col("y") - 3, F.lit(0.0)).alias("wanted"))
    rows = effects(spark, sf_dir).withColumn("delta", F.round("delta", 9)).join(wanted, "sample_idx")
    return guided_choice(rows, "sample_idx", "wanted", "delta", "position", "alt").select("sample_idx", "position", "alt", F.round("delta", 6).alias("delta"))


@query(
    "a14_a18_evidence_fusion",
    "WITH v AS (SELECT label, avg((embedding[1] > 0)::INT) AS stability, avg(abs(embedding[2]::DOUBLE)) AS strength, avg(abs(embedding[3]::DOUBLE)) AS effect FROM embeddings GROUP BY label), r AS (SELECT *, rank() OVER (ORDER BY strength) / count(*) OVER ()::DOUBLE AS strength_rank, effect / max(effect) OVER () AS effect_share FROM v),"
    " w AS (SELECT label, stability, strength_rank, effect_share, pow(stability * strength_rank * effect_share, 1 / 3.0) AS evidence FROM r) SELECT label, round(stability, 6) AS stability, round(strength_rank, 6) AS strength_rank, round(effect_share, 6) AS effect_share, round(evidence, 6) AS evidence, round(evidence / sum(evidence) OVER (), 6) AS weight FROM w",
)
def a14_a18_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get("embedding", k).cast("double")
    rows = load(spark, sf_dir, "embeddings").groupBy("label").agg(F.avg((e(0) > 0).cast("int")).alias("stability"), F.avg(F.abs(e(1))).alias("strength"), F.avg(F.abs(e(2))).alias("effect"))
    # few features are left: totals are one row
    rows = T.average_ranks(rows, "strength", "strength_rank", percent=True)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("effect").alias("most")))).withColumn("effect_share", F.col("effect") / F.col("most"))
    rows = rows.withColumn("evidence", F.pow(F.col("stability") * F.col("strength_rank") * F.col("effect_share"), F.lit(1 / 3.0)))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("evidence").alias("total")))).withColumn("weight", F.col("evidence") / F.col("total"))
    return rows.select("label", *(F.round(c, 6).alias(c) for c in ("stability", "strength_rank", "effect_share", "evidence", "weight")))


RULES_SQL = f"t AS (SELECT quantile_cont(y, 0.75) AS cut FROM f), w AS (SELECT feature, value FROM (SELECT f.* FROM f, t WHERE y >= cut) UNPIVOT (value FOR feature IN ({NAMES}))), k AS (SELECT feature, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.9), 6) AS q90, count(*) AS n FROM w GROUP BY feature)"


@query("l10_design_rules", f"{DESCRIBED_SQL}, {RULES_SQL} SELECT * FROM k")
def l10_design_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every descriptor among the rows of the highest quarter."""
    rows = kept(described(spark, sf_dir).where("y is not null"), "described")
    cut = T.quantiles(rows, "y", {"cut": 0.75})
    strong = I.unpivoted(rows.crossJoin(F.broadcast(cut)).where("y >= cut"), ["sample_idx"], FEATURES)
    ends = T.quantiles(strong, "value", {f"q{q}": q / 100 for q in (25, 75, 10, 90)}, ("feature",))
    count = strong.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return ends.join(count, "feature").select("feature", "n", *(F.round(f"q{q}", 6).alias(f"q{q}") for q in (25, 75, 10, 90)))


@query("l10_m13_rules_json", ASSOCIATIONS_SQL + f""", {RULES_SQL} SELECT '{{' || string_agg('"' || k.feature || '":{{"direction":"' || CASE WHEN rho_actual > 0 THEN 'higher' ELSE 'lower' END || '","range":[' || q25 || ',' || q75 || ']}}', ',' ORDER BY k.feature) || '}}' AS rules FROM k JOIN h ON h.feature = k.feature""")
def l10_m13_rules_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as one JSON text."""
    rho = associations(spark, sf_dir).select("feature", F.when(F.col("rho_actual") > 0, "higher").otherwise("lower").alias("direction"))
    ranges = l10_design_rules(spark, sf_dir).select("feature", F.col("q25").alias("low"), F.col("q75").alias("high"))
    return I.rules_json(rho.join(ranges, "feature"))
