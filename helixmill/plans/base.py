"""Registry of queries, table loading and the sequence view that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query; ``sql`` is its DuckDB form, with {S} and {G} for the shared views."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{S}", SEQUENCES_SQL).replace("{G}", GEOMETRY_SQL).replace("{D}", DESCRIPTORS_SQL)
        return f

    return add


def both(name: str, tables: str, sql: str, duck: str | None = None) -> None:
    """Registers a query that is one SQL text for Spark and, but for ``duck``, for the check."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql.replace("{S}", SEQUENCES_SPARK), **{t: load(spark, sf_dir, t) for t in tables.split()})

    query(name, duck or plain_tables(sql, tables))(run)


def plain_tables(sql: str, tables: str) -> str:
    for t in tables.split():
        sql = sql.replace("{" + t + "}", t)
    return sql


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


LETTERS = ("0123456789abcdef", "ACGTACGTACGTTTTT")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_idx, seq, y, pred, lang, n_chars): made-up sequences, a measured value and a stand-in prediction."""
    docs = load(spark, sf_dir, "documents")
    letters = F.translate(F.concat(F.md5("text"), F.md5(F.concat(F.lit("x"), F.col("text")))), *LETTERS)
    y = F.round(F.log10(F.col("n_chars") + 1), 6)
    return docs.select(
        F.col("doc_id").alias("sample_idx"),
        F.substring(letters, F.lit(1), (41 + F.col("doc_id") % 17).cast("int")).alias("seq"),
        y.alias("y"),
        F.round(y + (F.col("doc_id") * 7919 % 1000 - 500) / 5000.0, 6).alias("pred"),
        "lang",
        "n_chars",
    )


SEQUENCES_SQL = """s AS (SELECT doc_id AS sample_idx, substr(translate(md5(text) || md5('x' || text), '0123456789abcdef', 'ACGTACGTACGTTTTT'), 1, CAST(41 + doc_id % 17 AS INT)) AS seq,
  round(log10(n_chars + 1), 6) AS y, round(round(log10(n_chars + 1), 6) + (doc_id * 7919 % 1000 - 500) / 5000.0, 6) AS pred, lang, n_chars FROM documents)"""
SEQUENCES_SPARK = """s AS (SELECT doc_id AS sample_idx, substr(translate(md5(text) || md5('x' || text), '0123456789abcdef', 'ACGTACGTACGTTTTT'), 1, CAST(41 + doc_id % 17 AS INT)) AS seq,
  round(log10(n_chars + 1), 6) AS y, round(round(log10(n_chars + 1), 6) + (doc_id * 7919 % 1000 - 500) / 5000D, 6) AS pred, lang, n_chars FROM {documents})"""

#: Hairpins as running sums over pairs that grow outwards from each loop; {up} and {down} are bases to leave free.
GEOMETRY_TEMPLATE = """{name}p AS (SELECT sample_idx, k.k, i.i, t.t, substr(seq, i.i - t.t + 1, 1) || substr(seq, i.i + k.k + t.t, 1) AS pr FROM s, (SELECT unnest(range(3, 9)) AS k) k, (SELECT unnest(range(1, 60)) AS i) i, (SELECT unnest(range(1, 14)) AS t) t
  WHERE i.i - t.t >= {up} AND i.i + k.k + t.t + {down} <= length(seq)),
{name}a AS (SELECT s.sample_idx, k.k, i.i, t.t, substr(seq, i.i - t.t + 1, 1) || substr(seq, i.i + k.k + t.t, 1) AS pr FROM s, (SELECT unnest(range(3, 9)) AS k) k, (SELECT unnest(range(1, 60)) AS i) i, (SELECT unnest(range(1, 14)) AS t) t
  WHERE i.i - t.t >= 0 AND i.i + k.k + t.t <= length(seq)),
{name}c AS (SELECT *, CASE WHEN pr IN ('GC', 'CG') THEN 3 WHEN pr IN ('AT', 'TA') THEN 2 WHEN pr IN ('GT', 'TG') THEN 1 ELSE 0 END AS sc FROM {name}a),
{name}w AS (SELECT *, sum(sc) OVER w AS tot, sum(CASE WHEN sc > 0 THEN 1 ELSE 0 END) OVER w AS prs, sum(CASE WHEN sc = 1 THEN 1 ELSE 0 END) OVER w AS gu, sum(CASE WHEN sc = 3 AND t <= 2 THEN 1 ELSE 0 END) OVER w AS gc2 FROM {name}c WINDOW w AS (PARTITION BY sample_idx, k, i ORDER BY t)),
{name} AS (SELECT w.sample_idx, CAST(w.i - w.t AS INT) AS stem_start, CAST(w.t AS INT) AS stem_length, CAST(w.k AS INT) AS loop_length, CAST(w.i AS INT) AS loop_start, CAST(w.i + w.k AS INT) AS loop_end, CAST(w.i + w.k + w.t AS INT) AS hairpin_end,
  CAST(w.tot - 0.5 * abs(w.k - 4) AS DOUBLE) AS score, CAST(w.prs AS DOUBLE) / w.t AS pair_fraction, CAST(w.gu AS INT) AS gu_count, CAST(w.gc2 AS DOUBLE) / 2 AS proximal_gc
  FROM {name}w w JOIN {name}p p ON w.sample_idx = p.sample_idx AND w.k = p.k AND w.i = p.i AND w.t = p.t WHERE w.t >= 4 AND 4 * w.prs >= 3 * w.t
  QUALIFY row_number() OVER (PARTITION BY w.sample_idx ORDER BY w.tot - 0.5 * abs(w.k - 4) DESC, CAST(w.prs AS DOUBLE) / w.t DESC, w.t DESC, abs(w.k - 4), w.k, w.i - w.t) = 1)"""


def geometry_sql(name: str = "g", up: int = 0, down: int = 0) -> str:
    return GEOMETRY_TEMPLATE.replace("{name}", name).replace("{up}", str(up)).replace("{down}", str(down))


GEOMETRY_SQL = geometry_sql()


def count_sql(letter: str, of: str = "seq") -> str:
    return f"(length({of}) - length(replace({of}, '{letter}', '')))"


def motif_sql(motif: str) -> str:
    return f"(SELECT count(*) FROM unnest(range(1, length(seq) - {len(motif)} + 2)) u(j) WHERE substr(seq, CAST(j AS INT), {len(motif)}) = '{motif}')"


MOTIF_SQL = ", ".join(f"CAST(list_sum(list_transform(range(1, length(seq) - 1), lambda j: CASE WHEN substr(seq, j, 3) = '{m}' THEN 1 ELSE 0 END)) AS DOUBLE) / (length(seq) - 2) AS kmer_{m}" for m in ("TTT", "AAA", "GCG", "CGC", "TTG", "TTA", "GCT", "AGC"))
COMPOSITION_SQL = f"""CAST(length(seq) AS DOUBLE) AS seq_len, CAST({count_sql('G')} + {count_sql('C')} AS DOUBLE) / length(seq) AS gc_content, {', '.join(f"CAST({count_sql(b)} AS DOUBLE) / length(seq) AS freq_{b}" for b in 'ACGT')},
  CAST(list_sum(list_transform(range(1, length(seq) - 2), lambda j: CASE WHEN substr(seq, j, 4) = 'TTTT' THEN 1 ELSE 0 END)) AS DOUBLE) AS count_poly_t_4, CAST(coalesce(list_max(list_transform(regexp_extract_all(seq, 'T+'), lambda r: length(r))), 0) AS DOUBLE) AS max_poly_t_run, {MOTIF_SQL}"""
DESCRIPTORS_SQL = f"""b AS (SELECT s.*, {COMPOSITION_SQL}, g.* EXCLUDE (sample_idx), g.sample_idx IS NOT NULL AS has,
  CASE WHEN g.sample_idx IS NOT NULL THEN substr(seq, g.hairpin_end + 1, 15) ELSE '' END AS ds, CASE WHEN g.sample_idx IS NOT NULL THEN substr(seq, greatest(g.stem_start - 10, 0) + 1, least(g.stem_start, 10)) ELSE '' END AS us FROM s LEFT JOIN g ON s.sample_idx = g.sample_idx),
d0 AS (SELECT * EXCLUDE (stem_length, loop_length), CAST(coalesce(stem_length, 0) AS DOUBLE) AS stem_length, CAST(coalesce(loop_length, 0) AS DOUBLE) AS loop_length, coalesce(score, 0.0) AS stem_pairing_score, CAST(coalesce(gu_count, 0) AS DOUBLE) AS gu_wobble_count, coalesce(proximal_gc, 0.0) AS loop_proximal_gc_pair_fraction,
  CASE WHEN length(us) > 0 THEN CAST({count_sql('A', 'us')} AS DOUBLE) / length(us) ELSE 0.0 END AS upstream_a_richness,
  CASE WHEN length(ds) > 0 THEN list_sum(list_transform(range(0, length(ds)), lambda j: CASE WHEN substr(ds, j + 1, 1) = 'T' THEN exp(-0.2 * j) ELSE 0.0 END)) ELSE 0.0 END AS positional_poly_t_score,
  CASE WHEN instr(ds, 'T') > 0 THEN CAST(instr(ds, 'T') - 1 AS DOUBLE) ELSE 15.0 END AS spacer_length FROM b),
d AS (SELECT *, stem_pairing_score * positional_poly_t_score / (spacer_length + 1) AS "stem_polyT_coupling", stem_pairing_score * max_poly_t_run AS "stem_polyT_interaction", loop_proximal_gc_pair_fraction / (loop_length + 1) AS compact_gc_hairpin_score,
  max_poly_t_run / (spacer_length + 1) AS "polyT_spacer_proximity", max_poly_t_run * positional_poly_t_score AS "polyT_position_interaction" FROM d0)"""


def rounded(columns: list[str], digits: int = 6) -> list[Column]:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def rounded_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)
