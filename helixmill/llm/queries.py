"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

SHARDS = 16
CAPACITY = 4096
#: Rounds of clustering that move centroids.
ROUNDS = 5


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_bootstrap import find, report

    return report(find(load(spark, sf_dir, "documents")))


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jump_shards import shard_table

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = load(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shard_table(rows, "doc_id", SHARDS, SHARDS + 1).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, held_out, predict

    docs = load(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_groups

    return similar_groups(load(spark, sf_dir, "documents"), words=4, percent=85)


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_forest import findings, frequent_words, labelled_findings, train

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    words = frequent_words(docs)
    told = findings(docs, train(labelled_findings(spark), words), words)
    return told.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")


def op10_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_fst import piece_facts

    return piece_facts(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraph_dedup import passages

    return passages(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiset_hash import edited_fingerprints

    return edited_fingerprints(load(spark, sf_dir, "documents"))


def op9_wav_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_columns import media_columns

    facts = media_columns(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "facts.*")
    return facts.withColumn("feature", F.concat_ws(",", F.col("landmarks").cast("array<string>"))).drop("landmarks")


def op8_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .best_fit_pack import pack_documents

    return pack_documents(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), CAPACITY)


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_tree import cluster

    return cluster(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", dims=64, k=40, rounds=ROUNDS)


def op12_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out
    from .quality_network import fit, predict

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels").where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_mining import mine

    return mine(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_pii_bootstrap": op2_pii_bootstrap,
    "op3_jump_shards": op3_jump_shards,
    "op4_ngram_join": op4_ngram_join,
    "op5_secret_forest": op5_secret_forest,
    "op6_paragraph_dedup": op6_paragraph_dedup,
    "op7_multiset_hash": op7_multiset_hash,
    "op8_best_fit_pack": op8_best_fit_pack,
    "op9_wav_landmarks": op9_wav_landmarks,
    "op10_piece_fst": op10_piece_fst,
    "op11_ball_tree": op11_ball_tree,
    "op12_quality_network": op12_quality_network,
    "op13_phrase_mining": op13_phrase_mining,
}

#: Links of documents and the smallest id that they reach, step by step.
OP4_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, list_aggregate(words[k : k + 3], 'string_agg', ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, least(len(words), 1) + 1))) AS k FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.low)::BIGINT AS component_id FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


def clusters_sql(rounds: int) -> str:
    """Rounds of integer k-means over (vector, dimension) rows."""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "u AS MATERIALIZED (SELECT vec_id, i::INT AS i, v[i::INT] AS x FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM v))",
        "f AS MATERIALIZED (SELECT vec_id, (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS c FROM v QUALIFY c < 40)",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN u USING (vec_id))",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, arg_min(c, d * 64 + c)::INT AS c, min(d)::BIGINT AS d FROM (SELECT u.vec_id, z.c, sum((u.x - z.x) * (u.x - z.x)) AS d FROM u JOIN c{k} z USING (i) GROUP BY 1, 2) GROUP BY 1)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{k} JOIN u USING (vec_id) GROUP BY 1, 2)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT z.c, z.i, CASE WHEN n IS NULL THEN z.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM c{k} z LEFT JOIN m{k} USING (c, i))")
    steps.append(f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return "WITH " + ", ".join(steps) + f" SELECT vec_id, a.c AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{rounds} a JOIN h ON h.c = a.c"


#: Every run of words counted, cut and compared; {least} and {most} are the thresholds.
PHRASES_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6))::INT AS k) WHERE len(words) >= k),
f AS MATERIALIZED (SELECT lang, k AS words, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {least}),
c AS MATERIALIZED (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
t AS (SELECT c.*, k::INT AS k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:words], ' ') AS y FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c),
s AS (SELECT t.lang, t.phrase, t.words, t.w, t.a, x.f AS l, y.f AS r, n.n, k, (1000::HUGEINT * t.a * n.n) // (x.f::HUGEINT * y.f) AS score FROM t JOIN f x ON x.lang = t.lang AND x.phrase = t.x JOIN f y ON y.lang = t.lang AND y.phrase = t.y JOIN n ON n.lang = t.lang
  QUALIFY row_number() OVER (PARTITION BY t.lang, t.phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT lang, a, array_to_string(w[j : j + m - 1], ' ') AS phrase FROM (SELECT lang, a, w, words, m, unnest(range(1, words - m + 2)) AS j FROM (SELECT lang, a, w, words, unnest(range(2, words)) AS m FROM c))),
o AS (SELECT * FROM s ANTI JOIN i ON i.lang = s.lang AND i.phrase = s.phrase AND i.a >= s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o QUALIFY rank <= {most}"""


def phrases_sql(least: int = 100, most: int = 2000) -> str:
    return PHRASES_SQL.replace("{least}", str(least)).replace("{most}", str(most))


ORACLES: dict[str, str] = {"op4_ngram_join": OP4_SQL, "op11_ball_tree": clusters_sql(ROUNDS), "op13_phrase_mining": phrases_sql()}
