"""Corpus pipeline over ``documents``: each stage works on all that the one before kept.

1. language ID: rows that the language model rejects go; ``lang`` becomes the predicted language. Where no row is labelled,
   only rows without a letter go, and ``lang`` stays.
2. n-gram Jaccard join: of each group of documents with similar word shingles (five words, 0.8) the smallest id stays.
3. substring dedup: passages that an earlier document holds are cut out; documents that lose all their words go.
4. PII: identifiers are replaced by their kind.
5. best-fit packing: the token pieces of all documents with their places in sequences of 4096 tokens.

The stages set the size of the session's Arrow batches, which must hold while their results are written; ``run`` sets back what
the session had. It drops what a stage wrote for itself once the stage's rows are written, and those once the next stage's are. Stages 1 to 4 return the columns of ``documents``; rows with null or
wordless texts are rejected by stage 1.
Repeated rows are copies of each other and leave one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixmill.llm import best_fit_pack, language_id, ngram_join, paragraph_dedup, pii_bootstrap
from helixmill.llm.common import Scratch, carried, restored, swept
from helixmill.llm.queries import CAPACITY, tokenizer_path

#: SQL can't express the stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


#: Rows of a batch that goes to Python at most: texts are long, and both sides hold a whole batch.
BATCH = 4000
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's batches for the stages: they are written, and so run, after a stage's function has returned."""
    spark.conf.set(BATCHES, str(BATCH))


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars of its text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    model = language_id.fit(docs.where(~language_id.held_out()))
    told = carried(docs, language_id.tell(F.col("text"), model).alias("_told")).where(~F.col("_told.rejected"))
    # without a labelled row there is no model: what has letters stays, with the language that it had
    return restored(told, docs.columns, lang=F.col("_told.lang_pred") if model else F.col("_row.lang"))


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    groups = ngram_join.similar_groups(docs.select("doc_id", "text"))
    # rows without an id are kept as they are, but for repeated ones
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    gone = Scratch(spark, "similar").keep(gone, "gone")
    kept = carried(docs, "doc_id", F.md5("text").alias("_text")).join(gone, "doc_id", "left_anti")
    own = F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy("_row.source", "_row.lang", "_row.n_chars"))
    return restored(kept.withColumn("_copy", own).where("_copy = 1"), docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return counted(paragraph_dedup.without_passages(docs), docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return counted(pii_bootstrap.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return best_fit_pack.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", join_similar),
    ("paragraph_dedup", cut_passages),
    ("pii_bootstrap", redact_pii),
    ("best_fit_pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = spark.conf.get(BATCHES, None)
    try:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            with swept():
                docs = scratch.keep(stage(spark, docs, sf_dir), name)
            if k:
                scratch.drop(STAGES[k - 1][0])
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.unset(BATCHES) if before is None else spark.conf.set(BATCHES, before)
