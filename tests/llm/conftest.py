"""Documents that hold the odd cases: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, words: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


def odd_rows() -> list[tuple]:
    r = random.Random(5)
    long = prose(r, 60_000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "one", None, "a", 3), (5, "one", "en", "b", 3), (6, long, "en", "a", len(long)), (None, "no id here at all", "en", None, 17), (None, None, "de", "x", None), (None, "no id here at all", "en", None, 17)]
    same = prose(r, 80)
    rows += [(7, same, "en", "a", len(same)), (7, same, "en", "a", len(same)), (8, same, "en", "a", len(same)), (9, "é ü 漢字 🙂 " * 9, "en", "a", 9)]
    return rows


#: Columns whose names operators may use inside.
CLASHES = ("node", "sig", "rep", "key", "_key", "_row", "_id", "_spans", "_chunk", "_copy", "component_id", "score", "lang_pred", "rejected", "shard", "slot", "spans", "base", "digest", "media", "facts", "n_bytes", "piece", "length", "start", "end", "value", "x")


@pytest.fixture(scope="session")
def odd(spark) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd) -> DataFrame:
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def nothing(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark) -> DataFrame:
    from ..conftest import SF_DIR

    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
