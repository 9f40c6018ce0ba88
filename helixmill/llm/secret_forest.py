"""Secret scans with a random forest that removes false positives.

A candidate is a run of ``LEAST`` or more key-like signs, letters alone too. Its features are its length, how often its
characters change class, entropy and shares of classes, how much of it the corpus' frequent words cover, whether it
stands in a path or address, and the words beside it (credential names, names of digests and ids, assignment, quotes).
A forest trained on labelled findings gives each candidate a probability; those below the threshold are removed as
false positives by ``findings(..., keep=True)`` or marked by default.

Labelled findings are a table (doc_id, text, label) of one finding each, at most ``FITTED`` rows; ``labelled_findings``
makes such a table by rule. Words are counted over all texts, and the ``FREQUENT`` most frequent ones, ties by the word, are
the dictionary. Null texts have no candidates; repeated rows have theirs each; an empty table gives an empty table. A long
run is one candidate, whose features take time with its length. Other columns of the texts are not carried along."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Signs of a candidate at least.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.-]{%d,}" % LEAST)
#: Words that name credentials, and words that name what only looks like one (fixed values).
CREDENTIAL = ("token", "secret", "key", "password", "passwd", "pwd", "auth", "bearer", "credential", "apikey")
HARMLESS = ("commit", "sha", "md5", "checksum", "digest", "etag", "uuid", "id", "revision", "build", "phone", "card", "serial", "version")
#: Labelled findings that a forest is fitted on at most.
FITTED = 6000
FREQUENT = 2000
TREES = 40
DEPTH = 8
THRESHOLD = 0.5
SIDE = 40
FEATURES = ("length", "changes", "entropy", "digits", "upper", "lower", "signs", "distinct", "coverage", "longest_word", "hexadecimal", "path", "address", "quoted", "assigned", "credential_word", "harmless_word", "prose")


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def covered(value: str, words: frozenset[str], most: int = 12) -> tuple[int, int]:
    """Characters of a value that dictionary words cover, longest first from the left, and the longest word."""
    low, i, total, longest = value.lower(), 0, 0, 0
    while i < len(low):
        for n in range(min(most, len(low) - i), 2, -1):
            if low[i : i + n] in words:
                total, longest, i = total + n, max(longest, n), i + n
                break
        else:
            i += 1
    return total, longest


def features(value: str, before: str, after: str, words: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = [kind(c) for c in value]
    share = Counter(kinds)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    cover, longest = covered(value, words)
    left = [w.lower() for w in re.findall(r"[A-Za-z]+", before)][-3:]
    any_of = lambda names: float(any(any(x in w for x in names) if len(w) > 3 else w in names for w in left))
    return [
        float(n),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(n - 1, 1),
        entropy,
        *(share[k] / n for k in range(4)),
        len(set(value)) / n,
        cover / n,
        float(longest),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))),
        float(value.count("/") >= 2 or "/" in value[:2] or before.endswith(("/", "\\"))),
        float(bool(re.search(r"(https?:|www\.|@)\S*$", before)) or "." in value.strip(".")),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before)),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", before)) or before.lower().rstrip().endswith("bearer")),
        any_of(CREDENTIAL),
        any_of(HARMLESS),
        float(bool(re.search(r"[a-z]{2,}[.,]?\s$", before)) and bool(re.match(r"[.,]?\s[A-Za-z]{2,}", after))),
    ]


def frequent_words(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """The most frequent words of three to twelve letters of all texts (ties by the word)."""
    word = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where(F.length("w").between(3, 12))
    top = word.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(most)
    return [r[0] for r in top.collect()]


def candidates(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, start, end, value, features) of every candidate of every text; code points, end exclusive."""
    own = frozenset(words)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for m in CANDIDATE.finditer(text or ""):
                    value = m[0].strip(".=-") if not m[0].endswith("=") else m[0].lstrip(".=-")
                    if len(value) >= LEAST:
                        a = m.start() + m[0].index(value)
                        b = a + len(value)
                        out.append((doc, a, b, value, features(value, text[max(0, a - SIDE) : a], text[b : b + SIDE], own)))
            if out:
                doc, a, b, value, x = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.string()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "start", "end", "value", "x"])

    return docs.select("doc_id", "text").mapInArrow(walk, "doc_id long, start long, end long, value string, x array<double>")


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 7) -> DataFrame:
    """(doc_id, text, label): made-up findings, half of them secrets, in the contexts that scanners meet."""
    r = random.Random(seed)
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    lower, upper, number = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve")) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    hexes = lambda: pick("0123456789abcdef", r.choice((32, 40, 40, 64)))
    rows = []
    for i in range(n):
        secret = i % 2 == 0
        if secret:
            value = r.choice((hexes, lambda: hexes().upper(), lambda: pick(lower + upper + number, r.randint(20, 64)), lambda: pick(lower + upper + number + "+/", r.choice((40, 44, 64))), lambda: pick(upper + number, r.choice((16, 20))), lambda: pick(lower, 4) + "_" + pick(lower + upper + number, 36), lambda: pick(lower + upper, r.randint(18, 48)), lambda: pick(lower, r.randint(20, 40))))()
            name = r.choice(CREDENTIAL)
            name = r.choice((name, name.upper(), f"api_{name}", f"{word()}_{name}"))
            quote = r.choice(('"', '"', "'", ""))
            text = r.choice((f"{name} = {quote}{value}{quote}", f"{name}: {quote}{value}{quote}", f'"{name}": "{value}"', f"export {name.upper()}={value}", f"authorization: bearer {value}"))
        else:
            made = r.choice(
                (
                    lambda: f"{r.choice(('commit', 'sha256:', 'checksum', 'md5', 'etag:', 'digest =', 'revision'))} {hexes()}",
                    lambda: pick(number, r.choice((16, 16, 17, 18, 20))),
                    lambda: f"{pick(number, 16)} {pick(number, 16)}",
                    lambda: f"id = {hexes()[:8]}-{hexes()[:4]}-4{hexes()[:3]}-a{hexes()[:3]}-{hexes()[:12]}",
                    lambda: "/".join(["", *(word() for _ in range(r.randint(3, 6))), f"{word()}{r.randint(1, 99)}.txt"]),
                    lambda: f"https://www.{word()}.org/{word()}-{word()}-{word()}-{r.randint(10, 9999)}",
                    lambda: "_".join([*(word() for _ in range(r.randint(3, 6))), str(r.randint(1, 999))]),
                    lambda: "".join(word().title() for _ in range(r.randint(4, 7))) + str(r.randint(1, 99)),
                    lambda: f"{r.choice(CREDENTIAL)} = \"{r.choice(('xxxxxxxxxxxxxxxx1', 'your-api-key-here-1', '0123456789abcdef', '00000000000000000000', 'changeme-changeme-1', 'example-key-example-1'))}\"",
                    lambda: "".join(word() for _ in range(r.randint(5, 9))),
                    lambda: "-".join(word() for _ in range(r.randint(4, 7))),
                    lambda: "".join(word().title() for _ in range(r.randint(4, 7))),
                    lambda: f'"{r.choice(HARMLESS)}": "{hexes()}"',
                    lambda: f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
                    lambda: f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}",
                )
            )
            text = made()
        rows.append((i, f"{prose()} {text} {prose()}{r.choice(('', '.'))}", int(secret)))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "label"]))


def train(labelled: DataFrame, words: list[str], seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (doc_id, text, label); a finding's last candidate carries its label."""
    some = labelled.orderBy("doc_id").limit(FITTED)
    rows = candidates(some, words).groupBy("doc_id").agg(F.max_by("x", "start").alias("x")).join(some.select("doc_id", "label"), "doc_id")
    rows = rows.orderBy("doc_id").coalesce(1).select(array_to_vector("x").alias("features"), F.col("label").cast("double"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def findings(docs: DataFrame, model: RandomForestClassificationModel, words: list[str], threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """(doc_id, start, end, value, probability, is_secret) of every candidate, or of those kept alone."""
    told = model.transform(candidates(docs, words).withColumn("features", array_to_vector("x")))
    out = told.select("doc_id", "start", "end", "value", F.get(vector_to_array("probability"), 1).alias("probability"))
    out = out.withColumn("is_secret", F.col("probability") >= threshold)
    return out.where("is_secret") if keep else out
