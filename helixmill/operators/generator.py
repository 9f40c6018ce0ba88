"""Sample generation from prompts by a model of letter sequences that Spark counts, in restartable batches.

The model counts which letter follows each context of up to ``order`` letters; a context that was never seen falls back to a
shorter one. A plan's row (a job) asks for a number of samples of a prompt. Its samples are dealt into batches, which a table
function works out apart from each other: a batch that begins at sample d of job j draws with the seed ``seed + 100000 * j + d``. A
batch that runs out of memory is gone on with one sample at a time, each with its own seed, as batches of one are. What is done
is counted by job, so a run that goes on after a stop, which leaves whole batches, gives the same samples as one that never
stopped."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 2026
#: Contexts of a model at most: it is sent to all tasks.
CONTEXTS = 200_000
ALPHABET = "ACGT"
FIELDS = "sample_in_job long, generation_seed long, continuation string, sequence string, score double"


def transition_counts(df: DataFrame, sequence: str, order: int, alphabet: str = ALPHABET) -> DataFrame:
    """(context, letter, n): how often a letter follows a context of 0 to ``order`` letters. Nulls and letters of no alphabet don't count."""
    s = F.col(sequence)
    at = df.where(s.isNotNull() & (F.length(s) > 0)).select(s.alias("_s"), F.explode(F.sequence(F.lit(1), F.length(s))).alias("_p"))
    each = at.withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.col("_p") - 1, F.lit(order)))))
    some = each.select(F.substring("_s", F.col("_p") - F.col("_k"), F.col("_k")).alias("context"), F.substring("_s", F.col("_p"), F.lit(1)).alias("letter"))
    return some.where(F.col("letter").isin(*alphabet) & F.col("context").rlike(f"\\A[{alphabet}]*\\z")).groupBy("context", "letter").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class LetterModel:
    """Counts by context, and how letters are drawn from them."""

    counts: dict[str, np.ndarray]
    order: int
    alphabet: str = ALPHABET
    temperature: float = 1.0
    top_k: int = 4
    top_p: float = 1.0
    cache: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def odds(self, context: str) -> tuple[np.ndarray, np.ndarray]:
        """Running shares that letters are drawn by, and the logarithms of the letters' own shares, after a context."""
        if context not in self.cache:
            known = context[-self.order :] if self.order else ""
            while known and known not in self.counts:
                known = known[1:]
            n = self.counts.get(known, np.ones(len(self.alphabet)))
            share = n / n.sum()
            drawn = share ** (1 / self.temperature)
            best = np.argsort(-drawn, kind="stable")
            kept = best[: self.top_k]
            upto = np.cumsum(drawn[kept]) / drawn[kept].sum()
            kept = kept[: int(np.searchsorted(upto, self.top_p - 1e-12)) + 1]
            mask = np.zeros_like(drawn)
            mask[kept] = drawn[kept]
            with np.errstate(divide="ignore"):
                self.cache[context] = np.cumsum(mask) / mask.sum(), np.log(share)
        return self.cache[context]

    def generate(self, prompts: list[str], n_tokens: int, seed: int) -> list[tuple[str, float]]:
        """A continuation of each prompt, and the mean logarithm of its letters' shares."""
        r = np.random.default_rng(seed)
        text, total = list(prompts), [0.0] * len(prompts)
        for _ in range(n_tokens):
            for i, u in enumerate(r.random(len(text)).tolist()):
                upto, logs = self.odds(text[i][-self.order :] if self.order else "")
                k = min(int(np.searchsorted(upto, u, side="right")), len(self.alphabet) - 1)
                text[i] += self.alphabet[k]
                total[i] += float(logs[k])
        return [(t[len(p) :], s / max(n_tokens, 1)) for t, p, s in zip(text, prompts, total, strict=True)]


def letter_model(counts: DataFrame, order: int, **how: float) -> LetterModel:
    """The model of ``transition_counts``, of which there may be ``CONTEXTS``."""
    rows = counts.limit(CONTEXTS * len(ALPHABET) + 1).collect()
    if len(rows) > CONTEXTS * len(ALPHABET):
        raise ValueError(f"a model of at most {CONTEXTS} contexts is sent out: lower the order")
    told: dict[str, np.ndarray] = {}
    for r in rows:
        told.setdefault(r.context, np.zeros(len(ALPHABET)))[ALPHABET.index(r.letter)] = r.n
    return LetterModel(told, order, **how)


def batch_samples(generate: Callable[[list[str], int, int], list[tuple[str, float]]], job: int, prompt: str, n_tokens: int, first: int, count: int, seed: int) -> Iterator[tuple]:
    """Samples ``first`` to ``first + count - 1`` of a job: at once, or one by one where that takes too much memory."""
    while count:
        own = seed + 100_000 * job + first
        try:
            size, told = count, generate([prompt] * count, n_tokens, own)
        except MemoryError:
            if count == 1:
                raise
            size, told = 1, generate([prompt], n_tokens, own)
        if len(told) != size:
            raise RuntimeError(f"{len(told)} samples came of {size}")
        for k, (text, score) in enumerate(told):
            yield first + k, own, text, prompt + text, float(score) if math.isfinite(score) else None
        first, count = first + size, count - size


def batches_to_do(plan: DataFrame, done: DataFrame | None, batch: int) -> DataFrame:
    """``plan`` (job_id, n_samples, ...) with a row (first, count) for each batch that is left: what ``done`` holds of a job is its beginning."""
    had = plan.withColumn("_done", F.lit(0).cast("long"))
    if done is not None:
        had = plan.join(done.groupBy("job_id").agg(F.count(F.lit(1)).alias("_done")), "job_id", "left").withColumn("_done", F.coalesce("_done", F.lit(0)))
    left = had.where(F.col("_done") < F.col("n_samples"))
    first = F.sequence(F.col("_done"), F.col("n_samples").cast("long") - 1, F.lit(batch).cast("long"))
    return left.withColumn("first", F.explode(first)).withColumn("count", F.least(F.lit(batch), F.col("n_samples") - F.col("first")).cast("int")).drop("_done")


def samples(plan: DataFrame, generate: Callable[[list[str], int, int], list[tuple[str, float]]], done: DataFrame | None = None, batch: int = 8, seed: int = SEED) -> DataFrame:
    """The samples of ``plan`` (job_id, prompt, n_tokens, n_samples, ...) that are left to do: the plan's columns, with (sample_in_job,
    generation_seed, continuation, sequence, score). Jobs of no samples or with a null have none."""
    good = plan.where(F.col("job_id").isNotNull() & F.col("prompt").isNotNull() & (F.col("n_tokens") >= 0) & (F.col("n_samples") > 0))
    work = batches_to_do(good, done, batch).repartition("job_id", "first")

    class Samples:
        def eval(self, job: int, prompt: str, n_tokens: int, first: int, count: int):
            yield from batch_samples(generate, job, prompt, n_tokens, first, count, seed)

    table = F.udtf(Samples, returnType=FIELDS)
    call = table(F.col("job_id").cast("long").outer(), F.col("prompt").outer(), F.col("n_tokens").cast("int").outer(), F.col("first").outer(), F.col("count").outer())
    return work.lateralJoin(call).drop("first", "count")
