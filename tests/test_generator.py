"""Sample generation: counts, seeds, restarts, memory."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from helixmill.operators import generator as G

SEQUENCES = ["ACGTACGA", "TTTTTA", "", None, "ACNGT", "G"]


def test_transition_counts(spark):
    got = {(r.context, r.letter): r.n for r in G.transition_counts(spark.createDataFrame([(s,) for s in SEQUENCES], "s string"), "s", 2).collect()}
    want = Counter((s[p - k : p], s[p]) for s in SEQUENCES if s for p in range(len(s)) for k in range(min(p, 2) + 1) if s[p] in "ACGT" and set(s[p - k : p]) <= set("ACGT"))
    assert got == dict(want)


def test_draws_follow_the_shares():
    model = G.LetterModel({"": np.array([1.0, 1, 1, 1]), "A": np.array([0.0, 30, 10, 0])}, 1)
    told = Counter(t for t, _ in model.generate(["A"] * 4000, 1, 5))
    assert set(told) == {"C", "G"} and told["C"] == pytest.approx(3000, abs=120)
    assert {t for t, _ in G.LetterModel(model.counts, 1, top_k=1).generate(["A"] * 50, 1, 5)} == {"C"}
    assert {t for t, _ in G.LetterModel(model.counts, 1, top_p=0.7).generate(["A"] * 50, 1, 5)} == {"C"}
    cold = Counter(t for t, _ in G.LetterModel(model.counts, 1, temperature=0.25).generate(["A"] * 2000, 1, 5))
    assert cold["C"] > 1950
    assert model.generate(["A"], 1, 5)[0][1] in (pytest.approx(np.log(0.75)), pytest.approx(np.log(0.25)))


def plan(spark, n):
    return spark.createDataFrame([(j, f"ACG{'ACGT'[j % 4]}", 12 + j, n if j else 3, f"t{j}") for j in range(5)] + [(8, None, 3, 2, "x"), (9, "A", 3, 0, "x")], "job_id long, prompt string, n_tokens int, n_samples int, target string")


def test_a_rerun_after_a_stop_gives_the_same_samples(spark):
    model = G.letter_model(G.transition_counts(spark.createDataFrame([(s,) for s in SEQUENCES], "s string"), "s", 2), 2)
    whole = G.samples(plan(spark, 21), model.generate).collect()
    assert Counter(r.job_id for r in whole) == {0: 3, 1: 21, 2: 21, 3: 21, 4: 21}
    for r in whole:
        assert r.generation_seed == 2026 + 100_000 * r.job_id + r.sample_in_job // 8 * 8
        assert r.sequence == r.prompt + r.continuation and len(r.continuation) == r.n_tokens and set(r.continuation) <= set("ACGT")
        alone = model.generate([r.prompt] * min(8, r.n_samples - r.sample_in_job // 8 * 8), r.n_tokens, r.generation_seed)[r.sample_in_job % 8]
        assert (r.continuation, r.score) == (alone[0], pytest.approx(alone[1]))
    # a run that stopped after two batches of each job
    some = [r for r in whole if r.sample_in_job < 16]
    rest = G.samples(plan(spark, 21), model.generate, spark.createDataFrame(some, "job_id long, prompt string, n_tokens int, n_samples int, target string, " + G.FIELDS)).collect()
    assert sorted([*some, *rest]) == sorted(whole)
    assert not G.samples(plan(spark, 21), model.generate, spark.createDataFrame(whole, "job_id long, prompt string, n_tokens int, n_samples int, target string, " + G.FIELDS)).count()


def test_batches_that_run_out_of_memory(spark):
    def generate(prompts, n_tokens, seed):
        if len(prompts) > 1 and (seed - 2026) % 100_000 < 3:
            raise MemoryError
        return [(f"{len(prompts)}-{seed}-{k}", 0.5) for k in range(len(prompts))]

    rows = G.samples(plan(spark, 6).where("job_id = 2"), generate).collect()
    told = {r.sample_in_job: (r.generation_seed, r.continuation) for r in rows}
    base = 2026 + 200_000
    want = {k: (base + k, f"1-{base + k}-0") for k in range(3)} | {k: (base + 3, f"3-{base + 3}-{k - 3}") for k in range(3, 6)}
    assert told == want


def test_wrong_numbers_of_samples_are_refused(spark):
    with pytest.raises(Exception, match="samples came of"):
        G.samples(plan(spark, 6), lambda prompts, n, seed: [("A", 0.0)] * 99).collect()
