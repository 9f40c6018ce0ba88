"""Constrained evolution of sequences: every (target, seed) is one search of a bounded population in a task of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .hairpin import best_hairpins
from .pareto import front_numbers

BASES = "ACGT"
RESULT = "target double, seed int, sequence string, score double, error double, generation int, pareto_rank int"
HISTORY = "target double, seed int, generation int, n_tried int, n_taken int, n_first_front int, best_error double"
#: Ways to make a child and their shares (the search's parameters).
WAYS = {"crossover": 0.3, "stem": 0.2, "loop": 0.15, "tail": 0.15, "point": 0.2}
CANONICAL = ("AT", "TA", "GC", "CG")
TAIL = 15

Judge = Callable[[list[str]], np.ndarray]


def draws(*parts: object) -> np.random.Generator:
    """A generator that depends on the parts alone, so a lost task gives the same again."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "little"))


def child(r: np.random.Generator, way: str, a: str, b: str, g: dict[str, int]) -> str:
    """A child of a by one way: spliced with b, a stem pair, a loop base, a T after the hairpin, or any base changed."""
    letters = list(a)
    if way == "crossover" and min(len(a), len(b)) > 2:
        cut = int(r.integers(1, min(len(a), len(b))))
        return a[:cut] + b[cut:]
    if way == "stem" and g["stem"]:
        k, pair = int(r.integers(0, g["stem"])), CANONICAL[int(r.integers(0, 4))]
        letters[g["start"] + k], letters[g["start"] + 2 * g["stem"] + g["loop"] - 1 - k] = pair
        return "".join(letters)
    begin, end = {"loop": (g["start"] + g["stem"], g["start"] + g["stem"] + g["loop"]), "tail": (g["start"] + 2 * g["stem"] + g["loop"], min(len(a), g["start"] + 2 * g["stem"] + g["loop"] + TAIL))}.get(way, (0, len(a)))
    if begin >= end or not g["stem"]:
        begin, end = 0, len(a)
    letters[int(r.integers(begin, end))] = "T" if way == "tail" else BASES[int(r.integers(0, 4))]
    return "".join(letters)


def offspring(r: np.random.Generator, population: list[str], n: int) -> list[str]:
    """``n`` children of random parents, by the shares of ``WAYS``."""
    found = best_hairpins(population)
    at = [{c: int(found[c][i]) for c in ("start", "stem", "loop")} for i in range(len(population))]
    ways = r.choice(list(WAYS), n, p=list(WAYS.values()))
    mates = r.integers(0, len(population), (n, 2))
    return [child(r, str(w), population[i], population[j], at[i]) for w, (i, j) in zip(ways, mates, strict=True)]


def supported(sequences: list[str], shortest: int, longest: int) -> np.ndarray:
    """Whether sequences have a hairpin and a natural length."""
    size = np.array([len(s) for s in sequences])
    return (best_hairpins(sequences)["stem"] > 0) & (size >= shortest) & (size <= longest)


def crowded(x: np.ndarray, front: np.ndarray) -> np.ndarray:
    """Crowding distance of each row within its front."""
    out = np.zeros(len(x))
    for f in set(front.tolist()):
        at = np.flatnonzero(front == f)
        for k in range(x.shape[1]):
            order = at[np.argsort(x[at, k], kind="stable")]
            v = x[order, k]
            out[order[[0, -1]]] = np.inf
            if v[-1] > v[0]:
                out[order[1:-1]] += (v[2:] - v[:-2]) / (v[-1] - v[0])
    return out


def searched(pdf: pd.DataFrame, score: Judge, distance: Judge, generations: int, population: int, children: int, budget: int, patience: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Members and history of one search.

    A generation tries children that are new and supported until the budget of evaluations is spent, and keeps of parents
    and children the best by front of (error of the target, distance), crowding, error and sequence. The search ends at the
    last generation, when nothing is left to spend, or when so many generations in a row did not lower the best error."""
    target, seed = float(pdf["target"].iloc[0]), int(pdf["seed"].iloc[0])
    natural = sorted(set(pdf["sequence"]))
    shortest, longest = min(map(len, natural)), max(map(len, natural))
    ok = supported(natural, shortest, longest)
    # natural sequences without a hairpin are taken only if there is no other
    born = {s: 0 for s, k in zip(natural, ok, strict=True) if k} or dict.fromkeys(natural, 0)
    known: dict[str, tuple[float, float]] = {}

    def judged(names: list[str]) -> np.ndarray:
        new = [s for s in names if s not in known]
        if new:
            known.update(zip(new, zip(score(new).tolist(), distance(new).tolist(), strict=True), strict=True))
        return np.array([(abs(known[s][0] - target), known[s][1]) for s in names])

    def first(names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        x = judged(names)
        front = front_numbers(x)
        far = crowded(x, front)
        best = sorted(range(len(names)), key=lambda i: (front[i], -far[i], x[i, 0], names[i]))[:population]
        return [names[i] for i in best], x[best], front[best]

    names, x, front = first(list(born))
    history, spent, still = [(target, seed, 0, len(natural), len(names), int((front == 0).sum()), float(x[:, 0].min()))], 0, 0
    for g in range(1, generations + 1):
        made = [c for c in dict.fromkeys(offspring(draws(target, seed, g), names, children)) if c not in known]
        if made:
            made = [c for c, k in zip(made, supported(made, shortest, longest), strict=True) if k][: budget - spent]
        spent += len(made)
        born |= dict.fromkeys(made, g)
        before = x[:, 0].min()
        names, x, front = first(list(dict.fromkeys([*names, *made])))
        history.append((target, seed, g, len(made), len(set(made) & set(names)), int((front == 0).sum()), float(x[:, 0].min())))
        still = 0 if x[:, 0].min() < before else still + 1
        if spent >= budget or still >= patience:
            break
    members = pd.DataFrame({"target": target, "seed": seed, "sequence": names, "score": [known[s][0] for s in names], "error": x[:, 0], "generation": [born[n] for n in names], "pareto_rank": front_numbers(x).astype("int32")})
    return members, pd.DataFrame(history, columns=["target", "seed", "generation", "n_tried", "n_taken", "n_first_front", "best_error"])


LIMITS = {"generations": 40, "population": 96, "children": 64, "budget": 512, "patience": 8}


def evolve(starts: DataFrame, score: Judge, distance: Judge, **limits: int) -> DataFrame:
    """Final populations from ``starts`` (target, seed, sequence), whose groups are bounded by the caller; ``limits`` as ``LIMITS``."""
    run = lambda pdf: searched(pdf, score, distance, **(LIMITS | limits))[0]
    return starts.select("target", "seed", "sequence").groupBy("target", "seed").applyInPandas(run, RESULT)


def generation_history(starts: DataFrame, score: Judge, distance: Judge, **limits: int) -> DataFrame:
    """One row for each generation of each search."""
    run = lambda pdf: searched(pdf, score, distance, **(LIMITS | limits))[1]
    return starts.select("target", "seed", "sequence").groupBy("target", "seed").applyInPandas(run, HISTORY)
