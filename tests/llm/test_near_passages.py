"""Passages with an edited word, of frequent keys, and from repeated places of the first document."""

from __future__ import annotations

import random

import pytest
from helixmill.llm import paragraph_dedup

from .conftest import prose


def edited(r: random.Random, words: list[str], kind: str) -> list[str]:
    k = r.randrange(1, len(words) - 1)
    return {"same": words, "substituted": [*words[:k], "zz", *words[k + 1 :]], "inserted": [*words[:k], "zz", *words[k:]], "deleted": words[:k] + words[k + 1 :]}[kind]


def found(spark, rows: list[tuple]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for x in paragraph_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert x.keep_id < x.doc_id
        out.setdefault(x.doc_id, []).append((x.start, x.end))
    return out


def planted(seed: int) -> tuple[list[tuple], dict[int, tuple[str, int, int]]]:
    r, rows, want = random.Random(seed), [], {}
    for kind in ("same", "substituted", "inserted", "deleted"):
        for n in (50, 52, 60, 70, 80, 100):
            for _ in range(15):
                words, k = prose(r, n).split(), len(rows)
                copy, before = " ".join(edited(r, words, kind)), prose(r, r.randrange(20, 60)) + " "
                rows += [(k, f"{prose(r, 40)} {' '.join(words)} {prose(r, 40)}"), (k + 1, f"{before}{copy} {prose(r, 30)}")]
                want[k + 1] = (f"{kind} {n}", len(before), len(before) + len(copy))
    return rows, want


@pytest.mark.parametrize("meet", [2000, 0])
def test_edited_passages_are_found(spark, monkeypatch, meet):
    monkeypatch.setattr(paragraph_dedup, "MEET", meet)
    rows, want = planted(3)
    got = found(spark, rows)
    assert set(got) <= set(want)
    for doc, (what, a, b) in want.items():
        assert sum(min(e, b) - max(s, a) for s, e in got.get(doc, []) if min(e, b) > max(s, a)) >= 0.8 * (b - a), what
        assert all(s >= a - 12 and e <= b + 12 for s, e in got[doc]), what


def test_lines_of_a_frequent_key(spark, monkeypatch):
    """A frequent line in other contexts is no passage; with the words around it, it is, by either way."""
    r = random.Random(7)
    line = prose(r, 40)
    rows = [(k, f"{prose(r, 60)} {line} {prose(r, 60)}") for k in range(60)]
    for k in range(0, 60, 3):
        body = f"{prose(r, 8)} {line} {prose(r, 8)}"
        rows += [(100 + k, f"{prose(r, 30)} {body} {prose(r, 30)}"), (101 + k, f"{prose(r, 50)} {body} {prose(r, 20)}")]
    for meet in (2000, 10):
        monkeypatch.setattr(paragraph_dedup, "MEET", meet)
        assert set(found(spark, rows)) == {101 + k for k in range(0, 60, 3)}


def test_each_place_of_the_first_document(spark):
    r, rows = random.Random(9), []
    for k in range(0, 200, 2):
        line = prose(r, 40)
        passage = f"{prose(r, 6)} {line} {prose(r, 6)}"
        rows += [(k, f"{prose(r, 30)} {line} {prose(r, 60)} {passage} {prose(r, 30)}"), (k + 1, f"{prose(r, 30)} {passage} {prose(r, 30)}")]
    assert set(found(spark, rows)) == set(range(1, 200, 2))


@pytest.mark.parametrize(("n", "changes"), [(60, 1), (100, 2), (200, 4)])
def test_recall_of_substituted_words(spark, n, changes):
    """Nine tenths of a passage are found in nine of ten cases at least, wherever the words are replaced."""
    r, rows, want = random.Random(n), [], {}
    for k in range(0, 120, 2):
        words = prose(r, n).split()
        copy = list(words)
        for p in r.sample(range(n), changes):
            copy[p] = "zz"
        before = prose(r, 40) + " "
        rows += [(k, f"{prose(r, 30)} {' '.join(words)} {prose(r, 30)}"), (k + 1, f"{before}{' '.join(copy)} {prose(r, 30)}")]
        a, b = [set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (words, copy)]
        if len(a & b) >= 0.8 * len(a | b):
            want[k + 1] = (len(before), len(before) + len(" ".join(copy)))
    got = found(spark, rows)
    whole = [sum(min(e, b) - max(s, a) for s, e in got.get(doc, []) if min(e, b) > max(s, a)) >= 0.9 * (b - a) for doc, (a, b) in want.items()]
    assert len(whole) > 20 and sum(whole) >= 0.9 * len(whole)


@pytest.mark.parametrize(("others", "changes"), [(9, 1), (9, 2), (40, 2)])
def test_edits_where_all_lines_are_frequent(spark, others, changes):
    """Pairs of passages of three lines, each of which stands in many other documents, with replaced words."""
    r, rows, want = random.Random(17 * others + changes), [], {}
    for k in range(30):
        lines = [prose(r, 33).split() for _ in range(3)]
        words = [w for line in lines for w in line]
        copy = list(words)
        for p in r.sample(range(len(words)), changes):
            copy[p] = "zz"
        a, b = [set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (words, copy)]
        before = prose(r, 40) + " "
        rows += [(100_000 + 2 * k, f"{prose(r, 30)} {' '.join(words)} {prose(r, 30)}"), (100_001 + 2 * k, f"{before}{' '.join(copy)} {prose(r, 30)}")]
        if len(a & b) >= 0.8 * len(a | b):
            want[100_001 + 2 * k] = (len(before), len(before) + len(" ".join(copy)))
        rows += [(1000 * k + 100 * i + j, f"{prose(r, 60)} {' '.join(line)} {prose(r, 60)}") for i, line in enumerate(lines) for j in range(others)]
    got = found(spark, rows)
    assert set(got) <= {100_001 + 2 * k for k in range(30)}
    whole = [sum(min(e, b) - max(s, a) for s, e in got.get(doc, []) if min(e, b) > max(s, a)) >= 0.9 * (b - a) for doc, (a, b) in want.items()]
    assert len(whole) > 15 and sum(whole) >= 0.9 * len(whole)


@pytest.mark.parametrize("large", [paragraph_dedup.LARGE, 0] if hasattr(paragraph_dedup, "LARGE") else [None])
def test_edits_where_all_surroundings_are_frequent(spark, monkeypatch, large):
    """Of each passage there are 600 smaller versions that are unlike each other and all later ones, but share each of its shingles: two
    versions that differ by one gap of up to three words still meet."""
    monkeypatch.setattr(paragraph_dedup, "LARGE", large, raising=False)
    r, rows, want = random.Random(23), [], {}
    for k in range(6):
        words = prose(r, 80).split()
        for j in range(600):
            cut = [False]
            while min(sum(cut[i : i + 45]) for i in range(36)) < 2 or any(sum(cut[i : i + 5]) > 1 for i in range(76)):
                cut = [r.random() < 1 / 12 for _ in words]
            other = " ".join(f"x{r.randrange(4000)}" if c else w for c, w in zip(cut, words, strict=True))
            rows.append((1000 * k + j, f"{prose(r, 20)} {other} {prose(r, 20)}"))
        p, n = r.randrange(36, 44), k // 3 + 1
        copy = " ".join({0: [*words[:p], *["zz"] * n, *words[p + n :]], 1: [*words[:p], *["zz"] * n, *words[p:]], 2: words[:p] + words[p + n :]}[k % 3])
        before = prose(r, 20) + " "
        rows += [(100_000 + 2 * k, f"{prose(r, 20)} {' '.join(words)} {prose(r, 20)}"), (100_001 + 2 * k, f"{before}{copy} {prose(r, 20)}")]
        want[100_001 + 2 * k] = (len(before), len(before) + len(copy))
    got = found(spark, rows)
    for doc, (a, b) in want.items():
        assert sum(min(e, b) - max(s, a) for s, e in got.get(doc, []) if min(e, b) > max(s, a)) >= 0.9 * (b - a), doc


def test_long_gaps_in_long_passages(spark):
    """Twenty words inserted after the fortieth of three hundred: a similarity of 0.91 as a whole."""
    r, rows, want = random.Random(21), [], {}
    for k in range(0, 40, 2):
        words = prose(r, 300).split()
        copy = " ".join([*words[:40], prose(r, 20), *words[40:]])
        before = prose(r, 40) + " "
        rows += [(k, f"{prose(r, 30)} {' '.join(words)} {prose(r, 30)}"), (k + 1, f"{before}{copy} {prose(r, 30)}")]
        want[k + 1] = (len(before), len(before) + len(copy))
    got = found(spark, rows)
    for doc, (a, b) in want.items():
        assert sum(min(e, b) - max(s, a) for s, e in got.get(doc, []) if min(e, b) > max(s, a)) >= 0.9 * (b - a)


def test_texts_that_share_an_id_are_cut_each_by_itself(spark):
    r = random.Random(12)
    passage, other = prose(r, 70), prose(r, 150)
    rows = [(1, f"{prose(r, 30)} {passage}"), (5, f"{prose(r, 20)} {passage} {prose(r, 20)}"), (5, other), (5, other), (6, other), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((x.doc_id, x.text) for x in paragraph_dedup.without_passages(docs).where("text is not null").collect())
    assert left.count((5, other)) == 2 and (1, rows[0][1]) in left and not any(d == 6 for d, _ in left)
    assert all(passage not in t for d, t in left if d == 5)


def test_a_word_that_repeats_itself(spark):
    r = random.Random(14)
    rows = [(1, f"{prose(r, 60)} {'na ' * 400}{prose(r, 60)}"), (2, f"{prose(r, 50)} {'na ' * 150}{prose(r, 50)}"), (3, "na " * 200), (4, f"{'a b c ' * 90}"), (5, f"{prose(r, 9)} {'b c a ' * 60}")]
    got = found(spark, rows)
    assert set(got) == {2, 3, 5}
    assert max(e - s for s, e in got[2]) >= 3 * 140 and max(e - s for s, e in got[3]) >= 3 * 190


def test_passages_by_brute_force(spark, documents):
    """Every run of 50 words that a smaller document holds is removed, and what is removed is four fifths in smaller ones."""
    rows = sorted({(x.doc_id, x.text) for x in documents.select("doc_id", "text").collect() if x.text})
    words = {d: [(m.group().encode().lower(), *m.span()) for m in paragraph_dedup.WORD.finditer(t)] for d, t in rows}
    first: dict[int, dict[tuple, int]] = {5: {}, 50: {}}
    for size, seen in first.items():
        for d, own in words.items():
            for k in range(len(own) - size + 1):
                seen.setdefault(tuple(w for w, _, _ in own[k : k + size]), d)
    got = found(spark, rows)
    assert got
    for d, own in words.items():
        gone = [any(a >= s and b <= e for s, e in got.get(d, [])) for _, a, b in own]
        for k in range(len(own) - 49):
            if first[50][tuple(w for w, _, _ in own[k : k + 50])] < d:
                assert all(gone[k : k + 50]), (d, k)
        for s, e in got.get(d, []):
            inside = [w for w, a, b in own if a >= s and b <= e]
            grams = {tuple(inside[k : k + 5]) for k in range(len(inside) - 4)}
            assert len(inside) >= paragraph_dedup.LEAST and sum(first[5][g] < d for g in grams) >= 0.8 * len(grams), (d, s, e)
