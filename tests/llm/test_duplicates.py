"""N-gram Jaccard join, passages and the pipeline against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from helixmill.llm import best_fit_pack, language_id, ngram_join, paragraph_dedup, pii_bootstrap
from helixmill.llm.queries import ORACLES, QUERIES

from ..conftest import SF_DIR, assert_same
from .conftest import prose


def plain_groups(rows: list[tuple], words: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()
    up = {d: d for d in sets}

    def root(d: int) -> int:
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def near(r: random.Random, text: str, changes: int) -> str:
    w = text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_groups_by_brute_force(spark, words, percent):
    r = random.Random(words)
    rows, k = [], 0
    for n in (1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 80, 160, 300, 700):
        for _ in range(3):
            base = prose(r, n, 300)
            for _ in range(r.choice((1, 2, 6))):
                k += 1
                rows.append((k, near(r, base, r.choice((0, 0, 1, 1, 2, 3))) if n > 1 else base))
    base = prose(r, 120)
    for _ in range(40):  # a chain, whose ends are far apart
        k += 1
        base = near(r, base, 1)
        rows.append((k, base))
    rows += [(k + 1, None), (k + 2, ""), (k + 3, " \n"), (k + 4, "A b C d e"), (k + 5, "a B c D e"), (k + 6, "é É é É é")]
    want = plain_groups(rows, words, percent)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_op4_by_sql(spark, duck):
    assert_same(QUERIES["op4_ngram_join"](spark, SF_DIR), duck, ORACLES["op4_ngram_join"])


def test_groups_odd_rows(odd, clashing, nothing):
    rows = ngram_join.similar_groups(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for x in rows:
        by[x.doc_id].add((x.n_shingles, x.component_id))
    assert by[7] == {(76, 7)} and by[8] == {(76, 7)} and by[1] == {(0, 1)} and by[4] == {(1, 4)} and by[5] == {(1, 4)}
    assert sorted(map(str, rows)) == sorted(map(str, ngram_join.similar_groups(clashing).collect()))
    assert ngram_join.similar_groups(nothing).count() == 0


def test_planted_passages_go_and_clean_texts_stay(spark):
    r = random.Random(11)
    passage, other = prose(r, 60), prose(r, 55)
    rows = [(k, f"{prose(r, r.randrange(30, 300))} {passage if k % 3 else other} {prose(r, r.randrange(0, 200))}") for k in range(30)]
    rows += [(100, near(r, rows[0][1], 1)), (101, rows[1][1])]
    rows += [(200 + k, prose(r, 150)) for k in range(20)]
    got = defaultdict(list)
    for x in paragraph_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert x.keep_id < x.doc_id and x.component_id <= x.keep_id
        got[x.doc_id].append((x.start, x.end))
    texts = dict(rows)
    for k in range(2, 30):
        if k == 3:
            continue
        a = texts[k].index(passage if k % 3 else other)
        b = a + len(passage if k % 3 else other)
        assert any(s <= a + 8 and e >= b - 8 for s, e in got[k]), k
        assert sum(e - s for s, e in got[k]) <= b - a + 60
    assert got[101] == [(0, len(texts[101]))] and got[100]
    assert not any(k in got for k in (0, 1, *range(200, 220)))


def test_passages_odd_rows(odd, clashing, nothing):
    rows = paragraph_dedup.passages(odd.select("doc_id", "text")).collect()
    assert {x.doc_id for x in rows} <= {5, 8}
    out = paragraph_dedup.without_passages(clashing)
    assert out.columns == clashing.columns and {x.doc_id for x in out.collect()} >= {1, 2, 6, 7}
    assert paragraph_dedup.without_passages(nothing).count() == 0


def test_stages_and_results(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_join", "paragraph_dedup", "pii_bootstrap", "best_fit_pack"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    now, scratch = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF_DIR)
        if k + 1 < len(names):
            assert out.columns == docs.columns
        scratch[name] = (now.collect(), out.collect())
        now = spark.createDataFrame(scratch[name][1], out.schema)
    # languages: what is kept was not rejected
    rows, kept = scratch["language_id"]
    told = {x.doc_id: x for x in language_id.predict(docs, language_id.fit(docs.where(~language_id.held_out()))).collect()}
    assert {x.doc_id for x in kept} == {x.doc_id for x in rows if not told[x.doc_id].rejected}
    assert all(x.lang == told[x.doc_id].lang_pred for x in kept)
    # groups: the smallest id of each stays
    rows, kept = scratch["ngram_join"]
    groups = plain_groups([(x.doc_id, x.text) for x in rows], 5, 80)
    assert {x.doc_id for x in kept} == {d for d, (_, c) in groups.items() if c == d}
    # passages: the text without the removals
    rows, kept = scratch["paragraph_dedup"]
    spans = defaultdict(list)
    for x in paragraph_dedup.passages(spark.createDataFrame(rows, docs.schema).select("doc_id", "text")).collect():
        spans[x.doc_id].append((x.start, x.end))
    want = {}
    for x in rows:
        text, at, parts = x.text, 0, []
        for a, b in sorted(spans[x.doc_id]):
            parts.append(text[at:a])
            at = b
        text = "".join([*parts, text[at:]])
        if re.search(r"[^\x20\x09-\x0D]", text):
            want[x.doc_id] = (text, len(text))
    assert {x.doc_id: (x.text, x.n_chars) for x in kept} == want
    # personal data: none of the base kinds is left
    rows, kept = scratch["pii_bootstrap"]
    assert len(rows) == len(kept)
    left = pii_bootstrap.report(pii_bootstrap.find(spark.createDataFrame(kept, docs.schema))).collect()
    assert sum(x.n_email + x.n_card + x.n_phone for x in left) == 0
    rows, packed = scratch["best_fit_pack"]
    assert {x.doc_id for x in packed} == {x.doc_id for x in rows}
    spark.conf.unset(corpus_pipeline.BATCHES)
    assert sorted(map(str, corpus_pipeline.run(spark, SF_DIR).drop("sequence_id", "offset").collect())) == sorted(str(x) for x in spark.createDataFrame(packed, best_fit_pack.pack(now.limit(0).selectExpr("doc_id", "0 piece", "0L start", "0L length", "0L ids_crc32")).schema).drop("sequence_id", "offset").collect())
    assert spark.conf.get(corpus_pipeline.BATCHES, None) in (None, "10000")  # the session has its setting again


def test_stages_take_odd_rows(spark, odd, clashing, nothing):
    for docs in (odd, clashing, nothing):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            out.collect()
            if stage is not corpus_pipeline.pack:
                assert out.columns == docs.columns
