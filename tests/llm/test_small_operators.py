"""Sharding, packing, fingerprints, media and pieces against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helixmill.llm import best_fit_pack, jump_shards, media_columns, multiset_hash, piece_fst
from helixmill.llm.queries import QUERIES, tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ..conftest import SF_DIR


def plain_jump(key: int, shards: int) -> int:
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        to = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=40), st.integers(1, 40))
def test_jump_is_the_published_function(keys, shards):
    assert jump_shards.jump(np.array(keys, np.uint64), shards).tolist() == [plain_jump(k, shards) for k in keys]


def test_op3_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op3_jump_shards"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(rows) < 500 or any(r.grown_shard == 16 for r in rows)


def test_shard_odd_rows(odd, clashing, nothing):
    for df in (odd, clashing):
        got = jump_shards.shard_table(df, "doc_id", 4)
        assert set(df.columns) < set(got.columns) | {"shard", "slot"}
        rows = got.collect()
        assert len(rows) == df.count()
        for k in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert jump_shards.shard_table(nothing, "doc_id", 4).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=20))
def test_plan_fills_no_bin_twice(counts):
    plan, bins = best_fit_pack.packing_plan(counts, 60)
    taken = np.zeros((bins, 60), int)
    for r in plan.itertuples():
        for rank in range(r.first, r.last):
            d = rank - r.first
            at = r.used + d % r.each * r.length
            taken[r.bin + d // r.each, at : at + r.length] += 1
            assert at + r.length <= 60
    assert taken.max() <= 1 and taken.sum() == sum(k * n for k, n in counts.items())
    for row in taken:  # no gap before a piece
        assert row[: row.sum()].all()
    large = sum(n for k, n in counts.items() if 2 * k > 60)
    assert bins <= 1.34 * max(large, -(-int(taken.sum()) // 60)) + 2


def test_large_items_meet_at_most_twice():
    plan, bins = best_fit_pack.packing_plan({25: 4, 24: 2, 41: 1, 10: 3}, 60)
    per = defaultdict(int)
    for r in plan.itertuples():
        for rank in range(r.first, r.last):
            if r.length > 20:
                per[r.bin + (rank - r.first) // r.each] += 1
    assert max(per.values()) <= 2


def test_op8_contract(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op8_best_fit_pack"](spark, SF_DIR).collect()
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for doc, text in docs.items():
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert sorted(pieces[doc]) == list(range(-(-len(ids) // 4096)))
        for k, r in pieces[doc].items():
            part = ids[4096 * k : 4096 * k + 4096]
            assert (r.start, r.length, r.ids_crc32) == (4096 * k, len(part), zlib.crc32(part))
    total = 0
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(bins) <= -(-total // 4096) * 1.02 + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé漢🙂 \n\t0'.,!<|>startofx_-ſK"), max_size=30), min_size=1, max_size=6))
def test_word_encoder_is_the_library(texts):
    own = best_fit_pack.encoder(tokenizer_path("word_bpe_49k.json"))
    ids, starts = own.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, starts, starts[1:], strict=False):
        assert ids[a:b].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_pack_odd_rows(odd, clashing, nothing):
    path = tokenizer_path("word_bpe_49k.json")
    a = best_fit_pack.pack_documents(odd, path).collect()
    assert sum(r.piece == 0 for r in a) == odd.count()
    assert sum(r.length for r in best_fit_pack.pack_documents(clashing, path).collect()) == sum(r.length for r in a)
    assert best_fit_pack.pack_documents(nothing, path).count() == 0


def test_op7_contract(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    rows = {r.doc_id: r for r in QUERIES["op7_multiset_hash"](spark, SF_DIR).collect()}
    assert set(rows) == {d for d, _ in docs}
    edits, prints = [], defaultdict(set)
    for (d, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        k = len(t) // 4
        edit = t[: len(t) - k] + u[:k]
        edits.append(edit)
        assert (rows[d].n_chars, rows[d].edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert 0 <= rows[d].near_edited <= 1 and 0 <= rows[d].near_next <= 1
        prints[t].add(rows[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({p for (p,) in prints.values()}) == len(prints)
    whole = multiset_hash.text_form(*multiset_hash.vectors(pa.array(edits, pa.string())))
    assert [rows[d].edited_fingerprint for d, _ in docs] == whole
    far = [rows[d].near_edited - rows[d].near_next for d, t in docs if len(t) > 400]
    assert np.mean(np.array(far) > 0) > 0.97


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", max_size=12), min_size=1, max_size=6), st.integers(0, 5), st.randoms())
def test_fingerprint_is_a_multiset_sum(lines, k, r):
    form = lambda t: multiset_hash.text_form(*multiset_hash.vectors(pa.array([t])))[0]
    mixed = lines[:]
    r.shuffle(mixed)
    assert form("\n".join(lines)) == form("\n".join(mixed))
    cut = lines[:]
    gone = cut.pop(k % len(lines))
    if cut:
        assert multiset_hash.combine(form("\n".join(cut)), form(gone)) == form("\n".join(lines))
        assert multiset_hash.combine(form("\n".join(lines)), form(gone), -1) == form("\n".join(cut))


def test_fingerprint_odd_rows(odd, clashing, nothing):
    rows = multiset_hash.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(map(str, rows)) == sorted(map(str, multiset_hash.edited_fingerprints(clashing).collect()))
    assert multiset_hash.edited_fingerprints(nothing).count() == 0
    one = odd.where("doc_id = 6")
    assert multiset_hash.edited_fingerprints(one).count() == 1


def test_op9_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op9_wav_landmarks"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = media_columns.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest())
        assert media[:4] == b"RIFF" and media_columns.from_wav(media) == payload


def test_landmarks_find_a_tone():
    tone = ((np.sin(np.arange(8000) * 2 * np.pi * 1000 / 8000) + 1) * 127 * (np.arange(8000) // 1000 % 2)).astype(np.uint8).tobytes()
    codes = media_columns.landmarks(tone)
    bins = set(((codes >> 15) & 511).tolist()) | set(((codes >> 6) & 511).tolist())
    assert 64 in bins  # 1000 Hz of 8000 in 512 bins
    assert (np.diff(codes >> 24) >= 0).all()


def test_media_odd_rows(odd, clashing, nothing):
    rows = media_columns.media_columns(odd)
    back = rows.withColumn("back", media_columns.text_of_media(F.col("media"), F.col("n_bytes"))).collect()
    assert all(r.back == (r.text or "") for r in back) and len(back) == odd.count()
    assert media_columns.media_columns(clashing).select("n_bytes", "facts").count() == odd.count()
    assert media_columns.media_columns(nothing).count() == 0


PIECES = tokenizer_path("piece_bpe_32k.model")


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdefTheanwing ▁\n\t.,0<>🙂é"), st.characters(blacklist_categories=("Cs",), blacklist_characters="\0")), max_size=60))
def test_pieces_are_the_library_s(text):
    import sentencepiece

    own = piece_fst.machine(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = np.frombuffer(own.encode(text), "<i4").tolist()
    assert ids == library.encode(text)
    assert own.decode(own.encode(text)) == text.replace("▁", " ")


def test_op10_over_documents(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = QUERIES["op10_piece_fst"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(library.encode(docs[r.doc_id]), "<i4")
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())) and r.round_trip


def test_pieces_odd_rows(odd, clashing, nothing):
    encoded = piece_fst.encode_pieces(odd, PIECES)
    back = {(r.doc_id, r.text) for r in piece_fst.decode_pieces(encoded, PIECES).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert piece_fst.piece_facts(clashing, PIECES).count() == odd.count()
    assert piece_fst.encode_pieces(nothing, PIECES).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns(spark, name):
    needed = {
        "op1_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op2_": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op3_": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op4_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op7_": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
        "op8_": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op9_": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    }
    if (want := needed.get(name[:4])) is None:
        pytest.skip("no fixed columns")
    assert want.items() <= dict(QUERIES[name](spark, SF_DIR).dtypes).items()
