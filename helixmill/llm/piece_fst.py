"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The normaliser (space to U+2581, a prefix before the first word), the pieces and the byte fallback are compiled
into one machine: arcs read characters and write piece ids. Composed with an input it is a lattice, and the answer is
its tropical-semiring shortest path. For unigram models an arc weighs minus its piece's score. For merge models the
machine's states also hold the last piece, and an arc weighs 0 if the two pieces, taken together, merge into just
these two, and infinity if not: exactly one path, the model's own segmentation, has a finite weight. As no piece spans
certain places (before U+2581 after another sign; around signs that no piece holds), inputs are composed stretch by
stretch, and each different stretch once per worker.

Null texts are encoded as empty. Characters outside the vocabulary become byte pieces and decode to themselves.
Decoding turns U+2581 in a text to a space, as the model format has it. The machine is rebuilt in each worker."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, MERGES = 1, 2
#: Stretches that a worker keeps; beyond, it starts anew. Affects speed only.
CACHE = 800_000
INF = float("inf")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        n = shift = 0
        while True:
            c = data[i]
            i += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while i < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            n = number()
            yield tag >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", data[i : i + n])[0]
            i += n


class Transducer:
    """Normaliser, pieces and byte fallback of a model, compiled."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model, prefix, squeeze, charsmap = UNIGRAM, 1, 1, b""
        for field, value in fields(data):
            if field == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(piece.get(2, 0.0)))
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                self.model = dict(fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(fields(value))
                prefix, squeeze, charsmap = norm.get(3, 1), norm.get(4, 1), norm.get(2, b"")
        if charsmap or squeeze:
            raise ValueError("only models with an identity normaliser are compiled")
        self.prefix = SPACE if prefix else ""
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = [self.ids.get(f"<0x{b:02X}>", -1) for b in range(256)]
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.trie: dict = {}
        for p, i in self.ids.items():
            at = self.trie
            for c in p:
                at = at.setdefault(c, {})
            at[""] = i
        spanning = {c for p in self.ids if len(p) > 1 for c in p}
        cuts = "".join(re.escape(c) for c in "\n\t\r" if c not in spanning and c != SPACE)
        space_inside = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        stop = f"{SPACE}{cuts}"
        self.stretch = None if space_inside else re.compile(f"{SPACE}*[^{stop}]+|{SPACE}+|[{cuts}]" if cuts else f"{SPACE}*[^{stop}]+|{SPACE}+")
        self.floor = min(self.scores) - 10.0
        self.pairs: dict[tuple[int, int], float] = {}
        self.spelled = [self.spell(i) for i in range(len(self.pieces))]
        self.found: dict[str, bytes] = {}

    def spell(self, i: int) -> bytes:
        """Bytes that a piece writes when decoded."""
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == UNKNOWN:
            return " ⁇ ".encode()
        return self.pieces[i].replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[str]:
        """The model's merges of a short string, best score and then leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[self.ids[a + b]], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def weight(self, last: int, piece: int) -> float:
        """Of a merge model's arc that writes a piece after the last one (-1: none, or bytes)."""
        parts = [self.pieces[i] for i in (last, piece) if i >= 0]
        x = self.pairs[last, piece] = 0.0 if self.merged("".join(parts)) == parts else INF
        return x

    def shortest(self, text: str) -> list[int]:
        """Ids of the shortest path of the machine composed with a stretch."""
        n = len(text)
        merges, pairs = self.model == MERGES, self.pairs
        # states at a place: last piece (-1: none, or not looked at) to (weight, place before, state before, ids)
        at: list[dict[int, tuple[float, int, int, tuple[int, ...]]]] = [{} for _ in range(n + 1)]
        at[0][-1] = (0.0, 0, -1, ())
        for i in range(n):
            states = at[i]
            if not states:
                continue
            node, j, arcs = self.trie, i, []
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    arcs.append((j, node[""]))
            single = text[i] in self.ids
            if not single:  # byte fallback
                out = tuple(self.bytes[b] for b in text[i].encode()) if self.bytes[0] >= 0 else (self.kinds.index(UNKNOWN),)
                last, (w, *_) = min(states.items(), key=lambda s: s[1][0])
                w += 0.0 if merges else -self.floor * len(out)
                if -1 not in at[i + 1] or at[i + 1][-1][0] > w:
                    at[i + 1][-1] = (w, i, last, out)
            for j, piece in arcs:
                to = at[j]
                if merges:  # one path at most reaches a piece with a finite weight
                    for last in states:
                        x = pairs.get((last, piece))
                        if (self.weight(last, piece) if x is None else x) < INF:
                            to[piece] = (0.0, i, last, (piece,))
                            break
                else:
                    x = states[-1][0] - self.scores[piece]
                    if -1 not in to or to[-1][0] > x:
                        to[-1] = (x, i, -1, (piece,))
        if not at[n]:
            raise ValueError("no path")
        state = min(at[n], key=lambda s: at[n][s][0])
        out: list[tuple[int, ...]] = []
        while n:
            _, n, state, ids = (entry := at[n][state])
            out.append(entry[3])
        return [x for ids in reversed(out) for x in ids]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        text = self.prefix + text.replace(" ", SPACE)
        stretches = self.stretch.findall(text) if self.stretch else [text]
        found = self.found
        if len(found) > CACHE:
            found.clear()
        for s in set(stretches).difference(found):
            found[s] = struct.pack(f"<{len(ids := self.shortest(s))}i", *ids)
        return b"".join(map(found.__getitem__, stretches))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        with open(path, "rb") as f:
            _machines[path] = Transducer(f.read())
    return _machines[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of each text; ``model`` is a file that every executor has."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model)
        for batch in slices(batches, "text"):
            ids = [np.frombuffer(own.encode(t or ""), "<i4") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(walk, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model)
        for batch in batches:
            texts = [own.decode(np.array(x or [], "<i4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(walk, "doc_id long, text string")


def piece_facts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, round_trip): digests of the ids, and of the text decoded from them."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [own.encode(t) for t in texts]
            back = [own.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]), pa.array([a == b for a, b in zip(texts, back, strict=True)])],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(walk, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
