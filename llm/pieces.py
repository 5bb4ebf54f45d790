"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A space (U+0020) becomes the marker, with one marker before the text; other white space stays itself and is a piece or
bytes like any character. The best segmentation has the greatest sum of the pieces' log scores; characters without a
piece fall back to their bytes. No piece holds a marker after another character, so the text is cut before such markers
and each distinct stretch is segmented once a worker.

The scores of a unigram model file are log probabilities and are used as they are. Those of a file of merges are only
ranks; they become log probabilities by Zipf's law, log p = -log(rank + 2.7) less the logarithm of the sum over all
pieces, so that they add up to one. Nothing is counted or trained for this. A character that falls back costs
UNKNOWN_PENALTY more than the least likely piece.

Defined results: null or empty text has no pieces and decodes to nothing; ties go to the longer last piece; the marker
itself in a text decodes as a space; null doc_ids and repeated rows are encoded like any other; texts of any length are
whole; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents

MARK = "▁"
NORMAL, BYTE, UNIGRAM = 1, 6, 1
UNKNOWN_PENALTY, ZIPF = 10.0, 2.7
CACHE_ROWS, CACHE_CHARS = 400_000, 48
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(file: str) -> list[tuple[str, float, int]]:
    """Piece, log score and type of each id of a SentencePiece model file."""
    with open(file, "rb") as model:
        data = model.read()
    out, kind = [], UNIGRAM
    for number, value in _fields(data):
        if number == 1:
            one = dict(_fields(value))
            out.append((one[1].decode(), float(np.frombuffer(one.get(2, bytes(4)), "<f4")[0]), one.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
    return out if kind == UNIGRAM else ranked(out)


def ranked(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Pieces whose scores are ranks (the best has the highest) with log probabilities instead."""
    normal = sorted((i for i, (_, _, kind) in enumerate(pieces) if kind == NORMAL), key=lambda i: -pieces[i][1])
    score = -np.log(np.arange(1, len(normal) + 1) + ZIPF)
    score -= np.log(np.exp(score).sum())
    of = dict(zip(normal, score.tolist()))
    return [(p, of.get(i, s), kind) for i, (p, s, kind) in enumerate(pieces)]


class DoubleArray:
    """A trie in two arrays: the child of state s by byte b is base[s] + b + 1, if check of that is s. value: what a key ends in, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys:
            s = 0
            for b in key:
                if b not in children[s]:
                    children[s][b] = len(children)
                    children.append({})
                    ends.append(-1)
                s = children[s][b]
            ends[s] = value
        self.base, self.check, self.value = [0], [0], [ends[0]]
        free, top = 1, 1
        todo = [(0, 0)]
        taken = bytearray(1 << 20)
        taken[0] = 1
        while todo:
            node, state = todo.pop()
            kids = sorted(children[node])
            if not kids:
                self.base[state] = -1 << 30
                continue
            while taken[free]:
                free += 1
            # first fit from the first free place, or else behind everything
            for base in range(max(0, free - kids[0] - 1), max(0, free - kids[0] - 1) + 64):
                if not any(taken[base + k + 1] for k in kids):
                    break
            else:
                base = max(0, top - kids[0] - 1)
            if base + 600 > len(taken):
                taken += bytearray(len(taken))
            self.base[state] = base
            top = max(top, base + kids[-1] + 2)
            if top > len(self.base):
                grow = top - len(self.base)
                self.base += [-1 << 30] * grow
                self.check += [-1] * grow
                self.value += [-1] * grow
            for k in kids:
                to = base + k + 1
                taken[to] = 1
                self.check[to], self.value[to] = state, ends[children[node][k]]
                todo.append((children[node][k], to))
        self.base += [-1 << 30] * 300
        self.check += [-1] * 300
        self.value += [-1] * 300


class Codec:
    def __init__(self, file: str):
        self.pieces = read_model(file)
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(self.pieces) if kind == NORMAL]
        self.trie = DoubleArray([(p.encode(), i) for i, p, _ in normal])
        self.unknown = min(s for _, _, s in normal) - UNKNOWN_PENALTY
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.score = np.array([s for _, s, _ in self.pieces])
        for b, i in self.bytes.items():  # a fallen-back character counts once, by its first byte
            self.score[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown
        self.scores = self.score.tolist()
        self.text = [b"" if kind not in (NORMAL, BYTE) else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        self.cache: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation."""
        data = text.encode()
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        none = float("-inf")
        best, back, piece = [none] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            b = data[start]
            if 0x80 <= b < 0xC0:
                continue
            so_far = best[start]
            size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            whole = False
            state, at = 0, start
            while at < n:
                to = base[state] + data[at] + 1
                if to < 0 or check[to] != state:
                    break
                state = to
                at += 1
                i = value[state]
                if i >= 0:
                    s = so_far + scores[i]
                    if s > best[at]:
                        best[at], back[at], piece[at] = s, start, i
                    whole = whole or at - start == size
            if not whole and so_far + self.unknown > best[start + size]:
                best[start + size], back[start + size], piece[start + size] = so_far + self.unknown, start, -1
        out: list[int] = []
        at = n
        while at:
            start = back[at]
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [self.bytes[b] for b in reversed(data[start:at])]
            at = start
        return out[::-1]

    def _stretch(self, text: str) -> bytes:
        found = self.cache.get(text)
        if found is None:
            found = np.array(self.segment(text), "<u2").tobytes()
            if len(text) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_ROWS:
                    self.cache.clear()
                self.cache[text] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u2")
        stretches = _STRETCH.findall(MARK + text.replace(" ", MARK))
        get, one = self.cache.get, self._stretch
        return np.frombuffer(b"".join([get(s) or one(s) for s in stretches]), "<u2")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(file: str) -> Codec:
    if file not in _codecs:
        _codecs[file] = Codec(file)
    return _codecs[file]


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and score (the sum of the pieces' log scores) of each row of docs."""
    file = model or piece_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([float(c.score[x].sum()) for x in ids])], names=["doc_id", "ids", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, score double")


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    file = model or piece_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


_DIGEST = "doc_id long, n_pieces long, n_fallback_bytes long, score double, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    file = piece_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        fallback = np.zeros(len(c.pieces), np.bool_)
        fallback[list(c.bytes.values())] = True
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                ids = c.encode(text)
                back = c.decode(ids)
                out.append((doc_id, len(ids), int(fallback[ids].sum()), float(c.score[ids].sum()), zlib.crc32(ids.astype("<u4")), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(MARK, " ")))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.bool_()))], names=[x.split()[0] for x in _DIGEST.split(", ")])

    docs = documents(spark, sf_dir)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _DIGEST)
