"""Sequence packing by lexical retrieval.

Documents are tokenised once, into a table in the shared folder, while the documents that hold each token are counted
over the whole table. They are then sorted by their two most telling tokens, so that texts with a rare token in common
come together, and cut into shards of a bounded number of tokens. A shard has an inverted index with BM25 weights, from
the counts of the whole table. A seed document opens a window; the index names the shard's most similar unused
documents, best first, which fill the window up to its last token. What is left of a document that was cut seeds the
next window. The sort is by ranges of both tokens and the row's own number, so a token that a third of all documents
share is spread over many tasks, and a shard's size (and a task's memory) does not depend on the size or skew of the
table. A shard's last window is split at powers of two, so that no sequence needs padding.

Defined results: null text counts as empty (its single token is the end mark); null doc_ids and repeated rows are packed
like any other row; texts of any length are cut over as many windows as they need; an empty table gives no pieces;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import SHARES, added_up, documents, partitions, release, shares, slices, written

WINDOW, END, SHARD_TOKENS = 2048, 1, 1 << 20
#: Numbers of tokens; bytes of ids that a task packs, about.
IDS, PART_BYTES = 1 << 16, 64 << 20
K1, B = 1.2, 0.75
#: A term that one document in so many holds has a row of weights instead of a list.
ROW = 8
#: Two white spaces (of Unicode) next to each other.
RUNS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}"


def byte_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids (unsigned 16 bits) of a byte-level BPE vocabulary. A text goes to the encoder whole: where words are new to it as often as
    not, a cache of words costs more than it saves.

    The pattern of words looks ahead only to leave the last of several white spaces to the word behind them. Where no two are
    next to each other the pattern without that finds the same words, and needs no search that turns back."""

    def __init__(self, file: str):
        with open(file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    @cached_property
    def own(self):
        import public_tokenizers

        return self._encoding(public_tokenizers.PATTERN)

    @cached_property
    def plain(self):
        import public_tokenizers

        return self._encoding(public_tokenizers.PATTERN.replace(r"|\s+(?!\S)|\s+", r"|\s+"))

    def _encoding(self, pattern: str):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={"<|endoftext|>": len(self.ranks)})

    def many(self, texts: pa.Array) -> list[bytes]:
        runs = pc.match_substring_regex(texts, RUNS).to_pylist()
        return [(self.own if run else self.plain).encode_to_numpy(t, allowed_special="all").astype("<u2").tobytes() if t else b"" for t, run in zip(texts.to_pylist(), runs)]

    def __call__(self, text: str) -> bytes:
        return self.many(pa.array([text], pa.string()))[0]


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder for a worker process."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


class Corpus:
    """Documents and tokens of a whole table, and the documents that hold each token: of fixed size."""

    def __init__(self, docs: int, tokens: int, df: np.ndarray):
        self.mean = tokens / max(1, docs)
        self.idf = np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32)


def terms_of(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, token and frequency of each distinct pair of them, by token, then document."""
    n = len(lengths)
    key, bits = (np.uint32, 16) if n <= 1 << 16 else (np.uint64, 32)  # a pair in one number: these sort without an order beside them
    pairs = ids.astype(key) << key(bits) | np.repeat(np.arange(n, dtype=key), lengths)
    pairs.sort()
    at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    tf = np.diff(np.append(at, len(pairs)))
    pairs = pairs[at]
    return (pairs & key((1 << bits) - 1)).astype(np.int32), (pairs >> key(bits)).astype(np.int32), tf


def telling(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens of each document that tell most about it: the latest in the vocabulary, whose order is that of merges and so from common to rare. The second is -1 where there is one token only."""
    starts = np.cumsum(lengths) - lengths
    wide = ids.astype(np.int64)
    first = np.maximum.reduceat(wide, starts)
    wide[wide == np.repeat(first, lengths)] = -1
    return first, np.maximum.reduceat(wide, starts)


class Bm25Index:
    """Postings of a shard: for each term its documents and their BM25 weights. A term of many documents has a row with a
    place for each instead of a list, and once half of the documents are used, postings are kept for the others only."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, corpus: Corpus | None = None):
        n = len(lengths)
        doc, term, tf = terms_of(ids, lengths)
        self.df = np.bincount(term, minlength=IDS)
        corpus = corpus or Corpus(n, int(lengths.sum()), self.df)
        scale = (K1 * (1 - B + B * lengths / max(1.0, corpus.mean))).astype(np.float32)
        weight = corpus.idf[term] * (tf * np.float32(K1 + 1)) / (tf + scale[doc])
        order = np.argsort(doc.astype(np.uint16) if n <= IDS else doc, kind="stable")
        self.doc, self.term, self.weight = doc[order], term[order], weight[order]
        self.before = np.searchsorted(self.doc, np.arange(n + 1))
        self._post(np.arange(n), doc, term, weight)

    def _post(self, left: np.ndarray, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Postings by term of the documents left; doc: places in left."""
        self.left = left
        n = np.bincount(term, minlength=IDS)
        many = np.flatnonzero(n * ROW >= max(ROW, len(left)))
        self.row = np.full(IDS, -1)
        self.row[many] = np.arange(len(many))
        row = self.row[term]
        rest = row < 0
        self.rows = np.zeros((len(many), len(left)))
        self.rows[row[~rest], doc[~rest]] = weight[~rest]
        n[many] = 0
        self.ends = np.cumsum(n)
        self.starts = self.ends - n
        self.of_doc, self.of_weight = doc[rest].astype(np.intp), weight[rest].astype(np.float64)

    def _drop(self, used: np.ndarray) -> None:
        place = np.full(len(used), -1)
        left = self.left[~used[self.left]]
        place[left] = np.arange(len(left))
        keep = place[self.doc] >= 0
        doc, term, weight = place[self.doc[keep]], self.term[keep], self.weight[keep]
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self._post(left, doc[order], term[order], weight[order])

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, ties by position."""
        free = ~used[self.left]
        if 2 * np.count_nonzero(free) < len(free):
            self._drop(used)
            free = np.ones(len(self.left), np.bool_)
        terms = self.term[self.before[seed] : self.before[seed + 1]]
        terms = terms[self.df[terms] > 1]
        row = self.row[terms]
        score = self.rows[row[row >= 0]].sum(axis=0)
        terms = terms[row < 0]
        starts, ends = self.starts[terms], self.ends[terms]
        held = ends > starts
        parts = list(map(slice, starts[held].tolist(), ends[held].tolist()))
        if parts:
            score += np.bincount(np.concatenate([self.of_doc[p] for p in parts]), np.concatenate([self.of_weight[p] for p in parts]), len(score))
        score *= free
        found = np.flatnonzero(score)
        return self.left[found[np.argsort(-score[found], kind="stable")]]


def pack_shard(ids: np.ndarray, lengths: np.ndarray, window: int, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a shard: document, start, length, sequence, offset. Every token is in one piece, every sequence but those of the last window is full."""
    index = Bm25Index(ids, lengths, corpus)
    n = len(lengths)
    used = np.zeros(n, np.bool_)
    size = lengths.tolist()
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, at, next_seed = 0, 0, 0
    doc, done = -1, 0  # the document being placed, and how much of it is

    def fill() -> None:
        nonlocal sequence, at, done
        while done < size[doc]:
            take = min(window - at, size[doc] - done)
            pieces.append((doc, done, take, sequence, at))
            done += take
            at += take
            if at == window:
                sequence, at = sequence + 1, 0
                if done < size[doc] < done + window:
                    return  # its last part seeds the new window

    while True:
        if doc < 0 or done >= size[doc]:
            while next_seed < n and used[next_seed]:
                next_seed += 1
            if next_seed == n:
                break
            doc, done = next_seed, 0
            used[doc] = True
        seed = doc
        fill()
        while done < size[doc]:
            fill()
        if at:
            for other in index.neighbours(seed, used):
                doc, done = int(other), 0
                used[doc] = True
                fill()
                if not at or done < size[doc]:
                    break
    if not at:
        return pieces
    # the last window, cut at powers of two
    tail = [p for p in pieces if p[3] == sequence]
    del pieces[len(pieces) - len(tail) :]
    sizes = [1 << k for k in range(window.bit_length(), -1, -1) if at >> k & 1]
    room, place = sizes[0], 0
    for d, start, length, _, _ in tail:
        while length:
            take = min(room, length)
            pieces.append((d, start, take, sequence, place))
            start, length, room, place = start + take, length - take, room - take, place + take
            if not room:
                sequence += 1
                sizes.pop(0)
                room, place = sizes[0] if sizes else 0, 0
    return pieces


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_TOKENS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("ids", pa.binary()), ("share", pa.int64()), ("counts", pa.binary())])
_TOKENS_SQL = "doc_id long, row long, first long, second long, ids binary, share long, counts binary"


def _tokenised(file: str):
    """Documents -> their ids and most telling tokens; then the task's counts, in rows of share and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(file).many, np.array([END], "<u2").tobytes()
        row = TaskContext.get().partitionId() << 36
        total = np.zeros(IDS + SHARES, np.int64)  # behind the tokens' documents: documents and tokens
        for batch in slices(batches):
            texts = [x + end for x in encode(batch.column(1))]
            lengths = np.fromiter((len(x) // 2 for x in texts), np.int64, len(texts))
            n = len(texts)
            if not n:
                continue
            ids = np.frombuffer(b"".join(texts), "<u2")
            total[:IDS] += np.bincount(terms_of(ids, lengths)[1], minlength=IDS)
            total[IDS : IDS + 2] += n, lengths.sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(row, row + n)), *map(pa.array, telling(ids, lengths)), pa.array(texts, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_TOKENS)
            row += n
        share, counts = shares(total)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(SHARES, f.type) for f in list(_TOKENS)[:5]], pa.array(share, pa.int64()), pa.array(counts, pa.binary())], schema=_TOKENS)
        release()

    return run


def _pack(window: int, shard_tokens: int, corpus: Corpus, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        names: list = []
        texts: list[bytes] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            lengths = np.fromiter((len(x) // 2 for x in texts), np.int64, len(texts))
            ids = np.frombuffer(b"".join(texts), "<u2")
            found = pack_shard(ids, lengths, window, corpus)
            before = np.cumsum(lengths) - lengths
            wide = ids.astype("<u4")
            columns = list(zip(*found))
            at = [int(before[d]) + s for d, s in zip(columns[0], columns[1])]
            out = [
                [names[d] for d in columns[0]], columns[1], columns[2],
                [zlib.crc32(wide[a : a + k]) for a, k in zip(at, columns[2])],
                lengths[list(columns[0])], [first + s for s in columns[3]], columns[4],
            ]
            first += columns[3][-1] + 1
            arrays = [pa.array(x, pa.int64()) for x in out]
            if with_ids:
                arrays.append(pa.array([wide[a : a + k].astype(np.int32) for a, k in zip(at, columns[2])], pa.list_(pa.int32())))
            names.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _PIECE.split(", ")] + ["ids"] * with_ids)

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(doc_id)
                texts.append(ids)
                tokens += len(ids) // 2
                if tokens >= shard_tokens:
                    yield packed()
                    tokens = 0
        if texts:
            yield packed()

    return run


def packed(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids where asked for."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(source.mapInArrow(_tokenised(tokenizer or byte_bpe_file()), _TOKENS_SQL), "packing-tokens", "zstd")
    total = added_up(found.where("share is not null"), IDS + SHARES)
    corpus = Corpus(int(total[IDS]), int(total[IDS + 1]), total[:IDS])
    rows = found.where("share is null").select("doc_id", "ids", "first", "second", "row")
    parts = max(partitions(docs.sparkSession), -(-2 * int(total[IDS + 1]) // PART_BYTES))
    rows = rows.repartitionByRange(parts, "first", "second", "row").sortWithinPartitions("first", "second", "row").select("doc_id", "ids")
    return rows.mapInArrow(_pack(window, shard_tokens, corpus, with_ids), _PIECE + ", ids array<int>" * with_ids)


def op4_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), with_ids=False)
