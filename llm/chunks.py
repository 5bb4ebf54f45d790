"""Documents in chunks, and exchanges of packed hashes between chunks and buckets of the hash space.

A chunk holds whole documents, chosen by a hash of doc_id (rows of one doc_id stay together, for they are ordered by
text), and is small enough for one task: there are as many chunks as the session has shuffle partitions, or more where the
table's files say that chunks would be larger than CHUNK_BYTES. What a chunk asks about its hashes goes to the buckets as
one row a bucket, each hash once however often the chunk holds it; what a bucket answers comes back as one row a chunk.
So a passage that a third of all documents share costs a bucket one entry a chunk, and there are never more messages than
hashes.
"""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Block, blocks, mix, partitions, plain

MESSAGE = "bucket int, chunk int, kind int, x binary, y binary, z binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
Message = tuple[int, int, int, bytes, bytes, bytes]
LEAST = -(1 << 63)
#: Bytes of a chunk's documents in the table's files, at most, where these can be told from the plan.
CHUNK_BYTES = 16 << 20


def pieces(docs: DataFrame) -> int:
    """How many chunks a table needs: the session's shuffle partitions, or more for a larger table."""
    size = int(docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 58 else 0  # what isn't known counts as enormous
    return max(partitions(docs.sparkSession), -(-known // CHUNK_BYTES))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if t is None else press.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], names=["chunk", "doc_id", "text"])


def chunked(docs: DataFrame, per_partition: int = 2, squeeze: bool = False) -> tuple[DataFrame, int]:
    """chunk, doc_id and text of each row, rows of a chunk together; the number of partitions (and of buckets).

    squeeze: the texts travel compressed one by one, which takes a third less room than the shuffle's own compression.
    """
    n = pieces(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(n * per_partition)).cast("int").alias("chunk")
    rows = rows.select(chunk, "doc_id", "text")
    if squeeze:
        rows = rows.mapInArrow(_squeezed, "chunk int, doc_id long, text binary")
    return rows.repartition(n, "chunk"), n


class Chunk:
    """The documents of a chunk by ascending doc_id (null first), ties by text."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table
        nulls = table.column("doc_id").null_count
        if nulls:
            table = pa.concat_tables([table.slice(table.num_rows - nulls), table.slice(0, table.num_rows - nulls)])
        self.number = table.column("chunk")[0].as_py() if table.num_rows else -1
        self.ids = table.column("doc_id")
        self.order = np.asarray(self.ids.fill_null(LEAST).combine_chunks()) if table.num_rows else np.zeros(0, np.int64)
        self.text = table.column("text")
        if pa.types.is_binary(self.text.type):
            open_ = zstandard.ZstdDecompressor()
            self.text = pa.array([None if t is None else open_.decompress(t) for t in self.text.to_pylist()], pa.large_binary())
        self.rows = table.num_rows

    def blocks(self) -> Iterator[Block]:
        return blocks(self.text)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash and the bytes of each whole text (null: empty)."""
        texts = plain(self.text).to_pylist()
        return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in texts), np.uint64), np.array([len(t) for t in texts], np.int64)

    def without(self, gone: np.ndarray) -> Chunk:
        """The chunk with empty texts in the given rows."""
        out = copy.copy(self)
        if gone.any():
            out.text = pc.if_else(pa.array(~gone), plain(self.text), pa.scalar(b"", pa.large_binary()))
        return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int32)


def to_buckets(chunk: int, hashes: np.ndarray, buckets: int, *more: np.ndarray, kind: int = 0, by: np.ndarray | None = None) -> list[Message]:
    """A message for each bucket with the hashes that fall into it (or whose by does), sorted as they come, and what goes with each."""
    where = bucket_of(hashes if by is None else by, buckets)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[b] : cuts[b + 1]]
        out.append((b, chunk, kind, hashes[at].tobytes(), *[m[at].tobytes() for m in more], *[b""] * (2 - len(more))))
    return out


def to_chunks(bucket: int, chunks: np.ndarray, kind: int, x: np.ndarray, y: np.ndarray | None = None) -> list[Message]:
    """A message for each chunk with its entries of x (and y)."""
    order = np.argsort(chunks, kind="stable")
    ordered = chunks[order]
    cuts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]]) if len(ordered) else np.zeros(1, int)
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at = order[lo:hi]
        out.append((bucket, int(ordered[lo]), kind, x[at].tobytes(), y[at].tobytes() if y is not None else b"", b""))
    return out


def message_table(messages: list[Message]) -> pa.Table:
    columns = list(zip(*messages)) if messages else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class Received:
    """The messages of one bucket or chunk."""

    def __init__(self, table: pa.Table, kind: int | None = None):
        kinds = table.column("kind").to_pylist()
        rows = [k for k, x in enumerate(kinds) if kind is None or x == kind]
        self.bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        self.senders = [table.column("chunk")[k].as_py() for k in rows]
        self._columns = {c: [table.column(c)[k].as_py() for k in rows] for c in "xyz"}

    def array(self, column: str, kind: type | str) -> np.ndarray:
        return np.frombuffer(b"".join(self._columns[column]), kind)

    def chunks(self, width: int = 8) -> np.ndarray:
        """The chunk of each entry of x."""
        return np.repeat(np.array(self.senders, np.int32), [len(x) // width for x in self._columns["x"]])

    def lengths(self, column: str) -> np.ndarray:
        """Bytes of each message's column."""
        return np.array([len(x) for x in self._columns[column]], np.int64)


def per_chunk(chunks: DataFrame, f: Callable[[Chunk], pa.Table], schema: str) -> DataFrame:
    return chunks.groupBy("chunk").applyInArrow(lambda table: f(Chunk(table)), schema)


def per_bucket(messages: DataFrame, f: Callable[[pa.Table], list[Message]]) -> DataFrame:
    return messages.groupBy("bucket").applyInArrow(lambda table: message_table(f(table)), MESSAGE)


def with_answers(chunks: DataFrame, answers: DataFrame, f: Callable[[Chunk, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of each chunk and of the messages that came for it."""
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda table, found: f(Chunk(table), found), schema)


def recurring(table: pa.Table) -> list[Message]:
    """Hashes that came from two chunks, or that a chunk marked (y) as held more than once -> back to each chunk that has them."""
    got = Received(table)
    hashes, marked, chunks = got.array("x", np.uint64), got.array("y", np.uint8), got.chunks()
    order = np.argsort(hashes, kind="stable")
    hashes, marked, chunks = hashes[order], marked[order].astype(np.bool_), chunks[order]
    again = marked.copy()
    same = hashes[1:] == hashes[:-1]
    again[1:] |= same
    again[:-1] |= same
    return to_chunks(got.bucket, chunks[again], 0, hashes[again])


def once(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, and whether each was there more than once."""
    found, n = np.unique(hashes, return_counts=True)
    return found, (n > 1).astype(np.uint8)


def member(hashes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each hash is in found, which is sorted."""
    if not len(found):
        return np.zeros(len(hashes), np.bool_)
    at = np.minimum(np.searchsorted(found, hashes), len(found) - 1)
    return found[at] == hashes
