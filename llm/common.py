"""Helpers shared by the training-data operators: table access, shared storage, vectorised text primitives."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker looks at together; longer documents stand alone.
BLOCK_BYTES = 1 << 19
SPACES = np.zeros(256, np.bool_)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a table written to the shared folder and read again: its lineage ends there, and no executor holds it alone."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(df: DataFrame) -> None:
    """Delete a table made by written() once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if path.startswith(shared_folder(spark).replace("file://", "file:").rstrip("/")) or path.startswith(shared_folder(spark)):
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_named(docs: DataFrame, stays: DataFrame, digest: Column) -> DataFrame:
    """The rows of docs, with all their columns, that stays (doc_id, digest, n) names by doc_id (null equals null) and the
    digest of their text. n: how many rows of docs have both; of such repeated rows one is taken."""
    key, sha, other, n = fresh(docs, "stays_id", "row_digest", "stays_digest", "stays_n")
    named = stays.select(F.col("doc_id").alias(key), F.col("digest").alias(other), F.col("n").alias(n))
    rows = docs.withColumn(sha, digest).join(named, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(other)))
    if not stays.where("n > 1").isEmpty():
        rows = rows.where(F.col(n) == 1).unionByName(rows.where(F.col(n) > 1).dropDuplicates(["doc_id", sha]))
    return rows.select(*docs.columns)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions: set by whoever knows the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


class Powers:
    """Powers of an odd multiplier modulo 2**64, and of its inverse, grown when longer inputs come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """S with S[j] - S[i] = the sum of values[k] * base**k over i <= k < j."""
    up, _ = powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width consecutive values (unsigned 64-bit, themselves hashes)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values, _WORD_POWERS)
    return mix((sums[width:] - sums[:n]) * _WORD_POWERS.down[:n])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


class Block:
    """Some whole documents of a batch: their rows first..last, bytes, and offsets into these."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word (maximal runs without ASCII white space inside one document), and the words before each document."""
        n = len(self.data)
        black = np.zeros(n + 2, np.bool_)
        black[1:-1] = ~SPACES[self.data]
        edge = np.zeros(n + 1, np.bool_)
        edge[self.offsets] = True
        starts = np.flatnonzero(black[1:] & (~black[:-1] | edge))
        ends = np.flatnonzero(black[:-1] & (~black[1:] | edge))
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """words(), with a 64-bit hash of each word first."""
        starts, ends, before = self.words()
        table = _LOWER_VALUES if lower else _BYTE_VALUES
        sums = prefix_sums(table[self.data], _BYTE_POWERS)
        hashes = mix((sums[ends] - sums[starts]) * _BYTE_POWERS.down[starts] + (ends - starts).astype(np.uint64))
        return hashes, starts, ends, before

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[65:91] = _BYTE_VALUES[97:123]


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Text as one binary array, empty where it is null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    return column.cast(pa.large_binary())


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column as blocks of whole documents of about limit bytes."""
    column = plain(column)
    n = len(column)
    if not n:
        return
    _, places, bytes_ = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None and bytes_.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that copies of texts stay small; at a task's end freed memory goes back to the system."""
    for whole in batches:
        for at in range(0, max(1, whole.num_rows), rows):
            yield whole.slice(at, rows)
    release()


SHARES = 16


def shares(total: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A table of counts in SHARES compressed parts, for adding up over tasks."""
    return list(range(SHARES)), [zlib.compress(x.astype(np.int64).tobytes(), 1) for x in np.split(total, SHARES)]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for share, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[share] = total.get(share, 0) + np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["share", "counts"])


def added_up(counted: DataFrame, size: int) -> np.ndarray:
    """Rows of share and counts -> the sums, a table of that fixed size: all that comes to the driver."""
    out = np.zeros((SHARES, size // SHARES), np.int64)
    for r in counted.select("share", "counts").repartition(min(SHARES, partitions(counted.sparkSession)), "share").mapInArrow(_summed, "share long, counts binary").collect():
        out[r.share] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def release() -> None:
    """Gives memory that this worker has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def crc32_of_id(doc_id) -> "F.Column":
    """crc32 of doc_id written as decimal text: the folds are made from it."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary"))


def home() -> str:
    return os.path.dirname(os.path.abspath(__file__))
