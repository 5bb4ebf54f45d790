"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

A document's shingles of five words are hashed once; the top bits name one of BINS bins, each of which keeps its least
hash. An empty bin borrows from the first non-empty bin in an order of its own, the same for all documents. Of each bin
BITS low-order bits are stored; likeness takes off what such short codes agree by chance.

Defined results: null text counts as empty; a text without words has the empty fingerprint, like itself (1) and nothing
else (0); fewer than five words are one shingle; the order of documents is by descending doc_id, nulls last, ties by a
hash of the text, then by text; a single document is its own next; an empty table gives an empty result; further
columns, whatever their names, are ignored. A doc_id that many rows repeat, and rows without one, are spread over as
many parts as their share of the table asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Block, blocks, documents, mix, partitions, window_hashes

WIDTH, BINS, BITS, SEED = 5, 512, 4, 7
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
_orders: dict[int, np.ndarray] = {}


def borrowing_order(bins: int) -> np.ndarray:
    """order[i, j]: how soon bin i, if empty, asks bin j."""
    if bins not in _orders:
        rng = np.random.default_rng(SEED)
        _orders[bins] = np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.uint16)
    return _orders[bins]


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width lower-cased words, and the document of each."""
    words, _, _, before = block.word_hashes(lower=True)
    count = np.diff(before)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(doc)) - before[doc]
    full = window_hashes(words, width)
    at = np.flatnonzero(place + width <= count[doc])
    hashes, owner = [full[at]], [doc[at]]
    for n in range(1, width):  # short documents: all their words
        short = np.flatnonzero(count == n)
        if len(short):
            hashes.append(window_hashes(words, n)[before[short]])
            owner.append(short)
    return np.concatenate(hashes), np.concatenate(owner)


def bin_minima(hashes: np.ndarray, owner: np.ndarray, docs: int, bins: int) -> np.ndarray:
    """Least hash of each document and bin after densification; a row without any shingle stays free."""
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    table = np.full((docs, bins), _FREE, np.uint64)
    np.minimum.at(table, (owner, (hashes >> shift).astype(np.int64)), hashes)
    order = borrowing_order(bins)
    free = table == _FREE
    for row in np.flatnonzero(free.any(1) & ~free.all(1)).tolist():
        empty, taken = np.flatnonzero(free[row]), np.flatnonzero(~free[row])
        table[row, empty] = table[row, taken[order[np.ix_(empty, taken)].argmin(1)]]
    return table


def codes(block: Block, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The low-order bits of each document's bins, as a row of small integers; 255 throughout where there are no words."""
    minima = bin_minima(*shingles(block, width), len(block), bins)
    out = (mix(minima) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    out[(minima == _FREE).all(1)] = 255
    return out


def packed(row: np.ndarray, bits: int = BITS) -> str:
    """A row of codes as hexadecimal digits."""
    if row[0] == 255:
        return ""
    return np.packbits(((row[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).astype(np.uint8).ravel()).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard index of rows of codes."""
    chance = 2.0**-bits
    found = np.clip(((a == b).mean(-1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where((a[..., 0] == 255) | (b[..., 0] == 255), ((a[..., 0] == 255) & (b[..., 0] == 255)).astype(float), found)


def _all_codes(texts: pa.Array) -> np.ndarray:
    found = [codes(b) for b in blocks(texts)]
    return np.concatenate(found) if found else np.zeros((0, BINS), np.uint8)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(r) for r in _all_codes(batch.column(1))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """part, guest, doc_id, text: parts are ranges of doc_id, sorted by descending doc_id, each followed by its guest, the document that comes next in the whole order.

    Only the bounds of the parts and the first rows' keys of each come to the driver: a few numbers a partition.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    seen = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100 * n), F.count("*"), F.count("doc_id")).first()
    bounds = sorted(~x for x in seen[0] or [])  # descending doc_ids are ascending complements
    rows = placed(rows, bounds, max(1, round(n * (1 - seen[2] / max(1, seen[1])))))
    # the first row of each part: the least complement (null last), of equal ones the least tie
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("place"), "tie")
    heads = {r.part: (None if r.head.none else ~r.head.place, r.head.tie) for r in rows.groupBy("part").agg(F.min(first).alias("head")).collect()}
    order = sorted(heads)
    guests = [(order[k - 1], *heads[p]) for k, p in enumerate(order)]
    own = rows.select("part", F.lit(0).alias("guest"), "doc_id", "tie", "text")
    if not guests:
        return own.select("part", "guest", "doc_id", "text")
    invited = F.broadcast(spark.createDataFrame(guests, "to int, head long, head_tie long"))
    # rows of one doc_id and tie are told apart by text; of those the first is the guest
    again = rows.join(invited, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")))
    again = again.groupBy("to").agg(F.min("text").alias("text"), F.first("head").alias("head"), F.first("tie").alias("tie"))
    both = own.unionByName(again.select(F.col("to").alias("part"), F.lit(1).alias("guest"), F.col("head").alias("doc_id"), "tie", "text"))
    ordered = both.repartitionById(max(order) + 1, F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return ordered.select("part", "guest", "doc_id", "text")


def placed(rows: DataFrame, bounds: list[int], nulls: int) -> DataFrame:
    """rows (doc_id, tie) with their part: how many bounds are below the complement of doc_id, by halving in a literal array, one projection a step.

    A bound that comes several times names as many further parts, over which rows of that doc_id are spread by ranges of
    tie; rows without doc_id are spread over the last parts, nulls of them.
    """
    def spread(parts) -> Column:
        """Ranges of tie: 0 to parts - 1, ascending."""
        return F.least(F.floor((F.col("tie").cast("double") + 2.0**63) / 2.0**64 * parts), parts - 1).cast("int")

    rows = rows.withColumn("place", F.bitwise_not("doc_id")).withColumn("low", F.lit(0))
    if bounds:
        array = F.array(*map(F.lit, bounds))
        for step in reversed([1 << k for k in range(len(bounds).bit_length())]):
            rows = rows.withColumn("low", F.col("low") + F.when(F.coalesce(F.get(array, F.col("low") + (step - 1)) < F.col("place"), F.lit(False)), step).otherwise(0))
        rows = rows.withColumn("high", F.col("low"))
        for step in reversed([1 << k for k in range(len(bounds).bit_length())]):
            rows = rows.withColumn("high", F.col("high") + F.when(F.coalesce(F.get(array, F.col("high") + (step - 1)) <= F.col("place"), F.lit(False)), step).otherwise(0))
        known = F.when(F.col("high") - F.col("low") > 1, F.col("low") + spread(F.col("high") - F.col("low") + 1)).otherwise(F.col("low"))
    else:
        known = F.col("low")
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1 + spread(F.lit(nulls))).otherwise(known)
    return rows.select(part.cast("int").alias("part"), "doc_id", "text", "tie")


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending = None  # the last document of the part so far: doc_id, text, codes
    part, closed = None, False

    def rows(pairs: list[tuple]) -> pa.RecordBatch:
        texts = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for (_, t, _), (_, after, _) in pairs]
        mine = np.stack([a[2] for a, _ in pairs]) if pairs else np.zeros((0, BINS), np.uint8)
        other = np.stack([b[2] for _, b in pairs]) if pairs else mine
        edited = _all_codes(pa.array(texts, pa.large_string()))
        return pa.RecordBatch.from_arrays([
            pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array([packed(r) for r in mine], pa.string()), pa.array([packed(r) for r in edited], pa.string()),
            pa.array(likeness(mine, edited), pa.float64()), pa.array(likeness(mine, other), pa.float64()),
        ], names=[x.split()[0] for x in _EDITED.split(", ")])

    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            found = _all_codes(batch.column(3))
            pairs = []
            for p, guest, doc_id, text, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), found):
                if p != part:
                    part, closed, pending = p, False, None
                here = (doc_id, text, code)
                if pending is not None and not closed:
                    pairs.append((pending, here))
                closed = closed or bool(guest)
                pending = here
            yield rows(pairs)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its text with the last third replaced from the next document."""
    return in_order(docs).mapInArrow(_edited, _EDITED)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
