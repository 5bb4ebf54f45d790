"""Exact deduplication by a log-structured merge index over text digests.

Every scan task fills a memtable, digest -> class of equal texts; a hit there is verified byte by byte at once. A full
memtable is flushed: its digests, sorted, become a run with a Bloom filter for each shard of the digest space, and the
texts they stand for go to a value log. A shard takes the runs of all tasks one after another into its index. Each new
run's digests are looked up in the runs that stand already, through their filters; digests found are hits. Once more
than FANOUT runs of one level stand, they are compacted into one of the next: of equal digests the entry with the
smallest identifier is kept, the others leave the index as hits. So a shard's memory is that of its distinct digests,
however often they come, and a text that fills a third of the table costs a shard one entry a run.

Hits are settled by bytes: their texts are fetched from the value log and compared with the text of the entry that the
index kept, as a join whose hot keys adaptive execution can split. Only texts that differ from it though their digests
are equal are grouped by digest and compared with each other.

Defined results: null text counts as empty; a null doc_id stays only where all rows of a text have none; of repeated rows
(same doc_id, same text) exactly one is kept; an empty table gives an empty result; further columns, whatever their
names, are ignored here and kept by deduplicated().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents, partitions, plain, rows_named, slices, written

MEMTABLE_BYTES, FANOUT = 16 << 20, 4
#: Identifiers as they are ordered: a row without doc_id comes after all others.
NO_ID = (1 << 63) - 1


class Bloom:
    """A filter over the first bytes of digests, ten bits a key, four probes."""

    def __init__(self, keys: np.ndarray):
        self.size = max(64, 10 * len(keys))
        self.bits = np.zeros(self.size // 8 + 1, np.uint8)
        for at in self._places(keys):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(4):
            yield ((keys * np.uint64(2 * k + 1) + (keys >> np.uint64(17 + k))) % np.uint64(self.size)).astype(np.int64)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), np.bool_)
        for at in self._places(keys):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def _short(keys: np.ndarray) -> np.ndarray:
    """The first eight bytes of fixed-width digests as integers, for filters."""
    raw = np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), keys.dtype.itemsize)
    wide = np.zeros((len(keys), 8), np.uint8)
    wide[:, : min(8, raw.shape[1])] = raw[:, :8]
    return wide.view(np.uint64).ravel()


@dataclass
class Run:
    """A sorted run: digests without repeats, and for each the entry with the smallest identifier.

    key: digest; id, row: the smallest identifier of its class and the row that has it; rep: the row whose text stands in
    the value log; n: rows of the class; hit: whether the digest has been found in another run.
    """

    key: np.ndarray
    id: np.ndarray
    row: np.ndarray
    rep: np.ndarray
    n: np.ndarray
    hit: np.ndarray

    def __post_init__(self) -> None:
        self.filter = Bloom(_short(self.key))

    def __len__(self) -> int:
        return len(self.key)

    def take(self, at: np.ndarray) -> dict[str, np.ndarray]:
        return {f.name: getattr(self, f.name)[at] for f in fields(self)}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't here; only what the filter lets through is searched."""
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.filter.maybe(_short(keys)))
        if len(maybe) and len(self.key):
            at = np.minimum(np.searchsorted(self.key, keys[maybe]), len(self.key) - 1)
            found = self.key[at] == keys[maybe]
            out[maybe[found]] = at[found]
        return out


class LsmIndex:
    """digest -> entry with the smallest identifier, as sorted runs in levels. lost: entries that others have superseded, with the rep of what superseded them at the time."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[Run]] = []
        self.lost: list[dict[str, np.ndarray]] = []
        self.added = self.probed = self.compactions = 0

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def add(self, run: Run) -> None:
        for old in self.runs:
            at = old.find(run.key)
            self.probed += 1
            run.hit |= at >= 0
            old.hit[at[at >= 0]] = True
        self.added += 1
        self._put(0, run)

    def _put(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) > self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(runs))

    def _merged(self, runs: list[Run]) -> Run:
        """One run of several: of equal digests the smallest identifier is kept."""
        self.compactions += 1
        all_ = {f.name: np.concatenate([getattr(r, f.name) for r in runs]) for f in fields(Run)}
        order = np.lexsort((all_["row"], all_["id"], all_["key"]))
        all_ = {name: values[order] for name, values in all_.items()}
        new = np.ones(len(order), np.bool_)
        new[1:] = all_["key"][1:] != all_["key"][:-1]
        if not new.all():
            self.lost.append({name: values[~new] for name, values in all_.items()})
        return Run(**{name: values[new] for name, values in all_.items()})

    def compact(self) -> Run | None:
        """Everything in one run."""
        runs = self.runs
        if len(runs) > 1:
            self.levels = [[self._merged(runs)]]
        return self.runs[0] if runs else None

    def get(self, key: bytes) -> int | None:
        """The smallest identifier of a digest."""
        found = []
        for run in self.runs:
            at = int(run.find(np.array([key], run.key.dtype))[0])
            if at >= 0:
                found.append(int(run.id[at]))
        return min(found) if found else None


def run_of(keys: list[bytes], ids, rows, reps, n) -> Run:
    """A sorted run of classes whose digests differ."""
    array = _keys(keys)
    order = np.lexsort((np.asarray(rows, np.int64), np.asarray(ids, np.int64), array))
    return Run(array[order], *[np.asarray(x, np.int64)[order] for x in (ids, rows, reps, n)], np.zeros(len(order), np.bool_))


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), f"S{len(digests[0])}") if digests else np.zeros(0, "S1")


_ENTRY = np.dtype([("id", "<i8"), ("row", "<i8"), ("rep", "<i8"), ("n", "<i8")])
_SCAN = pa.schema([("kind", pa.int8()), ("row", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("raw", pa.binary()), ("rep", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("entries", pa.binary()), ("text", pa.binary())])
_SCAN_SQL = "kind byte, row long, doc_id long, sha binary, raw binary, rep long, shard int, keys binary, entries binary, text binary"
ROW, RUN, VALUE = 0, 1, 2


def _batch(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int8()) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCAN], schema=_SCAN)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the digest space."""
    return ((_short(keys).byteswap() >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _scan(digest_bytes: int, memtable_bytes: int, largest: bool, shards: int):
    """Documents -> a row each (ROW), the flushed runs by shard (RUN), and the value log (VALUE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        # digest -> classes [text, rep, rows, smallest identifier, its row]; more than one where digests collide
        memtable: dict[bytes, list[list]] = {}
        weight = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = [c for cs in memtable.values() for c in cs]
            for at in range(0, len(found), 1000):
                part = found[at : at + 1000]
                yield _batch(VALUE, rep=[c[1] for c in part], text=[c[0] for c in part])
            depth = max(map(len, memtable.values()))
            for k in range(depth):  # a run holds a digest once
                part = [(d, cs[k]) for d, cs in memtable.items() if len(cs) > k]
                sorted_run = run_of([d for d, _ in part], [c[3] for _, c in part], [c[4] for _, c in part], [c[1] for _, c in part], [c[2] for _, c in part])
                shard = shard_of(sorted_run.key, shards)
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                entries = np.empty(len(sorted_run), _ENTRY)
                for name in _ENTRY.names:
                    entries[name] = getattr(sorted_run, name)
                full = np.flatnonzero(np.diff(cuts)).tolist()
                yield _batch(RUN, row=[row] * len(full), shard=full, keys=[sorted_run.key[cuts[s] : cuts[s + 1]].tobytes() for s in full], entries=[entries[cuts[s] : cuts[s + 1]].tobytes() for s in full])

        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, given in zip(batch.column(0).to_pylist(), plain(batch.column(1)).to_pylist()):
                text = given.lower()  # of bytes: A-Z only
                sha = hashlib.sha256(text).digest()
                raw = sha if text == given else hashlib.sha256(given).digest()
                digest = sha[:digest_bytes]
                known = NO_ID if doc_id is None else ~doc_id if largest else doc_id
                for c in memtable.setdefault(digest, []):
                    if c[0] == text:  # byte verification
                        c[2] += 1
                        if (known, row) < (c[3], c[4]):
                            c[3], c[4] = known, row
                        break
                else:
                    c = [text, row, 1, known, row]
                    memtable[digest].append(c)
                    weight += len(text) + 200
                for column, x in zip(out, (row, doc_id, sha, raw, c[1])):
                    column.append(x)
                row += 1
                if weight > memtable_bytes:
                    yield from flush()
                    memtable, weight = {}, 0
            yield _batch(ROW, **dict(zip(("row", "doc_id", "sha", "raw", "rep"), out)))
        if memtable:
            yield from flush()

    return run


_CLASSES = "rep long, digest binary, first long, n long, id long, row long, hit boolean, runs long, probes long, compactions long"


def _shard(digest_bytes: int):
    """A shard's runs, sorted by shard and flush -> its entries: those the index kept (first = rep) and those it gave up; with the shard's numbers of runs, lookups and compactions."""
    def closed(index: LsmIndex) -> Iterator[pa.RecordBatch]:
        kept = index.compact()
        if kept is None:
            return
        for part in [kept.take(slice(None)), *index.lost]:
            at = kept.find(part["key"])
            n = len(at)
            data = part["key"].tobytes()  # single items of numpy lose their trailing NULs
            raw = [data[k : k + digest_bytes] for k in range(0, len(data), digest_bytes)]
            numbers = [np.full(n, x) for x in (index.added, index.probed, index.compactions)]
            yield pa.RecordBatch.from_arrays([pa.array(part["rep"]), pa.array(raw, pa.binary()), pa.array(kept.rep[at]), pa.array(part["n"]), pa.array(part["id"]), pa.array(part["row"]), pa.array(part["hit"]), *[pa.array(x, pa.int64()) for x in numbers]], names=[x.split()[0] for x in _CLASSES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, LsmIndex()
        for batch in batches:
            for shard, keys, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if shard != now:
                    yield from closed(index)
                    now, index = shard, LsmIndex()
                e = np.frombuffer(entries, _ENTRY)
                index.add(Run(np.frombuffer(keys, f"S{digest_bytes}"), *[e[name].copy() for name in _ENTRY.names], np.zeros(len(e), np.bool_)))
        yield from closed(index)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of equal digests that differ from the text the index kept, sorted by digest -> the class of each: texts of one class are equal in every byte."""
    last, seen = None, []
    for batch in slices(batches):
        names = []
        for digest, rep, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if digest != last:
                last, seen = digest, []
            for other, name in seen:
                if other == text:
                    break
            else:
                seen.append((text, name := rep))
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.int64())], names=["rep", "class"])


def index_tables(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 32, memtable_bytes: int = MEMTABLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The scan's table (rows, runs and value log) and the entries of all shards, both in the shared folder."""
    spark = docs.sparkSession
    shards = partitions(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(source.mapInArrow(_scan(digest_bytes, memtable_bytes, {"smallest": False, "largest": True}[keep], shards), _SCAN_SQL), "exact-scan")
    runs = found.where(F.col("kind") == RUN).select("shard", "keys", "entries", "row").repartition(shards, "shard").sortWithinPartitions("shard", "row")
    return found, written(runs.mapInArrow(_shard(digest_bytes), _CLASSES), "exact-shards")


def exact_duplicates(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 32, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, and raw_sha256 of the text as it is.

    keep: which doc_id of a class stays, "smallest" or "largest" (the index then orders identifiers backwards).
    digest_bytes: width of the index key; shorter keys collide, which verification sorts out.
    """
    spark = docs.sparkSession
    found, entries = index_tables(docs, keep, digest_bytes, memtable_bytes)
    doubted = entries.where("hit").select("rep", "digest", "first")
    texts = found.where(F.col("kind") == VALUE).select(F.col("rep").alias("of"), "text")
    texts = written(doubted.join(texts, F.col("rep") == F.col("of")).select("rep", "digest", "first", "text"), "exact-hits")
    kept = texts.where("rep = first").select(F.col("first").alias("kept"), F.col("text").alias("kept_text"))
    verdict = texts.where("rep <> first").join(kept, F.col("first") == F.col("kept"), "left").withColumn("same", F.coalesce(F.col("text") == F.col("kept_text"), F.lit(False)))
    equal = verdict.where("same").select("rep", F.col("first").alias("class"))
    apart = verdict.where("not same").select("digest", "rep", "text").repartition(partitions(spark), "digest").sortWithinPartitions("digest", "rep").mapInArrow(_verify, "rep long, class long")
    named = entries.where("rep = first").select("rep", F.col("rep").alias("class")).unionByName(equal).unionByName(apart)
    members = named.join(entries.select("rep", "n", F.struct("id", "row").alias("best")), "rep")
    totals = members.groupBy("class").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    answer = members.select("rep", "class").join(totals, "class").select("rep", "group_size", "best")
    rows = found.where(F.col("kind") == ROW).select("row", "doc_id", "sha", "raw", "rep")
    best = F.bitwise_not("best.id") if keep == "largest" else F.col("best.id")
    return rows.join(answer, "rep").select(
        "doc_id",
        F.when(F.col("best.id") != NO_ID, best).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.lower(F.hex("raw")).alias("raw_sha256"),
    )


def deduplicated(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each text. Rows are told by doc_id and text together, so that of a repeated doc_id each text is judged by itself."""
    found = exact_duplicates(docs, keep)
    stays = found.groupBy("doc_id", F.col("raw_sha256").alias("digest")).agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("kept")
    return rows_named(docs, written(stays.select("doc_id", "digest", "n"), "exact-stays"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="largest").drop("raw_sha256")


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, sha256({ASCII_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
