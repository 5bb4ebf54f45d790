"""Near-duplicates by SimHash, with exact comparison of tiles of fingerprints.

Distinct fingerprints are grouped by the population counts of their PARTS parts. Two fingerprints within the radius
differ by no more than it in the sum of these counts, so a group is compared with itself and the few groups around it;
all other tile pairs are skipped unseen. A group beyond TILE rows is split into tiles, each compared with every tile
around it, so a task holds one tile and streams past it what it is compared with. A tile pair is one exclusive-or and
one bit count in numpy. Of the links that a task finds it tells only a star around the least node of each of their
components, so n fingerprints that are all alike give n links. Beyond MANY distinct fingerprints there are twice as many
parts: more copies of a fingerprint, each compared with a far smaller share of the others.

Defined results: null text counts as empty; documents without words have fingerprint zero and are linked like any other;
shorter ones have one shingle; a null doc_id is never the smallest of a class unless all are null; repeated rows stay
rows of one class; an empty table gives an empty result; further columns, whatever their names, are ignored here and kept
by near_deduplicated(). That tells rows by doc_id and text, so that of a repeated doc_id each text is judged by itself;
of rows equal in both one stays; rows without doc_id stay and link nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import SPACES, Block, added_up, blocks, documents, mix, partitions, release, remove_written, rows_named, shares, slices, written
from llm.components import connected_components, star
from llm.fingerprints import codes, likeness, shingles

WIDTH, RADIUS, SEED = 3, 2, 42
PARTS, TILE, MANY = 4, 1 << 15, 1 << 24
BUCKETS = 1 << 20
_BUCKET = np.uint64(44)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[SPACES] = 32
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each run of width lower-cased words, joined by spaces, and the shingles before each document."""
    starts, ends, before = block.words()
    words = np.diff(before)
    # the same text with one space in each gap, so that a shingle is a slice
    keep = ~SPACES[block.data]
    keep[starts[1:] - 1] |= starts[1:] > ends[:-1]
    moved = np.concatenate([[0], np.cumsum(keep)])
    text = _LOWER[block.data[keep]].tobytes()
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    places = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(words)), count)
    first = before[doc] + np.arange(places[-1]) - places[doc]
    last = first + np.minimum(width, words[doc]) - 1
    a, b = moved[starts[first]].tolist(), moved[ends[last]].tolist()
    slices = map(text.__getitem__, map(slice, a, b))
    return np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(SEED)), np.uint64, len(a)), places


def majority(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each document the bits that are set in over half of its hashes."""
    n = np.diff(places)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # up to 255 hashes are counted in the bytes of one integer
    pieces = -(-n[full] // 255)
    group = np.repeat(np.arange(len(full)), pieces)
    within = np.arange(len(group)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = places[:-1][full][group] + 255 * within
    counts = np.zeros((len(full), 64), np.int64)
    heads = np.cumsum(pieces) - pieces
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, at)
        counts[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), heads)
    bits = counts * 2 > n[full, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [majority(*shingle_hashes(b, width)) for b in blocks(batch.column(1))]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def populations(fp: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of the parts of each fingerprint, a row each."""
    edges = np.linspace(0, 64, parts + 1).astype(int)
    return np.stack([np.bitwise_count((fp >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)).astype(np.int64) for a, b in zip(edges, edges[1:])], 1)


def group_numbers(pops: np.ndarray) -> np.ndarray:
    return pops @ (65 ** np.arange(pops.shape[1], dtype=np.int64))


def steps_around(parts: int, radius: int) -> list[np.ndarray]:
    """Differences of population counts within the radius, one of each pair of opposites."""
    out = set()
    for n in range(1, radius + 1):
        for where in combinations_with_replacement(range(parts), n):
            for signs in product((-1, 1), repeat=n):
                step = [0] * parts
                for k, sign in zip(where, signs):
                    step[k] += sign
                out.add(tuple(step))
    return [np.array(x) for x in sorted(out) if x > (0,) * parts]


def _routed(parts: int, radius: int, tiles: dict[int, int], complete: bool):
    """Rows of fingerprint, node and size -> (home tile, role 0: member of it, or 1: compared with its members).

    tiles: how many tiles each group has; where that isn't complete, groups it doesn't name have one.
    """
    around = steps_around(parts, radius)
    most = np.diff(np.linspace(0, 64, parts + 1).astype(int))
    known = np.array(sorted(tiles) or [-1], np.int64)
    tiles_of = np.array([tiles[k] for k in sorted(tiles)] or [0], np.int64)

    def count(number: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, number), len(known) - 1)
        return np.where(known[at] == number, tiles_of[at], 0 if complete else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node, size = (np.asarray(c) for c in batch.columns)
            fp = fp.view(np.uint64)
            pops = populations(fp, parts)
            home = group_numbers(pops)
            mine = count(home)
            tile = ((mix(fp) ^ mix(node.view(np.uint64))) >> np.uint64(33)).astype(np.int64) % mine
            all_ = np.arange(len(fp))
            out = [(home, tile, np.zeros(len(fp), np.int8), all_)]
            # later tiles of the same group
            for k in range(1, int(mine.max(initial=1))):
                to = np.flatnonzero(tile + k < mine)
                out.append((home[to], tile[to] + k, np.ones(len(to), np.int8), to))
            for step in around:
                near = pops + step
                number = group_numbers(near)
                n = count(number)
                to = np.flatnonzero((near >= 0).all(1) & (near <= most).all(1) & (n > 0))
                n = n[to]
                which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append((np.repeat(number[to], n), which, np.ones(n.sum(), np.int8), np.repeat(to, n)))
            home, tile, role, row = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(tile), pa.array(role), pa.array(fp[row].view(np.int64)), pa.array(node[row]), pa.array(size[row])], names=["home", "tile", "role", "fp", "node", "size"])
        release()

    return run


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 128, columns: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in a and b of pairs that differ in no more than radius bits."""
    bits, counts = np.empty((rows, columns), np.uint64), np.empty((rows, columns), np.uint8)
    for i in range(0, len(a), rows):
        x = a[i : i + rows, None]
        for j in range(0, len(b), columns):
            y = b[None, j : j + columns]
            shape = (slice(x.shape[0]), slice(y.shape[1]))
            np.bitwise_xor(x, y, out=bits[shape])
            np.bitwise_count(bits[shape], out=counts[shape])
            p, q = np.nonzero(counts[shape] <= radius)
            if len(p):
                yield i + p, j + q


def _compared(radius: int, ratio: float, stars: bool, most: int = 1 << 20):
    """Rows sorted by home, tile and role -> links of different nodes, the smaller of whose sizes is at least ratio times the larger; or stars with the same connections."""

    def fewer(u: list[np.ndarray], v: list[np.ndarray]) -> np.ndarray:
        both = np.stack([np.concatenate(u), np.concatenate(v)])
        return np.stack(star(*both)) if stars else np.unique(both, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, None, 0
        for batch in batches:
            key = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], 1)
            role = np.asarray(batch.column(2))
            rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in (3, 4, 5)])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            u, v = [], []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(role)]):
                if lo == hi:
                    continue
                if now != (name := tuple(key[lo])):
                    now, held = name, rows[:, :0]
                own = lo + int(np.searchsorted(role[lo:hi], 1))
                members, others = rows[:, lo:own], rows[:, own:hi]
                for a, b in ((held, members), (members, members), (np.concatenate([held, members], 1), others)):
                    for p, q in near_pairs(a[0].view(np.uint64), b[0].view(np.uint64), radius):
                        x, y = a[1:, p], b[1:, q]
                        fits = (x[0] != y[0]) & (np.minimum(x[1], y[1]) >= ratio * np.maximum(x[1], y[1]))
                        u.append(np.minimum(x[0], y[0])[fits])
                        v.append(np.maximum(x[0], y[0])[fits])
                        n += len(u[-1])
                        if n > most:
                            found = fewer(u, v)
                            u, v, n = [found[0]], [found[1]], 0
                held = np.concatenate([held, members], 1)
            if u:
                found = fewer(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["u", "v"])
        release()

    return run


def fingerprint_links(rows: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE, ratio: float = 0.0, stars: bool = False) -> DataFrame:
    """rows: fp, node, size (longs) -> pairs (u, v) of different nodes, u < v, whose fingerprints differ in no more than radius bits; stars: fewer pairs with the same connections."""
    spark = rows.sparkSession

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, n = np.unique(group_numbers(populations(np.asarray(batch.column(0)).view(np.uint64), parts)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(n)], names=["home", "n"])

    # up to four parts there are at most 17 ** 4 groups, whatever the size of the table; of more only those of several tiles are named
    complete = parts <= PARTS
    counted = rows.select("fp").mapInArrow(sizes, "home long, n long").groupBy("home").agg(F.sum("n").alias("n"))
    tiles = {r.home: -(-r.n // tile) for r in (counted if complete else counted.where(F.col("n") > tile)).collect()}
    routed = rows.select("fp", "node", "size").mapInArrow(_routed(parts, radius, tiles, complete), "home long, tile long, role byte, fp long, node long, size long")
    routed = routed.repartition(partitions(spark), "home", "tile").sortWithinPartitions("home", "tile", "role")
    return routed.mapInArrow(_compared(radius, ratio, stars), "u long, v long")


def simhash_classes(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp (the fingerprint as a long), component_id."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(source.mapInArrow(_fingerprints(width), "doc_id long, fp long"), "simhash")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    nodes = distinct.select("fp", F.col("fp").alias("node"), F.lit(1).cast("long").alias("size"))
    parts = connected_components(fingerprint_links(nodes, radius, PARTS if distinct.count() <= MANY else 2 * PARTS, stars=True))
    named = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def _bucket_counts(width: int):
    """How many shingles of a task fall into each of BUCKETS buckets of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for block in blocks(batch.column(0)):
                total += np.bincount((shingles(block, width)[0] >> _BUCKET).astype(np.int64), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(shares(total), (pa.int64(), pa.binary()))], names=["share", "counts"])

    return run


def bucket_counts(source: DataFrame, width: int) -> np.ndarray:
    """Shingles of the table in each bucket: a table of fixed size."""
    counted = source.select("text").mapInArrow(_bucket_counts(width), "share long, counts binary")
    return np.minimum(added_up(counted, BUCKETS), 0xFFFFFFFF).astype(np.uint32)


def prefixes(hashes: np.ndarray, owner: np.ndarray, docs: int, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums over each document's distinct shingles, their number, and how many of them, at the front of an order, two
    documents of the similarity can't avoid to share one of; these follow as an array of arrays. Then the SimHash
    fingerprints of the distinct shingles.

    The order is that of counts, so that common shingles come last, then of the hashes: the same for all documents.
    """
    at = np.lexsort((hashes, counts[(hashes >> _BUCKET).astype(np.int64)], owner))
    hashes, owner = hashes[at], owner[at]
    first = np.ones(len(at), np.bool_)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[first], owner[first]
    size = np.bincount(owner, minlength=docs)
    places = np.concatenate([[0], np.cumsum(size)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)])
    # at least similarity * size are shared, so not all the others and one more can be missing
    n = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    parts = np.empty(docs, object)
    parts[:] = [hashes[a : a + k].tobytes() for a, k in zip(places.tolist(), n.tolist())]
    return sums[places[1:]] - sums[places[:-1]], size, parts, majority(hashes, places)


def _sketches(width: int, counts: np.ndarray, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            node, fp, size, prefix, sketch = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
            for block in blocks(batch.column(2)):
                sums, n, parts, bits = prefixes(*shingles(block, width), len(block), counts, similarity)
                node.append(sums)
                fp.append(bits)
                size.append(n)
                prefix += parts.tolist()
                sketch += [row.tobytes() for row in codes(block, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(node).view(np.int64)), pa.array(np.concatenate(fp).view(np.int64)), pa.array(np.concatenate(size)), pa.array(sketch, pa.binary()), pa.array(prefix, pa.binary())], names=["doc_id", "digest", "node", "fp", "size", "sketch", "prefix"])

    return run


_POSTING = np.dtype([("hash", "<u4"), ("size", "<u4"), ("node", "<i8"), ("class", "<i8")])
#: The same where every node is a class of its own.
_SINGLE = np.dtype(_POSTING.descr[:3])


def _postings(parts: int, kind: np.dtype):
    """Rows of node, size, class and prefix -> the prefixes' hashes by parts of the hash space, with size, node and (where kind has it) class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            found = batch.column(3).to_pylist()
            hashes = np.frombuffer(b"".join(found), np.uint64)
            row = np.repeat(np.arange(len(found)), [len(x) // 8 for x in found])
            part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            at = np.argsort(part, kind="stable")
            out = np.empty(len(at), kind)
            out["hash"] = hashes[at].astype(np.uint32)
            for k, name in [x for x in enumerate(("node", "size", "class")) if x[1] in kind.names]:
                out[name] = np.asarray(batch.column(k))[row[at]]
            which, begin = np.unique(part[at], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array([x.tobytes() for x in np.split(out, begin[1:])] if len(which) else [], pa.binary())], names=["part", "postings"])

    return run


def _pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)


def neighbouring(postings: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs (u < v, two rows) of nodes of different classes that stand next to each other by size under a hash, where their sizes allow the similarity."""
    postings = postings[np.lexsort((postings["node"], postings["size"], postings["hash"]))]
    a, b = postings[:-1], postings[1:]
    fits = (a["hash"] == b["hash"]) & (a["size"] >= similarity * b["size"] - 1e-9) & (a["class"] != b["class"])
    return _pairs(a["node"][fits], b["node"][fits])


def sharing(postings: np.ndarray, similarity: float, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Pairs (u < v, two rows) of nodes of different classes that share a hash and whose sizes allow the similarity, each once a yield.

    Under each hash only the nodes outside its commonest class look for partners: two nodes of that class need none.
    """
    postings = postings[np.lexsort((postings["size"], postings["hash"]))]
    if not len(postings):
        return
    hash_, size, node, class_ = (np.ascontiguousarray(postings[k]) for k in ("hash", "size", "node", "class"))
    group = np.cumsum(np.concatenate([[0], hash_[1:] != hash_[:-1]]))
    by = np.lexsort((class_, group))
    heads = np.flatnonzero(np.concatenate([[True], (group[by][1:] != group[by][:-1]) | (class_[by][1:] != class_[by][:-1])]))
    n = np.diff(np.append(heads, len(by)))
    order = np.lexsort((n, group[by[heads]]))
    last = np.flatnonzero(np.append(np.diff(group[by[heads]][order]) != 0, True))
    common = class_[by[heads]][order][last]
    seekers = np.flatnonzero(class_ != common[group])
    key = group.astype(np.int64) << 32 | size
    base = group[seekers].astype(np.int64) << 32
    low = np.searchsorted(key, base + np.ceil(similarity * size[seekers] - 1e-9).astype(np.int64))
    high = np.searchsorted(key, base + np.minimum(np.floor(size[seekers] / similarity + 1e-9).astype(np.int64), 0xFFFFFFFF), "right")
    done = np.concatenate([[0], np.cumsum(high - low)])
    at = 0
    while at < len(seekers):
        to = max(at + 1, int(np.searchsorted(done, done[at] + most, "right")) - 1)
        count = (high - low)[at:to]
        one = np.repeat(seekers[at:to], count)
        other = np.arange(done[to] - done[at]) + np.repeat(low[at:to] - (done[at:to] - done[at]), count)
        apart = class_[one] != class_[other]
        if apart.any():
            yield _pairs(node[one[apart]], node[other[apart]])
        at = to


def several(postings: np.ndarray) -> np.ndarray:
    """The postings of hashes that nodes of more than one class hold."""
    postings = postings[np.argsort(postings["hash"], kind="stable")]
    if not len(postings):
        return postings
    starts = np.flatnonzero(np.concatenate([[True], postings["hash"][1:] != postings["hash"][:-1]]))
    class_ = np.ascontiguousarray(postings["class"])
    mixed = np.minimum.reduceat(class_, starts) != np.maximum.reduceat(class_, starts)
    return postings[np.repeat(mixed, np.diff(np.append(starts, len(postings))))]


def _sharing(similarity: float, chains: bool):
    """Rows of part and postings, sorted by part -> pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            postings = np.frombuffer(b"".join(held), _SINGLE if chains else _POSTING)
            if chains:
                single, postings = postings, np.empty(len(postings), _POSTING)
                for name in _POSTING.names:
                    postings[name] = single[name if name != "class" else "node"]
            postings = several(postings)
            for found in [neighbouring(postings, similarity)] if chains else sharing(postings, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["u", "v"])

        for batch in batches:
            for part, postings in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now:
                    yield from pairs()
                    now, held = part, []
                held.append(postings.as_py())
        yield from pairs()
        release()

    return run


def prefix_links(nodes: DataFrame, similarity: float, chains: bool = False) -> DataFrame:
    """nodes: node, size, class, prefix -> pairs (u, v) of nodes of different classes, u < v, which share a hash of their prefixes: all of at least the similarity, and some others; chains: each node is a class of its own, and only those next to each other by size under a hash are told."""
    parts = partitions(nodes.sparkSession)
    found = nodes.select("node", "size", "class", "prefix").mapInArrow(_postings(parts, _SINGLE if chains else _POSTING), "part long, postings binary")
    return found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_sharing(similarity, chains), "u long, v long").distinct()


def _likened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likeness(a, b) if batch.num_rows else [], pa.float64())], names=["u", "v", "near"])


def _jaccard(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            sets: list[list[np.ndarray]] = []
            for k in (2, 3):
                mine: list[np.ndarray] = []
                for block in blocks(batch.column(k)):
                    hashes, owner = shingles(block, width)
                    order = np.lexsort((hashes, owner))
                    cuts = np.searchsorted(owner[order], np.arange(len(block) + 1))
                    mine += [np.unique(hashes[order[a:b]]) for a, b in zip(cuts, cuts[1:])]
                sets.append(mine)
            found = []
            for a, b in zip(*sets):
                both = len(np.intersect1d(a, b, assume_unique=True))
                found.append(both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["u", "v", "near"])

    return run


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, doubt: float = 0.1, short: int = 128) -> DataFrame:
    """doc_id, component_id, and digest (sha256 of the text) of each row with a doc_id: classes of texts linked by a Jaccard index of their shingles of at least similarity.

    Texts of the same set of shingles are one node. The first candidates are SimHash's: nodes whose fingerprints differ
    in no more than RADIUS bits, found in tiles, as stars; what they link is a class. That finds most close copies and
    can't find all links of the similarity, so the rest comes from prefixes of the sorted shingles, of which two such
    texts always share one. First only representatives of the classes that stand next to each other by size under a
    shared shingle are compared. Then all nodes that share a shingle are, but for those of one class already: so a group
    of n copies gives about n pairs under each shingle, and no link between classes is lost. Candidate pairs of each kind
    are likened by sketches; those within doubt of the threshold (five standard errors), and those with a text of fewer
    than short shingles, on which sketches are coarse, are compared in full.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null").withColumn("digest", F.sha2("text", 256))
    scan = written(source.select("doc_id", "digest", "text").mapInArrow(_sketches(width, bucket_counts(source, width), similarity), "doc_id long, digest string, node long, fp long, size long, sketch binary, prefix binary"), "near-scan")
    nodes = written(scan.groupBy("node", "size").agg(F.min(F.struct("doc_id", "digest")).alias("least"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix")), "near-nodes")
    found = written(scan.select("doc_id", "digest", "node", "size"), "near-rows")
    remove_written(scan)

    def compared(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are similar, as a table; the tables on the way to it are removed."""
        of = lambda name: nodes.select(F.col("node").alias(name), F.col("sketch").alias(f"sketch_{name}"), F.col("size").alias(f"size_{name}"))
        both = pairs.join(of("u"), "u").join(of("v"), "v")
        is_short = F.least("size_u", "size_v") < short
        likened = written(
            both.where(~is_short).select("u", "v", "sketch_u", "sketch_v").mapInArrow(_likened, "u long, v long, near double").where(F.col("near") >= similarity - doubt)
            .unionByName(both.where(is_short).select("u", "v", F.lit(similarity).cast("double").alias("near"))), "near-liken",
        )
        unsure = likened.where(F.col("near") < similarity + doubt).select("u", "v")
        wanted = unsure.select(F.col("u").alias("node")).unionByName(unsure.select(F.col("v").alias("node"))).distinct().join(nodes, "node").select("node", F.col("least.doc_id").alias("doc_id"), F.col("least.digest").alias("digest"))
        texts = written(source.join(wanted, ["doc_id", "digest"]).dropDuplicates(["node"]).select("node", "text"), "near-texts")
        text = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
        full = unsure.join(text("u"), "u").join(text("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(_jaccard(width), "u long, v long, near double")
        links = written(likened.where(F.col("near") >= similarity + doubt).select("u", "v").unionByName(full.where(F.col("near") >= similarity).select("u", "v")), "near-links")
        for done in (pairs, likened, texts):
            remove_written(done)
        return links

    def classed(links: list[DataFrame]) -> DataFrame:
        """The nodes with their classes (the least node of each) by the links so far."""
        parts = connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("component", "class")
        return nodes.join(parts, "node", "left").withColumn("class", F.coalesce("class", "node"))

    close = fingerprint_links(nodes.select("fp", "node", "size"), RADIUS, PARTS if nodes.count() <= MANY else 2 * PARTS, ratio=similarity, stars=True)
    links = [compared(written(close.distinct(), "near-pairs"))]
    links.append(compared(written(prefix_links(classed(links).where(F.col("class") == F.col("node")), similarity, chains=True), "near-pairs")))
    links.append(compared(written(prefix_links(classed(links), similarity), "near-pairs")))
    named = written(classed(links).select("node", "size", "least", F.col("class").alias("component")), "near-named")
    for done in (nodes, *links):
        remove_written(done)
    least = named.groupBy("component").agg(F.min("least.doc_id").alias("component_id"))
    return found.select("doc_id", "digest", "node", "size").join(named.join(least, "component").select("node", "size", "component_id"), ["node", "size"]).select("doc_id", "component_id", "digest")


def near_deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their class (of several the one whose digest comes first), with all their columns; rows without doc_id stay."""
    found = written(similar_classes(docs, width, similarity), "near-classes")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest")).alias("least")).select("least.doc_id", "least.digest")
    stays = found.join(first, ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    kept = rows_named(docs, written(stays, "near-stays"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    return kept.unionByName(docs.where("doc_id is null"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
