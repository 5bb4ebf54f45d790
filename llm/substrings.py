"""Repeated passages of words, found through difference-cover anchors.

Positions whose number modulo PERIOD lies in COVER carry an anchor, a hash of WORDS - PERIOD + 1 words. For any two
positions there is a shift below PERIOD that brings both onto the cover, so two equal windows of WORDS words share an
anchor that lies inside both. First the anchors meet in buckets of the hash space; only windows around an anchor that
recurs are then extended to their whole length, as hashes of 96 bits, and meet in turn: the earliest stays.

Defined results: null or empty text has no words; null doc_ids come before all others; rows that repeat a doc_id are
ordered by text; texts of any length are one document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.chunks import MESSAGE, Chunk, Message, Received, chunked, member, message_table, once, per_bucket, per_chunk, recurring, to_buckets, to_chunks, with_answers
from llm.common import Block, documents, mix, window_hashes

WORDS = 20
#: Difference covers: {(a - b) mod period} is everything.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def period_for(width: int) -> int:
    """The longest period that leaves anchors of at least eight symbols, or the shortest."""
    return max((p for p in COVERS if width - p + 1 >= 8), default=min(COVERS))


class Words:
    """Words of a block: hashes, starts, ends, the words before each document, and their document and place in it."""

    def __init__(self, block: Block):
        self.hashes, self.starts, self.ends, self.before = block.word_hashes()
        self.count = np.diff(self.before)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(self.doc)) - self.before[self.doc]

    def fitting(self, width: int) -> np.ndarray:
        """Whether a run of width words that starts at each word stays in its document."""
        return self.place + width <= self.count[self.doc]


def anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that carry an anchor, and its hash."""
    period = period_for(width)
    size = width - period + 1
    cover = np.zeros(period, np.bool_)
    cover[list(COVERS[period])] = True
    hashes = window_hashes(words.hashes, size)
    at = np.flatnonzero(cover[words.place % period] & words.fitting(size) & (words.count[words.doc] >= width))
    return at, hashes[at]


def _windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the run of width words from each word; what leaves the document is not to be used."""
    pad = np.zeros(min(width - 1, len(words.hashes)), np.uint64)
    first = window_hashes(words.hashes, width)
    second = window_hashes(mix(words.hashes + np.uint64(0x2545F4914F6CDD1D)), width)
    return np.concatenate([first, pad]), np.concatenate([second, pad])


def _around(words: Words, at: np.ndarray, width: int) -> np.ndarray:
    """Words from which a window of width words starts that holds an anchor at one of the given words."""
    size = width - period_for(width) + 1
    change = np.zeros(len(words.doc) + 1, np.int64)
    low = np.maximum(at - (width - size), words.before[words.doc[at]])
    np.add.at(change, low, 1)
    np.add.at(change, at + 1, -1)
    return (np.cumsum(change[:-1]) > 0) & words.fitting(width)


def _first(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of windows whose words have not come before, by hash; and whether each window is such."""
    order = np.lexsort((np.arange(len(hashes)), checks, hashes))
    new = np.ones(len(hashes), np.bool_)
    h, c = hashes[order], checks[order]
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    first = np.zeros(len(hashes), np.bool_)
    first[order[new]] = True
    return order[new], first


def earliest(table: pa.Table) -> list[Message]:
    """Windows (x: hashes, y: further bits, z: the least doc_id of the chunk) -> each chunk's windows that start earlier in another chunk."""
    got = Received(table)
    hashes, checks, ids, chunks = got.array("x", np.uint64), got.array("y", np.uint32), got.array("z", np.int64), got.chunks()
    order = np.lexsort((ids, checks, hashes))
    hashes, checks, chunks = hashes[order], checks[order], chunks[order]
    later = np.zeros(len(hashes), np.bool_)
    later[1:] = (hashes[1:] == hashes[:-1]) & (checks[1:] == checks[:-1])
    return to_chunks(got.bucket, chunks[later], 0, hashes[later], checks[later])


def repeated_passages(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, the removed runs of words as spans (start, end) of code points, and the kept words joined by spaces."""
    chunks, buckets = chunked(docs)

    def ask_anchors(chunk: Chunk) -> pa.Table:
        found = [anchors(Words(b), width)[1] for b in chunk.blocks()]
        hashes, marked = once(np.concatenate(found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        return message_table(to_buckets(chunk.number, hashes, buckets, marked))

    def ask_windows(chunk: Chunk, answers: pa.Table) -> pa.Table:
        again = np.sort(Received(answers).array("x", np.uint64))
        hashes, checks, ids = [], [], []
        for block in chunk.blocks():
            words = Words(block)
            at, mine = anchors(words, width)
            take = _around(words, at[member(mine, again)], width)
            h, c = _windows(words, width)
            hashes.append(h[take])
            checks.append((c[take] >> np.uint64(32)).astype(np.uint32))
            ids.append(chunk.order[block.first + words.doc[take]])
        if not hashes:
            return message_table([])
        h, c, i = np.concatenate(hashes), np.concatenate(checks), np.concatenate(ids)
        at, _ = _first(h, c)
        return message_table(to_buckets(chunk.number, h[at], buckets, c[at], i[at], by=c[at].astype(np.uint64)))

    def remove(chunk: Chunk, answers: pa.Table) -> pa.Table:
        got = Received(answers)
        elsewhere, their = got.array("x", np.uint64), got.array("y", np.uint32)
        order = np.argsort(elsewhere, kind="stable")
        elsewhere, their = elsewhere[order], their[order]
        parts = list(chunk.blocks())
        found = [(Words(b), b) for b in parts]
        hashes = [_windows(w, width) for w, _ in found]
        fits = [w.fitting(width) for w, _ in found]
        h = np.concatenate([x[0][f] for x, f in zip(hashes, fits)]) if found else np.zeros(0, np.uint64)
        c = np.concatenate([(x[1][f] >> np.uint64(32)).astype(np.uint32) for x, f in zip(hashes, fits)]) if found else np.zeros(0, np.uint32)
        _, first = _first(h, c)
        gone = ~first
        maybe = np.flatnonzero(first & member(h, elsewhere))
        if len(maybe):
            at = np.searchsorted(elsewhere, h[maybe])
            hit = their[at] == c[maybe]
            for step in range(1, 8):  # entries of equal hash and unequal further bits, if there ever are any
                to = np.minimum(at + step, len(elsewhere) - 1)
                hit |= (elsewhere[to] == h[maybe]) & (their[to] == c[maybe])
            gone[maybe[hit]] = True
        n_words, n_removed, spans, kept = [], [], [], []
        at = 0
        for (words, block), fit in zip(found, fits):
            n = int(fit.sum())
            starts = np.flatnonzero(fit)[gone[at : at + n]]
            at += n
            change = np.zeros(len(words.doc) + 1, np.int64)
            change[starts] += 1
            np.add.at(change, starts + width, -1)
            covered = np.cumsum(change[:-1]) > 0
            for k in range(len(block)):
                lo, hi = words.before[k], words.before[k + 1]
                mask = covered[lo:hi]
                n_words.append(int(hi - lo))
                n_removed.append(int(mask.sum()))
                text = block.text(k)
                base = block.offsets[k]
                ends = words.ends[lo:hi] - base
                begin = words.starts[lo:hi] - base
                if not n_removed[-1]:
                    spans.append([])
                    kept.append(b" ".join(text.split()))
                    continue
                edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
                runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
                points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                spans.append([{"start": int(points[begin[a]]), "end": int(points[ends[b - 1]])} for a, b in runs])
                holes = [0] + [x for run in runs for x in run] + [int(hi - lo)]
                pieces = [text[begin[a] : ends[b - 1]] for a, b in zip(holes[::2], holes[1::2]) if a < b]
                kept.append(b" ".join(b" ".join(p.split()) for p in pieces))
        return pa.table({
            "doc_id": chunk.ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    asked = per_chunk(chunks, ask_anchors, MESSAGE)
    again = per_bucket(asked, recurring)
    windows = with_answers(chunks, again, ask_windows, MESSAGE)
    later = per_bucket(windows, earliest)
    return with_answers(chunks, later, remove, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
starts AS MATERIALIZED (SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
again AS (SELECT s, min({'d': doc_id, 'k': k}) AS least FROM starts GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, k FROM starts JOIN again USING (s) WHERE {'d': doc_id, 'k': k} <> least),
marked AS (SELECT doc_id, k, sum(CASE WHEN k > before + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM (SELECT doc_id, k, lag(k, 1, k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone)),
runs AS (SELECT doc_id, min(k) - 1 AS a, max(k) + 19 AS b FROM marked GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM runs),
kept AS (SELECT d.doc_id, sum(b - a) AS n, list_concat(flatten(list(w[since + 1 : a] ORDER BY a)), any_value(w)[max(b) + 1 : len(any_value(w))]) AS w FROM gaps JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(array_to_string(CASE WHEN kept.doc_id IS NULL THEN d.w ELSE kept.w END, ' ')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
