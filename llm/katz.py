"""Language-model scores by a Katz back-off model of n-grams, of any order.

Tokens are lower-cased words, then one end. Counts of each level are discounted by Good-Turing up to DISCOUNTED; what a
history's discounts free goes to words not seen after it, in proportion to their probability after the shorter history,
so that the probabilities after each history add up to exactly one over the V known tokens and one unknown. A history
without discounts gives up one count in c(h) + 1, so that nothing is impossible. Unigram probabilities are Good-Turing
estimates too; the mass they free belongs to the unknown token. A token's probability is evaluated recursively: its
n-gram's discounted share, or else the back-off weight of its history times its probability after the history without
the first word.

The model lives in tables partitioned by hash (n-grams of each level, histories), never in one place: chunks of documents
ask for their own distinct n-grams, each once, and get counts back in the order they asked. One asking chunk of an n-gram
owns it and adds it to the sums of its history. An n-gram is asked for only where both n-grams of the level below that
it holds are known to another chunk too; what a single chunk alone holds stays there.

Defined results: null or empty text is the end alone; documents with a null doc_id train; rows that repeat a doc_id are
documents of their own; texts of any length are whole; without training tokens every token is unknown; an empty table
gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.chunks import MESSAGE, Chunk, Message, bucket_of, chunked, message_table, per_bucket, per_chunk, with_answers
from llm.common import documents, mix

#: n-grams have up to ORDER words; counts up to DISCOUNTED are discounted.
ORDER, DISCOUNTED = 2, 5
START, END = np.uint64(0x51A7C0DE00000001), np.uint64(0xE4D0C0DE00000002)
#: Kinds of messages, each plus its level: counts, sums of histories, totals of n-grams that stay in a chunk, totals.
COUNTS, SUMS, LOCAL, TOTALS = 0, 20, 40, 60
_GRAM = np.uint64(0x9FB21C651E98DF25)
SHARED, OWN = 2, 1


def held_out(ids: pa.ChunkedArray) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % 7 == 2 for x in ids.to_pylist()], np.bool_)


class Level:
    """The distinct n-grams of one level in a chunk: hash, the n-gram without its last word, that without its first (both of the level below), the last word, occurrences in training documents, and whether it is an event (padding alone isn't)."""

    def __init__(self, hash_: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, word: np.ndarray, count: np.ndarray, event: np.ndarray):
        self.hash, self.prefix, self.suffix, self.word, self.count, self.event = hash_, prefix, suffix, word, count, event

    def __len__(self) -> int:
        return len(self.hash)


class Tokens:
    """A chunk's tokens and the distinct n-grams up to an order. Each document begins with a place of padding, before which there is more of it."""

    def __init__(self, chunk: Chunk, order: int):
        self.held_out = held_out(chunk.ids)
        token, doc = [], []
        for block in chunk.blocks():
            hashes, _, _, before = block.word_hashes(lower=True)
            n = len(block)
            t = np.empty(len(hashes) + 2 * n, np.uint64)
            heads = before[:-1] + 2 * np.arange(n)
            ends = before[1:] + 2 * np.arange(n) + 1
            word = np.ones(len(t), np.bool_)
            word[heads] = word[ends] = False
            t[word], t[heads], t[ends] = hashes, START, END
            token.append(t)
            doc.append((block.first + np.repeat(np.arange(n), np.diff(before) + 2)).astype(np.int32))
        token, doc = np.concatenate(token), np.concatenate(doc)
        head = np.ones(len(doc), np.bool_)
        head[1:] = doc[1:] != doc[:-1]
        trains = ~self.held_out[doc]
        words, at = np.unique(token, return_inverse=True)
        del token
        at = at.astype(np.int32)
        none = np.zeros(0, np.int32)
        self.levels = [Level(words, none, none, np.arange(len(words), dtype=np.int32), np.bincount(at, trains, len(words)).astype(np.int64), words != START)]
        self.token = at[~head]
        for _ in range(1, order):
            below = self.levels[-1]
            prefix = np.empty_like(at)
            prefix[1:] = at[:-1]
            prefix[head] = at[head]
            keys, new = np.unique(prefix.astype(np.int64) * len(below) + at, return_inverse=True)
            new = new.astype(np.int32)
            prefix, suffix = (keys // len(below)).astype(np.int32), (keys % len(below)).astype(np.int32)
            word = below.word[suffix]
            event = np.ones(len(keys), np.bool_)
            event[new[head]] = False
            self.levels.append(Level(mix(below.hash[prefix] * _GRAM + words[word]), prefix, suffix, word, np.bincount(new, trains, len(keys)).astype(np.int64), event))
            at = new
        self.gram, self.doc = at[~head], doc[~head]

    def asked(self, level: int, shared: np.ndarray | None) -> np.ndarray:
        """The n-grams of a level that other chunks may hold, by hash; shared: those of the level below that they do."""
        grams = self.levels[level - 1]
        at = np.arange(len(grams)) if shared is None else np.flatnonzero(shared[grams.prefix] & shared[grams.suffix])
        return at[np.argsort(grams.hash[at], kind="stable")]


def small(values: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as single bytes, larger ones apart."""
    return np.minimum(values, 255).astype(np.uint8).tobytes(), values[values >= 255].astype(np.int64).tobytes()


def unpacked(y: bytes, z: bytes) -> np.ndarray:
    out = np.frombuffer(y, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(z, np.int64)
    return out


def ascending(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the bytes of their differences, the highest of all first: these are mostly zero."""
    return np.ascontiguousarray(np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def descended(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def asks(chunk: int, kind: int, hashes: np.ndarray, buckets: int, pack) -> list[Message]:
    """A message for each bucket: sorted hashes, and pack(rows) of them."""
    where = bucket_of(hashes, buckets)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    return [(b, chunk, kind, ascending(hashes[order[cuts[b] : cuts[b + 1]]]), *pack(order[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts)).tolist()]


def placed(hashes: np.ndarray, buckets: int, rows: list[dict], read, out: np.ndarray) -> None:
    """Puts the answers of the buckets where the asked hashes are."""
    where = bucket_of(hashes, buckets)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    for r in rows:
        out[order[cuts[r["bucket"]] : cuts[r["bucket"] + 1]]] = read(r)


def _rows(table: pa.Table, kind: int) -> list[dict]:
    return [r for r in table.to_pylist() if r["kind"] == kind]


def _grouped(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All hashes of the messages: their order, the group of each in that order, the first of each group, the cuts of the messages."""
    parts = [descended(r["x"]) for r in rows]
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), np.bool_)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    return order, np.cumsum(new) - 1, new, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]


def counted(level: int):
    """Messages of counts -> each chunk's counts over all chunks, times four, plus SHARED if another chunk has the n-gram too and OWN if this chunk owns it; and the bucket's totals."""

    def settle(table: pa.Table) -> list[Message]:
        rows = sorted(_rows(table, COUNTS + level), key=lambda r: r["chunk"])
        order, group, new, cuts = _grouped(rows)
        counts = np.concatenate([unpacked(r["y"], r["z"]) for r in rows]) if rows else np.zeros(0, np.int64)
        total = np.bincount(group, counts[order], group[-1] + 1 if len(group) else 0).astype(np.int64)
        answer = np.empty(len(order), np.int64)
        answer[order] = 4 * total[group] + np.where(np.bincount(group, minlength=1)[group] > 1, SHARED, 0) + np.where(new, OWN, 0) if len(group) else 0
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        out = [(bucket, r["chunk"], COUNTS + level, b"", *small(answer[a:b])) for r, a, b in zip(rows, cuts, cuts[1:])]
        if len(order):
            hashes = np.concatenate([descended(r["x"]) for r in rows])[order][new]
            total = total[~np.isin(hashes, padding(level))]
        found = totals_of(total)
        for r in _rows(table, LOCAL + level):
            found += np.frombuffer(r["x"], np.int64)
        return [*out, (0, -1, TOTALS + level, found.astype(np.int64).tobytes(), b"", b"")]

    return settle


def padding(level: int) -> np.ndarray:
    """The hash of padding alone, which is a history but no event."""
    h = np.array([START])
    for _ in range(1, level):
        h = mix(h * _GRAM + START)
    return h


def totals_of(counts: np.ndarray) -> np.ndarray:
    """Occurrences, types, and how many types come once, twice and so on."""
    return np.concatenate([[counts.sum(), (counts > 0).sum()], counts_of_counts(counts[counts > 0])]).astype(np.int64)


def told(chunks: int):
    """The totals of all buckets, added up, for every chunk."""

    def settle(table: pa.Table) -> list[Message]:
        rows = table.to_pylist()
        total = sum((np.frombuffer(r["x"], np.int64) for r in rows), np.zeros(DISCOUNTED + 3, np.int64))
        return [(0, k, rows[0]["kind"], total.tobytes(), b"", b"") for k in range(chunks)]

    return settle


def summed(level: int):
    """Sums of the histories of a level over their owners."""

    def settle(table: pa.Table) -> list[Message]:
        rows = sorted(_rows(table, SUMS + level), key=lambda r: r["chunk"])
        order, group, _, cuts = _grouped(rows)
        values = np.concatenate([np.frombuffer(r["y"], np.float64).reshape(-1, 2) for r in rows]) if rows else np.zeros((0, 2))
        total = np.stack([np.bincount(group, values[order, k], group[-1] + 1 if len(group) else 0) for k in (0, 1)], 1)
        answer = np.empty_like(values)
        answer[order] = total[group]
        return [(r["bucket"], r["chunk"], SUMS + level, b"", answer[a:b].tobytes(), b"") for r, a, b in zip(rows, cuts, cuts[1:])]

    return settle


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing factors of counts 1 to DISCOUNTED (Katz's, which leave larger counts alone), from how many types have each count.

    Where they don't lie between 0 and 1 (copies make the numbers uneven), the numbers are first smoothed by a line
    between their logarithms and those of the counts; where that doesn't help (few data), discounting is absolute.
    """
    n = n.astype(float)
    r = np.arange(1, DISCOUNTED + 2)
    line = np.polyfit(np.log(r), np.log(np.maximum(n, 0.5)), 1)
    for numbers in (n, np.exp(np.polyval(line, np.log(r)))):
        with np.errstate(divide="ignore", invalid="ignore"):
            top = (DISCOUNTED + 1) * numbers[-1] / numbers[0]
            d = (r[1:] * numbers[1:] / (r[:-1] * numbers[:-1]) - top) / (1 - top)
        if np.isfinite(d).all() and (d > 0).all() and (d < 1).all() and n[0]:
            return d
    share = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    return 1 - min(0.9, max(0.1, share)) / r[:-1]


class Model:
    """Totals of the training tokens, discounts of each level, and unigram probabilities by count."""

    def __init__(self, totals: list[np.ndarray]):
        self.tokens, self.types = int(totals[0][0]), int(totals[0][1])
        self.d = [discounts(n[2:]) for n in totals]
        freed = sum((1 - d) * r * n for r, (d, n) in enumerate(zip(self.d[0], totals[0][2:]), 1))
        #: A corpus whose words are all frequent frees one count.
        self.spread = 1.0 if freed > 0 else self.tokens / (self.tokens + 1)
        self.unknown = freed / self.tokens if freed > 0 else 1 / (self.tokens + 1)

    def word(self, count: np.ndarray) -> np.ndarray:
        """Probability of a token of that count; of the unknown token for count 0."""
        return np.where(count > 0, self.spread * discounted(count, self.d[0]) / max(1, self.tokens), self.unknown)


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return count * np.concatenate([[0.0], d, [1.0]])[np.minimum(count, DISCOUNTED + 1)]


def backoff(count: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For histories of that count, whose words' discounted counts add up to kept and whose words have probability seen
    together after the shorter history: the factor of the discounted counts, and of the probabilities of other words."""
    safe = np.maximum(count, 1)
    free = 1 - kept / safe
    none = free < 1e-12
    scale = np.where(none, 1 / (safe + 1.0), 1.0 / safe)
    free = np.where(none, 1 / (safe + 1.0), free)
    return scale, np.where(count > 0, free / np.maximum(1 - seen, 1e-300), 1.0)


class Known:
    """What a chunk knows after some rounds: of each level up to the last one answered the counts over all chunks, which n-grams are shared and owned, and the probabilities as far as histories' sums have come."""

    def __init__(self, t: Tokens, found: pa.Table, buckets: int, levels: int, sums: int):
        self.t, self.buckets = t, buckets
        self.count, self.shared, self.own = [], [], []
        for k in range(1, levels + 1):
            grams = t.levels[k - 1]
            asked = t.asked(k, self.shared[-1] if self.shared else None)
            got = np.zeros(len(asked), np.int64)
            placed(grams.hash[asked], buckets, _rows(found, COUNTS + k), lambda r: unpacked(r["y"], r["z"]), got)
            count, shared, own = grams.count.copy(), np.zeros(len(grams), np.bool_), np.ones(len(grams), np.bool_)
            count[asked], shared[asked], own[asked] = got >> 2, got & SHARED > 0, got & OWN > 0
            self.count.append(count)
            self.shared.append(shared)
            self.own.append(own)
        if sums < 0:
            return
        self.model = Model([np.frombuffer(_rows(found, TOTALS + k)[0]["x"], np.int64) for k in range(1, levels + 1)])
        self.p = [self.model.word(self.count[0])]
        for k in range(1, sums + 1):  # histories of k words
            total = self.own_sums(k)
            at = self.asked_sums(k)
            got = np.zeros((len(at), 2))
            placed(t.levels[k - 1].hash[at], buckets, _rows(found, SUMS + k), lambda r: np.frombuffer(r["y"], np.float64).reshape(-1, 2), got)
            total[at] = got
            scale, alpha = backoff(self.count[k - 1], total[:, 0], total[:, 1])
            grams, count = t.levels[k], self.count[k]
            seen = (count > 0) & (self.count[k - 1][grams.prefix] > 0)
            self.p.append(np.where(seen, discounted(count, self.model.d[k]) * scale[grams.prefix], alpha[grams.prefix] * self.p[-1][grams.suffix]))

    def own_sums(self, k: int) -> np.ndarray:
        """Of each n-gram of level k as a history: the discounted counts of the words after it, and their probabilities after the shorter history, over those that this chunk owns."""
        grams, count = self.t.levels[k], self.count[k]
        mine = np.flatnonzero(self.own[k] & (count > 0) & grams.event)
        h = grams.prefix[mine]
        n = len(self.t.levels[k - 1])
        return np.stack([np.bincount(h, discounted(count[mine], self.model.d[k]), n), np.bincount(h, self.p[k - 1][grams.suffix[mine]], n)], 1)

    def asked_sums(self, k: int) -> np.ndarray:
        """The histories of this chunk that others have too, by hash."""
        used = np.zeros(len(self.t.levels[k - 1]), np.bool_)
        used[self.t.levels[k].prefix] = True
        at = np.flatnonzero(used & self.shared[k - 1] & (self.count[k - 1] > 0))
        return at[np.argsort(self.t.levels[k - 1].hash[at], kind="stable")]


_SCORES = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def katz_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Rounds: the counts of level one, then of level two; then, for each level from two on, the sums of its histories
    together with the counts of the next level; then the scores. The texts are shuffled once and read in each round.
    """
    if order < 2:
        raise ValueError("the order must be at least 2")
    chunks, buckets = chunked(docs, per_partition=1, squeeze=True)

    def counts(t: Tokens, level: int, shared: np.ndarray | None) -> list[Message]:
        grams = t.levels[level - 1]
        at = t.asked(level, shared)
        return asks(t.number, COUNTS + level, grams.hash[at], buckets, lambda k: small(grams.count[at[k]]))

    def stay(t: Tokens, level: int, shared: np.ndarray) -> Message:
        """Totals of what isn't asked for, since no other chunk can have it."""
        grams = t.levels[level - 1]
        local = grams.event.copy()
        local[t.asked(level, shared)] = False
        return (t.number % buckets, t.number, LOCAL + level, totals_of(grams.count[local]).tobytes(), b"", b"")

    def tokens(chunk: Chunk, levels: int) -> Tokens:
        t = Tokens(chunk, levels)
        t.number = chunk.number
        return t

    def ask(level: int) -> Callable[[Chunk, pa.Table], pa.Table]:
        """Asks for the sums of the histories of level words (from one on), and for the counts of the level after the next."""

        def run(chunk: Chunk, found: pa.Table) -> pa.Table:
            if not chunk.rows:
                return message_table([])
            t = tokens(chunk, min(order, level + 2))
            known = Known(t, found, buckets, level + 1, level - 1 if level else -1)
            out: list[Message] = []
            if level:
                sums, at = known.own_sums(level), known.asked_sums(level)
                out += asks(t.number, SUMS + level, t.levels[level - 1].hash[at], buckets, lambda k: (sums[at[k]].tobytes(), b""))
            if level + 2 <= order:
                out += [*counts(t, level + 2, known.shared[level]), stay(t, level + 2, known.shared[level])]
            return message_table(out)

        return run

    def score(chunk: Chunk, found: pa.Table) -> pa.Table:
        if not chunk.rows:
            return pa.table({k: pa.array([], v) for k, v in _SCORES})
        t = tokens(chunk, order)
        known = Known(t, found, buckets, order, order - 1)
        word = known.count[0]
        base = np.log10((word + 1) / (known.model.tokens + known.model.types + 1))
        with np.errstate(divide="ignore"):  # padding has no probability of its own
            log_p = np.log10(known.p[-1])
        docs_of = lambda x=None: np.bincount(t.doc, x, chunk.rows)
        columns = (chunk.ids, t.held_out, docs_of().astype(np.int64), docs_of(word[t.token] > 0).astype(np.int64), np.full(chunk.rows, known.model.tokens), docs_of(base[t.token]), docs_of(log_p[t.gram]))
        return pa.table({name: c if name == "doc_id" else pa.array(c) for (name, _), c in zip(_SCORES, columns)})

    def only(answers: DataFrame, kind: int) -> DataFrame:
        return answers.where(F.col("kind") == kind)

    def settled(asked: DataFrame, *settles: Callable[[pa.Table], list[Message]]) -> DataFrame:
        """What the buckets answer. Nothing is filtered before they get it, so that all rounds reuse one exchange."""
        return per_bucket(asked, lambda table: [m for settle in settles for m in settle(table)])

    def everyone(answers: DataFrame, level: int) -> DataFrame:
        """The totals of a level, for every chunk."""
        return per_bucket(only(answers, TOTALS + level), told(buckets))

    answers = settled(per_chunk(chunks, lambda chunk: message_table(counts(tokens(chunk, 1), 1, None)), MESSAGE), counted(1))
    so_far, totals = only(answers, COUNTS + 1), everyone(answers, 1)
    for level in range(order):
        # in round 0 no probability is needed yet, so no totals are sent
        asked = with_answers(chunks, so_far if not level else so_far.unionByName(totals), ask(level), MESSAGE)
        more = level + 2 <= order
        answers = settled(asked, *[summed(level)] * bool(level), *[counted(level + 2)] * more)
        if level:
            so_far = so_far.unionByName(only(answers, SUMS + level))
        if more:
            so_far, totals = so_far.unionByName(only(answers, COUNTS + level + 2)), totals.unionByName(everyone(answers, level + 2))
    return with_answers(chunks, so_far.unionByName(totals), score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))
