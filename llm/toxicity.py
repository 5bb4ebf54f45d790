"""Toxicity by a weighted finite-state pattern grammar.

A lexicon rewrites a text as classes: words as insult, threat, target, negation, report or other, ends of clauses as
stop, quotation marks as quote. Five transducers read the classes and weigh the insults and threats among them: one
raises an insult with a target before it, one halves a threat without; one, which reads from the end, raises either
with a target close behind; one lowers what stands after a negation; one lowers what is reported, after a verb of saying
or inside quotation marks. Those that read forwards are composed into one machine, whose factors are the products of
theirs, and no machine remembers words beyond the end of a clause. It runs over documents that hold an insult or a
threat; a document's score is a logistic function of the weights of its matched clauses.

Insult stems and their weights are learned from labelled rows: a word beginning that keeps company with the label far
beyond chance (a likelihood ratio that stands up to as many trials as there are beginnings) enters the lexicon. The sample
of labelled rows is bounded by SAMPLE rows and SAMPLE_BYTES of text; it is taken by a hash of doc_id and is the same
whenever the rows are.

Defined results: null or empty text matches nothing and gets the score of no clause; a null doc_id is not held out and
its row is scored; labels that name a document twice count once, as toxic if either is; without usable labels the
built-in lexicon is used alone; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import _BYTE_POWERS, Block, blocks, byte_values, crc32_of_id, documents, mix, prefix_sums, release, slices
from llm.fingerprints import shingles

#: Labelled rows that a fit reads at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 8_000, 64 << 20
LENGTHS = range(3, 13)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP, QUOTE = range(8)
CLASSES = 8
WORDS = {
    THREAT: "kill kills killing murder murders murdering destroy destroys destroying hurt hurts hurting beat beats beating stab stabs stabbing shoot shoots shooting tuer tue tuerai frapper frappe frapperai écraser écrase écraserai töten töte tötet umbringen umbringe schlagen schlage schlägt matar mato mataré golpear golpeo golpearé destruir destruyo destruiré",
    TARGET: "you your yours yourself youre u tu vous ton votre toi du dich dir ihr euch sie usted tú ti vosotros te",
    NEGATION: "not no never nobody isnt arent wasnt dont doesnt neither nor pas jamais aucun nicht nie kein keine nunca tampoco ningún",
    REPORT: "said says say told wrote quoted quote claims claimed called dit disait écrit sagte sagt schrieb dijo dice escribió",
}
INSULTS = "idiot idiots moron morons stupid loser scum worthless pathetic disgusting imbécile crétin connard dummkopf arschloch vollidiot estúpido estúpida gilipollas imbécil"
_LETTER = np.zeros(256, np.bool_)
_LETTER[97:123] = _LETTER[128:] = True
_LETTER[65:91] = True
_END = np.zeros(256, np.bool_)
_END[[10, 33, 46, 63, 59]] = True  # line end ! . ? ;
_QUOTE = 34


@dataclass
class Transducer:
    """A deterministic machine over classes: next state and factor of the weight for each state and class."""

    step: np.ndarray
    factor: np.ndarray

    def compose(self, other: Transducer) -> Transducer:
        """The machine that runs both; its weights are the products. States that can't be reached are left out."""
        n = len(other.step)
        step = (self.step[:, None, :] * n + other.step[None, :, :]).reshape(-1, CLASSES)
        factor = (self.factor[:, None, :] * other.factor[None, :, :]).reshape(-1, CLASSES)
        reached, todo = {0: 0}, [0]
        for state in todo:
            for to in step[state].tolist():
                if to not in reached:
                    reached[to] = len(reached)
                    todo.append(to)
        number = np.zeros(len(step), np.int64)
        number[todo] = np.arange(len(todo))
        return Transducer(number[step[todo]], factor[todo])


def countdown(trigger: int, reach: int, on: dict[int, float], off: dict[int, float] | None = None) -> Transducer:
    """Remembers for reach words that trigger was read: within them the factors on hold, else off. STOP forgets; a quotation mark isn't a word."""
    step = np.zeros((reach + 1, CLASSES), np.int64)
    factor = np.ones((reach + 1, CLASSES))
    for s in range(reach + 1):
        step[s] = max(0, s - 1)
        step[s, trigger], step[s, STOP], step[s, QUOTE] = reach, 0, s
        for symbol, f in (on if s else off or {}).items():
            factor[s, symbol] = f
    return Transducer(step, factor)


def insults() -> Transducer:
    return countdown(TARGET, 4, {INSULT: 1.5})


def threats() -> Transducer:
    return countdown(TARGET, 4, {}, {THREAT: 0.5})


def negations() -> Transducer:
    return countdown(NEGATION, 3, {INSULT: 0.2, THREAT: 0.2})


def reports() -> Transducer:
    """After a verb of saying, and inside quotation marks: every second one ends what the one before it began, whatever clauses are between."""
    step = np.zeros((2, CLASSES), np.int64)
    step[1] = 1
    step[:, QUOTE] = 1, 0
    factor = np.ones((2, CLASSES))
    factor[1, [INSULT, THREAT]] = 0.4
    return countdown(REPORT, 6, {INSULT: 0.4, THREAT: 0.4}).compose(Transducer(step, factor))


def targets() -> Transducer:
    """Reads from the end: a target within two words behind."""
    return countdown(TARGET, 2, {INSULT: 1.25, THREAT: 1.25})


class Grammar:
    """The composed machine that reads forwards, and the one that reads backwards."""

    def __init__(self, forward: Transducer, backward: Transducer):
        self.forward, self.backward = forward, backward
        self._rows = [(m.step.tolist(), m.factor.tolist()) for m in (forward, backward)]

    def weigh(self, symbols: list[int]) -> list[float]:
        """The factor of each insult and threat of a document's classes, in order."""
        found: list[list[float]] = []
        for (step, factor), read in zip(self._rows, (symbols, symbols[::-1])):
            state, out = 0, []
            for s in read:
                if s == INSULT or s == THREAT:
                    out.append(factor[state][s])
                state = step[state][s]
            found.append(out)
        return [a * b for a, b in zip(found[0], found[1][::-1])]


def grammar() -> Grammar:
    return Grammar(insults().compose(threats()).compose(negations()).compose(reports()), targets())


class Words:
    """Letter runs of a block: class-free, with hashes of their beginnings of each length and of the whole."""

    def __init__(self, block: Block):
        data = block.data
        black = np.zeros(len(data) + 2, np.bool_)
        black[1:-1] = _LETTER[data]
        edge = np.zeros(len(data) + 1, np.bool_)
        edge[block.offsets] = True
        self.starts = np.flatnonzero(black[1:] & (~black[:-1] | edge))
        self.ends = np.flatnonzero(black[:-1] & (~black[1:] | edge))
        self.doc = np.searchsorted(block.offsets, self.starts, "right") - 1
        self.sums = prefix_sums(byte_values(data), _BYTE_POWERS)

    def whole(self) -> np.ndarray:
        return mix((self.sums[self.ends] - self.sums[self.starts]) * _BYTE_POWERS.down[self.starts] + np.uint64(1))

    def beginning(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at least n bytes, and the hash of their first n."""
        at = np.flatnonzero(self.ends - self.starts >= n)
        s = self.starts[at]
        return at, mix((self.sums[s + n] - self.sums[s]) * _BYTE_POWERS.down[s])


def lowered(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def word_hash(word: str, n: int | None = None) -> int:
    """The hash of a word (whole, or its first n bytes), as Words gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    words = Words(Block(0, raw, np.array([0, len(raw)])))
    return int(words.whole()[0]) if n is None else int(words.beginning(n)[1][0])


@dataclass
class Model:
    """Sorted hashes of whole words and beginnings with class and weight, and the logistic function."""

    whole: tuple[np.ndarray, np.ndarray, np.ndarray]
    begins: dict[int, tuple[np.ndarray, np.ndarray]]
    slope: float = 3.0
    bias: float = -2.5

    def classes(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        symbol = np.zeros(len(words.doc), np.int8)
        weight = np.zeros(len(words.doc))
        known, classes, weights = self.whole
        if len(known):
            hashes = words.whole()
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            symbol[hit], weight[hit] = classes[at[hit]], weights[at[hit]]
        for n, (known, weights) in self.begins.items():
            at, hashes = words.beginning(n)
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[place] == hashes
            rows = at[hit]
            symbol[rows] = INSULT
            weight[rows] = np.maximum(weight[rows], weights[place[hit]])
        return symbol, weight

    def clauses(self, block: Block, machine: Grammar) -> np.ndarray:
        """The summed weight of each document's matched clauses."""
        total = np.zeros(len(block))
        words = Words(block)
        symbol, weight = self.classes(words)
        hit = (symbol == INSULT) | (symbol == THREAT)
        if not hit.any():
            return total
        wanted = np.zeros(len(block), np.bool_)
        wanted[words.doc[hit]] = True
        marks = np.flatnonzero(_END[block.data] | (block.data == _QUOTE))
        doc = np.searchsorted(block.offsets, marks, "right") - 1
        marks, doc = marks[wanted[doc]], doc[wanted[doc]]
        at = np.flatnonzero(wanted[words.doc])
        order = np.argsort(np.concatenate([words.starts[at], marks]), kind="stable")
        read = np.concatenate([symbol[at], np.where(block.data[marks] == _QUOTE, QUOTE, STOP).astype(np.int8)])[order]
        owner = np.concatenate([words.doc[at], doc])[order]
        cuts = np.searchsorted(owner, np.flatnonzero(wanted))
        factors: list[float] = []
        for lo, hi in zip(cuts.tolist(), [*cuts.tolist()[1:], len(read)]):
            factors += machine.weigh(read[lo:hi].tolist())
        np.add.at(total, words.doc[hit], weight[hit] * np.array(factors))
        return total

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log1p(total) + self.bias)))


def _lexicon(insults: dict[str, float], begins: list[tuple[int, int, float]]) -> Model:
    rows = [(word_hash(w), c, 1.0) for c, ws in WORDS.items() for w in ws.split()] + [(word_hash(w), INSULT, x) for w, x in insults.items()]
    rows.sort()
    by: dict[int, list] = {}
    for n, h, x in begins:
        by.setdefault(n, []).append((h, x))
    return Model(
        (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int8), np.array([r[2] for r in rows])),
        {n: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([x for _, x in sorted(v)])) for n, v in by.items()},
    )


def ratio(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Likelihood ratio of a toxic and b other documents against the share p, zero where they are fewer than expected."""
    n = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / (n * p)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - p))), 0))
    return np.where(a > n * p, g, 0)


def independent(column: pa.Array) -> np.ndarray:
    """Rows that share none of their four least shingle hashes with an earlier one: copies are no further evidence."""
    seen: set[int] = set()
    keep = []
    for block in blocks(column):
        hashes, owner = shingles(block, 5)
        order = np.lexsort((hashes, owner))
        hashes, cuts = hashes[order], np.searchsorted(owner[order], np.arange(len(block) + 1))
        for k in range(len(block)):
            mine = set(hashes[cuts[k] : min(cuts[k] + 4, cuts[k + 1])].tolist())
            if not mine & seen:
                keep.append(block.first + k)
            seen |= mine
    return np.array(keep, np.int64)


def fit(texts: list[str] | pa.ChunkedArray, toxic: np.ndarray) -> Model:
    """The lexicon and logistic function learned from labelled texts."""
    seed = dict.fromkeys(INSULTS.split(), 1.0)
    toxic = np.asarray(toxic, np.bool_)
    column = lowered(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
    del texts
    if len(toxic):
        rows = independent(column)
        column, toxic = column.take(pa.array(rows)), toxic[rows]
    if not toxic.any() or toxic.all():
        return _lexicon(seed, [])
    all_blocks = list(blocks(column))
    p = toxic.mean()
    tables = {}
    trials = 0
    for n in (0, *LENGTHS):  # one length at a time, for the memory of the driver
        held, owner = [], []
        for block in all_blocks:
            words = Words(block)
            at, hashes = (np.arange(len(words.doc)), words.whole()) if n == 0 else words.beginning(n)
            pair = np.unique(mix(hashes) ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1)), return_index=True)[1] if len(at) else np.zeros(0, np.int64)
            held.append(hashes[pair])
            owner.append((block.first + words.doc[at][pair]).astype(np.int32))
        hashes, owner = np.concatenate(held), np.concatenate(owner)
        del held
        order = np.argsort(hashes)
        hashes, y = hashes[order], toxic[owner[order]]
        del order, owner
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
        found = hashes[first]
        a = np.add.reduceat(y.astype(float), first) if len(first) else np.zeros(0)
        b = np.diff(np.append(first, len(hashes))) - a
        del hashes, y
        some = (a > 0) | (n == 0)  # of whole words all: those of the built-in lexicon may be ordinary here
        tables[n] = (found[some], a[some], b[some])
        trials += len(found)
    needed = 2 * math.log(max(2, trials)) + 4
    clean = len(toxic) - toxic.sum()
    chosen: dict[tuple[int, int], tuple[float, float]] = {}
    for n, (found, a, b) in tables.items():
        g = ratio(a, b, p)
        for k in np.flatnonzero((g >= needed) & (b <= 0.02 * clean) & (a >= 5 * b)).tolist():
            chosen[n, int(found[k])] = (float(a[k]), float(b[k]))
    # of beginnings of one word keep the longest among those that are as common as it, and no longer ones inside it
    keep: dict[tuple[int, int], tuple[float, float]] = {}
    for block in all_blocks:
        words = Words(block)
        chains: dict[int, list[tuple[int, int]]] = {}
        for n in (*LENGTHS, 0):
            at, hashes = (np.arange(len(words.doc)), words.whole()) if n == 0 else words.beginning(n)
            known = np.array(sorted(h for m, h in chosen if m == n), np.uint64)
            if not len(known):
                continue
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for w, h in zip(at[known[place] == hashes].tolist(), hashes[known[place] == hashes].tolist()):
                chains.setdefault(w, []).append((n, h))
        for chain in chains.values():
            best = chain[0]
            for step in chain[1:]:
                if chosen[step][0] >= 0.97 * chosen[best][0]:
                    best = step
            keep[best] = chosen[best]
    whole_known = tables[0]
    for word in list(seed):
        at = int(np.searchsorted(whole_known[0], np.uint64(word_hash(word))))
        if at < len(whole_known[0]) and whole_known[0][at] == np.uint64(word_hash(word)) and whole_known[2][at] > max(2, whole_known[1][at] / 5):
            del seed[word]  # ordinary in these texts
    weight = lambda a, b: min(2.0, max(0.5, math.log(((a + 0.5) / (toxic.sum() + 1)) / ((b + 0.5) / (clean + 1))) / 4))
    model = _lexicon(seed, [(n, h, weight(*ab)) for (n, h), ab in keep.items() if n])
    known = {h: (c, x) for h, c, x in zip(*map(np.ndarray.tolist, model.whole))} | {h: (INSULT, weight(*ab)) for (n, h), ab in keep.items() if not n}
    rows = sorted((h, c, x) for h, (c, x) in known.items())
    model.whole = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int8), np.array([r[2] for r in rows]))
    machine = grammar()
    total = np.concatenate([model.clauses(b, machine) for b in all_blocks])
    model.slope, model.bias = _logistic(np.log1p(total), toxic)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> tuple[float, float]:
    """Slope (at least zero) and bias by Newton's method, with a penalty that keeps them finite where the classes part."""
    w = np.zeros(2)
    rows = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-rows @ w))
        gradient = rows.T @ (p - y) + penalty * w * [1, 0.1]
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + penalty * np.diag([1, 0.1])
        step = np.linalg.solve(curve, gradient)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of labelled rows whose crc32(doc_id as text) mod 5 is not 0: of at most sample of them, by a hash of doc_id, as far as their texts fit into sample_bytes."""
    spark = docs.sparkSession
    wanted = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    wanted = wanted.where(crc32_of_id("doc_id") % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = wanted.toPandas().astype("int64")
    ids["place"] = range(len(ids))
    named = spark.createDataFrame(ids, "doc_id long, toxic long, place long")
    sizes = texts.join(F.broadcast(named), "doc_id").groupBy("place").agg(F.sum(F.octet_length("text")).alias("size")).toPandas().sort_values("place")
    most = sizes["place"][sizes["size"].cumsum() <= sample_bytes].max()
    rows = texts.join(F.broadcast(named.where(F.col("place") <= (-1 if most != most else int(most)))), "doc_id").select("text", "toxic").toArrow()
    toxic = np.asarray(rows.column("toxic")) > 0
    found = fit(rows.column("text"), toxic)
    del rows
    release()  # the driver needs no room for the sample any more
    return found


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, the weight of the matched clauses, score and predicted for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in slices(batches):
            found = [model.clauses(b, machine) for b in blocks(lowered(batch.column(2).fill_null("")))]
            total = np.concatenate(found) if found else np.zeros(0)
            score = model.score(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "clauses", "score", "predicted"])

    held_out = F.coalesce(crc32_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", held_out, "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, clauses double, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).fill_null("")
            found = [model.clauses(b, machine) for b in blocks(lowered(texts))]
            yield batch.filter(pa.array(model.score(np.concatenate(found)) < 0.5 if found else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model).select("doc_id", "held_out", "score", "predicted")
