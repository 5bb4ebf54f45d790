"""Cases that a shortcut once lost: each is held against the whole job's result."""

import random

import numpy as np

from llm import packing, pii, simhash


def test_refrain_in_one_of_two_near_copies(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(2000)]
    rows = []
    for k in range(6):
        words = [rng.choice(vocab) for _ in range(200)]
        refrain = words[-10:]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words + refrain * 100))]
    found = simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 10 for i, _ in rows}


def test_short_texts_at_the_threshold(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(7)) for _ in range(20000)]
    rows = []
    for k in range(1500):  # four of five shingles: the longer text has one word more
        words = [rng.choice(vocab) for _ in range(9)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:-1]))]
    found = simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 10 for i, _ in rows}


def test_spelled_out_addresses_whole():
    addresses = [
        "jane.doe (at) university (dot) org", "jane (at) mail (dot) example (dot) org", "jane (at) city-hospital (dot) example (dot) de",
        "a.very.long.local.part.of.a.name [at] mail [dot] example [dot] com", "maximiliana.featherstonehaugh-smythe (at) mail (dot) example (dot) org",
    ]
    texts = [f"write to {a} today, or not" for a in addresses]
    found = pii.all_spans(texts, pii.trained())
    assert [[t[a:b] for _, a, b in added] for t, (_, added) in zip(texts, found)] == [[a] for a in addresses]


def test_neighbours_by_all_terms():
    rng = np.random.default_rng(5)
    docs = [np.sort(rng.choice(600, 60, replace=False)) for _ in range(40)]
    index = packing.Bm25Index(np.concatenate(docs).astype(np.int64), np.full(40, 60))
    used = np.arange(40) % 3 == 0
    score = {}
    for d in np.flatnonzero(~used).tolist():
        mine = dict(zip(index.term[index.before[d] : index.before[d + 1]].tolist(), index.weight[index.before[d] : index.before[d + 1]].tolist()))
        score[d] = sum(mine.get(t, 0.0) for t in docs[0].tolist())
    found = index.neighbours(0, used).tolist()
    assert set(found) == {d for d in score if score[d] > 0}
    assert all(score[a] >= score[b] - 1e-6 for a, b in zip(found, found[1:]))
