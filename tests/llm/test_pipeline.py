"""The pipeline's stages on the smallest tables, each held against brute force on its own input."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from llm import pii, toxicity
from llm.common import written

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(written(stage(spark, found[-1], FOLDER), f"test-{name}"))
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "personal_data", "packing"]
    assert all(df.columns == stages[0].columns and df.schema == stages[0].schema for df in stages[1:5])


def test_toxicity(spark, stages):
    model = toxicity.trained(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.scores(stages[0], model).collect() if not r.predicted}
    assert set(texts(stages[1])) == clean


def test_exact(stages):
    least = {}
    for i, t in sorted(texts(stages[1]).items()):
        least.setdefault(lower(t), i)
    assert set(texts(stages[2])) == set(least.values())


def test_near(stages):
    before = texts(stages[2])
    sets = {}
    for i, t in before.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1) >= 0.8:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert set(texts(stages[3])) == {i for i in sets if label[i] == i}


def test_personal_data(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for i, t in before.items():
        spans = pii.base_spans(t)
        assert all(t[a:b] not in after[i] for _, a, b in spans) and (spans or len(after[i]) <= len(t))


def test_packing(stages):
    want, got = collections.Counter(texts(stages[4]).keys()), collections.defaultdict(int)
    tokens = {}
    for r in stages[5].collect():
        got[r.doc_id] += r.length
        tokens[r.doc_id] = r.doc_tokens
        assert len(r.ids) == r.length and max(r.ids) < 50257
    assert set(got) == set(want) and all(got[i] == tokens[i] for i in got) and np.sum(list(got.values())) > 0
