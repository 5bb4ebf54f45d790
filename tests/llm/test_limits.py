"""What operators exchange and sort, held against bounds that larger tables need, and against plain definitions."""

import collections
import re

import numpy as np

from llm import packing, simhash, suffixes
from llm.chunks import message_table, to_buckets


def test_anchors_are_answered_by_bits():
    rng = np.random.default_rng(2)
    buckets, all_ = 3, rng.integers(0, 1 << 48, 3000).astype(np.uint64)
    chunks = {c: np.unique(rng.choice(all_, 1500)) for c in (4, 7, 9)}
    marks = {c: (rng.random(len(h)) < 0.01).astype(np.uint8) for c, h in chunks.items()}
    asked = [(*m[:3], suffixes.shortened(m[3]), *m[4:]) for c, h in chunks.items() for m in to_buckets(c, h, buckets, marks[c])]
    assert sum(len(m[3]) for m in asked) == suffixes.ASKED * sum(map(len, chunks.values()))
    answers = [a for b in range(buckets) for a in suffixes.recurring_bits(message_table([m for m in asked if m[0] == b]))]
    assert sum(len(a[3]) for a in answers) <= sum(map(len, chunks.values())) / 8 + 9
    for c, h in chunks.items():
        others = np.concatenate([x for d, x in chunks.items() if d != c])
        want = h[np.isin(h, others) | (marks[c] > 0)]
        found = suffixes.answered(h, buckets, message_table([a for a in answers if a[1] == c]))
        assert found.tolist() == want.tolist() and len(h) > len(want) > 0
    assert not len(suffixes.answered(chunks[4], buckets, message_table([])))


def test_doubling_sorts_only_ties(monkeypatch):
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 1500).astype(np.uint8)
    text = np.concatenate([passage, rng.integers(97, 123, 60000).astype(np.uint8), passage])
    n = 0

    def counted(sort, of):
        def run(keys, *args, **named):
            nonlocal n
            n += of(keys)
            return sort(keys, *args, **named)

        return run

    monkeypatch.setattr(np, "lexsort", counted(np.lexsort, lambda k: len(k[0])))
    monkeypatch.setattr(np, "argsort", counted(np.argsort, len))
    sorter = suffixes.SuffixSorter(text)
    assert n < 2 * len(text) * len(suffixes.COVER) / suffixes.PERIOD
    monkeypatch.undo()
    for text in (text[:4000], np.tile(passage[:70], 40)):
        wanted, sorter = np.arange(len(text)), suffixes.SuffixSorter(text)
        assert np.concatenate(list(sorter.buckets(wanted))).tolist() == sorted(wanted.tolist(), key=lambda k: text.tobytes()[k:])


def test_a_text_is_encoded_in_one_call(monkeypatch):
    import public_tokenizers
    import tiktoken
    import tokenizers

    calls = []
    for name in ("encode", "encode_to_numpy"):
        plain = getattr(tiktoken.Encoding, name)
        monkeypatch.setattr(tiktoken.Encoding, name, lambda self, text, plain=plain, **named: calls.append(text) or plain(self, text, **named))
    rng = np.random.default_rng(4)
    text = " ".join("".join(map(chr, rng.integers(97, 123, 9))) + ("  \n", "", ", é<|endoftext|>")[k % 3] for k in range(3000))
    ids = np.frombuffer(packing.Encoder(packing.byte_bpe_file())(text), "<u2").tolist()
    assert ids == tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert calls == [text]


def test_words_are_looked_ahead_only_at_white_space_in_a_row(monkeypatch):
    import public_tokenizers
    import tiktoken
    import tokenizers

    plain, calls = tiktoken.Encoding.encode_to_numpy, []
    monkeypatch.setattr(tiktoken.Encoding, "encode_to_numpy", lambda self, text, **named: calls.append((text, "(?!" in self._pat_str)) or plain(self, text, **named))
    encode, tok = packing.Encoder(packing.byte_bpe_file()), tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(6)
    signs = [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "\u2028", "\u3000", "\ufeff", "ab", "é", "12", "'s", "!", "字", "<|endoftext|>"]
    white = "[\t-\r \x85\xa0\u2003\u2028\u3000]"
    texts = ["".join(rng.choice(signs, rng.integers(1, 12))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert calls == [(t, re.search(white * 2, t) is not None) for t in texts]
    assert 500 < sum(ahead for _, ahead in calls) < 2500


def test_common_terms_are_not_listed_document_by_document(monkeypatch):
    rng = np.random.default_rng(7)
    docs = [np.concatenate([np.arange(40), 1000 + rng.choice(3000, 60, replace=False)]) for _ in range(200)]
    ids, lengths = np.concatenate(docs), np.full(200, 100)
    index, used, listed, plain = packing.Bm25Index(ids, lengths), np.zeros(200, np.bool_), 0, np.bincount

    def counted(x, *args, **named):
        nonlocal listed
        listed += len(x)
        return plain(x, *args, **named)

    weights = [dict(zip(index.term[a:b].tolist(), index.weight[a:b].astype(float).tolist())) for a, b in zip(index.before, index.before[1:])]
    for seed in rng.permutation(200).tolist():
        used[seed] = True
        monkeypatch.setattr(np, "bincount", counted)
        found = index.neighbours(seed, used).tolist()
        monkeypatch.undo()
        score = {d: sum(w for t, w in weights[d].items() if t in weights[seed]) for d in np.flatnonzero(~used).tolist()}
        assert found == sorted(score, key=lambda d: (-round(score[d], 9), d))
    assert listed < 200 * 200 * 40 / 8  # of what lists of the common terms alone would hold


def test_pairs_of_many_documents():
    rng = np.random.default_rng(8)
    for n in (1000, 70_000):
        lengths = rng.integers(1, 4, n)
        ids = rng.choice([1, 2, 65535], int(lengths.sum())).astype("<u2")
        pairs = collections.Counter(zip(ids.tolist(), np.repeat(np.arange(n), lengths).tolist()))
        doc, term, tf = packing.terms_of(ids, lengths)
        assert list(zip(term.tolist(), doc.tolist(), tf.tolist())) == [(*k, pairs[k]) for k in sorted(pairs)]


def test_simhash_links_close_copies_before_prefixes_are_asked(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(2000)]
    rows = []
    for k in range(12):
        text = rng.choice(words, 1500).tolist()
        near, like = [*text[:-2], "x", "y"], [*text[:1370], *rng.choice(words, 130)]
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(like))]
    found, asked = [], []

    def fingerprint_links(nodes, *args, plain=simhash.fingerprint_links, **named):
        links = plain(nodes, *args, **named)
        fp = {r.node: r.fp for r in nodes.collect()}
        found.extend(((fp[r.u] ^ fp[r.v]) & (1 << 64) - 1).bit_count() for r in links.collect())
        return links

    def prefix_links(nodes, *args, plain=simhash.prefix_links, **named):
        asked.append(nodes.count())
        return plain(nodes, *args, **named)

    monkeypatch.setattr(simhash, "fingerprint_links", fingerprint_links)
    monkeypatch.setattr(simhash, "prefix_links", prefix_links)
    classes = simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in classes} == {i: i - i % 10 for i, _ in rows}
    assert len(found) >= 10 and max(found) <= 2 * simhash.RADIUS
    assert asked[0] < len(rows) - 8 and asked[1] == len(rows)  # representatives, then all


def test_whole_copies_are_told_once_a_chunk():
    """Chunks with the same texts: all but the one with the least doc_id hear of it (a null one comes first, equal ones are one document)."""
    texts = np.array([11, 12, 13], np.uint64)
    asked = [m for c, d in ((0, [5, 7, -(1 << 63)]), (1, [6, 7, 9]), (2, [4, 8, 3])) for m in to_buckets(c, texts, 1, np.array(d, np.int64))]
    told = {m[1]: np.frombuffer(m[3], np.uint64).tolist() for m in suffixes.copies(message_table(asked))}
    assert told == {0: [11], 1: [11, 13], 2: [12, 13]}


def test_copies_lose_all_bytes(spark):
    """Whole texts repeated in other documents, in the same one, under null, and too short to hold a string; what others share with them still counts."""
    rng = np.random.default_rng(3)
    long = ["".join(rng.choice(list("abcdé "), 300)) for _ in range(4)]
    rows = [(k, t) for k, t in enumerate(long)] + [(k + 10 * j, t) for k, t in enumerate(long) for j in (1, 2, 3)] + [(None, long[3]), (None, long[3]), (2, long[2]), (40, "short"), (41, "short"), (42, ""), (43, None), (44, "x" + long[0][:80] + "y"), (-1, long[1][100:200])]
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - 49):
            first[data[k : k + 50]] = min(-99 if i is None else i, first.get(data[k : k + 50], 99))
    want = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < (-99 if i is None else i):
                gone[k : k + 50] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2).tolist()
        want.append((str(i), len(data), int(gone.sum()), edge, bytes(np.frombuffer(data, np.uint8)[~gone])))
    found = suffixes.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, [[s.start, s.end] for s in r.spans], bytes(r.kept)) for r in found) == sorted(want)
