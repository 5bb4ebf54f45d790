"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from llm import components, exact_dedup, fingerprints, katz, packing, pieces, pii, queries, simhash, substrings, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, keep_id long, chunk int, digest string, u long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for k in range(40):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120)))
        if k % 3 == 0:
            t += "\n" + passage + " " + rng.choice(vocab)
        if k % 7 == 0:
            t = t.replace("a", "é").replace(" ", "  ", 3)
        out.append((k * 3 + 1, t))
    base = dict(out)
    out += [(500, base[4]), (501, base[4].upper()), (2, base[4]), (502, base[7] + " extra"), (503, ""), (504, None), (505, " \t\n "), (506, "one"), (507, "one two"), (508, "漢字 😀 x"), (509, "same " * 3000), (510, "x" * 9000), (511, base[10][5:]), (511, base[10][5:])]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, 1, "d", 2) for i, t in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def with_null_id(spark):
    return spark.createDataFrame([(None, "a b c d e f", "en", 1, 1, "", 1), (1, "a b c d e f", "en", 1, 1, "", 1), (2, None, None, None, None, None, None)], COLUMNS)


OPERATORS = [exact_dedup.exact_duplicates, packing.packed, simhash.simhash_classes, simhash.similar_classes, substrings.repeated_passages, suffixes.repeated_strings, katz.katz_scores, fingerprints.edited_fingerprints, fingerprints.fingerprints, pieces.encoded, exact_dedup.deduplicated, simhash.near_deduplicated, pii.personal_data, pii.masked]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_empty_and_null(empty, with_null_id, operator):
    assert operator(empty).count() == 0
    assert operator(with_null_id).count() >= 2


@pytest.mark.parametrize("keep, width", [("largest", 32), ("smallest", 1)])
def test_exact(docs, rows, keep, width):
    found = exact_dedup.exact_duplicates(docs, keep, digest_bytes=width, memtable_bytes=2000).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t or "")].append(i)
    pick = max if keep == "largest" else min
    want = sorted((i, pick(groups[lower(t or "")]), len(groups[lower(t or "")]), hashlib.sha256(lower(t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == len(groups) and all(r.doc_id == r.keep_id for r in found if r.kept)
    kept = exact_dedup.deduplicated(docs, keep).collect()
    assert len(kept) == len(groups) and all(r.doc_id == pick(groups[lower(r.text or "")]) for r in kept)


def test_lsm_index():
    index = exact_dedup.LsmIndex()
    rng = random.Random(1)
    known, n = {}, 0
    for flush in range(30):
        keys = sorted({rng.randrange(60 + 400 * (flush % 2)).to_bytes(4, "little") for _ in range(20)})
        values = [rng.randrange(1000) for _ in keys]
        for k, v in zip(keys, values):
            known.setdefault(k, []).append(v)
        index.add(exact_dedup.run_of(keys, values, range(n, n + len(keys)), range(n, n + len(keys)), [1] * len(keys)))
        n += len(keys)
    assert all(index.get(k) == min(v) for k, v in known.items()) and index.get(b"none") is None and len(index.runs) > 1
    run = index.compact()
    assert index.added == 30 and index.compactions > 6 and index.probed > 30 and len(index.runs) == 1
    assert len(run) == len(known) and all(index.get(k) == min(v) for k, v in known.items())
    data = run.key.tobytes()
    assert {data[4 * k : 4 * k + 4] for k in np.flatnonzero(run.hit)} == {k for k, v in known.items() if len(v) > 1}
    assert sum(len(x["key"]) for x in index.lost) == n - len(known) and all(x["hit"].all() for x in index.lost)


def test_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    bloom = exact_dedup.Bloom(keys[:2000])
    assert bloom.maybe(keys[:2000]).all() and bloom.maybe(keys[2000:]).mean() < 0.05


def test_index_at_work(docs, rows):
    """The query's own index: tasks flush several runs, shards look up and compact them, and the entries given up are the hits."""
    found, entries = exact_dedup.index_tables(docs, "smallest", memtable_bytes=3000)
    runs = found.where(f"kind = {exact_dedup.RUN}").collect()
    shards = entries.groupBy("runs", "probes", "compactions").count().collect()
    assert len({r.row for r in runs}) > 6 and sum(r.compactions for r in shards) >= 4 and sum(r.probes for r in shards) > len(runs)
    assert all(list(exact_dedup.shard_of(np.frombuffer(r["keys"], "S32"), 4)) == [r.shard] * (len(r["keys"]) // 32) for r in runs)
    lost = entries.where("rep <> first").collect()
    assert lost and all(r.hit for r in lost) and entries.where("rep = first").count() == len({lower(t or "") for _, t in rows})


def test_repeated_ids_and_clashing_columns(spark):
    """Rows are told by doc_id and text: of a repeated doc_id each text is judged by itself."""
    names = "stays_id", "row_digest", "stays_digest", "stays_n", "_id", "_sha", "_is", "_again", "_hit", "_n", "_k", "node", "component", "digest", "n", "kept", "sha", "size", "fp"
    body = "one two three four five six seven eight nine ten eleven twelve"
    made = [(5, body), (5, "quite another text of its own, unlike the rest of them"), (1, body + " more"), (1, body + " more"), (None, body), (None, "apart"), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in made], "doc_id long, text string, " + ", ".join(f"{c} long" for c in names))
    exact = exact_dedup.deduplicated(df)
    assert exact.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in exact.collect()) == collections.Counter([(5, made[0][1]), (5, made[1][1]), (1, made[2][1]), (None, "apart"), (7, None)])
    near = simhash.near_deduplicated(df)
    assert near.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in near.collect()) == collections.Counter([(5, made[1][1]), (1, made[2][1]), (None, body), (None, "apart"), (7, None)])


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    sequences = collections.defaultdict(list)
    pieces_of = collections.defaultdict(list)
    for r in packing.packed(docs, window=256, shard_tokens=3000).collect():
        assert zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces_of[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    for (i, n), parts in pieces_of.items():
        copies = [x for x in want[i] if len(x) == n]
        assert sorted(t for s, ids in parts for t in ids) == sorted(t for x in copies for t in x)
        if len(copies) == 1:
            assert [t for _, ids in sorted(parts) for t in ids] == copies[0]
    for text in ["", " ", "  a  b\n c ", "x <|endoftext|> y  z", "　a　 b", "a\x1c b", "tail "]:
        assert np.frombuffer(packing.encoder(packing.byte_bpe_file())(text), "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_windows_hold_the_best_neighbours():
    """What fills a seed's window are its best unused neighbours in turn, by BM25 worked out in loops from counts of the whole table."""
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 300, 40) for _ in range(60)]
    for k in range(0, 60, 6):  # some pairs with much in common, far from each other in the table
        docs[(k + 31) % 60] = np.concatenate([docs[k][:30], rng.integers(0, 300, 10)])
    df = np.zeros(packing.IDS, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    df[:50] += 400  # elsewhere in the table
    corpus = packing.Corpus(1000, 50_000, df)
    found = packing.pack_shard(np.concatenate(docs), np.full(60, 40), 200, corpus)

    def bm25(seed, d):
        idf = lambda t: math.log1p((1000 - df[t] + 0.5) / (df[t] + 0.5))
        tf = collections.Counter(docs[d].tolist())
        return sum(idf(t) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * 40 / 50)) for t in set(docs[seed].tolist()) if t in tf)

    windows = collections.defaultdict(list)
    for d, _, _, sequence, offset in found:
        windows[sequence].append((offset, d))
    used, checked = set(), 0
    for sequence in sorted(windows)[:-3]:
        seed, *others = [d for _, d in sorted(windows[sequence])]
        used.add(seed)
        for d in others:
            best = max((bm25(seed, x) for x in range(60) if x not in used), default=0)
            assert math.isclose(bm25(seed, d), best, rel_tol=1e-5)
            used.add(d)
            checked += 1
    assert checked > 30


def test_lexical_shards(spark):
    """Texts that share a rare token come into one shard from anywhere in the table, and counts are those of the whole table."""
    rng = random.Random(15)
    rare = ["Zimbabwe", "Neuroscience", "Mozilla", "Palestinians", "Quarterback", "Constantinople"]
    made = [(k, " ".join(rng.choice(["the", "of", "and", "to", "in", "a"]) for _ in range(30)) + f" {rare[k % 6]} {rare[k % 6]}") for k in range(240)]
    df = spark.createDataFrame([(i, t, 1, 1, 1) for i, t in made], "doc_id long, text string, row long, first long, share long").repartition(6)
    pieces_of = collections.defaultdict(list)
    for r in packing.packed(df, window=256, shard_tokens=1500, with_ids=False).collect():
        pieces_of[r.sequence_id].append((r.offset, r.doc_id))
    kinds = [len({i % 6 for _, i in p}) for p in pieces_of.values()]
    assert sum(kinds) / len(kinds) < 1.5


def simhash_of(t, width):
    words = WORD.findall(lower(t or ""))
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)), frozenset(shingles)


def classes(nodes, linked):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_simhash(docs, rows):
    prints = {i: simhash_of(t, 3)[0] for i, t in rows}
    want = classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    found = simhash.simhash_classes(docs).collect()
    assert all(r.fp & (1 << 64) - 1 == prints[r.doc_id] and r.component_id == want[r.doc_id] for r in found) and len(found) == len(rows)


def test_tiles(spark):
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = fp[:80] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))
    fp = np.unique(np.concatenate([fp, near, near ^ np.uint64(5)]))
    df = spark.createDataFrame([(int(x), int(x), 1) for x in fp.view(np.int64)], "fp long, node long, size long")
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    for radius, parts, tile in ((2, 4, 1 << 15), (2, 1, 7), (5, 2, 11)):
        want = {tuple(sorted((int(a), int(b)))) for a, b in zip(*(fp.view(np.int64)[k] for k in np.nonzero((d <= radius) & (d > 0))))}
        assert {(r.u, r.v) for r in simhash.fingerprint_links(df, radius, parts, tile).collect()} == want


def test_stars(spark):
    """Stars connect what all pairs connect; eight parts find what four do."""
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    hot = fp[0] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))
    near = fp[:80] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))
    fp = np.unique(np.concatenate([fp, near, hot]))
    df = spark.createDataFrame([(int(x), int(x), 1) for x in fp.view(np.int64)], "fp long, node long, size long")
    pairs = [(r.u, r.v) for r in simhash.fingerprint_links(df).collect()]
    linked = set(pairs)
    want = classes(sorted(fp.view(np.int64).tolist()), lambda a, b: (a, b) in linked)
    assert len(pairs) > 60 * 59 / 2
    for parts, tile in ((4, 1 << 15), (8, 1 << 15), (8, 3)):
        stars = {(r.u, r.v) for r in simhash.fingerprint_links(df, parts=parts, tile=tile, stars=True).collect()}
        assert classes(sorted(fp.view(np.int64).tolist()), lambda a, b: (a, b) in stars) == want
    assert len(simhash.fingerprint_links(df, stars=True).collect()) < 400


def test_sharing():
    rng = np.random.default_rng(7)
    for _ in range(20):
        p = np.empty(300, simhash._POSTING)
        p["node"] = np.arange(300)
        p["hash"], p["size"], p["class"] = rng.integers(0, 8, 300), rng.integers(20, 40, 300), np.where(rng.random(300) < 0.6, -7, p["node"])
        want = {(a, b) for a in range(300) for b in range(a + 1, 300) if p["hash"][a] == p["hash"][b] and p["class"][a] != p["class"][b] and min(p["size"][a], p["size"][b]) >= 0.8 * max(p["size"][a], p["size"][b]) - 1e-9}
        got = [tuple(x) for f in simhash.sharing(simhash.several(p), 0.8, most=500) for x in f.T.tolist()]
        assert set(got) == want
        assert {tuple(x) for x in simhash.neighbouring(p, 0.8).T.tolist()} <= want


def test_group_of_near_copies_gives_few_pairs(spark):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(3000)]
    base = [rng.choice(vocab) for _ in range(300)]
    rows = []
    for k in range(300):
        words = list(base)
        words[rng.randrange(300)] = f"w{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(rng.choice(vocab) for _ in range(200))) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_deduplicated(df).collect()} == {0, *range(1000, 1050)}
    nodes = spark.createDataFrame([(k, 100, k, np.arange(20, dtype=np.uint64).tobytes()) for k in range(300)], "node long, size long, class long, prefix binary")
    assert simhash.prefix_links(nodes, 0.8, chains=True).count() == 299
    assert simhash.prefix_links(nodes.selectExpr("node", "size", "0L AS class", "prefix"), 0.8).count() == 0


def test_similar(docs, rows):
    sets = {}
    for i, t in rows:
        sets[i] = simhash_of(t, 5)[1]
    alike = lambda a, b: (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= 0.8
    want = classes(sorted(sets), alike)
    assert {r.doc_id: r.component_id for r in simhash.similar_classes(docs).collect()} == want
    kept = {r.doc_id for r in simhash.near_deduplicated(docs).collect()}
    assert kept == set(want.values())


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(200, k) for k in range(201, 260)]
    want = classes(sorted({x for e in links for x in e}), lambda a, b: (a, b) in links or (b, a) in links)
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    assert all(found.get(n, n) == c for n, c in want.items())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0], r[1] or ""))


def test_passages(docs, rows):
    seen, want = set(), []
    for i, t in ordered(rows):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            key = tuple(words[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        want.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    found = substrings.repeated_passages(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == sorted(want) and any(w[2] for w in want)
    text = dict(rows)
    for r in found:
        if r.doc_id != 511:
            assert sum(len(WORD.findall(text[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_removed


def test_strings(docs, rows):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - 49):
            first[data[k : k + 50]] = min(i, first.get(data[k : k + 50], i))
    want = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        want.append((i, len(data), int(gone.sum()), bytes(np.frombuffer(data, np.uint8)[~gone])))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.repeated_strings(docs).collect()) == sorted(want) and any(w[2] for w in want)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n, letters in ((200, 1), (900, 2), (3000, 3)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        wanted = np.sort(rng.choice(n, n // 2, replace=False))
        got = np.concatenate(list(suffixes.SuffixSorter(text).buckets(wanted))).tolist()
        assert got == sorted(wanted.tolist(), key=lambda k: text.tobytes()[k:])


def good_turing(counts, most=5):
    """Katz's factors of counts 1 to most, worked out from his formulas in plain numbers; smoothed, or absolute, where these give none."""
    n = [sum(c == r for c in counts) for r in range(1, most + 2)]

    def factors(n):
        if not n[0] or not all(n[:-1]):
            return None
        top = (most + 1) * n[most] / n[0]
        if top == 1:
            return None
        out = [((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top) for r in range(1, most + 1)]
        return out if all(0 < d < 1 for d in out) else None

    x, y = [math.log(r) for r in range(1, most + 2)], [math.log(max(v, 0.5)) for v in n]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    smooth = [math.exp(my + slope * (a - mx)) for a in x]
    plain = factors(n)
    if plain is None and n[0]:
        plain = factors(smooth)
    if plain is None:
        share = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        plain = [1 - min(0.9, max(0.1, share)) / r for r in range(1, most + 1)]
    return plain


def katz_by_hand(tokens, out, order):
    """A function P(word, history) by the definition: counters, recursion, no arrays."""
    grams = [collections.Counter() for _ in range(order + 1)]
    histories = [collections.Counter() for _ in range(order + 1)]
    followers = collections.defaultdict(set)
    for i, t in tokens:
        if i not in out:
            padded = ["<s>"] * (order - 1) + t
            for k in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    g = tuple(padded[k - n + 1 : k + 1])
                    grams[n][g] += 1
                    histories[n][g[:-1]] += 1
                    followers[g[:-1]].add(g[-1])
    d = [None] + [good_turing(grams[n].values()) for n in range(1, order + 1)]
    kept = lambda n, c: c * d[n][c - 1] if c <= 5 else c
    total = sum(grams[1].values())
    freed = sum(c - kept(1, c) for c in grams[1].values())
    memo = {}

    def p(w, h):
        n = len(h) + 1
        if n == 1:
            c = grams[1][w,]
            if not c:
                return freed / total if freed > 0 else 1 / (total + 1)
            return kept(1, c) / total * (1 if freed > 0 else total / (total + 1))
        count = histories[n][h]
        if not count:
            return p(w, h[1:])
        if h not in memo:
            free = 1 - sum(kept(n, grams[n][(*h, v)]) for v in followers[h]) / count
            scale = 1 / count
            if free < 1e-12:
                free, scale = 1 / (count + 1), 1 / (count + 1)
            memo[h] = scale, free / (1 - sum(p(v, h[1:]) for v in followers[h]))
        scale, alpha = memo[h]
        c = grams[n][(*h, w)]
        return kept(n, c) * scale if c else alpha * p(w, h[1:])

    return p, grams[1]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(docs, rows, order):
    tokens = [(i, WORD.findall(lower(t or "")) + ["</s>"]) for i, t in rows]
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    p, words = katz_by_hand(tokens, out, order)
    words = collections.Counter({w: c for (w,), c in words.items()})
    n, v = sum(words.values()), len(words)
    pad = ("<s>",) * (order - 1)
    some = [pad, ("one", "two", "three")[: order - 1], ("same",) * (order - 1), *[(*pad, *t)[k : k + order - 1] for i, t in tokens[:4] for k in (0, 1, 5)]]
    for h in some:
        assert math.isclose(sum(p(w, h) for w in words) + p("\0unknown", h), 1, abs_tol=1e-9)

    def score(t):
        padded = [*pad, *t]
        return sum(math.log10(p(padded[k], tuple(padded[k - order + 1 : k]))) for k in range(order - 1, len(padded)))

    want = sorted((i, i in out, len(t), sum(words[w] > 0 for w in t), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), score(t)) for i, t in tokens)
    found = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.katz_scores(docs, order).collect())
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for f, w in zip(found, want) for a, b in zip(f[5:], w[5:]))


def test_good_turing():
    """Where counts of counts are regular, the factors are Katz's; they are always between 0 and 1."""
    n = np.array([5000, 1800, 900, 520, 340, 240])
    counts = [r for r, k in enumerate(n.tolist(), 1) for _ in range(k)]
    assert np.allclose(katz.discounts(n), good_turing(counts)) and math.isclose(katz.discounts(n)[0], (2 * 1800 / 5000 - 6 * 240 / 5000) / (1 - 6 * 240 / 5000))
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(0, 40, 6)
        d = katz.discounts(n)
        assert (d > 0).all() and (d < 1).all() and np.allclose(d, good_turing([r for r, k in enumerate(n.tolist(), 1) for _ in range(k)]))


def test_fingerprints(docs, rows):
    found = fingerprints.edited_fingerprints(docs).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == sorted(want)
    text = dict(rows)
    by = collections.defaultdict(set)
    for r in found:
        by[text[r.doc_id] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by.values())


def test_fingerprint_likeness_is_jaccard(docs, rows):
    """near_edited and near_next against sets of shingles, within the error of 512 bins."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    want = collections.defaultdict(list)

    def jaccard(a, b):
        a, b = simhash_of(a, 5)[1], simhash_of(b, 5)[1]
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        want[i].append((jaccard(t, t[: len(t) - m] + after[:m]), jaccard(t, after)))
    for r in fingerprints.edited_fingerprints(docs).collect():
        assert any(abs(r.near_edited - e) < 0.13 and abs(r.near_next - n) < 0.13 for e, n in want[r.doc_id])
        assert r.fingerprint == "" or len(r.fingerprint) == 512 * 4 // 4


def test_densification_by_hand():
    """Bins of one permutation, and what empty ones borrow, against loops."""
    rng = np.random.default_rng(8)
    for n in (1, 3, 40):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        bins = {}
        for h in hashes.tolist():
            bins[h >> 58] = min(h, bins.get(h >> 58, h))
        order = fingerprints.borrowing_order(64)
        want = [bins[b] if b in bins else bins[min(bins, key=lambda j: order[b][j])] for b in range(64)]
        assert fingerprints.bin_minima(hashes, np.zeros(n, np.int64), 1, 64)[0].tolist() == want


@pytest.mark.parametrize("share", ["null", "one"])
def test_order_with_a_hot_id(spark, share):
    """A third of all rows have no doc_id, or one and the same: they are spread over parts, and the order holds."""
    hot = None if share == "null" else 50
    made = [(k, f"text {k}") for k in range(200)] + [(hot, f"other {k}") for k in range(100)] + [(-(1 << 63), "first"), ((1 << 63) - 1, "last")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in made], "doc_id long, text string, part int, tie long, guest int, place long").repartition(5)
    tie = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        parts = fingerprints.in_order(df).where("guest = 0").selectExpr("part", "doc_id <=> " + ("NULL" if hot is None else "50L") + " AS hot").groupBy("part").agg({"*": "count", "hot": "max"}).collect()
        got = fingerprints.edited_fingerprints(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(parts) >= 10 and max(r["count(1)"] for r in parts) < 60 and sum(r["max(hot)"] for r in parts) >= 3
    order = sorted(made, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = {t: t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3] for k, (_, t) in enumerate(order)}
    assert len(got) == len(made) and sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in want.values())


def test_likeness():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.8, 1.0):
        a, b, c = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (int(2000 * share), int(2000 * (1 - share) / 2), int(2000 * (1 - share) / 2)))
        table = fingerprints.bin_minima(np.concatenate([a, b, a, c]), np.repeat([0, 1], [len(a) + len(b), len(a) + len(c)]), 2, 512)
        codes = (fingerprints.mix(table) & np.uint64(15)).astype(np.uint8)
        assert abs(float(fingerprints.likeness(codes[0], codes[1])) - share) < 0.09


def test_pieces(docs, rows):
    import sentencepiece

    c = pieces.codec(pieces.piece_file())
    normal = [x for _, x, kind in c.pieces if kind == pieces.NORMAL]
    assert math.isclose(sum(map(math.exp, normal)), 1) and min(normal) > -25 and c.unknown == min(normal) - 10
    proto = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_file()).serialized_model_proto()
    at = proto.rfind(b"tok_v0\x18\x02")
    proto = proto[:at] + b"tok_v0\x18\x01" + proto[at + 8 :]  # a unigram model, with the scores that stand for the ranks
    scored, at, i = b"", 0, 0
    while at < len(proto):
        key, to = pieces._varint(proto, at)
        size, to = pieces._varint(proto, to)
        body = proto[to : to + size]
        if key == 10:
            piece, s, kind = c.pieces[i]
            raw = piece.encode()
            body = bytes([10, len(raw)]) + raw + b"\x15" + np.float32(s).tobytes() + bytes([24, kind])
            i += 1
        n, head = len(body), b""
        while n > 127:
            head, n = head + bytes([n & 127 | 128]), n >> 7
        scored += bytes([key]) + head + bytes([n]) + body
        at = to + size
    unigram = sentencepiece.SentencePieceProcessor(model_proto=scored)
    for text in ["the ring of the", "which thing", "é and über", "a b c", "thering singingly unbelievable", *(t for _, t in rows[:15])]:
        if text and "  " not in text and "\n" not in text:
            best = unigram.nbest_encode(text, nbest_size=2)[0]
            assert math.isclose(c.score[c.encode(text)].sum(), c.score[best].sum(), rel_tol=1e-6)
    one = c.encode("漢\U0001f9ff\u2007")
    assert c.unknown * 3 - 30 < c.score[one].sum() < 0
    for t in [t or "" for _, t in rows] + ["  lead", "tail  ", "\t\n", "a\tb\r\nc\u00a0d\u3000e", "漢\U0001f600"]:
        assert c.decode(c.encode(t)) == t
    back = pieces.decoded(pieces.encoded(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t in rows)


def test_viterbi_is_best():
    c = pieces.codec(pieces.piece_file())
    normal = {p: s for p, s, kind in c.pieces if kind == pieces.NORMAL}
    for word in ["▁there", "▁singing", "▁été"]:
        best = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                if word[start:end] in normal:
                    best[end] = max(best[end], best[start] + normal[word[start:end]])
        assert math.isclose(sum(c.scores[i] for i in c.segment(word)), best[-1])


@pytest.fixture(scope="module")
def tagger():
    return pii.trained(windows=1500, steps=150, rows=32)


def test_tagger_gradient():
    t = pii.Tagger(3)
    ids, tags = (x[:, :8] for x in pii.training_windows(3, 1))
    _, grad = t.loss(ids, tags)
    rng = np.random.default_rng(0)
    for name, p in t.p.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = t.loss(ids, tags)[0]
        p[at] = old - 1e-5
        down = t.loss(ids, tags)[0]
        p[at] = old
        assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-6


def test_personal_data(spark, tagger):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    texts = ["", None, "write to a.b@c.example.com, or x@y", "@@a@b.c@d.e f@g..h", "at 1.2.3.4.5 and 300.1.1.1", "card 4111 1111 1111 1111!", "+1 (017) 555-7713 and +123", "nothing here", "x" * 5000 + " a@b.co " + "y" * 5000]
    for t in texts:
        assert [(a, b) for k, a, b in pii.base_spans(t or "") if k == "email"] == [m.span() for m in email.finditer(t or "")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.personal_data(df, tagger).collect()}
    assert [(found[k].n_email, found[k].n_ip, found[k].n_card, found[k].n_phone) for k in range(len(texts))] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0), (1, 0, 0, 0)]
    assert found[7].spans == "" and found[5].spans == "card:5:24" and found[5].base_sha256 == hashlib.sha256(b"card:5:24").hexdigest()
    assert {r.doc_id: r.text for r in pii.masked(df, tagger).collect()}[5] == "card [CARD]!"


def test_personal_data_odd_rows(spark, tagger):
    """Digit runs of any length, null ids, repeats, an empty table and clashing names."""
    texts = ["0" * 5000 + ".1.1.1", "9" * 40000, "1." * 5000, "+1" * 3000, "a@b.co" * 500, None, "", "call +49 (030) 123-4567", "call +49 (030) 123-4567"]
    df = spark.createDataFrame([(None if k == 0 else k // 2, t, 5, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, n_email long, spans string, n_chars long").coalesce(1)
    found = pii.personal_data(df, tagger).collect()
    ip, card, phone = (re.compile(p) for p in (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits_of = lambda t: "".join(c for c in t if "0" <= c <= "9")

    def check_digit(n):
        return sum(x if k % 2 == 0 else (2 * x) % 10 + 2 * x // 10 for k, x in enumerate(map(int, reversed(n)))) % 10 == 0

    for r, t in zip(found, texts):
        t = t or ""
        want = [("ip", *m.span()) for m in ip.finditer(t) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m.group().split("."))] if len(t) < 20000 else []
        want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits_of(m.group())) <= 19 and check_digit(digits_of(m.group()))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits_of(m.group())) <= 15]
        assert (r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in want) for k in ("ip", "card", "phone"))
        if not r.n_email:
            assert r.base_sha256 == hashlib.sha256(",".join(":".join(map(str, x)) for x in want).encode()).hexdigest()
    assert [r.doc_id for r in found] == [None, 0, 1, 1, 2, 2, 3, 3, 4] and found[7].spans == found[8].spans == "phone:5:23"
    kept = pii.masked(df, tagger)
    assert kept.columns == df.columns and [r.text for r in kept.collect()][5:] == [None, "", "call [PHONE]", "call [PHONE]"]
    assert pii.masked(df.limit(0), tagger).count() == pii.personal_data(df.limit(0), tagger).count() == 0


def test_patterns_against_regular_expressions():
    """Base spans of random strings against the plain expressions."""
    rng = random.Random(21)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    hits = collections.Counter()
    for k in range(20000):
        t = "".join(rng.choice(("aB.@-+ 0123456789()_é", "4111222533367-", "10.25.7 ", "+123 (4)-")[k % 4]) for _ in range(rng.randint(0, 40)))
        want = []
        for kind, p in plain.items():
            for m in re.finditer(p, t):
                d = "".join(c for c in m.group() if c.isdigit())
                ok = kind == "email" or kind == "ip" and all(int(x) < 256 for x in m.group().split(".")) or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15
                if ok:
                    want.append((kind, *m.span()))
                    hits[kind] += 1
        assert pii.base_spans(t) == want
    assert min(hits[k] for k in plain) > 10


def test_toxicity(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("bdfgklmnprstvaeiou") for _ in range(6)) for _ in range(400)]
    made = []
    for k in range(500):
        t = [rng.choice(words) for _ in range(40)]
        if k % 5 == 0:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), "zorgu" + rng.choice(["ta", "len", "mi", ""]))
        made.append((" ".join(t), k % 5 == 0))
    model = toxicity.fit([t for t, _ in made[:400]], np.array([y for _, y in made[:400]]))
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)] + [(1000, None), (1001, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.scores(df, model).collect()}
    assert all(found[k].predicted == int(y) for k, (_, y) in enumerate(made)) and found[1000].predicted == found[1001].predicted == 0
    assert found[3].held_out == (zlib.crc32(b"3") % 5 == 0) and toxicity.without_toxic(df, model).count() == 402


def test_grammar():
    from llm.common import blocks
    import pyarrow as pa

    model = toxicity.fit([], np.zeros(0))
    weigh = lambda t: float(np.concatenate([model.clauses(b, toxicity.grammar()) for b in blocks(toxicity.lowered(pa.array([t])))])[0])
    assert weigh("you idiot") > weigh("an idiot") > weigh('they said "idiot"') > 0
    assert weigh("he is not an idiot") < weigh("he is an idiot") and weigh("never. idiot") == weigh("idiot")
    assert weigh("i will kill you") > weigh("kill time") and weigh("a fine day") == 0


def test_grammar_by_hand():
    """The composed machine against rules written out word by word."""
    t = toxicity
    rng = random.Random(14)
    machine = t.grammar()
    weights = [0.5, 0.1, 0.1, 0.15, 0.1, 0.08, 0.1, 0.1]
    seen = set()
    for _ in range(3000):
        symbols = rng.choices(range(t.CLASSES), weights, k=rng.randint(0, 25))

        def within(k, trigger, reach, step):
            at, words = k + step, 0
            while 0 <= at < len(symbols) and symbols[at] != t.STOP and words < reach:
                if symbols[at] == trigger:
                    return True
                words += symbols[at] != t.QUOTE
                at += step
            return False

        want = []
        for k, s in enumerate(symbols):
            if s in (t.INSULT, t.THREAT):
                f = 1.5 if s == t.INSULT and within(k, t.TARGET, 4, -1) else 0.5 if s == t.THREAT and not within(k, t.TARGET, 4, -1) else 1.0
                f *= 0.2 if within(k, t.NEGATION, 3, -1) else 1
                f *= 0.4 if within(k, t.REPORT, 6, -1) else 1
                f *= 0.4 if symbols[:k].count(t.QUOTE) % 2 else 1
                f *= 1.25 if within(k, t.TARGET, 2, 1) else 1
                want.append(f)
                seen.add(round(f, 6))
        assert np.allclose(machine.weigh(symbols), want)
    assert len(seen) > 20
    single = [t.insults(), t.threats(), t.negations(), t.reports(), t.targets()]
    assert all(len(m.step) > 1 and (m.factor != 1).any() for m in single) and len({m.step.tobytes() + m.factor.tobytes() for m in single}) == 5


def test_scores_whole_documents(spark):
    """Scores against a scorer that reads one word after another, with nulls, repeats, an empty table and clashing names."""
    model = toxicity.fit([], np.zeros(0))
    texts = ["you idiot!", 'she said "you idiot" and left', "I will KILL you; not you, idiot", None, "", "no idiots here. moron", "x " * 20000 + "you stupid loser", "you idiot!"]
    word, ends = re.compile(r"[A-Za-z\u0080-\U0010ffff]+|[\n!.?;]|\""), set("\n!.?;")
    classes_of = {w: c for c, ws in toxicity.WORDS.items() for w in ws.split()} | dict.fromkeys(toxicity.INSULTS.split(), toxicity.INSULT)
    want = []
    for t in texts:
        read = [toxicity.STOP if w in ends else toxicity.QUOTE if w == '"' else classes_of.get(w, 0) for w in word.findall((t or "").lower())]
        want.append(sum(toxicity.grammar().weigh(read)))
    schema = "doc_id long, text string, score double, clauses long, toxic long, held_out string"
    df = spark.createDataFrame([(None if k == 1 else k // 2, t, 0.5, 1, 1, "") for k, t in enumerate(texts)], schema)
    found = toxicity.scores(df.coalesce(1), model).collect()
    assert np.allclose([r.clauses for r in found], want) and want[0] > 0 and want[3] == want[4] == 0
    assert [r.held_out for r in found] == [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in found]
    kept = toxicity.without_toxic(df.coalesce(1), model)
    assert kept.columns == df.columns and [r.text for r in kept.collect()] == [t for t, r in zip(texts, found) if not r.predicted]
    assert toxicity.scores(df.limit(0), model).count() == 0 and toxicity.without_toxic(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([(k // 2, int(k % 3 == 0)) for k in range(8)] + [(None, 1), (3, None)], "doc_id long, toxic long")
    for some in (df, df.limit(0)):
        toxicity.trained(some, labels), toxicity.trained(some, labels.limit(0)), toxicity.trained(some, labels, sample_bytes=15)


def test_registered():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
