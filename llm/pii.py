"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The network is trained in numpy from labelled spans of generated sentences (training_windows), with a fixed seed. A
span of any of the four kinds holds a digit, an at sign or a spelled-out one, so only stretches around these triggers
and spelled-out dots are tagged, out to the ends of an address's words: each stretch is cut into overlapping windows, the tags' scores of windows that overlap are averaged with
weights that fall towards a window's edges, and one Viterbi pass over the whole stretch reconciles them. A tagged span
is added where it touches no pattern span and stands up to its kind's rules (parts of an address, digits and check
digit of a card, digits of a number).

Defined results: null or empty text has no spans; null doc_ids and repeated rows are searched like any other; texts of
any length are searched whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
_EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Digits are taken whole: a match can't begin inside a run, and long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s?(?:at|AT|dot|DOT)\s?[)\]}]")
_AT = re.compile(r"[(\[{]\s?(?:at|AT)\s?[)\]}]")
_HOST = re.compile(r"\s?[\w-]+(?:\.[\w-]+|\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?[\w-]+)+")
WINDOW, STRIDE, MARGIN = 64, 40, 20


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(number)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _ip_parts(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def base_spans(text: str) -> list[Span]:
    """Pattern spans, by kind as listed, then by start; leftmost and without overlap in each kind."""
    out: list[Span] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_LEFT:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text) is None:
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_parts(m.group())]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


# --- the network

_SYMBOLS = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz@.-+()/:,#\"'_%*[]{}=$&!?|;", 4)}
OTHER, SPACE, FOREIGN, NUMBER = 0, 1, 2, 3
_TABLE = np.zeros(128, np.int64)
for _c in range(128):
    _ch = chr(_c)
    _TABLE[_c] = NUMBER if _ch.isdigit() else SPACE if _ch.isspace() else _SYMBOLS.get(_ch.lower(), OTHER)
SYMBOLS = 4 + len(_SYMBOLS)
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
EMBED, HIDDEN = 10, 16


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], FOREIGN)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Embedding, LSTM in both directions, linear scores of the tags, CRF transitions (with scores to begin and end with)."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        t = len(TAGS)
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "out": scale(2 * HIDDEN, t), "out_b": np.zeros(t), "trans": np.zeros((t, t)), "begin": np.zeros(t), "end": np.zeros(t)}
        for d in "fb":
            self.p |= {f"{d}_x": scale(EMBED, 4 * HIDDEN), f"{d}_h": scale(HIDDEN, 4 * HIDDEN), f"{d}_b": np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])}

    def _lstm(self, x: np.ndarray, d: str, keep: bool = False):
        """x: steps, rows, EMBED -> hidden states; gates forget, input, output, candidate."""
        w, b = self.p[f"{d}_h"], self.p[f"{d}_b"]
        into = x @ self.p[f"{d}_x"] + b
        steps, rows = x.shape[:2]
        h = c = np.zeros((rows, HIDDEN))
        out, kept = np.empty((steps, rows, HIDDEN)), []
        for t in range(steps):
            z = into[t] + h @ w
            g = _sigmoid(z[:, : 3 * HIDDEN])
            a = np.tanh(z[:, 3 * HIDDEN :])
            f, i, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            before = c
            c = f * c + i * a
            s = np.tanh(c)
            if keep:
                kept.append((h, before, f, i, o, a, s))
            h = o * s
            out[t] = h
        return out, kept

    def _lstm_back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        w, wx = self.p[f"{d}_h"], self.p[f"{d}_x"]
        dz_all = np.empty((*x.shape[:2], 4 * HIDDEN))
        dh = dc = np.zeros(dout.shape[1:])
        dw = np.zeros_like(w)
        for t in range(len(kept) - 1, -1, -1):
            h, before, f, i, o, a, s = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * before * f * (1 - f), dc * a * i * (1 - i), dh * s * o * (1 - o), dc * i * (1 - a * a)], 1)
            dw += h.T @ dz
            dz_all[t] = dz
            dh, dc = dz @ w.T, dc * f
        grad[f"{d}_h"] = dw
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad[f"{d}_x"] = x.reshape(-1, EMBED).T @ flat
        grad[f"{d}_b"] = flat.sum(0)
        return dz_all @ wx.T

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids: rows, steps -> scores of the tags: rows, steps, tags."""
        x = self.p["embed"][ids].transpose(1, 0, 2)
        f, _ = self._lstm(x, "f")
        b, _ = self._lstm(x[::-1], "b")
        return (np.concatenate([f, b[::-1]], 2) @ self.p["out"] + self.p["out_b"]).transpose(1, 0, 2)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        p = self.p
        n, steps = ids.shape
        x = p["embed"][ids].transpose(1, 0, 2)
        f, kf = self._lstm(x, "f", True)
        b, kb = self._lstm(x[::-1], "b", True)
        hidden = np.concatenate([f, b[::-1]], 2)
        e = hidden @ p["out"] + p["out_b"]
        rows = np.arange(n)

        def total(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis)
            return top + np.log(np.exp(v - np.expand_dims(top, axis)).sum(axis))

        forward = np.empty_like(e)
        forward[0] = p["begin"] + e[0]
        for t in range(1, steps):
            forward[t] = total(forward[t - 1][:, :, None] + p["trans"], 1) + e[t]
        z = total(forward[-1] + p["end"], 1)
        backward = np.empty_like(e)
        backward[-1] = p["end"]
        for t in range(steps - 2, -1, -1):
            backward[t] = total(p["trans"] + (e[t + 1] + backward[t + 1])[:, None, :], 2)
        y = tags.T
        gold = p["begin"][y[0]] + p["end"][y[-1]] + sum(e[t, rows, y[t]] for t in range(steps)) + sum(p["trans"][y[t], y[t + 1]] for t in range(steps - 1))
        de = np.exp(forward + backward - z[:, None])
        grad = {"begin": de[0].sum(0), "end": de[-1].sum(0), "trans": np.zeros_like(p["trans"])}
        np.add.at(grad["begin"], y[0], -1)
        np.add.at(grad["end"], y[-1], -1)
        for t in range(steps - 1):
            grad["trans"] += np.exp(forward[t][:, :, None] + p["trans"] + (e[t + 1] + backward[t + 1])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(grad["trans"], (y[:-1].ravel(), y[1:].ravel()), -1)
        de[np.arange(steps)[:, None], rows[None, :], y] -= 1
        flat = de.reshape(-1, len(TAGS))
        grad["out"], grad["out_b"] = hidden.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
        dh = de @ p["out"].T
        dx = self._lstm_back(x, "f", kf, dh[:, :, :HIDDEN], grad)
        dx = dx + self._lstm_back(x[::-1], "b", kb, dh[::-1, :, HIDDEN:], grad)[::-1]
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], ids.T, dx)
        return float((z - gold).mean()), {k: v / n for k, v in grad.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int, rows: int, seed: int = 5, rate: float = 0.01) -> float:
        """Adam over random batches; the last loss."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        value = 0.0
        for step in range(1, steps + 1):
            at = rng.integers(0, len(ids), rows)
            value, grad = self.loss(ids[at], tags[at])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= now * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return value

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags of one stretch: steps, tags -> steps. An inside tag never follows another kind."""
        trans = self.p["trans"] + _FORBIDDEN
        score = self.p["begin"] + e[0] + _NO_START
        back = np.empty(e.shape, np.int64)
        for t in range(1, len(e)):
            all_ = score[:, None] + trans
            back[t] = all_.argmax(0)
            score = all_.max(0) + e[t]
        tag = int((score + self.p["end"]).argmax())
        out = [tag]
        for t in range(len(e) - 1, 0, -1):
            tag = int(back[t, tag])
            out.append(tag)
        return np.array(out[::-1])


_FORBIDDEN = np.zeros((len(TAGS), len(TAGS)))
_NO_START = np.zeros(len(TAGS))
for _j, _to in enumerate(TAGS):
    if _to[0] == "I":
        _NO_START[_j] = -1e6
        for _i, _from in enumerate(TAGS):
            if _from[1:] != _to[1:]:
                _FORBIDDEN[_i, _j] = -1e6


# --- labelled spans to train on

def _word(rng) -> str:
    w = "".join(rng.choice(["th", "er", "on", "an", "re", "ing", "de", "la", "ch", "en", "ment", "ge", "ión", "ñ", "é", "ö", "ei", "os", "ta", "qu", "st"]) for _ in range(rng.integers(1, 5)))
    return w.capitalize() if rng.random() < 0.15 else w


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _item(rng) -> tuple[str, str | None]:
    """A piece of personal data and its kind, or something that only looks like it."""
    kind = rng.integers(0, 14)
    if kind < 2:
        user = _word(rng).lower() + rng.choice(["", ".", "_", "-"]) + rng.choice([_word(rng).lower(), _number(rng, 2)])
        host = f"{_word(rng).lower()}{rng.choice(['', _number(rng, 1)])}.{rng.choice(['example', _word(rng).lower()])}.{rng.choice(['com', 'org', 'de', 'fr', 'es', 'net'])}"
        if rng.random() < 0.3:
            a, d = rng.choice(["(at)", "[at]", "{at}"]), rng.choice(["(dot)", "[dot]", "."])
            space = rng.choice(["", " "]) if d != "." else ""
            return user + rng.choice(["", " "]) + a + rng.choice(["", " "]) + host.replace(".", space + d + space), "email"
        return f"{user}@{host}", "email"
    if kind < 4:
        return ".".join(str(x) for x in rng.integers(0, 256, 4)), "ip"
    if kind < 6:
        head = _number(rng, int(rng.choice([15, 15, 15, 18])))
        number = next(head + str(d) for d in range(10) if luhn(head + str(d)))
        mark = rng.choice(["", " ", "-"])
        return mark.join(number[k : k + 4] for k in range(0, len(number), 4)), "card"
    if kind < 9:
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        return str(rng.choice([f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.integers(1, 99)}-{a}-{b}-{c}", f"+{rng.integers(1, 99)}{a}{b}{c}"])), "phone"
    day, month, year = rng.integers(1, 29), rng.integers(1, 13), rng.integers(1900, 2030)
    return str(rng.choice([
        str(year), f"{year}-{month:02d}-{day:02d}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{rng.integers(0, 24)}:{rng.integers(0, 60):02d}", f"{rng.integers(1, 900)}.{_number(rng, 2)}",
        f"{rng.integers(0, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", _number(rng, int(rng.integers(1, 8))), f"{rng.integers(1, 100)}%", f"#{_number(rng, 4)}",
        'token = "' + "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(24, 41)))) + '"', _number(rng, int(rng.integers(20, 30))), f"@{_word(rng)}", f"{_number(rng, 2)},{_number(rng, 3)}",
    ])), None


def training_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of generated windows of text with labelled spans."""
    rng = np.random.default_rng(seed)
    ids, tags = np.full((n, WINDOW), SPACE), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        text, labels = "", []
        while len(text) < WINDOW + 40:
            text += " ".join(_word(rng) for _ in range(rng.integers(1, 6))) + str(rng.choice([" ", " ", " ", ". ", "\n", " | ", ", "]))
            what, kind = _item(rng)
            if kind:
                labels.append((kind, len(text), len(text) + len(what)))
            text += what + str(rng.choice([" ", " ", " ", ", ", ". ", "!! ", "*** ", "### ", "\n", "$$$ "]))
        at = int(rng.integers(0, len(text) - WINDOW))
        ids[row] = symbols(text[at : at + WINDOW])
        for kind, a, b in labels:
            if a >= at and b <= at + WINDOW:
                k = 1 + 2 * KINDS.index(kind)
                tags[row, a - at : b - at] = k + 1
                tags[row, a - at] = k
            else:  # cut by the window: inside tags alone
                a, b = max(a, at), min(b, at + WINDOW)
                if a < b:
                    k = 1 + 2 * KINDS.index(kind)
                    tags[row, a - at : b - at] = k + 1
                    if a > at:
                        tags[row, a - at] = k
    return ids, tags


@lru_cache(maxsize=2)
def trained(windows: int = 3000, steps: int = 350, rows: int = 48, seed: int = 11) -> Tagger:
    """The tagger after its training, always the same for the same arguments."""
    tagger = Tagger(seed)
    tagger.train(*training_windows(windows, seed), steps, rows)
    return tagger


# --- spans that the network adds

def stretches(text: str) -> list[tuple[int, int]]:
    """What lies around triggers, with MARGIN code points on either side, and at the signs of an address the whole words there."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        done = out[-1][1] if out else -1
        lo, hi = max(0, m.start() - MARGIN), max(done, min(len(text), m.end() + MARGIN))
        if not m.group().isdigit():
            while lo > max(0, done) and not text[lo - 1].isspace():
                lo -= 1
            while 0 < hi < len(text) and not text[hi].isspace() and not text[hi - 1].isspace():
                hi += 1
        if out and lo <= done:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


_FADE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)


def tagged(tagger: Tagger, texts: list[str], rows: int = 512) -> list[np.ndarray]:
    """The tags of each stretch: windows in batches, then averaged scores and one Viterbi pass."""
    places = [(s, at) for s, text in enumerate(texts) for at in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)]
    coded = [symbols(t) for t in texts]
    total = [np.zeros((len(t), len(TAGS))) for t in texts]
    weight = [np.zeros((len(t), 1)) for t in texts]
    for lo in range(0, len(places), rows):
        part = places[lo : lo + rows]
        ids = np.full((len(part), WINDOW), SPACE)
        for k, (s, at) in enumerate(part):
            piece = coded[s][at : at + WINDOW]
            ids[k, : len(piece)] = piece
        for (s, at), e in zip(part, tagger.emissions(ids)):
            n = min(WINDOW, len(coded[s]) - at)
            if n > 0:
                total[s][at : at + n] += e[:n] * _FADE[:n, None]
                weight[s][at : at + n] += _FADE[:n, None]
    return [tagger.viterbi(t / w) if len(t) else np.zeros(0, np.int64) for t, w in zip(total, weight)]


def plausible(kind: str, text: str) -> bool:
    number = digits(text)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+\s?(?:@|[(\[{]\s?(?:at|AT)\s?[)\]}])\s?[^\s@]+(?:\s?(?:\.|[(\[{]\s?(?:dot|DOT)\s?[)\]}])\s?[^\s@.]+)+", text) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text) is not None and _ip_parts(text)
    if kind == "card":
        return 16 <= len(number) <= 19 and luhn(number) and re.fullmatch(r"[0-9 -]+", text) is not None
    return 8 <= len(number) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", text) is not None and any(c in text for c in " -()")


def address(text: str, start: int, end: int) -> tuple[int, int]:
    """Of a tagged span that holds a spelled-out at sign, the whole address around it: the network says where one is, its parts how far it goes."""
    sign = _AT.search(text, start, end)
    host = _HOST.match(text, sign.end()) if sign else None
    if not host:
        return start, end
    last = sign.start() - (sign.start() > 0 and text[sign.start() - 1].isspace())
    lo = last
    while lo > 0 and (text[lo - 1] in _EMAIL_LEFT or lo > start and not text[lo - 1].isspace() and text[lo - 1] != "@"):
        lo -= 1
    return (lo, host.end()) if lo < last else (start, end)


def spans_of(tags: np.ndarray, text: str) -> list[Span]:
    out = []
    t = 0
    while t < len(tags):
        if tags[t] and TAGS[tags[t]][0] == "B":
            kind, end = TAGS[tags[t]][2:], t + 1
            while end < len(tags) and TAGS[tags[end]] == f"I-{kind}":
                end += 1
            start = t
            while start < end and text[start].isspace():
                start += 1
            stop = end
            while stop > start and (text[stop - 1].isspace() or text[stop - 1] in ".,;!*#$&%|"):
                stop -= 1
            if start < stop:
                out.append((kind, start, stop))
            t = end
        else:
            t += 1
    return out


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans and added ones of each text."""
    base = [base_spans(t) for t in texts]
    where = [(k, a, b) for k, t in enumerate(texts) for a, b in stretches(t)]
    added: list[list[Span]] = [[] for _ in texts]
    for (k, a, b), tags in zip(where, tagged(tagger, [texts[k][a:b] for k, a, b in where])):
        for kind, s, e in spans_of(tags, texts[k][a:b]):
            start, end = a + s, a + e
            if kind == "email":
                start, end = address(texts[k], start, end)
            # whole numbers only, and nothing that a pattern has found already
            cut = start and texts[k][start - 1].isdigit() or end < len(texts[k]) and texts[k][end].isdigit()
            if not cut and plausible(kind, texts[k][start:end]) and all(end <= x or y <= start for _, x, y in base[k]) and (kind, start, end) not in added[k]:
                added[k].append((kind, start, end))
    return list(zip(base, added))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the number of pattern spans of each kind, of added spans, a digest of the former, and all spans as text."""
    tagger = tagger or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                batch = whole.slice(at, 512)
                found = all_spans([t or "" for t in batch.column(1).to_pylist()], tagger)
                counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array([len(a) for _, a in found], pa.int64()),
                    pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([_joined(base + added) for base, added in found], pa.string()),
                ], names=[x.split()[0] for x in _FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FOUND)


def masked(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in brackets, and n_chars, where it is there, brought up to date."""
    tagger = tagger or trained()

    def cover(text: str, spans: list[Span]) -> str:
        out, done = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                batch = whole.slice(at, 512)
                column = batch.schema.get_field_index("text")
                texts = batch.column(column).to_pylist()
                new = [t if t is None or not (base or added) else cover(t, base + added) for t, (base, added) in zip(texts, all_spans([t or "" for t in texts], tagger))]
                arrays = list(batch.columns)
                arrays[column] = pa.array(new, batch.schema.field(column).type)
                size = batch.schema.get_field_index("n_chars")
                if size >= 0:
                    old = batch.column(size).to_pylist()
                    arrays[size] = pa.array([o if n == t else len(n) for o, t, n in zip(old, texts, new)], batch.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
