"""PII by a character-level bidirectional LSTM with CRF transitions, in numpy.

Characters are read as themselves where ASCII or a letter of Latin-1 (as German, Spanish and French have them), and as
one letter otherwise. Two LSTM layers of HIDDEN units, with clipped linear gates, read a window from either side; a linear layer scores the tags of every character, and learned transitions between tags score
their sequence. Training maximises the conditional likelihood of labelled spans by Adam; decoding is Viterbi's.

The labelled spans come from the trainer's own generator: personal data in many formats, and look-alikes that are none
(dates, versions, amounts, hashes, other numbers), are put between the words of at most BACKGROUND documents of the
corpus, the first by the hash of their id. What in these already looks like personal data is masked out first.

Texts are cut into windows of WINDOW characters that overlap by OVERLAP, windows of equal length are decoded together,
and every character takes its tag from the window in which it lies farthest from an end that is not the text's; runs of
a tag are then joined over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm import tokens as tk

TAGS = ("O", "EMAIL", "PHONE", "IP", "CARD")
HIDDEN, WINDOW, OVERLAP, BACKGROUND = 12, 512, 64, 400
STEPS, BATCH, LENGTH = 700, 96, 96
#: ASCII, any other character, the letters of Latin-1.
VOCABULARY = 128 + 1 + 64
#: What a span of a kind can't be without: so many digits, dots and at signs; spans without them are noise.
NEEDS = {"EMAIL": (0, 1, 1), "PHONE": (7, 0, 0), "IP": (4, 3, 0), "CARD": (12, 0, 0)}
_K = len(TAGS)
_LOOKS = re.compile(r"[^\s|]*@[^\s|]*|\+?\d[\d ().:/-]{5,}\d")


@dataclass
class Model:
    """Input rows and recurrent weights of either direction (gates i, f, o, g), output layer and CRF."""

    wx: list[np.ndarray]
    u: list[np.ndarray]
    wo: np.ndarray
    bo: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.wx, *self.u, self.wo, self.bo, self.trans, self.start]


def new_model(seed: int = 0, h: int = HIDDEN) -> Model:
    rng = np.random.default_rng(seed)

    def w(*s: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(s) * scale).astype(np.float32)

    wx = [w(VOCABULARY, 4 * h, scale=0.1) for _ in range(2)]
    for x in wx:
        x[:, : 3 * h] += 0.5
        x[:, h : 2 * h] += 0.2
        x[:, 3 * h :] *= 3
    bo = np.zeros(_K, np.float32)
    bo[0] = 2
    return Model(wx, [w(h, 4 * h, scale=0.15) for _ in range(2)], w(2 * h, _K, scale=0.3), bo, w(_K, _K, scale=0.1), np.zeros(_K, np.float32))


def _direction(x: np.ndarray, wx: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """States (T, N, H) of a recurrent layer over x (T, N), and what training needs of each step."""
    h_n = u.shape[0]
    h = c = np.zeros((x.shape[1], h_n), u.dtype)
    states, kept = np.empty((*x.shape, h_n), u.dtype), []
    for t in range(len(x)):
        z = wx[x[t]] + h @ u
        s, g = np.clip(z[:, : 3 * h_n], 0, 1), np.clip(z[:, 3 * h_n :], -1, 1)
        i, f, o = s[:, :h_n], s[:, h_n : 2 * h_n], s[:, 2 * h_n :]
        before, last = c, h
        c = f * c + i * g
        tc = np.clip(c, -1, 1)
        h = o * tc
        states[t] = h
        kept.append((i, f, o, g, before, tc, last))
    return states, kept


def _direction_back(x: np.ndarray, u: np.ndarray, kept: list[tuple[np.ndarray, ...]], ds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of input rows and recurrent weights, given those of the states."""
    h_n = u.shape[0]
    du, dz_all = np.zeros_like(u), np.empty((*x.shape, 4 * h_n), u.dtype)
    dh_next, dc = np.zeros_like(ds[0]), np.zeros_like(ds[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, before, tc, last = kept[t]
        dh = ds[t] + dh_next
        dc = dc + dh * o * (np.abs(tc) < 1)
        dz = dz_all[t]
        dz[:, :h_n], dz[:, h_n : 2 * h_n] = dc * g * (i > 0) * (i < 1), dc * before * (f > 0) * (f < 1)
        dz[:, 2 * h_n : 3 * h_n], dz[:, 3 * h_n :] = dh * tc * (o > 0) * (o < 1), dc * i * (np.abs(g) < 1)
        du += last.T @ dz
        dh_next, dc = dz @ u.T, dc * f
    one = np.zeros((VOCABULARY, x.size), u.dtype)
    one[x.ravel(), np.arange(x.size)] = 1
    return one @ dz_all.reshape(-1, 4 * h_n), du


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def loss_and_gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tags y (T, N) of the characters x (T, N), and its gradients."""
    (fwd, fk), (bwd, bk) = _direction(x, m.wx[0], m.u[0]), _direction(x[::-1], m.wx[1], m.u[1])
    p = np.concatenate([fwd, bwd[::-1]], axis=2)
    e = p @ m.wo + m.bo
    t_n, n = x.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + m.start
    for t in range(1, t_n):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + m.trans, 1)
    for t in range(t_n - 2, -1, -1):
        beta[t] = _logsum(m.trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    gold = e[np.arange(t_n)[:, None], np.arange(n), y].sum(axis=0) + m.start[y[0]] + m.trans[y[:-1], y[1:]].sum(axis=0)
    scale = 1 / (n * t_n)
    de = np.exp(alpha + beta - z[:, None])
    pair = np.exp(alpha[:-1, :, :, None] + m.trans + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum(axis=(0, 1))
    np.add.at(pair, (y[:-1].ravel(), y[1:].ravel()), -1)
    de[np.arange(t_n)[:, None], np.arange(n), y] -= 1
    dstart = de[0].sum(axis=0) * scale
    de *= scale
    flat, h = de.reshape(-1, _K), m.u[0].shape[0]
    dp = de @ m.wo.T
    gx0, gu0 = _direction_back(x, m.u[0], fk, dp[:, :, :h])
    gx1, gu1 = _direction_back(x[::-1], m.u[1], bk, dp[::-1, :, h:])
    return float((z - gold).sum() * scale), [gx0, gx1, gu0, gu1, p.reshape(-1, 2 * h).T @ flat, flat.sum(axis=0), pair * scale, dstart]


def codes(text: np.ndarray) -> np.ndarray:
    """Numbers of the characters of UTF-8 bytes: ASCII as it is, letters of Latin-1 from 129 on, 128 for any other."""
    at = np.flatnonzero((text & 0xC0) != 0x80)
    lead = text[at]
    out = np.minimum(lead, 128).astype(np.uint8)
    latin = np.flatnonzero((lead == 0xC3) & (at + 1 < len(text)))
    out[latin] = 129 + (text[at[latin] + 1] & 0x3F)
    return out


def code_of(char: str) -> int:
    return min(ord(char), 128) if not 0xC0 <= ord(char) <= 0xFF else 129 + ord(char) - 0xC0


class Generator:
    """Labelled examples: lines of background words with personal data and look-alikes put in."""

    def __init__(self, words: list[str], seed: int) -> None:
        self.words, self.rng = words or ["text"], np.random.default_rng(seed)

    def _n(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high))

    def _digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def _pick(self, *options: str) -> str:
        return options[self._n(0, len(options))]

    def word(self) -> str:
        return self.words[self._n(0, len(self.words))]

    def name(self) -> str:
        w = re.sub(r"\W", "", self.word()).lower()[:10]
        return w or "ann"

    def email(self) -> str:
        local = self._pick(self.name(), f"{self.name()}.{self._digits(self._n(1, 4))}", f"{self.name()}.{self.name()}", f"{self.name()}_{self._digits(2)}", f"{self.name()[:1]}.{self.name()}", f"{self.name()}+{self.name()}", f"{self.name()}-{self.name()}{self._digits(2)}")
        host = self._pick(self.name(), f"mail{self._n(0, 30)}", f"{self.name()}-{self.name()}", "mail")
        return f"{local}@{host}" + self._pick(".com", ".org", ".net", ".example.com", ".example.org", ".de", ".fr", ".es", ".co.uk", ".io")

    def phone(self) -> str:
        d = self._digits
        return self._pick(f"+1 ({d(3)}) 555-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{self._n(1, 99)} {d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+{self._n(20, 99)} {self._n(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)} {d(7)}")

    def ip(self) -> str:
        return ".".join(str(self._n(0, 256)) for _ in range(4))

    def card(self) -> str:
        d = self._digits
        return self._pick(d(16), d(16), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", d(15))

    def lookalike(self) -> str:
        d, n = self._digits, self._n
        hexa = "".join(self._pick(*"0123456789abcdef") for _ in range(self._pick("8", "12", "32", "40", "40") and n(8, 41)))
        return self._pick(
            f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)}", f"{n(0, 24)}:{d(2)}:{d(2)}", f"{n(0, 9)}.{n(0, 20)}.{n(0, 20)}", f"v{n(0, 9)}.{n(0, 9)}", f"{n(0, 10)}.0", d(n(1, 7)), d(n(1, 7)), f"{n(1, 999)},{d(3)}",
            f"{n(1, 999)}.{d(2)}", f"${n(1, 999)}.{d(2)}", f'token = "{hexa}"', f'"{hexa.upper()}"', hexa, f"@{self.name()}", f"{self.name()} @ {n(1, 9)}", f"#{d(n(2, 6))}", f"({n(1, 99)})", f"+{n(1, 9)}", f"{n(1, 99)}%", f"{self.word()}###", f"| {self.word()} |", f"{self.word()}!!", f"{self.word()}&&&", f"{d(3)}-{d(2)}", f"{self.name()}.{self.name()}/{d(3)}", d(n(20, 27)),
        )

    def example(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tags, each ``length`` long."""
        text, tags = "", []
        shout = self.rng.random() < 0.08
        while len(text) < length + 40:
            r = self.rng.random()
            tag = 0
            if r < 0.14:
                tag = self._n(1, _K)
                piece = (self.email, self.phone, self.ip, self.card)[tag - 1]()
            elif r < 0.27:
                piece = self.lookalike()
            else:
                piece = self.word()
            if shout:
                piece = piece.upper()
            # a mark before or after is no part of it
            after = self._pick(" ", " ", " ", " ", " ", " ", ". ", ", ", "\n", " | ", "!! ", "### ", ") ", '" ', "; ", "*** ", "%%% ", "$$$ ")
            before = self._pick(*[""] * 12, "(", '"', "<", ":") if tag else ""
            text += before + piece + after
            tags += [0] * len(before) + [tag] * len(piece) + [0] * len(after)
        at = self._n(0, 40)
        raw = np.array([code_of(c) for c in text[at : at + length]], np.uint8)
        return raw, np.array(tags[at : at + length], np.int64)


def train(texts: list[str], steps: int = STEPS, seed: int = 0) -> Model:
    """Fits the model to examples made over the given background texts."""
    words = [w for t in texts for w in _LOOKS.sub(" ", t).split()]
    made, m = Generator(words, seed + 1), new_model(seed)
    params = m.arrays()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pool = [made.example(LENGTH) for _ in range(max(BATCH, min(3000, steps * 8)))]
    xs, ys = np.stack([a for a, _ in pool]), np.stack([b for _, b in pool])
    order = np.random.default_rng(seed + 2)
    for step in range(1, steps + 1):
        pick = order.integers(0, len(xs), BATCH)
        _, grads = loss_and_gradients(m, xs[pick].T.astype(np.int64), ys[pick].T)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        rate = 0.02 * min(1.0, step / 20) * (1 - step / (steps + 1)) ** 0.7
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def fit(docs: DataFrame, background: int = BACKGROUND) -> Model:
    ids = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(background)
    chosen = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id").distinct()  # ids are at most ``background``
    return train([r["text"] for r in chosen.orderBy("doc_id", "text").collect()])


class Decoder:
    """Tags windows of characters. All arrays hold a feature a row and a window a column."""

    def __init__(self, m: Model) -> None:
        self.h = m.u[0].shape[0]
        self.wx = [np.ascontiguousarray(w.T) for w in m.wx]
        # below the recurrent weights come those of the scores, for one product a step
        self.u = [np.ascontiguousarray(np.vstack([u.T, out.T])) for u, out in zip(m.u, (m.wo[: self.h], m.wo[self.h :]), strict=True)]
        self.bo, self.trans, self.start = m.bo[:, None], m.trans, m.start

    def _states(self, x: np.ndarray, k: int, e: np.ndarray) -> None:
        """Adds the direction's scores to e (T, tags, N)."""
        t_n, n = x.shape
        h_n = self.h
        h, c = np.zeros((h_n, n), np.float32), np.zeros((h_n, n), np.float32)
        z, full, tmp = np.empty((4 * h_n, n), np.float32), np.empty((4 * h_n + _K, n), np.float32), np.empty((h_n, n), np.float32)
        wx, u, r, score = self.wx[k], self.u[k], full[: 4 * h_n], full[4 * h_n :]
        i, f, o, g = (r[j * h_n : (j + 1) * h_n] for j in range(4))
        gates = r[: 3 * h_n]
        before = None
        for t in range(t_n) if k == 0 else range(t_n - 1, -1, -1):
            np.take(wx, x[t], axis=1, out=z, mode="clip")
            np.dot(u, h, out=full)
            if before is not None:
                e[before] += score
            before = t
            r += z
            np.clip(gates, 0, 1, out=gates)
            np.clip(g, -1, 1, out=g)
            c *= f
            np.multiply(i, g, out=tmp)
            c += tmp
            np.clip(c, -1, 1, out=tmp)
            np.multiply(tmp, o, out=h)
        np.dot(u, h, out=full)
        e[before] += score

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Tags (T, N) of windows x (T, N) of character numbers."""
        t_n, n = x.shape
        x = x.astype(np.intp)
        e = np.empty((t_n, _K, n), np.float32)
        e[:] = self.bo
        self._states(x, 0, e)
        self._states(x, 1, e)
        # Viterbi: e becomes the best score of a path up to each tag
        e[0] += self.start[:, None]
        both, trans = np.empty((_K, _K, n), np.float32), self.trans[:, :, None]
        for t in range(1, t_n):
            np.add(e[t - 1][:, None], trans, out=both)
            e[t] += both.max(axis=0)
        tags = np.empty((t_n, n), np.uint8)
        tags[-1] = e[-1].argmax(axis=0)
        for t in range(t_n - 1, 0, -1):
            last, best = tags[t], e[t - 1, 0] + self.trans[0].take(tags[t])
            arg = np.zeros(n, np.uint8)
            for i in range(1, _K):
                other = e[t - 1, i] + self.trans[i].take(last)
                np.copyto(arg, np.uint8(i), where=other > best)
                np.maximum(best, other, out=best)
            tags[t - 1] = arg
        return tags


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first character, characters, first kept, last kept + 1) of the windows of texts of the given lengths."""
    stride = WINDOW - OVERLAP
    n = np.maximum(1, -(-(lengths - OVERLAP) // stride))
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = k * stride
    size = np.minimum(WINDOW, lengths[text] - first)
    low = np.where(k == 0, 0, OVERLAP // 2)
    high = np.where(k == n[text] - 1, size, WINDOW - OVERLAP // 2)
    return text, first, size, low, high


def tag_texts(texts: pa.Array, decoder: Decoder, together: int = 1024) -> tuple[np.ndarray, ...]:
    """(text, first character, last + 1, tag) of every run of a tag in the texts."""
    data, offsets = tk.text_bytes(texts)
    lead = (data & 0xC0) != 0x80
    chars = codes(data)
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    lengths = np.diff(at)
    some = np.flatnonzero(lengths)
    tags = np.zeros(len(chars) + 1, np.uint8)
    if len(some):
        text, first, size, low, high = windows(lengths[some])
        begin = at[some[text]] + first
        bucket = -(-size // 32) * 32
        padded = np.concatenate([chars, np.full(WINDOW, 10, np.uint8)])
        for width in np.unique(bucket).tolist():
            group = np.flatnonzero(bucket == width)
            for low_i in range(0, len(group), together):
                g = group[low_i : low_i + together]
                step = np.arange(width)
                x = padded[begin[g] + step[:, None]]
                x[step[:, None] >= size[g]] = 10
                found = decoder(x)
                keep = (step[:, None] >= low[g]) & (step[:, None] < high[g])
                tags[(begin[g] + step[:, None])[keep]] = found[keep]
    new = np.ones(len(chars), bool)
    if len(chars):
        new[1:] = tags[1:-1] != tags[:-2]
        new[at[:-1][lengths > 0]] = True
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(chars))
    kind = tags[s]
    ok = kind > 0
    need = np.array([(0, 0, 0), *(NEEDS[t] for t in TAGS[1:])])
    for k, is_it in enumerate(((chars >= 48) & (chars < 58), chars == 46, chars == 64)):
        total = np.concatenate([[0], np.cumsum(is_it)])
        ok &= total[e] - total[s] >= need[kind, k]
    s, e, kind = s[ok], e[ok], kind[ok]
    doc = np.searchsorted(at, s, "right") - 1
    return doc, s - at[doc], e - at[doc], kind


def find_pii(docs: DataFrame, background: int = BACKGROUND) -> DataFrame:
    """(doc_id, start_char, end_char, kind): every span tagged as personal data; places count characters.

    Null, empty and short texts give no rows; a null id gives rows with a null id; rows that repeat an id or a text are
    read each. Very long texts are read whole. Other columns are not read. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, background))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            for part in tk.slices(batch, limit=2 * tk.SLICE_BYTES):  # many windows at once
                doc, s, e, kind = tag_texts(part.column("text"), decoder)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(s), pa.array(e), pa.array([TAGS[k] for k in kind], pa.string())], names=["doc_id", "start_char", "end_char", "kind"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    return chosen.mapInArrow(run, "doc_id long, start_char long, end_char long, kind string")
