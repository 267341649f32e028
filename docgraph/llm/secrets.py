"""Secret scans by a battery of randomness tests with false-discovery control.

A candidate is a run of at least MIN_LENGTH characters of [A-Za-z0-9+/_-], without '-' and '_' at its ends ('=' parts a
name from its value, and pads), and also each part of a run between '_' and '/', and between '-', '_' and '/', which
may join a name or a path to a key. Of findings that overlap the one that begins first stays, the longest of these. The
encoding of a candidate is the smallest alphabet that holds it: decimal, hexadecimal, base32 or base64; hyphens between hexadecimal or
decimal digits are passed over, as in UUIDs. A candidate has room for at least MIN_BITS bits in its encoding: shorter
numbers, such as those of cards and orders, may be as random as they like without being keys.

Two questions are asked of a candidate. *Is it ordinary text?* The evidence against that is the likelihood of the
uniform distribution over its alphabet over the likelihood of the corpus' own character pairs; by Markov's inequality
the inverse is a p-value, and it falls off with length, so that short runs need more than they can show. By
Benjamini and Hochberg the share of ordinary text among the findings is held to RATE in each class of length, classes
being powers of two. *Is it random?* A chi-squared test of the alphabet's uniformity, a runs test about the alphabet's
middle and a test of serial correlation, together a chi-squared statistic of three degrees, must not reject
randomness at BATTERY: repeats, counters and words in unusual characters do not pass.

Character pairs, numbers of candidates and p-values are counted over the whole corpus; p-values go to the driver as a
histogram of fixed size, rounded up, which can only make the control stricter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm import tokens as tk
from docgraph.llm.common import map_rows

MIN_LENGTH, MIN_BITS, RATE, BATTERY = 16, 80, 0.01, 1e-4
#: p-values are counted by -log10 in steps of 1 / GRAIN up to TOP; those of 0.1 and more can't be found at this rate.
GRAIN, TOP = 10, 60
CLASSES = 24
ALPHABETS = {"decimal": b"0123456789", "hex": b"0123456789abcdef", "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
NAMES = tuple(ALPHABETS)
_CHARS = np.zeros(256, bool)
_CHARS[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
#: What runs are made of: whole ones, parts that '_' and '/' part, parts that '-' parts too.
_RUNS = [_CHARS.copy() for _ in range(3)]
_RUNS[1][[*b"_/"]] = False
_RUNS[2][[*b"_/-"]] = False
_TRIM = np.zeros(256, bool)
_TRIM[[*b"-_"]] = True


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*chars]] = True
    return out


_DIGIT, _HEX_LOW, _HEX_UP, _B32 = _set(b"0123456789"), _set(b"0123456789abcdef"), _set(b"0123456789ABCDEF"), _set(ALPHABETS["base32"])
_INDEX = np.full((4, 256), -1)
for _i, _name in enumerate(NAMES):
    _INDEX[_i, [*ALPHABETS[_name]]] = np.arange(len(ALPHABETS[_name]))
_INDEX[1, [*b"ABCDEF"]] = np.arange(10, 16)
_INDEX[3, [*b"-_"]] = 62, 63


def _runs(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of ``chars`` of at least MIN_LENGTH, trimmed."""
    n = len(data)
    inside = chars[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    after = np.concatenate([inside[1:], [False]]) if n else inside
    start = np.flatnonzero(inside & ~(before & ~edge[:n]))
    end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    long = end - start >= MIN_LENGTH
    start, end = start[long].copy(), end[long].copy()
    while True:  # a round takes one character off either end
        head, tail = _TRIM[data[start]], _TRIM[data[end - 1]]
        if not (head.any() or tail.any()):
            break
        start, end = start + head, end - tail
        long = end - start >= MIN_LENGTH
        start, end = start[long], end[long]
    return start, end


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, encoding) of all candidates, by start; none crosses from one text into the next."""
    found = [np.stack(_runs(data, offsets, chars), axis=1) for chars in _RUNS]
    start, end = np.unique(np.concatenate(found), axis=0).T
    kind = np.full(len(start), 3)
    for code, chars in ((2, _B32), (1, _HEX_LOW), (1, _HEX_UP), (0, _DIGIT)):
        other = ~chars[data]
        if code < 2:
            other &= data != 45
        total = np.concatenate([[0], np.cumsum(other)])
        kind[total[end] == total[start]] = code
    bits = np.log2([len(a) for a in ALPHABETS.values()])
    enough = (end - start) * bits[kind] >= MIN_BITS
    return start[enough], end[enough], kind[enough]


def pair_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each byte follows each, 65,536 counts; a text's first byte follows a space."""
    before = np.empty(len(data), np.int64)
    before[1:] = data[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before[firsts] = 32
    return np.bincount(before * 256 + data, minlength=65536)


def pair_model(counts: np.ndarray) -> np.ndarray:
    """log10 of the share of each byte after each, smoothed by one count for each of 64 bytes."""
    c = counts.reshape(256, 256).astype(float)
    return np.log10((c + 1) / (c.sum(axis=1, keepdims=True) + 64)).ravel()


def evidence(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, model: np.ndarray) -> np.ndarray:
    """-log10 of the p-value of ordinary text, 0 or more."""
    if not len(start):
        return np.empty(0)
    size = np.array([len(a) for a in ALPHABETS.values()])
    before = np.empty(len(data), np.int64)
    before[1:] = data[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = 32
    total = np.concatenate([[0], np.cumsum(model[before * 256 + data])])
    dashes = np.concatenate([[0], np.cumsum(data == 45)])
    n = end - start - np.where(kind < 2, dashes[end] - dashes[start], 0)
    return np.maximum(0, -(total[end] - total[start]) - n * np.log10(size[kind]))


def battery(symbols: np.ndarray, size: int) -> float:
    """The p-value of randomness of a sequence of numbers below ``size``; 1.0 for fewer than two symbols."""
    n = len(symbols)
    if n < 2:
        return 1.0
    counts = np.bincount(symbols, minlength=size)
    chi, free = float(((counts - n / size) ** 2).sum() * size / n), size - 1
    z1 = (chi - free) / math.sqrt(2 * free * (1 - 1 / n))
    z1 = max(0.0, ((max(chi, 0) / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free))) if z1 > 0 else min(0.0, z1)
    high = symbols >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        expected = 2 * a * b / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z2 = (1 + int((high[1:] != high[:-1]).sum()) - expected) / math.sqrt(spread) if spread > 0 else 0.0
        z2b = (a - b) / math.sqrt(n)
        z2 = z2 if abs(z2) > abs(z2b) else z2b
    else:
        z2 = math.sqrt(n)
    x = symbols - symbols.mean()
    power = float(x @ x)
    z3 = (float(x[1:] @ x[:-1]) / power + 1 / n) * math.sqrt(n) if power else math.sqrt(n)
    q = z1 * z1 + z2 * z2 + z3 * z3
    return math.erfc(math.sqrt(q / 2)) + math.sqrt(2 * q / math.pi) * math.exp(-q / 2)


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.log2(np.maximum(n, 1)).astype(int))


def thresholds(cells: dict[tuple[int, int], int], numbers: dict[int, int], rate: float = RATE) -> np.ndarray:
    """Of each length class, the least -log10 p that Benjamini and Hochberg reject; infinite where none is."""
    out = np.full(CLASSES, np.inf)
    for c, m in numbers.items():
        found = 0
        for cell in sorted((k for k in cells if k[0] == c), key=lambda k: -k[1]):
            found += cells[cell]
            if 10 ** (-cell[1] / GRAIN) <= rate * found / m:
                out[c] = cell[1] / GRAIN
    return out


def _cells(e: np.ndarray) -> np.ndarray:
    return np.minimum((e * GRAIN + 1e-9).astype(int), TOP * GRAIN)


class Scan:
    """What the two counting passes found: enough to scan any text of the corpus."""

    def __init__(self, model: np.ndarray, least: np.ndarray) -> None:
        self.model, self.least = model, least

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(bytes, offsets, start, end, encoding, evidence, randomness) of the findings."""
        data, offsets = tk.text_bytes(texts)
        start, end, kind = candidates(data, offsets)
        e = evidence(data, offsets, start, end, kind, self.model)
        ok = _cells(e) / GRAIN >= self.least[length_class(end - start)]
        start, end, kind, e = start[ok], end[ok], kind[ok], e[ok]
        p = np.empty(len(start))
        for i, (s, t, k) in enumerate(zip(start.tolist(), end.tolist(), kind.tolist(), strict=True)):
            seq = _INDEX[k, data[s:t]]
            p[i] = battery(seq[seq >= 0], len(ALPHABETS[NAMES[k]]))
        ok = p >= BATTERY
        order = np.lexsort((-end, start))
        order = order[ok[order]]
        if len(order):  # of findings that overlap the first stays
            stop = 0
            for i in order.tolist():
                ok[i] = start[i] >= stop
                stop = max(stop, int(end[i])) if ok[i] else stop
        return data, offsets, start[ok], end[ok], kind[ok], e[ok], p[ok]


def prepare(docs: DataFrame, text_col: str = "text") -> Scan:
    """Counts character pairs, then candidates and p-values, over all documents."""
    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    spark = docs.sparkSession

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for part in tk.slices(batch):
                total += pair_counts(*tk.text_bytes(part.column("text")))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    counts = np.zeros(65536)
    for r in texts.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    sent = spark.sparkContext.broadcast(pair_model(counts))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, TOP * GRAIN + 1), np.int64)
        for batch in batches:
            for part in tk.slices(batch):
                data, offsets = tk.text_bytes(part.column("text"))
                start, end, kind = candidates(data, offsets)
                np.add.at(total, (length_class(end - start), _cells(evidence(data, offsets, start, end, kind, sent.value))), 1)
        c, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(cell), pa.array(total[c, cell])], names=["class", "cell", "n"])

    cells: dict[tuple[int, int], int] = {}
    numbers: dict[int, int] = {}
    for r in texts.mapInArrow(values, "class long, cell long, n long").groupBy("class", "cell").agg(F.sum("n").alias("n")).collect():
        cells[r["class"], r["cell"]] = r["n"]
        numbers[r["class"]] = numbers.get(r["class"], 0) + r["n"]
    return Scan(sent.value, thresholds(cells, numbers))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_byte, n_bytes, encoding, evidence, randomness): every finding; places count UTF-8 bytes.

    evidence is -log10 of the p-value of ordinary text, randomness the battery's p-value. Null texts and texts without
    a candidate give no rows; a null id gives rows with a null id; rows that repeat an id or a text are scanned each.
    Very long texts are read whole. Other columns are not read. An empty table gives no rows.
    """
    scan = docs.sparkSession.sparkContext.broadcast(prepare(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                _, offsets, start, end, kind, e, p = scan.value(part.column("text"))
                doc = np.searchsorted(offsets, start, "right") - 1
                cols = [part.column("doc_id").take(pa.array(doc)), pa.array(start - offsets[doc]), pa.array(end - start), pa.array([NAMES[k] for k in kind], pa.string()), pa.array(np.round(e, 3)), pa.array(np.round(p, 6))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start_byte", "n_bytes", "encoding", "evidence", "randomness"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return chosen.mapInArrow(run, "doc_id long, start_byte long, n_bytes long, encoding string, evidence double, randomness double")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every finding in ``text`` replaced by ``mark``, and n_chars, if there, counted anew.

    All rows and columns stay, whatever their names. Null and empty texts stay null and empty; a null id is as good as
    any other; rows that repeat an id or a text are redacted each; very long texts are read whole; of findings that
    overlap the one that begins first, and of these the longest, is replaced. An empty table stays empty.
    """
    scan = docs.sparkSession.sparkContext.broadcast(prepare(docs))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                data, offsets, start, end, *_ = scan.value(part.column("text"))
                if not len(start):
                    yield part
                    continue
                texts = part.column("text").to_pylist()
                doc = np.searchsorted(offsets, start, "right") - 1
                for d in np.unique(doc).tolist():
                    at, pieces = int(offsets[d]), []
                    for i in np.flatnonzero(doc == d).tolist():
                        pieces += [data[at : start[i]].tobytes(), mark.encode()]
                        at = int(end[i])
                    texts[d] = b"".join([*pieces, data[at : offsets[d + 1]].tobytes()]).decode()
                cols = list(part.columns)
                cols[place] = pa.array(texts, cols[place].type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    out = map_rows(docs, run)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
