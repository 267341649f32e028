"""Substring dedup by recompression.

Rounds over the words of all documents replace runs of one symbol and then pairs of symbols by new symbols. A symbol's
name is a 64-bit hash of what it replaces, so that every executor gives equal contents the same name in every round,
without a shuffle to agree on names. In a pair round a bit of each name puts it on the left or the right side, and
pairs of a left and a right symbol are joined; such pairs never overlap. A symbol never spans more words than its
round's cap.

What a round does to two symbols depends on these alone, except at the ends of a repeated passage: there a run or a
pair may reach out of it. Each round so spoils at either end at most a run, of the round's cap of words, and then a
symbol that joins one outside, of a word less. After the rounds of CAPS all symbols that lie LOSS words inside an
occurrence of the passage are the same at every occurrence, and every window of 50 words holds TOGETHER such symbols in
a row. Among these the ones with the least hash are the window's anchor: shared symbols reveal the repeats, and the
windows around them are compared in repeats.equal_windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from docgraph.llm import repeats
from docgraph.llm import tokens as tk

CAPS = (2, 3, 4)
TOGETHER = 3
LOSS = sum(2 * c - 1 for c in CAPS)
LAST = repeats.LENGTH - LOSS - TOGETHER * CAPS[-1]
assert LAST - LOSS + 1 >= CAPS[-1], "a window must hold symbols that are safe from its surroundings"


def symbols(w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words) of the symbols of the last round."""
    name, at, span, doc = w.hash, np.arange(len(w.hash)), np.ones(len(w.hash), np.int64), w.doc
    for r, cap in enumerate(CAPS):
        if len(name) < 2:
            break
        # runs: a symbol repeated, where the whole run keeps within the cap
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(name)))
        joined = (n > 1) & (n * span[first] <= cap)
        keep = new | np.repeat(~joined, n)
        name = name.copy()
        name[first[joined]] = tk.mix(name[first[joined]] * np.uint64(31) + n[joined].astype(np.uint64), 200 + r)
        span = span.copy()
        span[first[joined]] *= n[joined]
        name, at, span, doc = name[keep], at[keep], span[keep], doc[keep]
        # pairs
        left = (tk.mix(name, 300 + r) >> np.uint64(63)).astype(bool)
        pair = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1]) & (span[:-1] + span[1:] <= cap)
        i = np.flatnonzero(pair)
        name[i] = tk.mix(name[i] * np.uint64(3) ^ tk.mix(name[i + 1], 400 + r), 500 + r)
        span[i] += span[i + 1]
        keep = np.ones(len(name), bool)
        keep[i + 1] = False
        name, at, span, doc = name[keep], at[keep], span[keep], doc[keep]
    return name, at, span


def symbol_candidates(w: tk.Words) -> tuple[np.ndarray, np.ndarray, int, int]:
    hashes, has = np.zeros(len(w.hash), np.uint64), np.zeros(len(w.hash), bool)
    name, at, _ = symbols(w)
    first = np.arange(max(0, len(name) - TOGETHER + 1))
    hashes[at[first]] = tk.window_hash(name, tk.WORD_BASE, first, first + TOGETHER)
    has[at[first]] = True
    return hashes, has, LOSS, LAST


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, first_doc): where at least 50 words repeat elsewhere in the corpus.

    A word is a run of anything but ASCII space, taken as it stands; spans are the unions of a document's overlapping
    or touching repeated windows of 50 words, and first_doc is the least id among all holders of the span's windows.

    Null ids, null texts and texts under 50 words give no rows. Rows that repeat an id are copies under that one id.
    Other columns are not read. An empty table gives no rows.
    """
    return repeats.repeated_spans(docs, symbol_candidates, id_col, text_col)
