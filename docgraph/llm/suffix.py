"""Suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered only through their first ``repeats.LENGTH`` words. The first, most significant, digit of a suffix
is the least hash among the 8-word grams of those words; it is the digit by which Spark distributes the suffixes, and
equal suffixes agree in it. The other digits follow in repeats.equal_windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from docgraph.llm import repeats
from docgraph.llm import tokens as tk

GRAM = 8


def gram_candidates(w: tk.Words) -> tuple[np.ndarray, np.ndarray, int, int]:
    hashes, has = np.zeros(len(w.hash), np.uint64), np.zeros(len(w.hash), bool)
    h, at = tk.grams(w, GRAM)
    hashes[at], has[at] = h, True
    return hashes, has, 0, repeats.LENGTH - GRAM


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, first_doc): where a document's words repeat elsewhere in the corpus.

    A word is a run of anything but ASCII space, taken as it stands. Every window of 50 words that occurs at more than
    one place, in the same or in another document, is repeated; the spans are the unions of a document's overlapping or
    touching repeated windows, and first_doc is the least id among all holders of the span's windows. To dedup, keep
    the spans with first_doc = doc_id.

    Null ids, null texts and texts under 50 words give no rows. Rows that repeat an id are copies under that one id.
    Other columns are not read. An empty table gives no rows.
    """
    return repeats.repeated_spans(docs, gram_candidates, id_col, text_col)
