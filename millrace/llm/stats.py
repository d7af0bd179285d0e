"""Statistics of whole texts, for the quality operators (7 and 8).

A null text counts as empty; shares of an empty text are 0. Rows stay one for one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import common, lines

#: Byte classes whose share of the bytes is a statistic.
_CLASSES = {
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "space": [9, 10, 11, 12, 13, 32],
    "stop": [ord(c) for c in ".,;:?"],
    "mark": [ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~[]"],
    "wide": [*range(128, 256)],
}
NAMES = ("n_bytes", "n_words", "word_bytes", "distinct_words", "top_word", "distinct_trigrams", "n_lines", "line_bytes", "distinct_lines", *(f"share_{c}" for c in _CLASSES))
_TABLES = [np.isin(np.arange(256), c).astype(np.int64) for c in _CLASSES.values()]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, how many different hashes it has and how often the most frequent one occurs."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    _, at, count = np.unique(common.mix(h ^ common.mix(doc.astype(np.uint64))), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[at], count)
    return np.bincount(doc[at], minlength=n), most


def _block(column: pa.Array) -> np.ndarray:
    data, off = common.utf8(column)
    size = np.diff(off)
    w = common.words(column)
    h, count = w.hashes(), np.diff(w.first)
    word_bytes = np.diff(np.concatenate([[0], np.cumsum(w.end - w.start)])[w.first])
    words, top = _distinct(h, w.first)
    g, _, firsts = common.gram_table(h, w.first, 3)
    grams, _ = _distinct(g[: firsts[-1]], firsts)
    x = lines.split(column)
    kinds, _ = _distinct(lines.hashes(x), x.first)
    n_lines = np.diff(x.first)
    over = lambda a, b: a / np.maximum(b, 1)
    shares = [over(np.diff(np.concatenate([[0], np.cumsum(t[data])])[off]), size) for t in _TABLES]
    return np.stack([size, count, over(word_bytes, count), over(words, count), over(top, count), over(grams, np.diff(firsts)), n_lines, over(size, n_lines), over(kinds, n_lines), *shares], axis=1).astype(np.float64)


def of(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    return np.concatenate([np.zeros((0, len(NAMES))), *(_block(column.slice(a, b - a)) for a, b in common.blocks(column))])


def table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row."""

    def fn(batch):
        x = of(common.as_array(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in range(len(NAMES)))], names=["doc_id", *NAMES])

    return common.only(docs, id_col, text_col).mapInArrow(common.flat_map(fn), "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))
