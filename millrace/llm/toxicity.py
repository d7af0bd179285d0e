"""Toxicity by classifier chains (operator 6).

Categories are predicted one after another. The model of each is a lasso logistic regression over
which words a text holds, three statistics of its style, and the probabilities of the categories
before it. While fitting, those probabilities are out-of-fold ones, so that a later model sees
what it will see on new texts; each fold chooses its words without its own labels as well. The labels
table knows one toxicity label; the chain's categories are its two kinds, `toxic_fluent` (labelled
quality 1) and `toxic_junk` (quality 0), and then `toxic`, which reads both and decides.

Defined results: a null or empty text has the probabilities of a text without words; a text of any
length is read whole; every row is scored by itself, repeated or not; equal texts score alike; a null
doc_id stays null; ids are whole numbers; labels without both classes, or no labels, give a
model that rejects nothing; other columns are passed on or left alone; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, learn

#: Labelled documents that the models are fitted on, at most.
MAX_TRAIN = 4000
#: Words that are features: the most telling ones found in at least MIN_DOCS of those documents.
VOCABULARY, MIN_DOCS = 512, 5
FOLDS, LAMBDA = 4, 0.001
_PARTS = 16
#: Beside whole words, their first so many bytes are features: insults are inflected and compounded.
PREFIXES = (4, 5, 6, 7)
#: The last one decides.
CHAIN = ("toxic_fluent", "toxic_junk", "toxic")
_SCHEMA = "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", toxic boolean"
_SYMBOL, _UPPER = np.zeros(256, np.int64), np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#$%&*|!"]] = 1
_UPPER[65:91] = 1


@dataclass
class Chain:
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    cut: float = 2.0

    def probabilities(self, words: np.ndarray, doc: np.ndarray, style: np.ndarray) -> np.ndarray:
        """Of each text and category. words, doc: the hash and text number of every word."""
        n, v = len(style), len(self.vocabulary)
        out = np.zeros((n, len(CHAIN)))
        if not self.weights:
            return out
        at = np.minimum(np.searchsorted(self.vocabulary, words), v - 1) if v else np.zeros(len(words), np.int64)
        hit = self.vocabulary[at] == words if v else np.zeros(len(words), bool)
        pair, count = np.unique(doc[hit] * max(v, 1) + at[hit], return_counts=True)
        d, f, strength = pair // max(v, 1), pair % max(v, 1), np.log2(1 + count)
        for j, (w, b) in enumerate(zip(self.weights, self.bias)):
            z = np.bincount(d, weights=w[f] * strength, minlength=n) + style @ w[v : v + style.shape[1]] + out[:, :j] @ w[v + style.shape[1] :] + b
            out[:, j] = learn.sigmoid(z)
        return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the text of each, and the style statistics: shares of symbols and capitals, log of the words."""
    raw, off = common.utf8(column)
    w = common.words(column)
    size = np.maximum(np.diff(off), 1)
    share = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[raw])])[off]) / size
    doc = w.doc
    parts = [w.hashes(), *(np.where(w.end - w.start > n, w.hashes(n) + np.uint64(n), 0) for n in PREFIXES)]
    hashes, docs = np.concatenate(parts), np.tile(doc, len(parts))
    return hashes[hashes > 0], docs[hashes > 0], np.stack([share(_SYMBOL), share(_UPPER), np.log1p(np.diff(w.first)) / 10], axis=1)


def _entries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, text and count of every different word of every text, and the style statistics."""
    words, doc, counts, style = [], [], [], []
    for lo, hi in common.blocks(texts):
        w, d, s = features(texts.slice(lo, hi - lo))
        order = np.lexsort((d, w))
        w, d = w[order], d[order]
        first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (d[1:] != d[:-1]))) if len(w) else np.zeros(0, np.int64)
        words.append(w[first]), doc.append((d[first] + lo).astype(np.int32)), counts.append(np.diff(np.append(first, len(w))).astype(np.int32)), style.append(s)
    return tuple(map(np.concatenate, (words, doc, counts, style)))


def vocabularies(words: np.ndarray, doc: np.ndarray, y: np.ndarray, subsets: list[np.ndarray]) -> list[np.ndarray]:
    """For each subset of the texts, the VOCABULARY words that tell its labels y best, sorted."""
    chosen, score = [[] for _ in subsets], [[] for _ in subsets]
    for part in range(_PARTS):  # by hash, as one sort of all words would hold several times their size
        own = words % np.uint64(_PARTS) == part
        known, which = np.unique(words[own], return_inverse=True)
        texts = doc[own]
        for k, rows in enumerate(subsets):
            n, base = rows.sum(), y[rows].mean() if rows.any() else 0.0
            df = np.bincount(which, weights=rows[texts], minlength=len(known))
            seen = np.bincount(which, weights=(y * rows)[texts], minlength=len(known))
            worth = np.where(df >= MIN_DOCS, np.abs(seen - df * base) / np.sqrt(df * base * (1 - base) * (1 - df / (n + 1)) + 1), 0)
            best = np.argsort(-worth, kind="stable")[:VOCABULARY]
            best = best[worth[best] > 0]
            chosen[k].append(known[best]), score[k].append(worth[best])
    chosen, score = [np.concatenate(c) for c in chosen], [np.concatenate(c) for c in score]
    return [np.sort(c[np.lexsort((c, -w))[:VOCABULARY]]) for c, w in zip(chosen, score)]


def fit(texts: pa.Array, ids: np.ndarray, labels: np.ndarray) -> Chain:
    """labels: a 0/1 column for each category of CHAIN."""
    y = labels.astype(np.float64)
    if not len(y) or y[:, -1].min() == y[:, -1].max():
        return Chain()
    words, doc, counts, style = _entries(texts)
    n, fold = len(y), learn.folds(ids, FOLDS)
    inside = [fold != k for k in range(FOLDS) if (fold == k).any() and (fold != k).any()]
    inside.append(np.ones(n, bool))  # the last is fitted on all
    known = vocabularies(words, doc, y[:, -1], inside)

    def matrix(vocabulary: np.ndarray) -> np.ndarray:
        x = np.zeros((n, len(vocabulary)), np.float32)
        for part in range(0, len(words), 1 << 20) if len(vocabulary) else ():
            some = slice(part, part + (1 << 20))
            place = np.minimum(np.searchsorted(vocabulary, words[some]), len(vocabulary) - 1)
            hit = vocabulary[place] == words[some]
            x[doc[some][hit], place[hit]] = np.log2(1 + counts[some][hit])
        return np.concatenate([x, style], axis=1, dtype=np.float32)

    xs, model, ahead = [matrix(v) for v in known], Chain(known[-1]), np.zeros((n, 0))
    del words, doc, counts
    weight = lambda t: np.where(t > 0, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum()))
    for j in range(len(CHAIN)):
        p = np.zeros(n)
        for x, rows in zip(xs, inside):
            xj = np.concatenate([x, ahead], axis=1, dtype=np.float32)
            w, b = learn.lasso_logistic(xj[rows], y[rows, j], LAMBDA, weight(y[rows, j]))
            if not rows.all():
                p[~rows] = learn.sigmoid(xj[~rows] @ w + b)
        model.weights.append(w), model.bias.append(b)
        ahead = np.column_stack([ahead, p])
    model.cut = max(0.5, learn.best_cut(ahead[:, -1], y[:, -1]))  # what is more likely clean is never rejected
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> Chain:
    toxic, good = F.col("toxic").cast("int"), F.col("quality").cast("int")
    columns = {"fluent": toxic * good, "junk": toxic * (1 - good), "toxic": toxic}
    rows = learn.labelled(docs, labels, id_col, text_col, columns, most).toArrow().sort_by("id")
    y = np.column_stack([rows.column(c).to_numpy() for c in columns]) if rows.num_rows else np.zeros((0, 3))
    return fit(common.as_array(rows.column("text")), rows.column("id").to_numpy(), y)


def probabilities(column: pa.Array, model: Chain) -> np.ndarray:
    parts = [np.zeros((0, len(CHAIN)))]
    parts += [model.probabilities(*features(column.slice(lo, hi - lo))) for lo, hi in common.blocks(column)]
    return np.concatenate(parts)


def score(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the probability of each category, and whether the document is rejected as toxic; all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY weights a category

    def fn(batch):
        p = probabilities(common.as_array(batch.column(1)), shared.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j]) for j in range(len(CHAIN))), pa.array(p[:, -1] >= shared.value.cut)], names=["doc_id", *(f"p_{c}" for c in CHAIN), "toxic"])

    return common.only(docs, id_col, text_col).mapInArrow(common.flat_map(fn), _SCHEMA)


def keep(docs: DataFrame, model: Chain, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def fn(batch):
        for lo, hi in common.blocks(batch.column(at)):
            part = batch.slice(lo, hi - lo)
            p = shared.value.probabilities(*features(common.as_array(part.column(at))))
            yield part.filter(pa.array(p[:, -1] < shared.value.cut))

    return docs.mapInArrow(common.flat_map(fn), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected documents of the whole table, with their categories' probabilities."""
    docs = common.load(spark, sf_dir, "documents")
    return score(docs, train(docs, common.load(spark, sf_dir, "labels"))).where("toxic").drop("toxic")
