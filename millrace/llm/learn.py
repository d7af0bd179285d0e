"""Small models fitted on the driver from a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, the same ones on every run and as good as random: those of least key hash."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, columns: dict[str, Column], most: int) -> DataFrame:
    """id, text and label columns of at most `most` labelled documents.

    A doc_id labelled more than once has the largest of its labels, and one that several rows have counts once, with
    its least text; rows with a null id or label are left out.
    """
    one = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.max(c).cast("int").alias(n) for n, c in columns.items()])
    one = sample(one.dropna(), "id", most)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(one), "id")  # `most` rows of a few numbers
    return found.groupBy("id", *columns).agg(F.min("text").alias("text"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def lasso_logistic(x: np.ndarray, y: np.ndarray, lam: float, weight: np.ndarray | None = None, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of least weighted log-loss plus lam times the weights' absolute sum (accelerated proximal gradient)."""
    n, m = x.shape
    x = np.ascontiguousarray(x, np.float32)
    s = np.ones(n) if weight is None else weight * n / weight.sum()
    one = np.ones(m + 1)
    for _ in range(8):  # largest singular value, with the intercept's column
        u = x @ one[:m].astype(np.float32) + one[m]
        u = u * s
        one = np.append(x.T @ u.astype(np.float32), u.sum())
        size = np.linalg.norm(one)
        one = one / size if size else np.ones(m + 1)
    step = 1 / (0.25 * 1.1 * size / n + 1e-9)
    w, b = np.zeros(m), 0.0
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        r = s * (sigmoid(x @ v.astype(np.float32) + c) - y) / n
        w2 = v - step * (x.T @ r.astype(np.float32))
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * lam, 0)
        b2 = c - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / t2
        if ((v - w2) * (w2 - w)).sum() > 0:
            t2, k = 1.0, 0.0  # restart
        v, c = w2 + k * (w2 - w), b2 + k * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def linear_svm(x: np.ndarray, y: np.ndarray, lam: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of least squared hinge loss with an L2 penalty, for y of -1 and 1; classes weigh alike."""
    n, m = x.shape
    x = np.ascontiguousarray(x, np.float32)
    s = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    one = np.ones(m + 1)
    for _ in range(8):
        u = s * (x @ one[:m].astype(np.float32) + one[m])
        one = np.append(x.T @ u.astype(np.float32), u.sum())
        size = np.linalg.norm(one)
        one = one / size if size else np.ones(m + 1)
    step = 1 / (2.2 * size + lam)
    w, b = np.zeros(m), 0.0
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ v.astype(np.float32) + c))
        r = -2 * s * y * miss
        w2 = v - step * (x.T @ r.astype(np.float32) + lam * v)
        b2 = c - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / t2
        v, c = w2 + k * (w2 - w), b2 + k * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def folds(ids: np.ndarray, k: int) -> np.ndarray:
    """A fold for each id, the same for equal ids."""
    from millrace.llm.common import mix

    return (mix(ids.astype(np.uint64)) % np.uint64(k)).astype(np.int64)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability between two neighbours at which F1 is best; 0.5 where there is nothing to choose."""
    if not len(p) or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(len(p)) + 1 + y.sum())
    last = np.append(np.diff(p[order]) != 0, True)
    k = int(np.argmax(np.where(last, f1, -1)))
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + low) / 2)
