"""Quality by learned rules over text statistics: a sparse rule ensemble (operator 7) and decision lists (operator 8).

The ensemble grows small trees on random halves of a labelled sample, takes the path to every node as
a conjunction of thresholds, and fits lasso logistic weights to them (Friedman and Popescu, 2008).
The rules left over compile into one sum of Spark CASE expressions. The decision list covers the
rejected documents rule by rule: each conjunction grows by information gain on two thirds of what is
uncovered and is pruned on the rest, and the list compiles into one ordered CASE expression.

Defined results: a null or empty text has the statistics of an empty one; a text of any length is read
whole; every row is judged by itself, repeated or not; where several rules hold, the list's first one
decides, and a score of exactly 0.5 is kept; among equal splits and gains the first statistic and least
threshold are taken; a labelled id that several rows have is fitted on once; a null doc_id stays null; ids
are whole numbers; labels without both classes give a model that keeps everything (score 1, rule 0);
other columns are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, learn, stats

#: Labelled documents that are fitted on, at most.
MAX_TRAIN = 4000
TREES, DEPTH, QUANTILES, LEAST = 40, 3, 16, 8
LAMBDA = 0.002
#: A rule of the decision list must be right so often on the documents that it was not grown on.
PRECISION = 0.6

Rule = tuple[tuple[int, bool, float], ...]
"""Conditions (statistic, whether at most, threshold)."""


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for j, at_most, t in rule:
        c = F.col(stats.NAMES[j])
        out = out & ((c <= F.lit(float(t))) if at_most else (c > F.lit(float(t))))
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, at_most, t in rule:
        out &= x[:, j] <= t if at_most else x[:, j] > t
    return out


def thresholds(x: np.ndarray) -> list[tuple[int, float]]:
    """Candidate cuts of every statistic, between different values."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        q = np.unique(np.quantile(v, np.arange(1, QUANTILES) / QUANTILES, method="lower"))
        q = np.unique(np.concatenate([q, np.quantile(x[:, j], np.arange(1, QUANTILES) / QUANTILES, method="lower")]))
        out += [(j, float(t)) for t in q if t < v[-1]]
    return out


def paths(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The path to every node of the trees, as conjunctions; those that hold for the same rows count once."""
    cuts = thresholds(x)
    if not cuts:
        return []
    below = np.stack([x[:, j] <= t for j, t in cuts], axis=1)
    rng, found = np.random.default_rng(seed), {}

    def grow(rows: np.ndarray, rule: Rule, usable: np.ndarray) -> None:
        if len(rule) == DEPTH or len(rows) < 2 * LEAST or y[rows].min() == y[rows].max():
            return
        n, p = len(rows), y[rows].sum()
        part = below[np.ix_(rows, usable)]
        left = part.sum(axis=0)
        hit = y[rows] @ part
        ok = (left >= LEAST) & (n - left >= LEAST)
        if not ok.any():
            return
        right = np.maximum(n - left, 1)
        pure = hit**2 / np.maximum(left, 1) + (p - hit) ** 2 / right + (left - hit) ** 2 / np.maximum(left, 1) + (right - p + hit) ** 2 / right
        best = usable[int(np.argmax(np.where(ok, pure, -1)))]
        j, t = cuts[best]
        side = below[rows, best]
        for at_most, part_rows in ((True, rows[side]), (False, rows[~side])):
            one = (*rule, (j, at_most, t))
            found.setdefault(holds(one, x).tobytes(), one)
            grow(part_rows, one, usable)

    for _ in range(TREES):
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        some = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        grow(rows, (), np.array([k for k, (j, _) in enumerate(cuts) if j in some] or range(len(cuts))))
    return list(found.values())


@dataclass
class Ensemble:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 50.0

    def score(self) -> Column:
        """The probability of good quality, over the statistics' columns."""
        z = F.lit(self.bias)
        for r, w in zip(self.rules, self.weights):
            z = z + F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights):
            z = z + np.where(holds(r, x), w, 0.0)
        return 1 / (1 + np.exp(-z))


def fit_ensemble(x: np.ndarray, y: np.ndarray, lam: float = LAMBDA) -> Ensemble:
    if not len(y) or y.min() == y.max():
        return Ensemble()
    rules = paths(x, y.astype(np.float64))
    if not rules:
        return Ensemble()
    active = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32)
    w, b = learn.lasso_logistic(active, y.astype(np.float64), lam, rounds=400)
    used = np.flatnonzero(w)
    return Ensemble([rules[i] for i in used], [float(w[i]) for i in used], b)


def fit_list(x: np.ndarray, bad: np.ndarray, ids: np.ndarray) -> list[Rule]:
    """Ordered conjunctions for the rejected documents; what none of them covers is kept."""
    if not len(bad) or bad.min() == bad.max():
        return []
    cuts = thresholds(x)
    if not cuts:
        return []
    tests = [(j, side, t) for j, t in cuts for side in (True, False)]
    true = np.stack([holds((c,), x) for c in tests], axis=1)
    held = learn.folds(ids, 3) == 0
    left, out = np.ones(len(bad), bool), []
    while True:
        grow, prune = left & ~held, left & held
        rule, rows = [], grow
        while True:  # grow by FOIL's gain
            p, n = bad[rows].sum(), (~bad[rows]).sum()
            if p == 0 or n == 0:
                break
            p1, n1 = true[rows & bad].sum(axis=0), true[rows & ~bad].sum(axis=0)
            gain = np.where(p1 > 0, p1 * (np.log2(np.maximum(p1, 1) / np.maximum(p1 + n1, 1)) - np.log2(p / (p + n))), -1)
            k = int(np.argmax(gain))
            if gain[k] <= 1e-9:
                break
            rule.append(k)
            rows = rows & true[:, k]
        if not rule or bad[rows].sum() < 3:
            return out

        def worth(m: int) -> float:
            on = prune & true[:, rule[:m]].all(axis=1)
            p, n = bad[on].sum(), (~bad[on]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        size = max(range(1, len(rule) + 1), key=lambda m: (worth(m), -m))
        if worth(size) < 2 * PRECISION - 1:
            return out
        rule = rule[:size]
        out.append(tuple(tests[k] for k in rule))
        left &= ~true[:, rule].all(axis=1)


def decide(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, 0 where none does."""
    out = None
    for k, r in enumerate(rules, 1):
        out = F.when(condition(r), F.lit(k)) if out is None else out.when(condition(r), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, labels and ids of at most `most` labelled documents."""
    rows = learn.labelled(docs, labels, id_col, text_col, {"good": F.col("quality").cast("int")}, most)
    found = rows.toArrow().sort_by("id")
    return stats.of(common.as_array(found.column("text"))), found.column("good").to_numpy() > 0, found.column("id").to_numpy()


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score and keep of the whole documents table."""
    docs = common.load(spark, sf_dir, "documents")
    x, good, _ = sample(docs, common.load(spark, sf_dir, "labels"))
    scored = stats.table(docs).select("doc_id", fit_ensemble(x, good).score().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).alias("keep"))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the rule that decides (0: none) and keep of the whole documents table."""
    docs = common.load(spark, sf_dir, "documents")
    x, good, ids = sample(docs, common.load(spark, sf_dir, "labels"))
    ruled = stats.table(docs).select("doc_id", decide(fit_list(x, ~good, ids)).alias("rule"))
    return ruled.select("doc_id", "rule", (F.col("rule") == 0).alias("keep"))
