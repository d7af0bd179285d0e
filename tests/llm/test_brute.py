"""The queries of the operators that learn, row by row against plain Python, and what they fit against its conditions."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common, langid, learn, rules, stats, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, [(r.doc_id, r.text or "") for r in docs.collect()]


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def hashed(word):
    data = np.frombuffer(word, np.uint8)
    return int(common.hash_spans(data, np.array([0]), np.array([len(data)]))[0])


def test_op3_against_plain_python(spark, tables):
    docs, _, texts = tables
    model = langid.train(docs)
    number = lambda v, salt: ((v * 2654435761 + salt) % (1 << 32)) >> 20

    def judge(text):
        data = bytes(32 if b in b"\n\r\t" else b for b in text.lower().encode())
        if not data.strip(b" "):
            return langid.UNKNOWN, langid.UNKNOWN
        hit = Counter()
        for i, x in enumerate(data):
            y, z = (data[i + 1 : i + 3] + b"  ")[:2]
            hit.update([number(x, 1), number(x << 8 | y, 77), number(x << 16 | y << 8 | z, 12345)])
        out = [sum(float(model.weights[f, j]) * n for f, n in hit.items()) / (3 * len(data)) + model.bias[j] for j in range(len(model.bias))]
        k = len(model.families)
        family = model.families[int(np.argmax(out[:k]))]
        inside, votes, margin = model.languages[family], Counter(), Counter()
        for p, (a, b) in enumerate(model.pairs):
            if a in inside:
                v = out[k + p]
                votes[a if v > 0 else b] += 1
                margin[a] += v
                margin[b] -= v
        return family, max(inside, key=lambda g: (votes[g], margin[g])) if len(inside) > 1 else inside[0]

    got = {r.doc_id: (r.family, r.language) for r in langid.op3_language_id(spark, SF).collect()}
    want = {i: judge(t) for i, t in texts}
    assert len(got) == len(texts) == len(want) and len(model.families) > 1
    assert sum(got[i] != want[i] for i in want) == 0


def test_op6_against_plain_python(spark, tables):
    docs, labels, texts = tables
    model = toxicity.train(docs, labels)
    place = {int(h): k for k, h in enumerate(model.vocabulary)}
    v = len(place)

    def judge(text):
        seen = Counter()
        for w in words(text):
            w = w.encode()
            for h in [hashed(w)] + [(hashed(w[:n]) + n) % (1 << 64) for n in toxicity.PREFIXES if len(w) > n]:
                if h in place:
                    seen[place[h]] += 1
        raw = text.encode()
        style = [sum(b in b"#$%&*|!" for b in raw) / max(1, len(raw)), sum(65 <= b <= 90 for b in raw) / max(1, len(raw)), math.log1p(len(words(text))) / 10]
        p = []
        for w, b in zip(model.weights, model.bias):
            z = b + sum(w[k] * math.log2(1 + n) for k, n in seen.items()) + sum(w[v + k] * s for k, s in enumerate(style)) + sum(w[v + 3 + k] * q for k, q in enumerate(p))
            p.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        return p

    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, SF).collect()}
    want = {i: judge(t) for i, t in texts}
    assert got and set(got) == {i for i, p in want.items() if p[-1] >= model.cut}
    for i, r in got.items():
        assert [r[f"p_{c}"] for c in toxicity.CHAIN] == pytest.approx(want[i], abs=1e-6)


def plain_statistics(text):
    w, n = words(text), len(text.encode())
    g, x = list(zip(w, w[1:], w[2:])), text.split("\n") if text else []
    share = lambda part, whole: part / max(1, whole)
    out = [n, len(w), share(sum(len(v.encode()) for v in w), len(w)), share(len(set(w)), len(w)), share(max(Counter(w).values(), default=0), len(w)), share(len(set(g)), len(g)), len(x), share(n, len(x)), share(len({v.strip(" \t\r\x0b\x0c") for v in x}), len(x))]
    return out + [share(sum(b in set(c) for b in text.encode()), n) for c in stats._CLASSES.values()]


def on(rule, x):
    return all(x[j] <= t if at_most else x[j] > t for j, at_most, t in rule)


def test_op7_and_op8_against_plain_python(spark, tables):
    docs, labels, texts = tables
    good = {r.doc_id: r.quality for r in labels.collect()}
    known = [(i, t) for i, t in texts if good.get(i) is not None]
    x = np.array([plain_statistics(t) for _, t in known])
    assert stats.of(pa.array([t for _, t in known])) == pytest.approx(x)
    x = stats.of(pa.array([t for _, t in known]))  # the same to the last bit
    y, ids = np.array([good[i] > 0 for i, _ in known]), np.array([i for i, _ in known])
    ensemble, ordered = rules.fit_ensemble(x, y), rules.fit_list(x, ~y, ids)
    got7 = {r.doc_id: r for r in rules.op7_rule_ensemble(spark, SF).collect()}
    got8 = {r.doc_id: r for r in rules.op8_decision_list(spark, SF).collect()}
    assert len(got7) == len(got8) == len(texts)
    all_ = stats.of(pa.array([t for _, t in texts]))
    for (i, _), s in zip(texts, all_):
        z = ensemble.bias + sum(w for r, w in zip(ensemble.rules, ensemble.weights) if on(r, s))
        assert got7[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and got7[i].keep == (got7[i].score >= 0.5)
        first = next((k for k, r in enumerate(ordered, 1) if on(r, s)), 0)
        assert (got8[i].rule, got8[i].keep) == (first, first == 0)


def small_sample(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((240, 4))
    return x, (x[:, 1] > 0.6) & (x[:, 2] < 0.7)


def test_lasso_meets_its_optimality_conditions():
    x, y = small_sample()
    w, b = learn.lasso_logistic(x - 0.5, y.astype(float), 0.02, rounds=3000)
    r = learn.sigmoid((x - 0.5) @ w + b) - y
    grad = (x - 0.5).T @ r / len(y)
    assert abs(r.mean()) < 1e-3 and (w != 0).any() and (w == 0).any()
    for g, v in zip(grad, w):
        assert abs(g) <= 0.02 + 1e-3 if v == 0 else abs(g + 0.02 * np.sign(v)) < 1e-3


def test_svm_meets_its_optimality_conditions():
    x, y = small_sample(1)
    y = np.where(y, 1.0, -1.0)
    w, b = learn.linear_svm(x, y, lam=1e-2, rounds=5000)
    s = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    miss = np.maximum(0, 1 - y * (x @ w + b))
    assert np.abs(1e-2 * w - 2 * (s * y * miss) @ x).max() < 1e-3 and abs((s * y * miss).sum()) < 1e-3


def test_trees_split_best_and_lists_cover_by_gain():
    x, bad = small_sample(2)
    cuts = rules.thresholds(x)
    found = rules.paths(x, bad.astype(float))
    roots = {r[0][::2] for r in found if len(r) == 1}
    assert roots and roots <= {(j, t) for j, t in cuts} and all(len(r) <= rules.DEPTH for r in found)
    first = rules.fit_list(x, bad, np.arange(len(bad)))[0]
    grow = learn.folds(np.arange(len(bad)), 3) != 0

    def gain(rows, c):
        on_ = rows & rules.holds((c,), x)
        p, n, p1, n1 = (rows & bad).sum(), (rows & ~bad).sum(), (on_ & bad).sum(), (on_ & ~bad).sum()
        return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n))) if p1 else -1.0

    rows = grow
    for c in first:  # each condition has the largest gain of all where it was added
        assert gain(rows, c) == pytest.approx(max(gain(rows, (j, side, t)) for j, t in cuts for side in (True, False)))
        rows = rows & rules.holds((c,), x)
