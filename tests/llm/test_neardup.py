import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from millrace.llm import neardup


def near(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def corpus():
    docs, k = [], 0
    for g in range(60):
        base = prose(100 + g, 150)
        docs.append((k, base))
        k += 1
        for c in range(g % 4):
            docs.append((k, near(base, 1000 * g + c, (0.0, 0.03, 0.08, 0.2)[c])))
            k += 1
    docs += [(k + i, prose(7, 200)) for i in range(300)]  # a large group of exact copies
    docs += [(k + 300 + i, near(prose(7, 200), i, 0.02)) for i in range(60)]
    return docs


def jaccards(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    holders, pairs = {}, {}
    for i in sets:
        for g in sets[i]:
            for j in holders.setdefault(g, []):
                pairs[i, j] = pairs.get((i, j), 0) + 1
            holders[g].append(i)
    return {(i, j): n / (len(sets[i]) + len(sets[j]) - n) for (i, j), n in pairs.items()}


def test_groups_against_all_pairs(spark, corpus):
    got = {r.doc_id: r for r in neardup.groups(spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)).collect()}
    pairs = [p for p, j in jaccards(corpus).items() if j >= neardup.THRESHOLD]
    hit = sum(a in got and b in got and got[a].group_id == got[b].group_id for a, b in pairs)
    assert hit >= 0.98 * len(pairs)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    for d, r in got.items():  # nothing is grouped that similarity does not connect
        assert find(d) == find(r.group_id)
        assert r.keep == (r.doc_id == r.group_id)


def test_partners_unlike_their_leader_are_compared(spark):
    a, b = prose(1, 60), prose(2, 60)
    mix = a + " " + b  # half like either, so a band may be shared without the threshold being reached
    docs = [(1, mix), (2, near(a, 1, 0.02)), (3, near(a, 2, 0.02)), (4, near(b, 3, 0.02)), (5, near(b, 4, 0.02))]
    got = {r.doc_id: r.group_id for r in neardup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2] == got[3] and got[4] == got[5] and got[2] != got[4]


@pytest.mark.parametrize("kin", [False, True])
def test_templates_cost_pairs_in_proportion(spark, monkeypatch, kin):
    """Documents of one template, too unlike to be linked, and a few alike among them."""
    tried = []
    whole = neardup._compare
    monkeypatch.setattr(neardup, "_compare", lambda pairs, *rest: (tried.append(pairs.count()), whole(pairs, *rest))[1])
    cost = []
    for n in (100, 400):
        tried.clear()
        docs = [(k, prose(1, 60) + " " + " ".join(f"w{k}x{i}" for i in range(40))) for k in range(n)]
        if kin:  # every tenth is much like the one before it
            docs = [(k, near(docs[k - 1][1], k, 0.05) if k % 10 == 9 else t) for k, t in docs]
        got = {r.doc_id: r.group_id for r in neardup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        want = sorted(b for (a, b), j in jaccards(docs).items() for b in (a, b) if j >= neardup.THRESHOLD)
        assert sorted(got) == want and all(got[k] in (k, k - 1) for k in got)
        cost.append(sum(tried))
    assert cost[1] < 4 * 1.5 * cost[0] and cost[1] < 12 * 400


def test_posterior_bounds():
    need = neardup.least_matches(0.6, 0.01)
    assert len(need) == neardup.HASHES // neardup.BATCH and need == sorted(need)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 30, (4000, neardup.HASHES)).astype(np.uint32)
    for s, low, high in ((0.6, 0.985, 1.0), (0.3, 0.0, 0.02), (0.9, 1.0, 1.0)):
        b = np.where(rng.random(a.shape) < s, a, a + 1)
        kept = len(neardup.survivors(a, b, need)) / len(a)
        assert low <= kept <= high


def test_signatures_estimate_similarity():
    base = prose(5, 600)
    t = pa.array([base, near(base, 1, 0.05)])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), t], names=["id", "text"])
    out = next(neardup._signatures(batch))
    sig = np.frombuffer(b"".join(out.column("sig").to_pylist()), np.uint32).reshape(2, -1)
    true = jaccards([(1, base), (2, near(base, 1, 0.05))])[2, 1]
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12


def test_odd_tables(spark, odd, empty):
    got = {r.doc_id: r.group_id for r in neardup.groups(odd).collect()}
    assert got == {8: 8, 9: 8}  # null and wordless texts and null ids are in no group
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    assert kept.count() == odd.count() - 1 and kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 8").count() == 2
    assert neardup.groups(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_short_texts(spark):
    docs = spark.createDataFrame([(1, "Hello World"), (2, "hello, world!"), (3, "hello"), (4, "hello there"), (5, "HELLO")], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in neardup.groups(docs).collect()} == {1: 1, 2: 1, 3: 3, 5: 3}


def test_recall_just_above_the_threshold(spark):
    docs, pairs = [], []
    for k in range(400):
        base = prose(3000 + k, 150)
        two = [(2 * k, base), (2 * k + 1, near(base, k, 0.105))]
        if 0.5 <= next(iter(jaccards(two).values())) < 0.6:
            docs += two
            pairs.append(2 * k)
    got = {r.doc_id: r.group_id for r in neardup.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    hit = sum(got.get(a) == got.get(a + 1) == a for a in pairs)
    assert len(pairs) >= 150 and hit >= 0.92 * len(pairs)
