import re

import numpy as np
import pyarrow as pa
from conftest import prose

from millrace.llm import common


def test_words_against_a_pattern():
    texts = ["Hello, World! it's 42", "", None, "été à-côté", "日本語 x", "  ", "a_b", prose(3, 500)]
    w = common.words(pa.array(texts))
    for d, t in enumerate(texts):
        want = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]])]
        assert got == want
    h = w.hashes()
    words = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
    assert len(set(h.tolist())) == len(set(words))


def test_grams_are_equal_where_runs_are():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 13, 50):
        g = common.grams(h, k)[: len(h) - k + 1]
        runs = [h[i : i + k].tobytes() for i in range(len(h) - k + 1)]
        first = {}
        for i, r in enumerate(runs):
            assert g[i] == g[first.setdefault(r, i)]
        assert len(set(g.tolist())) == len(set(runs))


def test_runs_against_sets():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = rng.integers(0, 12)
        lo, group = rng.integers(0, 40, n), rng.integers(0, 3, n)
        hi = lo + rng.integers(1, 9, n)
        a, b, g = common.runs(lo, hi, group)
        cover = lambda x, y, z: {(k, i) for p, q, k in zip(x, y, z) for i in range(p, q)}
        assert cover(a, b, g) == cover(lo, hi, group)
        assert all(g[i] != g[i + 1] or b[i] < a[i + 1] for i in range(len(a) - 1))


def test_whole_groups():
    t = pa.table({"k": [None, None, 1, 1, 1, 2, 3, 3, 4], "v": list(range(9))})
    for size in (1, 2, 3, 4, 9):
        got = [x.column("v").to_pylist() for x in common.whole_groups(iter(t.to_batches(size)))]
        assert sum(got, []) == list(range(9))
        for part in got:
            keys = {t.column("k")[v].as_py() for v in part}
            for k in keys:
                assert [v for v in range(9) if t.column("k")[v].as_py() == k] == [v for v in part if t.column("k")[v].as_py() == k]


def test_components_against_union_find(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_folder_and_unstash(spark):
    import os

    df = common.stash(spark.range(5))
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert df.count() == 5 and os.path.isdir(folder)
    common.unstash(df)
    assert not os.path.isdir(folder)
