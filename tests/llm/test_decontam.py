import random

import numpy as np
import pyarrow as pa
from conftest import prose
from pyspark.sql import functions as F

from millrace.llm import common, decontam


def words(t):
    import re

    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def brute(docs, items):
    phrases = set()
    for t in items:
        w = words(t)
        if decontam.MIN_WORDS <= len(w) < decontam.PHRASE:
            phrases.add(tuple(w))
        phrases |= {tuple(w[i : i + decontam.PHRASE]) for i in range(len(w) - decontam.PHRASE + 1)}
    out = []
    for i, t in docs:
        w, hit = words(t), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit |= set(range(k, k + n))
        for k in sorted(hit):
            if k - 1 not in hit:
                end = k
                while end + 1 in hit:
                    end += 1
                out.append((i, k, end))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    items = [prose(50 + k, rng.randrange(3, 60)) for k in range(20)] + [None, "", "too short", prose(99, 8)]
    docs = []
    for k in range(60):
        w = prose(500 + k, rng.randrange(20, 200)).split(" ")
        if k % 2:
            for _ in range(rng.randrange(1, 4)):
                item = rng.choice([x for x in items if x]).split(" ")
                a = rng.randrange(len(item))
                at = rng.randrange(len(w))
                w[at:at] = item[a : a + rng.randrange(5, 60)]
        docs.append((k, " ".join(w)))
    return docs, items


def test_spans_against_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute(docs, items)
    assert want
    for most in (decontam.SLICE_BYTES, 800):
        known = decontam.slices(bench, most=most)
        assert (len(known) > 1) == (most == 800)
        assert sorted((r.doc_id, r.first_word, r.last_word) for r in decontam.spans(df, known).collect()) == want
    cleaned = decontam.clean(df, decontam.slices(bench))
    by = {r.doc_id: r.text for r in cleaned.collect()}
    for i, t in docs:
        gone = [(a, b) for d, a, b in want if d == i]
        w = words(t)
        assert words(by[i]) == [x for k, x in enumerate(w) if not any(a <= k <= b for a, b in gone)]
        if not gone:
            assert by[i] == t


def test_clean_does_not_depend_on_slices(spark, odd):
    docs, items = corpus()
    shared = prose(700, 20)
    more = [shared, f"{shared} {prose(701, 10)}", f"{prose(702, 9)} {shared} {prose(703, 9)}"]  # a template, and items that hold it
    items, docs = items + more, docs + [(100 + k, f"{prose(800 + k, 15)} {t} {prose(900 + k, 15)}") for k, t in enumerate(more)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text")).repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute(docs, items)
    for most in (decontam.SLICE_BYTES, 2000, 100):
        known = decontam.slices(bench, most=most)
        assert (len(known) > 1) == (most < decontam.SLICE_BYTES)
        rows = decontam.clean(df, known).collect()
        by = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(by) == len(docs) and all(r.n_chars == len(r.text) for r in rows)
        for i, t in docs:
            gone = [(a, b) for d, a, b in want if d == i]
            assert words(by[i]) == [x for k, x in enumerate(words(t)) if not any(a <= k <= b for a, b in gone)]
            assert gone or by[i] == t
    bench = spark.createDataFrame([(k, prose(2, 120)) for k in range(2)] + [(2, None)], "item_id long, text string")
    key = lambda known: sorted(map(repr, decontam.clean(odd, known).collect()))
    known = decontam.slices(bench, most=800)
    assert len(known) > 1 and key(known) == key(decontam.slices(bench)) and decontam.clean(odd, known).schema == odd.schema


def test_index_against_scan():
    rng = np.random.default_rng(0)
    for _ in range(150):
        x = rng.integers(0, 4, rng.integers(1, 80))
        x[-1] = 0
        index = decontam.Index(x, 3, int(rng.integers(1, 9)))
        m = rng.integers(1, 4, (20, 4)).astype(np.int32)
        m[:5, 0], m[:3, 1] = 0, 0
        got = {q: sorted(index.locate(np.arange(a, b)).tolist()) for q, a, b in zip(*index.search(m))}
        for q in range(20):
            p = m[q][m[q] > 0]
            assert got.get(q, []) == [s for s in range(len(x) - len(p) + 1) if (x[s : s + len(p)] == p).all()]
        suffix = index._sort(x, np.flatnonzero(x == 0), int((x == 0).sum()))
        assert sorted(suffix.tolist()) == list(range(len(x)))


def test_long_repetition_is_sorted():
    x = np.concatenate([np.ones(5000, np.int64), [0], np.ones(5000, np.int64), [0]])
    index = decontam.Index(x, 1)
    m = np.ones((1, 13), np.int32)
    _, lo, hi = index.search(m)
    assert hi[0] - lo[0] == 2 * (5000 - 12)
    assert sorted(index.locate(np.arange(lo[0], hi[0]))) == [*range(4988), *range(5001, 9989)]


def test_odd_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, prose(2, 120)), (2, None)], "item_id long, text string")
    known = decontam.slices(bench)
    got = {(r.doc_id, r.first_word) for r in decontam.spans(odd, known).collect()}
    assert got == {(8, 0), (9, 0), (None, 0)}
    out = decontam.clean(odd, known)
    assert out.schema.names == odd.schema.names and out.count() == odd.count()
    assert {(r.text, r.n_chars) for r in out.where("doc_id = 9").collect()} == {("." if prose(2, 120).endswith(".") else "", 0)} or len(words(out.where("doc_id = 9").first().text)) == 0
    assert out.where("doc_id = 1").first().text is None and out.where("doc_id = 2").first().text == ""
    assert decontam.spans(empty, known).count() == 0 and decontam.clean(empty, known).count() == 0
    none = decontam.slices(bench.limit(0))
    assert decontam.spans(odd, none).count() == 0 and decontam.clean(odd, none).count() == odd.count()


def test_cut_keeps_what_stands_between():
    t = pa.array(["Ä one, two three. four!", None, "x y z"])
    out = common.cut_words(t, np.array([0, 0, 2]), np.array([1, 4, 0]), np.array([3, 5, 1]))
    assert out.to_pylist() == ["Ä  three. !", None, " y z"]


def test_query_against_sql(spark):
    from checks import same

    import __spark_entry__ as entry

    same(spark, entry, "op2_decontaminate", "/root/testdata/sf0.001")
