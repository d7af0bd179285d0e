import random

import numpy as np
import pytest
from conftest import odd_rows
from pyspark.sql import functions as F

from millrace.llm import common, lines


def brute(docs):
    """docs: (doc_id, text) with distinct ids."""
    first = {}
    for i, t in sorted((d for d in docs if d[1]), key=lambda d: (d[0] is None, d[0] or 0)):
        for k, x in enumerate(t.split("\n")):
            first.setdefault(x.strip(" \t\r\x0b\x0c"), (i, k))
    out = {}
    for i, t in docs:
        if not t:
            out[i] = (t, 0, 0)
            continue
        parts = t.split("\n")
        kept = [x for k, x in enumerate(parts) if not x.strip(" \t\r\x0b\x0c") or first[x.strip(" \t\r\x0b\x0c")] == (i, k)]
        out[i] = ("\n".join(kept), len(parts), len(parts) - len(kept))
    return out


def corpus():
    rng = random.Random(3)
    pool = ["", "  ", "menu", " menu\t", "Über uns", "日本", *[f"line {k}" for k in range(60)]]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(150)]
    return [*docs, (900, None), (901, ""), (902, "\n"), (903, "\n\nonly\n"), (904, "menu")]


@pytest.mark.parametrize("probes", [lines.PROBES, 20])
def test_dedup_against_brute_force(spark, probes):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup(df, tally=True, shard_lines=16, probes=probes).collect()}
    assert got == brute(docs)
    keyed, row = common.numbered(df)
    index = lines.Index(common.stash(lines.hashed(lines._rows(keyed, row, "doc_id", "text"))), 16, probes)
    distinct = {x.strip(" \t\r\x0b\x0c") for _, t in docs if t for x in t.split("\n")} - {""}
    table = index.table.collect()
    assert index.shards > 1 and sum(len(r.firsts) // 8 for r in table) == len(distinct)  # all distinct lines, not only repeated ones
    assert (index.busy.count() > 0) == (probes == 20)


def test_emptied_documents(spark):
    docs = [(1, "a b\nc d"), (2, "c d\n\na b"), (3, "c d\nnew"), (4, ""), (5, None), (6, " \n ")]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string"), emptied=False).collect()}
    assert got == {1: "a b\nc d", 3: "new", 4: "", 5: None, 6: " \n "}


def probe_of(h, c):
    sizes, bits, ranks, slot = lines.build(h, c)
    by = np.argsort(slot)
    return slot, bits, lines.Probe({"sizes": sizes, "bits": bits.tobytes(), "ranks": ranks.tobytes(), "prints": c[by].tobytes(), "counts": np.ones(len(h), np.uint32).tobytes(), "firsts": np.zeros(len(h), np.int64).tobytes()})


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    c = rng.integers(0, 1 << 32, len(h)).astype(np.uint32)
    slot, bits, probe = probe_of(h, c)
    assert sorted(slot.tolist()) == list(range(len(h)))
    assert bits.nbytes * 8 < 6 * len(h)
    assert (probe.slots(h, c) == slot).all()
    strange = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert (probe.slots(strange, c[:20_000]) >= 0).sum() < 10
    assert (probe.slots(h, c + np.uint32(1)) == -1).all()
    assert lines.build(np.zeros(0, np.uint64), np.zeros(0, np.uint32))[0] == []


def test_lines_of_one_first_hash_are_told_apart():
    h, c = np.full(3, 77, np.uint64), np.arange(3, dtype=np.uint32)
    slot, _, probe = probe_of(h, c)
    assert sorted(slot.tolist()) == [0, 1, 2] and (probe.slots(h, c) == slot).all()


def test_both_hashes_tell_spans():
    data = np.frombuffer(b"abcdefghijabcdefghiXabcdefgh\0\0", np.uint8)
    start, end = np.array([0, 10, 20, 20, 20, 0]), np.array([10, 20, 28, 29, 30, 10])
    for x in (common.hash_spans(data, start, end), *common.hash_spans_twice(data, start, end)):
        assert len(set(x.tolist())) == 5 and x[0] == x[5]


def test_odd_tables(spark, odd, empty):
    out = lines.dedup(odd.withColumn("__ROW", F.lit("a")).withColumn("__gone", F.lit("b")))
    assert out.columns == [*odd.columns, "__ROW", "__gone"] and out.count() == odd.count()
    assert {(r["__ROW"], r["__gone"]) for r in out.collect()} == {("a", "b")}
    out = lines.dedup(odd)
    assert out.schema.names == odd.schema.names
    rows = {}
    for r in out.collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows[1][0].text is None and rows[2][0].text == "" and rows[3][0].text == " \t\n \n"
    assert rows[11][0].text == "\n\n\nsame line here\n\n" and rows[11][0].n_chars == len(rows[11][0].text)
    text = next(t for i, t, *_ in odd_rows() if i == 8)
    assert sorted(r.text for r in rows[8]) == ["", text]  # one of the rows of one doc_id keeps all lines
    assert rows[9][0].text == "" and {r.text for r in rows[None]} == {None, ""}
    assert lines.dedup(empty).count() == 0
    nulls = spark.createDataFrame([(None, "x\ny")] * 5, "doc_id long, text string").repartition(3)
    assert sorted(r.text for r in lines.dedup(nulls).collect()) == ["", "", "", "", "x\ny"]


def test_query_against_sql(spark):
    from checks import same

    import __spark_entry__ as entry

    same(spark, entry, "op9_line_dedup", "/root/testdata/sf0.001")
