import random
import re

import numpy as np
import pyarrow as pa
from conftest import prose

from millrace.llm import common, substring


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def brute(docs, size):
    where = {}
    for k, (i, t) in enumerate(docs):
        w = words(t)
        for p in range(len(w) - size + 1):
            where.setdefault(tuple(w[p : p + size]), []).append((i is not None, i or 0, p, k))
    out = set()
    for kind in ("repeat", "remove"):
        cover = {}
        for places in where.values():
            if len(places) > 1:
                for has, i, p, _ in sorted(places)[kind == "remove" :]:
                    cover.setdefault(i if has else None, set()).update(range(p, p + size))
        for i, c in cover.items():
            for p in sorted(c):
                if p - 1 not in c:
                    end = p
                    while end + 1 in c:
                        end += 1
                    out.add((i, kind, p, end))
    return out


def corpus():
    rng = random.Random(8)
    passages = [prose(700 + k, rng.randrange(50, 120)) for k in range(12)]
    docs = []
    for k in range(80):
        w = prose(900 + k, rng.randrange(10, 150)).split(" ")
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(passages).split(" ")
        docs.append((k, " ".join(w)))
    return [*docs, (200, docs[0][1]), (201, docs[0][1]), (202, "And " * 130), (203, None), (204, "")]


def test_spans_against_brute_force_both_ways(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for window, gram in ((50, 8), (20, 5)):
        want = brute(docs, window)
        assert want
        for limit in (substring.BROADCAST_BYTES, 0):
            got = {(r.doc_id, r.kind, r.first_word, r.last_word) for r in substring.spans(df, window=window, gram=gram, limit=limit).collect()}
            assert got == want


def test_anchors_never_count_less_than_windows():
    t = pa.array([t for _, t in corpus()])
    least, full, pos, doc = substring.anchors(t, 20, 5)
    chosen = substring.chosen(t, 20, 5)
    anchor, n = np.unique(chosen, return_counts=True)
    count = dict(zip(anchor.tolist(), n.tolist()))
    window, at, m = np.unique(full, return_index=True, return_counts=True)
    assert all(count[least[a]] >= k for a, k in zip(at, m))
    assert len(chosen) < len(full) / 3


def test_sketch_never_underestimates(spark):
    df = common.only(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4), "doc_id", "text")
    anchor, n = np.unique(substring.chosen(pa.array([t for _, t in corpus()]), 50, 8), return_counts=True)
    for bits in (6, 12, 24):  # two shards and more at the last
        cells = substring.sketch(df, bits, 50, 8).toPandas()
        for row in range(substring.DEPTH):
            known = set(cells[cells.row == row].cell)
            assert all(c in known for c in substring.cells(anchor[n > 1], row, bits).tolist())
        if bits == 24:
            assert len(known) < 1.2 * (n > 1).sum() + 5


def test_odd_tables(spark, odd, empty):
    got = {(r.doc_id, r.kind) for r in substring.spans(odd).collect()}
    assert got == {(8, "repeat"), (8, "remove"), (9, "repeat"), (9, "remove"), (None, "repeat"), (12, "repeat"), (12, "remove")}
    assert substring.spans(empty).count() == 0
    assert substring.spans(odd, limit=0).count() == substring.spans(odd).count()


def test_query_against_sql(spark):
    from checks import same

    import __spark_entry__ as entry

    same(spark, entry, "op4_substring_dedup", "/root/testdata/sf0.001")


def test_windows_of_one_hash_and_two_anchors_are_told_apart():
    def rows(*places):
        anchor, ids, h = zip(*places)
        n = len(places)
        columns = [pa.array(anchor, pa.int64()), pa.array(ids, pa.int64()), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([np.uint64(x).tobytes() for x in h], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "pos", "n", "hashes"])

    def found(*batches):
        return sorted((i, k) for b in substring._repeats(iter(batches)) for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    assert found(rows((1, 10, 7), (2, 20, 7), (3, 30, 7))) == []
    assert found(rows((1, 10, 7), (2, 20, 7), (2, 21, 7), (3, 30, 7), (3, 31, 8))) == [(20, 0), (21, 0), (21, 1)]
    assert found(rows((1, 10, 7), (2, 20, 7)), rows((2, 21, 7), (3, 22, 7))) == [(20, 0), (21, 0), (21, 1)]
