import bisect
import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import routing, upsert


def test_latest_and_tombstones(spark):
    df = spark.createDataFrame([(1, 1, False, "a"), (1, 3, False, "c"), (1, 2, False, "b"), (2, 1, False, "x"), (2, 2, True, None), (3, 1, None, "n")], "pk long, version long, deleted boolean, payload string")
    out = upsert.latest(df, ["pk"], [F.col("version").desc()], F.col("deleted"))
    assert sorted((r.pk, r.payload) for r in out.collect()) == [(1, "c"), (3, "n")]
    assert out.columns == df.columns
    assert sorted((r.pk, r.payload) for r in upsert.latest(df, ["pk"], [F.col("version").desc()]).collect()) == [(1, "c"), (2, None), (3, "n")]
    assert sorted(r.version for r in upsert.latest_of(df, ["pk"], "version", ["version"]).collect()) == [1, 2, 3]
    assert upsert.latest(df.limit(0), ["pk"], [F.col("version").desc()]).count() == 0


def test_queryable(spark):
    df = spark.range(10)
    assert upsert.queryable(df, spark.createDataFrame([(3,), (3,), (4,), (99,)], "id long"), ["id"]).count() == 2


def test_log_against_a_dict(spark):
    import random

    rng, live, log = random.Random(5), {}, []
    for seq in range(300):
        k = f"k{rng.randrange(40)}"
        if rng.random() < 0.3:
            live.pop(k, None)
            log.append((k, seq, None, True))
        else:
            live[k] = f"v{seq}"
            log.append((k, seq, live[k], False))
    df = spark.createDataFrame(log, "key string, seq long, value string, deleted boolean")
    assert {r.key: r.value for r in upsert.state(df).collect()} == live
    some = sorted(live)[0]
    assert upsert.get(df, some).first().value == live[some]
    assert upsert.get(df, "nobody").first() is None
    more = upsert.put(df, spark.createDataFrame([("new", 900, "v")], "key string, seq long, value string"))
    assert upsert.get(more, "new").first().value == "v"
    after, found = upsert.delete(more, spark.createDataFrame([("new", 901), ("nobody", 902)], "key string, seq long"))
    assert {r.key: r.found for r in found.collect()} == {"new": True, "nobody": False}
    assert upsert.get(after, "new").first() is None


def place(k):
    return int.from_bytes(hashlib.md5(k.encode()).digest()[:4], "big", signed=True)


def owner(k, names, virtual):
    ring = sorted((place(f"{n}-{i}"), n) for n in names for i in range(virtual))
    at = bisect.bisect_left(ring, (place(k), ""))
    return ring[at % len(ring)][1]


def test_ring_against_bisection(spark):
    keys = spark.range(2000).select(F.concat(F.lit("key"), "id").alias("k"))
    three, four = ["a", "b", "c"], ["a", "b", "c", "d"]
    got = routing.assign(keys, "k", routing.nodes(spark, three), 16).collect()
    assert len(got) == 2000
    for r in got:
        assert r.place == place(r.k) and r.node == owner(r.k, three, 16)
    moved = {r.k: (r.old_node, r.new_node) for r in routing.moved(keys, "k", routing.nodes(spark, three), routing.nodes(spark, four), 16).collect()}
    want = {f"key{i}": (owner(f"key{i}", three, 16), owner(f"key{i}", four, 16)) for i in range(2000)}
    assert moved == {k: v for k, v in want.items() if v[0] != v[1]}
    assert {v[1] for v in moved.values()} == {"d"}


def test_ring_wraps_and_rejects_clashes(spark):
    keys = spark.range(200).select(F.col("id").cast("string").alias("k"))
    got = routing.assign(keys, "k", routing.nodes(spark, ["only"]), 1)
    assert got.count() == 200 and got.select("node").distinct().count() == 1
    with pytest.raises(Exception, match="two virtual nodes"):
        routing.assign(keys, "k", routing.nodes(spark, ["x", "x"]), 2).collect()


def test_ring_leaves_the_callers_columns_alone(spark):
    keys = spark.createDataFrame([("a", 1, 2, 3)], "k string, low int, high int, cell int")
    got = routing.assign(keys, "k", routing.nodes(spark, ["x", "y"]), 4)
    assert got.columns == ["k", "low", "high", "cell", "place", "node", "vnode"] and tuple(got.first())[:4] == ("a", 1, 2, 3)
    with pytest.raises(ValueError, match="node"):
        routing.assign(keys.withColumn("node", F.lit(1)), "k", routing.nodes(spark, ["x"]), 4)


def test_latest_of_takes_one_row_at_ties(spark):
    rows = [(1, 5, "a", 1), (1, 5, "b", 2), (1, 4, "c", 3)]
    got = upsert.latest_of(spark.createDataFrame(rows, "k int, v int, s string, n int").repartition(3), ["k"], "v", ["s", "n"]).first()
    assert (got.s, got.n) in {("a", 1), ("b", 2)}
