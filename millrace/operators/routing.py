"""Consistent-hash routing of keys to nodes.

A place on the ring is the first four bytes of a key's MD5, as a signed integer. A node has some
virtual nodes, `name-0`, `name-1` and so on; a key belongs to the first virtual node at its place or
after it, else to the first of all. The ring is cut into equal cells, so that owners come from a hash join
on the cell with a range check, not from comparing every key with every virtual node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a ring, as estimated, up to which it is broadcast for the join.
MAX_BROADCAST = 64 << 20
_LEAST, _MOST = -(1 << 31), (1 << 31) - 1


def place(key: Column) -> Column:
    x = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


def nodes(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def ring(members: DataFrame, virtual: int) -> DataFrame:
    """node, vnode, low, high: each virtual node with the half-open range (low, high] of places that it owns.

    The first one also owns what lies beyond the last, as a second range. Two virtual nodes at one
    place raise when the ring is used.
    """
    each = members.select("node", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("i"))
    each = each.select("node", F.concat_ws("-", "node", "i").alias("vnode"))
    sorted_ = each.agg(F.sort_array(F.collect_list(F.struct(place(F.col("vnode")).alias("high"), "vnode", "node"))).alias("ring"))

    def owned(x: Column, i: Column) -> Column:
        before = F.get(F.col("ring"), i - 1)["high"]
        clash = F.raise_error(F.concat(F.lit("two virtual nodes at the place of "), x["vnode"])).cast("long")
        low = F.when(i == 0, F.lit(_LEAST - 1)).when(before == x["high"], clash).otherwise(before)
        return F.struct(x["node"].alias("node"), x["vnode"].alias("vnode"), low.alias("low"), x["high"].alias("high"))

    first, last = F.get(F.col("ring"), F.lit(0)), F.element_at("ring", -1)
    wrap = F.struct(first["node"].alias("node"), first["vnode"].alias("vnode"), last["high"].alias("low"), F.lit(_MOST).alias("high"))
    ranges = F.concat(F.transform("ring", owned), F.array(wrap))
    return sorted_.where(F.size("ring") > 0).select(F.inline(ranges)).where("low < high")


#: The ring has 2 to the power of CELL_BITS equal cells.
CELL_BITS = 12


def _owners(members: DataFrame, virtual: int) -> DataFrame:
    """The ring with a row for every cell that a range touches, under names of its own."""
    shift = 32 - CELL_BITS
    r = ring(members, virtual)
    cells = F.explode(F.sequence(F.shiftright(F.col("low") + 1, shift), F.shiftright("high", shift)))
    r = r.select(*[F.col(c).alias(f"__ring_{c}") for c in ("node", "vnode", "low", "high")], cells.alias("__ring_cell"))
    size = int(members._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) * (virtual + 1)
    return F.broadcast(r) if size <= MAX_BROADCAST else r


def _join(keys: DataFrame, owners: DataFrame, at: Column) -> DataFrame:
    """keys with the owners' columns; at: the place of a key."""
    placed = keys.withColumn("__ring_place", at).withColumn("__ring_at", F.shiftright("__ring_place", 32 - CELL_BITS))
    hit = (F.col("__ring_at") == F.col("__ring_cell")) & (F.col("__ring_place") > F.col("__ring_low")) & (F.col("__ring_place") <= F.col("__ring_high"))
    return placed.join(owners, hit)


def assign(keys: DataFrame, key_column: str, members: DataFrame, virtual: int) -> DataFrame:
    """keys with the columns place, node and vnode, which keys must not have yet."""
    clash = {"place", "node", "vnode"} & {c.lower() for c in keys.columns}
    if clash:
        raise ValueError(f"the keys have columns {', '.join(sorted(clash))} already")
    found = _join(keys, _owners(members, virtual), place(F.col(f"`{key_column}`")))
    return found.select(*[F.col(f"`{c}`") for c in keys.columns], *[F.col(f"__ring_{c}").alias(c) for c in ("place", "node", "vnode")])


def moved(keys: DataFrame, key_column: str, before: DataFrame, after: DataFrame, virtual: int) -> DataFrame:
    """Keys that change their node between two rings: key, old_node and new_node."""
    key = F.col(f"`{key_column}`")
    a = _join(keys.select(key), _owners(before, virtual), place(key)).select(key, F.col("__ring_node").alias("__old"), F.col("__ring_place").alias("__place"))
    b = _join(a, _owners(after, virtual), F.col("__place"))
    return b.select(key, F.col("__old").alias("old_node"), F.col("__ring_node").alias("new_node")).where("old_node <> new_node")
