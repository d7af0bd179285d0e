"""Two explicit range indexes: equi-depth ranges as partitions of a stored table, and bit slices.

Parquet's own statistics serve sorted tables. These serve a column that the table is not sorted by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import ingest

MOST = 20


def boundaries(df: DataFrame, column: str, most: int = MOST) -> list[float]:
    """At most `most` - 1 values that cut the column into ranges of about as many rows each."""
    shares = F.array(*[F.lit(k / most) for k in range(1, most)])
    found = df.agg(F.percentile_approx(F.col(f"`{column}`").cast("double"), shares, 10_000).alias("q")).first()[0]
    return sorted(set(found or []))


def write_ranged(df: DataFrame, path: str, column: str, most: int = MOST) -> list[float]:
    """Store df with a directory for each range of the column; range k holds values above bound k - 1 up to bound k."""
    bounds = boundaries(df, column, most)
    c = F.col(f"`{column}`")
    number = sum((F.when(c > b, 1).otherwise(0) for b in bounds), F.lit(0))
    ingest.write(df.withColumn("range_id", number.cast("int")), path, ingest.Layout(sort=(column,), partition=("range_id",)))
    return bounds


def between(spark: SparkSession, path: str, bounds: list[float], column: str, low: float, high: float) -> DataFrame:
    """Rows with low <= column <= high: ranges that lie inside are taken whole, the two at the ends are looked through, the rest is not read."""
    edges = [float("-inf"), *bounds, float("inf")]
    whole = [k for k in range(len(edges) - 1) if edges[k] >= low and edges[k + 1] <= high]
    ends = [k for k in range(len(edges) - 1) if k not in whole and edges[k] < high and edges[k + 1] >= low]
    c, number = F.col(f"`{column}`"), F.col("range_id")
    hit = (number.isin(whole) & c.isNotNull()) | (number.isin(ends) & (c >= low) & (c <= high))
    return ingest.read(spark, path).where(number.isin([*whole, *ends])).where(hit).drop("range_id")


def bit_slices(df: DataFrame, position: str, column: str, bits: int = 63) -> DataFrame:
    """block, bit, map: for every 32,768 positions a bitmap for each bit of the column's values, and one (bit -1) of the rows that have any.

    position: whole numbers from 1, different for each row; the column: whole numbers of 0 and more, others raise.
    """
    p, v = F.col(f"`{position}`").cast("long"), F.col(f"`{column}`").cast("long")
    v = F.when(v < 0, F.raise_error(F.lit(f"{column} has a negative value")).cast("long")).otherwise(v)
    set_ = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.getbit(v, b) == 1)
    each = df.where(v.isNotNull()).select(F.bitmap_bucket_number(p).alias("block"), F.bitmap_bit_position(p).alias("at"), F.explode(F.concat(F.array(F.lit(-1)), set_)).alias("bit"))
    return each.groupBy("block", "bit").agg(F.bitmap_construct_agg("at").alias("map"))


def sliced_between(slices: DataFrame, low: int, high: int) -> DataFrame:
    """position of every row with low <= value <= high, from the slices alone; nothing is looked up in the table."""

    def below(maps: dict[int, np.ndarray], top: int) -> np.ndarray:
        """Rows whose value is at most top."""
        some = maps[-1]
        if top < 0:
            return np.zeros_like(some)
        less, same = np.zeros_like(some), some.copy()
        for b in range(max(max(maps), top.bit_length()), -1, -1):
            m = maps.get(b, np.zeros_like(some))
            if top >> b & 1:
                less |= same & ~m
                same &= m
            else:
                same &= ~m
        return less | same

    def fn(key, table):
        maps = {b: np.frombuffer(m, np.uint8) for b, m in zip(table.column("bit").to_pylist(), table.column("map").to_pylist())}
        hit = np.flatnonzero(np.unpackbits(below(maps, high) & ~below(maps, low - 1), bitorder="little"))
        return pa.table({"position": pa.array(hit + (key[0].as_py() - 1) * 32768 + 1)})

    return slices.groupBy("block").applyInArrow(fn, "position long")
