"""Keyed upserts over immutable rows: the latest version of each key, tombstones, put/get/delete logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column], deleted: Column | None = None) -> DataFrame:
    """The last row of each key by `order` (descending expressions), without keys whose last row is deleted.

    Rows that tie on the whole order are told apart arbitrarily; give a unique last key.
    """
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order))
    flagged = df.withColumn("__rank", rank)
    if deleted is not None:
        flagged = flagged.withColumn("__gone", F.coalesce(deleted, F.lit(False)))
    out = flagged.where("__rank = 1")
    return (out.where("not __gone").drop("__gone") if deleted is not None else out).drop("__rank")


def latest_of(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """The same for a few columns by max_by: partial aggregation before the shuffle. All columns come from one row, at ties too."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    found = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(row, F.col(f"`{version}`")).alias("__row"))
    return found.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"__row.c{k}").alias(c) for k, c in enumerate(columns)])


def queryable(df: DataFrame, valid: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in the validity set."""
    return df.join(valid.select(*on).distinct(), on, "left_semi")


def get(log: DataFrame, key: str, key_column: str = "key", seq: str = "seq") -> DataFrame:
    """The live row of one key of a put/delete log with a boolean column `deleted`; no row if there is none."""
    return latest(log.where(F.col(key_column) == F.lit(key)), [key_column], [F.col(seq).desc()], F.col("deleted"))


def state(log: DataFrame, key_column: str = "key", seq: str = "seq") -> DataFrame:
    """All live rows of a put/delete log, last write winning."""
    return latest(log, [key_column], [F.col(seq).desc()], F.col("deleted"))


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with more rows, as puts."""
    return log.unionByName(rows.withColumn("deleted", F.lit(False)), allowMissingColumns=True)


def delete(log: DataFrame, keys: DataFrame, key_column: str = "key", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The log with tombstones for the keys (columns key and seq), and each key with whether it was found."""
    found = keys.join(state(log, key_column, seq).select(F.col(key_column), F.lit(True).alias("found")), key_column, "left")
    tombs = keys.select(key_column, seq).withColumn("deleted", F.lit(True))
    return log.unionByName(tombs, allowMissingColumns=True), found.select(key_column, F.coalesce("found", F.lit(False)).alias("found"))
