"""CSV in by declared schema, Parquet out with the layout that scans profit from, and column statistics."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.schema import Field, Schema


def _cell(token: Column, f: Field) -> Column:
    base = f.spark_type if f.single else f.spark_type.elementType
    kind = base.simpleString()

    def parse(x: Column) -> Column:
        if f.kind in ("STRING", "BYTES"):
            return x.cast(kind)  # text is taken as it is
        return F.trim(x).cast(kind)  # in ANSI mode a cell that is no number raises

    return parse(token) if f.single else F.transform(F.split(token, ";"), parse)



def _default(f: Field) -> Column:
    d = F.lit(f.missing).cast(f.spark_type.simpleString() if f.single else f.spark_type.elementType.simpleString())
    return d if f.single else F.array(d)


def read_csv(spark: SparkSession, path: str, schema: Schema, delimiter: str = ",") -> DataFrame:
    """Rows of a CSV with a header, bound by name, in schema order.

    No quoting; blank lines are skipped; columns that the schema lacks are ignored; an empty cell or
    one missing at the end of a line takes the field's default; cells of multi-value fields are split
    at `;`. A schema column that the header lacks raises.
    """
    options = {"header": True, "sep": delimiter, "quote": "", "escape": "", "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "inferSchema": False}
    raw = spark.read.options(**options).csv(path)
    absent = [f.name for f in schema.fields if f.name not in raw.columns]
    if absent:
        raise ValueError(f"the header of {path} lacks {', '.join(absent)}")
    cells = []
    for f in schema.fields:
        token = F.col(f"`{f.name}`")
        cells.append(F.when(token.isNull() | (token == ""), _default(f)).otherwise(_cell(token, f)).alias(f.name, metadata={"role": f.role}))
    return raw.select(*cells)


def fill_defaults(df: DataFrame, schema: Schema) -> DataFrame:
    """df with the schema's columns, nulls replaced by the fields' defaults."""
    return df.select(*[F.coalesce(F.col(f"`{f.name}`").cast(f.spark_type), _default(f)).alias(f.name, metadata={"role": f.role}) for f in schema.fields])


@dataclass(frozen=True)
class Layout:
    """How a table is stored.

    sort: rows of each file are in this order, so that row groups and pages cover narrow ranges (the
    part of sorted and range indexes). bloom: columns with Bloom filters for equality. distinct: how
    many different values to size them for, one number for all or one for each column by name; None
    is Parquet's own guess. partition: directory columns. files: how many at least, by range of the
    directory and sort columns; 0 leaves the partitions as they are. file_bytes: where so many files would
    hold more than this of rows as Spark holds them in memory, there are as many more as it takes, and
    rows of one key may lie in several; a task sorts a file, so this bounds what it holds. encoding: the
    compression.
    """

    sort: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()
    partition: tuple[str, ...] = ()
    files: int = 0
    distinct: int | dict[str, int] | None = None
    row_group_bytes: int | None = None
    encoding: str = "zstd"
    file_bytes: int = 128 << 20


def _bytes(df: DataFrame) -> int:
    """What the rows take in memory: eight bytes a column and what texts, bytes and nested values take besides. A pass over df."""
    nested = lambda c, t: c.cast("string") if t.startswith(("struct", "map")) else c
    wide = [F.octet_length(nested(F.col(f"`{c}`"), t)) for c, t in df.dtypes if t.startswith(("string", "char", "varchar", "binary", "struct", "map"))]
    each = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(8 * (len(df.columns) + 1 + len(wide))).cast("long"))
    return df.agg(F.sum(each)).first()[0] or 0


def write(df: DataFrame, path: str, layout: Layout = Layout(), mode: str = "errorifexists") -> None:
    """Store df. Where the layout asks for files, df is read once before to size them."""
    if any(t.startswith("array") for _, t in df.dtypes):
        raise ValueError("multi-value columns cannot be stored")
    keys = [*layout.partition, *layout.sort]
    files = layout.files and max(layout.files, -(-_bytes(df) // layout.file_bytes))
    if files and keys:
        cuts = [F.col(f"`{c}`") for c in keys]
        if files > layout.files:  # a key of many rows is cut as well, by the hash of what can be hashed
            cuts.append(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]))
        df = df.repartitionByRange(files, *cuts)
    elif files:
        df = df.repartition(files)
    if keys:
        df = df.sortWithinPartitions(*[F.col(f"`{c}`") for c in keys])
    out = df.write.mode(mode).option("compression", layout.encoding)
    for c in layout.bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        expected = layout.distinct.get(c) if isinstance(layout.distinct, dict) else layout.distinct
        if expected:
            out = out.option(f"parquet.bloom.filter.expected.ndv#{c}", str(expected))
    if layout.row_group_bytes:
        out = out.option("parquet.block.size", str(layout.row_group_bytes))
    (out.partitionBy(*layout.partition) if layout.partition else out).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); in local mode a temporary one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{found.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """A table of one or more stored parts."""
    return spark.read.parquet(*paths)


def metadata_only(spark: SparkSession) -> SparkSession:
    """A session of its own in which COUNT, MIN and MAX without a filter are answered from Parquet footers."""
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    return own


def statistics(df: DataFrame) -> DataFrame:
    """For each column: name, docs, cardinality, min, max (as text) and the most values in a cell.

    Each column is scanned by itself, so wide tables are never expanded by the number of columns.
    """
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        v = F.explode_outer(c) if kind.startswith("array") else None
        one = df.select((v if v is not None else c).alias("v"), (F.size(c) if v is not None else F.lit(1)).alias("n"))
        parts.append(one.agg(F.lit(name).alias("column"), F.count(F.lit(1)).alias("values"), F.countDistinct("v").alias("cardinality"), F.min("v").cast("string").alias("min"), F.max("v").cast("string").alias("max"), F.max("n").alias("most_in_cell")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def is_sorted(df: DataFrame, column: str, order: str) -> DataFrame:
    """One row, `sorted`: whether the column never falls along the order column.

    Each value is compared with the greatest before it; partitions are cut by range of the order
    column and compared by their ends, so no single task holds the table.
    """
    c, o = F.col(f"`{column}`"), F.col(f"`{order}`")
    ranged = df.select(c.alias("v"), o.alias("o")).repartitionByRange("o").withColumn("p", F.spark_partition_id())
    from pyspark.sql import Window

    inside = ranged.withColumn("before", F.lag("v").over(Window.partitionBy("p").orderBy("o")))
    ends = inside.groupBy("p").agg(F.max(F.when(F.col("before") > F.col("v"), 1).otherwise(0)).alias("bad"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    chained = ends.withColumn("prior", F.max("hi").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    return chained.agg((F.coalesce(F.max(F.greatest("bad", F.when(F.col("prior") > F.col("lo"), 1).otherwise(0))), F.lit(0)) == 0).alias("sorted"))
