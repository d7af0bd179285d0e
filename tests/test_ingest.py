import pytest
from pyspark.sql import functions as F

from millrace.plans.engine import Engine
from millrace.sources import ingest
from millrace.sources.schema import Field, Schema

ALL = Schema(
    "all",
    (
        Field("i", "INT"),
        Field("l", "LONG", "METRIC"),
        Field("f", "FLOAT", "METRIC"),
        Field("d", "DOUBLE", "METRIC", default=1.5),
        Field("s", "STRING"),
        Field("b", "BYTES"),
        Field("t", "LONG", "DATE_TIME"),
    ),
)


def test_schema_json_round_trip():
    text = """{"schemaName": "x", "metricFieldSpecs": [{"name": "m", "dataType": "double", "defaultNullValue": 2}],
      "dimensionFieldSpecs": [{"name": "a", "dataType": "STRING", "singleValueField": false}, {"name": "b", "dataType": "BYTES"}],
      "dateTimeFieldSpecs": [{"name": "ts", "dataType": "LONG"}]}"""
    s = Schema.from_json(text)
    assert [f.name for f in s.fields] == ["a", "b", "m", "ts"]
    assert s.fields[2].default == 2.0 and not s.fields[0].single
    assert Schema.from_json(s.to_json()) == s
    spark = s.spark()
    assert spark["a"].dataType.simpleString() == "array<string>" and spark["m"].metadata["role"] == "METRIC"
    assert spark["ts"].metadata["default"] == str(-(1 << 63))


def test_schema_rejects():
    with pytest.raises(ValueError):
        Field("a", "BOOLEAN")
    with pytest.raises(ValueError):
        Schema("x", (Field("a", "INT"), Field("a", "LONG")))


def test_csv_binds_by_name_and_fills_defaults(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("t,s,zzz,d,f,l,i,b\n5, x ,q, 2.5 ,0.5,7, 3 ,hey\n\n6,,q,,,,,\n7,\"y\",q\n")
    df = ingest.read_csv(spark, str(f), ALL)
    assert df.columns == ["i", "l", "f", "d", "s", "b", "t"]
    rows = {r.t: r for r in df.collect()}
    assert (rows[5].i, rows[5].l, rows[5].f, rows[5].d, rows[5].s, bytes(rows[5].b)) == (3, 7, 0.5, 2.5, " x ", b"hey")
    assert (rows[6].i, rows[6].l, rows[6].f, rows[6].d, rows[6].s, bytes(rows[6].b)) == (-(1 << 31), -(1 << 63), float("-inf"), 1.5, "null", b"")
    assert rows[7].s == '"y"' and rows[7].d == 1.5
    # defaults are values like others
    assert Engine(df).query("SELECT sum(f), count(l) FROM x").first()[:2] == (float("-inf"), 3)


def test_csv_lacking_a_column_or_with_a_bad_cell_raises(spark, tmp_path):
    f = tmp_path / "b.csv"
    f.write_text("i,l\n1,x\n")
    with pytest.raises(ValueError, match="lacks"):
        ingest.read_csv(spark, str(f), ALL)
    with pytest.raises(Exception, match="CAST|cast"):
        ingest.read_csv(spark, str(f), Schema("x", (Field("l", "LONG"),))).collect()


def test_multi_value_cells(spark, tmp_path):
    f = tmp_path / "c.tsv"
    f.write_text("k\ttags\tn\n1\ta;b\t1;2; 3\n2\t\t\n")
    s = Schema("m", (Field("k", "INT"), Field("tags", "STRING", single=False), Field("n", "INT", single=False)))
    rows = sorted(ingest.read_csv(spark, str(f), s, "\t").collect())
    assert rows[0].tags == ["a", "b"] and rows[0].n == [1, 2, 3]
    assert rows[1].tags == ["null"] and rows[1].n == [-(1 << 31)]
    with pytest.raises(ValueError, match="multi-value"):
        ingest.write(ingest.read_csv(spark, str(f), s, "\t"), str(tmp_path / "out"))


def test_fill_defaults(spark):
    df = spark.createDataFrame([(None, "x"), (4, None)], "l long, s string")
    out = ingest.fill_defaults(df, Schema("x", (Field("l", "LONG"), Field("s", "STRING"))))
    assert sorted(map(tuple, out.collect())) == [(-(1 << 63), "x"), (4, "null")]


def test_layout_skips_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), (F.col("id") % 50).cast("string").alias("c"))
    ingest.write(df, path, ingest.Layout(sort=("k",), bloom=("c",), files=4, distinct=50, row_group_bytes=1 << 18))
    back = ingest.read(spark, path)
    assert back.count() == 200_000
    files = sorted((tmp_path / "t").glob("*.parquet"))
    assert len(files) == 4
    ranges = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        ranges += [(meta.row_group(g).column(0).statistics.min, meta.row_group(g).column(0).statistics.max) for g in range(meta.num_row_groups)]
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # an equality touches one row group
    plan = back.where("k = 77 and c = '3'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,77)" in plan and "EqualTo(c,3)" in plan


@pytest.mark.parametrize("hot", [False, True])
def test_files_grow_in_number_not_in_size(spark, tmp_path, hot):
    """A task sorts a file, so no file may grow with the table, nor with the rows of one key."""
    import pyarrow.parquet as pq

    df = spark.range(20_000, numPartitions=4).select((F.lit(7) if hot else F.col("id") * 7919 % 20_000).cast("long").alias("k"), "id", F.repeat(F.lit("x"), 68).alias("s"))
    ingest.write(df, str(tmp_path / "t"), ingest.Layout(sort=("k",), files=2, file_bytes=200_000))
    files = [pq.read_table(f).column("k").to_pylist() for f in (tmp_path / "t").glob("*.parquet")]
    assert sum(map(len, files)) == 20_000 and max(map(len, files)) < 4_000  # 108 bytes a row: 11 files of 1,800
    assert all(f == sorted(f) for f in files)
    if not hot:
        ranges = sorted((f[0], f[-1]) for f in files)
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert sorted(r.id for r in ingest.read(spark, str(tmp_path / "t")).collect()) == list(range(20_000))


def test_values_are_found_over_more_files_than_asked_for(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(20_000, numPartitions=4).select((F.col("id") % 500).alias("k"), "id")
    ingest.write(df, path, ingest.Layout(sort=("k",), files=2, row_group_bytes=1 << 18, file_bytes=30_000))
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 16  # 24 bytes a row
    got = Engine(ingest.read(spark, path), None).query("SELECT id FROM t WHERE k IN (3, 55, 120) OR k = 77")
    assert sorted(r.id for r in got.collect()) == [i for i in range(20_000) if i % 500 in (3, 55, 77, 120)]


def test_sizes_of_odd_rows(spark):
    """Nulls, nested values and no rows at all."""
    df = spark.createDataFrame([(None, None, {"a": 1}), ("ab", bytearray(b"a\xff\x00"), None)], "s string, b binary, m map<string,int>")
    assert ingest._bytes(df) == 2 * 8 * 7 + 5 + len("{a -> 1}")
    assert ingest._bytes(df.limit(0)) == 0


def test_partitioned_layout_prunes(spark, tmp_path):
    path = str(tmp_path / "p")
    ingest.write(spark.range(100).select("id", (F.col("id") % 4).alias("part")), path, ingest.Layout(sort=("id",), partition=("part",)))
    plan = ingest.read(spark, path).where("part = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_footers_alone_answer_count_min_max(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.range(1000).select("id", (F.col("id") / 2).alias("x")).coalesce(1).write.parquet(path)
    own = ingest.metadata_only(spark)
    e = Engine(own.read.parquet(path))
    df = e.query("SELECT count(*), min(id), max(id) FROM t")
    assert tuple(df.first()) == (1000, 0.0, 999.0)
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id)]" in df._jdf.queryExecution().executedPlan().toString()
    mixed = e.query("SELECT count(*), sum(id) FROM t")
    assert tuple(mixed.first()) == (1000, 499500.0)
    assert "PushedAggregation: []" in mixed._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""  # the session at hand is left alone


def test_statistics_and_sortedness(spark):
    df = spark.createDataFrame([(1, "b", [1, 2]), (2, "a", [2]), (2, "a", [])], "k int, s string, m array<int>")
    found = {r["column"]: r for r in ingest.statistics(df).collect()}
    assert (found["k"].cardinality, found["k"].min, found["k"].max) == (2, "1", "2")
    assert (found["m"].cardinality, found["m"].most_in_cell) == (2, 2)
    up = spark.range(1000).select(F.col("id").alias("o"), (F.col("id") / 3).cast("long").alias("v"))
    assert ingest.is_sorted(up, "v", "o").first().sorted
    assert not ingest.is_sorted(up.withColumn("v", F.when(F.col("o") == 700, 0).otherwise(F.col("v"))), "v", "o").first().sorted
    assert ingest.is_sorted(up.limit(0), "v", "o").first().sorted
