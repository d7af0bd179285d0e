"""The sample of ten events in two parts, and a rule of the engine a test."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import sql
from millrace.plans.engine import Engine
from millrace.plans.model import Agg, Builder, Col, Compare, Item, Lit, Order, QueryError

ROWS = [
    ("US", "Chrome", "Desktop", 3, 1.50, 1000),
    ("US", "Safari", "Mobile", 1, 0.20, 1001),
    ("IN", "Chrome", "Mobile", 5, 2.75, 1002),
    ("IN", "Firefox", "Desktop", 2, 0.90, 1003),
    ("US", "Chrome", "Mobile", 4, 1.10, 1004),
    ("DE", "Chrome", "Desktop", 7, 3.40, 1005),
    ("IN", "Safari", "Mobile", 1, 0.15, 1006),
    ("US", "Firefox", "Desktop", 2, 0.80, 1007),
    ("DE", "Safari", "Mobile", 3, 1.20, 1008),
    ("IN", "Chrome", "Desktop", 6, 2.10, 1009),
]
SCHEMA = "country string, browser string, device string, clicks long, revenue double, ts long"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    for k, part in enumerate((ROWS[:5], ROWS[5:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")
    return Engine.of_segments([spark.read.parquet(f"{folder}/{k}") for k in (0, 1)])


def got(engine, text):
    return [tuple(r) for r in engine.query(text).collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT count(*) FROM events", [(10,)]),
        ("SELECT min(clicks), max(clicks) FROM events", [(1.0, 7.0)]),
        ("SELECT sum(clicks) FROM events WHERE country = 'US'", [(10.0,)]),
        ("SELECT count(*) FROM events WHERE clicks BETWEEN 2 AND 4", [(5,)]),
        ("SELECT country, count(*) FROM events GROUP BY country ORDER BY country", [("DE", 2), ("IN", 4), ("US", 4)]),
        ("SELECT country, count(*) FROM events GROUP BY country HAVING count(*) > 2 ORDER BY country", [("IN", 4), ("US", 4)]),
        ("SELECT country, clicks FROM events ORDER BY clicks DESC LIMIT 3", [("DE", 7), ("IN", 6), ("IN", 5)]),
        ("SELECT count(*) FROM events WHERE country='IN' AND clicks >= 5", [(2,)]),
        ("SELECT avg(revenue) FROM events WHERE country IN ('DE')", [(2.3,)]),
        ("SELECT count(*) FROM events WHERE NOT (country = 'US' OR clicks != 1)", [(1,)]),
        ("SELECT browser, device, sum(clicks) AS s FROM events GROUP BY browser, device ORDER BY s DESC LIMIT 2", [("Chrome", "Desktop", 16.0), ("Chrome", "Mobile", 9.0)]),
        ("SELECT ts FROM events ORDER BY ts LIMIT 2 OFFSET 3", [(1003,), (1004,)]),
        ("SELECT ts FROM events ORDER BY ts LIMIT 3, 2", [(1003,), (1004,)]),
    ],
)
def test_queries_with_known_answers(engine, text, want):
    assert got(engine, text) == want


def test_limit_is_ten_unless_lifted(spark):
    many = spark.range(25)
    assert Engine(many).query("SELECT id FROM t").count() == 10
    assert Engine(many).query("SELECT id, count(*) FROM t GROUP BY id").count() == 10
    assert Engine(many, None).query("SELECT id FROM t").count() == 25
    assert Engine(many).run(Builder().select("id").build()).count() == 25


def test_aggregation_is_one_row_whatever_the_limit(engine):
    assert got(engine, "SELECT count(*) FROM e ORDER BY ts LIMIT 0 OFFSET 5") == [(10,)]


def test_aggregates_are_doubles_and_count_is_long(engine):
    kinds = dict(engine.query("SELECT count(clicks), sum(clicks), min(clicks), max(clicks), avg(clicks) FROM e").dtypes)
    assert kinds == {"count(clicks)": "bigint", "sum(clicks)": "double", "min(clicks)": "double", "max(clicks)": "double", "avg(clicks)": "double"}


def test_empty_input(engine):
    assert got(engine, "SELECT count(*), sum(clicks), min(clicks), max(clicks), avg(clicks) FROM e WHERE clicks > 99") == [(0, 0.0, float("inf"), float("-inf"), 0.0)]
    assert got(engine, "SELECT country, count(*) FROM e WHERE clicks > 99 GROUP BY country") == []


def test_names(engine):
    assert engine.query("SELECT country, COUNT(*), SUM(clicks) AS s FROM e GROUP BY country").columns == ["country", "count(*)", "s"]
    assert engine.query("SELECT ts, * FROM e").columns == ["country", "browser", "device", "clicks", "revenue", "ts"]
    assert engine.query("SELECT e.country FROM e").columns == ["country"]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT country, count(*) FROM e",
        "SELECT browser, count(*) FROM e GROUP BY country",
        "SELECT count(DISTINCT country) FROM e",
        "SELECT min(country) FROM e",
        "SELECT sum(*) FROM e",
        "SELECT count(*) FROM e HAVING count(*) > 1",
        "SELECT nothing FROM e",
        "SELECT upper(country) FROM e",
        "SELECT country FROM e WHERE country LIKE 'U%'",
        "SELECT country FROM e WHERE country IS NULL",
        "SELECT country FROM e WHERE clicks = revenue",
        "SELECT a.country FROM a JOIN b",
        "SELECT country FROM a, b",
        "SELECT clicks + 1 FROM e",
        "SELECT country FROM e WHERE clicks > 'many'",
        "SELECT stddev(clicks) FROM e",
        "SELECT country FROM e ORDER BY count(*)",
        "SELECT country FROM e LIMIT -1",
        "SELECT country FROM e WHERE",
        "SELECT country FROM e extra words",
        "DELETE FROM e",
    ],
)
def test_what_is_not_supported_raises(engine, text):
    with pytest.raises(QueryError):
        engine.query(text)


def test_hidden_aggregates_and_aliases_order(engine):
    assert got(engine, "SELECT country FROM e GROUP BY country HAVING avg(clicks) > 2.5 ORDER BY sum(revenue) DESC") == [("IN",), ("DE",)]
    assert got(engine, "SELECT country AS c, max(ts) AS t FROM e GROUP BY country ORDER BY t") == [("US", 1007.0), ("DE", 1008.0), ("IN", 1009.0)]
    assert got(engine, "SELECT clicks AS n FROM e ORDER BY n DESC, ts LIMIT 2") == [(7,), (6,)]


def test_not_between_limit_zero_and_repeated_in(engine):
    assert got(engine, "SELECT count(*) FROM e WHERE clicks NOT BETWEEN 2 AND 4") == [(5,)]
    assert got(engine, "SELECT ts FROM e ORDER BY ts LIMIT 0") == []
    assert got(engine, "SELECT count(*) FROM e WHERE ts IN (1000, 1000, 1000)") == [(1,)]
    assert got(engine, "SELECT count(*) FROM e WHERE country NOT IN ('US', 'IN')") == [(2,)]


def test_literals_meet_columns(engine):
    assert got(engine, "SELECT count(*) FROM e WHERE clicks > 2.5") == [(6,)]
    assert got(engine, "SELECT count(*) FROM e WHERE '2.5' < clicks") == [(6,)]
    assert got(engine, "SELECT count(*) FROM e WHERE clicks > -1 AND country != '*'") == [(10,)]
    assert got(engine, "SELECT count(*) FROM e WHERE revenue = 1.5e0") == [(1,)]


def test_having_on_text_compares_text(engine):
    assert got(engine, "SELECT country FROM e GROUP BY country HAVING country > 'DE' ORDER BY country") == [("IN",), ("US",)]


def test_group_limit_without_order_is_deterministic(engine):
    assert got(engine, "SELECT browser FROM e GROUP BY browser LIMIT 2") == [("Chrome",), ("Firefox",)]


def test_distinct(engine):
    assert sorted(got(engine, "SELECT DISTINCT device FROM e")) == [("Desktop",), ("Mobile",)]


def test_quotes_escapes_and_comments(spark):
    df = spark.createDataFrame([("it's", 1), ("x", 2)], "`odd name` string, `select` int")
    e = Engine(df)
    assert [tuple(r) for r in e.query("SELECT `select` FROM t -- all\nWHERE \"odd name\" = 'it''s'").collect()] == [(1,)]


def test_code_and_text_share_a_model():
    text = sql.parse("SELECT country, count(*) AS n FROM e WHERE clicks > 2 GROUP BY country ORDER BY count(*) DESC LIMIT 4 OFFSET 1")
    code = Builder().select("country", Item(Agg("COUNT"), "n")).where(Compare(Col("clicks"), ">", Lit.of(2))).group_by("country").order_by(Order(Agg("count"), True)).limit(4).offset(1).build()
    assert text.items == code.items and text.filter == code.filter and text.order == code.order and (text.limit, text.offset) == (code.limit, code.offset)


def test_unknown_table_and_no_segments(spark):
    with pytest.raises(QueryError):
        Engine({"a": spark.range(1)}).query("SELECT id FROM b")
    none = Engine.of_segments([])
    assert tuple(none.query("SELECT count(*), sum(x), min(x), max(x), avg(x) FROM t WHERE y = 'a' AND z > 1").first()) == (0, 0.0, float("inf"), float("-inf"), 0.0)
    assert none.query("SELECT a, count(*) FROM t GROUP BY a").columns == ["a", "count(*)"] and none.query("SELECT * FROM t").columns == []
    known = Engine.of_segments([], schema="a int, b string")
    assert known.query("SELECT * FROM t").columns == ["a", "b"] and known.query("SELECT b FROM t WHERE a > 1").count() == 0
    assert known.query("SELECT count(*) AS n FROM t").first().n == 0


def test_distinct_over_groups(spark):
    e = Engine(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "c string, d int"))
    assert [r.c for r in e.query("SELECT DISTINCT c FROM t GROUP BY c, d ORDER BY c").collect()] == ["a", "b"]
    assert [tuple(r) for r in e.query("SELECT DISTINCT count(*) AS n FROM t GROUP BY c, d ORDER BY n DESC LIMIT 1").collect()] == [(2,)]
    assert sorted(map(tuple, e.query("SELECT DISTINCT c, d FROM t GROUP BY d, c").collect())) == [("a", 1), ("a", 2), ("b", 1)]
    assert [tuple(r) for r in e.query("SELECT DISTINCT c AS x, c AS y FROM t GROUP BY c, d LIMIT 9").collect()] == [("a", "a"), ("b", "b")]
    with pytest.raises(QueryError):
        e.query("SELECT DISTINCT c FROM t GROUP BY c, d ORDER BY d")


def test_null_order(spark):
    e = Engine(spark.createDataFrame([(1,), (None,), (2,)], "x int"))
    assert [r.x for r in e.query("SELECT x FROM t ORDER BY x").collect()] == [1, 2, None]
    assert [r.x for r in e.query("SELECT x FROM t ORDER BY x DESC").collect()] == [None, 2, 1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(engine, spark, tmp_path):
    assert "TakeOrderedAndProject" in plan(engine.query("SELECT country FROM e ORDER BY clicks DESC LIMIT 3 OFFSET 2"))
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    p = plan(Engine(spark.read.parquet(path)).query("SELECT country FROM e WHERE clicks > 3 AND browser = 'Chrome'"))
    assert "GreaterThan(clicks,3)" in p and "EqualTo(browser,Chrome)" in p and "ReadSchema: struct<country:string,browser:string,clicks:bigint>" in p
    grouped = plan(Engine(spark.read.parquet(path)).query("SELECT country, sum(clicks) FROM e GROUP BY country"))
    assert "partial_sum" in grouped and grouped.count("Exchange") == 1


def test_random_filters_against_rows(engine):
    """Seeded trees of all leaves against a row-by-row evaluation."""
    import random

    rng = random.Random(11)
    columns = ["country", "browser", "clicks", "revenue", "ts"]
    at = {c: k for k, c in enumerate(["country", "browser", "device", "clicks", "revenue", "ts"])}
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}

    def lit(v):
        return "'" + v + "'" if isinstance(v, str) else repr(v)

    def tree(depth):
        if depth and rng.random() < 0.7:
            kind = rng.choice(["AND", "OR", "NOT"])
            if kind == "NOT":
                t, f = tree(depth - 1)
                return f"NOT ({t})", lambda r: not f(r)
            (a, f), (b, g) = tree(depth - 1), tree(depth - 1)
            return f"({a}) {kind} ({b})", (lambda r: f(r) and g(r)) if kind == "AND" else (lambda r: f(r) or g(r))
        c = rng.choice(columns)
        k = at[c]
        v, w = rng.choice(ROWS)[k], rng.choice(ROWS)[k]
        leaf = rng.choice(["cmp", "flip", "in", "between"])
        op = rng.choice(list(ops))
        if leaf == "cmp":
            return f"{c} {op} {lit(v)}", lambda r: ops[op](r[k], v)
        if leaf == "flip":
            return f"{lit(v)} {op} {c}", lambda r: ops[op](v, r[k])
        no = rng.random() < 0.5
        if leaf == "in":
            return f"{c} {'NOT ' * no}IN ({lit(v)}, {lit(w)})", lambda r: (r[k] in (v, w)) != no
        return f"{c} {'NOT ' * no}BETWEEN {lit(v)} AND {lit(w)}", lambda r: (v <= r[k] <= w) != no

    trees = [tree(3) for _ in range(40)]
    from functools import reduce

    found = reduce(lambda a, b: a.union(b), [engine.run(sql.parse(f"SELECT ts FROM e WHERE {t}")).select(F.lit(k).alias("k"), "ts") for k, (t, _) in enumerate(trees)])
    got_ = sorted((r.k, r.ts) for r in found.collect())
    assert got_ == sorted((k, r[5]) for k, (_, f) in enumerate(trees) for r in ROWS if f(r))
