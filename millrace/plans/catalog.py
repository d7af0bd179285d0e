"""The registered queries over the driver tables, and the SQL that gives the same rows.

Each answers over the whole of its tables. The workflow tables are derived from the driver tables by
expressions that Spark and DuckDB read alike, so the same text stands on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dag, ranges, routing, upsert
from millrace.operators import workflow as wf
from millrace.plans.engine import Engine
from millrace.plans.model import Agg, Builder, Item
from millrace.sources import ingest
from millrace.sources.schema import Schema
from millrace.streaming import counters

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ingest.read(spark, f"{sf_dir}/{name}.parquet")


def add(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


class _Lazy(dict):
    """Tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __contains__(self, name):
        return name in TABLES

    def __missing__(self, name):
        return load(self.spark, self.sf_dir, name)


def _text(name: str, text: str, oracle: str, default_limit: int | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: Engine(_Lazy(spark, sf_dir), default_limit).query(text)
    ORACLE[name] = oracle


_FIVE = 'count(*) AS n, coalesce(sum(CAST({c} AS DOUBLE)), 0) AS total, coalesce(CAST(min({c}) AS DOUBLE), CAST(\'inf\' AS DOUBLE)) AS least, coalesce(CAST(max({c}) AS DOUBLE), CAST(\'-inf\' AS DOUBLE)) AS most, coalesce(avg(CAST({c} AS DOUBLE)), 0) AS mean'
_ALL = "count(*) AS n, sum({c}) AS total, min({c}) AS least, max({c}) AS most, avg({c}) AS mean"

# Sums of doubles depend on the order of addition, so reports of them round on both sides.


def _rounded(name: str, text: str, oracle: str, columns: tuple[str, ...], digits: int = 3) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(_Lazy(spark, sf_dir), None).query(text)
        return df.withColumns({c: F.round(c, digits) for c in columns})

    QUERIES[name] = run
    ORACLE[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM ({oracle})"


_rounded("agg_all", f"SELECT {_ALL.format(c='value')} FROM events", f"SELECT {_FIVE.format(c='value')} FROM events", ("total", "mean"))
_text("agg_empty", f"SELECT {_ALL.format(c='value')} FROM events WHERE value < -1e18", f"SELECT {_FIVE.format(c='value')} FROM events WHERE value < -1e18")
_rounded("agg_filtered", f"SELECT {_ALL.format(c='l_quantity')} FROM lineitem WHERE l_returnflag = 'R' AND l_discount BETWEEN 0.02 AND 0.08", f"SELECT {_FIVE.format(c='l_quantity')} FROM lineitem WHERE l_returnflag = 'R' AND l_discount BETWEEN 0.02 AND 0.08", ("total", "mean"))
_rounded("group_one", f"SELECT event_type, {_ALL.format(c='value')} FROM events GROUP BY event_type", f"SELECT event_type, {_FIVE.format(c='value')} FROM events GROUP BY event_type", ("total", "mean"))
_rounded("group_multi", f"SELECT l_returnflag, l_linestatus, {_ALL.format(c='l_extendedprice')} FROM lineitem GROUP BY l_returnflag, l_linestatus", f"SELECT l_returnflag, l_linestatus, {_FIVE.format(c='l_extendedprice')} FROM lineitem GROUP BY l_returnflag, l_linestatus", ("total", "mean"), 1)
_text("group_distinct", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority", "SELECT DISTINCT o_orderpriority FROM orders")
_text("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_text("group_key_order", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5 OFFSET 2", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5 OFFSET 2")
_text("canonical_names", "SELECT c_mktsegment, count(*), max(c_acctbal) FROM customer GROUP BY c_mktsegment", 'SELECT c_mktsegment, count(*) AS "count(*)", CAST(max(c_acctbal) AS DOUBLE) AS "max(c_acctbal)" FROM customer GROUP BY c_mktsegment')
_text("having", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 20 AND NOT c_mktsegment = 'BUILDING'", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 20 AND NOT c_mktsegment = 'BUILDING'")
_text("having_hidden", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) >= 100000 OR count(*) > 14 ORDER BY min(o_totalprice) DESC, o_custkey LIMIT 50", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) >= 100000 OR count(*) > 14 ORDER BY min(o_totalprice) DESC, o_custkey LIMIT 50")

for _name, _table, _where in (
    ("flt_eq", "events", "event_type = 'click'"),
    ("flt_ne", "events", "event_type <> 'click'"),
    ("flt_in", "orders", "o_orderpriority IN ('1-URGENT', '2-HIGH', 'none')"),
    ("flt_in_dup", "orders", "o_custkey IN (7, 7, 11)"),
    ("flt_not_in", "orders", "o_orderstatus NOT IN ('F', 'O')"),
    ("flt_range", "events", "value >= 10 AND value < 20.5"),
    ("flt_promote", "orders", "o_custkey > 2.5"),
    ("flt_between", "lineitem", "l_quantity BETWEEN 10 AND 12"),
    ("flt_not_between", "lineitem", "NOT l_quantity BETWEEN 3 AND 48"),
    ("flt_flip", "lineitem", "45 <= l_quantity AND 'R' = l_returnflag"),
    ("flt_and", "lineitem", "l_returnflag = 'A' AND l_linestatus = 'F' AND l_tax < 0.03"),
    ("flt_or", "lineitem", "l_quantity < 2 OR l_discount > 0.09 OR l_tax = 0.08"),
    ("flt_not", "lineitem", "NOT (l_quantity > 5 OR NOT l_linestatus = 'O')"),
    ("flt_time", "lineitem", "l_shipdate >= '1996-01-01' AND l_shipdate < '1996-03-01'"),
    ("flt_empty", "lineitem", "l_returnflag = 'none'"),
    ("flt_nested", "events", "(event_type = 'click' OR event_type = 'view') AND NOT (value < 5 OR value > 400) AND user_id IN (1, 2, 3, 5, 8, 13, 21)"),
):
    _rows = {"events": "event_id, event_type, value", "orders": "o_orderkey, o_custkey, o_orderstatus", "lineitem": "l_orderkey, l_linenumber, l_quantity, l_shipdate"}[_table]
    _text(_name, f"SELECT {_rows} FROM {_table} WHERE {_where}", f"SELECT {_rows} FROM {_table} WHERE {_where}")

_text("sel_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_text("sel_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20, 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
_text("sel_hidden_key", "SELECT o_custkey AS customer FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30", "SELECT o_custkey AS customer FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
_text("sel_alias_key", "SELECT c_custkey AS id, c_acctbal AS money FROM customer ORDER BY money DESC, id LIMIT 12", "SELECT c_custkey AS id, c_acctbal AS money FROM customer ORDER BY money DESC, id LIMIT 12")
_text("sel_default_limit", "SELECT event_id, ts FROM events ORDER BY event_id", "SELECT event_id, ts FROM events ORDER BY event_id LIMIT 10", 10)
_text("sel_star", "SELECT * FROM nation", "SELECT * FROM nation")
_text("sel_limit_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0", "SELECT o_orderkey FROM orders LIMIT 0")
_text("sel_qualified", "SELECT n.n_name, n.n_regionkey FROM nation n WHERE n.n_regionkey < 3", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 3")


@add("agg_meta", "SELECT count(*) AS n, CAST(min(l_quantity) AS DOUBLE) AS least, CAST(max(l_quantity) AS DOUBLE) AS most FROM lineitem")
def agg_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Builder().select(Item(Agg("count"), "n"), Item(Agg("min", "l_quantity"), "least"), Item(Agg("max", "l_quantity"), "most")).build()
    return Engine(load(ingest.metadata_only(spark), sf_dir, "lineitem")).run(q)


@add("segments_union", "SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT s_nationkey + 100, count(*) FROM supplier GROUP BY s_nationkey")
def segments_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), load(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 100).alias("nation"))]
    return Engine.of_segments(parts, None).query("SELECT nation, count(*) AS n FROM segments GROUP BY nation")


@add("column_stats", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS \"values\", count(DISTINCT {c}) AS cardinality, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, 1 AS most_in_cell FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.statistics(load(spark, sf_dir, "part"))


@add("column_sorted", "SELECT coalesce(bool_and(v >= b OR b IS NULL), true) AS sorted FROM (SELECT ts AS v, lag(ts) OVER (ORDER BY event_id) AS b FROM events)")
def column_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.is_sorted(load(spark, sf_dir, "events"), "ts", "event_id")


@add("column_unsorted", "SELECT coalesce(bool_and(v >= b OR b IS NULL), true) AS sorted FROM (SELECT o_totalprice AS v, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS b FROM orders)")
def column_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.is_sorted(load(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@add("upsert_latest", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return upsert.latest(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], F.col("event_type") == "error").drop("ts")


@add("upsert_max_by", "SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def upsert_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.latest_of(load(spark, sf_dir, "events"), ["user_id"], "ts", ["event_type", "value"])


@add("queryable_rows", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def queryable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return upsert.queryable(load(spark, sf_dir, "events").select("event_id", "user_id"), valid, ["user_id"])


_NODES = ("alpha", "bravo", "charlie", "delta")
_PLACE = "CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END"


def _ring_sql(names: tuple[str, ...], virtual: int, tag: str) -> str:
    values = ", ".join(f"('{n}')" for n in names)
    return f"""v{tag} AS (SELECT node, node || '-' || i AS vnode FROM (VALUES {values}) AS t(node), range({virtual}) AS r(i)),
w{tag} AS (SELECT node, vnode, {_PLACE} AS high FROM (SELECT *, CAST('0x' || substr(md5(vnode), 1, 8) AS BIGINT) AS h FROM v{tag})),
o{tag} AS (SELECT k.key, k.place, (SELECT struct_pack(node := arg_min(node, high), vnode := arg_min(vnode, high)) FROM w{tag} WHERE high >= k.place) AS a,
  (SELECT struct_pack(node := arg_min(node, high), vnode := arg_min(vnode, high)) FROM w{tag}) AS f FROM k)"""


_KEYS = f"k AS (SELECT c_custkey AS key, {_PLACE} AS place FROM (SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM customer))"


@add("ring_assign", f"WITH {_KEYS}, {_ring_sql(_NODES, 24, 'a')} SELECT key AS c_custkey, place, coalesce(a.node, f.node) AS node, coalesce(a.vnode, f.vnode) AS vnode FROM oa")
def ring_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.assign(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", routing.nodes(spark, list(_NODES)), 24)


@add("ring_moved", f"WITH {_KEYS}, {_ring_sql(_NODES, 24, 'a')}, {_ring_sql((*_NODES, 'echo'), 24, 'b')} SELECT oa.key AS c_custkey, coalesce(oa.a.node, oa.f.node) AS old_node, coalesce(ob.a.node, ob.f.node) AS new_node FROM oa JOIN ob USING (key) WHERE coalesce(oa.a.node, oa.f.node) <> coalesce(ob.a.node, ob.f.node)")
def ring_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = load(spark, sf_dir, "customer").select("c_custkey")
    return routing.moved(keys, "c_custkey", routing.nodes(spark, list(_NODES)), routing.nodes(spark, [*_NODES, "echo"]), 24)


@add("log_state", "SELECT key, seq, value FROM (SELECT user_id AS key, event_id AS seq, value, event_type = 'error' AS deleted, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND NOT deleted")
def log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").selectExpr("user_id as key", "event_id as seq", "value", "event_type = 'error' as deleted")
    return upsert.state(log).drop("deleted")


@add("stream_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type AS key, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc = load(spark, sf_dir, "events").withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.expr("current_timezone()")))
    found = counters.windowed(utc, "ts", "event_type", "value", "1 day")
    return found.select(F.from_utc_timestamp("start", F.expr("current_timezone()")).cast("timestamp_ntz").alias("start"), "key", "n", F.round("total", 3).alias("total"))


# --- workflow tables, from the driver tables

_NOW = "2024-01-15 00:00:00"
_INSTANCES = (
    "CAST(o_orderkey AS {s}) AS workflow_instance_id",
    "'order' AS workflow_name",
    "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'NOT_STARTED' ELSE CASE WHEN o_custkey % 7 = 0 THEN 'FAILED' WHEN o_custkey % 7 < 3 THEN 'PENDING' ELSE 'RUNNING' END END AS state",
    "CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority",
    "CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN '' ELSE 'p1' END AS processor_id",
    "CASE WHEN o_custkey % 5 = 0 THEN CAST(o_custkey % 50 AS {s}) END AS parent_workflow_id",
    "CAST(o_custkey % 100 AS {s}) AS correlation_id",
    "o_orderdate AS started_at",
    "CASE WHEN o_orderstatus = 'F' OR o_custkey % 7 = 0 THEN o_orderdate + INTERVAL '90' MINUTE END AS completed_at",
    "o_orderdate AS last_updated",
    "CAST(o_custkey % 4 AS INT) AS retry_count",
    "3 AS max_retries",
    "CAST(NULL AS {s}) AS context_data",
    "CAST(NULL AS {s}) AS output_data",
)
_TASKS = (
    "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id",
    "CAST(l_orderkey AS {s}) AS workflow_id",
    "'t' || CAST(l_linenumber AS {s}) AS task_reference_name",
    "l_linenumber AS sequence_number",
    "CASE WHEN l_linenumber <= 1 THEN NULL WHEN l_linenumber = 2 THEN 't1' ELSE 't1,t' || CAST(l_linenumber - 1 AS {s}) END AS dependencies",
    "CASE WHEN l_returnflag = 'N' THEN 'PENDING' WHEN l_quantity <= 25 THEN 'SUCCESS' WHEN l_quantity <= 30 THEN 'SKIPPED' WHEN l_quantity <= 40 THEN 'RUNNING' ELSE 'FAILED' END AS status",
    "CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE 'w1' END AS worker_id",
    "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_shipdate END AS scheduled_at",
    "l_shipdate AS started_at",
    "CAST(NULL AS TIMESTAMP{n}) AS completed_at",
    "CAST(l_suppkey % 4 AS INT) AS retry_count",
    "3 AS max_retries",
    "CAST(NULL AS {s}) AS output_data",
    "CAST(NULL AS BIGINT) AS execution_time_ms",
    "CAST(NULL AS {s}) AS error_message",
    "CAST(NULL AS {s}) AS error_type",
    "CAST(NULL AS {s}) AS error_details",
)
_DEFINITIONS = (
    "p_brand AS workflow_id",
    "p_brand || ' flow' AS workflow_name",
    "p_partkey AS version",
    "CASE p_size % 3 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'ACTIVE' ELSE 'DEPRECATED' END AS status",
    "p_partkey = max(p_partkey) OVER (PARTITION BY p_brand) AS is_latest",
    "p_type AS tags",
    "'user' || CAST(p_size % 5 AS {s}) AS created_by",
    "p_partkey AS created_at",
    "CAST(NULL AS {s}) AS updated_by",
)
_SCHEDULES = (
    "event_id AS schedule_id",
    "CASE user_id % 4 WHEN 0 THEN 'ONE_TIME' WHEN 1 THEN 'FIXED_RATE' WHEN 2 THEN 'FIXED_DELAY' ELSE 'CRON' END AS schedule_type",
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'PAUSED' ELSE 'ACTIVE' END AS status",
    "CASE WHEN user_id % 6 = 0 THEN NULL ELSE ts - INTERVAL '1' DAY END AS start_time",
    "CASE WHEN user_id % 5 = 0 THEN NULL ELSE ts + INTERVAL '3' DAY END AS end_time",
    "ts AS next_execution_time",
    "CASE WHEN user_id % 2 = 0 THEN NULL ELSE ts - INTERVAL '2' HOUR END AS last_execution_time",
    "3600 AS fixed_rate_seconds",
    "600 AS fixed_delay_seconds",
    "CAST(user_id % 7 AS INT) AS execution_count",
    "5 AS max_executions",
    "CAST(user_id % 4 AS INT) AS consecutive_failures",
    "3 AS max_consecutive_failures",
    "ts AS updated_at",
    "'flow' || CAST(user_id % 9 AS {s}) AS workflow_name",
    "user_id % 4 + 1 AS workflow_version",
    "'user' || CAST(user_id % 5 AS {s}) AS created_by",
    "CAST(event_id AS {s}) AS last_workflow_instance_id",
    "CAST(NULL AS {s}) AS last_workflow_status",
    "CASE user_id % 3 WHEN 0 THEN '0 30 4 * * MON' WHEN 1 THEN '*/15 * * * *' ELSE '0 0 12 1 * ?' END AS cron_expression",
)
_DERIVED = {"i": (_INSTANCES, "orders"), "t": (_TASKS, "lineitem"), "d": (_DEFINITIONS, "part"), "s": (_SCHEDULES, "events")}


def derived(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    columns, table = _DERIVED[which]
    return load(spark, sf_dir, table).selectExpr(*[c.format(s="STRING", n="_NTZ") for c in columns])


def _wf(name: str, which: str, fn: Callable[[DataFrame], DataFrame], sql: str, columns: str = "") -> None:
    """columns: those compared; sql selects from the derived table by its letter."""
    exprs, table = _DERIVED[which]
    head = f"WITH {which} AS (SELECT {', '.join(c.format(s='VARCHAR', n='') for c in exprs)} FROM {table}) "
    QUERIES[name] = lambda spark, sf_dir: (lambda df: df.select(*columns.split()) if columns else df)(fn(derived(spark, sf_dir, which)))
    ORACLE[name] = head + (f"SELECT {', '.join(columns.split())} FROM ({sql})" if columns else sql)


_I = "workflow_instance_id state priority started_at"
_wf("wf_task_list", "t", lambda t: wf.tasks_of(t, "7"), "SELECT * FROM t WHERE workflow_id = '7'", "id workflow_id sequence_number status")
_wf("wf_task_status", "t", lambda t: wf.tasks_by_status(t, "RUNNING", "w1"), "SELECT * FROM t WHERE status = 'RUNNING' AND worker_id = 'w1'", "id status worker_id")
_wf("wf_task_poll", "t", lambda t: wf.pending_tasks(t, "1997-06-01", 40), "SELECT * FROM t WHERE status = 'PENDING' AND worker_id IS NULL AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '1997-06-01') ORDER BY workflow_id, sequence_number, id LIMIT 40", "id workflow_id")
_wf("wf_task_unassigned", "t", wf.unassigned, "SELECT * FROM t WHERE status = 'PENDING' AND worker_id IS NULL", "id workflow_id")
_wf("wf_task_stale", "t", lambda t: wf.stale_tasks(t, "1996-01-01"), "SELECT * FROM t WHERE status = 'RUNNING' AND started_at < TIMESTAMP '1996-01-01'", "id status started_at")
_wf("wf_task_counts", "t", wf.task_counts, "SELECT workflow_id, status, count(*) AS n FROM t GROUP BY workflow_id, status")
_READY = "SELECT * FROM t WHERE status = 'PENDING' AND worker_id IS NULL AND NOT EXISTS (SELECT 1 FROM t AS d WHERE d.workflow_id = t.workflow_id AND list_contains(string_split(t.dependencies, ','), d.task_reference_name) AND d.status NOT IN ('SUCCESS', 'SKIPPED'))"
_wf("wf_ready", "t", wf.ready_tasks, _READY, "id workflow_id task_reference_name")
_wf("wf_task_claim", "t", lambda t: wf.claimable_task(t, "1999-01-01"), _READY + " AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '1999-01-01') ORDER BY workflow_id, sequence_number, id LIMIT 1", "id workflow_id")
_wf("wf_satisfied", "t", wf.satisfied_tasks, "SELECT * FROM t WHERE status = 'PENDING' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(t.dependencies, ',')) AS dep) AS x WHERE x.dep NOT IN (SELECT d.task_reference_name FROM t AS d WHERE d.workflow_id = t.workflow_id AND d.status IN ('SUCCESS', 'SKIPPED')))", "id workflow_id task_reference_name")
_wf("wf_task_reset", "t", lambda t: wf.reset_stale_tasks(t, "1996-01-01"), "SELECT id, CASE WHEN g THEN 'PENDING' ELSE status END AS status, CASE WHEN g THEN NULL ELSE worker_id END AS worker_id, CASE WHEN g THEN retry_count + 1 ELSE retry_count END AS retry_count FROM (SELECT *, status = 'RUNNING' AND started_at < TIMESTAMP '1996-01-01' AND retry_count < max_retries AS g FROM t)", "id status worker_id retry_count")
_wf("wf_task_cancel", "t", lambda t: wf.cancel_tasks(t, "7", _NOW), f"SELECT id, CASE WHEN g THEN 'CANCELLED' ELSE status END AS status, CASE WHEN g THEN TIMESTAMP '{_NOW}' ELSE completed_at END AS completed_at FROM (SELECT *, workflow_id = '7' AND status IN ('PENDING', 'RUNNING') AS g FROM t)", "id status completed_at")
_wf("wf_error_rate", "t", lambda t: wf.error_rate(t, ["sequence_number"]), "SELECT sequence_number, count(*) AS volume, count(*) FILTER (WHERE status = 'FAILED') AS errors, count(*) FILTER (WHERE status = 'FAILED') * 100.0 / count(*) AS error_percent FROM t GROUP BY sequence_number")
_wf("wf_fork_summary", "t", lambda t: wf.fork_summary(t, ["workflow_id"]), "SELECT workflow_id, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCESS') AS successful, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM t GROUP BY workflow_id")
_wf("wf_claim", "i", wf.claimable_instance, "SELECT * FROM i WHERE state IN ('NOT_STARTED', 'PENDING') AND (processor_id IS NULL OR processor_id = '') ORDER BY priority DESC, started_at ASC NULLS LAST, workflow_instance_id LIMIT 1", _I)
_wf("wf_by_priority", "i", lambda i: wf.pending_by_priority(i, 60), "SELECT * FROM i WHERE state IN ('NOT_STARTED', 'PENDING') ORDER BY priority DESC, started_at ASC NULLS LAST, workflow_instance_id LIMIT 60", _I)
_wf("wf_lookup", "i", lambda i: wf.instances_where(i, state=["RUNNING", "FAILED"], parent_workflow_id="15"), "SELECT * FROM i WHERE state IN ('RUNNING', 'FAILED') AND parent_workflow_id = '15'", _I)
_wf("wf_page", "i", lambda i: wf.instances_where(i, page=2, size=25, correlation_id="42"), "SELECT * FROM i WHERE correlation_id = '42' ORDER BY workflow_instance_id LIMIT 25 OFFSET 50", _I)
_wf("wf_stale", "i", lambda i: wf.stale_instances(i, "1996-01-01"), "SELECT * FROM i WHERE state = 'RUNNING' AND last_updated < TIMESTAMP '1996-01-01'", _I)
_wf("wf_metrics", "i", lambda i: wf.metrics(i, "1996-01-01"), "SELECT count(*) FILTER (WHERE state = 'RUNNING') AS running, count(*) FILTER (WHERE state = 'COMPLETED') AS completed, count(*) FILTER (WHERE state = 'FAILED') AS failed, count(*) FILTER (WHERE state IN ('NOT_STARTED', 'PENDING')) AS pending, count(*) FILTER (WHERE started_at >= TIMESTAMP '1996-01-01') AS started_since, count(*) FILTER (WHERE completed_at >= TIMESTAMP '1996-01-01' AND state = 'COMPLETED') AS completed_since, count(*) FILTER (WHERE completed_at >= TIMESTAMP '1996-01-01' AND state = 'FAILED') AS failed_since, avg(epoch(completed_at - started_at)) FILTER (WHERE completed_at >= TIMESTAMP '1996-01-01') AS mean_seconds FROM i")
_wf("wf_transition", "i", lambda i: wf.transition(i, "3", "RUNNING", "PAUSED", _NOW), f"SELECT workflow_instance_id, CASE WHEN workflow_instance_id = '3' AND state = 'RUNNING' THEN 'PAUSED' ELSE state END AS state, CASE WHEN workflow_instance_id = '3' AND state = 'RUNNING' THEN TIMESTAMP '{_NOW}' ELSE last_updated END AS last_updated FROM i", "workflow_instance_id state last_updated")
_wf("wf_reset", "i", lambda i: wf.reset_stale_instances(i, "1996-01-01"), "SELECT workflow_instance_id, CASE WHEN g THEN 'PENDING' ELSE state END AS state, CASE WHEN g THEN NULL ELSE processor_id END AS processor_id, CASE WHEN g THEN retry_count + 1 ELSE retry_count END AS retry_count FROM (SELECT *, state = 'RUNNING' AND last_updated < TIMESTAMP '1996-01-01' AND retry_count < max_retries AS g FROM i)", "workflow_instance_id state processor_id retry_count")
_D = "workflow_id version status"
_wf("wf_def_latest", "d", lambda d: wf.latest_definition(d, workflow_id="Brand#1"), "SELECT * FROM d WHERE is_latest AND workflow_id = 'Brand#1'", _D)
_wf("wf_def_exact", "d", lambda d: wf.exact_definition(d, 5), "SELECT * FROM d WHERE version = 5", _D)
_wf("wf_def_versions", "d", lambda d: wf.definition_versions(d, workflow_name="Brand#1 flow"), "SELECT * FROM d WHERE workflow_name = 'Brand#1 flow'", _D)
_wf("wf_def_status", "d", lambda d: wf.definitions_by_status(d, "DRAFT"), "SELECT * FROM d WHERE status = 'DRAFT'", _D)
_wf("wf_def_active", "d", lambda d: wf.latest_definitions(d, active=True), "SELECT * FROM d WHERE is_latest AND status = 'ACTIVE'", _D)
_wf("wf_def_tag", "d", lambda d: wf.latest_definitions(d, tag="A"), "SELECT * FROM d WHERE is_latest AND contains(tags, 'A')", _D)
_wf("wf_def_next", "d", lambda d: wf.next_version(d, "Brand#1"), "SELECT coalesce(max(version), 0) + 1 AS next_version FROM d WHERE workflow_id = 'Brand#1'")
_wf("wf_def_creator", "d", lambda d: wf.definitions_by_creator(d, "user2"), "SELECT * FROM d WHERE created_by = 'user2'", _D)
_wf("wf_def_exists", "d", lambda d: wf.definition_exists(d, workflow_id="none"), "SELECT count(*) > 0 AS present FROM d WHERE workflow_id = 'none'")
_wf("wf_def_count", "d", wf.count_active, "SELECT count(*) FILTER (WHERE is_latest AND status = 'ACTIVE') AS n FROM d")
_S = "schedule_id status next_execution_time"
_wf("wf_sched_due", "s", lambda s: wf.due_schedules(s, _NOW), f"SELECT * FROM s WHERE status = 'ACTIVE' AND next_execution_time <= TIMESTAMP '{_NOW}' AND (start_time IS NULL OR start_time <= TIMESTAMP '{_NOW}') AND (end_time IS NULL OR end_time > TIMESTAMP '{_NOW}')", _S)
_wf("wf_sched_lookup", "s", lambda s: wf.schedules_where(s, status="PAUSED", schedule_type="CRON"), "SELECT * FROM s WHERE status = 'PAUSED' AND schedule_type = 'CRON'", _S)
_wf("wf_sched_recurring", "s", wf.active_recurring, "SELECT * FROM s WHERE status = 'ACTIVE' AND schedule_type IN ('FIXED_RATE', 'FIXED_DELAY', 'CRON')", _S)
_wf("wf_sched_errors", "s", wf.schedules_in_error, "SELECT * FROM s WHERE status = 'ERROR' OR consecutive_failures >= max_consecutive_failures", _S)
_wf("wf_sched_expired", "s", lambda s: wf.expired_schedules(s, _NOW), f"SELECT * FROM s WHERE status = 'ACTIVE' AND end_time <= TIMESTAMP '{_NOW}'", _S)
_wf("wf_sched_eligible", "s", lambda s: wf.eligibility(s, _NOW), f"SELECT schedule_id, new_status, status = 'ACTIVE' AND NOT early AND new_status = 'ACTIVE' AND next_execution_time <= TIMESTAMP '{_NOW}' AS eligible FROM (SELECT *, CASE WHEN status <> 'ACTIVE' OR early THEN status WHEN coalesce(end_time < TIMESTAMP '{_NOW}', false) THEN 'EXPIRED' WHEN execution_count >= max_executions THEN 'COMPLETED' WHEN consecutive_failures >= max_consecutive_failures THEN 'ERROR' ELSE status END AS new_status FROM (SELECT *, coalesce(start_time > TIMESTAMP '{_NOW}', false) AS early FROM s))", "schedule_id new_status eligible")
_CRON = {"0 30 4 * * MON": "2024-01-15 04:30:00", "*/15 * * * *": "2024-01-15 00:15:00", "0 0 12 1 * ?": "2024-02-01 12:00:00"}
_CRON_SQL = "CASE cron_expression " + " ".join(f"WHEN '{e}' THEN TIMESTAMP '{t}'" for e, t in _CRON.items()) + " END"
_wf("wf_sched_next", "s", lambda s: wf.next_time(s, _NOW), f"SELECT schedule_id, CASE WHEN coalesce(end_time < TIMESTAMP '{_NOW}', false) THEN NULL WHEN schedule_type = 'FIXED_RATE' THEN coalesce(last_execution_time, TIMESTAMP '{_NOW}') + INTERVAL 1 HOUR WHEN schedule_type = 'FIXED_DELAY' THEN TIMESTAMP '{_NOW}' + INTERVAL 10 MINUTE WHEN schedule_type = 'CRON' THEN {_CRON_SQL} END AS next_time FROM s", "schedule_id next_time")
_wf("wf_sched_delete", "s", lambda s: wf.delete_old(wf.eligibility(s, _NOW).drop("status").withColumnRenamed("new_status", "status"), "2024-01-10"), f"SELECT schedule_id FROM (SELECT *, CASE WHEN status <> 'ACTIVE' OR coalesce(start_time > TIMESTAMP '{_NOW}', false) THEN status WHEN coalesce(end_time < TIMESTAMP '{_NOW}', false) THEN 'EXPIRED' WHEN execution_count >= max_executions THEN 'COMPLETED' WHEN consecutive_failures >= max_consecutive_failures THEN 'ERROR' ELSE status END AS st FROM s) WHERE NOT (st IN ('COMPLETED', 'EXPIRED') AND updated_at < TIMESTAMP '2024-01-10')", "schedule_id")

_wf("wf_def_set_latest", "d", lambda d: wf.set_latest(d, "Brand#1", 26, _NOW), "SELECT workflow_id, version, CASE WHEN workflow_id = 'Brand#1' THEN version = 26 ELSE is_latest END AS is_latest FROM d", "workflow_id version is_latest")
_wf("wf_def_deprecate", "d", lambda d: wf.deprecate(d, "Brand#1", 26, "me", "old", _NOW), "SELECT workflow_id, version, CASE WHEN g THEN 'DEPRECATED' ELSE status END AS status, is_latest AND NOT g AS is_latest FROM (SELECT *, workflow_id = 'Brand#1' AND version = 26 AS g FROM d)", "workflow_id version status is_latest")
_wf("wf_sched_record", "s", lambda s: wf.record_execution(s, 7, _NOW, "i", "FAILED", False), f"SELECT schedule_id, CASE WHEN schedule_id = 7 THEN TIMESTAMP '{_NOW}' ELSE last_execution_time END AS last_execution_time, CASE WHEN schedule_id = 7 THEN execution_count + 1 ELSE execution_count END AS execution_count, CASE WHEN schedule_id = 7 THEN consecutive_failures + 1 ELSE consecutive_failures END AS consecutive_failures FROM s", "schedule_id last_execution_time execution_count consecutive_failures")
_wf("wf_claimed", "i", lambda i: wf.claim_instance(i, "9", "me", _NOW), f"SELECT workflow_instance_id, CASE WHEN g THEN 'RUNNING' ELSE state END AS state, CASE WHEN g THEN 'me' ELSE processor_id END AS processor_id, CASE WHEN g THEN TIMESTAMP '{_NOW}' ELSE last_updated END AS last_updated FROM (SELECT *, workflow_instance_id = '9' AND processor_id IS NULL AND state IN ('NOT_STARTED', 'PENDING') AS g FROM i)", "workflow_instance_id state processor_id last_updated")


# --- every other update and lookup


def _first(t: DataFrame, where: str) -> int:
    """The least id of the tasks for which it holds; -1 if there is none."""
    return t.where(where).agg(F.coalesce(F.min("id"), F.lit(-1))).first()[0]


def _task(name: str, where: str, fn: Callable[[DataFrame, int], DataFrame], changes: dict[str, str], guard: str = "true") -> None:
    """An update of the first task for which `where` holds; changes: what the SQL makes of the columns where the guard holds too."""
    g = f"(id = (SELECT min(id) FROM t WHERE {where}) AND {guard})"
    columns = ", ".join(f"CASE WHEN {g} THEN {v} ELSE {c} END AS {c}" for c, v in changes.items())
    _wf(name, "t", lambda t: fn(t, _first(t, where)), f"SELECT id, {columns} FROM t", " ".join(["id", *changes]))


_STAMP_SQL = f"TIMESTAMP '{_NOW}'"
_FREE = "status = 'PENDING' AND worker_id IS NULL"
_task("wf_task_acquire", _FREE, lambda t, k: wf.acquire_task(t, k, "me", _NOW), {"status": "'RUNNING'", "worker_id": "'me'", "started_at": _STAMP_SQL}, _FREE)
_task("wf_task_release", "status = 'RUNNING' AND worker_id = 'w1'", wf.release_task, {"status": "'PENDING'", "worker_id": "NULL"})
_task("wf_task_end", "worker_id = 'w1'", lambda t, k: wf.set_task_status(t, k, "SUCCESS", "w1", _NOW), {"status": "'SUCCESS'", "completed_at": _STAMP_SQL}, "worker_id = 'w1'")
_task("wf_task_begin", "worker_id = 'w1'", lambda t, k: wf.set_task_status(t, k, "RUNNING", "w1", _NOW), {"status": "'RUNNING'", "completed_at": "completed_at"}, "worker_id = 'w1'")
_task("wf_task_other_worker", "worker_id = 'w1'", lambda t, k: wf.set_task_status(t, k, "FAILED", "w2", _NOW), {"status": "'FAILED'"}, "worker_id = 'w2'")
_task("wf_task_assign", "worker_id IS NULL", lambda t, k: wf.assign_task(t, k, "me"), {"worker_id": "'me'"}, "worker_id IS NULL")
_task("wf_task_output", "status = 'RUNNING'", lambda t, k: wf.finish_task(t, k, "{}", "SUCCESS", 1500, _NOW), {"output_data": "'{}'", "status": "'SUCCESS'", "completed_at": _STAMP_SQL})
_task("wf_task_error", "status = 'RUNNING'", lambda t, k: wf.fail_task(t, k, "no", "Timeout", "late", _NOW), {"error_message": "'no'", "error_type": "'Timeout'", "error_details": "'late'", "status": "'FAILED'", "completed_at": _STAMP_SQL})


def _change(name: str, which: str, fn: Callable[[DataFrame], DataFrame], key: str, where: str, changes: dict[str, str]) -> None:
    columns = ", ".join(f"CASE WHEN {where} THEN {v} ELSE {c} END AS {c}" for c, v in changes.items())
    _wf(name, which, fn, f"SELECT {key.replace(' ', ', ')}, {columns} FROM {which}", f"{key} {' '.join(changes)}")


_INST = "workflow_instance_id = '5'"
_change("wf_release", "i", lambda i: wf.release_instance(i, "5"), "workflow_instance_id", _INST, {"processor_id": "NULL", "state": "'PENDING'"})
_change("wf_fail", "i", lambda i: wf.fail_instance(i, "5", _NOW), "workflow_instance_id", _INST, {"state": "'FAILED'", "completed_at": _STAMP_SQL, "last_updated": _STAMP_SQL})
_change("wf_set_state", "i", lambda i: wf.set_instance(i, "5", _NOW, state="PAUSED"), "workflow_instance_id", _INST, {"state": "'PAUSED'", "last_updated": _STAMP_SQL})
_change("wf_set_context", "i", lambda i: wf.set_instance(i, "5", _NOW, context_data="{a}"), "workflow_instance_id", _INST, {"context_data": "'{a}'", "last_updated": _STAMP_SQL})
_change("wf_set_output", "i", lambda i: wf.set_instance(i, "5", _NOW, output_data="{b}"), "workflow_instance_id", _INST, {"output_data": "'{b}'", "last_updated": _STAMP_SQL})
_change("wf_def_set_status", "d", lambda d: wf.set_definition_status(d, "Brand#1", 26, "ACTIVE", "me", _NOW), "workflow_id version", "workflow_id = 'Brand#1' AND version = 26", {"status": "'ACTIVE'", "updated_by": "'me'"})
_change("wf_sched_set_time", "s", lambda s: wf.set_next_time(s, 7, _NOW, _NOW), "schedule_id", "schedule_id = 7", {"next_execution_time": _STAMP_SQL, "updated_at": _STAMP_SQL})
_change("wf_sched_set_status", "s", lambda s: wf.set_schedule_status(s, 7, "PAUSED", _NOW), "schedule_id", "schedule_id = 7", {"status": "'PAUSED'", "updated_at": _STAMP_SQL})
_change("wf_sched_success", "s", lambda s: wf.record_execution(s, 7, _NOW, "i9", "COMPLETED", True), "schedule_id", "schedule_id = 7", {"last_execution_time": _STAMP_SQL, "execution_count": "execution_count + 1", "consecutive_failures": "0", "last_workflow_instance_id": "'i9'", "last_workflow_status": "'COMPLETED'"})
_change("wf_sched_pause", "s", lambda s: wf.paused(s, 7, _NOW), "schedule_id", "schedule_id = 7 AND status = 'ACTIVE'", {"status": "'PAUSED'", "updated_at": _STAMP_SQL})
for _name, _equal in (("name", {"workflow_name": "flow3"}), ("version", {"workflow_name": "flow3", "workflow_version": 2}), ("creator", {"created_by": "user2"}), ("lock", {"schedule_id": 7})):
    _wf(f"wf_sched_by_{_name}", "s", lambda s, e=_equal: wf.schedules_where(s, **e), "SELECT * FROM s WHERE " + " AND ".join(f"{c} = '{v}'" for c, v in _equal.items()), _S)

# the rounds of a scheduler over stored schedules
_CHECKED = f"(SELECT *, status = 'ACTIVE' AND NOT early AND new_status = 'ACTIVE' AND coalesce(next_execution_time <= {_STAMP_SQL}, false) AS eligible FROM (SELECT *, CASE WHEN status <> 'ACTIVE' OR early THEN status WHEN coalesce(end_time < {_STAMP_SQL}, false) THEN 'EXPIRED' WHEN execution_count >= max_executions THEN 'COMPLETED' WHEN consecutive_failures >= max_consecutive_failures THEN 'ERROR' ELSE status END AS new_status FROM (SELECT *, coalesce(start_time > {_STAMP_SQL}, false) AS early FROM s)))"
_wf("wf_sched_round", "s", lambda s: wf.started(s, _NOW), f"SELECT schedule_id, CASE WHEN eligible AND schedule_type = 'ONE_TIME' THEN 'COMPLETED' ELSE new_status END AS status, CASE WHEN eligible THEN execution_count + 1 ELSE execution_count END AS execution_count, CASE WHEN eligible THEN {_STAMP_SQL} ELSE last_execution_time END AS last_execution_time FROM {_CHECKED}", "schedule_id status execution_count last_execution_time")
_wf("wf_sched_settle", "s", lambda s: wf.settled(s, s.selectExpr("last_workflow_instance_id as workflow_instance_id", "case when schedule_type = 'CRON' then 'FAILED' when status = 'ACTIVE' then 'COMPLETED' else 'RUNNING' end as state"), _NOW), "SELECT schedule_id, CASE WHEN schedule_type = 'CRON' THEN consecutive_failures + 1 WHEN status = 'ACTIVE' THEN 0 ELSE consecutive_failures END AS consecutive_failures, CASE WHEN schedule_type = 'CRON' THEN 'FAILED' WHEN status = 'ACTIVE' THEN 'COMPLETED' END AS last_workflow_status FROM s", "schedule_id consecutive_failures last_workflow_status")
_wf("wf_sched_remove", "s", lambda s: wf.removed(s, 7), "SELECT schedule_id FROM s WHERE schedule_id <> 7", "schedule_id")
_wf("wf_breaker", "t", lambda t: wf.breaker_state(t, ["worker_id"], ["id"], failures=1, volume=10, percent=5.0), "SELECT worker_id, count(*) AS volume, count(*) FILTER (WHERE status = 'FAILED') AS errors, count(*) FILTER (WHERE status = 'FAILED' AND (good IS NULL OR id > good)) AS in_row, CASE WHEN in_row >= 1 AND volume >= 10 AND errors * 100.0 / volume >= 5 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM (SELECT *, max(CASE WHEN status <> 'FAILED' THEN id END) OVER (PARTITION BY worker_id) AS good FROM t WHERE worker_id IS NOT NULL) GROUP BY worker_id")


@add("wf_sched_create", f"SELECT schedule_type, status, execution_count, next_execution_time, count(*) AS n FROM (SELECT 'FIXED_RATE' AS schedule_type, 'ACTIVE' AS status, 0 AS execution_count, TIMESTAMP '{_NOW}' + to_seconds(c_custkey) AS next_execution_time FROM customer) GROUP BY ALL")
def wf_sched_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").selectExpr("c_custkey + 1000000000 as schedule_id", "'FIXED_RATE' as schedule_type", "cast(null as timestamp_ntz) as start_time", "cast(null as timestamp_ntz) as end_time", "c_custkey as fixed_rate_seconds", "0 as fixed_delay_seconds")
    out = wf.created(derived(spark, sf_dir, "s"), rows, _NOW).where("schedule_id >= 1000000000")
    return out.groupBy("schedule_type", "status", "execution_count", "next_execution_time").agg(F.count("*").alias("n"))


# --- substitution, conditions, backoff, versioning, forks and flows


@add("wf_substitute", "SELECT n_nationkey, n_name || ' in ' || CAST(n_regionkey AS VARCHAR) || '/' AS text FROM nation")
def wf_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("n"), F.col("n_name"), F.lit("r"), F.col("n_regionkey").cast("string"))
    return load(spark, sf_dir, "nation").select("n_nationkey", wf.substitute(F.lit("${n} in ${r}/${none}"), values).alias("text"))


@add("wf_truth", "SELECT o_orderkey, o_orderstatus = 'F' AS same, o_orderstatus = 'O' AS literal, false AS neither FROM orders")
def wf_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    literal = F.when(status == "O", "TRUE").otherwise("false")
    return load(spark, sf_dir, "orders").select("o_orderkey", wf.truth(F.concat(status, F.lit(" == F"))).alias("same"), wf.truth(literal).alias("literal"), wf.truth(F.concat(status, F.lit(" is F"))).alias("neither"))


@add("wf_backoff", "SELECT l_linenumber AS retries, CAST(least(1000 * power(2, l_linenumber), 60000) AS BIGINT) AS millis, count(*) AS n FROM lineitem GROUP BY ALL")
def wf_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("retries"), wf.backoff_ms(F.col("l_linenumber")).alias("millis")).agg(F.count("*").alias("n"))


def _registered(d: DataFrame) -> DataFrame:
    return wf.register(d.drop("created_at"), d.select("workflow_id").distinct().union(d.select(F.lit("new").alias("workflow_id")).limit(1)), _NOW)


_wf("wf_def_register", "d", _registered, "SELECT workflow_id, version, false AS is_latest FROM d UNION ALL SELECT workflow_id, max(version) + 1, true FROM d GROUP BY workflow_id UNION ALL SELECT 'new', 1, true", "workflow_id version is_latest")


@add("wf_fork_join", "SELECT n_regionkey, string_agg(CAST(100 // n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS results FROM nation WHERE n_nationkey > 0 GROUP BY n_regionkey")
def wf_fork_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch for every nation; the one that divides by zero fails and is left out."""

    def branch(row):
        k = int(row["n_nationkey"].iloc[0])
        return row.assign(result=100 // k)[["n_nationkey", "n_regionkey", "result"]]

    done = wf.fork_join(load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), branch, "n_nationkey long, n_regionkey long, result long", ["n_nationkey"])
    return wf.join_results(done, ["n_regionkey"], "result", "n_nationkey").withColumn("results", F.array_join("results", ","))


@add("wf_flow", "SELECT 'count.result' AS key, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'open.result', CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS VARCHAR) FROM orders UNION ALL SELECT 'share', (SELECT CAST(count(*) AS VARCHAR) FROM orders) || ' orders' UNION ALL SELECT 'inner.double', CAST(2 * count(*) AS VARCHAR) FROM orders")
def wf_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow of two parallel Spark jobs, a join, a variable, a decision with a skipped branch, and a sub-flow."""
    orders = load(spark, sf_dir, "orders")
    registry = {
        "count": lambda data: orders.count(),
        "open": lambda data: orders.where("o_orderstatus = 'O'").count(),
        "some": lambda data: None,
        "none": lambda data: 1 / 0,
        "double": lambda data: 2 * int(data["n"]),
    }
    flow = dag.Flow().parallel("count", "open").join("both").then("set", "SET_VARIABLE", inputs={"variables": {"share": "${count.result} orders"}})
    flow = flow.conditional("${count.result}==${count.result}", "some", "none").join("decided").sub("inner", dag.Flow().then("double"), {"n": "${count.result}"})
    run = dag.execute(flow, registry)
    if run.status != "COMPLETED" or run.outcomes["none"].status != "SKIPPED":
        raise RuntimeError(f"the flow ended as {run.status}")
    return spark.createDataFrame([(k, str(run.data[k])) for k in ("count.result", "open.result", "share", "inner.double")], "key string, value string")


# --- stored tables: CSV to segments, layouts and indexes


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part by way of CSV files and a declared schema."""
    path = ingest.scratch(spark)
    load(spark, sf_dir, "part").select("p_size", "p_brand", "p_partkey", F.when(F.col("p_size") % 10 == 0, None).otherwise(F.col("p_retailprice")).alias("p_retailprice")).write.option("header", True).csv(path)
    schema = Schema.from_json('{"schemaName": "part", "dimensionFieldSpecs": [{"name": "p_partkey", "dataType": "LONG"}, {"name": "p_brand", "dataType": "STRING"}], "metricFieldSpecs": [{"name": "p_size", "dataType": "INT"}, {"name": "p_retailprice", "dataType": "DOUBLE", "defaultNullValue": 1.5}]}')
    return ingest.read_csv(spark, path, schema)


@add("csv_rows", "SELECT p_partkey, p_brand, p_size, CASE WHEN p_size % 10 = 0 THEN 1.5 ELSE p_retailprice END AS p_retailprice FROM part")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv(spark, sf_dir)


@add("csv_segments", "SELECT p_brand, count(*) AS n, CAST(max(p_size) AS DOUBLE) AS largest FROM part WHERE p_size BETWEEN 5 AND 40 GROUP BY p_brand")
def csv_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV to two stored segments with their layouts, and a query over both."""
    rows, paths = _csv(spark, sf_dir), [ingest.scratch(spark), ingest.scratch(spark)]
    ingest.write(rows.where("p_partkey % 2 = 0"), paths[0], ingest.Layout(sort=("p_size",), bloom=("p_brand",), distinct={"p_brand": 25}, encoding="snappy"))
    ingest.write(rows.where("p_partkey % 2 = 1"), paths[1], ingest.Layout(partition=("p_brand",), sort=("p_size",)))
    return Engine.of_segments([ingest.read(spark, p).select(*rows.columns) for p in paths], None).query("SELECT p_brand, count(*) AS n, max(p_size) AS largest FROM part WHERE p_size BETWEEN 5 AND 40 GROUP BY p_brand")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate"


def _laid(name: str, layout: ingest.Layout, where: str, oracle: str | None = None) -> None:
    """A filter over lineitem, stored in that layout."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = ingest.scratch(spark)
        ingest.write(load(spark, sf_dir, "lineitem"), path, layout)
        return Engine(ingest.read(spark, path), None).query(f"SELECT {_LINE} FROM lineitem WHERE {where}")

    QUERIES[name], ORACLE[name] = run, f"SELECT {_LINE} FROM lineitem WHERE {oracle or where}"


_laid("idx_sorted", ingest.Layout(sort=("l_partkey",), files=4, row_group_bytes=1 << 18), "l_partkey BETWEEN 20 AND 40")
_laid("idx_sorted_in", ingest.Layout(sort=("l_partkey",), files=4, row_group_bytes=1 << 18), "l_partkey IN (3, 55, 120) OR l_partkey = 77")
_laid("idx_bloom", ingest.Layout(bloom=("l_partkey", "l_suppkey"), distinct={"l_partkey": 20_000, "l_suppkey": 1_000}), "l_partkey = 11 OR l_suppkey = 5")
_laid("idx_inverted", ingest.Layout(sort=("l_returnflag", "l_linestatus"), bloom=("l_returnflag",)), "l_returnflag = 'R' AND NOT l_linestatus = 'O'")
_laid("idx_range", ingest.Layout(sort=("l_quantity",), row_group_bytes=1 << 18, encoding="snappy"), "l_quantity > 48.5 OR l_quantity < 2")
_laid("idx_partition", ingest.Layout(partition=("l_returnflag",), sort=("l_shipdate",)), "l_returnflag = 'A' AND l_shipdate >= '1994-01-01' AND l_shipdate < '1994-06-01'")


@add("idx_equi_depth", f"SELECT {_LINE} FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 31000.5")
def idx_equi_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = ingest.scratch(spark)
    bounds = ranges.write_ranged(load(spark, sf_dir, "lineitem"), path, "l_extendedprice")
    return ranges.between(spark, path, bounds, "l_extendedprice", 20000, 31000.5).select(*_LINE.split(", "))


@add("idx_bit_sliced", "SELECT o_orderkey AS position FROM orders WHERE o_custkey BETWEEN 10 AND 70")
def idx_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = ranges.bit_slices(load(spark, sf_dir, "orders").withColumn("row", F.col("o_orderkey") + 1), "row", "o_custkey")
    return ranges.sliced_between(slices, 10, 70).select((F.col("position") - 1).alias("position"))


# --- what was not covered of selections, groups and logs

_text("sel_unordered", "SELECT n_name FROM nation WHERE n_regionkey < 9 LIMIT 100", "SELECT n_name FROM nation WHERE n_regionkey < 9")
_text("sel_unordered_cut", "SELECT l_linestatus FROM lineitem WHERE l_linestatus = 'F' LIMIT 3, 7", "SELECT 'F' AS l_linestatus FROM range(7)")
_text("distinct_grouped", "SELECT DISTINCT o_orderstatus FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus FROM orders")
_text("distinct_aggregate", "SELECT DISTINCT count(*) AS n FROM lineitem GROUP BY l_orderkey ORDER BY count(*) DESC LIMIT 4", "SELECT DISTINCT n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) ORDER BY n DESC LIMIT 4")


@add("segments_none", f"SELECT {_FIVE.format(c='x')} FROM (SELECT 1 AS x) WHERE x > 1")
def segments_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.of_segments([]).query(f"SELECT {_ALL.format(c='x')} FROM t WHERE y = 'a'")


@add("group_bytes", "SELECT hex(event_type) AS kind, count(*) AS n FROM events GROUP BY event_type")
def group_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.col("event_type").cast("binary").alias("kind"))
    return Engine(events, None).query("SELECT kind, count(*) AS n FROM events GROUP BY kind").withColumn("kind", F.hex("kind"))


@add("log_get", "SELECT key, seq, value FROM (SELECT user_id AS key, event_id AS seq, value, event_type = 'error' AS deleted, row_number() OVER (ORDER BY event_id DESC) AS r FROM events WHERE user_id = 3) WHERE r = 1 AND NOT deleted")
def log_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").selectExpr("user_id as key", "event_id as seq", "value", "event_type = 'error' as deleted")
    return upsert.get(log, 3).drop("deleted")


_LOG = "SELECT user_id AS key, event_id AS seq, value, false AS deleted FROM events"


@add("log_put_delete", f"WITH l AS ({_LOG} UNION ALL SELECT c_custkey, 1000000000, c_acctbal, false FROM customer UNION ALL SELECT user_id, 2000000000, NULL, true FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')) SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM l) WHERE r = 1 AND NOT deleted")
def log_put_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").selectExpr("user_id as key", "event_id as seq", "value", "false as deleted")
    log = upsert.put(log, load(spark, sf_dir, "customer").selectExpr("c_custkey as key", "1000000000L as seq", "c_acctbal as value"))
    gone = load(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("user_id as key", "2000000000L as seq").distinct()
    return upsert.state(upsert.delete(log, gone)[0]).drop("deleted")


@add("log_deleted", "SELECT c_custkey AS key, c_custkey IN (SELECT user_id FROM events) AS found FROM customer")
def log_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").selectExpr("user_id as key", "event_id as seq", "value", "false as deleted")
    return upsert.delete(log, load(spark, sf_dir, "customer").selectExpr("c_custkey as key", "2000000000L as seq"))[1]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(_Lazy(spark, sf_dir)).query("SELECT event_type, count(*), sum(value) FROM events GROUP BY event_type ORDER BY event_type")
