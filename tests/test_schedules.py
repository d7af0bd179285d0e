import random
import threading
import time
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import cron, ranges
from millrace.operators import workflow as wf
from millrace.operators.scheduler import Scheduler


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("* * * * *", "2024-02-28 23:59:00"),
        ("0 0 29 2 *", "2024-02-29 00:00:00"),
        ("30 0 0 1 1 ?", "2025-01-01 00:00:30"),
        ("0 */15 8-9 * * MON-FRI", "2024-02-29 08:00:00"),
        ("5,50 23 * * SUN", "2024-03-03 23:05:00"),
        ("0 12 31 APR,JUN *", None),
        ("0 0 * * 7", "2024-03-03 00:00:00"),
        ("10/20 58 23 28 2 *", "2024-02-28 23:58:30"),
    ],
)
def test_next_time_of_cron(expression, want):
    now = datetime(2024, 2, 28, 23, 58, 10)
    got = cron.next_after(expression, now)
    assert (got and str(got)) == want


def test_cron_against_every_second():
    for e in ("*/7 3-5 * * * *", "0 0 1,13 * * *", "15 30 6 * * 2"):
        now, fields = datetime(2023, 12, 30, 5, 59, 58), cron.parse(e)
        t = now + timedelta(seconds=1)
        while not (t.second in fields[0] and t.minute in fields[1] and t.hour in fields[2] and (t.weekday() + 1) % 7 in fields[5]):
            t += timedelta(seconds=1)
        assert cron.next_after(e, now) == t


@pytest.mark.parametrize("bad", ["* * *", "61 * * * *", "5-1 * * * *", "*/0 * * * *", "x * * * *"])
def test_what_is_no_cron_raises(bad):
    with pytest.raises((ValueError, KeyError)):
        cron.parse(bad)


def test_scheduler_runs_pauses_and_cancels():
    ran, done = [], threading.Event()
    with Scheduler() as s:
        once = s.after(0.01, lambda: ran.append("once"))
        when = s.at(datetime.now() + timedelta(milliseconds=20), lambda: ran.append("at"))
        often = s.every(0.02, lambda: (ran.append("often"), ran.count("often") > 2 and done.set()), delay=0)
        bad = s.every(0.02, lambda: 1 / 0)
        never = s.after(0.2, lambda: ran.append("never"))
        far = s.cron("0 0 1 1 *", lambda: ran.append("cron"))
        assert s.cancel(never) and not s.cancel(never) and s.pause(far) and s.resume(far) and not s.resume(far)
        assert done.wait(5)
        assert s.pause(often)
        time.sleep(0.05)
        count = ran.count("often")
        time.sleep(0.1)
        assert ran.count("often") == count and s.resume(often)
        time.sleep(0.2)
        assert ran.count("often") > count and {"once", "at"} <= set(ran) and not {"never", "cron"} & set(ran)
        assert s.jobs[once].state == s.jobs[when].state == "DONE" and s.jobs[bad].errors and s.jobs[bad].state == "ACTIVE"
        with pytest.raises(ValueError):
            s.cron("0 0 30 2 *", print)


def test_rounds_of_stored_schedules(spark):
    now = "2024-01-15 00:00:00"
    none = spark.createDataFrame([], "schedule_id long, schedule_type string, status string, start_time timestamp_ntz, end_time timestamp_ntz, next_execution_time timestamp_ntz, last_execution_time timestamp_ntz, fixed_rate_seconds int, fixed_delay_seconds int, cron_expression string, execution_count int, max_executions int, consecutive_failures int, max_consecutive_failures int, updated_at timestamp_ntz, last_workflow_instance_id string, last_workflow_status string")
    rows = spark.createDataFrame([(1, "ONE_TIME", None), (2, "FIXED_RATE", None), (3, "FIXED_DELAY", None), (4, "CRON", "30 1 * * *")], "schedule_id long, schedule_type string, cron_expression string")
    rows = rows.selectExpr("*", "cast(null as timestamp_ntz) start_time", "cast(null as timestamp_ntz) end_time", "60 fixed_rate_seconds", "90 fixed_delay_seconds", "5 max_executions", "3 max_consecutive_failures", "cast(schedule_id as string) last_workflow_instance_id")
    made = wf.created(none, rows, now)
    due = {r.schedule_id: str(r.next_execution_time)[11:] for r in made.collect()}
    assert due == {1: "00:00:00", 2: "00:01:00", 3: "00:01:30", 4: "01:30:00"}
    later = "2024-01-15 00:01:10"
    ran = {r.schedule_id: r for r in wf.started(made, later).collect()}
    assert [(ran[k].status, ran[k].execution_count) for k in (1, 2, 3, 4)] == [("COMPLETED", 1), ("ACTIVE", 1), ("ACTIVE", 0), ("ACTIVE", 0)]
    paused = wf.paused(made, 3, now)
    assert paused.where("schedule_id = 3").first().status == "PAUSED" and wf.started(paused, "2024-01-16").where("schedule_id = 3").first().execution_count == 0
    back = wf.resumed(paused, 3, later).where("schedule_id = 3").first()
    assert back.status == "ACTIVE" and str(back.next_execution_time)[11:] == "00:02:40"
    assert wf.removed(made, 2).count() == 3
    ends = spark.createDataFrame([("2", "FAILED"), ("3", "RUNNING"), ("4", "COMPLETED")], "workflow_instance_id string, state string")
    after = wf.settled(made, ends, now)
    assert {r.schedule_id: (r.consecutive_failures, r.last_workflow_status) for r in after.collect()} == {1: (0, None), 2: (1, "FAILED"), 3: (0, None), 4: (0, "COMPLETED")}
    assert wf.settled(after, ends, now).where("schedule_id = 2").first().consecutive_failures == 1  # told once


def shuffled(spark, df):
    """df's rows, and the most rows that a stage read from a shuffle while they were made."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()
    spark.sparkContext.setJobGroup(group := uuid.uuid4().hex, "")
    out = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = spark.sparkContext.statusTracker()
    ours = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
    return out, max(s.shuffleReadRecords() for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() in ours)


def test_breaker_state_shuffles_no_group_of_many_rows(spark):
    """One worker has nearly all the tasks; it and its failures are told where they lie."""
    rows = spark.range(40_000, numPartitions=4).selectExpr("if(id % 100 = 0, concat('w', id), 'w') as k", "id as n", "if(id % 3 = 0, 'SUCCESS', 'FAILED') as status")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of a large table
    try:
        got, most = shuffled(spark, wf.breaker_state(rows, ["k"], ["n"], hot=1000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {r.k: (r.volume, r.errors, r.in_row, r.state) for r in got}["w"] == (39600, 26400, 0, "CLOSED") and len(got) == 401
    assert most < 2000


@pytest.mark.parametrize("hot", [0, 1, 3, 1000])
def test_breaker_state_is_the_same_whichever_groups_are_broadcast(spark, hot):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "b", None, f"x{i % 40}"]), draw.choice([1, 2, None]), draw.choice([None, i, i // 50]), draw.choice(["SUCCESS", "FAILED", "FAILED", None])) for i in range(600)]
    rows += [("lost", 1, i, "FAILED") for i in range(20)] + [("odd", 1, 1, None), ("odd", 1, 2, "FAILED")]
    want = {}
    for k in {r[:2] for r in rows if None not in r[:2]}:
        own = [r for r in rows if r[:2] == k]
        at = lambda r: (r[2] is not None, r[2] or 0)
        good = max((at(r) for r in own if r[3] not in (None, "FAILED")), default=None)
        bad = [r for r in own if r[3] == "FAILED"]
        want[k] = (len(own), len(bad), sum(good is None or at(r) > good for r in bad))
    df = spark.createDataFrame(rows, "k string, `the p` int, n int, status string")
    got = wf.breaker_state(df, ["k", "the p"], ["n"], hot=hot)
    assert got.columns == ["k", "the p", "volume", "errors", "in_row", "state"]
    assert {(r[0], r[1]): (r.volume, r.errors, r.in_row) for r in got.collect()} == want


def test_breaker_state_over_tables(spark):
    rows = [("a", k, "FAILED" if k > 4 else "SUCCESS") for k in range(12)] + [("b", k, "FAILED" if k % 2 else "SUCCESS") for k in range(12)] + [("c", k, "FAILED") for k in range(4)]
    got = {r.k: (r.volume, r.errors, r.in_row, r.state) for r in wf.breaker_state(spark.createDataFrame(rows, "k string, n int, status string"), ["k"], ["n"]).collect()}
    assert got == {"a": (12, 7, 7, "OPEN"), "b": (12, 6, 1, "CLOSED"), "c": (4, 4, 4, "CLOSED")}


def test_equi_depth_ranges(spark, tmp_path):
    df = spark.range(5000).select("id", (F.col("id") * F.col("id") % 4999).cast("double").alias("x")).union(spark.createDataFrame([(9000, None)], "id long, x double"))
    path = str(tmp_path / "r")
    bounds = ranges.write_ranged(df, path, "x")
    assert 1 < len(bounds) < ranges.MOST
    for low, high in ((100, 300), (-5, 12.5), (bounds[2], bounds[5]), (4998, 9e9), (7, 3), (-9e9, 9e9)):
        want = {r.id for r in df.where((F.col("x") >= low) & (F.col("x") <= high)).collect()}
        assert {r.id for r in ranges.between(spark, path, bounds, "x", low, high).collect()} == want
    plan = ranges.between(spark, path, bounds, "x", 100, 300)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range_id" in plan or "range_id#" in plan.split("PartitionFilters")[1][:60]


def test_bit_slices(spark):
    df = spark.range(1, 40_000).select("id", F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 1000).alias("v"))
    slices = ranges.bit_slices(df, "id", "v")
    for low, high in ((0, 0), (5, 37), (998, 5000), (40, 12), (-3, 2), (0, 1 << 40)):
        want = {r.id for r in df.where((F.col("v") >= low) & (F.col("v") <= high)).collect()}
        assert {r.position for r in ranges.sliced_between(slices, low, high).collect()} == want
    with pytest.raises(Exception, match="negative"):
        ranges.bit_slices(spark.createDataFrame([(1, -1)], "id long, v long"), "id", "v").collect()
