from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import workflow as wf

T0 = datetime(2024, 1, 1)
TASKS = "id long, workflow_id string, task_reference_name string, sequence_number int, dependencies string, status string, worker_id string, scheduled_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, retry_count int, max_retries int, output_data string, execution_time_ms long, error_message string, error_type string, error_details string"


def task(i, w, ref, deps, status, worker=None, scheduled=None, started=None, retries=0):
    return (i, w, ref, i, deps, status, worker, scheduled, started, None, retries, 3, None, None, None, None, None)


@pytest.fixture(scope="module")
def tasks(spark):
    return spark.createDataFrame(
        [
            task(1, "w", "a", None, "SUCCESS", "x"),
            task(2, "w", "b", "a", "PENDING"),
            task(3, "w", "c", "a, b", "PENDING"),
            task(4, "w", "d", "ghost", "PENDING"),
            task(5, "w", "e", "", "PENDING", None, datetime(2025, 1, 1)),
            task(6, "w", "f", "a", "RUNNING", "x", None, datetime(2023, 1, 1), 1),
            task(7, "w", "g", None, "RUNNING", "y", None, datetime(2023, 1, 1), 3),
            task(8, "v", "b", "a", "PENDING", "z"),
        ],
        TASKS,
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def one(df, i):
    return df.where(F.col("id") == i).first()


def test_readiness_in_both_readings(tasks):
    assert ids(wf.ready_tasks(tasks)) == [2, 4, 5]  # a dependency that names no task does not block
    assert ids(wf.satisfied_tasks(tasks)) == [2, 5]  # or is never finished
    assert ids(wf.ready_tasks(tasks, 1)) == [2]
    assert ids(wf.claimable_task(tasks, T0)) == [2]


ALIKE = [
    task(1, "w", "a", None, "RUNNING", "x"),
    task(1, "v", "a", None, "SUCCESS", "x"),
    task(2, "w", "b", "a", "PENDING"),
    task(2, "v", "b", "a", "PENDING"),
    task(2, "v", "c", "a,b", "PENDING"),
    task(2, None, "d", None, "PENDING"),
    task(2, None, "e", "a", "PENDING"),
]


def test_ready_tasks_are_told_apart_where_they_share_an_id(spark):
    """A task is held back by its own dependencies, not by those of another with its id."""
    got = wf.ready_tasks(spark.createDataFrame(ALIKE, TASKS))
    assert sorted((r.workflow_id or "", r.task_reference_name) for r in got.collect()) == [("", "d"), ("", "e"), ("v", "b")]
    assert got.columns == [c.split()[0] for c in TASKS.split(", ")]
    first = wf.claimable_task(spark.createDataFrame([r for r in ALIKE if r[1]], TASKS), T0).first()
    assert (first.workflow_id, first.task_reference_name) == ("v", "b")


def test_satisfied_tasks_are_told_apart_where_they_share_an_id(spark):
    got = wf.satisfied_tasks(spark.createDataFrame(ALIKE, TASKS))
    assert sorted((r.workflow_id or "", r.task_reference_name) for r in got.collect()) == [("", "d"), ("v", "b")]  # no workflow, no finished task
    assert got.columns == [c.split()[0] for c in TASKS.split(", ")]


def test_task_reads(tasks):
    assert [r.id for r in wf.tasks_of(tasks, "w").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert ids(wf.tasks_by_status(tasks, "RUNNING")) == [6, 7] and ids(wf.tasks_by_status(tasks, "RUNNING", "y")) == [7]
    assert ids(wf.unassigned(tasks)) == [2, 3, 4, 5]
    assert ids(wf.pending_tasks(tasks, T0, 10)) == [2, 3, 4]
    assert ids(wf.stale_tasks(tasks, T0)) == [6, 7]
    assert {(r.workflow_id, r.status): r.n for r in wf.task_counts(tasks).collect()}["w", "PENDING"] == 4


def test_task_updates(tasks):
    a = wf.acquire_task(tasks, 2, "me", T0)
    assert (one(a, 2).status, one(a, 2).worker_id, one(a, 2).started_at) == ("RUNNING", "me", T0)
    assert a.schema == tasks.schema and a.count() == tasks.count()
    assert one(wf.acquire_task(tasks, 8, "me", T0), 8).worker_id == "z"
    assert one(wf.release_task(a, 2), 2).status == "PENDING"
    s = wf.set_task_status(tasks, 6, "FAILED", "x", T0)
    assert (one(s, 6).status, one(s, 6).completed_at) == ("FAILED", T0)
    assert one(wf.set_task_status(tasks, 6, "RETRYING", "x", T0), 6).completed_at is None
    assert one(wf.set_task_status(tasks, 6, "FAILED", "other", T0), 6).status == "RUNNING"
    assert one(wf.assign_task(tasks, 3, "n"), 3).worker_id == "n"
    r = wf.reset_stale_tasks(tasks, T0)
    assert (one(r, 6).status, one(r, 6).retry_count, one(r, 6).worker_id) == ("PENDING", 2, None) and one(r, 7).status == "RUNNING"
    assert one(wf.finish_task(tasks, 6, "out", "SUCCESS", 12, T0), 6).execution_time_ms == 12
    assert one(wf.fail_task(tasks, 6, "m", "k", "d", T0), 6).error_type == "k"
    c = wf.cancel_tasks(tasks, "w", T0)
    assert {r.status for r in c.where("workflow_id = 'w'").collect()} == {"SUCCESS", "CANCELLED"} and one(c, 8).status == "PENDING"


INSTANCES = "workflow_instance_id string, state string, priority int, processor_id string, started_at timestamp_ntz, completed_at timestamp_ntz, last_updated timestamp_ntz, retry_count int, max_retries int, parent_workflow_id string, output_data string"


@pytest.fixture(scope="module")
def instances(spark):
    d = lambda n: datetime(2024, 1, n)
    return spark.createDataFrame(
        [
            ("a", "NOT_STARTED", 1, None, d(3), None, d(3), 0, 3, None, None),
            ("b", "PENDING", 5, "", d(4), None, d(4), 0, 3, "a", None),
            ("c", "PENDING", 5, None, d(2), None, d(2), 0, 3, "a", None),
            ("d", "RUNNING", 9, "p", d(1), None, d(1), 0, 3, None, None),
            ("e", "COMPLETED", 9, "p", d(1), d(2), d(2), 0, 3, None, None),
            ("f", "FAILED", 9, "p", None, d(5), d(5), 0, 3, None, None),
        ],
        INSTANCES,
    )


def test_instances(instances):
    assert wf.claimable_instance(instances).first().workflow_instance_id == "c"
    assert [r.workflow_instance_id for r in wf.pending_by_priority(instances).collect()] == ["c", "b", "a"]
    assert wf.instances_where(instances, parent_workflow_id="a", state=["PENDING"]).count() == 2
    assert [r.workflow_instance_id for r in wf.instances_where(instances, page=1, size=4).collect()] == ["e", "f"]
    m = wf.metrics(instances, datetime(2024, 1, 2)).first()
    assert tuple(m) == (1, 1, 1, 3, 3, 1, 1, 86400.0)
    assert wf.metrics(instances.limit(0), T0).first().mean_seconds is None
    key = lambda df, k: df.where(F.col("workflow_instance_id") == k).first()
    assert key(wf.claim_instance(instances, "c", "me", T0), "c").state == "RUNNING"
    assert key(wf.claim_instance(instances, "b", "me", T0), "b").state == "PENDING"  # a blank processor is not null
    assert key(wf.release_instance(instances, "d"), "d").state == "PENDING"
    assert key(wf.reset_stale_instances(instances, datetime(2024, 1, 2)), "d").retry_count == 1
    assert key(wf.transition(instances, "d", "RUNNING", "PAUSED", T0), "d").state == "PAUSED"
    assert key(wf.transition(instances, "d", "FAILED", "PAUSED", T0), "d").state == "RUNNING"
    assert key(wf.fail_instance(instances, "d", T0), "d").completed_at == T0
    assert key(wf.set_instance(instances, "d", T0, output_data="{}"), "d").output_data == "{}"
    assert [r.workflow_instance_id for r in wf.stale_instances(instances, datetime(2024, 1, 2)).collect()] == ["d"]
    assert wf.window_start("24h", datetime(2024, 1, 2)) == T0 and wf.window_start("1d", datetime(2024, 1, 2)) == T0
    assert wf.window_start("soon", datetime(2024, 1, 1, 1)) == T0


def test_definitions(spark):
    d = spark.createDataFrame(
        [("w", "flow", 1, "ACTIVE", False, "x,y", "me", T0, None, None, None, None, None), ("w", "flow", 2, "ACTIVE", True, "x", "me", T0, None, None, None, None, None), ("v", "air", 1, "DRAFT", True, "y", "you", T0, None, None, None, None, None)],
        "workflow_id string, workflow_name string, version int, status string, is_latest boolean, tags string, created_by string, created_at timestamp_ntz, updated_at timestamp_ntz, updated_by string, deprecated_at timestamp_ntz, deprecated_by string, deprecation_reason string",
    )
    assert wf.latest_definition(d, workflow_name="flow").first().version == 2
    assert wf.exact_definition(d, 1, workflow_id="w").count() == 1
    assert [r.version for r in wf.definition_versions(d, workflow_id="w").collect()] == [2, 1]
    assert [r.workflow_id for r in wf.latest_definitions(d).collect()] == ["v", "w"]
    assert wf.latest_definitions(d, active=True).count() == 1 and wf.latest_definitions(d, tag="x").count() == 1
    assert [r.version for r in wf.definitions_by_status(d, "ACTIVE").collect()] == [2, 1]
    assert wf.next_version(d, "w").first()[0] == 3 and wf.next_version(d, "none").first()[0] == 1
    assert wf.definitions_by_creator(d, "me").count() == 2 and wf.count_active(d).first().n == 1
    assert wf.definition_exists(d, workflow_id="w").first().present and not wf.definition_exists(d, workflow_id="z").first().present
    s = wf.set_latest(d, "w", 1, T0)
    assert wf.latest_definition(s, workflow_id="w").first().version == 1 and wf.latest_definition(s, workflow_id="v").count() == 1
    assert wf.exact_definition(wf.set_definition_status(d, "w", 1, "DRAFT", "z", T0), 1, workflow_id="w").first().updated_by == "z"
    gone = wf.exact_definition(wf.deprecate(d, "w", 2, "z", "old", T0), 2).first()
    assert (gone.status, gone.is_latest, gone.deprecation_reason) == ("DEPRECATED", False, "old")
    new = wf.register(d, spark.createDataFrame([("w", "flow", "DRAFT"), ("n", "new", "DRAFT")], "workflow_id string, workflow_name string, status string"), T0)
    assert sorted((r.workflow_id, r.version) for r in new.where("is_latest").collect()) == [("n", 1), ("v", 1), ("w", 3)]
    assert new.count() == 5


def test_schedules(spark):
    d = lambda n: datetime(2024, 1, n)
    s = spark.createDataFrame(
        [
            ("due", "FIXED_RATE", "ACTIVE", None, None, d(9), d(8), 3600, 60, 0, None, 0, 3, d(1)),
            ("early", "FIXED_DELAY", "ACTIVE", d(11), None, d(9), None, 3600, 60, 0, None, 0, 3, d(1)),
            ("over", "CRON", "ACTIVE", None, d(9), d(9), None, 3600, 60, 0, None, 0, 3, d(1)),
            ("spent", "ONE_TIME", "ACTIVE", None, None, d(9), None, 3600, 60, 5, 5, 0, 3, d(1)),
            ("broken", "CRON", "ACTIVE", None, None, d(9), None, 3600, 60, 0, None, 3, 3, d(1)),
            ("done", "CRON", "COMPLETED", None, None, None, None, 3600, 60, 0, None, 0, 3, d(1)),
        ],
        "schedule_id string, schedule_type string, status string, start_time timestamp_ntz, end_time timestamp_ntz, next_execution_time timestamp_ntz, last_execution_time timestamp_ntz, fixed_rate_seconds int, fixed_delay_seconds int, execution_count int, max_executions int, consecutive_failures int, max_consecutive_failures int, updated_at timestamp_ntz",
    )
    s = s.withColumns({"last_workflow_instance_id": F.lit(None).cast("string"), "last_workflow_status": F.lit(None).cast("string")})
    now = d(10)
    names = lambda df: sorted(r.schedule_id for r in df.collect())
    assert names(wf.due_schedules(s, now)) == ["broken", "due", "spent"]
    e = {r.schedule_id: (r.eligible, r.new_status) for r in wf.eligibility(s, now).collect()}
    assert e == {"due": (True, "ACTIVE"), "early": (False, "ACTIVE"), "over": (False, "EXPIRED"), "spent": (False, "COMPLETED"), "broken": (False, "ERROR"), "done": (False, "COMPLETED")}
    n = {r.schedule_id: r.next_time for r in wf.next_time(s, now).collect()}
    assert n["due"] == datetime(2024, 1, 8, 1) and n["early"] == datetime(2024, 1, 10, 0, 1) and n["spent"] is None and n["over"] is None
    assert names(wf.active_recurring(s)) == ["broken", "due", "early", "over"]
    assert names(wf.schedules_in_error(s)) == ["broken"] and names(wf.expired_schedules(s, now)) == ["over"]
    assert names(wf.schedules_where(s, schedule_type="CRON", status="COMPLETED")) == ["done"]
    assert names(wf.delete_old(s, now)) == ["broken", "due", "early", "over", "spent"]
    r = wf.record_execution(s, "broken", now, "i", "FAILED", False).where("schedule_id = 'broken'").first()
    assert (r.execution_count, r.consecutive_failures, r.last_execution_time) == (1, 4, now)
    assert wf.record_execution(s, "broken", now, "i", "COMPLETED", True).where("schedule_id = 'broken'").first().consecutive_failures == 0
    assert wf.set_next_time(s, "due", d(20), now).where("schedule_id = 'due'").first().next_execution_time == d(20)
    assert wf.set_schedule_status(s, "due", "PAUSED", now).where("schedule_id = 'due'").first().status == "PAUSED"


def test_dataflow(spark, tasks):
    def half(pdf):
        if pdf.x.iloc[0] % 2:
            raise ValueError("odd")
        return pdf.assign(y=pdf.x // 2)[["k", "x", "y"]]

    rows = spark.createDataFrame([("a", 4), ("a", 3), ("a", 2), ("b", 8)], "k string, x long")
    out = wf.fork_join(rows, half, "k string, x long, y long", ["k"])
    assert {r.k: r.results for r in wf.join_results(out, ["k"], "y", "x").collect()} == {"a": [1, 2], "b": [4]}
    with pytest.raises(Exception, match="odd"):
        wf.fork_join(rows, half, "k string, x long, y long", ["k"], fail_fast=True).collect()
    assert wf.fork_summary(tasks, ["workflow_id"]).where("workflow_id = 'w'").first().total == 7
    assert wf.error_rate(tasks, ["workflow_id"]).where("workflow_id = 'v'").first().error_percent == 0.0
    t = spark.createDataFrame([("${a} and ${b}${a}", {"a": "1"}), ("plain", {"a": "1"}), (None, {})], "t string, v map<string,string>")
    assert [r[0] for r in t.select(wf.substitute(F.col("t"), F.col("v"))).collect()] == ["1 and 1", "plain", None]
    c = spark.createDataFrame([("TRUE",), ("false",), ("a == a",), ("a==b",), ("==",), ("a==a==a",), ("x",), ("",)], "c string")
    assert [r[0] for r in c.select(wf.truth(F.col("c"))).collect()] == [True, False, True, False, False, False, False, False]
    b = spark.range(8).select(wf.backoff_ms(F.col("id")))
    assert [r[0] for r in b.collect()] == [1000, 2000, 4000, 8000, 16000, 32000, 60000, 60000]
    assert wf.sub_workflow({"x": 1}, "s", {"in": "x"}, lambda d: {"y": d["in"] + 1}) == {"x": 1, "s_output": {"y": 2}, "s.y": 2}
