"""Reports over workflow tables, and updates as functions from one snapshot to the next.

Tables (columns in snake case): workflow_instances, task_executions, workflow_definitions,
scheduled_workflows. Spark has no row locks, so claims only say which row would be claimed; updates
return the whole new snapshot, to be written by whoever owns the table.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import cron

DONE = ("SUCCESS", "SKIPPED")
ENDED = ("SUCCESS", "FAILED", "CANCELLED", "SKIPPED")
WAITING = ("NOT_STARTED", "PENDING")
RECURRING = ("FIXED_RATE", "FIXED_DELAY", "CRON")
_STAMP = "timestamp_ntz"


def at(t: datetime | str) -> Column:
    return F.lit(t).cast(_STAMP)


# --- tasks


def tasks_of(tasks: DataFrame, workflow_id: str) -> DataFrame:
    return tasks.where(F.col("workflow_id") == workflow_id).orderBy("sequence_number")


def tasks_by_status(tasks: DataFrame, status: str, worker_id: str | None = None) -> DataFrame:
    out = tasks.where(F.col("status") == status)
    return out if worker_id is None else out.where(F.col("worker_id") == worker_id)


def unassigned(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'PENDING' and worker_id is null")


def pending_tasks(tasks: DataFrame, now: datetime | str, limit: int) -> DataFrame:
    """Unassigned tasks whose time has come, by workflow and sequence."""
    due = F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= at(now))
    return unassigned(tasks).where(due).orderBy("workflow_id", "sequence_number", "id").limit(limit)


def _dependencies(tasks: DataFrame) -> DataFrame:
    """workflow_id, dependencies and dep of every dependency named in the tasks' lists; equal lists of a workflow count once."""
    names = F.explode(F.split(F.coalesce("dependencies", F.lit("")), ","))
    lists = tasks.select("workflow_id", "dependencies").distinct()
    return lists.select("workflow_id", "dependencies", names.alias("dep")).withColumn("dep", F.trim("dep")).where("dep <> ''")


def _without(waiting: DataFrame, held: DataFrame) -> DataFrame:
    """The tasks whose workflow and list of dependencies are not among those held back. Nothing is told by id, which tasks may share."""
    held = held.select(F.col("workflow_id").alias("__workflow"), F.col("dependencies").alias("__list")).distinct()
    return waiting.join(held, F.col("workflow_id").eqNullSafe(F.col("__workflow")) & (F.col("dependencies") == F.col("__list")), "left_anti")


def _unblocked(waiting: DataFrame, tasks: DataFrame) -> DataFrame:
    open_ = tasks.where(~F.col("status").isin(*DONE)).select("workflow_id", F.col("task_reference_name").alias("dep")).distinct()
    return _without(waiting, _dependencies(waiting).join(open_, ["workflow_id", "dep"], "left_semi"))


def ready_tasks(tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """Unassigned pending tasks none of whose dependencies is unfinished; one that names no task does not block.

    By workflow and sequence where a limit cuts them, else in no order, which would cost a sort of all.
    """
    out = _unblocked(unassigned(tasks), tasks)
    return out if limit is None else out.orderBy("workflow_id", "sequence_number", "id").limit(limit)


def claimable_task(tasks: DataFrame, now: datetime | str) -> DataFrame:
    """The task that would be claimed next: ready, its time come, first by workflow and sequence."""
    due = F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= at(now))
    waiting = unassigned(tasks).where(due)
    return _unblocked(waiting, tasks).orderBy("workflow_id", "sequence_number", "id").limit(1)


def satisfied_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks all of whose dependencies are finished; one that names no task is never finished."""
    waiting = tasks.where("status = 'PENDING'")
    done = tasks.where(F.col("status").isin(*DONE)).select("workflow_id", F.col("task_reference_name").alias("dep")).distinct()
    return _without(waiting, _dependencies(waiting).join(done, ["workflow_id", "dep"], "left_anti"))


def stale_tasks(tasks: DataFrame, threshold: datetime | str) -> DataFrame:
    return tasks.where((F.col("status") == "RUNNING") & (F.col("started_at") < at(threshold)))


def task_counts(tasks: DataFrame) -> DataFrame:
    """Tasks of each workflow and status."""
    return tasks.groupBy("workflow_id", "status").agg(F.count("*").alias("n"))


def update(table: DataFrame, guard: Column, **values: Column) -> DataFrame:
    """The snapshot after an UPDATE: where the guard holds, the columns take the values, computed from the old row."""
    hit = F.coalesce(guard, F.lit(False))
    return table.select(*[F.when(hit, values[c].cast(t)).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c, t in table.dtypes])


def acquire_task(tasks: DataFrame, task_id: int, worker_id: str, now: datetime | str) -> DataFrame:
    return update(tasks, (F.col("id") == task_id) & F.col("worker_id").isNull() & (F.col("status") == "PENDING"), worker_id=F.lit(worker_id), status=F.lit("RUNNING"), started_at=at(now))


def release_task(tasks: DataFrame, task_id: int) -> DataFrame:
    return update(tasks, F.col("id") == task_id, worker_id=F.lit(None), status=F.lit("PENDING"))


def set_task_status(tasks: DataFrame, task_id: int, status: str, worker_id: str, now: datetime | str) -> DataFrame:
    done = at(now) if status in ENDED else F.col("completed_at")
    return update(tasks, (F.col("id") == task_id) & (F.col("worker_id") == worker_id), status=F.lit(status), completed_at=done)


def assign_task(tasks: DataFrame, task_id: int, worker_id: str) -> DataFrame:
    return update(tasks, (F.col("id") == task_id) & F.col("worker_id").isNull(), worker_id=F.lit(worker_id))


def reset_stale_tasks(tasks: DataFrame, threshold: datetime | str) -> DataFrame:
    guard = (F.col("status") == "RUNNING") & (F.col("started_at") < at(threshold)) & (F.col("retry_count") < F.col("max_retries"))
    return update(tasks, guard, status=F.lit("PENDING"), worker_id=F.lit(None), retry_count=F.col("retry_count") + 1)


def finish_task(tasks: DataFrame, task_id: int, output: str, status: str, millis: int, now: datetime | str) -> DataFrame:
    return update(tasks, F.col("id") == task_id, output_data=F.lit(output), status=F.lit(status), completed_at=at(now), execution_time_ms=F.lit(millis))


def fail_task(tasks: DataFrame, task_id: int, message: str, kind: str, details: str, now: datetime | str) -> DataFrame:
    return update(tasks, F.col("id") == task_id, error_message=F.lit(message), error_type=F.lit(kind), error_details=F.lit(details), status=F.lit("FAILED"), completed_at=at(now))


def cancel_tasks(tasks: DataFrame, workflow_id: str, now: datetime | str) -> DataFrame:
    return update(tasks, (F.col("workflow_id") == workflow_id) & F.col("status").isin("PENDING", "RUNNING"), status=F.lit("CANCELLED"), completed_at=at(now))


# --- instances


def instances_where(instances: DataFrame, page: int | None = None, size: int = 20, **equal: str | list[str]) -> DataFrame:
    """Instances by any columns, each one value or a list; a page of them by id where a page is asked for."""
    out = instances
    for c, v in equal.items():
        out = out.where(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
    return out if page is None else out.orderBy("workflow_instance_id").offset(page * size).limit(size)


def pending_by_priority(instances: DataFrame, limit: int | None = None) -> DataFrame:
    out = instances.where(F.col("state").isin(*WAITING)).orderBy(F.col("priority").desc(), F.col("started_at").asc_nulls_last(), "workflow_instance_id")
    return out if limit is None else out.limit(limit)


def claimable_instance(instances: DataFrame) -> DataFrame:
    """The instance that would be claimed next."""
    return pending_by_priority(instances.where("processor_id is null or processor_id = ''"), 1)


def stale_instances(instances: DataFrame, threshold: datetime | str) -> DataFrame:
    return instances.where((F.col("state") == "RUNNING") & (F.col("last_updated") < at(threshold)))


def seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def metrics(instances: DataFrame, since: datetime | str) -> DataFrame:
    """Eight numbers in one pass: three states, pending, and started, completed, failed and mean seconds since then."""
    s, done = F.col("state"), F.col("completed_at") >= at(since)
    return instances.agg(
        F.count_if(s == "RUNNING").alias("running"),
        F.count_if(s == "COMPLETED").alias("completed"),
        F.count_if(s == "FAILED").alias("failed"),
        F.count_if(s.isin(*WAITING)).alias("pending"),
        F.count_if(F.col("started_at") >= at(since)).alias("started_since"),
        F.count_if(done & (s == "COMPLETED")).alias("completed_since"),
        F.count_if(done & (s == "FAILED")).alias("failed_since"),
        F.avg(F.when(done & F.col("started_at").isNotNull(), seconds(F.col("started_at"), F.col("completed_at")))).alias("mean_seconds"),
    )


def window_start(window: str, now: datetime) -> datetime:
    """`24h` or `7d` before now; an hour for anything else."""
    from datetime import timedelta

    unit = {"h": 3600, "d": 86400}.get(window[-1:])
    return now - timedelta(seconds=int(window[:-1]) * unit if unit else 3600)


def claim_instance(instances: DataFrame, instance_id: str, processor_id: str, now: datetime | str) -> DataFrame:
    guard = (F.col("workflow_instance_id") == instance_id) & F.col("processor_id").isNull() & F.col("state").isin(*WAITING)
    return update(instances, guard, processor_id=F.lit(processor_id), state=F.lit("RUNNING"), last_updated=at(now))


def release_instance(instances: DataFrame, instance_id: str) -> DataFrame:
    return update(instances, F.col("workflow_instance_id") == instance_id, processor_id=F.lit(None), state=F.lit("PENDING"))


def reset_stale_instances(instances: DataFrame, threshold: datetime | str) -> DataFrame:
    guard = (F.col("state") == "RUNNING") & (F.col("last_updated") < at(threshold)) & (F.col("retry_count") < F.col("max_retries"))
    return update(instances, guard, processor_id=F.lit(None), state=F.lit("PENDING"), retry_count=F.col("retry_count") + 1)


def fail_instance(instances: DataFrame, instance_id: str, now: datetime | str) -> DataFrame:
    return update(instances, F.col("workflow_instance_id") == instance_id, state=F.lit("FAILED"), completed_at=at(now), last_updated=at(now))


def set_instance(instances: DataFrame, instance_id: str, now: datetime | str, **values: str) -> DataFrame:
    """New state, context_data or output_data."""
    return update(instances, F.col("workflow_instance_id") == instance_id, last_updated=at(now), **{k: F.lit(v) for k, v in values.items()})


def transition(instances: DataFrame, instance_id: str, expected: str, new: str, now: datetime | str) -> DataFrame:
    """Compare and set: only where the state is still the expected one."""
    return update(instances, (F.col("workflow_instance_id") == instance_id) & (F.col("state") == expected), state=F.lit(new), last_updated=at(now))


# --- definitions


def latest_definition(definitions: DataFrame, **equal: str) -> DataFrame:
    out = definitions.where("is_latest")
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def exact_definition(definitions: DataFrame, version: int, **equal: str) -> DataFrame:
    out = definitions.where(F.col("version") == version)
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def definition_versions(definitions: DataFrame, **equal: str) -> DataFrame:
    out = definitions
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out.orderBy(F.col("version").desc())


def definitions_by_status(definitions: DataFrame, status: str) -> DataFrame:
    return definitions.where(F.col("status") == status).orderBy("workflow_name", F.col("version").desc())


def latest_definitions(definitions: DataFrame, active: bool = False, tag: str | None = None) -> DataFrame:
    out = definitions.where("is_latest")
    if active:
        out = out.where("status = 'ACTIVE'")
    if tag is not None:
        out = out.where(F.col("tags").contains(tag))
    return out.orderBy("workflow_name")


def next_version(definitions: DataFrame, workflow_id: str) -> DataFrame:
    return definitions.where(F.col("workflow_id") == workflow_id).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def definitions_by_creator(definitions: DataFrame, created_by: str) -> DataFrame:
    return definitions.where(F.col("created_by") == created_by).orderBy(F.col("created_at").desc())


def definition_exists(definitions: DataFrame, **equal: str) -> DataFrame:
    out = definitions
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out.limit(1).agg((F.count("*") > 0).alias("present"))


def count_active(definitions: DataFrame) -> DataFrame:
    return definitions.agg(F.count_if(F.col("is_latest") & (F.col("status") == "ACTIVE")).alias("n"))


def set_latest(definitions: DataFrame, workflow_id: str, version: int, now: datetime | str) -> DataFrame:
    """Exactly this version of the workflow is the latest from now on."""
    return update(definitions, F.col("workflow_id") == workflow_id, is_latest=F.col("version") == version, updated_at=at(now))


def set_definition_status(definitions: DataFrame, workflow_id: str, version: int, status: str, by: str, now: datetime | str) -> DataFrame:
    return update(definitions, (F.col("workflow_id") == workflow_id) & (F.col("version") == version), status=F.lit(status), updated_at=at(now), updated_by=F.lit(by))


def deprecate(definitions: DataFrame, workflow_id: str, version: int, by: str, reason: str, now: datetime | str) -> DataFrame:
    guard = (F.col("workflow_id") == workflow_id) & (F.col("version") == version)
    return update(definitions, guard, status=F.lit("DEPRECATED"), deprecated_at=at(now), deprecated_by=F.lit(by), deprecation_reason=F.lit(reason), is_latest=F.lit(False), updated_at=at(now))


def register(definitions: DataFrame, rows: DataFrame, now: datetime | str) -> DataFrame:
    """Definitions with new ones (workflow_id and any other columns, one row a workflow): each gets the next version and is the latest."""
    top = definitions.groupBy("workflow_id").agg(F.max("version").alias("__top"))
    new = rows.join(top, "workflow_id", "left").withColumn("version", F.coalesce("__top", F.lit(0)) + 1).drop("__top").withColumn("is_latest", F.lit(True)).withColumn("updated_at", at(now))
    named = rows.select("workflow_id").distinct().withColumn("__new", F.lit(True))
    old = definitions.join(named, "workflow_id", "left")
    old = update(old, F.col("__new"), is_latest=F.lit(False), updated_at=at(now)).drop("__new")
    return old.unionByName(new, allowMissingColumns=True)


# --- schedules


def due_schedules(schedules: DataFrame, now: datetime | str) -> DataFrame:
    t = at(now)
    open_ = (F.col("start_time").isNull() | (F.col("start_time") <= t)) & (F.col("end_time").isNull() | (F.col("end_time") > t))
    return schedules.where((F.col("status") == "ACTIVE") & (F.col("next_execution_time") <= t) & open_).orderBy("next_execution_time", "schedule_id")


def schedules_where(schedules: DataFrame, **equal: str | int) -> DataFrame:
    out = schedules
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def active_recurring(schedules: DataFrame) -> DataFrame:
    return schedules.where((F.col("status") == "ACTIVE") & F.col("schedule_type").isin(*RECURRING))


def schedules_in_error(schedules: DataFrame) -> DataFrame:
    return schedules.where("status = 'ERROR' or consecutive_failures >= max_consecutive_failures")


def expired_schedules(schedules: DataFrame, now: datetime | str) -> DataFrame:
    return schedules.where((F.col("status") == "ACTIVE") & F.col("end_time").isNotNull() & (F.col("end_time") <= at(now)))


def eligibility(schedules: DataFrame, now: datetime | str) -> DataFrame:
    """schedules with `eligible`, and `new_status`, what the check would make of the status."""
    t = at(now)
    active = F.col("status") == "ACTIVE"
    early = F.coalesce(F.col("start_time") > t, F.lit(False))
    over = F.coalesce(F.col("end_time") < t, F.lit(False))
    spent = F.coalesce(F.col("execution_count") >= F.col("max_executions"), F.lit(False))
    broken = F.coalesce(F.col("consecutive_failures") >= F.col("max_consecutive_failures"), F.lit(False))
    due = F.coalesce(F.col("next_execution_time") <= t, F.lit(False))
    status = F.when(~active | early, F.col("status")).when(over, "EXPIRED").when(spent, "COMPLETED").when(broken, "ERROR").otherwise(F.col("status"))
    return schedules.withColumn("eligible", active & ~early & ~over & ~spent & ~broken & due).withColumn("new_status", status)


def next_time(schedules: DataFrame, now: datetime | str) -> DataFrame:
    """schedules with `next_time`: null for one-time and ended ones. Cron expressions stand in a column cron_expression."""
    t, kind = at(now), F.col("schedule_type")
    later = lambda start, s: F.timestamp_add("SECOND", s, start)
    rate = later(F.coalesce("last_execution_time", t), F.col("fixed_rate_seconds"))
    found = F.when(kind == "FIXED_RATE", rate).when(kind == "FIXED_DELAY", later(t, F.col("fixed_delay_seconds")))
    if "cron_expression" in schedules.columns:
        found = found.when(kind == "CRON", cron.next_column(F.col("cron_expression"), t))
    return schedules.withColumn("next_time", F.when(F.coalesce(F.col("end_time") < t, F.lit(False)), F.lit(None)).otherwise(found))


def set_next_time(schedules: DataFrame, schedule_id: str, time: datetime | str, now: datetime | str) -> DataFrame:
    return update(schedules, F.col("schedule_id") == schedule_id, next_execution_time=at(time), updated_at=at(now))


def set_schedule_status(schedules: DataFrame, schedule_id: str, status: str, now: datetime | str) -> DataFrame:
    return update(schedules, F.col("schedule_id") == schedule_id, status=F.lit(status), updated_at=at(now))


def record_execution(schedules: DataFrame, schedule_id: str, time: datetime | str, instance_id: str, status: str, ok: bool) -> DataFrame:
    failures = F.lit(0) if ok else F.col("consecutive_failures") + 1
    return update(schedules, F.col("schedule_id") == schedule_id, last_execution_time=at(time), execution_count=F.col("execution_count") + 1, consecutive_failures=failures, last_workflow_instance_id=F.lit(instance_id), last_workflow_status=F.lit(status), updated_at=at(time))


def created(schedules: DataFrame, rows: DataFrame, now: datetime | str) -> DataFrame:
    """The schedules with new ones (schedule_id, schedule_type and any other columns): active, never run, next due by their type.

    A one-time schedule is due at its start_time, a recurring one at start_time if it has one, else at its first next time.
    """
    due = next_time(rows.withColumn("last_execution_time", F.lit(None).cast(_STAMP)), now)
    first = F.coalesce(F.col("start_time"), F.when(F.col("schedule_type") == "ONE_TIME", at(now)).otherwise(F.col("next_time")))
    fresh = due.withColumns({"next_execution_time": first, "status": F.lit("ACTIVE"), "execution_count": F.lit(0), "consecutive_failures": F.lit(0), "updated_at": at(now)}).drop("next_time")
    return schedules.unionByName(fresh, allowMissingColumns=True)


def paused(schedules: DataFrame, schedule_id: int | str, now: datetime | str) -> DataFrame:
    return update(schedules, (F.col("schedule_id") == schedule_id) & (F.col("status") == "ACTIVE"), status=F.lit("PAUSED"), updated_at=at(now))


def resumed(schedules: DataFrame, schedule_id: int | str, now: datetime | str) -> DataFrame:
    """A paused schedule is active again, its next time counted from now; its failures are forgotten."""
    told = next_time(schedules, now)
    guard = (F.col("schedule_id") == schedule_id) & (F.col("status") == "PAUSED")
    out = update(told, guard, status=F.lit("ACTIVE"), next_execution_time=F.coalesce("next_time", "next_execution_time"), consecutive_failures=F.lit(0), updated_at=at(now))
    return out.drop("next_time")


def removed(schedules: DataFrame, schedule_id: int | str) -> DataFrame:
    return schedules.where(~F.coalesce(F.col("schedule_id") == schedule_id, F.lit(False)))


def started(schedules: DataFrame, now: datetime | str) -> DataFrame:
    """The snapshot after a scheduler's round: eligible schedules have run once more and wait for their next time; the check's statuses hold."""
    told = next_time(eligibility(schedules, now), now)
    ran = update(told, F.col("eligible"), last_execution_time=at(now), execution_count=F.col("execution_count") + 1, next_execution_time=F.col("next_time"), updated_at=at(now))
    ended = F.when(F.col("eligible") & (F.col("schedule_type") == "ONE_TIME"), "COMPLETED").otherwise(F.col("new_status"))
    return ran.withColumn("status", ended).drop("eligible", "new_status", "next_time")


def settled(schedules: DataFrame, instances: DataFrame, now: datetime | str) -> DataFrame:
    """The snapshot after the started instances (workflow_instance_id, state) were looked at: success clears failures, failure counts."""
    ends = instances.where(F.col("state").isin("COMPLETED", "FAILED", "CANCELLED")).select(F.col("workflow_instance_id").alias("__instance"), F.col("state").alias("__state"))
    told = schedules.join(ends, F.col("last_workflow_instance_id") == F.col("__instance"), "left")
    fresh = F.col("__state").isNotNull() & ~F.col("last_workflow_status").eqNullSafe(F.col("__state"))
    failures = F.when(F.col("__state") == "COMPLETED", 0).otherwise(F.col("consecutive_failures") + 1)
    return update(told, fresh, consecutive_failures=failures, last_workflow_status=F.col("__state"), updated_at=at(now)).drop("__instance", "__state")


def delete_old(schedules: DataFrame, before: datetime | str) -> DataFrame:
    gone = F.col("status").isin("COMPLETED", "EXPIRED") & (F.col("updated_at") < at(before))
    return schedules.where(~F.coalesce(gone, F.lit(False)))


# --- dataflow


def fork_join(rows: DataFrame, fn: Callable, schema: str, key: list[str], fail_fast: bool = False) -> DataFrame:
    """fn (a pandas DataFrame to a pandas DataFrame of `schema`) over every row by itself; successes only, or the first error raised.

    fn gets one row at a time, for rows may fail alone; the batches travel by Arrow.
    """
    import pandas as pd

    def over(batches):
        for batch in batches:
            out = []
            for i in range(len(batch)):
                try:
                    out.append(fn(batch.iloc[i : i + 1]))
                except Exception:
                    if fail_fast:
                        raise
            if out:
                yield pd.concat(out, ignore_index=True)

    return rows.mapInPandas(over, schema)


def join_results(results: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The values of each group as one list, in order."""
    return results.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("results"))


def fork_summary(tasks: DataFrame, by: list[str]) -> DataFrame:
    """total, successful and failed tasks of each fork."""
    return tasks.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "SUCCESS").alias("successful"), F.count_if(F.col("status") == "FAILED").alias("failed"))


def substitute(template: Column, values: Column) -> Column:
    """`${name}` replaced by the value of a string map, or by nothing."""
    names = F.regexp_extract_all(template, F.lit(r"\$\{([^}]+)\}"), F.lit(1))
    return F.aggregate(F.array_distinct(names), template, lambda s, n: F.replace(s, F.concat(F.lit("${"), n, F.lit("}")), F.coalesce(F.element_at(values, n), F.lit(""))))


def truth(condition: Column) -> Column:
    """`true`, `false`, or whether the two sides of a==b are the same text; false for anything else."""
    sides = F.split(condition, "==", -1)
    both = F.trim(F.get(sides, F.lit(0))) == F.trim(F.get(sides, F.lit(1)))
    pair = (F.size(sides) == 2) & (F.get(sides, F.lit(1)) != "")
    return F.when(F.lower(condition) == "true", True).when(F.lower(condition) == "false", False).otherwise(F.coalesce(pair & both, F.lit(False)))


def backoff_ms(retries: Column) -> Column:
    """The wait after so many retries: a second doubled each time, a minute at most."""
    return F.least(F.lit(1000) * F.pow(F.lit(2.0), F.least(retries, F.lit(10))), F.lit(60000)).cast("long")


def error_rate(tasks: DataFrame, by: list[str]) -> DataFrame:
    """volume, errors and error_percent of each group."""
    n, e = F.count("*"), F.count_if(F.col("status") == "FAILED")
    return tasks.groupBy(*by).agg(n.alias("volume"), e.alias("errors"), (e * F.lit(100.0) / n).alias("error_percent"))


def breaker_state(tasks: DataFrame, by: list[str], order: list[str], failures: int = 5, volume: int = 10, percent: float = 50.0, hot: int = 100_000) -> DataFrame:
    """volume, errors, in_row (failures since the last success) and state of each group, as a breaker that saw its tasks in this order.

    No group is sorted or held whole, and none goes to one task: successes are only aggregated, and failures
    are compared with their group's last success where they lie if the group has `hot` of them or more. Such
    groups are broadcast, one for every `hot` rows at most; only the failures of the others are shuffled.
    Rows with a null in `by` belong to no group.
    """
    key = [F.col(f"`{c}`") for c in by]
    at_ = F.struct(*[F.col(f"`{c}`") for c in order])
    failed = F.col("status") == "FAILED"
    for k in key:
        tasks = tasks.where(k.isNotNull())
    groups = tasks.groupBy(*key).agg(
        F.count("*").alias("volume"),
        F.count_if(failed).alias("errors"),
        F.max(F.when(~failed, at_)).alias("__good"),
    )
    mixed = groups.where("errors > 0 and volume > errors and __good is not null")
    often = F.broadcast(mixed.where(F.col("errors") >= hot).select(*key, "__good"))
    seldom = mixed.where(F.col("errors") < hot).select(*key, "__good")
    bad = tasks.where(failed).select(*key, at_.alias("__at"))
    told = bad.join(often, by).unionByName(bad.join(often.select(*key), by, "left_anti").join(seldom, by))
    late = told.where(F.col("__at") > F.col("__good")).groupBy(*key).agg(F.count("*").alias("__late"))
    in_row = F.when(F.col("__good").isNull(), F.col("errors")).otherwise(F.coalesce("__late", F.lit(0)))
    out = groups.join(late, by, "left").select(*key, "volume", "errors", in_row.alias("in_row"))
    opens = (F.col("in_row") >= failures) & (F.col("volume") >= volume) & (F.col("errors") * 100.0 / F.col("volume") >= percent)
    return out.withColumn("state", F.when(opens, "OPEN").otherwise("CLOSED"))


def sub_workflow(parent: dict, ref: str, inputs: dict[str, str], run: Callable[[dict], dict]) -> dict:
    """The parent's data with a sub-workflow's outputs: `<ref>_output` and `<ref>.<key>`."""
    out = run({k: parent.get(v) for k, v in inputs.items()})
    return parent | {f"{ref}_output": out} | {f"{ref}.{k}": v for k, v in out.items()}
