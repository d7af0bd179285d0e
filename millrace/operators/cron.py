"""Cron expressions: minute, hour, day of month, month and day of week, with seconds before them if there are six fields.

Each field is `*` or `?`, or a list of numbers and ranges, each with a step if wanted; months and days of the
week have names as well. Day of month and day of week both hold where both are given.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = {n: k for k, n in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
_DAYS = {n: k for k, n in enumerate("SUN MON TUE WED THU FRI SAT".split())}
_FIELDS = ((0, 59, {}), (0, 59, {}), (0, 23, {}), (1, 31, {}), (1, 12, _MONTHS), (0, 7, _DAYS))
#: Leap days come round within eight years.
_YEARS = 9


def _field(text: str, low: int, high: int, names: dict[str, int]) -> frozenset[int]:
    number = lambda x: names[x] if x in names else int(x)
    found: set[int] = set()
    for part in text.upper().split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        else:
            first, dash, last = span.partition("-")
            a = number(first)
            b = number(last) if dash else high if step else a
        if not low <= a <= b <= high or step and int(step) < 1:
            raise ValueError(f"{part} is no part of a cron field from {low} to {high}")
        found.update(range(a, b + 1, int(step) if step else 1))
    return frozenset(found)


@lru_cache(4096)
def parse(expression: str) -> tuple[frozenset[int], ...]:
    """Allowed seconds, minutes, hours, days, months and days of the week (0 is Sunday)."""
    parts = expression.split()
    if len(parts) == 5:
        parts = ["0", *parts]
    if len(parts) != 6:
        raise ValueError(f"{expression!r} has neither five nor six fields")
    found = [_field(p, *f) for p, f in zip(parts, _FIELDS)]
    found[5] = frozenset(d % 7 for d in found[5])
    return tuple(found)


def next_after(expression: str, now: datetime) -> datetime | None:
    """The first time after now, to the second; None where there is none."""
    seconds, minutes, hours, days, months, weekdays = parse(expression)
    t = now.replace(microsecond=0) + timedelta(seconds=1)
    end = now.year + _YEARS
    while t.year <= end:
        if t.month not in months:
            t = (t.replace(day=1, hour=0, minute=0, second=0) + timedelta(days=32)).replace(day=1)
        elif t.day not in days or (t.weekday() + 1) % 7 not in weekdays:
            t = t.replace(hour=0, minute=0, second=0) + timedelta(days=1)
        elif t.hour not in hours:
            t = t.replace(minute=0, second=0) + timedelta(hours=1)
        elif t.minute not in minutes:
            t = t.replace(second=0) + timedelta(minutes=1)
        elif t.second not in seconds:
            t += timedelta(seconds=1)
        else:
            return t
    return None


def next_column(expression: Column, now: Column) -> Column:
    """The same over columns; null where the expression or the time is null. Each different pair is worked out once a batch."""

    @F.pandas_udf("timestamp_ntz")
    def fn(e: pd.Series, t: pd.Series) -> pd.Series:
        known = {k: None if k[0] is None or pd.isna(k[1]) else next_after(k[0], k[1].to_pydatetime()) for k in set(zip(e, t))}
        return pd.Series([known[k] for k in zip(e, t)], dtype="datetime64[us]")

    return fn(expression, now)
