"""The five aggregates. All but count give doubles; what they give over no rows is fixed here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.model import Agg, QueryError

EMPTY = {"count": 0, "sum": 0.0, "min": float("inf"), "max": float("-inf"), "avg": 0.0}


def column(agg: Agg, name: str, kind: T.DataType | None) -> Column:
    """The aggregate over the column of that name; kind None for a star.

    The casts stand outside min and max, so that a scan of footers alone can still answer them.
    """
    if agg.function == "count":
        return F.count(F.lit(1))  # ingest leaves no nulls, so count(column) is count(*)
    if not isinstance(kind, T.NumericType):
        raise QueryError(f"{agg.label} needs a number, {name} is {kind.simpleString()}")
    c = F.col(f"`{name}`")
    if agg.function in ("min", "max"):
        found = (F.min if agg.function == "min" else F.max)(c).cast("double")
    else:
        found = (F.sum if agg.function == "sum" else F.avg)(c.cast("double"))
    return F.coalesce(found, F.lit(EMPTY[agg.function]))
