"""The engine: SQL text or a query model in, a lazy DataFrame out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.plans import compile as compiler
from millrace.plans import sql
from millrace.plans.model import Query, QueryError

#: Rows that SQL text without LIMIT gives.
DEFAULT_LIMIT = 10


class _Nothing(dict):
    """Stands for a table of which not even the schema is known."""


class Engine:
    """Answers single-table queries over one DataFrame, or over several by name.

    SQL without LIMIT gives DEFAULT_LIMIT rows; default_limit=None lifts that. Queries built in code
    are limited only where they say so.
    """

    def __init__(self, tables: DataFrame | Mapping[str, DataFrame], default_limit: int | None = DEFAULT_LIMIT):
        self.tables = tables if isinstance(tables, Mapping) else None
        self.only = None if isinstance(tables, Mapping) else tables
        self.default_limit = default_limit

    @classmethod
    def of_segments(cls, segments: list[DataFrame], default_limit: int | None = DEFAULT_LIMIT, schema: T.StructType | str | None = None) -> Engine:
        """One table of several parts of the same columns.

        Without parts it is an empty table of `schema`. Where that is not given either, aggregates still
        give their one row, and other queries no rows of the columns that they name (a star: none).
        """
        if segments:
            return cls(reduce(DataFrame.unionByName, segments), default_limit)
        return cls(_Nothing() if schema is None else SparkSession.active().createDataFrame([], schema), default_limit)

    def table(self, name: str | None) -> DataFrame:
        if self.only is not None:
            return self.only  # a single table answers to any name
        if name not in self.tables:
            raise QueryError(f"unknown table {name}")
        return self.tables[name]

    def query(self, text: str) -> DataFrame:
        q = sql.parse(text)
        if q.limit is None:
            q = replace(q, limit=self.default_limit)
        return self.run(q)

    def run(self, q: Query) -> DataFrame:
        if isinstance(self.tables, _Nothing):
            return compiler.compile(q, SparkSession.active().createDataFrame([], compiler.unknown_table(q) or T.StructType()))
        return compiler.compile(q, self.table(q.table))
