"""The query model to a DataFrame. All rules of names, limits and empty input are kept here.

- Aggregation without GROUP BY gives one row, whatever ORDER BY, LIMIT and OFFSET say.
- Columns are named by alias, else canonically: the column's name or `fn(argument)`.
- A star stands for exactly all columns, in order.
- Groups cut by a limit without ORDER BY are ordered by their keys, so that the cut is always the same.
- DISTINCT holds for the rows that come out, grouped or not; ORDER BY then names selected columns only.
- Nulls, should there be any, come last ascending and first descending.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import aggregates
from millrace.plans.model import Agg, And, Between, Col, Compare, Condition, In, Item, Lit, Not, Operand, Or, Order, Query, QueryError


class _Scope:
    """Columns of a DataFrame by name, exactly or, if only one fits, without regard to case."""

    def __init__(self, df: DataFrame):
        self.kinds = {f.name: f.dataType for f in df.schema.fields}

    def find(self, name: str) -> str:
        if name in self.kinds:
            return name
        near = [k for k in self.kinds if k.lower() == name.lower()]
        if len(near) != 1:
            raise QueryError(f"unknown column {name}")
        return near[0]


def literal(value: Lit, kind: T.DataType) -> Column:
    """The literal as it compares with a column of that type; numbers are promoted, never cut."""
    if isinstance(kind, T.StringType):
        return F.lit(value.raw)
    if isinstance(kind, T.BinaryType):
        return F.lit(value.raw).cast("binary")
    if isinstance(kind, T.NumericType):
        raw = value.raw.strip()
        try:
            return F.lit(int(raw))
        except ValueError:
            pass
        try:
            return F.lit(float(raw))
        except ValueError:
            raise QueryError(f"{value.raw!r} is no number") from None
    return F.lit(value.raw).cast(kind)


_OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def condition(c: Condition, resolve) -> Column:
    """resolve: operand to (Column, type)."""
    if isinstance(c, And):
        return reduce(lambda a, b: a & b, (condition(p, resolve) for p in c.parts))
    if isinstance(c, Or):
        return reduce(lambda a, b: a | b, (condition(p, resolve) for p in c.parts))
    if isinstance(c, Not):
        return ~condition(c.part, resolve)
    left, kind = resolve(c.left)
    if isinstance(c, Compare):
        return _OPS[c.op](left, literal(c.right, kind))
    if isinstance(c, Between):
        return (left >= literal(c.low, kind)) & (left <= literal(c.high, kind))
    return left.isin(*[literal(v, kind) for v in dict.fromkeys(c.values)]) if c.values else F.lit(False)


def _operands(c: Condition | None):
    if isinstance(c, (And, Or)):
        for p in c.parts:
            yield from _operands(p)
    elif isinstance(c, Not):
        yield from _operands(c.part)
    elif c is not None:
        yield c.left


def _sorted(order: Order, c: Column) -> Column:
    return c.desc_nulls_first() if order.descending else c.asc_nulls_last()


def _slice(df: DataFrame, q: Query) -> DataFrame:
    if q.offset:
        df = df.offset(q.offset)
    return df if q.limit is None else df.limit(q.limit)


def compile(q: Query, df: DataFrame) -> DataFrame:
    scope = _Scope(df)

    def plain(x: Operand):
        if isinstance(x, Agg):
            raise QueryError(f"{x.label} cannot stand in WHERE")
        name = scope.find(x.name)
        return F.col(f"`{name}`"), scope.kinds[name]

    rows = df if q.filter is None else df.where(condition(q.filter, plain))
    if q.group or q.aggregates:
        return _grouped(q, rows, scope)
    if q.having is not None:
        raise QueryError("HAVING needs GROUP BY")
    items = [Item(Col(c)) for c in df.columns] if any(i.value is None for i in q.items) else list(q.items)
    if q.distinct:
        names = tuple(dict.fromkeys(i.value.name for i in items))
        return _grouped(Query(tuple(items), q.table, None, names, None, q.order, q.limit, q.offset), rows, scope)
    aliases = {i.alias: i.value for i in items if i.alias}
    keys = []
    for o in q.order:
        if isinstance(o.value, Agg):
            raise QueryError(f"{o.value.label} cannot order rows that are not grouped")
        keys.append(_sorted(o, plain(aliases.get(o.value.name, o.value))[0]))
    rows = _slice(rows.orderBy(*keys) if keys else rows, q)
    return rows.select(*[plain(i.value)[0].alias(i.name) for i in items])


def _grouped(q: Query, rows: DataFrame, scope: _Scope) -> DataFrame:
    if any(i.value is None for i in q.items):
        raise QueryError("a star cannot stand beside GROUP BY or aggregates")
    group = list(dict.fromkeys(scope.find(g) for g in q.group))
    for i in q.items:
        if isinstance(i.value, Col) and scope.find(i.value.name) not in group:
            raise QueryError(f"{i.value.name} is neither grouped nor aggregated")
    if not group:
        if q.having is not None:
            raise QueryError("HAVING needs GROUP BY")
        return rows.agg(*[_aggregate(i.value, scope).alias(i.name) for i in q.items])
    aliases = {i.alias: i.value for i in q.items if i.alias}
    order = [Order(aliases.get(o.value.name, o.value) if isinstance(o.value, Col) else o.value, o.descending) for o in q.order]
    wanted = [*(i.value for i in q.items), *_operands(q.having), *(o.value for o in order)]
    known = {a: f"__agg{k}" for k, a in enumerate(dict.fromkeys(Agg(x.function, x.column) for x in wanted if isinstance(x, Agg)))}
    keys = {g: f"__key{k}" for k, g in enumerate(group)}
    chosen = rows.groupBy(*[F.col(f"`{g}`").alias(k) for g, k in keys.items()])
    out = chosen.agg(*[_aggregate(a, scope).alias(n) for a, n in known.items()]) if known else rows.select(*[F.col(f"`{g}`").alias(k) for g, k in keys.items()]).distinct()

    def resolve(x: Operand):
        if isinstance(x, Agg):
            return F.col(known[x]), T.LongType() if x.function == "count" else T.DoubleType()
        name = scope.find(x.name)
        if name not in keys:
            raise QueryError(f"{x.name} is neither grouped nor aggregated")
        return F.col(keys[name]), scope.kinds[name]

    if q.having is not None:
        out = out.where(condition(q.having, resolve))
    plain = lambda x: Agg(x.function, x.column) if isinstance(x, Agg) else scope.find(x.name)
    if q.distinct and not set(keys) <= {plain(i.value) for i in q.items}:  # else the groups are distinct as they are
        items = {plain(i.value): f"__item{k}" for k, i in enumerate(q.items)}
        out = out.select(*[resolve(i.value)[0].alias(items[plain(i.value)]) for i in {plain(i.value): i for i in q.items}.values()]).distinct()
        hidden = [o.value for o in order if plain(o.value) not in items]
        if hidden:
            raise QueryError("with DISTINCT, ORDER BY names selected columns only")
        chosen_keys, value = list(items.values()), lambda x: F.col(items[plain(x)])
    else:
        chosen_keys, value = list(keys.values()), lambda x: resolve(x)[0]
    by = [_sorted(o, value(o.value)) for o in order]
    if not by and (q.limit is not None or q.offset):
        by = [F.col(k).asc_nulls_last() for k in chosen_keys]
    out = _slice(out.orderBy(*by) if by else out, q)
    return out.select(*[value(i.value).alias(i.name) for i in q.items])


def unknown_table(q: Query) -> str:
    """A schema that a query over no known table can be compiled against: numbers where it aggregates, else text."""
    operands = [*(i.value for i in q.items if i.value is not None), *_operands(q.filter), *_operands(q.having), *(o.value for o in q.order), *map(Col, q.group)]
    aliases = {i.alias for i in q.items if i.alias}
    numbers = {x.column for x in operands if isinstance(x, Agg) and x.column != "*"}
    texts = {x.name for x in operands if isinstance(x, Col)} - numbers - aliases
    return ", ".join([f"`{n}` double" for n in sorted(numbers)] + [f"`{n}` string" for n in sorted(texts)])


def _aggregate(a: Agg, scope: _Scope) -> Column:
    name = None if a.column == "*" else scope.find(a.column)
    return aggregates.column(a, name, None if name is None else scope.kinds[name])
