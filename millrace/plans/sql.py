"""SQL text to the query model.

    SELECT [DISTINCT] item, ... FROM name [WHERE c] [GROUP BY name, ...] [HAVING c]
    [ORDER BY key [ASC|DESC], ...] [LIMIT n [OFFSET m] | LIMIT m, n] [OFFSET m]

Items are *, names, and COUNT/SUM/MIN/MAX/AVG calls, with or without an alias. Conditions are AND, OR,
NOT and parentheses over = != <> < <= > >=, [NOT] IN and [NOT] BETWEEN between one name (or, after
HAVING, an aggregate) and literals, on either side. Anything else raises QueryError.
"""

from __future__ import annotations

import re

from millrace.plans.model import FUNCTIONS, Agg, And, Between, Col, Compare, Condition, In, Item, Lit, Not, Operand, Or, Order, Query, QueryError

_TOKEN = re.compile(
    r"""\s+|--[^\n]*
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<text>'(?:[^']|'')*')
    |(?P<name>[A-Za-z_][\w$]*|"(?:[^"]|"")+"|`(?:[^`]|``)+`)
    |(?P<sign><>|!=|<=|>=|[=<>(),.*;+-])""",
    re.X,
)
_FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_CLAUSES = {"from", "where", "group", "having", "order", "limit", "offset", "asc", "desc", "and", "or", "not", "in", "between", "as", "by", "select"}


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise QueryError(f"cannot read {text[at : at + 12]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        """Whether the next tokens are these keywords; they are consumed then."""
        for k, w in enumerate(words):
            kind, value = self.peek(k)
            if kind != "name" or value.lower() != w:
                return False
        self.at += len(words)
        return True

    def sign(self, s: str) -> bool:
        if self.peek() == ("sign", s):
            self.at += 1
            return True
        return False

    def need(self, ok: bool, what: str) -> None:
        if not ok:
            raise QueryError(f"expected {what}, found {self.peek()[1] or 'the end'}")

    def name(self) -> str:
        kind, value = self.peek()
        self.need(kind == "name" and value.lower() not in _CLAUSES, "a name")
        self.at += 1
        if self.sign("."):
            return self.name()
        return value[1:-1].replace(value[0] * 2, value[0]) if value[0] in "\"`" else value

    def operand(self, aggregates: bool) -> Operand:
        kind, value = self.peek()
        if kind == "name" and self.peek(1) == ("sign", "("):
            if value.lower() not in FUNCTIONS:
                raise QueryError(f"there is no function {value}")
            if not aggregates:
                raise QueryError(f"{value} cannot stand here")
            self.at += 2
            if self.word("distinct"):
                raise QueryError("aggregates over distinct values are not supported")
            column = "*" if self.sign("*") else self.name()
            self.need(self.sign(")"), ")")
            return Agg(value, column)
        return Col(self.name())

    def literal(self) -> Lit | None:
        kind, value = self.peek()
        if kind == "text":
            self.at += 1
            return Lit(value[1:-1].replace("''", "'"), True)
        minus = kind == "sign" and value in "+-" and self.peek(1)[0] == "number"
        if minus or kind == "number":
            self.at += 1 + minus
            return Lit(("-" if value == "-" else "") + (self.peek(-1)[1]))
        if kind == "name" and value.lower() in ("true", "false", "null"):
            raise QueryError(f"{value} is no literal here")
        return None

    def some_literal(self) -> Lit:
        found = self.literal()
        if found is None:
            raise QueryError(f"expected a literal, found {self.peek()[1] or 'the end'}")
        return found

    def condition(self, aggregates: bool = False) -> Condition:
        parts = [self.conjunction(aggregates)]
        while self.word("or"):
            parts.append(self.conjunction(aggregates))
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def conjunction(self, aggregates: bool) -> Condition:
        parts = [self.leaf(aggregates)]
        while self.word("and"):
            parts.append(self.leaf(aggregates))
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def leaf(self, aggregates: bool) -> Condition:
        if self.word("not"):
            return Not(self.leaf(aggregates))
        if self.sign("("):
            inner = self.condition(aggregates)
            self.need(self.sign(")"), ")")
            return inner
        first = self.literal()
        if first is not None:
            op = self.operator()
            return Compare(self.operand(aggregates), _FLIP[op], first)
        left = self.operand(aggregates)
        no = self.word("not")
        if self.word("in"):
            self.need(self.sign("("), "(")
            values = [self.some_literal()]
            while self.sign(","):
                values.append(self.some_literal())
            self.need(self.sign(")"), ")")
            out: Condition = In(left, tuple(values))
        elif self.word("between"):
            low = self.some_literal()
            self.need(self.word("and"), "AND")
            out = Between(left, low, self.some_literal())
        else:
            self.need(not no, "IN or BETWEEN")
            return Compare(left, self.operator(), self.some_literal())
        return Not(out) if no else out

    def operator(self) -> str:
        kind, value = self.peek()
        value = "!=" if value == "<>" else value
        self.need(kind == "sign" and value in _FLIP, "a comparison")
        self.at += 1
        return value

    def item(self) -> Item:
        if self.sign("*"):
            return Item(None)
        value = self.operand(True)
        if self.word("as"):
            return Item(value, self.name())
        kind, word = self.peek()
        return Item(value, self.name()) if kind == "name" and word.lower() not in _CLAUSES else Item(value)

    def whole(self) -> int:
        kind, value = self.peek()
        self.need(kind == "number" and value.isdigit(), "a whole number")
        self.at += 1
        return int(value)

    def query(self) -> Query:
        self.need(self.word("select"), "SELECT")
        distinct = self.word("distinct")
        items = [self.item()]
        while self.sign(","):
            items.append(self.item())
        self.need(self.word("from"), "FROM")
        table = self.name()
        kind, word = self.peek()
        if kind == "name" and word.lower() not in _CLAUSES:
            if word.lower() in ("join", "inner", "left", "right", "full", "cross", "natural"):
                raise QueryError("joins are not supported")
            self.name()  # the table's alias
        if self.peek() == ("sign", ","):
            raise QueryError("joins are not supported")
        where = self.condition() if self.word("where") else None
        group: list[str] = []
        if self.word("group", "by"):
            group.append(self.name())
            while self.sign(","):
                group.append(self.name())
        having = self.condition(True) if self.word("having") else None
        order: list[Order] = []
        if self.word("order", "by"):
            while True:
                value = self.operand(True)
                order.append(Order(value, self.word("desc") or (self.word("asc") and False)))
                if not self.sign(","):
                    break
        limit, offset = None, 0
        if self.word("limit"):
            limit = self.whole()
            if self.sign(","):
                offset, limit = limit, self.whole()
        if self.word("offset"):
            offset = self.whole()
        self.sign(";")
        self.need(self.peek()[0] == "end", "the end")
        return Query(tuple(items), table, where, tuple(group), having, tuple(order), limit, offset, distinct)


def parse(text: str) -> Query:
    """The model of a SELECT; QueryError where the text is none of ours."""
    return _Parser(text).query()
