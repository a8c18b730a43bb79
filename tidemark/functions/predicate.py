"""Predicates that become Columns, print themselves, and can rule out files by their statistics.

NULL never satisfies a predicate: `mask` is two-valued, so its negation keeps rows with NULLs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    low: Any = None
    high: Any = None
    nulls: int | None = None
    rows: int | None = None


@dataclass(frozen=True)
class Predicate:
    """op: always, gt, ge, lt, le, eq, ne, between, in, null, not_null, and, or, not."""

    op: str
    name: str = ""
    values: tuple = ()
    parts: tuple[Predicate, ...] = field(default=())

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate("and", parts=(self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate("or", parts=(self, other))

    def __invert__(self) -> Predicate:
        return Predicate("not", parts=(self,))

    def column(self) -> Column:
        """The condition as Spark sees it, so that it can be pushed into a scan."""
        c, v = F.col(f"`{self.name}`") if self.name else None, self.values
        match self.op:
            case "always":
                return F.lit(True)
            case "gt":
                return c > v[0]
            case "ge":
                return c >= v[0]
            case "lt":
                return c < v[0]
            case "le":
                return c <= v[0]
            case "eq":
                return c == F.lit(v[0])
            case "ne":
                return c != F.lit(v[0])
            case "between":
                return c.between(*v)
            case "in":
                return c.isin(*v)
            case "null":
                return c.isNull()
            case "not_null":
                return c.isNotNull()
            case "and":
                return self.parts[0].column() & self.parts[1].column()
            case "or":
                return self.parts[0].column() | self.parts[1].column()
            case "not":
                return ~self.parts[0].mask()
        raise ValueError(self.op)

    def mask(self) -> Column:
        return F.coalesce(self.column(), F.lit(False))

    def columns(self) -> set[str]:
        return {self.name} - {""} | {x for p in self.parts for x in p.columns()}

    def __str__(self) -> str:
        v = [repr(x) for x in self.values]
        sign = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>"}.get(self.op)
        if sign:
            return f"{self.name} {sign} {v[0]}"
        match self.op:
            case "always":
                return "TRUE"
            case "between":
                return f"{self.name} BETWEEN {v[0]} AND {v[1]}"
            case "in":
                return f"{self.name} IN ({', '.join(v)})"
            case "null" | "not_null":
                return f"{self.name} IS {'NOT ' * (self.op == 'not_null')}NULL"
            case "not":
                return f"NOT ({self.parts[0]})"
        return f"({self.parts[0]}) {self.op.upper()} ({self.parts[1]})"

    def may_match(self, stats: Mapping[str, Stats]) -> bool:
        """False only if no row of a file with these statistics can satisfy it."""
        if self.op == "and":
            return all(p.may_match(stats) for p in self.parts)
        if self.op == "or":
            return any(p.may_match(stats) for p in self.parts)
        s = stats.get(self.name)
        if s is None or self.op in ("always", "not"):
            return True
        if self.op == "null":
            return s.nulls is None or s.nulls > 0
        if s.rows is not None and s.nulls == s.rows:
            return False  # nothing but NULL
        if self.op in ("not_null", "ne") or s.low is None or s.high is None:
            return True
        try:
            v = self.values
            match self.op:
                case "gt":
                    return s.high > v[0]
                case "ge":
                    return s.high >= v[0]
                case "lt":
                    return s.low < v[0]
                case "le":
                    return s.low <= v[0]
                case "eq":
                    return s.low <= v[0] <= s.high
                case "between":
                    return s.low <= v[1] and v[0] <= s.high
                case "in":
                    return any(s.low <= x <= s.high for x in v)
        except TypeError:
            pass  # values of another type: can't tell
        return True


ALWAYS = Predicate("always")


class col:  # noqa: N801
    """col("x") > 3, col("x").between(1, 2), col("x").isin("a", "b"), with &, | and ~."""

    def __init__(self, name: str):
        self.name = name

    def _make(self, op: str, *values) -> Predicate:
        return Predicate(op, self.name, values)

    def __gt__(self, v):
        return self._make("gt", v)

    def __ge__(self, v):
        return self._make("ge", v)

    def __lt__(self, v):
        return self._make("lt", v)

    def __le__(self, v):
        return self._make("le", v)

    def __eq__(self, v):
        return self._make("eq", v)

    def __ne__(self, v):
        return self._make("ne", v)

    __hash__ = None

    def between(self, low, high):
        return self._make("between", low, high)

    def isin(self, *values):
        return self._make("in", *values)

    def is_null(self):
        return self._make("null")

    def is_not_null(self):
        return self._make("not_null")
