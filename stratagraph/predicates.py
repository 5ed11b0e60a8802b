"""Conditions with Python's two-valued truth, compiled to Columns that still reach the Parquet scan.

A condition is compiled twice: `holds` gives a Column that is true exactly where it is true (null may stand for
false), `fails` one that is true exactly where it is false. Negation swaps the two, so no leaf is ever wrapped in
coalesce and filters stay pushable.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryError
from .schema import EntityType

LONG = range(-(2**63), 2**63)


@dataclass(frozen=True)
class Ref:
    """A reference to a record by its oid; None if it was never committed."""

    oid: int | None


class Condition:
    def types(self) -> set[str]:
        raise NotImplementedError

    def entity(self) -> EntityType:
        raise NotImplementedError

    def holds(self) -> Column:
        raise NotImplementedError

    def fails(self) -> Column:
        raise NotImplementedError

    def __and__(self, other: Condition) -> Condition:
        return All.of(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Any_.of(self, other)

    def __invert__(self) -> Condition:
        return Negation(self)

    def __rand__(self, other):
        raise QueryError("& binds tighter than a comparison: put each comparison in parentheses")

    __ror__ = __rand__

    def __bool__(self):
        raise QueryError("a condition has no truth value of its own: combine with & | ~ instead of and, or, not, and put comparisons in parentheses")

    def leaves(self) -> list[Leaf]:
        raise NotImplementedError


def condition(x: Any) -> Condition:
    if not isinstance(x, Condition):
        raise QueryError(f"{x!r} is no condition: put each comparison in parentheses")
    return x


class Combined(Condition):
    def __init__(self, parts: list[Condition]):
        self.parts = parts
        if len(names := self.types()) > 1:
            raise QueryError(f"a condition is over one type, not {sorted(names)}: join the extents instead")

    @classmethod
    def of(cls, *parts: Any) -> Condition:
        flat: list[Condition] = []
        for p in map(condition, parts):
            flat += p.parts if type(p) is cls else [p]
        return cls(flat)

    def types(self) -> set[str]:
        return set().union(*[p.types() for p in self.parts])

    def entity(self) -> EntityType:
        return self.parts[0].entity()

    def leaves(self) -> list[Leaf]:
        return [x for p in self.parts for x in p.leaves()]


class All(Combined):
    def holds(self) -> Column:
        return reduce(and_, [p.holds() for p in self.parts])

    def fails(self) -> Column:
        return reduce(or_, [p.fails() for p in self.parts])

    def __repr__(self) -> str:
        return f"all({', '.join(map(repr, self.parts))})"


class Any_(Combined):
    def holds(self) -> Column:
        return reduce(or_, [p.holds() for p in self.parts])

    def fails(self) -> Column:
        return reduce(and_, [p.fails() for p in self.parts])

    def __repr__(self) -> str:
        return f"any({', '.join(map(repr, self.parts))})"


class Negation(Condition):
    def __init__(self, part: Condition):
        self.part = condition(part)

    def types(self) -> set[str]:
        return self.part.types()

    def entity(self) -> EntityType:
        return self.part.entity()

    def holds(self) -> Column:
        return self.part.fails()

    def fails(self) -> Column:
        return self.part.holds()

    def leaves(self) -> list[Leaf]:
        return self.part.leaves()

    def __repr__(self) -> str:
        return f"not({self.part!r})"


def _family(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "float"
    for kind, name in ((T.StringType, "str"), (T.TimestampNTZType, "naive"), (T.TimestampType, "aware"), (T.DateType, "date"), (T.BinaryType, "bytes"), (T.ArrayType, "list")):
        if isinstance(t, kind):
            return name
    return "other"


def _value_family(v: Any) -> str:
    if isinstance(v, dt.datetime):
        return "naive" if v.tzinfo is None else "aware"
    for kind, name in ((bool, "bool"), (int, "int"), (float, "float"), (str, "str"), (dt.date, "date"), (bytes, "bytes"), ((list, tuple), "list")):
        if isinstance(v, kind):
            return name
    return "other"


_NUMBERS = ("bool", "int", "float")


def _literal(v: Any, family: str) -> Column:
    return F.lit(v.isoformat(" ")).cast("timestamp_ntz") if family == "naive" else F.lit(v)


class Leaf(Condition):
    def __init__(self, entity: EntityType, field: str, op: str, value: Any):
        self._entity, self.field, self.op, self.value = entity, field, op, value

    def types(self) -> set[str]:
        return {self._entity.name}

    def entity(self) -> EntityType:
        return self._entity

    def leaves(self) -> list[Leaf]:
        return [self]

    def __repr__(self) -> str:
        return f"{self._entity.name}.{self.field} {self.op} {self.value!r}"

    def _column(self) -> tuple[Column, T.DataType]:
        return F.col(f"`{self.field}`"), self._entity.field(self.field).spark

    def holds(self) -> Column:
        return self._compile(True)

    def fails(self) -> Column:
        return self._compile(False)

    def _compile(self, true: bool) -> Column:
        c, t = self._column()
        value = self.value
        if isinstance(value, Ref):
            if value.oid is None:
                raise QueryError(f"{self!r}: the referenced record was never committed")
            value = value.oid
        if self.op == "==":
            return _equal(c, t, value, true)
        if self.op == "!=":
            return _equal(c, t, value, not true)
        if self.op == "in":
            parts = [_equal(c, t, v, true) for v in value]
            plain = [v for v in value if v is not None and _value_family(v) == _family(t) in ("str", "int")]
            if len(plain) == len(parts) and all(type(v) is not int or v in LONG for v in plain) and plain:
                return c.isin(*plain) if true else c.isNull() | ~c.isin(*plain)
            return reduce(or_ if true else and_, parts, F.lit(not true) if not parts else parts[0])
        if self.op in ("contains", "startswith"):
            return self._text(c, t, value, true)
        return _ordered(c, t, self.op, value, true, repr(self))

    def _text(self, c: Column, t: T.DataType, value: Any, true: bool) -> Column:
        if isinstance(t, T.ArrayType) and self.op == "contains":
            same = _family(t.elementType) == _value_family(value) or {_family(t.elementType), _value_family(value)} <= set(_NUMBERS)
            if not same:
                return F.lit(not true)
            # arrays never reach the scan's filters, so coalesce costs nothing here; a null element makes the result null
            has = F.coalesce(F.array_contains(c, F.lit(value).cast(t.elementType)), F.lit(False))
            return has if true else ~has
        if not isinstance(t, T.StringType):
            return F.lit(not true)
        has = c.contains(value) if self.op == "contains" else c.startswith(value)
        return has if true else c.isNull() | ~has


def _equal(c: Column, t: T.DataType, v: Any, true: bool) -> Column:
    """Python's ==, or its negation: values of unlike kinds are never equal, numbers compare across kinds."""
    if isinstance(v, Ref):
        v = v.oid
    if v is None:
        return c.isNull() if true else c.isNotNull()
    family, own = _value_family(v), _family(t)
    if own in _NUMBERS and family in _NUMBERS:
        if isinstance(v, float) and math.isnan(v):
            return F.lit(not true)
        if own == "bool":
            if v not in (0, 1):
                return F.lit(not true)
            v = bool(v)
        elif own == "int":
            if v != int(v) if not math.isinf(v) else True:
                return F.lit(not true)
            v = int(v)
            if v not in LONG:
                return F.lit(not true)
        else:
            v = float(v)
    elif own != family:
        return F.lit(not true)
    elif own == "list":
        lit = F.array(*[F.lit(x) for x in v]).cast(t)
        return c.eqNullSafe(lit) if true else ~c.eqNullSafe(lit)
    lit = _literal(v, family)
    return c == lit if true else ~c.eqNullSafe(lit)


def _ordered(c: Column, t: T.DataType, op: str, v: Any, true: bool, text: str) -> Column:
    """Ordering: null or NaN on either side never matches."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return F.lit(not true)
    family, own = _value_family(v), _family(t)
    nan = None
    if own in _NUMBERS and family in _NUMBERS:
        if own == "bool":
            c, own = c.cast("int"), "int"
        if own == "int" and (isinstance(v, float) or isinstance(v, bool)):
            if isinstance(v, float) and math.isinf(v):
                v = 2**64 if v > 0 else -(2**64)
            else:
                v = math.floor(v) if op in ("<=", ">") else math.ceil(v)
        if own == "int" and v not in LONG:
            always = (v > 0) == (op in ("<", "<="))
            return (c.isNotNull() if true else c.isNull()) if always else F.lit(not true)
        if own == "float":
            v = float(v)
            nan = F.isnan(c)
    elif own != family or own in ("other", "list"):
        raise QueryError(f"{text}: values of these kinds have no order")
    lit = _literal(v, family)
    yes = {"<": c < lit, "<=": c <= lit, ">": c > lit, ">=": c >= lit}[op]
    no = {"<": c >= lit, "<=": c > lit, ">": c <= lit, ">=": c < lit}[op]
    # Spark ranks NaN above every number, Python ranks it nowhere
    if nan is not None and op in (">", ">="):
        yes, no = yes & ~nan, no | nan
    return yes if true else c.isNull() | no


class FieldRef:
    """A field of a type; comparing it makes a condition."""

    __hash__ = None

    def __init__(self, entity: EntityType, name: str):
        self.entity, self.name = entity, name

    def _leaf(self, op: str, value: Any) -> Leaf:
        if isinstance(value, Condition):
            raise QueryError("& and | bind tighter than a comparison: put each comparison in parentheses")
        return Leaf(self.entity, self.name, op, value)

    def __eq__(self, value):
        return self._leaf("==", value)

    def __ne__(self, value):
        return self._leaf("!=", value)

    def __lt__(self, value):
        return self._leaf("<", value)

    def __le__(self, value):
        return self._leaf("<=", value)

    def __gt__(self, value):
        return self._leaf(">", value)

    def __ge__(self, value):
        return self._leaf(">=", value)

    def in_(self, values) -> Leaf:
        return self._leaf("in", tuple(values))

    def contains(self, value) -> Leaf:
        return self._leaf("contains", value)

    def startswith(self, value: str) -> Leaf:
        if not isinstance(value, str):
            raise QueryError("startswith takes a string")
        return self._leaf("startswith", value)

    def between(self, low, high) -> Condition:
        return (self >= low) & (self <= high)

    def __repr__(self) -> str:
        return f"{self.entity.name}.{self.name}"
