"""All current records of a type as one lazy DataFrame, and the reads over it.

An extent composes fold, shape projection, read filter, condition, order and window; Catalyst plans the whole. Nothing is
collected unless the name says so (count, query_iter).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import DanglingRef, QueryError, UnseenType
from ..predicates import Condition, Ref, condition
from ..schema import OID, EntityType
from ..security import Principal, read_filter, readable, redacted

#: Keys that a lookup sends as literals; beyond it they become a table that is joined.
INLINE_KEYS = 200


@dataclass(frozen=True)
class QueryPlan:
    """What a read would do: which leaves the scan's filters and statistics can answer, and Spark's own plan."""

    typename: str
    condition: str
    indexed: tuple[str, ...]
    residual: tuple[str, ...]
    pushed: tuple[str, ...]
    physical: str


def order_columns(entity: EntityType, order_by: Any) -> list[Column]:
    """A total order: nulls last in either direction, ties by ascending oid."""
    if order_by is None:
        return [F.col(OID).asc()]
    name, way = order_by if isinstance(order_by, tuple) else (order_by, "asc")
    name = getattr(name, "name", name)
    if way not in ("asc", "desc"):
        raise QueryError(f"the direction is 'asc' or 'desc', not {way!r}")
    if entity.field(name).type.lower().startswith(("array", "map", "struct")) or entity.field(name).blob:
        raise QueryError(f"{entity.name}.{name} has no order")
    c = F.col(f"`{name}`")
    return [c.asc_nulls_last() if way == "asc" else c.desc_nulls_last(), F.col(OID).asc()]


def window(rows: DataFrame, limit: int | None, offset: int) -> DataFrame:
    for what, n in (("offset", offset), ("limit", limit)):
        if n is not None and type(n) is not int:
            raise TypeError(f"{what} must be an int")
        if n is not None and n < 0:
            raise ValueError(f"{what} must not be negative")
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


class Extent:
    """rows has __oid__ and the entity's columns."""

    def __init__(self, rows: DataFrame, entity: EntityType, principal: Principal | None = None, unseen: bool = False):
        self.rows, self.entity, self.principal, self.unseen = rows, entity, principal, unseen

    @classmethod
    def of_table(cls, table: DataFrame, entity: EntityType, key: str, principal: Principal | None = None) -> Extent:
        """A plain table as an extent, one of its columns being the oid."""
        return cls(table.withColumn(OID, F.col(key).cast("bigint")), entity, principal)

    def for_principal(self, principal: Principal) -> Extent:
        return Extent(self.rows, self.entity, principal, self.unseen)

    def _visible(self) -> DataFrame:
        if self.unseen:
            warnings.warn(f"{self.entity.name} was never committed", UnseenType, stacklevel=3)
        return read_filter(self.rows, self.principal, self.entity.protected)

    def where(self, target: Condition | EntityType | None = None) -> DataFrame:
        rows = self._visible()
        if target is None or isinstance(target, EntityType):
            return rows
        names = condition(target).types()
        if names != {self.entity.name}:
            raise QueryError(f"the condition is over {sorted(names)}, the extent holds {self.entity.name}")
        return rows.where(target.holds())

    def query(self, target=None, *, limit: int | None = None, offset: int = 0, order_by=None) -> DataFrame:
        rows = self.where(target).select(OID, *[f"`{c}`" for c in self.entity.columns])
        order = order_columns(self.entity, order_by)
        return window(rows.orderBy(*order), limit, offset)

    def pluck(self, target, *names, limit: int | None = None, offset: int = 0, order_by=None) -> DataFrame:
        """Only the named fields; the field of the order need not be among them. A blob gives its descriptor."""
        if not names:
            raise QueryError("pluck needs a field")
        cols = [getattr(n, "name", n) for n in names]
        for n in cols:
            self.entity.field(n)
        return self.query(target, limit=limit, offset=offset, order_by=order_by).select(*[f"`{c}`" for c in cols])

    def count(self, target=None) -> int:
        return self.where(target).count()

    def count_rows(self, target=None) -> DataFrame:
        return self.where(target).agg(F.count("*").alias("n"))

    def query_iter(self, target=None) -> Iterator[Row]:
        """Rows one partition at a time, in the order of their oid."""
        return self.query(target).toLocalIterator(prefetchPartitions=True)

    def get(self, **key) -> DataFrame:
        """At most one row; a record that may not be read is as if it weren't there."""
        ((name, value),) = key.items()
        self._unique(name)
        return self.where(self.entity_field(name) == value).limit(1)

    def entity_field(self, name: str):
        from ..schema import fields

        return fields(self.entity)[name]

    def _unique(self, name: str) -> None:
        if not self.entity.field(name).unique:
            raise QueryError(f"{self.entity.name}.{name} is not unique")

    def get_many(self, keys: DataFrame | Iterable[Any], name: str) -> DataFrame:
        """One row per key, in their order (`ord`), with nulls where there is no record; repeated keys are answered each time."""
        self._unique(name)
        return self._aligned(self._keys(keys, name), name)

    def _keys(self, keys: DataFrame | Iterable[Any], name: str) -> DataFrame:
        if isinstance(keys, DataFrame):
            return keys.select(F.col("ord"), F.col("key"))
        kind = "bigint" if name == OID else self.entity.field(name).type
        rows = [(i, k.oid if isinstance(k, Ref) else k) for i, k in enumerate(keys)]
        return self.rows.sparkSession.createDataFrame(rows, f"ord int, key {kind}")

    def _aligned(self, keys: DataFrame, name: str, rows: DataFrame | None = None) -> DataFrame:
        rows = self._visible() if rows is None else rows
        return keys.join(rows, F.col("key") == F.col(f"`{name}`"), "left").orderBy("ord")

    def fetch(self, oids: Iterable[int]) -> DataFrame:
        """The records of some oids: literals while they are few, a join with their table beyond."""
        oids = list(oids)
        if len(oids) <= INLINE_KEYS:
            return self._visible().where(F.col(OID).isin(*oids) if oids else F.lit(False))
        wanted = self.rows.sparkSession.createDataFrame([(o,) for o in set(oids)], f"{OID} bigint")
        return self._visible().join(wanted, OID, "left_semi")

    def deref(self, refs: DataFrame | Iterable[Any], strict: bool = True) -> DataFrame:
        """One row per reference, aligned. A record that may not be read comes redacted; a missing one is an error, or null if not strict."""
        keys = self._keys(refs, OID)
        rows = redacted(self.rows, self.principal) if self.entity.protected and self.principal else self.rows
        out = self._aligned(keys, OID, rows)
        if strict and (bad := out.where(F.col("key").isNotNull() & F.col(OID).isNull()).select("key").take(1)):
            raise DanglingRef(f"no record {bad[0][0]}")
        return out

    def postings(self, name: str) -> DataFrame:
        """(value, n, oids): the records of each value of an indexed field; refused where it would tell of unreadable ones."""
        f = self.entity.field(name)
        if self.entity.protected:
            raise QueryError("postings of a protected type would tell of records that may not be read")
        if not (f.index or f.unique or f.sorted):
            raise QueryError(f"{self.entity.name}.{name} has no index")
        value = F.explode(f"`{name}`") if f.type.lower().startswith("array") else F.col(f"`{name}`")
        return self.rows.select(value.alias("value"), OID).groupBy("value").agg(F.countDistinct(OID).alias("n"), F.array_sort(F.collect_set(OID)).alias("oids"))

    def bitmaps(self, name: str) -> DataFrame:
        """(value, bucket, bitmap): postings as bitmaps of 32768 oids each, however many records a value has."""
        if self.entity.protected:
            raise QueryError("bitmaps of a protected type would tell of records that may not be read")
        f = self.entity.field(name)
        value = F.explode(f"`{name}`") if f.type.lower().startswith("array") else F.col(f"`{name}`")
        return (
            self.rows.select(value.alias("value"), F.bitmap_bucket_number(OID).alias("bucket"), F.bitmap_bit_position(OID).alias("bit"))
            .groupBy("value", "bucket")
            .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        )

    def explain(self, target=None, order_by=None) -> QueryPlan:
        rows = self.query(target, order_by=order_by)
        leaves = target.leaves() if isinstance(target, Condition) else []
        indexed, residual = [], []
        for leaf in leaves:
            f = self.entity.field(leaf.field)
            quick = (f.index or f.unique or f.sorted) and leaf.op in ("==", "in", "startswith", "contains") or f.sorted and leaf.op in ("<", "<=", ">", ">=")
            (indexed if quick else residual).append(repr(leaf))
        if self.entity.protected and self.principal and readable(self.principal) is not None:
            residual.append("read filter")
        physical = rows._jdf.queryExecution().executedPlan().toString()
        pushed = tuple(sorted({line.split("PushedFilters: ", 1)[1].split("]", 1)[0].lstrip("[") for line in physical.splitlines() if "PushedFilters: " in line}))
        return QueryPlan(self.entity.name, repr(target) if leaves else "extent", tuple(indexed), tuple(residual), pushed, physical)

    def handoff(self, target, other: DataFrame, on: str = OID) -> DataFrame:
        """Rows of other whose key a read of this extent gives: the read set as a semi-join, within one plan."""
        hits = self.where(target).select(F.col(OID).alias("__hit__"))
        return other.join(hits, F.col(on) == F.col("__hit__"), "left_semi")
