"""References between records as edges, and walks over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.extent import Extent
from ..runtime import materialize
from ..schema import OID


def oids_in(value: Column, kind: T.DataType) -> Column:
    """Every oid that a value of some type holds, at any depth: whole numbers, lists, maps (their values) and structs."""
    none = F.array().cast("array<bigint>")
    if isinstance(kind, T.IntegralType):
        return F.array_compact(F.array(value.cast("bigint")))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: oids_in(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(value), lambda x: oids_in(x, kind.valueType))), none)
    if isinstance(kind, T.StructType):
        return F.concat(none, *[oids_in(value[f.name], f.dataType) for f in kind.fields])
    return none


def edges(*extents: Extent) -> DataFrame:
    """(src, src_type, field, dst): every reference that the extents hold, those within lists, maps and structs one by one, each once."""
    parts = []
    for x in extents:
        kinds = {f.name: f.dataType for f in x.entity.struct.fields}
        for name in x.entity.refs:
            plain = isinstance(kinds[name], T.IntegralType)
            dst = F.col(f"`{name}`") if plain else F.explode(F.array_distinct(oids_in(F.col(f"`{name}`"), kinds[name])))
            rows = x.rows.select(F.col(OID).alias("src"), F.lit(x.entity.name).alias("src_type"), F.lit(name).alias("field"), dst.alias("dst"))
            parts.append(rows.withColumn("dst", F.col("dst").cast("bigint")).where("dst is not null"))
    if not parts:
        raise ValueError("no extent has a reference")
    return reduce(DataFrame.unionByName, parts)


def incoming(links: DataFrame, targets: DataFrame) -> DataFrame:
    """(dst, src, src_type): the distinct referrers of the targets (__oid__), whether or not the targets still exist."""
    wanted = targets.select(F.col(OID).alias("dst")).distinct()
    return links.join(wanted, "dst", "left_semi").select("dst", "src", "src_type").distinct()


def follow(child: DataFrame, field: str, parent: DataFrame, prefix: str = "to_") -> DataFrame:
    """One hop along a reference; children without target stay, with nulls."""
    p = parent.select(*[F.col(f"`{c}`").alias(prefix + c) for c in parent.columns])
    return child.join(p, F.col(f"`{field}`") == F.col(prefix + OID), "left")


#: Links that one round of a walk follows.
HOPS = 4


def closure(links: DataFrame, seeds: DataFrame, reverse: bool = False, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): what each seed reaches, with the least number of links; cycles end where they close.

    links (src, dst); reverse walks from dst to src. Each round follows HOPS links from the nodes of the greatest depth
    so far, and an anti-join drops what was met before; rounds are written tables, so a lost executor costs one round.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = materialize(links.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node is not null and next is not null").distinct(), "links")
    met = materialize(seeds.select(F.col(OID).alias("seed"), F.col(OID).alias("node"), F.lit(0).alias("depth")).distinct(), "closure")
    rounds, depth = [met], 0
    while rounds[-1].where(F.col("depth") == depth).take(1) and (max_depth is None or depth < max_depth):
        last = depth if max_depth is None else min(depth, max_depth - HOPS)
        level, levels = rounds[-1].where(F.col("depth") == depth).select("seed", "node"), []
        for hop in range(depth + 1, last + HOPS + 1):
            level = level.join(step, "node").select("seed", F.col("next").alias("node")).distinct()
            levels.append(level.withColumn("depth", F.lit(hop)))
        reached = reduce(DataFrame.unionByName, levels).groupBy("seed", "node").agg(F.min("depth").alias("depth"))
        seen = reduce(DataFrame.unionByName, rounds).select("seed", "node")
        rounds.append(materialize(reached.join(seen, ["seed", "node"], "left_anti"), "closure"))
        depth = last + HOPS
    return reduce(DataFrame.unionByName, rounds)


def dangling(links: DataFrame, *extents: Extent) -> DataFrame:
    """The edges whose target is in none of the extents."""
    alive = reduce(DataFrame.unionByName, [x.rows.select(F.col(OID).alias("dst")) for x in extents])
    return links.join(alive, "dst", "left_anti")


def blocked_deletes(links: DataFrame, deletes: DataFrame) -> DataFrame:
    """(dst, src, src_type): referrers of deleted records (__oid__) that aren't deleted with them."""
    gone = deletes.select(OID).distinct()
    left = links.join(gone.withColumnRenamed(OID, "dst"), "dst", "left_semi").join(gone.withColumnRenamed(OID, "src"), "src", "left_anti")
    return left.select("dst", "src", "src_type").distinct()


def in_degree(links: DataFrame) -> DataFrame:
    """(dst, n): how many references each target has, combined before the shuffle, so a hub is one row per task."""
    return links.groupBy("dst").agg(F.count("*").alias("n"))
