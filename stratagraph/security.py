"""Row-level permissions as Column expressions, and the gate that a commit's staged rows must pass."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import ReadDenied, SponsorRequired, UnknownActor, WriteDenied
from .schema import GROUPS, LABELS, OID, OWNER, READ_FLOOR, WRITE_FLOOR

# The ladder of levels, and the group that everyone is in. Fixed values of the permission model.
NO_STANDING, VIEWER, AGENT, AUTOMATION, STAFF, CURATOR, ADMIN, EXECUTIVE = -1, 0, 100, 200, 300, 400, 500, 600
WORLD = 0


@dataclass(frozen=True)
class Principal:
    """Who acts: a uid (0 is nobody) and the level held in each group."""

    uid: int = 0
    memberships: dict[int, int] = field(default_factory=dict)

    def level(self, group: int) -> int:
        """The level held in a group: everyone views the world, and without a membership one stands nowhere else."""
        if group in self.memberships:
            return self.memberships[group]
        return NO_STANDING if group != WORLD else VIEWER

    @property
    def root(self) -> bool:
        """True for someone (not nobody) whose level over the world is the highest."""
        return bool(self.uid) and self.level(WORLD) >= EXECUTIVE


ROOT = Principal(1, {WORLD: EXECUTIVE})


def level(p: Principal, group: Column) -> Column:
    """The level p holds in a group; the memberships are a literal map, so nothing is joined."""
    held = {WORLD: VIEWER} | p.memberships
    known = F.create_map(*[F.lit(x).cast(t) for g, v in held.items() for x, t in ((g, "bigint"), (v, "int"))])
    return F.coalesce(F.element_at(known, group.cast("bigint")), F.lit(NO_STANDING))


def owns(p: Principal, owner: Column) -> Column:
    return F.coalesce(owner == p.uid, F.lit(False)) if p.uid else F.lit(False)


def authority(p: Principal, owner: Column, groups: Column) -> Column:
    """The highest level over the record's groups; the owner of an unshared record acts at their personal best."""
    shared = F.coalesce(groups, F.array().cast("array<bigint>"))
    best = max(p.memberships.values(), default=VIEWER)
    through = F.aggregate(shared, F.lit(NO_STANDING), lambda a, g: F.greatest(a, level(p, g)))
    return F.when((F.size(shared) == 0) & owns(p, owner), F.lit(best)).otherwise(through)


def readable(p: Principal) -> Column | None:
    """True where p may read; None if nothing is to be filtered."""
    if p.root:
        return None
    return owns(p, F.col(OWNER)) | (authority(p, F.col(OWNER), F.col(GROUPS)) >= F.col(READ_FLOOR))


def read_filter(rows: DataFrame, p: Principal | None, protected: bool) -> DataFrame:
    """Unprotected types and root pay nothing: no filter is added."""
    if not protected or p is None or (rule := readable(p)) is None:
        return rows
    return rows.where(rule)


def redacted(rows: DataFrame, p: Principal, keep: tuple[str, ...] = (OID,)) -> DataFrame:
    """Every row, those that p may not read with null fields and __redacted__ true."""
    rule = F.lit(True) if p.root else F.coalesce(readable(p), F.lit(False))
    marked = rows.withColumn("__redacted__", ~rule)
    return marked.select(*[F.col(c) if c in keep or c == "__redacted__" else F.when(~F.col("__redacted__"), F.col(c)).alias(c) for c in marked.columns])


def _deny(found: list[tuple[Column, str]], rows: DataFrame, p: Principal) -> None:
    """An error for the first rule that a row breaks; all rules are read in one pass."""
    first = rows.agg(*[F.min(F.when(rule, F.col(OID))).alias(f"_{n}") for n, (rule, _) in enumerate(found)]).first()
    for n, (_, why) in enumerate(found):
        if first[n] is not None:
            raise WriteDenied(f"{why} (record {first[n]}, principal {p.uid}); nothing was written")


def check_writes(staged: DataFrame, prior: DataFrame, deletes: DataFrame, p: Principal) -> None:
    """Refuses staged rows (__oid__ and labels) or deletes (__oid__) that p may not write.

    The current write floor binds everyone, the owner included; the owner never changes; a changed floor is at most the
    writer's own authority; a group is added only by someone who stands in it. prior has the current labels by __oid__.
    """
    if p.root:
        return
    old = prior.select(OID, *[F.col(c).alias(f"old{c}") for c in LABELS])
    both = staged.select(OID, *LABELS).join(old, OID, "left")
    fresh = F.col(f"old{OWNER}").isNull()
    held = authority(p, F.col(f"old{OWNER}"), F.col(f"old{GROUPS}"))
    own = authority(p, F.col(OWNER), F.col(GROUPS))
    base_groups = F.when(fresh, F.array().cast("array<bigint>")).otherwise(F.col(f"old{GROUPS}"))
    added = F.array_except(F.coalesce(GROUPS, F.array().cast("array<bigint>")), base_groups)
    rules = [(fresh, "nobody can't create a protected record")] if p.uid == 0 else []
    rules += [
        (fresh & (F.col(OWNER) != p.uid), "a new record belongs to its writer"),
        (~fresh & (held < F.col(f"old{WRITE_FLOOR}")), "the write floor is above the writer's authority"),
        (~fresh & ~F.col(OWNER).eqNullSafe(F.col(f"old{OWNER}")), "ownership doesn't change after birth"),
        (F.exists(added, lambda g: level(p, g) == NO_STANDING), "the writer doesn't stand in an added group"),
    ]
    for floor in (READ_FLOOR, WRITE_FLOOR):
        was = F.when(fresh, F.lit(VIEWER)).otherwise(F.col(f"old{floor}"))
        rules.append(((F.col(floor) != was) & (F.col(floor) > own), "a floor is above the writer's authority"))
    _deny(rules, both, p)
    _deny([(held < F.col(f"old{WRITE_FLOOR}"), "a delete is a write below the floor")], deletes.select(OID).join(old, OID), p)


def check_grants(staged: DataFrame, prior: DataFrame, p: Principal) -> None:
    """Refuses memberships (map<bigint,int>) that rise above what p holds; lowering or removing is free."""
    if p.root:
        return
    both = staged.select(OID, "memberships").join(prior.select(OID, F.col("memberships").alias("was")), OID, "left")
    changed = F.map_filter("memberships", lambda g, v: ~v.eqNullSafe(F.element_at("was", g)) & (v > level(p, g)))
    _deny([(F.size(changed) > 0, "a granted level is above the granter's own")], both, p)


def share(rows: DataFrame, group: int) -> DataFrame:
    return rows.withColumn(GROUPS, F.array_union(F.coalesce(GROUPS, F.array().cast("array<bigint>")), F.array(F.lit(group).cast("bigint"))))


def unshare(rows: DataFrame, group: int) -> DataFrame:
    return rows.withColumn(GROUPS, F.array_remove(GROUPS, F.lit(group).cast("bigint")))


def protect(rows: DataFrame, read: int | None = None, write: int | None = None) -> DataFrame:
    for column, floor in ((READ_FLOOR, read), (WRITE_FLOOR, write)):
        if floor is not None:
            rows = rows.withColumn(column, F.lit(floor))
    return rows


def born(rows: DataFrame, p: Principal) -> DataFrame:
    """New rows with the labels of their birth where none are given: the writer's own, unshared."""
    first: dict[str, Any] = {OWNER: p.uid, GROUPS: None, READ_FLOOR: VIEWER, WRITE_FLOOR: VIEWER}
    for c, t in LABELS.items():
        start = F.array().cast(t) if c == GROUPS else F.lit(first[c]).cast(t)
        rows = rows.withColumn(c, F.coalesce(F.col(c), start) if c in rows.columns else start)
    return rows


def acting_as(actors: DataFrame, uid: int, sponsor: int | None = None) -> Principal:
    """The principal of a registered actor. Machines act only under the sponsor that is registered for them."""
    found = actors.where(F.col("uid") == uid).limit(1).collect()
    if not found:
        raise UnknownActor(f"no actor {uid}")
    row = found[0]
    if not row["human"] and (row["sponsor"] is None or row["sponsor"] != sponsor):
        raise SponsorRequired(f"actor {uid} is a machine and acts only for its sponsor")
    return Principal(uid, dict(row["memberships"] or {}))


def require_readable(rows: DataFrame, p: Principal) -> DataFrame:
    """rows, or an error if p may not read one of them."""
    if not p.root and rows.where(~F.coalesce(readable(p), F.lit(False))).take(1):
        raise ReadDenied(f"principal {p.uid} may not read every record asked for")
    return rows
