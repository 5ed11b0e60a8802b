"""Versioned typed tables: Parquet segments per type and commit, a manifest published by one rename.

A commit writes its segments first and then swaps the manifest; what a crashed commit left behind is not in the manifest,
is never read, and is swept away when the store is opened for writing. Reads are DataFrames over the segments valid at a
transaction; the newest row of each oid wins, tombstones fall out.
"""

from __future__ import annotations

import json
import socket
import threading
import time
import uuid
import warnings
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import security
from ..errors import Conflict, CorruptRecord, FrozenEntity, NewerStore, NotAnEntity, QueryError, SchemaMismatch, StoreLocked, UniqueViolation
from ..operators.graph import blocked_deletes, edges
from ..plans.extent import Extent
from ..runtime import HadoopFiles, fresh_path, materialize
from ..schema import CID, DELETED, LABELS, LEGACY_LABELS, OID, TID, EntityType
from ..security import Principal

FORMAT = 1
#: The first oid. A fixed value of the data model.
FIRST_OID = 1 << 40
#: Segments of a type beyond which a commit compacts it, if the store was opened with auto_compact.
MAX_SEGMENTS = 16
#: Seconds after which a lock that nobody renewed may be taken over; its holder renews it four times as often.
LEASE = 60.0


@dataclass
class Staged:
    entity: EntityType
    rows: DataFrame | None = None
    new: DataFrame | None = None
    deletes: DataFrame | None = None
    #: Unique keys that the way the rows were made keeps unique.
    sure: frozenset[str] = frozenset()


def shape_projection(entity: EntityType, columns: list[str]) -> list[Column]:
    """The entity's columns read from rows of an older shape: renamed, derived, defaulted or cast."""
    have = set(columns)
    old = {c: F.col(f"`{c}`") for c in columns}
    out = []
    for name, f in entity.fields.items():
        kind = entity.columns[name]
        if name in have:
            value = old[name]
        elif f.renamed_from and f.renamed_from in have:
            value = old[f.renamed_from]
        elif f.glue is not None:
            value = f.glue(old)
        elif f.required and f.default is None:
            raise SchemaMismatch(f"{entity.name}.{name} is required, has no default, and older records lack it")
        else:
            value = F.lit(f.default)
        out.append(value.cast(kind).alias(name))
    if entity.protected:
        out += [(F.coalesce(old[c], F.lit(LEGACY_LABELS[c]).cast(t)) if c in have else F.lit(LEGACY_LABELS[c]).cast(t)).alias(c) for c, t in LABELS.items()]
    return out


def newest(rows: DataFrame) -> DataFrame:
    """The latest row of each oid; combined on the map side, so a record of many versions costs one row per task."""
    rest = [c for c in rows.columns if c != OID]
    top = rows.groupBy(OID).agg(F.max_by(F.struct(*[f"`{c}`" for c in rest]), F.col(TID)).alias("_r"))
    return top.select(OID, *[F.col("_r")[c].alias(c) for c in rest])


def _renewed(files: HadoopFiles, name: str, token: str, facts, closed: threading.Event) -> None:
    """Keeps a lock alive until its writer closes, its process ends, another one holds it, or it is gone with its store."""
    missed = 0
    while missed < 3 and not closed.wait(LEASE / 4):
        try:
            if json.loads(files.read(name))["token"] != token:
                return
            files.swap(name, facts())
            missed = 0
        except Exception:  # tried again; a lock that can't be renewed runs out
            missed += 1


class Store:
    def __init__(self, spark: SparkSession, path: str, principal: Principal | None = None, strict_deletes: bool = False, read_only: bool = False, auto_compact: bool = False, durability: str = "commit"):
        self.spark, self.path = spark, path.rstrip("/")
        self.principal, self.strict_deletes, self.read_only, self.auto_compact = principal, strict_deletes, read_only, auto_compact
        self.files = HadoopFiles(spark, self.path, durability)
        self._token = uuid.uuid4().hex
        self._staged: dict[str, Staged] = {}
        self.consumers: list[Any] = []
        if not read_only:
            self.files.mkdirs(self.path)
            self._lock()
        self.manifest = self._load()
        if not read_only:
            self._sweep()

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Store:
        return cls(spark, path, **options)

    @classmethod
    def temporary(cls, spark: SparkSession, **options) -> Store:
        """A store in the shared folder that is gone when the process ends: for tests and intermediate results."""
        return cls(spark, fresh_path(spark, "store"), **options)

    # -- manifest, lock, crash cleanup

    def _load(self) -> dict:
        name = f"{self.path}/manifest.json"
        if not self.files.exists(name):
            return {"format": FORMAT, "tid": 0, "next_oid": FIRST_OID, "root": None, "types": [], "segments": []}
        try:
            m = json.loads(self.files.read(name))
        except ValueError as e:
            raise CorruptRecord(f"{name} can't be read") from e
        if m["format"] > FORMAT:
            raise NewerStore(f"{self.path} has format {m['format']}, this engine knows {FORMAT}")
        return m

    def _save(self, manifest: dict) -> None:
        self._still_locked()
        self.files.swap(f"{self.path}/manifest.json", json.dumps(manifest))
        self.manifest = manifest

    def _lock(self) -> None:
        """Creates the lock, which only one writer can. One that wasn't renewed for LEASE seconds is moved away first, which again only one can."""
        name = f"{self.path}/writer.lock"
        facts = lambda: json.dumps({"token": self._token, "host": socket.gethostname(), "at": time.time()})
        for _ in range(2):
            try:
                self.files.write(name, facts(), overwrite=False)
                break
            except Exception as e:
                held = self._held()
                if held is not None and time.time() - held.get("at", 0) < LEASE:
                    raise StoreLocked(f"{self.path} is written by {held.get('host')}") from e
                if held is not None:
                    self.files.move(name, f"{name}.{self._token}")
                    self.files.delete(f"{name}.{self._token}")
        self._still_locked()
        self._closed = threading.Event()
        threading.Thread(target=_renewed, args=(self.files, name, self._token, facts, self._closed), daemon=True).start()

    def _held(self) -> dict | None:
        try:
            return json.loads(self.files.read(f"{self.path}/writer.lock"))
        except Exception:  # gone, or being written
            return None

    def _still_locked(self) -> None:
        held = self._held()
        if held is None or held["token"] != self._token:
            raise StoreLocked(f"another writer took over {self.path}")

    def close(self) -> None:
        if not self.read_only:
            self._closed.set()
            self._still_locked()
            self.files.delete(f"{self.path}/writer.lock")
            self.read_only = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _sweep(self) -> None:
        """Deletes folders that no manifest names: what a crash left."""
        known = {s["path"] for s in self.manifest["segments"]}
        for folder in self.files.list(f"{self.path}/data"):
            name = folder.rsplit("/", 1)[-1]
            if name not in known:
                self.files.delete(f"{self.path}/data/{name}")

    @property
    def tid(self) -> int:
        return self.manifest["tid"]

    @property
    def root(self) -> int | None:
        return self.manifest["root"]

    def set_root(self, oid: int) -> None:
        self._save(self.manifest | {"root": oid})

    # -- reads

    def _segments(self, typename: str, tid: int) -> list[dict]:
        return [s for s in self.manifest["segments"] if s["type"] == typename and s["low"] <= tid]

    def versions(self, entity: EntityType, tid: int | None = None, after: int = 0) -> DataFrame:
        """Every row version of a type in (after, tid], tombstones included, under the live shape."""
        upto = self.tid if tid is None else tid
        shapes = {t["cid"]: t for t in self.manifest["types"]}
        by_shape: dict[int, list[str]] = {}
        for s in self._segments(entity.name, upto):
            if s["high"] > after:
                by_shape.setdefault(s["cid"], []).append(f"{self.path}/data/{s['path']}")
        parts = []
        for cid, paths in sorted(by_shape.items()):
            cols = dict(shapes[cid]["columns"])
            ddl = ", ".join([f"{OID} bigint", f"{TID} bigint", f"{DELETED} boolean", *[f"`{n}` {t}" for n, t in cols.items()]])
            raw = self.spark.read.schema(ddl).parquet(*paths).where((F.col(TID) <= upto) & (F.col(TID) > after))
            parts.append(raw.select(OID, TID, DELETED, F.lit(cid).alias(CID), *shape_projection(entity, list(cols))))
        if not parts:
            ddl = ", ".join([f"{OID} bigint", f"{TID} bigint", f"{DELETED} boolean", f"{CID} int", *[f"`{n}` {t}" for n, t in entity.columns.items()]])
            return self.spark.createDataFrame([], ddl)
        return reduce(DataFrame.unionByName, parts)

    def snapshot(self, tid: int | None = None) -> Snapshot:
        return Snapshot(self, self.tid if tid is None else tid)

    def extent(self, entity: EntityType, tid: int | None = None) -> Extent:
        at = self.tid if tid is None else tid
        seen = bool(self._segments(entity.name, at))
        rows = newest(self.versions(entity, at)).where(~F.col(DELETED)).drop(DELETED)
        return Extent(rows, entity, self.principal, unseen=not seen)

    # -- staging

    def _stage(self, entity: EntityType) -> Staged:
        if not isinstance(entity, EntityType):
            raise NotAnEntity(f"{entity!r} is no entity type")
        staged = self._staged.setdefault(entity.name, Staged(entity))
        staged.sure = frozenset()
        return staged

    def insert(self, entity: EntityType, rows: DataFrame) -> None:
        """New records; absent fields get their defaults."""
        s = self._stage(entity)
        cols = set(rows.columns)
        full = rows.select(*[(F.col(f"`{n}`") if n in cols else F.lit(entity.fields[n].default if n in entity.fields else None)).cast(t).alias(n) for n, t in entity.columns.items()])
        s.new = full if s.new is None else s.new.unionByName(full)

    def update(self, entity: EntityType, rows: DataFrame) -> None:
        """Whole records by __oid__; of repeated oids the last staged call wins."""
        if entity.frozen:
            raise FrozenEntity(f"{entity.name} is append-only")
        s = self._stage(entity)
        part = rows.select(OID, *[F.col(f"`{n}`").cast(t).alias(n) for n, t in entity.columns.items()])
        s.rows = part if s.rows is None else s.rows.join(part.select(OID), OID, "left_anti").unionByName(part)

    def delete(self, entity: EntityType, oids: DataFrame) -> None:
        """Records by __oid__. Deleting what isn't there does nothing; a delete wins over a write of the same commit."""
        s = self._stage(entity)
        part = oids.select(OID).distinct()
        s.deletes = part if s.deletes is None else s.deletes.unionByName(part).distinct()

    def upsert(self, entity: EntityType, rows: DataFrame, key: str | None = None, order: str | None = None) -> None:
        """Merges by a unique key. Only given, changed fields are written; an unchanged record isn't written at all.

        Of rows with one key the one with the greatest order wins (without order: the greatest row, so that reruns agree).
        """
        if key is None:
            if len(entity.uniques) != 1:
                raise QueryError(f"{entity.name} has {len(entity.uniques)} unique fields: name the key")
            key = entity.uniques[0]
        elif not entity.field(key).unique:
            raise QueryError(f"{entity.name}.{key} is not unique")
        given = [c for c in rows.columns if c in entity.fields]
        keep = [c for c in given if c != key]
        by = F.struct(*([order] if order else []), *[f"`{c}`" for c in keep])
        source = rows.groupBy(key).agg(F.max(by).alias("_w")).select(F.col(key).alias("_k"), *[F.col("_w")[c].cast(entity.columns[c]).alias(f"_n_{c}") for c in keep])
        now = self.extent(entity).rows
        changed = reduce(lambda a, b: a | b, [~F.col(f"_n_{c}").eqNullSafe(F.col(f"`{c}`")) for c in keep], F.lit(False))
        met = source.join(now, F.col("_k") == F.col(f"`{key}`"), "left").withColumn("_way", F.when(F.col("_k").isNull(), "null").when(F.col(OID).isNull(), "new").when(changed, "hit"))
        met = materialize(met.where("_way is not null"), "upsert")
        ways = {r["_way"]: r["count"] for r in met.groupBy("_way").count().collect()}
        if "null" in ways:
            raise QueryError(f"{entity.name}.{key} is null in an upsert")
        if entity.frozen and "hit" in ways:
            raise FrozenEntity(f"{entity.name} is append-only")
        alone = entity.name not in self._staged
        merged = lambda c: F.col(f"_n_{c}").alias(c) if c in keep else F.col(f"`{c}`")
        if "hit" in ways:
            self.update(entity, met.where("_way = 'hit'").select(OID, *[merged(c) for c in entity.columns]))
        if "new" in ways:
            self.insert(entity, met.where("_way = 'new'").select(F.col("_k").alias(key), *[F.col(f"_n_{c}").alias(c) for c in keep]))
        if ways and alone:
            self._stage(entity).sure = frozenset([key])  # each key comes once, with the record that has it

    def discard(self) -> None:
        self._staged.clear()

    # -- commit

    def _new_oids(self, rows: DataFrame, first: int) -> tuple[DataFrame, int]:
        """Oids without gaps: the rows are fixed with their task and place first, then each task's share is offset."""
        at = F.monotonically_increasing_id()
        fixed = materialize(rows.withColumn("_at", at), "new-rows")
        task = F.shiftright("_at", 33)
        sizes = sorted((r[0], r[1]) for r in fixed.groupBy(task.alias("task")).count().collect())
        start, starts = first, {}
        for t, n in sizes:
            starts[t], start = start, start + n
        if not starts:
            return fixed.withColumn(OID, F.lit(None).cast("bigint")).drop("_at"), first
        base = self.spark.createDataFrame(list(starts.items()), "_task bigint, _base bigint")
        # places within a task are dense, as the ids of a written partition are
        place = F.col("_at").bitwiseAND((1 << 33) - 1)
        return fixed.join(F.broadcast(base), task == F.col("_task")).withColumn(OID, F.col("_base") + place).drop("_at", "_task", "_base"), start

    def commit(self, actor: int | None = None, expected: int | None = None, since: int | None = None) -> int | None:
        """Writes what is staged as the next transaction; None if nothing is. A refusal leaves store and stage as they were.

        expected: the store must still be at that transaction. since: the records staged must not have changed after it.
        Each type's segment is written first; the checks read it there, and the manifest makes it count.
        """
        if expected is not None and expected != self.tid:
            raise Conflict(f"the store is at {self.tid}, the change was made on {expected}")
        tid, next_oid = self.tid + 1, self.manifest["next_oid"]
        types, segments = list(self.manifest["types"]), []
        prepared: list[tuple[EntityType, DataFrame, DataFrame]] = []
        try:
            for s in self._staged.values():
                e = s.entity
                current = self.extent(e).rows if self._segments(e.name, self.tid) else None
                rows, next_oid = self._segment_rows(s, current, tid, next_oid)
                name = f"{e.name}-{tid:012d}-{uuid.uuid4().hex}"
                order = [c for c, f in e.fields.items() if f.sorted or f.index and not f.type.startswith("array")][:1]
                segments.append({"type": e.name, "path": name, "cid": self._shape(types, e), "low": tid, "high": tid})
                rows.sortWithinPartitions(*order, OID).write.parquet(f"{self.path}/data/{name}")
                made = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}")
                gone = made.where(F.col(DELETED)).select(OID)
                upserts = made.where(~F.col(DELETED)).select(OID, *[f"`{c}`" for c in e.columns]) if s.rows is not None or s.new is not None else None
                if made.limit(1).count():
                    self._check(e, upserts, gone, current, s.sure, since)
                    prepared.append((e, upserts, gone))
                else:
                    self.files.delete(f"{self.path}/data/{segments.pop()['path']}")
            if self.strict_deletes:
                self._check_dangling(prepared)
        except Exception:
            for made in segments:
                self.files.delete(f"{self.path}/data/{made['path']}")
            raise
        if not prepared:
            self._staged.clear()
            return None
        facts = {"tid": tid, "actor": actor if actor is not None else (self.principal.uid if self.principal else 0), "at": time.time_ns()}
        self.files.mkdirs(f"{self.path}/commits")
        self.files.write(f"{self.path}/commits/{tid:012d}.json", json.dumps(facts))
        self._save(self.manifest | {"tid": tid, "next_oid": next_oid, "types": types, "segments": self.manifest["segments"] + segments})
        self._staged.clear()
        self._deliver({e.name: e for e, _, _ in prepared})
        if self.auto_compact:
            for e, _, _ in prepared:
                self.compact_if_needed(e)
        return tid

    def _segment_rows(self, s: Staged, current: DataFrame | None, tid: int, next_oid: int) -> tuple[DataFrame, int]:
        """What the segment of a type holds: the rows written and tombstones. Only records that exist are deleted, and a delete wins over a write."""
        e, upserts, deletes = s.entity, s.rows, s.deletes
        if s.new is not None:
            new = security.born(s.new, self.principal or security.ROOT) if e.protected else s.new
            new, next_oid = self._new_oids(new, next_oid)
            new = new.select(OID, *[f"`{c}`" for c in e.columns])
            upserts = new if upserts is None else upserts.unionByName(new)
        if upserts is not None and deletes is not None:
            upserts = upserts.join(deletes, OID, "left_anti")
        stamp = lambda gone: [F.lit(tid).cast("bigint").alias(TID), F.lit(gone).alias(DELETED)]
        rows = None if upserts is None else upserts.select(OID, *stamp(False), *[f"`{c}`" for c in e.columns])
        if deletes is not None:
            known = deletes.limit(0) if current is None else deletes.join(current.select(OID), OID, "left_semi")
            gone = known.select(OID, *stamp(True), *[F.lit(None).cast(t).alias(c) for c, t in e.columns.items()])
            rows = gone if rows is None else rows.unionByName(gone)
        return rows, next_oid

    def _shape(self, types: list[dict], e: EntityType) -> int:
        columns = [[n, t] for n, t in e.columns.items()]
        for t in types:
            if t["name"] == e.name and t["columns"] == columns:
                return t["cid"]
        cid = 1 + max([t["cid"] for t in types], default=0)
        types.append({"cid": cid, "name": e.name, "columns": columns})
        return cid

    def _check(self, e: EntityType, upserts: DataFrame | None, deletes: DataFrame, current: DataFrame | None, sure: frozenset[str] = frozenset(), since: int | None = None) -> None:
        if since is not None and current is not None and since < self.tid:
            touched = deletes if upserts is None else deletes.unionByName(upserts.select(OID))
            if bad := current.where(F.col(TID) > since).join(touched, OID, "left_semi").select(OID).take(1):
                raise Conflict(f"record {bad[0][0]} of {e.name} changed after {since}")
        if upserts is not None:
            for key in e.uniques:
                if key in sure:
                    continue
                if bad := self.unique_violations(e, key, upserts, deletes, current).take(1):
                    raise UniqueViolation(f"{e.name}.{key}: {bad[0]['key']!r} " + ("comes more than once in the commit" if bad[0]["fresh"] > 1 else "is taken"))
        if e.protected and self.principal is not None:
            none = self.spark.createDataFrame([], ", ".join([f"{OID} bigint", *[f"`{n}` {t}" for n, t in e.columns.items()]]))
            prior = none if current is None else current.select(OID, *[f"`{c}`" for c in e.columns])
            security.check_writes(upserts if upserts is not None else none, prior, deletes, self.principal)
            if e.actor and upserts is not None:
                security.check_grants(upserts, prior, self.principal)

    @staticmethod
    def unique_violations(e: EntityType, key: str, upserts: DataFrame, deletes: DataFrame, current: DataFrame | None) -> DataFrame:
        """(key, fresh, records): values of a unique field that more than one record would have after the writes; fresh counts those written. Nulls are free."""
        c = F.col(f"`{key}`")
        every = upserts.select(c.alias("key"), F.lit(1).alias("fresh"))
        if current is not None:
            touched = deletes.select(OID).unionByName(upserts.select(OID))
            kept = current.select(OID, c.alias("key")).join(touched, OID, "left_anti").select("key", F.lit(0).alias("fresh"))
            every = every.unionByName(kept)
        met = every.where("key is not null").groupBy("key").agg(F.sum("fresh").alias("fresh"), F.count("*").alias("records"))
        return met.where("fresh > 0 and records > 1")

    def _check_dangling(self, prepared: list[tuple[EntityType, DataFrame, DataFrame]]) -> None:
        from ..errors import DanglingRef

        gone = [d for _, _, d in prepared if d is not None]
        if not gone:
            return
        deletes = reduce(DataFrame.unionByName, gone)
        extents = []
        for e, upserts, _ in prepared:
            if e.refs:
                now = self.extent(e).rows.select(OID, *[f"`{c}`" for c in e.columns])
                if upserts is not None:
                    now = now.join(upserts.select(OID), OID, "left_anti").unionByName(upserts.select(now.columns))
                extents.append(Extent(now, e))
        seen = {e.name for e, _, _ in prepared}
        extents += [self.extent(e) for e in self.known_types if e.name not in seen and e.refs]
        if extents and (bad := blocked_deletes(edges(*extents), deletes).take(1)):
            raise DanglingRef(f"record {bad[0]['src']} still refers to the deleted {bad[0]['dst']}")

    known_types: tuple[EntityType, ...] = ()

    # -- consumers

    def attach(self, consumer: Any) -> None:
        """A consumer with `watermark` and `apply(delta)`; it must be where the store is."""
        if consumer.watermark != self.tid:
            raise Conflict(f"the consumer is at {consumer.watermark}, the store at {self.tid}: replay or bootstrap it first")
        self.consumers.append(consumer)

    def detach(self, consumer: Any) -> None:
        self.consumers.remove(consumer)

    def _deliver(self, entities: dict[str, EntityType]) -> None:
        if not self.consumers:
            return
        delta = self.delta(self.tid, list(entities.values()))
        for c in list(self.consumers):
            try:
                c.apply(delta)
            except Exception as e:  # a broken consumer must not stop the writer
                warnings.warn(f"consumer {c!r} failed at {self.tid} and was detached: {e}", RuntimeWarning, stacklevel=2)
                self.consumers.remove(c)

    def delta(self, tid: int, entities: list[EntityType]):
        """The changes of one transaction with the state before; their order is that of (op descending, oid): upserts by oid, then tombstones."""
        from ..streaming.changes import Delta

        facts = f"{self.path}/commits/{tid:012d}.json"
        made = json.loads(self.files.read(facts)) if self.files.exists(facts) else {"actor": 0, "at": 0}
        parts = []
        for e in entities:
            rows = self.versions(e, tid, tid - 1)
            cols = [f"`{c}`" for c in e.columns]
            prior = newest(self.versions(e, tid - 1)).where(~F.col(DELETED)).join(rows.select(OID), OID, "left_semi")
            prior = prior.select(OID, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("prior"))
            now = F.when(~F.col(DELETED), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
            parts.append(
                rows.select(OID, CID, DELETED, now.alias("payload")).join(prior, OID, "left").select(
                    F.when(F.col(DELETED), "delete").otherwise("upsert").alias("op"), F.col(OID).alias("oid"), F.lit(e.name).alias("type"), F.col(CID).alias("cid"), "payload", "prior"
                )
            )
        ops = reduce(DataFrame.unionByName, parts)
        shapes = [t for t in self.manifest["types"] if t["name"] in {e.name for e in entities}]
        return Delta(tid=tid, actor=made["actor"], at=made["at"], ops=ops, types=shapes, root=self.root)

    # -- upkeep

    def compact(self, entity: EntityType, files: int | None = None) -> None:
        """One fold-free segment under the live shape. Snapshots before the current transaction are given up."""
        rows = newest(self.versions(entity)).where(~F.col(DELETED))
        rows = rows.select(OID, TID, DELETED, *[f"`{c}`" for c in entity.columns])
        name = f"{entity.name}-c{self.tid:012d}-{uuid.uuid4().hex}"
        (rows.coalesce(files) if files else rows).write.parquet(f"{self.path}/data/{name}")
        types = list(self.manifest["types"])
        cid = self._shape(types, entity)
        kept = [s for s in self.manifest["segments"] if s["type"] != entity.name]
        old = [s["path"] for s in self.manifest["segments"] if s["type"] == entity.name]
        low = min([s["low"] for s in self.manifest["segments"] if s["type"] == entity.name], default=self.tid)
        self._save(self.manifest | {"types": types, "segments": kept + [{"type": entity.name, "path": name, "cid": cid, "low": low, "high": self.tid}]})
        for path in old:
            self.files.delete(f"{self.path}/data/{path}")

    def compact_if_needed(self, entity: EntityType, most: int = MAX_SEGMENTS) -> bool:
        if len(self._segments(entity.name, self.tid)) <= most:
            return False
        self.compact(entity)
        return True

    migrate = compact

    def verify(self, entity: EntityType) -> DataFrame:
        """(__oid__, __tid__, problem): records without a required field, or whose reference field holds no oid."""
        rows = self.extent(entity).rows
        rules = [F.when(F.col(f"`{n}`").isNull(), F.lit(f"{n} is null")) for n, f in entity.fields.items() if f.required]
        rules += [F.when(F.col(f"`{n}`") < FIRST_OID, F.lit(f"{n} is no oid")) for n in entity.refs if entity.fields[n].type == "bigint"]
        if not rules:
            return rows.limit(0).select(OID, TID, F.lit("").alias("problem"))
        return rows.select(OID, TID, F.explode(F.array_compact(F.array(*rules))).alias("problem"))

    def parquet_paths(self, entity: EntityType) -> list[str]:
        """The segment folders, for other engines."""
        return [f"{self.path}/data/{s['path']}" for s in self._segments(entity.name, self.tid)]


class Snapshot:
    """The store as it was at one transaction."""

    def __init__(self, store: Store, tid: int, principal: Principal | None = None):
        if tid > store.tid or tid < 0:
            raise QueryError(f"no transaction {tid}: the store is at {store.tid}")
        self.store, self.tid, self.principal = store, tid, principal or store.principal

    def all(self, entity: EntityType) -> Extent:
        x = self.store.extent(entity, self.tid)
        return x.for_principal(self.principal) if self.principal else x

    def for_principal(self, principal: Principal) -> Snapshot:
        return Snapshot(self.store, self.tid, principal)

    def deref(self, entity: EntityType, refs: Any) -> DataFrame:
        """One row per reference, aligned; an error if a record is missing or may not be read."""
        rows = Extent(self.store.extent(entity, self.tid).rows, entity).deref(refs)
        return security.require_readable(rows, self.principal) if entity.protected and self.principal else rows

    def incoming(self, targets: DataFrame, *entities: EntityType) -> DataFrame:
        from ..operators.graph import incoming

        return incoming(edges(*[self.all(e) for e in entities]), targets)


def committing(store: Store, work, retries: int = 3) -> int | None:
    """Runs work(store) and commits; if one of its records changed meanwhile, discards, reloads and tries again."""
    for attempt in range(retries + 1):
        base = store.tid
        try:
            work(store)
            return store.commit(since=base)
        except Conflict:
            store.discard()
            store.manifest = store._load()
            if attempt == retries:
                raise
