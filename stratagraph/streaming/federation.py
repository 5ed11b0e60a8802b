"""Followers of a store: copies that replay its change log, and writes that go back to it.

A follower begins from the log's genesis and then takes what it lacks, all at once or as a stream. Its writes go to the
store as conditional upserts: they are refused if a record changed after the transaction they were made on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, DanglingRef, NotAnEntity, QueryError
from ..operators.graph import edges
from ..plans.extent import Extent
from ..schema import OID, EntityType
from ..sources.store import Store
from .changes import ChangeSource, DeltaLog, Mirror, catch_up


def head(log: DeltaLog) -> dict:
    """Where a log stands: what a follower asks before it takes changes."""
    return {"tid": log.watermark, "genesis": log.state["genesis"], "types": sorted({t["name"] for h in log.state["parts"] for t in h["types"]} | {t["name"] for t in log.state["types"]})}


class Follower:
    """A copy at path of the store whose change log is at feed."""

    def __init__(self, spark: SparkSession, path: str, feed: str, only: list[str] | None = None, verify: bool = False):
        self.spark, self.feed = spark, feed
        self.mirror = Mirror(spark, path, only, verify=verify)

    @property
    def watermark(self) -> int:
        return self.mirror.watermark

    def sync(self) -> int:
        """Takes what the log has beyond the copy; gives the number of transactions."""
        return catch_up(self.mirror, DeltaLog(self.spark, self.feed, read_only=True))

    def stream(self, checkpoint: str, once: bool = True):
        """Follows the log as a stream, in batches of whole transactions; once: until there is nothing more."""
        self.spark.dataSource.register(ChangeSource)
        read = self.spark.readStream.format("changes").option("path", self.feed).option("after", str(self.watermark)).load()

        def take(batch: DataFrame, _: int) -> None:
            low, high = batch.agg(F.min("tid"), F.max("tid")).first()
            if high is not None:
                self.mirror.apply_range(batch, low, high)

        write = read.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
        return (write.trigger(availableNow=True) if once else write).start()

    def table(self, typename: str, schema: str | None = None) -> DataFrame:
        return self.mirror.table(typename, schema)

    def contribute(self, store: Store, entity: EntityType, rows: DataFrame, actor: int | None = None) -> int | None:
        """Sends rows back to the store, as submit does, made on what this copy has; then takes the result over."""
        tid = submit(store, entity, rows, self.watermark, actor)
        self.sync()
        return tid


def submit(store: Store, entity: EntityType, rows: DataFrame, based_on: int, actor: int | None = None) -> int | None:
    """Writes whole records: those with an __oid__ replace the record they name, those without are new. Nothing is deleted.

    Refused, with nothing written: a record that is gone or changed after based_on, blobs, a reference to no record (so
    new records can't refer to each other), and whatever a commit refuses.
    """
    if not isinstance(entity, EntityType):
        raise NotAnEntity(f"{entity!r} is no entity type")
    if blobs := [n for n, f in entity.fields.items() if f.blob and n in rows.columns]:
        raise QueryError(f"{entity.name}.{blobs[0]} is a blob and can't be submitted")
    if store._staged:
        raise Conflict("the store has staged changes of its own")
    rows = rows if OID in rows.columns else rows.withColumn(OID, F.lit(None).cast("bigint"))
    old = rows.where(F.col(OID).isNotNull())
    if gone := old.join(store.extent(entity).rows.select(OID), OID, "left_anti").select(OID).take(1):
        raise Conflict(f"record {gone[0][0]} of {entity.name} is gone")
    for field in [n for n in entity.refs if n in rows.columns]:
        target = next((t for t in (entity, *store.known_types) if t.name == entity.fields[field].ref), None)
        if target is not None:
            held = edges(Extent(rows.withColumn(OID, F.coalesce(OID, F.lit(-1))), EntityType(entity.name, {field: entity.fields[field]})))
            if lost := held.join(store.extent(target).rows.select(F.col(OID).alias("dst")), "dst", "left_anti").select("dst").take(1):
                raise DanglingRef(f"{entity.name}.{field} refers to {lost[0][0]}, which is no {target.name}")
    try:
        store.update(entity, old)
        store.insert(entity, rows.where(F.col(OID).isNull()).drop(OID))
        return store.commit(actor=actor, since=based_on)
    except Exception:
        store.discard()
        raise
