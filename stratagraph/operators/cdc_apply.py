"""Problem 3: a feed of inserts, updates and deletes brought into effect in the order of its sequence.

The state lies in buckets by a fixed hash of the key. A feed is compacted where it is read and sent to its buckets;
each bucket that it touches is read and upserted by an embedded DuckDB: on conflict the stored sequence is compared
with the new one, so repeats and rows out of order change nothing, and a delete stays as a tombstone. Spark's writer
exports the touched buckets into a new version folder, the others stay where they are, and one file, created once,
publishes all of them together: of two feeds applied to one version the second is refused. As buckets grow beyond
BUCKET_BYTES their number is doubled.

A later feed may bring a higher attempt of a commit that is in effect already. So that what the lower attempt alone
wrote can be taken back, every feed is kept in a journal (unless journal=False); the records that an outdone attempt
wrote are built again from it.

Defined results: rows with a null key or sequence don't count; a delete wins over a write of the same sequence, else
the greater payload wins a tie; a null payload is a delete; of deliveries under one (store_id, tid) only those of the
highest attempt count (a null attempt is the lowest), null or empty lists do nothing; an inner tid is ignored in
favour of the outer one; empty tables give an empty state; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict
from ..functions.records import intact_rows
from ..runtime import HadoopFiles, disk_bytes, fresh_path, materialize

STATE = "store_id int, oid bigint, tid bigint, deleted boolean, cid int, payload string"
CHANGES = f"{STATE}, attempt int"
BUCKETED = f"{STATE}, bucket int"
#: Bytes on disk that a bucket should hold; DuckDB takes some thirty times as much for it, and may take MEMORY.
BUCKET_BYTES = 6 << 20
MEMORY = "500MB"
#: Bytes beyond which a size is the optimizer's word for not knowing it.
UNKNOWN = 1 << 60
#: The attempt of deliveries without one. Changes that come from no delivery have null.
NONE = -(2**31)


def as_changes(objects: DataFrame) -> DataFrame:
    """The record log as changes (CHANGES): intact rows, a null payload being a delete."""
    return intact_rows(objects).select("store_id", "oid", "tid", F.col("payload").isNull().alias("deleted"), "cid", "payload", F.lit(None).cast("int").alias("attempt"))


def winning_deliveries(batches: DataFrame) -> DataFrame:
    """Deliveries of the highest attempt per (store_id, tid). Only the few outdone attempts are joined, not the batches."""
    rows = batches.where(F.col("store_id").isNotNull() & F.col("tid").isNotNull()).withColumn("attempt", F.coalesce("attempt", F.lit(NONE)))
    top = rows.groupBy("store_id", "tid").agg(F.max("attempt").alias("top"), F.min("attempt").alias("low")).where("low < top").drop("low")
    return rows.join(top, ["store_id", "tid"], "left").where(F.col("top").isNull() | (F.col("attempt") == F.col("top"))).drop("top")


def batch_changes(batches: DataFrame) -> DataFrame:
    """Every record and delete of the winning deliveries (CHANGES), with the outer tid."""
    won = winning_deliveries(batches.select("store_id", "tid", "attempt", "records", "deletes"))
    ops = F.concat(
        F.transform(
            F.coalesce("records", F.array().cast("array<struct<oid:bigint,cid:int,tid:bigint,payload:string>>")),
            lambda r: F.struct(r["oid"].alias("oid"), r["payload"].isNull().alias("deleted"), r["cid"].alias("cid"), r["payload"].alias("payload")),
        ),
        F.transform(
            F.coalesce("deletes", F.array().cast("array<bigint>")),
            lambda d: F.struct(d.alias("oid"), F.lit(True).alias("deleted"), F.lit(None).cast("int").alias("cid"), F.lit(None).cast("string").alias("payload")),
        ),
    )
    # a delivery without oids still outdoes lower attempts: each leaves a row without oid
    mark = F.struct(F.lit(None).cast("bigint").alias("oid"), F.lit(True).alias("deleted"), F.lit(None).cast("int").alias("cid"), F.lit(None).cast("string").alias("payload"))
    return won.select("store_id", "tid", "attempt", F.inline(F.concat(F.filter(ops, lambda x: x["oid"].isNotNull()), F.array(mark)))).select("store_id", "oid", "tid", "deleted", "cid", "payload", "attempt")


def _newest(table: pa.Table) -> pa.Table:
    """One row per key: the greatest (tid, deleted, payload)."""
    order = table.sort_by([("store_id", "ascending"), ("oid", "ascending"), ("tid", "ascending"), ("deleted", "ascending"), ("payload", "ascending")])
    s, o = order["store_id"].to_numpy(), order["oid"].to_numpy()
    last = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    return order.filter(pa.array([*last, True])) if len(order) else order


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: a batch keeps the newest row of each key, so a hot key sends one row per batch."""
    for batch in batches:
        if batch.num_rows:
            yield from _newest(pa.Table.from_batches([batch])).to_batches()


def _upsert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    # no folder to spill to: a bucket fits the memory, and an executor's own disk may be gone with it
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
    con.execute("create table state (store_id integer, oid bigint, tid bigint, deleted boolean, cid integer, payload varchar, bucket integer, primary key (store_id, oid))")
    for batch in batches:
        if not batch.num_rows:
            continue
        con.register("feed", _newest(pa.Table.from_batches([batch])))
        con.execute(
            """insert into state select store_id, oid, tid, deleted, cid, payload, bucket from feed
            on conflict do update set tid = excluded.tid, deleted = excluded.deleted, cid = excluded.cid, payload = excluded.payload
            where excluded.tid > state.tid or (excluded.tid = state.tid and (excluded.deleted, coalesce(excluded.payload, '')) > (state.deleted, coalesce(state.payload, '')))"""
        )
        con.unregister("feed")
    yield from con.sql("select store_id, oid, tid, deleted, cid, payload, bucket from state").to_arrow_reader(10_000)
    con.close()


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("store_id", "oid"), F.lit(buckets)).cast("int")


class BucketedState:
    """The state at root: version folders with a folder per bucket, and next/<version>.json, which names what follows a version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = HadoopFiles(spark, self.root)

    def head(self) -> dict | None:
        """The newest published version: the end of the chain that starts from what _head.json remembers."""
        at, name = None, f"{self.root}/_head.json"
        if self.files.exists(name):
            at = json.loads(self.files.read(name))
        while self.files.exists(follows := f"{self.root}/next/{at['version'] if at else 'none'}.json"):
            at = json.loads(self.files.read(follows))
        return at

    def publish(self, before: dict | None, now: dict) -> None:
        """Makes now the version after before; Conflict if another one is. What is written so far is complete, so a crash after this loses nothing."""
        self.files.mkdirs(f"{self.root}/next")
        try:
            self.files.write(f"{self.root}/next/{before['version'] if before else 'none'}.json", json.dumps(now), overwrite=False)
        except Exception as e:
            raise Conflict(f"another feed was applied to {self.root} first") from e
        self.files.swap(f"{self.root}/_head.json", json.dumps(now))

    def read(self, head: dict | None, only: set[int] | None = None) -> DataFrame:
        """STATE of some or all buckets, tombstones included."""
        paths = [f"{self.root}/{version}/bucket={b}" for b, version in (head or {"places": {}})["places"].items() if only is None or int(b) in only]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def journal(self, head: dict | None) -> DataFrame:
        parts = [f"{self.root}/journal/{j}" for j in (head or {"journal": []})["journal"]]
        return self.spark.read.schema(CHANGES).parquet(*parts) if parts else self.spark.createDataFrame([], CHANGES)

    def vacuum(self) -> None:
        """Deletes what the newest version doesn't use: replaced buckets, and what failed feeds left. Not while a feed is applied."""
        head = self.head()
        used = set(head["places"].items()) if head else set()
        versions = {v for _, v in used}
        for folder in self.files.list(self.root):
            name = folder.rsplit("/", 1)[-1]
            if name in ("journal", "next", "_head.json"):
                continue
            if name not in versions:
                self.files.delete(folder)
                continue
            for sub in self.files.list(folder):
                bucket = sub.rsplit("=", 1)[-1]
                if "bucket=" in sub and (bucket, name) not in used:
                    self.files.delete(sub)

    def _fitted(self, head: dict | None, incoming: int) -> int:
        """How many buckets there should be: the number stays until they outgrow twice BUCKET_BYTES, and then doubles."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if not head:
            return max(least, -(-incoming // BUCKET_BYTES))
        n = head["buckets"]
        while head["bytes"] + incoming > 2 * n * max(BUCKET_BYTES, 1):
            n *= 2
        return n

    def apply(self, changes: DataFrame, journal: bool = True) -> dict:
        """Merges changes (CHANGES, or STATE without attempts) into the state and publishes the result; a failure leaves the old version current."""
        head, version = self.head(), uuid.uuid4().hex
        if "attempt" not in changes.columns:
            changes = changes.withColumn("attempt", F.lit(None).cast("int"))
        changes = changes.select(*[c.split()[0] for c in CHANGES.split(", ")])
        again: DataFrame | None = None
        if journal:
            path = f"{self.root}/journal/{version}"
            changes.write.parquet(path)
            changes = self.spark.read.schema(CHANGES).parquet(path)
            if head:
                changes, again = self._attempts(head, changes)
        if (incoming := disk_bytes(changes)) > UNKNOWN:
            changes = materialize(changes, "changes")
            incoming = disk_bytes(changes)
        buckets = self._fitted(head, incoming)
        whole = not head or buckets != head["buckets"]
        feed = changes.where("store_id is not null and oid is not null and tid is not null").drop("attempt")
        if again is not None:
            feed = feed.join(again.select("store_id", "oid").distinct(), ["store_id", "oid"], "left_anti").unionByName(again.where("tid is not null"))
        feed = feed.mapInArrow(_compact, STATE).withColumn("bucket", bucket_of(buckets))
        if head and not whole:
            feed = materialize(feed, "feed")
            touched = {r[0] for r in feed.select("bucket").union(again.select(bucket_of(buckets)) if again is not None else feed.select("bucket").limit(0)).distinct().collect()}
        else:
            touched = None
        old = self.read(head, touched)
        if again is not None:
            old = old.join(again.select("store_id", "oid").distinct(), ["store_id", "oid"], "left_anti")
        if head:
            feed = feed.unionByName(old.withColumn("bucket", bucket_of(buckets)))
        out = feed.repartitionById(buckets, F.col("bucket")).mapInArrow(_upsert, BUCKETED)
        out.write.partitionBy("bucket").parquet(f"{self.root}/{version}")
        made = {p.rsplit("=", 1)[-1]: version for p in self.files.list(f"{self.root}/{version}") if "bucket=" in p}
        kept = {} if whole else {b: v for b, v in head["places"].items() if int(b) not in touched}
        now = {
            "version": version, "buckets": buckets, "places": kept | made, "journal": [*(head or {"journal": []})["journal"], *([version] if journal else [])],
            "bytes": (0 if whole else head["bytes"]) + self.files.size(f"{self.root}/{version}"),
        }
        self.publish(head, now)
        return now

    def _attempts(self, head: dict, changes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The changes that count beside those of the journal, and the records to build again (one row with a null tid where nothing is left of one)."""
        past = self.journal(head)
        each = lambda rows: rows.where("attempt is not null").groupBy("store_id", "tid").agg(F.max("attempt").alias("top"))
        fresh = materialize(each(changes), "attempts")
        met = fresh.join(each(past).withColumnRenamed("top", "was"), ["store_id", "tid"])
        met = materialize(met.where("top <> was"), "outdone")
        if not met.limit(1).count():
            return changes, None
        best = met.select("store_id", "tid", F.greatest("top", "was").alias("best"))
        counts = lambda rows: rows.join(best, ["store_id", "tid"], "left").where(F.col("best").isNull() | F.col("attempt").isNull() | (F.col("attempt") == F.col("best"))).drop("best")
        lost = past.join(met.where("top > was"), ["store_id", "tid"]).where("attempt is not null and oid is not null").select("store_id", "oid").distinct()
        lost = materialize(lost, "lost")
        both = past.join(lost, ["store_id", "oid"], "left_semi").unionByName(changes.join(lost, ["store_id", "oid"], "left_semi"))
        # of attempts within the journal, too, only the highest counts
        top = past.unionByName(changes).where("attempt is not null").groupBy("store_id", "tid").agg(F.max("attempt").alias("t"))
        valid = counts(both).join(top, ["store_id", "tid"], "left").where(F.col("attempt").isNull() | (F.col("attempt") == F.col("t"))).select("store_id", "oid", "tid", "deleted", "cid", "payload")
        gone = lost.join(valid.select("store_id", "oid").distinct(), ["store_id", "oid"], "left_anti")
        blank = gone.select("store_id", "oid", *[F.lit(None).cast(t).alias(c) for c, t in (("tid", "bigint"), ("deleted", "boolean"), ("cid", "int"), ("payload", "string"))])
        return counts(changes), materialize(valid.unionByName(blank), "again")


def apply_feed(spark: SparkSession, root: str, changes: DataFrame, journal: bool = True) -> dict:
    """Merges changes into the state at root; see BucketedState.apply."""
    return BucketedState(spark, root).apply(changes, journal)


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The live records of the published version."""
    state = BucketedState(spark, root)
    return state.read(state.head()).where("not deleted").drop("deleted")


def rebuilt_records(objects: DataFrame, commit_batches: DataFrame) -> DataFrame:
    """(store_id, oid, tid, cid, payload): each store's live records after the log and the feed, applied at once."""
    spark = objects.sparkSession
    root = fresh_path(spark, "records")
    apply_feed(spark, root, as_changes(objects).unionByName(batch_changes(commit_batches)), journal=False)
    return read_state(spark, root)


def applied_feeds(objects: DataFrame, feeds: list[DataFrame]) -> DataFrame:
    """As rebuilt_records, but with the log as the first load and each feed of deliveries applied to it in turn."""
    spark = objects.sparkSession
    root = fresh_path(spark, "feeds")
    for changes in [as_changes(objects), *map(batch_changes, feeds)]:
        apply_feed(spark, root, changes)
    return read_state(spark, root)
