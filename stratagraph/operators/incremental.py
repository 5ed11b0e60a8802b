"""Problem 1: each run of a consumer takes only what is new or changed since its last successful run.

A consumer's ledger holds the (key, version) pairs that successful runs have taken. A run rereads from the oldest
transaction that was still open when the consumer last ran, and an anti-join with the ledger removes the overlap.
Nothing is skipped (late versions lie at or after that transaction) and nothing is repeated (the ledger has it).

One late version would make its whole store be read again, so the oldest open transaction is kept for each BUCKET of
transactions; buckets that are closed are not read at all. Runs meet transactions, not versions: what a run took of a
transaction follows from the moment it began.

Defined results: null keys are no version; a version whose arrival is unknown counts as not taken; a run without an
end, without a readable cursor, or whose latest status isn't `ok` takes nothing; a tie between statuses at one moment
goes against `ok`, so a record may come twice rather than never; repeated rows count once; empty tables give no rows,
or every version if no run exists; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict
from ..functions.records import intact_rows, leading_number
from ..runtime import HadoopFiles, if_small, is_small, materialize

#: The consumers of a store. A fixed value of the data.
CONSUMERS = ("mirror", "fts", "deltalog")
#: Transactions that share an open point, and that a run meets at once.
BUCKET = 16
#: Buckets of one run made at once, so that a run over many transactions makes no array without end.
SPAN = 4096
#: Parts into which the versions of a hot transaction are split.
SALTS = 64
#: Versions of a transaction beyond which it is joined by salted keys.
HOT = 1_000_000
#: Parts of a ledger beyond which a run compacts it.
MAX_PARTS = 16


def record_versions(objects: DataFrame) -> DataFrame:
    """(store_id, oid, tid, available): every version once, from its earliest intact arrival."""
    return intact_rows(objects).groupBy("store_id", "oid", "tid").agg(F.min("arrived_at").alias("available"))


def successful_runs(consumer_runs: DataFrame, meta: DataFrame) -> DataFrame:
    """(run_id, store_id, consumer, from_tid, cursor, started_at) of runs whose latest logged status is ok."""
    logged = consumer_runs.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.max(F.struct("logged_at", (~F.col("status").eqNullSafe("ok")).alias("bad"))).alias("last"),
        F.max("store_id").alias("store_id"),
        F.max("consumer").alias("consumer"),
        F.max("from_tid").alias("from_tid"),
        F.min("started_at").alias("started_at"),
    )
    cursors = (
        meta.where(F.col("run_id").isNotNull() & F.col("key").startswith("cursor."))
        .groupBy("run_id")
        .agg(F.max(leading_number(F.col("value"))).alias("cursor"))
    )
    return (
        logged.where(~F.col("last.bad"))
        .join(cursors, "run_id")
        .where(F.col("cursor") > F.col("from_tid"))
        .select("run_id", "store_id", "consumer", "from_tid", "cursor", "started_at")
    )


def _bucket(tid: Column) -> Column:
    return F.floor(tid / BUCKET).cast("bigint")


def run_buckets(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each run once per bucket of transactions that it touches, cut to the transactions its store has.

    bounds (store_id, low, high) keeps a cursor far beyond the data from making buckets without end.
    """
    cut = runs.join(bounds, "store_id").select(
        "consumer", "store_id", "started_at",
        F.greatest("from_tid", F.col("low") - 1).alias("from_tid"),
        F.least("cursor", "high").alias("to_tid"),
    ).where(F.col("to_tid") > F.col("from_tid"))
    cut = cut.withColumns({"first": _bucket(F.col("from_tid") + 1), "last": _bucket(F.col("to_tid"))})
    spans = cut.withColumn("span", F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor(F.col("last") / SPAN))))
    within = F.sequence(F.greatest("first", F.col("span") * SPAN), F.least("last", F.col("span") * SPAN + SPAN - 1))
    return spans.withColumn("bucket", F.explode(within)).drop("span", "first", "last")


def taken_transactions(moments: DataFrame, buckets: DataFrame) -> DataFrame:
    """(store_id, tid, consumer, taken_at): when the last successful run that covers a transaction began."""
    b = buckets.select(*[F.col(c).alias(f"r_{c}") for c in ("consumer", "store_id", "started_at", "from_tid", "to_tid", "bucket")])
    on = (F.col("store_id") == F.col("r_store_id")) & (_bucket(F.col("tid")) == F.col("r_bucket")) & (F.col("tid") > F.col("r_from_tid")) & (F.col("tid") <= F.col("r_to_tid"))
    return moments.join(b, on).groupBy("store_id", "tid", F.col("r_consumer").alias("consumer")).agg(F.max("r_started_at").alias("taken_at"))


def reread_transactions(versions: DataFrame, buckets: DataFrame, consumers: tuple[str, ...] = CONSUMERS) -> DataFrame:
    """(store_id, tid, consumer, taken_at, n) of the transactions at or after the oldest open one of their bucket; n is how many versions each holds.

    A transaction is open for a consumer if no successful run covered it, or if a version of it came after every run that did.
    """
    moments = versions.groupBy("store_id", "tid").agg(F.max("available").alias("closed_at"), F.max(F.col("available").isNull()).alias("unknown"), F.count("*").alias("n"))
    moments = materialize(moments, "transactions")
    taken = taken_transactions(moments.select("store_id", "tid"), buckets).groupBy("store_id", "tid").agg(F.map_from_entries(F.collect_list(F.struct("consumer", "taken_at"))).alias("taken"))
    each = moments.join(taken, ["store_id", "tid"], "left").withColumn("consumer", F.explode(F.array(*[F.lit(c) for c in consumers])))
    each = each.withColumn("taken_at", F.element_at("taken", F.col("consumer")))
    is_open = F.col("taken_at").isNull() | F.col("unknown") | (F.col("closed_at") > F.col("taken_at"))
    # the transactions of a bucket are few: their list is filtered from the oldest open one on
    listed = each.groupBy("store_id", _bucket(F.col("tid")).alias("bucket"), "consumer").agg(
        F.min(F.when(is_open, F.col("tid"))).alias("reread_tid"), F.collect_list(F.struct("tid", "taken_at", "n")).alias("t")
    )
    kept = listed.where("reread_tid is not null").select("store_id", "consumer", F.inline(F.filter("t", lambda t: t["tid"] >= F.col("reread_tid"))))
    return kept.select("store_id", "tid", "consumer", "taken_at", "n")


def reread(versions: DataFrame, transactions: DataFrame) -> DataFrame:
    """The versions (store_id, oid, tid, available) of some transactions, once for each consumer.

    A transaction may hold any number of versions: those of more than HOT are joined apart, by salted keys.
    """
    if is_small(transactions):
        return versions.join(F.broadcast(transactions), ["store_id", "tid"])
    hot = transactions.where(F.col("n") > HOT)
    if not hot.limit(1).count():
        return versions.join(transactions, ["store_id", "tid"])
    keys = hot.select("store_id", "tid").distinct()
    cold = versions.join(if_small(keys), ["store_id", "tid"], "left_anti").join(transactions.where(F.col("n") <= HOT), ["store_id", "tid"])
    salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("oid"), F.lit(SALTS)).cast("int")
    return cold.unionByName(versions.withColumn("salt", salt).join(if_small(salted), ["store_id", "tid", "salt"]).drop("salt"))


def outside_ledger(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose (key, version) pair no successful run took: the operator's core."""
    taken = ledger.select(*[F.col(k).alias(f"_taken_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_taken_{k}")) for k in keys]
    return rows.join(taken, reduce(lambda a, b: a & b, same), "left_anti")


def untaken(objects: DataFrame, consumer_runs: DataFrame, meta: DataFrame) -> DataFrame:
    """(consumer, store_id, oid, tid): for each consumer the versions that no successful run of it took."""
    versions = materialize(record_versions(objects), "versions")
    bounds = versions.groupBy("store_id").agg(F.min("tid").alias("low"), F.max("tid").alias("high"))
    again = materialize(reread_transactions(versions, run_buckets(successful_runs(consumer_runs, meta), bounds)), "open")
    rows = materialize(reread(versions, again).select("consumer", "store_id", "oid", "tid", "available", "taken_at"), "reread")
    ledger = rows.where(F.col("available") <= F.col("taken_at"))
    keys = ["consumer", "store_id", "oid", "tid"]
    return outside_ledger(rows.select(*keys), ledger, keys)


class IncrementalReader:
    """A consumer of a growing table whose ledger lives in a folder.

    A run first fixes its batch and writes runs/<n>.plan, then hands the batch to process(batch, n), then writes
    runs/<n>.json; each file is created once and never replaced, so of two runs at once the second is refused. A run
    that ended in between left its plan: the next run hands the same batch over again under the same number, so a
    consumer that remembers the last number it finished takes nothing twice. Folders that no file names are deleted.

    lag says how far behind the newest version a row may still arrive: rows older than that are not read again. Without
    it every row is, and only the ledger keeps them from coming twice. Rows without a version are never taken.
    """

    def __init__(self, spark: SparkSession, state: str, keys: list[str], version: str, lag: int | None = None):
        self.spark, self.state, self.keys, self.version, self.lag = spark, state.rstrip("/"), keys, version, lag
        self.pair = [*keys, version]
        self.files = HadoopFiles(spark, self.state)
        self.files.mkdirs(f"{self.state}/runs")

    def _records(self, kind: str) -> list[dict]:
        names = [p for p in self.files.list(f"{self.state}/runs") if p.endswith(f".{kind}")]
        return sorted((json.loads(self.files.read(p)) for p in names), key=lambda r: r["run"])

    def _create(self, number: int, kind: str, facts: dict) -> None:
        try:
            self.files.write(f"{self.state}/runs/{number:09d}.{kind}", json.dumps(facts), overwrite=False)
        except Exception as e:
            raise Conflict(f"another run {number} of {self.state} was first") from e

    @staticmethod
    def _parts(records: list[dict]) -> list[str]:
        """The parts of the ledger since the last compaction, which holds all before."""
        parts: list[str] = []
        for r in records:
            parts = [r["part"]] if r["whole"] else [*parts, r["part"]]
        return parts

    def _ledger(self, records: list[dict]) -> DataFrame | None:
        parts = self._parts(records)
        return self.spark.read.parquet(*parts).select(*self.pair) if parts else None

    def pending(self, source: DataFrame) -> DataFrame:
        """Rows of source not yet taken; of rows with one key and version one comes."""
        records = self._records("json")
        rows = source.where(F.col(self.version).isNotNull())
        if records and records[-1]["open_from"] is not None:
            rows = rows.where(F.col(self.version) >= records[-1]["open_from"])
        rows, ledger = rows.dropDuplicates(self.pair), self._ledger(records)
        return rows if ledger is None else outside_ledger(rows, ledger, self.pair)

    def _folder(self, number: int) -> str:
        return f"{self.state}/data/{number:09d}-{uuid.uuid4().hex}"

    def _sweep(self, records: list[dict]) -> None:
        """Deletes what runs before the last left behind: batches, compacted parts, and folders that no record names. A run beside this one may still read the last batch."""
        named = {part.rsplit("/", 1)[-1] for part in self._parts(records)}
        for folder in self.files.list(f"{self.state}/data"):
            name = folder.rsplit("/", 1)[-1]
            if name not in named and int(name.split("-")[0]) < len(records):
                self.files.delete(folder)

    def _plan(self, source: DataFrame, records: list[dict]) -> dict:
        batch = self._folder(len(records) + 1)
        # the batch is fixed before it is processed: a source that grows meanwhile can't put a pair in the ledger unprocessed
        self.pending(source).write.parquet(batch)
        newest = self.spark.read.parquet(batch).agg(F.max(self.version)).first()[0]
        was = records[-1]["open_from"] if records else None
        point = was if self.lag is None or newest is None else max(newest - self.lag, was if was is not None else newest - self.lag)
        plan = {"run": len(records) + 1, "batch": batch, "open_from": point}
        self._create(plan["run"], "plan", plan)
        return plan

    def run(self, source: DataFrame, process: Callable[[DataFrame, int], None]) -> int:
        """Hands what is pending to process(batch, number) and gives the number; the run counts once its record is written."""
        records = self._records("json")
        plans = {r["run"]: r for r in self._records("plan")}
        plan = plans.get(len(records) + 1)
        if plan is None:
            self._sweep(records)
            plan = self._plan(source, records)
        batch = self.spark.read.parquet(plan["batch"])
        process(batch, plan["run"])
        taken, whole = batch.select(*self.pair), False
        if len(records) % MAX_PARTS == MAX_PARTS - 1 and (before := self._ledger(records)) is not None:
            # pairs before the open point are never read again
            taken, whole = before.unionByName(taken), True
            taken = taken if plan["open_from"] is None else taken.where(F.col(self.version) >= plan["open_from"])
        part = self._folder(plan["run"])
        taken.write.parquet(part)
        self._create(plan["run"], "json", {"run": plan["run"], "part": part, "open_from": plan["open_from"], "whole": whole})
        return plan["run"]
