"""The change stream: deltas, consumers that apply them in order, a retained log, and a streaming source over it."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import ConfigDrift, DeltaFormat, DeltaGap
from ..runtime import HadoopFiles

VERSION = 2
OPS = "op string, oid bigint, type string, cid int, payload string, prior string"
LOG = f"tid bigint, actor bigint, at bigint, {OPS}"


@dataclass
class Delta:
    """The changes of one transaction. ops is a DataFrame of OPS: upserts before tombstones."""

    tid: int
    ops: DataFrame
    actor: int = 0
    at: int = 0
    types: list[dict] = field(default_factory=list)
    root: int | None = None
    version: int = VERSION


class Consumer(Protocol):
    watermark: int

    def apply(self, delta: Delta) -> bool: ...


def in_turn(watermark: int, tid: int, version: int = VERSION) -> bool:
    """False for a transaction already applied; an error for a gap or another version."""
    if version != VERSION:
        raise DeltaFormat(f"version {version} is not {VERSION}")
    if tid > watermark + 1:
        raise DeltaGap(f"after {watermark} comes {watermark + 1}, not {tid}")
    return tid > watermark


def refuse_unsound(ops: DataFrame) -> None:
    """An error for an unknown kind of change, an upsert without payload, a delete without prior, or two changes of one record in one transaction."""
    wrong = F.coalesce(~F.col("op").isin("upsert", "delete"), F.lit(True)) | (F.col("op") == "delete") & F.col("prior").isNull() | (F.col("op") == "upsert") & F.col("payload").isNull()
    by = ["oid", *[c for c in ops.columns if c == "tid"]]
    if bad := ops.groupBy(*by).agg(F.max(wrong).alias("wrong"), F.count("*").alias("n")).where("wrong or n > 1").take(1):
        raise DeltaFormat(f"refused: {bad[0]}")


def refuse_other_priors(ops: DataFrame, state: DataFrame) -> None:
    """An error if the prior of a change isn't what state (oid, payload) has: the consumer missed something."""
    now = state.select(F.col("oid").alias("_oid"), F.col("payload").alias("_now"))
    if bad := ops.join(now, F.col("oid") == F.col("_oid"), "left").where("not (prior <=> _now)").select("oid").take(1):
        raise DeltaGap(f"the state before the change of {bad[0][0]} is not the one it was made on")


def due(watermark: int, delta: Delta) -> bool:
    """As in_turn, for a delta; its changes are checked too."""
    if not in_turn(watermark, delta.tid, delta.version):
        return False
    refuse_unsound(delta.ops)
    return True


class Mirror:
    """A columnar copy: tables of changes and a watermark that moves in the same rename.

    flush_every: so many deltas are written together (flush writes what waits); max_parts: so many tables are compacted
    into one; verify: the prior of each change is held against the copy. What an apply that crashed left behind is
    deleted when the mirror is opened, and deltas that were waiting must be applied again.
    """

    def __init__(self, spark: SparkSession, path: str, only: list[str] | None = None, max_parts: int = 64, verify: bool = False, flush_every: int = 1):
        self.spark, self.path, self.only, self.max_parts, self.verify, self.flush_every = spark, path.rstrip("/"), only, max_parts, verify, flush_every
        self.waiting: list[Delta] = []
        self.files = HadoopFiles(spark, self.path)
        self.files.mkdirs(self.path)
        name = f"{self.path}/mirror.json"
        self.state = json.loads(self.files.read(name)) if self.files.exists(name) else {"watermark": 0, "parts": [], "only": only}
        if self.state["only"] != only:
            raise ConfigDrift(f"{self.path} mirrors {self.state['only']}, not {only}")
        sweep(self.files, self.path, self.state["parts"])

    @property
    def watermark(self) -> int:
        """The last transaction taken; durable is the last one written."""
        return self.waiting[-1].tid if self.waiting else self.durable

    @property
    def durable(self) -> int:
        return self.state["watermark"]

    def _publish(self, watermark: int, parts: list[str]) -> None:
        state = {"watermark": watermark, "parts": parts, "only": self.only}
        self.files.swap(f"{self.path}/mirror.json", json.dumps(state))
        self.state = state

    def apply(self, delta: Delta) -> bool:
        if not due(self.watermark, delta):
            return False
        self.waiting.append(delta)
        if len(self.waiting) >= self.flush_every:
            self.flush()
        return True

    def flush(self) -> None:
        if self.waiting:
            ops = [d.ops.withColumn("tid", F.lit(d.tid).cast("bigint")) for d in self.waiting]
            self._add(reduce(DataFrame.unionByName, ops), self.waiting[-1].tid)
            self.waiting = []

    def apply_range(self, changes: DataFrame, first: int, last: int) -> int:
        """Transactions first to last, without a gap, in one job; changes as DeltaLog.changes gives them."""
        self.flush()
        if last <= self.watermark or not in_turn(self.watermark, max(first, self.watermark + 1)):
            return 0
        changes = changes.where((F.col("tid") > self.watermark) & (F.col("tid") <= last))
        refuse_unsound(changes.select("tid", "oid", "op", "payload", "prior"))
        done = last - self.watermark
        self._add(changes, last)
        return done

    def _add(self, changes: DataFrame, upto: int) -> None:
        ops = changes if self.only is None else changes.where(F.col("type").isin(self.only))
        if self.verify:
            first = ops.groupBy("oid").agg(F.min_by("prior", "tid").alias("prior"))
            refuse_other_priors(first, self._newest())
        part = f"{upto:012d}-{uuid.uuid4().hex}"
        ops.select("tid", "type", "oid", "payload").write.parquet(f"{self.path}/{part}")
        self._publish(upto, [*self.state["parts"], part])
        if len(self.state["parts"]) > self.max_parts:
            self.compact()

    def _newest(self) -> DataFrame:
        ddl = "tid bigint, type string, oid bigint, payload string"
        parts = [f"{self.path}/{p}" for p in self.state["parts"]]
        rows = self.spark.read.schema(ddl).parquet(*parts) if parts else self.spark.createDataFrame([], ddl)
        return rows.groupBy("type", "oid").agg(F.max_by("payload", "tid").alias("payload")).where("payload is not null")

    def bootstrap(self, rows: DataFrame, tid: int) -> None:
        """Starts from a whole state (type, oid, payload); the watermark is set last."""
        part = f"{tid:012d}-{uuid.uuid4().hex}"
        rows.select(F.lit(tid).cast("bigint").alias("tid"), "type", "oid", "payload").write.parquet(f"{self.path}/{part}")
        self._publish(tid, [part])

    def table(self, typename: str, schema: str | None = None) -> DataFrame:
        """What is written of the live records of a type, their payload parsed if a schema is given."""
        now = self._newest().where(F.col("type") == typename).select("oid", "payload")
        return now if schema is None else now.select("oid", F.inline(F.array(F.from_json("payload", schema))))

    def inferred(self, typename: str) -> DataFrame:
        """The type's table with columns as its values ask: booleans, integers, floats widen, lists element by element, anything else is a variant."""
        rows = self.table(typename)
        kind = rows.agg(F.schema_of_variant_agg(F.try_parse_json("payload"))).first()[0]
        if not kind.startswith("OBJECT<"):
            return rows.select("oid")
        ddl = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", kind.replace("OBJECT<", "STRUCT<")).replace("VOID", "STRING")
        return rows.select("oid", F.inline(F.array(F.from_json("payload", ddl))))

    def compact(self) -> None:
        """One table of the live records, tombstones dropped."""
        ddl = "tid bigint, type string, oid bigint, payload string"
        old = self.state["parts"]
        if not old:
            return
        rows = self.spark.read.schema(ddl).parquet(*[f"{self.path}/{p}" for p in old])
        now = rows.groupBy("type", "oid").agg(F.max(F.struct("tid", "payload")).alias("r")).where("r.payload is not null")
        part = f"{self.durable:012d}-{uuid.uuid4().hex}"
        now.select("r.tid", "type", "oid", "r.payload").write.parquet(f"{self.path}/{part}")
        self._publish(self.durable, [part])
        for p in old:
            self.files.delete(f"{self.path}/{p}")


def sweep(files: HadoopFiles, path: str, named: list[str]) -> None:
    """Deletes the tables under path that no state names."""
    for folder in files.list(path):
        name = folder.rsplit("/", 1)[-1]
        if name not in named and re.fullmatch(r"\d{12}-[0-9a-f]{32}", name):
            files.delete(folder)


class CountingConsumer:
    """Live records per type, kept from the deltas alone."""

    def __init__(self):
        self.watermark, self.counts = 0, {}

    def apply(self, delta: Delta) -> bool:
        if not due(self.watermark, delta):
            return False
        self._count(delta.ops)
        self.watermark = delta.tid
        return True

    def apply_range(self, changes: DataFrame, first: int, last: int) -> int:
        if last <= self.watermark or not in_turn(self.watermark, max(first, self.watermark + 1)):
            return 0
        changes, done = changes.where((F.col("tid") > self.watermark) & (F.col("tid") <= last)), last - self.watermark
        refuse_unsound(changes.select("tid", "oid", "op", "payload", "prior"))
        self._count(changes)
        self.watermark = last
        return done

    def _count(self, ops: DataFrame) -> None:
        step = F.when((F.col("op") == "upsert") & F.col("prior").isNull(), 1).when(F.col("op") == "delete", -1).otherwise(0)
        for r in ops.groupBy("type").agg(F.sum(step).alias("n")).collect():
            self.counts[r["type"]] = self.counts.get(r["type"], 0) + r["n"]


class DeltaLog:
    """An append-only table of every delta, read back in order from any transaction on. What a crashed apply left is deleted on opening.

    genesis is the transaction the log begins after; with a snapshot (type, oid, payload) and its types, as bootstrap
    takes them, a replay from genesis starts from that state.
    """

    def __init__(self, spark: SparkSession, path: str, genesis: int = 0, read_only: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = HadoopFiles(spark, self.path)
        self.files.mkdirs(self.path)
        name = f"{self.path}/log.json"
        self.state = json.loads(self.files.read(name)) if self.files.exists(name) else {"genesis": genesis, "watermark": genesis, "parts": [], "snapshot": None, "types": []}
        if not read_only:
            sweep(self.files, self.path, [h["path"] for h in self.state["parts"]] + [self.state["snapshot"]])

    @property
    def watermark(self) -> int:
        return self.state["watermark"]

    def _publish(self, state: dict) -> None:
        self.files.swap(f"{self.path}/log.json", json.dumps(state))
        self.state = state

    def bootstrap(self, rows: DataFrame, tid: int, types: list[dict]) -> None:
        """Begins the log after tid, from a whole state (type, oid, payload) and the shapes it was written in."""
        if self.state["parts"]:
            raise DeltaGap(f"{self.path} has deltas already")
        part = f"{tid:012d}-{uuid.uuid4().hex}"
        rows.select("type", "oid", "payload").write.parquet(f"{self.path}/{part}")
        self._publish({"genesis": tid, "watermark": tid, "parts": [], "snapshot": part, "types": types})

    def genesis(self) -> tuple[DataFrame, int, list[dict]]:
        """The state that the log begins from, its transaction and its shapes."""
        ddl, part = "type string, oid bigint, payload string", self.state["snapshot"]
        rows = self.spark.read.schema(ddl).parquet(f"{self.path}/{part}") if part else self.spark.createDataFrame([], ddl)
        return rows, self.state["genesis"], self.state["types"]

    def apply(self, delta: Delta) -> bool:
        if not in_turn(self.watermark, delta.tid, delta.version):
            return False
        part = f"{delta.tid:012d}-{uuid.uuid4().hex}"
        rows = delta.ops.select(F.lit(delta.tid).cast("bigint").alias("tid"), F.lit(delta.actor).cast("bigint").alias("actor"), F.lit(delta.at).cast("bigint").alias("at"), "op", "oid", "type", "cid", "payload", "prior")
        rows.sortWithinPartitions(F.desc("op"), "oid").write.parquet(f"{self.path}/{part}")
        try:
            refuse_unsound(self.spark.read.schema(LOG).parquet(f"{self.path}/{part}").select("oid", "op", "payload", "prior"))
        except DeltaFormat:
            self.files.delete(f"{self.path}/{part}")
            raise
        head = {"tid": delta.tid, "path": part, "actor": delta.actor, "at": delta.at, "root": delta.root, "types": delta.types}
        self._publish(self.state | {"watermark": delta.tid, "parts": [*self.state["parts"], head]})
        return True

    def replay(self, after: int = 0) -> Iterator[Delta]:
        if after < self.state["genesis"]:
            raise DeltaGap(f"the log begins after {self.state['genesis']}")
        for h in self.state["parts"]:
            if h["tid"] > after:
                ops = self.spark.read.schema(LOG).parquet(f"{self.path}/{h['path']}").drop("tid", "actor", "at")
                yield Delta(h["tid"], ops, h["actor"], h["at"], h["types"], h["root"])

    def changes(self, after: int = 0) -> DataFrame:
        """Every change after a transaction as one table."""
        paths = [f"{self.path}/{h['path']}" for h in self.state["parts"] if h["tid"] > after]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def state_digest(self) -> str:
        """A hash of the replayed state that doesn't depend on the order in which it is read."""
        start = self.genesis()[0].select("oid", F.lit(self.state["genesis"]).cast("bigint").alias("tid"), "type", "payload")
        every = start.unionByName(self.changes(self.state["genesis"]).select("oid", "tid", "type", "payload"))
        now = every.groupBy("oid").agg(F.max_by(F.struct("type", "payload"), "tid").alias("r")).where("r.payload is not null")
        row = F.sha2(F.concat_ws("\x1f", F.col("oid").cast("string"), "r.type", "r.payload"), 256)
        half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
        r = now.agg(F.count("*").alias("n"), *[half(1 + 15 * i).alias(f"h{i}") for i in range(4)]).first()
        return f"{self.watermark}:" + ":".join(str(x or 0) for x in r)


def catch_up(consumer: Consumer, log: DeltaLog) -> int:
    """Applies what the consumer lacks; gives the number of deltas applied. A consumer that takes ranges gets all of it at once."""
    if consumer.watermark < log.state["genesis"] and log.state["snapshot"] and hasattr(consumer, "bootstrap"):
        rows, tid, _ = log.genesis()
        consumer.bootstrap(rows, tid)
    if consumer.watermark < log.state["genesis"]:
        raise DeltaGap(f"the log begins after {log.state['genesis']}")
    if hasattr(consumer, "apply_range"):
        return consumer.apply_range(log.changes(consumer.watermark), consumer.watermark + 1, log.watermark) if log.watermark > consumer.watermark else 0
    return sum(consumer.apply(d) for d in log.replay(consumer.watermark))


def check_consumer(make: Callable[[], Any], deltas: list[Delta], content: Callable[[Any], Any]) -> None:
    """Fails with AssertionError unless consumers keep the rules of the stream. deltas: at least two, from 1 on."""
    whole = make()
    assert [whole.apply(d) for d in deltas] == [True] * len(deltas), "a delta in turn was not applied"
    assert whole.watermark == deltas[-1].tid, "the watermark is not the last transaction"
    once = content(whole)
    assert whole.apply(deltas[0]) is False and content(whole) == once, "a repeated delta changed something"
    for bad, error in (
        (replace(deltas[-1], tid=deltas[-1].tid + 2), DeltaGap),
        (replace(deltas[-1], tid=deltas[-1].tid + 1, version=VERSION + 1), DeltaFormat),
        (replace(deltas[-1], tid=deltas[-1].tid + 1, ops=deltas[-1].ops.withColumn("op", F.lit("?"))), DeltaFormat),
        (replace(deltas[-1], tid=deltas[-1].tid + 1, ops=deltas[-1].ops.withColumns({"op": F.lit("delete"), "prior": F.lit(None).cast("string")})), DeltaFormat),
    ):
        try:
            whole.apply(bad)
        except error:
            pass
        else:
            raise AssertionError(f"no {error.__name__}")
        assert content(whole) == once and whole.watermark == deltas[-1].tid, "a refused delta changed something"
    again = make()
    for d in deltas:
        again.apply(replace(d, actor=d.actor + 1, at=d.at + 1))
    assert content(again) == once, "the content depends on actor or time"
    # a record must leave by its prior alone: what the last delta wrote, deleted again, ends as if it had been deleted instead
    ops = deltas[-1].ops.where("op = 'upsert'")
    undone = replace(deltas[-1], tid=deltas[-1].tid + 1, ops=ops.withColumns({"op": F.lit("delete"), "prior": F.col("payload"), "payload": F.lit(None).cast("string")}))
    without = make()
    for d in deltas[:-1]:
        without.apply(d)
    without.apply(replace(deltas[-1], ops=deltas[-1].ops.where("op = 'delete' or prior is not null").withColumns({"op": F.lit("delete"), "payload": F.lit(None).cast("string")})))
    without.apply(replace(undone, ops=undone.ops.limit(0)))
    assert whole.apply(undone) is True and content(whole) == content(without), "a delete left something of its record behind"


class ChangeReader(DataSourceStreamReader):
    """Deltas in the order of their transactions; the offset is the transaction, a gap is an error."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").rstrip("/")
        self.after = int(options.get("after", 0))

    def _log(self) -> dict:
        with open(f"{self.path}/log.json") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"tid": self.after}

    def latestOffset(self) -> dict:
        return {"tid": self._log()["watermark"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = [p for p in self._log()["parts"] if start["tid"] < p["tid"] <= end["tid"]]
        if [p["tid"] for p in parts] != list(range(start["tid"] + 1, end["tid"] + 1)):
            raise DeltaGap(f"the log lacks a transaction between {start['tid']} and {end['tid']}")
        return [InputPartition(p["path"]) for p in parts]

    def read(self, partition: InputPartition):
        import pyarrow.dataset as ds

        yield from ds.dataset(f"{self.path}/{partition.value}", format="parquet").to_batches()

    def commit(self, end: dict) -> None:
        pass


class ChangeBatch(DataSourceReader):
    """Every change after a transaction, one task per delta."""

    def __init__(self, options: dict):
        self.stream = ChangeReader(options)

    def partitions(self) -> list[InputPartition]:
        return self.stream.partitions(self.stream.initialOffset(), self.stream.latestOffset())

    def read(self, partition: InputPartition):
        yield from self.stream.read(partition)


class ChangeSource(DataSource):
    """As a table, spark.read.format("changes"), or a stream: spark.dataSource.register(ChangeSource); spark.readStream.format("changes").option("path", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> ChangeBatch:
        return ChangeBatch(self.options)

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)
