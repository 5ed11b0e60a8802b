import pytest
from pyspark.sql import functions as F

from stratagraph.errors import Conflict, CorruptRecord, DanglingRef, DeltaGap, FrozenEntity, NewerStore, NotAnEntity, QueryError, SchemaMismatch, StoreLocked, UniqueViolation, UnseenType
from stratagraph.schema import OID, EntityType, Field, fields, json_schema, unify
from stratagraph.sources.blobs import BlobTable, from_path
from stratagraph.sources.store import FIRST_OID, Store, committing
from stratagraph.streaming.federation import Follower, head, submit
from stratagraph.streaming.changes import ChangeSource, CountingConsumer, DeltaLog, Mirror, catch_up, check_consumer

THING = EntityType("Thing", {"k": Field("string", unique=True), "v": Field("int", sorted=True), "to": Field("bigint", ref="Thing")})


def rows(spark, data, ddl="k string, v int"):
    return spark.createDataFrame(data, ddl)


def state(store, tid=None):
    return {r["k"]: r["v"] for r in store.snapshot(tid).all(THING).rows.collect()}


@pytest.fixture()
def store(spark, folder):
    s = Store.open(spark, folder)
    s.insert(THING, rows(spark, [("a", 1), ("b", 2), ("c", 3)]))
    assert s.commit() == 1
    return s


def test_history(spark, store):
    oids = sorted(r[OID] for r in store.extent(THING).rows.collect())
    assert oids == [FIRST_OID, FIRST_OID + 1, FIRST_OID + 2]
    assert store.commit() is None and store.tid == 1
    store.upsert(THING, rows(spark, [("a", 1), ("b", 20), ("d", 4), ("d", 5)]))
    assert store.commit() == 2
    ops = {(r["op"], r["prior"] is None) for r in store.delta(2, [THING]).ops.collect()}
    assert ops == {("upsert", True), ("upsert", False)} and store.delta(2, [THING]).ops.count() == 2  # a was not written
    store.delete(THING, store.extent(THING).where(fields(THING).k == "c"))
    store.delete(THING, rows(spark, [(99,)], f"{OID} bigint"))
    assert store.commit() == 3
    assert state(store) == {"a": 1, "b": 20, "d": 5}
    assert state(store, 1) == {"a": 1, "b": 2, "c": 3} and state(store, 2)["c"] == 3
    store.compact(THING)
    assert state(store) == {"a": 1, "b": 20, "d": 5} and len(store.parquet_paths(THING)) == 1


def test_refusals(spark, store):
    for bad in ([("a", 9)], [("x", 1), ("x", 2)]):
        store.insert(THING, rows(spark, bad))
        with pytest.raises(UniqueViolation):
            store.commit()
        store.discard()
    store.insert(THING, rows(spark, [(None, 1), (None, 2)]))
    assert store.commit() == 2  # null is exempt
    with pytest.raises(QueryError):
        store.upsert(THING, rows(spark, [(None, 1)]))
    # a key freed in a commit can be taken in the same commit
    store.delete(THING, store.extent(THING).where(fields(THING).k == "a"))
    store.insert(THING, rows(spark, [("a", 50)]))
    store.commit()
    assert state(store)["a"] == 50
    with pytest.raises(Conflict):
        store.insert(THING, rows(spark, [("z", 1)])), store.commit(expected=0)
    with pytest.raises(NotAnEntity):
        store.insert("Thing", rows(spark, [("q", 1)]))
    frozen = EntityType("Log", {"k": Field("string", unique=True)}, frozen=True)
    with pytest.raises(FrozenEntity):
        store.update(frozen, rows(spark, [], "k string"))
    with pytest.raises(StoreLocked):
        Store.open(spark, store.path)
    with pytest.warns(UnseenType):
        assert store.extent(frozen).count() == 0


def test_crash_leaves_the_committed_prefix(spark, store):
    """Segments without manifest are never read and are swept away by the next writer."""
    rows(spark, [("lost", 1)]).write.parquet(f"{store.path}/data/Thing-000000000002-dead")
    store.close()
    again = Store.open(spark, store.path)
    assert state(again) == {"a": 1, "b": 2, "c": 3}
    assert not again.files.exists(f"{again.path}/data/Thing-000000000002-dead")
    again.files.swap(f"{again.path}/manifest.json", '{"format": 99}')
    with pytest.raises(NewerStore):
        Store.open(spark, again.path, read_only=True)


def test_strict_deletes(spark, folder):
    s = Store.open(spark, folder, strict_deletes=True)
    s.insert(THING, rows(spark, [("a", 1, None), ("b", 2, FIRST_OID)], "k string, v int, to bigint").coalesce(1))
    s.commit()
    s.delete(THING, rows(spark, [(FIRST_OID,)], f"{OID} bigint"))
    with pytest.raises(DanglingRef):
        s.commit()
    s.delete(THING, rows(spark, [(FIRST_OID + 1,)], f"{OID} bigint"))
    assert s.commit() == 2  # the referrer goes with it


def test_shapes(spark, folder):
    s = Store.open(spark, folder)
    s.insert(EntityType("R", {"k": Field("string"), "n": Field("int")}), rows(spark, [("a", 7)], "k string, n int"))
    s.commit()
    live = EntityType("R", {"name": Field("string", renamed_from="k"), "n": Field("double"), "extra": Field("string", default="d"), "twice": Field("int", glue=lambda old: old["n"] * 2)})
    assert s.extent(live).rows.select("name", "n", "extra", "twice").first() == ("a", 7.0, "d", 14)
    s.migrate(live)
    assert s.extent(live).rows.select("name", "n", "extra", "twice").first() == ("a", 7.0, "d", 14)
    with pytest.raises(SchemaMismatch):
        s.extent(EntityType("R", {"other": Field("string", required=True)}))
    for bad in ({"x": Field("array<string>", unique=True)}, {"x": Field("int", fulltext="en")}, {"__oid__": Field("int")}, {"x": Field("string", blob=True)}):
        with pytest.raises(SchemaMismatch):
            EntityType("Bad", bad)
    assert unify("int", "double") == "double" and unify("array<boolean>", "array<int>") == "array<bigint>" and unify("string", "int") == "variant" and unify("void", "date") == "date"
    assert json_schema(live)["properties"]["n"] == {"type": "number"}


def _deltas(spark, store):
    store.upsert(THING, rows(spark, [("b", 20), ("d", 4)]))
    store.commit()
    store.delete(THING, store.extent(THING).where(fields(THING).k == "a"))
    store.commit()
    return [store.delta(t, [THING]) for t in (1, 2, 3)]


def test_consumers(spark, store, tmp_path):
    deltas = _deltas(spark, store)
    n = iter(range(100))
    check_consumer(CountingConsumer, deltas, lambda c: dict(c.counts))
    check_consumer(lambda: Mirror(spark, f"file://{tmp_path}/m{next(n)}"), deltas, lambda m: sorted(tuple(r) for r in m.table("Thing").collect()))
    check_consumer(lambda: DeltaLog(spark, f"file://{tmp_path}/l{next(n)}"), deltas, lambda x: x.state_digest())

    class Careless(CountingConsumer):
        def apply(self, delta):
            self.watermark = delta.tid
            self.counts["n"] = self.counts.get("n", 0) + 1
            return True

    with pytest.raises(AssertionError):
        check_consumer(Careless, deltas, lambda c: dict(c.counts))


def test_incremental_equals_bootstrap(spark, store, tmp_path):
    deltas = _deltas(spark, store)
    log = DeltaLog(spark, f"file://{tmp_path}/log")
    for d in deltas:
        assert log.apply(d)
    mirror = Mirror(spark, f"file://{tmp_path}/mirror")
    assert catch_up(mirror, log) == 3 and catch_up(mirror, log) == 0
    fresh = Mirror(spark, f"file://{tmp_path}/fresh")
    now = store.extent(THING).rows
    fresh.bootstrap(now.select(F.lit("Thing").alias("type"), F.col(OID).alias("oid"), F.to_json(F.struct("k", "v", "to"), {"ignoreNullFields": "false"}).alias("payload")), store.tid)
    table = lambda m: sorted(map(tuple, m.table("Thing", "k string, v int").collect()))
    assert table(mirror) == table(fresh)
    mirror.compact()
    assert table(mirror) == table(fresh) and Mirror(spark, f"file://{tmp_path}/mirror").watermark == 3
    with pytest.raises(DeltaGap):
        list(DeltaLog(spark, f"file://{tmp_path}/late", genesis=2).replay(0))


def test_inferred_columns(spark, tmp_path):
    m = Mirror(spark, f"file://{tmp_path}/m")
    assert m.inferred("T").columns == ["oid"]
    values = ['{"n": 1, "x": 1, "mix": 1, "l": [1], "none": null}', '{"n": 2, "x": 2.5, "mix": "a", "l": [2.5, null]}', '{"n": null, "x": null, "new": true}']
    m.bootstrap(spark.createDataFrame([("T", i, v) for i, v in enumerate(values)], "type string, oid bigint, payload string"), 1)
    t = m.inferred("T")
    assert dict(t.dtypes) == {"oid": "bigint", "n": "bigint", "x": "double", "mix": "variant", "l": "array<double>", "none": "string", "new": "boolean"}
    assert sorted((r["oid"], r["x"], r["l"], r["new"]) for r in t.select("oid", "x", "l", "new").collect()) == [(0, 1.0, [1.0], None), (1, 2.5, [2.5, None], None), (2, None, None, True)]


def test_stream(spark, store, tmp_path):
    log = DeltaLog(spark, f"file://{tmp_path}/log")
    deltas = _deltas(spark, store)
    log.apply(deltas[0]), log.apply(deltas[1])
    spark.dataSource.register(ChangeSource)
    got = []

    def run():
        q = (
            spark.readStream.format("changes").option("path", f"file://{tmp_path}/log").load()
            .writeStream.foreachBatch(lambda df, n: got.extend((r["tid"], r["op"]) for r in df.collect()))
            .option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        )
        q.awaitTermination(120)

    run()
    assert sorted({t for t, _ in got}) == [1, 2]
    log.apply(deltas[2])
    run()
    assert sorted({t for t, _ in got}) == [1, 2, 3] and len(got) == sum(d.ops.count() for d in deltas)


def test_attach_and_retry(spark, store):
    late = CountingConsumer()
    with pytest.raises(Conflict):
        store.attach(late)
    late.watermark = 1
    late.counts = {"Thing": 3}
    store.attach(late)

    def work(s):
        s.insert(THING, rows(spark, [("n", 1)]))

    assert committing(store, work) == 2 and late.counts == {"Thing": 4}
    late.apply = None
    work2 = lambda s: s.insert(THING, rows(spark, [("m", 1)]))
    with pytest.warns(RuntimeWarning):
        committing(store, work2)
    assert store.consumers == [] and store.tid == 3


def test_blobs(spark, tmp_path):
    data = bytes(range(256)) * 9000
    (tmp_path / "f").write_bytes(data)
    size, chunks = from_path(str(tmp_path / "f"))
    t = BlobTable(spark, f"file://{tmp_path}/blobs")
    d = t.write(5, size, chunks)
    stream = t.open(d)
    assert stream.read() == data and stream.seek(-5, 2) == len(data) - 5 and stream.read() == data[-5:]
    assert stream.seek(1_048_570) and stream.read(6) == data[1_048_570:1_048_576] and stream.read(9) == data[1_048_576:1_048_585] and stream.seek(9, 1) == 1_048_594
    assert t.verified(d).read(3) == data[:3]
    with pytest.raises(CorruptRecord):
        t.verified(d | {"sha256": "0"})
    empty = t.write(7, 0, lambda: [])
    assert t.verified(empty).read() == b""
    wanted = spark.createDataFrame([(5, 1_048_570, 20), (5, 0, 3)], "blob_oid bigint, pos bigint, len bigint")
    got = {r["pos"]: bytes(r["bytes"]) for r in t.ranges(wanted).collect()}
    assert got == {1_048_570: data[1_048_570:1_048_590], 0: data[:3]}
    with pytest.raises(ValueError):
        t.write(6, 1, chunks)
    made = t.write_column(spark.createDataFrame([(8, bytearray(b"xy")), (9, None)], "oid bigint, b binary"), "oid", "b").collect()
    assert made[0]["descriptor"]["size"] == 2 and made[1]["descriptor"] is None
    assert t.open(made[0]["descriptor"].asDict()).read() == b"xy"


def test_follower(spark, store, tmp_path):
    """A copy from genesis, in ranges and as a stream; writes back are refused if they were made on something older."""
    feed = f"file://{tmp_path}/feed"
    log = DeltaLog(spark, feed)
    for d in _deltas(spark, store)[:2]:
        log.apply(d)
    follower = Follower(spark, f"file://{tmp_path}/copy", feed, verify=True)
    assert head(log)["tid"] == 2 and follower.sync() == 2 and follower.sync() == 0
    log.apply(store.delta(3, [THING]))
    other = Follower(spark, f"file://{tmp_path}/streamed", feed)
    other.stream(f"file://{tmp_path}/checkpoint").awaitTermination()
    follower.sync()
    table = lambda f: sorted(map(tuple, f.table("Thing", "k string, v int").select("k", "v").collect()))
    assert table(follower) == table(other) == sorted(tuple(r)[:2] for r in store.extent(THING).rows.select("k", "v").collect())
    spark.dataSource.register(ChangeSource)
    assert spark.read.format("changes").option("path", feed).option("after", "1").load().count() == log.changes(1).count()
    now = store.extent(THING).rows.where("k = 'b'")
    oid = now.first()[OID]
    made = rows(spark, [(oid, "b", 77), (None, "new", 1)], f"{OID} bigint, k string, v int").withColumn("to", F.lit(None).cast("bigint"))
    store.attach(log)
    assert follower.contribute(store, THING, made) == 4 and ("b", 77) in table(follower) and ("new", 1) in table(follower)
    with pytest.raises(Conflict):
        submit(store, THING, made.where("k = 'b'"), 3)
    with pytest.raises(Conflict):
        submit(store, THING, made.where("k = 'b'").withColumn(OID, F.lit(12).cast("bigint")), 4)
    with pytest.raises(DanglingRef):
        submit(store, THING, made.where("k = 'new'").withColumns({"k": F.lit("x"), "to": F.lit(99).cast("bigint")}), 4)
    assert store.tid == 4 and not store._staged


def test_mirror_upkeep(spark, store, tmp_path):
    """Deltas that wait for each other, tables that are compacted, leftovers that go, and a state that isn't the one a change was made on."""
    deltas = _deltas(spark, store)
    m = Mirror(spark, f"file://{tmp_path}/m", flush_every=2)
    m.apply(deltas[0])
    assert (m.watermark, m.durable) == (1, 0) and Mirror(spark, f"file://{tmp_path}/m").watermark == 0
    m.apply(deltas[1])
    assert m.durable == 2 and len(m.state["parts"]) == 1
    (tmp_path / "m" / f"{9:012d}-{'0' * 32}").mkdir()
    n = Mirror(spark, f"file://{tmp_path}/m", max_parts=1)
    n.apply(deltas[2])
    assert len(n.state["parts"]) == 1 and sum(x.is_dir() for x in (tmp_path / "m").iterdir()) == 1
    late = Mirror(spark, f"file://{tmp_path}/late", verify=True)
    late.bootstrap(spark.createDataFrame([], "type string, oid bigint, payload string"), 1)
    with pytest.raises(DeltaGap):
        late.apply(deltas[1])


def test_lease(spark, folder, monkeypatch):
    """A second writer waits for the first, and takes over only when its lock has run out; the first can't write any more."""
    from stratagraph.sources import store as module

    first = Store(spark, folder)
    with pytest.raises(StoreLocked):
        Store(spark, folder)
    monkeypatch.setattr(module, "LEASE", 0.0)
    first._closed.set()
    second = Store(spark, folder)
    first.insert(THING, rows(spark, [("x", 1)]).withColumn("to", F.lit(None).cast("bigint")))
    with pytest.raises(StoreLocked):
        first.commit()
    second.close()


def test_modes(spark):
    with Store.temporary(spark, durability="never", auto_compact=True) as s:
        for i in range(2):
            s.insert(THING, rows(spark, [(f"x{i}", i)]).withColumn("to", F.lit(None).cast("bigint")))
            s.commit()
        assert s.extent(THING).count() == 2
    with pytest.raises(ValueError):
        Store.temporary(spark, durability="sometimes")
