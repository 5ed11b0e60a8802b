"""Queries of the engine's own operators over whole tables, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search, vectors
from ..operators import analytics, graph, hierarchy
from ..plans.extent import Extent
from ..runtime import fresh_path, read_table
from ..schema import DELETED, OID, TID, EntityType, Field, fields
from .. import security
from ..errors import EngineError, WriteDenied
from ..security import STAFF, VIEWER, Principal, read_filter, redacted
from ..sources import files
from ..sources.blobs import BlobTable
from ..sources.store import Store, newest
from ..streaming.changes import CountingConsumer, DeltaLog, Mirror, catch_up

CUSTOMER = EntityType("Customer", {
    "c_custkey": Field("bigint", unique=True), "c_name": Field("string"), "c_nationkey": Field("int", ref="Nation"),
    "c_acctbal": Field("double", sorted=True), "c_mktsegment": Field("string", index=True),
})
ORDER = EntityType("Order", {
    "o_orderkey": Field("bigint", unique=True), "o_custkey": Field("bigint", ref="Customer"), "o_orderstatus": Field("string", index=True),
    "o_totalprice": Field("double", sorted=True), "o_orderdate": Field("timestamp_ntz", sorted=True), "o_orderpriority": Field("string", index=True),
})
PART = EntityType("Part", {
    "p_partkey": Field("bigint", unique=True), "p_name": Field("string", index=True), "p_brand": Field("string", index=True),
    "p_type": Field("string"), "p_size": Field("int", sorted=True), "p_retailprice": Field("double"),
})
EVENT = EntityType("Event", {
    "event_id": Field("bigint", unique=True), "ts": Field("timestamp_ntz", sorted=True), "user_id": Field("bigint", index=True),
    "event_type": Field("string", index=True), "value": Field("double", sorted=True),
}, frozen=True)
MINERAL = EntityType("Mineral", {
    "qid": Field("string", unique=True), "name": Field("string"), "crystal_system": Field("string", index=True),
    "mohs": Field("double", sorted=True), "type_locality": Field("string"), "tags": Field("array<string>", index=True),
})
SECRET = EntityType("Secret", {"event_id": Field("bigint", unique=True), "value": Field("double")}, protected=True)
READER = Principal(7, {2: STAFF, 3: VIEWER})


def customers(s: SparkSession, d: str) -> Extent:
    return Extent.of_table(read_table(s, d, "customer"), CUSTOMER, "c_custkey")


def orders(s: SparkSession, d: str) -> Extent:
    return Extent.of_table(read_table(s, d, "orders"), ORDER, "o_orderkey")


def parts(s: SparkSession, d: str) -> Extent:
    return Extent.of_table(read_table(s, d, "part"), PART, "p_partkey")


def events(s: SparkSession, d: str) -> Extent:
    """Events with the null values that the table itself lacks."""
    rows = read_table(s, d, "events").withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return Extent.of_table(rows, EVENT, "event_id")


def minerals(s: SparkSession, d: str) -> Extent:
    rows = read_table(s, d, "minerals")
    return Extent(rows.withColumn(OID, F.substring("qid", 2, 20).cast("bigint")), MINERAL)


def secrets(s: SparkSession, d: str) -> DataFrame:
    """Events under labels that follow from their columns."""
    return read_table(s, d, "events").select(
        F.col("event_id").alias(OID), "event_id", "value", F.col("user_id").alias("__owner__"),
        F.when(F.col("event_type") == "click", F.array(F.lit(2))).when(F.col("event_type") == "view", F.array(F.lit(3), F.lit(0))).otherwise(F.array().cast("array<int>")).cast("array<bigint>").alias("__groups__"),
        F.when(F.col("value") > 50, 200).otherwise(0).alias("__read_floor__"), F.lit(300).alias("__write_floor__"),
    )


E, C, O_, P, M = fields(EVENT), fields(CUSTOMER), fields(ORDER), fields(PART), fields(MINERAL)
IDS = lambda x, t: x.where(t).select(F.col(OID).alias("id"))


def order_topk(s, d):
    x = events(s, d)
    return x.query(E.event_type.in_(["click", "purchase"]) & (E.value >= 10), order_by=("value", "desc"), limit=50).select("event_id", "event_type", "value")


def page_offset(s, d):
    return customers(s, d).pluck(C.c_acctbal >= 0, "c_custkey", "c_acctbal", order_by="c_acctbal", offset=40, limit=20)


def get_many_aligned(s, d):
    keys = read_table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("key"))
    got = customers(s, d).get_many(keys, "c_custkey")
    return got.select("ord", "key", "c_name")


def deref_join(s, d):
    o, c = orders(s, d), customers(s, d)
    hop = graph.follow(o.rows, "o_custkey", c.rows)
    return hop.groupBy("to_c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def deref_tolerant(s, d):
    refs = read_table(s, d, "lineitem").select(F.monotonically_increasing_id().alias("ord"), F.col("l_orderkey").alias("key"))
    got = orders(s, d).deref(refs, strict=False)
    return got.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _links(s, d):
    return graph.edges(customers(s, d), orders(s, d))


def edges_harvest(s, d):
    return _links(s, d).groupBy("src_type", "field").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets"))


def incoming(s, d):
    rich = customers(s, d).where(C.c_acctbal > 9000)
    return graph.incoming(_links(s, d).where(F.col("field") == "o_custkey"), rich).select("dst", "src")


def indegree(s, d):
    return graph.in_degree(_links(s, d).where(F.col("field") == "o_custkey"))


def dangling(s, d):
    few = Extent(customers(s, d).where(C.c_mktsegment != "BUILDING"), CUSTOMER)
    return graph.dangling(graph.edges(orders(s, d)), few).select("src", "dst")


def blocked_deletes(s, d):
    gone = customers(s, d).where(C.c_acctbal < 0)
    return graph.blocked_deletes(graph.edges(orders(s, d)), gone).select("dst", "src")


def _roots_and_links(s, d):
    cur = hierarchy.current_terms(read_table(s, d, "terms"))
    links = hierarchy.parent_links(cur).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    roots = cur.join(links.select(F.col("src").alias("go_id")), "go_id", "left_anti").select(F.col("go_id").alias(OID))
    return links, roots


def closure_depth(s, d):
    return graph.closure(*_roots_and_links(s, d), reverse=True)


def groupby_agg(s, d):
    g = analytics.grouped(events(s, d).rows, "event_type", "value")
    return g.select("event_type", "n", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), "low", "high")


def handoff_semijoin(s, d):
    lines = read_table(s, d, "lineitem")
    picked = orders(s, d).handoff(O_.o_totalprice > 200000, lines, on="l_orderkey")
    return picked.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def postings(s, d):
    return minerals(s, d).postings("tags").select("value", "n")


def bitmaps(s, d):
    x = customers(s, d).bitmaps("c_mktsegment")
    return x.groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def _history(s, d):
    """Events as versions of their user's record; an error deletes it."""
    return read_table(s, d, "events").select(
        F.col("user_id").alias(OID), F.col("event_id").alias(TID), (F.col("event_type") == "error").alias(DELETED), "event_type", "value"
    )


def fold_latest(s, d):
    return newest(_history(s, d)).where(~F.col(DELETED)).select(F.col(OID).alias("oid"), F.col(TID).alias("tid"), "event_type", "value")


def snapshot_at_tid(s, d):
    rows = _history(s, d)
    half = rows.agg(F.floor(F.avg(TID))).first()[0]
    return newest(rows.where(F.col(TID) <= half)).where(~F.col(DELETED)).select(F.col(OID).alias("oid"), F.col(TID).alias("tid"), "event_type", "value")


def live_counts(s, d):
    log = read_table(s, d, "events").withColumn("gone", F.col("event_type") == "error").withColumn("kind", F.lit("user"))
    return analytics.live_counts(log, "kind", ["user_id"], "event_id", "gone")


def _commits(store: Store, s, d) -> None:
    """Three commits: every customer; changed balances of one segment; deletes of negative ones."""
    rows = read_table(s, d, "customer").select(*CUSTOMER.fields)
    store.insert(CUSTOMER, rows)
    store.commit()
    store.upsert(CUSTOMER, rows.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 1000).otherwise(F.col("c_acctbal")).alias("c_acctbal")))
    store.commit()
    store.delete(CUSTOMER, store.extent(CUSTOMER).where(C.c_acctbal < 0))
    store.commit()


def _store(s, d) -> tuple[Store, EntityType]:
    store = Store.open(s, fresh_path(s, "store"))
    _commits(store, s, d)
    return store, CUSTOMER


def upsert_merge(s, d):
    store, e = _store(s, d)
    return store.extent(e).rows.select("c_custkey", "c_acctbal", F.col(TID).alias("tid"))


def store_snapshot(s, d):
    store, e = _store(s, d)
    return store.snapshot(1).all(e).rows.select("c_custkey", "c_acctbal")


def store_compacted(s, d):
    store, e = _store(s, d)
    store.compact(e)
    return s.read.parquet(*store.parquet_paths(e)).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


def delta_diff(s, d):
    store, e = _store(s, d)
    ops = store.delta(2, [e]).ops
    bal = lambda c: F.get_json_object(c, "$.c_acctbal").cast("double")
    return ops.select("op", F.get_json_object("payload", "$.c_custkey").cast("bigint").alias("c_custkey"), bal("prior").alias("before"), bal("payload").alias("after"))


def delta_log_replay(s, d):
    store, e = _store(s, d)
    log = DeltaLog(s, fresh_path(s, "log"))
    mirror, counts = Mirror(s, fresh_path(s, "mirror")), CountingConsumer()
    for tid in range(1, store.tid + 1):
        log.apply(store.delta(tid, [e]))
    catch_up(mirror, log)
    catch_up(counts, log)
    rows = mirror.table("Customer", "c_custkey bigint, c_acctbal double, c_mktsegment string")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).withColumn("live", F.lit(counts.counts["Customer"]).cast("bigint"))


def lineage_union(s, d):
    """Records written under two shapes, read under a third: a rename, a default, a widened and a derived field."""
    first = EntityType("Reading", {"event_id": Field("bigint", unique=True), "kind": Field("string"), "amount": Field("int")})
    second = EntityType("Reading", {"event_id": Field("bigint", unique=True), "kind": Field("string"), "amount": Field("double"), "note": Field("string")})
    live = EntityType("Reading", {
        "event_id": Field("bigint", unique=True), "event_kind": Field("string", renamed_from="kind"), "amount": Field("double"), "note": Field("string", default="none"),
        "big": Field("boolean", glue=lambda old: old["amount"] > 50),
    })
    store = Store.open(s, fresh_path(s, "lineage"))
    rows = read_table(s, d, "events")
    store.insert(first, rows.where("event_type <> 'click'").select("event_id", F.col("event_type").alias("kind"), F.floor("value").cast("int").alias("amount")))
    store.commit()
    store.insert(second, rows.where("event_type = 'click'").select("event_id", F.col("event_type").alias("kind"), F.col("value").alias("amount"), F.lit("new").alias("note")))
    store.commit()
    return store.extent(live).rows.select("event_id", "event_kind", "amount", "note", "big")


def readable_filter(s, d):
    return read_filter(secrets(s, d), READER, True).select("event_id", "value")


def redaction(s, d):
    return redacted(secrets(s, d), READER).select(F.col(OID).alias("oid"), "value", F.col("__redacted__").alias("redacted"))


def _index(s, d):
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("oid"), "text")
    return search.FullTextIndex.build({"Document": {"text": None}}, {"Document": docs})


def _fts(query, match):
    return lambda s, d: _index(s, d).search(query, limit=20, match=match).select("oid", F.round("score", 6).alias("score"))


def fts_fenced(s, d):
    """Of the matches only those that may be read, here the documents with even ids."""
    readable = read_table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("oid"))
    return _index(s, d).search("crystal ledger drawer", limit=20, readable=readable).select("oid", F.round("score", 6).alias("score"))


def fts_stemmed(s, d):
    """Words and stems of four languages: each document under the language it is written in."""
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("oid"), "text", F.lower(F.trim("lang")).alias("lang"))
    kinds = {lang: {"text": lang} for lang in ("en", "de", "es", "fr")}
    index = search.FullTextIndex.build(kinds, {lang: docs.where(F.col("lang") == lang) for lang in kinds})
    path = fresh_path(s, "fts")
    index.save(path)
    return search.FullTextIndex.load(s, path, kinds).search("crystals kristalle cristales cristaux", limit=20).select("oid", "type", F.round("score", 6).alias("score"))


def fts_highlight(s, d):
    """The first marked word of each excerpt, and how many are marked."""
    rows = read_table(s, d, "documents").where("text is not null").select("doc_id", "text")
    excerpt = _index(s, d).highlighter("ledger")("text")
    return rows.select("doc_id", excerpt.alias("x")).where("x is not null").select("doc_id", F.lower(F.regexp_extract("x", r"(?i)\[(ledger)\]", 1)).alias("word"))


def _nearest_each(s, d, k):
    """Every row whose id is divisible by 50 as a query against all rows."""
    rows = read_table(s, d, "embeddings")
    return vectors.nearest_each(rows, "embedding", "vec_id", rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), k)


def vector_topk(s, d):
    return _nearest_each(s, d, 20).select("query", "vec_id", F.round("score", 6).alias("score"))


def rrf(s, d):
    return vectors.fuse_ranked(_nearest_each(s, d, 50), "vec_id").select("vec_id", F.round("score", 9).alias("score"))


def relevance(s, d):
    """Each label is a query, the first coordinate the score, the second's sign and size the grade."""
    rows = read_table(s, d, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("doc"), F.get("embedding", F.lit(0)).alias("score"), F.get("embedding", F.lit(1)).alias("g"))
    judged = rows.select("query", "doc", F.when(F.col("g") > 0.1, 2).when(F.col("g") > 0, 1).otherwise(0).alias("grade"))
    r = analytics.relevance(rows.drop("g"), judged)
    return r.select("query", *[F.round(c, 6).alias(c) for c in ("ndcg", "precision", "recall", "mrr")])


def checksums(s, d):
    return read_table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))


LINE = EntityType("Line", {"line": Field("string", unique=True)})


def unique_violations(s, d):
    """The store's own check of a unique field, over line items under order and number."""
    rows = read_table(s, d, "lineitem").select(F.monotonically_increasing_id().alias(OID), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    return Store.unique_violations(LINE, "line", rows, rows.select(OID).limit(0), None).select(F.col("key").alias("line"), F.col("records").alias("n"))


def fetch_batch(s, d):
    return customers(s, d).fetch(range(1, 4000, 7)).select("c_custkey", "c_name")


def deref_strict(s, d):
    refs = read_table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("key"))
    return customers(s, d).deref(refs).select("ord", "key", "c_mktsegment")


def pages(s, d):
    """Three pages side by side: no row twice, none left out."""
    x = customers(s, d)
    each = [x.pluck(None, "c_custkey", "c_nationkey", order_by=("c_nationkey", "desc"), offset=100 * n, limit=100).withColumn("page", F.lit(n)) for n in range(3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


def snapshot_incoming(s, d):
    """Who referred to rich customers in transaction 1, though some orders were deleted in transaction 2."""
    store = Store.open(s, fresh_path(s, "orders"))
    store.insert(ORDER, read_table(s, d, "orders").select(*ORDER.fields))
    store.commit()
    store.delete(ORDER, store.extent(ORDER).where(O_.o_orderstatus == "F"))
    store.commit()
    then = store.snapshot(1)
    met = then.incoming(customers(s, d).where(C.c_acctbal > 9000), ORDER)
    return met.join(then.all(ORDER).rows.select(F.col(OID).alias("src"), "o_orderkey"), "src").select("dst", "o_orderkey")


def attached_consumers(s, d):
    """A mirror and a counter attached before the first commit, each change delivered as it is made."""
    store = Store.open(s, fresh_path(s, "attached"))
    mirror, counts = Mirror(s, fresh_path(s, "mirror"), max_parts=2, verify=True), CountingConsumer()
    store.attach(mirror)
    store.attach(counts)
    _commits(store, s, d)
    rows = mirror.table("Customer", "c_custkey bigint, c_acctbal double, c_mktsegment string")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).withColumn("live", F.lit(counts.counts["Customer"]).cast("bigint"))


def log_bootstrap(s, d):
    """A log begun from the store's state at transaction 2 ends in the same state as one that holds every delta; a mirror catches up from either."""
    store, e = _store(s, d)
    whole, late = DeltaLog(s, fresh_path(s, "whole")), DeltaLog(s, fresh_path(s, "late"))
    deltas = [store.delta(tid, [e]) for tid in range(1, store.tid + 1)]
    for x in deltas:
        whole.apply(x)
    rows = store.snapshot(2).all(e).rows.select(F.lit(e.name).alias("type"), F.col(OID).alias("oid"), F.to_json(F.struct(*e.columns), {"ignoreNullFields": "false"}).alias("payload"))
    late.bootstrap(rows, 2, deltas[1].types)
    late.apply(deltas[2])
    mirror = Mirror(s, fresh_path(s, "mirror"))
    catch_up(mirror, late)
    same = whole.state_digest() == late.state_digest()
    return mirror.table("Customer", "c_custkey bigint, c_acctbal double").select("c_custkey", "c_acctbal", F.lit(same).alias("same"))


def inferred_columns(s, d):
    """Columns as the mirrored values ask: integers and floats widen, what is neither stays text."""
    rows = read_table(s, d, "events")
    loose = F.when(F.col("event_type") == "click", F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    payload = F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "amount": '), loose, F.lit(', "kind": "'), "event_type", F.lit('"}'))
    mirror = Mirror(s, fresh_path(s, "inferred"))
    mirror.bootstrap(rows.select(F.lit("Event").alias("type"), F.col("event_id").alias("oid"), payload.alias("payload")), 1)
    return mirror.inferred("Event").select("event_id", F.col("amount").cast("double").alias("amount"), "kind")


def migrated(s, d):
    """A store rewritten under a new shape, and what breaks that shape's rules."""
    old = EntityType("Reading", {"event_id": Field("bigint", unique=True), "amount": Field("double")})
    live = EntityType("Reading", {"event_id": Field("bigint", unique=True), "total": Field("double", renamed_from="amount", required=True)})
    store = Store.open(s, fresh_path(s, "migrated"))
    store.insert(old, events(s, d).rows.select("event_id", F.col("value").alias("amount")))
    store.commit()
    store.migrate(live)
    bad = store.verify(live).join(store.extent(live).rows.select(OID, "event_id"), OID)
    return bad.select("event_id", "problem")


def file_import(s, d):
    """Nations written as CSV and as JSON lines, read back with a schema."""
    path, rows = fresh_path(s, "files"), read_table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows.write.option("header", True).csv(f"{path}/csv")
    rows.write.json(f"{path}/json")
    return files.csv(s, f"{path}/csv", ddl).withColumn("kind", F.lit("csv")).unionByName(files.json_lines(s, f"{path}/json", ddl).withColumn("kind", F.lit("json")))


def blob_ranges(s, d):
    """The bytes 3 to 22 of each document's text, from chunks kept beside the records."""
    rows = read_table(s, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("data"))
    table = BlobTable(s, fresh_path(s, "blobs"))
    kept = table.write_column(rows, "doc_id", "data")
    wanted = kept.select(F.col("doc_id").alias("blob_oid"), F.lit(3).cast("bigint").alias("pos"), F.lit(20).cast("bigint").alias("len"))
    got = table.ranges(wanted).select(F.col("blob_oid").alias("doc_id"), F.lower(F.hex("bytes")).alias("bytes"))
    return got.join(kept.select("doc_id", F.col("descriptor.size").alias("size"), "descriptor.sha256"), "doc_id").where("bytes <> ''")


def label_verbs(s, d):
    """Clicks shared with group 7 and raised to a floor, then what a member of that group may read."""
    clicks = secrets(s, d).where("event_id % 2 = 0")
    shared = security.protect(security.share(clicks, 7), read=STAFF)
    back = security.unshare(shared.where("value < 10"), 7)
    return read_filter(shared.where("value >= 10").unionByName(back), Principal(11, {7: STAFF}), True).select("event_id", "value")


def write_gate(s, d):
    """Which of some writes the gate refuses."""
    rows = secrets(s, d).limit(1).select(F.col(OID), F.lit(5).cast("bigint").alias("__owner__"), F.array(F.lit(2).cast("bigint")).alias("__groups__"), F.lit(0).alias("__read_floor__"), F.lit(STAFF).alias("__write_floor__"))
    none, change = rows.limit(0), lambda c, v: rows.withColumn(c, v)
    staff, viewer, nobody = Principal(5, {2: STAFF}), Principal(6, {2: VIEWER}), Principal()
    cases = {
        "a change by staff": (change("__read_floor__", F.lit(STAFF)), rows, none, staff), "a change by a viewer": (rows, rows, none, viewer), "a new record of another": (rows, none, none, viewer),
        "a new record of nobody": (rows, none, none, nobody), "a delete by a viewer": (none, rows, rows, viewer), "a delete by staff": (none, rows, rows, staff),
        "another owner": (change("__owner__", F.lit(6).cast("bigint")), rows, none, staff), "a floor above oneself": (change("__write_floor__", F.lit(600)), rows, none, staff),
        "a group not stood in": (security.share(rows, 9), rows, none, staff),
    }
    out = []
    for name, (staged, prior, deletes, p) in cases.items():
        try:
            security.check_writes(staged, prior, deletes.select(OID), p)
            out.append((name, False))
        except WriteDenied:
            out.append((name, True))
    return s.createDataFrame(out, "name string, refused boolean")


def refusals(s, d):
    """What a store and its conditions refuse, and what a refusal leaves."""
    store, e = _store(s, d)
    first = store.extent(e).rows.select(OID, *e.fields).limit(1)
    x = customers(s, d)

    def conflict():
        store.update(e, store.extent(e).rows.where(F.col(TID) == 2).select(OID, *e.fields).limit(1))
        store.commit(since=1)

    def twice():
        store.insert(e, first.drop(OID).unionByName(first.drop(OID)))
        store.commit()

    def taken():
        store.insert(e, first.drop(OID))
        store.commit()

    tries = {
        "a condition as a truth value": lambda: bool(C.c_acctbal > 0), "a condition of another type": lambda: x.where(O_.o_orderkey == 1), 
        "a record changed since": conflict, "a unique value twice": twice, "a unique value taken": taken, "an order by no field": lambda: x.query(order_by="nothing"),
        "a second writer": lambda: Store.open(s, store.path), "a consumer that lags": lambda: store.attach(CountingConsumer()), "no such transaction": lambda: store.snapshot(9),
    }
    out = []
    for name, run in tries.items():
        try:
            run()
            refused = False
        except (EngineError, TypeError, ValueError):
            refused = True
        store.discard()
        out.append((name, refused, store.tid))
    return s.createDataFrame(out, "name string, refused boolean, tid bigint")


def explained(s, d):
    """Which leaves of a condition the scan can answer."""
    plan = orders(s, d).explain((O_.o_totalprice >= 1000) & (O_.o_orderstatus == "F") & (O_.o_custkey == 5))
    rows = [("indexed", len(plan.indexed), "o_totalprice" in plan.pushed[0]), ("residual", len(plan.residual), "o_custkey" in plan.pushed[0])]
    return s.createDataFrame(rows, "kind string, leaves int, pushed boolean")


def acting(s, d):
    """Actors from a table of customers: people act for themselves, machines (odd keys) only for their sponsor."""
    actors = read_table(s, d, "customer").select(F.col("c_custkey").alias("uid"), (F.col("c_custkey") % 2 == 0).alias("human"), F.lit(2).cast("bigint").alias("sponsor"), F.create_map(F.lit(2).cast("bigint"), F.col("c_nationkey").cast("bigint")).alias("memberships"))
    out = []
    for uid, sponsor in ((2, None), (3, None), (3, 2), (3, 4), (-1, None)):
        try:
            out.append((uid, sponsor, security.acting_as(actors, uid, sponsor).level(2)))
        except EngineError:
            out.append((uid, sponsor, None))
    return s.createDataFrame(out, "uid bigint, sponsor bigint, level bigint")


QUERIES = {
    "filter_eq": lambda s, d: IDS(orders(s, d), O_.o_orderstatus == "F"),
    "filter_eq_null": lambda s, d: IDS(events(s, d), E.value == None),  # noqa: E711
    "filter_ne_null": lambda s, d: IDS(minerals(s, d), M.crystal_system != "cubic"),
    "filter_range": lambda s, d: IDS(events(s, d), (E.value >= 20) & (E.value < 80)),
    "filter_between": lambda s, d: IDS(parts(s, d), P.p_size.between(10, 20)),
    "filter_in": lambda s, d: IDS(events(s, d), E.event_type.in_(["click", "error"])),
    "filter_in_null": lambda s, d: IDS(minerals(s, d), ~M.crystal_system.in_(["cubic", None])),
    "filter_contains": lambda s, d: IDS(parts(s, d), P.p_name.contains("gi")),
    "filter_startswith": lambda s, d: IDS(parts(s, d), P.p_brand.startswith("Brand#1")),
    "filter_list_contains": lambda s, d: IDS(minerals(s, d), M.tags.contains("type")),
    "filter_list_equality": lambda s, d: IDS(minerals(s, d), M.tags == ["polished"]),
    "filter_not_tree": lambda s, d: IDS(events(s, d), ~((E.value > 30) | (E.event_type == "view") & ~(E.user_id < 100))),
    "filter_not_range_null": lambda s, d: IDS(minerals(s, d), ~(M.mohs >= 5.0)),
    "filter_ref_eq": lambda s, d: IDS(customers(s, d), C.c_nationkey == 7),
    "filter_unlike_kinds": lambda s, d: IDS(parts(s, d), (P.p_size == 7.0) | (P.p_name == 5)),
    "pluck": lambda s, d: customers(s, d).pluck(None, "c_custkey", "c_mktsegment"),
    "count_extent": lambda s, d: orders(s, d).count_rows(),
    "count_cond": lambda s, d: orders(s, d).count_rows((O_.o_totalprice >= 1000) & (O_.o_orderstatus != "O")),
    "order_topk": order_topk,
    "order_nulls_last": lambda s, d: events(s, d).query(order_by=("value", "desc"), offset=0).select("event_id", "value"),
    "page_offset": page_offset,
    "get_unique": lambda s, d: customers(s, d).get(c_custkey=17).select("c_custkey", "c_name"),
    "get_many_aligned": get_many_aligned,
    "deref_join": deref_join,
    "deref_tolerant": deref_tolerant,
    "edges_harvest": edges_harvest,
    "incoming": incoming,
    "indegree": indegree,
    "dangling": dangling,
    "blocked_deletes": blocked_deletes,
    "closure_depth": closure_depth,
    "groupby_agg": groupby_agg,
    "handoff_semijoin": handoff_semijoin,
    "postings": postings,
    "bitmaps": bitmaps,
    "fold_latest": fold_latest,
    "snapshot_at_tid": snapshot_at_tid,
    "live_counts": live_counts,
    "upsert_merge": upsert_merge,
    "store_snapshot": store_snapshot,
    "store_compacted": store_compacted,
    "delta_diff": delta_diff,
    "delta_log_replay": delta_log_replay,
    "lineage_union": lineage_union,
    "unique_violations": unique_violations,
    "readable_filter": readable_filter,
    "redaction": redaction,
    "fts_any": _fts("crystal ledger drawer", "any"),
    "fts_all": _fts("crystal ledger", "all"),
    "fts_phrase": _fts('"hardness scale" lamp', "any"),
    "vector_topk": vector_topk,
    "rrf": rrf,
    "fts_fenced": fts_fenced,
    "fts_stemmed": fts_stemmed,
    "fts_highlight": fts_highlight,
    "relevance": relevance,
    "checksums": checksums,
    "fetch_batch": fetch_batch,
    "deref_strict": deref_strict,
    "pages": pages,
    "snapshot_incoming": snapshot_incoming,
    "attached_consumers": attached_consumers,
    "log_bootstrap": log_bootstrap,
    "inferred_columns": inferred_columns,
    "migrated": migrated,
    "file_import": file_import,
    "blob_ranges": blob_ranges,
    "label_verbs": label_verbs,
    "write_gate": write_gate,
    "refusals": refusals,
    "explained": explained,
    "acting": acting,
}

_EV = "ev as (select event_id, ts, user_id, event_type, case when value >= 5 then value end as value from events)"
_MIN = "select substr(qid, 2)::bigint as id from minerals where "
_EDGES = """edges as (
  select c_custkey as src, 'Customer' as src_type, 'c_nationkey' as field, c_nationkey::bigint as dst from customer where c_nationkey is not null
  union all select o_orderkey, 'Order', 'o_custkey', o_custkey from orders where o_custkey is not null)"""
_HIST = "hist as (select user_id as oid, event_id as tid, event_type = 'error' as deleted, event_type, value from events)"
_FINAL = """final as (
  select c_custkey, c_mktsegment, case when c_mktsegment = 'BUILDING' then c_acctbal + 1000 else c_acctbal end as c_acctbal, case when c_mktsegment = 'BUILDING' then 2 else 1 end as tid from customer)"""
_READ = "(user_id = 7 or case event_type when 'click' then 300 when 'view' then 0 else -1 end >= case when value > 50 then 200 else 0 end)"


def _fts_sql(terms: list[list[str]], every: bool, fence: str = "true") -> str:
    """BM25 over one folded text column (weight 2) beside a type name of one word."""
    phrases = " union all ".join(
        f"select {i} as phrase, a.doc_id, count(*) as times from toks a "
        + " ".join(f"join toks t{k} on t{k}.doc_id = a.doc_id and t{k}.pos = a.pos + {k} and t{k}.w = '{w}'" for k, w in enumerate(unit) if k)
        + f" where a.w = '{unit[0]}' group by a.doc_id"
        for i, unit in enumerate(terms)
    )
    return rf"""with words as (select doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{{L}}\p{{N}}]+') as ws from documents where text is not null),
toks as (select doc_id, strip_accents(translate(unnest(ws), '０１２３４５６７８９', '0123456789')) as w, generate_subscripts(ws, 1) as pos from words),
lens as (select doc_id, len(ws) + 1 as n from words),
whole as (select count(*) as docs, avg(n) as mean from lens),
hits as ({phrases}),
dfs as (select phrase, count(*) as n_p from hits group by phrase)
select doc_id as oid, round(sum(greatest(case when ln((docs - n_p + 0.5) / (n_p + 0.5)) <= 0 then 1e-6 else ln((docs - n_p + 0.5) / (n_p + 0.5)) end, 0)
  * 2.0 * times * 2.2 / (2.0 * times + 1.2 * (0.25 + 0.75 * n / mean))), 6) as score
from hits join dfs using (phrase) join lens using (doc_id), whole where {fence} group by doc_id {'having count(distinct phrase) = ' + str(len(terms)) if every else ''}
order by sum(case when ln((docs - n_p + 0.5) / (n_p + 0.5)) <= 0 then 1e-6 else ln((docs - n_p + 0.5) / (n_p + 0.5)) end * 2.0 * times * 2.2 / (2.0 * times + 1.2 * (0.25 + 0.75 * n / mean))) desc, oid limit 20"""


_EACH = """each_ as (
  select q.vec_id as query, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score, row_number() over (partition by q.vec_id order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id) as rn
  from embeddings q, embeddings e where q.vec_id % 50 = 0)"""

ORACLE = {
    "filter_eq": "select o_orderkey as id from orders where o_orderstatus = 'F'",
    "filter_eq_null": f"with {_EV} select event_id as id from ev where value is null",
    "filter_ne_null": _MIN + "crystal_system is distinct from 'cubic'",
    "filter_range": f"with {_EV} select event_id as id from ev where value >= 20 and value < 80",
    "filter_between": "select p_partkey as id from part where p_size between 10 and 20",
    "filter_in": "select event_id as id from events where event_type in ('click', 'error')",
    "filter_in_null": _MIN + "crystal_system is not null and crystal_system <> 'cubic'",
    "filter_contains": "select p_partkey as id from part where contains(p_name, 'gi')",
    "filter_startswith": "select p_partkey as id from part where starts_with(p_brand, 'Brand#1')",
    "filter_list_contains": _MIN + "list_contains(tags, 'type')",
    "filter_list_equality": _MIN + "tags is not distinct from ['polished']",
    "filter_not_tree": f"with {_EV} select event_id as id from ev where (value is null or value <= 30) and (event_type <> 'view' or user_id < 100)",
    "filter_not_range_null": _MIN + "(mohs is null or mohs < 5)",
    "filter_ref_eq": "select c_custkey as id from customer where c_nationkey = 7",
    "filter_unlike_kinds": "select p_partkey as id from part where p_size = 7",
    "pluck": "select c_custkey, c_mktsegment from customer",
    "count_extent": "select count(*) as n from orders",
    "count_cond": "select count(*) as n from orders where o_totalprice >= 1000 and o_orderstatus is distinct from 'O'",
    "order_topk": f"with {_EV} select event_id, event_type, value from ev where event_type in ('click', 'purchase') and value >= 10 order by value desc, event_id limit 50",
    "order_nulls_last": f"with {_EV} select event_id, value from ev order by value desc nulls last, event_id",
    "page_offset": "select c_custkey, c_acctbal from customer where c_acctbal >= 0 order by c_acctbal, c_custkey limit 20 offset 40",
    "get_unique": "select c_custkey, c_name from customer where c_custkey = 17",
    "get_many_aligned": "select o_orderkey as ord, o_custkey as key, c_name from orders left join customer on c_custkey = o_custkey",
    "deref_join": "select c_mktsegment as to_c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders left join customer on c_custkey = o_custkey group by all",
    "deref_tolerant": "select o_orderstatus, count(*) as n from lineitem left join orders on l_orderkey = o_orderkey group by all",
    "edges_harvest": f"with {_EDGES} select src_type, field, count(*) as n, count(distinct dst) as targets from edges group by all",
    "incoming": "select distinct o_custkey as dst, o_orderkey as src from orders join customer on c_custkey = o_custkey where c_acctbal > 9000",
    "indegree": "select o_custkey as dst, count(*) as n from orders where o_custkey is not null group by all",
    "dangling": "select o_orderkey as src, o_custkey as dst from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')",
    "blocked_deletes": "select distinct o_custkey as dst, o_orderkey as src from orders join customer on c_custkey = o_custkey where c_acctbal < 0 and o_orderkey not in (select c_custkey from customer where c_acctbal < 0)",
    "closure_depth": """with recursive cur as (select go_id, arg_max(parents, tid) as parents from terms group by go_id),
links as (select distinct c.go_id as child, p.go_id as parent from (select go_id, unnest(parents) as entry from cur) c
  join cur p on lower(trim(string_split(c.entry, '!')[1], ' ' || chr(9) || chr(10) || chr(13))) = lower(p.go_id)),
walk(seed, node, depth) using key (seed, node) as (
  select go_id, go_id, 0 from cur where go_id not in (select child from links)
  union select w.seed, l.child, min(w.depth + 1) from walk w join links l on l.parent = w.node
    left join recurring.walk r on r.seed = w.seed and r.node = l.child where r.depth is null group by all)
select seed, node, depth from walk""",
    "groupby_agg": f"with {_EV} select event_type, count(value) as n, round(sum(value), 2) as total, round(avg(value), 6) as mean, min(value) as low, max(value) as high from ev where event_type is not null group by all",
    "handoff_semijoin": "select l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem where l_orderkey in (select o_orderkey from orders where o_totalprice > 200000) group by all",
    "postings": "select value, count(distinct qid) as n from (select qid, unnest(tags) as value from minerals) group by all",
    "bitmaps": "select c_mktsegment as value, count(*) as n from customer group by all",
    "fold_latest": f"with {_HIST} select oid, tid, event_type, value from (select *, row_number() over (partition by oid order by tid desc) as rn from hist) where rn = 1 and not deleted",
    "snapshot_at_tid": f"with {_HIST} select oid, tid, event_type, value from (select *, row_number() over (partition by oid order by tid desc) as rn from hist where tid <= (select floor(avg(tid)) from hist)) where rn = 1 and not deleted",
    "live_counts": f"with {_HIST} select 'user' as kind, count(*) as n from (select *, row_number() over (partition by oid order by tid desc) as rn from hist) where rn = 1 and not deleted",
    "upsert_merge": f"with {_FINAL} select c_custkey, c_acctbal, tid from final where c_acctbal >= 0",
    "store_snapshot": "select c_custkey, c_acctbal from customer",
    "store_compacted": f"with {_FINAL} select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as total from final where c_acctbal >= 0 group by all",
    "delta_diff": "select 'upsert' as op, c_custkey, c_acctbal as before, c_acctbal + 1000 as after from customer where c_mktsegment = 'BUILDING'",
    "delta_log_replay": f"with {_FINAL} select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as total, (select count(*) from final where c_acctbal >= 0) as live from final where c_acctbal >= 0 group by all",
    "lineage_union": """select event_id, event_type as event_kind, case when event_type = 'click' then value else floor(value) end as amount, case when event_type = 'click' then 'new' else 'none' end as note,
case when event_type = 'click' then value else floor(value) end > 50 as big from events""",
    "unique_violations": "select l_orderkey || '-' || l_linenumber as line, count(*) as n from lineitem group by all having count(*) > 1",
    "readable_filter": f"select event_id, value from events where {_READ}",
    "redaction": f"select event_id as oid, case when {_READ} then value end as value, not {_READ} as redacted from events",
    "fts_any": _fts_sql([["crystal"], ["ledger"], ["drawer"]], False),
    "fts_all": _fts_sql([["crystal"], ["ledger"]], True),
    "fts_phrase": _fts_sql([["hardness", "scale"], ["lamp"]], False),
    "vector_topk": f"with {_EACH} select query, vec_id, round(score, 6) as score from each_ where rn <= 20",
    "rrf": f"with {_EACH} select vec_id, round(sum(1.0 / (60 + rn)), 9) as score from each_ where rn <= 50 group by vec_id",
    "relevance": """with r as (select label as query, vec_id as doc, embedding[1] as score, case when embedding[2] > 0.1::float then 2 when embedding[2] > 0 then 1 else 0 end as grade from embeddings),
ranked as (select *, row_number() over (partition by query order by score desc, doc) as rank, row_number() over (partition by query order by grade desc, doc) as best from r)
select query, round(coalesce(sum(case when rank <= 10 then grade / log2(rank + 1) else 0 end) / sum(case when best <= 10 then grade / log2(best + 1) else 0 end), 0), 6) as ndcg,
round(count(*) filter (where rank <= 10 and grade > 0) / 10.0, 6) as precision, round(count(*) filter (where rank <= 100 and grade > 0) / count(*) filter (where grade > 0), 6) as recall,
round(coalesce(1.0 / min(rank) filter (where grade > 0 and rank <= 100), 0), 6) as mrr from ranked group by query having count(*) filter (where grade > 0) > 0""",
    "checksums": "select doc_id, sha256(text) as sha from documents where text is not null",
}

ORACLE |= {
    "fts_fenced": _fts_sql([["crystal"], ["ledger"], ["drawer"]], False, "doc_id % 2 = 0"),
    "fts_highlight": r"""select doc_id, 'ledger' as word from documents where list_contains(regexp_extract_all(strip_accents(lower(nfc_normalize(text))), '[\p{L}\p{N}]+'), 'ledger')""",
    "fetch_batch": "select c_custkey, c_name from customer where c_custkey % 7 = 1 and c_custkey < 4000",
    "deref_strict": "select o_orderkey as ord, o_custkey as key, c_mktsegment from orders join customer on c_custkey = o_custkey",
    "pages": "select c_custkey, c_nationkey, (rn - 1) // 100 as page from (select *, row_number() over (order by c_nationkey desc, c_custkey) as rn from customer) where rn <= 300",
    "snapshot_incoming": "select distinct o_custkey as dst, o_orderkey from orders join customer on c_custkey = o_custkey where c_acctbal > 9000",
    "attached_consumers": ORACLE["delta_log_replay"],
    "log_bootstrap": f"with {_FINAL} select c_custkey, c_acctbal, true as same from final where c_acctbal >= 0",
    "inferred_columns": "select event_id, case when event_type = 'click' then floor(value) else value end as amount, event_type as kind from events",
    "migrated": "select event_id, 'total is null' as problem from events where value < 5 or value is null",
    "file_import": "select n_nationkey, n_name, n_regionkey, kind from nation, (values ('csv'), ('json')) k(kind)",
    "blob_ranges": "select doc_id, substr(lower(hex(encode(text))), 7, 40) as bytes, octet_length(encode(text)) as size, sha256(text) as sha256 from documents where text is not null and octet_length(encode(text)) > 3",
    "label_verbs": "select event_id, value from events where event_id % 2 = 0 and (value >= 10 or user_id = 11)",
    "write_gate": """select * from (values ('a change by staff', false), ('a change by a viewer', true), ('a new record of another', true), ('a new record of nobody', true), ('a delete by a viewer', true),
('a delete by staff', false), ('another owner', true), ('a floor above oneself', true), ('a group not stood in', true)) v(name, refused)""",
    "refusals": """select name, true as refused, 3 as tid from (values ('a condition as a truth value'), ('a condition of another type'), ('a record changed since'),
('a unique value twice'), ('a unique value taken'), ('an order by no field'), ('a second writer'), ('a consumer that lags'), ('no such transaction')) v(name)""",
    "explained": "select * from (values ('indexed', 2, true), ('residual', 1, true)) v(kind, leaves, pushed)",
    "acting": "select uid, sponsor, case when uid = 2 or sponsor = 2 then (select c_nationkey from customer where c_custkey = uid) end as level from (values (2, null), (3, null), (3, 2), (3, 4), (-1, null)) v(uid, sponsor)",
}
