import itertools

import pytest
from pyspark.sql import functions as F

from stratagraph.errors import DanglingRef, ReadDenied, SponsorRequired, UnknownActor, WriteDenied
from stratagraph.schema import LABELS, OID, EntityType, Field
from stratagraph.security import CURATOR, EXECUTIVE, ROOT, STAFF, Principal, acting_as, born, check_grants, protect, read_filter, redacted, require_readable, share, unshare
from stratagraph.sources.store import Store

DDL = ", ".join([f"{OID} bigint", *[f"{c} {t}" for c, t in LABELS.items()]])
PRINCIPALS = [Principal(), Principal(5), Principal(5, {2: 300}), Principal(6, {2: 0, 3: 400}), Principal(7, {0: 200}), Principal(1, {0: 600}), Principal(0, {0: 600})]


def may_read(p, owner, groups, floor):
    """The rule, row by row."""
    if p.uid != 0 and p.memberships.get(0, 0) >= 600:
        return True
    if p.uid != 0 and owner == p.uid:
        return True
    held = [p.memberships.get(g, 0 if g == 0 else -1) for g in groups]
    return max(held, default=-1) >= floor


def test_reads(spark):
    rows = [(i, *x) for i, x in enumerate(itertools.product([0, 5, 6], [[], [0], [2], [2, 3], [9]], [-1, 0, 200, 400], [300]))]
    df = spark.createDataFrame(rows, DDL).cache()
    for p in PRINCIPALS:
        want = {r[0] for r in rows if may_read(p, *r[1:4])}
        assert {r[0] for r in read_filter(df, p, True).collect()} == want
        shown = {r[OID] for r in redacted(df, p).collect() if not r["__redacted__"]}
        assert shown == want
    with pytest.raises(ReadDenied):
        require_readable(df, Principal())
    # an unprotected read has the same plan with and without principal
    assert read_filter(df, Principal(), False) is df and read_filter(df, ROOT, True) is df


SECRET = EntityType("Secret", {"k": Field("string", unique=True)}, protected=True)


def test_write_gate(spark, folder):
    mine = Principal(5, {2: STAFF})
    s = Store.open(spark, folder, principal=mine)
    s.insert(SECRET, spark.createDataFrame([("a",)], "k string"))
    s.commit()
    row = s.extent(SECRET).rows
    assert row.first()["__owner__"] == 5

    def attempt(rows, who):
        s.principal = who
        s.update(SECRET, rows)
        try:
            return s.commit()
        finally:
            s.discard()

    cols = [OID, *SECRET.columns]
    row = row.select(cols)
    assert attempt(share(row, 2), mine)  # standing in group 2
    with pytest.raises(WriteDenied):
        attempt(share(row, 3), mine)  # none in group 3
    now = lambda: s.extent(SECRET).rows.select(cols)
    s.principal = ROOT
    with pytest.raises(WriteDenied):
        attempt(protect(now(), write=CURATOR), mine)  # above the own authority
    assert attempt(protect(now(), write=CURATOR), ROOT)
    s.principal = ROOT
    base = now()
    with pytest.raises(WriteDenied):
        attempt(base, mine)  # the floor binds the owner too
    with pytest.raises(WriteDenied):
        attempt(base.withColumn("__owner__", base[OID]), Principal(9, {2: CURATOR}))  # no change of owner
    assert attempt(unshare(base, 2), Principal(9, {2: EXECUTIVE}))
    s.principal = Principal(8)
    s.delete(SECRET, base.select(OID))
    with pytest.raises(WriteDenied):
        s.principal = Principal(8, {2: 0})
        s._staged["Secret"].deletes = base.select(OID)
        s._check(SECRET, None, base.select(OID), base)
    s.discard()
    s.principal = Principal()
    s.insert(SECRET, spark.createDataFrame([("n",)], "k string"))
    with pytest.raises(WriteDenied):
        s.commit()


def test_actors(spark):
    actors = spark.createDataFrame([(5, "p", True, None, {2: 300}), (6, "bot", False, 5, {2: 100}), (7, "x", True, None, None)], "uid bigint, subject string, human boolean, sponsor bigint, memberships map<bigint,int>")
    assert acting_as(actors, 5) == Principal(5, {2: 300}) and acting_as(actors, 6, 5).uid == 6 and acting_as(actors, 7).memberships == {}
    with pytest.raises(SponsorRequired):
        acting_as(actors, 6)
    with pytest.raises(UnknownActor):
        acting_as(actors, 99)
    staged = spark.createDataFrame([(1, {2: 400})], f"{OID} bigint, memberships map<bigint,int>")
    prior = spark.createDataFrame([], f"{OID} bigint, memberships map<bigint,int>")
    with pytest.raises(WriteDenied):
        check_grants(staged, prior, Principal(5, {2: 300}))
    check_grants(staged, prior, Principal(5, {2: 400}))
    assert born(spark.createDataFrame([(1,)], f"{OID} bigint"), Principal(5)).first()["__owner__"] == 5


def test_strict_snapshot(spark, folder):
    """A snapshot's deref says which record is missing, and refuses one that may not be read."""
    kind = EntityType("Note", {"k": Field("string", unique=True)}, protected=True)
    store = Store.open(spark, folder, principal=Principal(5, {2: STAFF}))
    store.insert(kind, protect(spark.createDataFrame([("mine",)], "k string").withColumn("__groups__", F.array(F.lit(2).cast("bigint"))), read=STAFF))
    store.commit()
    oid = store.extent(kind).rows.first()[OID]
    assert store.snapshot().deref(kind, [oid]).first()["k"] == "mine"
    with pytest.raises(DanglingRef):
        store.snapshot().deref(kind, [oid, 5])
    with pytest.raises(ReadDenied):
        store.snapshot().for_principal(Principal(6, {})).deref(kind, [oid])
    assert Principal(0, {0: 600}).root is False and Principal(3, {0: 600}).root and Principal(3).level(0) == 0 and Principal(3).level(4) == -1
