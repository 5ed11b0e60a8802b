"""The general training-data operators against plain versions, with the odd cases their docstrings define."""

import json
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.errors import Conflict
from stratagraph.functions.records import kind_letters, leading_number, payload_refs, split_fields
from stratagraph.operators import cdc_apply, drift, hierarchy, incremental, orphans
from stratagraph.queries import training

T0 = datetime(2024, 1, 1)
OBJECTS = "store_id int, oid bigint, cid int, tid bigint, payload string, crc bigint, committed_at timestamp_ntz, arrived_at timestamp_ntz, name string, fields string"
RUNS = "run_id bigint, store_id int, consumer string, from_tid bigint, status string, started_at timestamp_ntz, logged_at timestamp_ntz, cursor string"
META = "store_id int, key string, value string, run_id bigint, written_at timestamp_ntz, consumer string"
TYPES = "store_id int, cid int, name string, fields string, recorded_at timestamp_ntz, oid bigint"
SPECS = "typename string, name string, kind string, marker string, renamed_from string, entity_ref boolean"
BATCH = "store_id int, tid bigint, attempt int, actor bigint, committed_at timestamp_ntz, records array<struct<oid:bigint,cid:int,tid:bigint,payload:string>>, deletes array<bigint>, arrived_at timestamp_ntz, oid bigint"
TERMS = "go_id string, name string, namespace string, parents array<string>, tid bigint, stored_at timestamp_ntz, child string, root string"


def obj(store, oid, tid, value, arrived=0, cid=1, good=True):
    """A row of objects; columns named as in other tables ride along."""
    payload = None if value is None else json.dumps(value)
    crc = None if payload is None else zlib.crc32(payload.encode()) + (0 if good else 1)
    return (store, oid, cid, tid, payload, crc, T0 + timedelta(days=40 * (tid or 0)), None if arrived is None else T0 + timedelta(minutes=arrived), "clash", "clash")


def objects(spark, rows):
    return spark.createDataFrame(rows, OBJECTS)


def log(rng, stores=3, n=400):
    rows = []
    for _ in range(n):
        oid = 2**40 + (0 if rng.random() < 0.3 else rng.randrange(60))
        value = None if rng.random() < 0.15 else ["x", {"$ref": 2**40 + rng.randrange(70)}, [{"$ref": 2**40 + rng.randrange(90)}], rng.choice([1, 1.5, None, "7", True])]
        rows.append(obj(rng.randrange(stores), oid, rng.randrange(1, 90), value, rng.randrange(500), good=rng.random() > 0.1))
    # one version must not have two payloads
    seen = {}
    for i, r in enumerate(rows):
        first = seen.setdefault((r[0], r[1], r[3]), r)
        rows[i] = (*r[:4], first[4], first[5], *r[6:])
    odd = [(None, 1, 1, 1, "[]", zlib.crc32(b"[]"), None, None, None, None), (0, None, 1, 1, None, None, None, None, None, None), (0, 5, None, None, None, None, None, None, None, None)]
    return rows + odd + rows[:20]


def intact(rows):
    return [r for r in rows if None not in (r[0], r[1], r[3]) and (r[5] == (None if r[4] is None else zlib.crc32(r[4].encode())))]


def current(rows):
    best = {}
    for r in intact(rows):
        best[r[0], r[1]] = max(best.get((r[0], r[1]), (-1, None)), (r[3], r[4]), key=lambda x: x[0])
    return best


# -- 1


def runs_and_meta(rng):
    runs, meta = [], []
    for i in range(60):
        store, consumer, low = rng.randrange(4), rng.choice(incremental.CONSUMERS), rng.randrange(80)
        start = T0 + timedelta(minutes=rng.randrange(500))
        runs.append((i, store, consumer, low, "running", start, start, "x"))
        end = rng.choice(["ok", "ok", "failed", "crashed", "ok then rolled_back", None])
        for k, status in enumerate((end or "").split(" then ")):
            if status:
                runs += [(i, store, consumer, low, status, start, start + timedelta(minutes=k + 1), "x")] * 2
        cursor = low + rng.randrange(30)
        text = rng.choice([f"{cursor}", f"+{cursor}", f" {cursor}\n", f"{cursor}.0", f"tid={cursor}", f'{{"tid": {cursor}}}', "000" + str(cursor), "n/a", "", "null", None])
        meta += [(store, f"cursor.{consumer}", text, i, start, "x")] * rng.choice([1, 2])
    runs.append((None, 0, "mirror", 0, "ok", T0, T0, "x"))
    meta += [(0, "next_tid", "99", None, T0, "x"), (None, None, None, None, None, None)]
    return runs, meta


def number(text):
    import re

    m = re.fullmatch(r"\s*\D*?(\d+)(\.\d*)?\D*", text or "")
    return int(m[1]) if m else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_untaken(spark, seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(incremental, "is_small", lambda df: False)
    if seed == 2:
        monkeypatch.setattr(incremental, "is_small", lambda df: False)
        monkeypatch.setattr(incremental, "SPAN", 2)
        monkeypatch.setattr(incremental, "HOT", 3)
    rng = random.Random(seed)
    rows, (runs, meta) = log(rng), runs_and_meta(rng)
    got = incremental.untaken(objects(spark, rows), spark.createDataFrame(runs, RUNS), spark.createDataFrame(meta, META)).collect()
    last = {}
    for r in runs:
        if r[0] is not None:
            last[r[0]] = max(last.get(r[0], (T0, False, r)), (r[6], r[4] != "ok", r), key=lambda x: x[:2])
    cursors = {}
    for m in meta:
        if m[3] is not None and number(m[2]) is not None:
            cursors[m[3]] = number(m[2])
    good = [(r[2], r[1], r[3], cursors[i], r[5]) for i, (_, bad, r) in last.items() if not bad and i in cursors]
    first = {}
    for r in intact(rows):
        k = r[0], r[1], r[3]
        first[k] = min(first.get(k, r[7]), r[7])
    want = {(c, *k) for k, at in first.items() for c in incremental.CONSUMERS if not any(g[0] == c and g[1] == k[0] and g[2] < k[2] <= g[3] and at <= g[4] for g in good)}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and want


def test_untaken_empty(spark):
    none = spark.createDataFrame([], OBJECTS)
    runs, meta = spark.createDataFrame([], RUNS), spark.createDataFrame([], META)
    assert incremental.untaken(none, runs, meta).count() == 0
    assert incremental.untaken(objects(spark, [obj(1, 2, 3, ["a"]), obj(1, 2, 3, ["a"], None)]), runs, meta).count() == 3


def test_numbers(spark):
    texts = ["12", "+12", " 12\n", "12.0", "tid=12", '{"tid": 12}', "00012", "", "n/a", None, "1 2", "9223372036854775807", "tid=10000000000000000000"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(leading_number(F.col("t"))).collect()]
    assert got == [12] * 7 + [None] * 4 + [2**63 - 1] * 2


def test_reader_survives_failures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MAX_PARTS", 3)
    reader = incremental.IncrementalReader(spark, f"file://{tmp_path}/state", ["k"], "v", lag=3)
    data, seen, done = [("a", 1), ("b", 2), ("b", 2), (None, 2), ("n", None)], [], set()
    table = lambda: spark.createDataFrame(data, "k string, v bigint")

    def take(df, run):
        if run not in done:
            seen.extend(map(tuple, df.collect()))
            done.add(run)

    def lost_before(df, run):
        raise OSError("lost")

    def lost_after(df, run):
        take(df, run)
        raise OSError("lost")

    assert reader.run(table(), take) == 1
    data += [("c", 2), ("a", 3)]  # c is late: its transaction was open at the last run
    with pytest.raises(OSError):
        reader.run(table(), lost_before)
    data += [("d", 4)]
    with pytest.raises(OSError):
        reader.run(table(), lost_after)  # the batch of the plan, without d
    assert reader.run(table(), take) == 2 and reader.run(table(), take) == 3 and reader.run(table(), take) == 4
    assert sorted(seen, key=str) == sorted([("a", 1), ("a", 3), ("b", 2), ("c", 2), ("d", 4), (None, 2)], key=str)
    data += [("e", 9), ("f", 5), ("z", 0)]
    assert reader.run(table(), take) == 5 and sorted(seen[6:]) == [("e", 9), ("f", 5)]  # z lies before the open point
    data += [("g", 5), ("h", 6)]
    assert reader.run(table(), take) == 6 and sorted(seen[8:]) == [("h", 6)]
    whole = [r for r in reader._records("json") if r["whole"]]
    assert [r["run"] for r in whole] == [3, 6] and len(reader.files.list(reader.state + "/data")) <= 6
    # of two runs at once the second is refused

    def other_first(df, run):
        incremental.IncrementalReader(spark, reader.state, ["k"], "v", lag=3).run(table(), take)

    data += [("i", 9)]
    with pytest.raises(Conflict):
        reader.run(table(), other_first)
    assert seen.count(("i", 9)) == 1 and reader.run(table(), take) == 8 and len(seen) == len(set(seen))


# -- 2


def store_types(spark, rows=None):
    rows = rows or [(s, 1, "m:Thing", "a,b,c,d", T0, 9) for s in range(3)]
    return spark.createDataFrame(rows, TYPES)


@pytest.mark.parametrize("small", [True, False])
def test_orphans(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(orphans, "if_small", lambda df: df)
    rows = log(random.Random(5))
    got = {tuple(r) for r in orphans.find_orphans(objects(spark, rows), store_types(spark)).select("store_id", "oid", "field", "ref_oid").collect()}
    now = current(rows)
    live = {k for k, (_, p) in now.items() if p is not None}
    want = {(s, o, "abcd"[pos], ref) for s, o in live for pos, ref in payload_refs(now[s, o][1]) if (s, ref) not in live}
    assert got == want and want
    counts = orphans.orphan_counts(objects(spark, rows), store_types(spark)).collect()
    assert sum(r["orphans"] for r in counts) == len(want) and {r["name"] for r in counts} == {"m:Thing"}


def test_orphans_odd(spark):
    rows = [obj(0, 1, 1, ["a", "b", "c", "d", {"$ref": 3}]), obj(0, 2, 1, [{"$ref": 1}, {"$ref": "x"}, {"$ref": 3, "n": 1}, '{"$ref": 9}']), obj(7, 3, 1, [{"$ref": -5}]), obj(0, 9, 1, "no list")]
    got = {tuple(r) for r in orphans.find_orphans(objects(spark, rows), store_types(spark)).select("store_id", "oid", "field", "ref_oid").collect()}
    assert got == {(0, 1, None, 3), (7, 3, None, -5)}
    assert orphans.find_orphans(objects(spark, []), store_types(spark)).count() == 0
    assert payload_refs(None) == payload_refs("{") == payload_refs("") == [] and payload_refs('[[{"$ref":1}],{"a":{"b":{"$ref":1}}}]') == [(0, 1), (1, 1)]


def test_field_lists(spark):
    texts = ["a\x1fb", "a, b", '["a", "b"]', "a", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(split_fields(F.col("t"))).collect()]
    assert got == [["a", "b"]] * 3 + [["a"], [], None]


# -- 3


def feed(rng):
    rows = []
    for tid in range(80, 130):
        for store in range(3):
            top = rng.choice([1, 1, 1, 2, 3])
            for attempt in range(1, top + 1):
                for _ in range(rng.choice([1, 2])):
                    oids = rng.sample(range(70), 6)
                    recs = [(2**40 + o, 1, rng.choice([tid, None, 5]), json.dumps([tid, attempt])) for o in oids[:4]]
                    rows.append((store, tid, attempt, 1, T0, rng.choice([recs, recs, None, []]), rng.choice([None, [], [2**40 + o for o in oids[4:]]]), T0, 3))
    rng.shuffle(rows)
    return rows + rows[:10] + [(None, 1, 1, 1, T0, [(1, 1, 1, "[]")], [1], T0, 3), (1, None, 1, 1, T0, None, None, T0, 3), (0, 200, None, 1, None, [(None, 1, 1, "[]"), (77, 1, 1, None)], [None], None, 3)]


@pytest.mark.parametrize("seed", [3, 4])
def test_rebuilt_records(spark, seed):
    rng = random.Random(seed)
    rows, batches = log(rng), feed(rng)
    got = [tuple(r) for r in cdc_apply.rebuilt_records(objects(spark, rows), spark.createDataFrame(batches, BATCH)).select("store_id", "oid", "tid", "payload").collect()]
    ops = [(r[0], r[1], r[3], r[4] is None, r[4]) for r in intact(rows)]
    top = {}
    for b in batches:
        if None not in (b[0], b[1]):
            top[b[0], b[1]] = max(top.get((b[0], b[1]), -1), b[2] or -1)
    for b in batches:
        if None not in (b[0], b[1]) and (b[2] or -1) == top[b[0], b[1]]:
            ops += [(b[0], o, b[1], p is None, p) for o, _, _, p in b[5] or [] if o is not None] + [(b[0], o, b[1], True, None) for o in b[6] or [] if o is not None]
    best = {}
    for s, o, t, gone, p in ops:
        best[s, o] = max(best.get((s, o), (-1, False, "")), (t, gone, p or ""))
    want = {(s, o, t, p) for (s, o), (t, gone, p) in best.items() if not gone}
    assert set(got) == want and len(got) == len(want)


def test_feed_in_steps(spark, folder):
    """Applying the changes in any portions, twice, ends in the same state; the tombstone keeps a late write out."""
    changes = [(1, 1, 5, False, 1, "[5]"), (1, 1, 9, True, None, None), (1, 1, 7, False, 1, "[7]"), (1, 2, 3, False, 1, "[3]"), (1, 2, 3, False, 1, "[4]"), (1, 3, 2, True, None, None), (1, 3, 2, False, 1, "[2]")]
    for part in (changes[:2], changes[2:], changes, []):
        cdc_apply.apply_feed(spark, folder, spark.createDataFrame(part, cdc_apply.STATE))
    assert [tuple(r) for r in cdc_apply.read_state(spark, folder).select("oid", "tid", "payload").collect()] == [(2, 3, "[4]")]
    assert cdc_apply.rebuilt_records(objects(spark, []), spark.createDataFrame([], BATCH)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_feeds_in_any_order(spark, seed):
    """Deliveries in several feeds, higher attempts before or after lower ones, end as they do all at once."""
    rng = random.Random(seed)
    rows, batches = log(rng), feed(rng)
    rng.shuffle(batches)
    cut = sorted(rng.sample(range(len(batches)), 2))
    parts = [spark.createDataFrame(p, BATCH) for p in (batches[: cut[0]], batches[cut[0] : cut[1]], batches[cut[1] :])]
    cols = ["store_id", "oid", "tid", "payload"]
    want = {tuple(r) for r in cdc_apply.rebuilt_records(objects(spark, rows), spark.createDataFrame(batches, BATCH)).select(*cols).collect()}
    got = cdc_apply.applied_feeds(objects(spark, rows), parts).select(*cols).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_higher_attempt_later(spark, folder):
    """What a lower attempt alone wrote is taken back: to the version before, or to nothing."""
    row = lambda oid, tid, payload, attempt: (1, oid, tid, payload is None, 1, payload, attempt)
    state = cdc_apply.BucketedState(spark, folder)
    steps = [[row(1, 1, "a", None)], [row(1, 2, "b", 1), row(2, 2, "c", 1), row(3, 3, "d", 1)], [row(4, 2, "e", 2)], [row(2, 2, "late", 1)]]
    for step in steps:
        state.apply(spark.createDataFrame(step, cdc_apply.CHANGES))
    assert {(r["oid"], r["payload"]) for r in cdc_apply.read_state(spark, folder).collect()} == {(1, "a"), (3, "d"), (4, "e")}


def test_feed_touches_its_buckets(spark, folder, monkeypatch):
    """A state 1,000 times the feed: other buckets stay where they are; a state that outgrows its buckets gets more; two appliers can't lose a feed."""
    many = spark.range(20_000).selectExpr("cast(1 as int) as store_id", "id as oid", "cast(1 as bigint) as tid", "false as deleted", "cast(1 as int) as cid", "concat('[', id, ']') as payload")
    monkeypatch.setattr(cdc_apply, "BUCKET_BYTES", 5_000)
    state = cdc_apply.BucketedState(spark, folder)
    first = state.apply(many)
    assert first["buckets"] >= 4
    few = spark.createDataFrame([(1, i, 2, i % 2 == 0, 1, None if i % 2 == 0 else "new") for i in range(3)], cdc_apply.STATE)
    second = state.apply(few)
    moved = [b for b, v in second["places"].items() if v == second["version"]]
    assert second["buckets"] == first["buckets"] and 1 <= len(moved) <= 3 < len(second["places"])
    assert cdc_apply.read_state(spark, folder).count() == 19_998 and cdc_apply.read_state(spark, folder).where("payload = 'new'").count() == 1
    other, head = cdc_apply.BucketedState(spark, folder), state.head
    stale = head()
    monkeypatch.setattr(other, "head", lambda: stale)
    state.apply(spark.createDataFrame([(1, 7, 3, False, 1, "mine")], cdc_apply.STATE))
    with pytest.raises(Conflict):
        other.apply(spark.createDataFrame([(1, 8, 3, False, 1, "theirs")], cdc_apply.STATE))
    assert cdc_apply.read_state(spark, folder).where("payload in ('mine', 'theirs')").count() == 1
    monkeypatch.setattr(cdc_apply, "BUCKET_BYTES", 500)
    third = state.apply(few)
    assert third["buckets"] > second["buckets"] and cdc_apply.read_state(spark, folder).count() == 19_998
    state.vacuum()
    assert cdc_apply.read_state(spark, folder).count() == 19_998 and {v for v in third["places"].values()} == {third["version"]}


# -- 4


def term(go_id, parents, tid=1):
    return (go_id, "n", None, parents, tid, T0, "clash", "clash")


def graph(rng, n=120, loops=6):
    rows = [term(f"DT:{i:03d}", [rng.choice([f"DT:{j:03d}", f" dt:{j:03d} ! name", f"DT:{j:03d}\t"]) for j in (rng.randrange(max(i, 1)) for _ in range(rng.choice([0, 1, 1, 2])))] if i else []) for i in range(n)]
    up = lambda i: int(rows[i][3][0].strip().upper()[3:6]) if rows[i][3] else i
    for _ in range(loops):
        b = rng.randrange(n // 2, n)
        a = b
        for _ in range(rng.choice([1, 2, 3])):
            a = up(a)
        rows.append(term(f"DT:{a:03d}", [f"DT:{b:03d}"], 5))
    return rows + [term("DT:500", ["DT:500", None, "", "!x", "DT:nowhere"]), term("DT:501", None), term(None, ["DT:001"])] + rows[:9]


def plain_links(rows):
    best = {}
    for r in rows:
        if r[0] is not None and (r[0] not in best or (r[4], r[3] or []) > (best[r[0]][4], best[r[0]][3] or [])):
            best[r[0]] = r
    ids = {g.lower(): g for g in best}
    return {g: {ids[e.split("!")[0].strip().lower()] for e in r[3] or [] if e and e.split("!")[0].strip().lower() in ids} for g, r in best.items()}


def up_from(links, g):
    seen, todo = set(), list(links[g])
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += links[x]
    return seen


@pytest.mark.parametrize("merge_rows", [None, 20])
@pytest.mark.parametrize("seed", [11, 21])
def test_cycles(spark, seed, merge_rows):
    """With few rows to a part the forest is finished by joins."""
    rows = graph(random.Random(seed))
    links = plain_links(rows)
    above = {g: up_from(links, g) for g in links}
    want = {(min(x for x in above[g] if g in above[x]), g) for g in links if g in above[g]}
    df = hierarchy.parent_links(hierarchy.current_terms(spark.createDataFrame(rows, TERMS)))
    assert {(r["child"], r["parent"]) for r in df.collect()} == {(a, b) for a, bs in links.items() for b in bs}
    assert {tuple(r) for r in hierarchy.cyclic_terms(df, merge_rows).collect()} == want and len(want) > 3


def test_cycles_within_cycles(spark):
    """Dense links, where contracted cycles lie on further cycles."""
    for seed in range(3):
        rng = random.Random(seed)
        links = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
        up = {n: {b for a, b in links if a == n} for n in range(30)}
        above = {n: up_from(up, n) for n in up}
        want = {frozenset(x for x in above[n] if n in above[x]) for n in up if n in above[n]}
        got = {}
        for r in hierarchy.cyclic_nodes(spark.createDataFrame(list(links), "child bigint, parent bigint"), 7 if seed else None).collect():
            got.setdefault(r["cycle"], set()).add(r["node"])
        assert {frozenset(x) for x in got.values()} == want


def test_settle():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(1, 40)
        up = {i: rng.randrange(n) for i in range(n) if rng.random() < 0.9}
        up = {a: b for a, b in up.items() if a != b}
        node, first = np.array(list(up), np.int64), np.array(list(up.values()), np.int64)
        rings = hierarchy.ring_labels(node, first)
        # settled in two parts first, then together
        part = np.array([rng.random() < 0.5 for _ in up], bool)
        top, off, bound = first.copy(), np.ones(len(up), np.int64), np.zeros(len(up), np.int64)
        for p in (part, ~part, part | ~part):
            top[p], off[p], bound[p] = hierarchy.settle(node[p], top[p].copy(), off[p].copy(), bound[p].copy())
        for x0, t, o, b, ring in zip(node, top, off, bound, rings):
            trail, x = [], x0
            while x in up and x not in trail:
                trail.append(x)
                x = up[x]
            if x not in up:
                assert (t, o, b, ring) == (x, len(trail), 0, -1)
            else:
                cycle = trail[trail.index(x) :]
                assert b == 1 and ring == (min(cycle) if x0 in cycle else -1)
    none = np.zeros(0, np.int64)
    assert all(len(c) == 0 for c in hierarchy.settle(none, none, none, none)) and len(hierarchy.ring_labels(none, none)) == 0


def test_many_paths(spark):
    """A ladder of 60 terms has a thousand million paths, but few pairs; the paths of some terms can be listed alone."""
    rows = [term(f"L{i:02d}{s}", [f"L{i - 1:02d}a", f"L{i - 1:02d}b"] if i else None) for i in range(30) for s in "ab"]
    df = spark.createDataFrame(rows, TERMS)
    below = hierarchy.descendants(df).collect()
    assert len(below) == 4 * sum(range(30)) and all(r["distance"] == int(r["go_id"][1:3]) - int(r["ancestor"][1:3]) for r in below)
    summary = {r["go_id"]: r for r in hierarchy.node_summary(df).collect()}
    assert tuple(summary["L29a"])[1:] == (29, 2, 58, 0) and tuple(summary["L00b"])[1:] == (0, 1, 0, 58)
    assert hierarchy.all_paths(df, spark.createDataFrame([("L03a",), ("L00b",)], "go_id string")).count() == 9
    assert hierarchy.cyclic_terms(hierarchy.parent_links(hierarchy.current_terms(df))).count() == 0


def test_paths(spark):
    """A root above a cycle keeps the cycle's terms and all below them; a cycle without parents is a root itself."""
    rows = [term("R", None), term("A", ["R", "B"]), term("B", ["C"]), term("C", ["A"]), term("D", ["B", "R"]), term("E", ["D"]), term("X", ["Y"]), term("Y", ["X"]), term("Z", ["Y"]), term("S", ["S"])]
    df = spark.createDataFrame(rows, TERMS)
    got = {(r["go_id"], r["root"], r["depth"], r["from_cycle"], "/".join(r["path"])) for r in hierarchy.all_paths(df).collect()}
    assert got == {
        ("R", "R", 0, False, "R"), *((g, "R", 1, False, "R/A") for g in "ABC"), ("D", "R", 1, False, "R/D"), ("D", "R", 2, False, "R/A/D"), ("E", "R", 2, False, "R/D/E"), ("E", "R", 3, False, "R/A/D/E"),
        ("X", "X", 0, True, "X"), ("Y", "X", 0, True, "X"), ("Z", "X", 1, True, "X/Z"), ("S", "S", 0, True, "S"),
    }


@pytest.mark.parametrize("seed", [12, 13])
def test_descendants(spark, seed):
    rows = graph(random.Random(seed), 60, 4)
    links = plain_links(rows)
    want = {}
    for g in links:
        front, distance = {g}, 0
        while front:
            distance += 1
            front = {p for x in front for p in links[x]} - {a for a, b in want if b == g} - {g}
            want |= {(a, g): distance for a in front}
    got = hierarchy.descendants(spark.createDataFrame(rows, TERMS)).collect()
    assert len(got) == len(want) and {(r["ancestor"], r["go_id"]): r["distance"] for r in got} == want
    roots = {(r["go_id"], r["root"]) for r in hierarchy.all_paths(spark.createDataFrame(rows, TERMS)).collect() if not r["from_cycle"]}
    tops = {g for g in links if not links[g]}
    assert roots == {(g, t) for g in links for t in tops if t == g or t in up_from(links, g)}
    summary = {r["go_id"]: r for r in hierarchy.node_summary(spark.createDataFrame(rows, TERMS)).collect()}
    assert set(summary) == set(links)
    for g, r in summary.items():
        own = {a: d for (a, x), d in want.items() if x == g}
        assert r["depth"] == (0 if g in tops else min((d for a, d in own.items() if a in tops), default=None)) and r["ancestors"] == len(own)
        assert r["roots"] == (1 if g in tops else len(tops & set(own))) and r["descendants"] == sum(a == g for a, _ in want)
    assert hierarchy.descendants(spark.createDataFrame([], TERMS)).count() == hierarchy.all_paths(spark.createDataFrame([], TERMS)).count() == 0


def test_deep_chain(spark):
    rows = [term(f"T{i:04d}", [f"T{i - 1:04d}"] if i else ["T0700"]) for i in range(701)]
    found = hierarchy.cyclic_terms(hierarchy.parent_links(hierarchy.current_terms(spark.createDataFrame(rows, TERMS))))
    assert {tuple(r) for r in found.collect()} == {("T0000", f"T{i:04d}") for i in range(701)}


@pytest.mark.parametrize("merge_rows", [None, 30])
def test_peeled(spark, tmp_path, monkeypatch, merge_rows):
    """What hangs above and below the cycles is peeled off before forests are built, however deep it hangs."""
    rng = random.Random(4)
    rows = [term(f"T{i:04d}", [f"T{rng.randrange(i):04d}" for _ in range(rng.choice([1, 1, 2]))] if i else None) for i in range(600)]
    rows += [term(f"C{i}", [f"C{(i + 1) % 4}", *["T0007"] * (i == 0)]) for i in range(4)] + [term("T0300", ["T0007", "C2 ! below a cycle"], 2)]
    spark.createDataFrame(rows, TERMS).write.parquet(str(tmp_path / "terms.parquet"))
    given, forest = [], hierarchy.forest
    monkeypatch.setattr(hierarchy, "forest", lambda chosen, rows, most: given.append(rows) or forest(chosen, rows, most))
    if merge_rows:
        monkeypatch.setattr(hierarchy, "MERGE_ROWS", merge_rows)
    assert {tuple(r) for r in training.p4_found(spark, str(tmp_path)).collect()} == {("C0", f"C{i}") for i in range(4)}
    assert 4 <= given[0] < 30


@pytest.mark.parametrize("kinds", [1, 40])
def test_equal_hashes(spark, monkeypatch, kinds):
    """Terms of equal hash may keep links from being peeled off, but lose no cycle."""
    rows = graph(random.Random(31)) + [term("dt:003", ["DT:002"]), term("X", ["Y"]), term("Y", ["x "])]
    ids, links = {}, {}
    for r in rows:
        ids.setdefault((r[0] or "").lower(), set()).add(r[0])
    best = {}
    for r in rows:
        if r[0] is not None and (r[0] not in best or (r[4], r[3] or []) > best[r[0]]):
            best[r[0]] = (r[4], r[3] or [])
    for g, (_, parents) in best.items():
        links[g] = {p for e in parents if e and e.split("!")[0].strip() for p in ids.get(e.split("!")[0].strip().lower(), ())}
    above = {g: up_from(links, g) for g in links}
    want = {(min(x for x in above[g] if g in above[x]), g) for g in links if g in above[g]}
    monkeypatch.setattr(hierarchy, "_hash", lambda name: F.pmod(F.xxhash64(name), F.lit(kinds)).cast("bigint"))
    assert {tuple(r) for r in hierarchy.term_cycles(spark.createDataFrame(rows, TERMS)).collect()} == want and len(want) > 5
    assert hierarchy.term_cycles(spark.createDataFrame([], TERMS)).count() == 0


# -- 5


def test_assignment():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for n, m in ((1, 1), (2, 3), (3, 3), (4, 5)):
        for _ in range(20):
            s = rng.random((n, m)).round(1)
            best = max(sum(s[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
            got = drift.assign(s)
            assert len(set(got)) == n and sum(s[i, j] for i, j in enumerate(got)) == pytest.approx(best)


def test_matching():
    c = lambda old, new, score: {"old": old, "new": new, "score": score}
    # two new fields declare one vanished field: both are its renames
    both = drift.match_columns([c("home", "a", 101.0), c("home", "b", 101.0), c("x", "a", 2.0), c("x", "b", 2.0)])
    assert {(m["old"], m["new"]) for m in both} == {("home", "a"), ("home", "b")}
    assert {(m["old"], m["new"]) for m in drift.match_columns([c("p", "q", 1.0), c("p", "r", 2.0)])} == {("p", "r")}


def test_drift(spark):
    types = [
        (0, 1, "m:Thing", "a,b,c", T0, 1), (0, 3, "m:Thing", '["a", "bee", "c", "e"]', T0, 1), (0, 3, "m:Thing", "a\x1fbee\x1fc\x1fe", T0, 1), (0, 5, "m:Thing", "e,c,a", T0, 1),
        (0, 2, "m:Other", "a", T0, 1), (1, 1, "m:Thing", "z", T0, 1), (None, 1, "m:Thing", "z", T0, 1), (1, 2, None, "z", T0, 1),
    ]
    specs = [("m:Thing", "bee", "string", None, "b", False), ("m:Thing", "e", "int", None, "nothing", False), ("m:Other", "c", None, None, "a", None), (None, None, None, None, None, None)]
    rows = [obj(0, i, 1, [i, "x", 1.5], cid=1) for i in range(5)] + [obj(0, 9, 1, ["s", "x", 1.5], cid=1)]
    rows += [obj(0, i, 2, ["s", i, None, {"$ref": 1}], cid=3) for i in range(4)] + [obj(0, i, 2, ["s", "t", None, {"x": 1}], cid=3) for i in (10, 11, 12, 13)]
    rows += [obj(0, 20, 3, [True, 2, "s", "extra"], cid=5), obj(0, 21, 3, [True, 2.0, "s"], cid=5, good=False), obj(0, 22, 3, "no list", cid=5)]
    rows += rows[:6]
    d = drift.Drift(objects(spark, rows), spark.createDataFrame(types, TYPES), spark.createDataFrame(specs, SPECS))
    got = {tuple(r) for r in d.changes().collect()}
    assert got == {(0, 3, "bee", "renamed"), (0, 3, "e", "added"), (0, 3, "a", "retyped"), (0, 3, "bee", "retyped"), (0, 5, "bee", "removed"), (0, 5, "e", "retyped")}
    unified = {(r["oid"], r["tid"]): r["row"] for r in d.unified().collect()}
    assert unified[0, 1] == {"a": "0", "bee": "x", "c": "1.5"} and unified[20, 3] == {"e": "true", "c": "2", "a": "s"}
    table = drift.type_table(d.unified(), "m:Thing", {"a": "bigint", "bee": "string", "e": "boolean"})
    assert {(r["a"], r["bee"]) for r in table.where("oid = 9").collect()} == {(None, "x")}
    empty = drift.Drift(objects(spark, []), spark.createDataFrame([], TYPES), spark.createDataFrame([], SPECS))
    assert empty.changes().count() == 0 and empty.unified().count() == 0


def test_one_name_per_type(spark):
    """A rename holds in a store that never made it, and in shapes after the step, unless the shape holds the new name too."""
    types = [(0, 1, "m:Thing", "x,mass_g", T0, 1), (0, 2, "m:Thing", "x,mass", T0, 1), (0, 3, "m:Thing", "mass_g,y", T0, 1), (1, 1, "m:Thing", "mass_g", T0, 1), (1, 2, "m:Thing", "mass_g,mass", T0, 1), (1, 3, "m:Other", "mass_g", T0, 1)]
    specs = [("m:Thing", "mass", "float", None, "mass_g", False), ("m:Thing", "x", "int", None, None, False)]
    rows = [obj(0, 1, 1, [1, 2], cid=1), obj(0, 1, 2, [1, 3], cid=2), obj(0, 1, 3, [4, 5], cid=3), obj(1, 1, 4, [6], cid=1), obj(1, 1, 5, [7, 8], cid=2), obj(1, 2, 6, [9], cid=3)]
    d = drift.Drift(objects(spark, rows), spark.createDataFrame(types, TYPES), spark.createDataFrame(specs, SPECS))
    got = {r["tid"]: r["row"] for r in d.unified().collect()}
    assert got == {1: {"x": "1", "mass": "2"}, 2: {"x": "1", "mass": "3"}, 3: {"mass": "4", "y": "5"}, 4: {"mass": "6"}, 5: {"mass_g": "7", "mass": "8"}, 6: {"mass_g": "9"}}
    # the chain of renames is followed to its end; two fields declared from one both have its value
    names = lambda fields, *pairs: drift.unified_names(fields, [{"old": o, "new": n} for o, n in pairs])
    assert names(["a", "z"], ("a", "b"), ("b", "c")) == [["c"], ["z"]]
    assert names(["home"], ("home", "seat"), ("home", "sponsor")) == [["seat", "sponsor"]] and names(["home", "sponsor"], ("home", "seat"), ("home", "sponsor")) == [["seat"], ["sponsor"]]
    assert names(["p", "q"], ("p", "r"), ("q", "r")) == [["r"], ["q"]] and names(["a"], ("a", "b"), ("b", "a")) == [["b"]] and names(["a", "a"]) == [["a"], []]


def test_undeclared_renames(spark):
    """A rename that nobody declared shows in names, kinds and values: it is no `renamed` in the report but unifies the columns, in a store that never made it too."""
    types = [(0, 1, "m:Thing", "no,last_kind", T0, 1), (0, 2, "m:Thing", "no,latest_kind,extra", T0, 1), (1, 1, "m:Thing", "last_kind,no", T0, 1)]
    kinds = ["red", "green", "blue", "black"]
    rows = [obj(0, i, 1, [i, kinds[i % 4]], cid=1) for i in range(12)] + [obj(0, i, 2, [i, kinds[i % 4], i], cid=2) for i in range(12)] + [obj(1, 1, 3, ["red", 1.5], cid=1), obj(1, 2, 3, ["red", 2, "more", None], cid=1), obj(1, 3, 3, [1], cid=9), obj(1, 4, 3, "no list", cid=1)]
    d = drift.Drift(objects(spark, rows), spark.createDataFrame(types, TYPES), spark.createDataFrame([], SPECS))
    found = drift.materialize(d.matches(), "matches")
    assert [(r["old"], r["new"], r["declared"]) for r in d.likely(found).collect()] == [("last_kind", "latest_kind", False)]
    assert {tuple(r) for r in d.changes(found).collect()} == {(0, 2, "latest_kind", "added"), (0, 2, "extra", "added"), (0, 2, "last_kind", "removed")}
    got = {(r["store_id"], r["oid"], r["tid"]): (r["row"], r["rest"]) for r in d.unified(found).collect()}
    assert got[0, 3, 1] == ({"no": "3", "latest_kind": "black"}, None) and got[1, 1, 3] == ({"latest_kind": "red", "no": "1.5"}, None)
    assert got[1, 2, 3] == ({"latest_kind": "red", "no": "2"}, '["more",null]') and got[1, 3, 3] == (None, "[1]") and got[1, 4, 3][0] is None and len(got) == 28
    assert d.unified().where("row['last_kind'] is not null").count() == 14
    assert {tuple(r) for r in d.columns(found).select("field", "kind").collect()} == {("no", "float"), ("latest_kind", "string"), ("extra", "int")}
    table = d.table("m:Thing", found)
    assert dict(table.dtypes)["no"] == "double" and {r["latest_kind"] for r in table.where("no = 1.5").collect()} == {"red"} and table.count() == 27


def test_kinds():
    assert kind_letters('[true, 1, 1.0, 1e3, "s", {"$ref": 1}, [1], {"$ref": 1, "a": 2}, null]') == "biffsrlmn"
    assert kind_letters("{}") is kind_letters(None) is kind_letters("[1") is None and kind_letters("[]") == ""
