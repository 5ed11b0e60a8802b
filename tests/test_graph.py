"""The registered walks over terms."""

from datetime import datetime

from stratagraph.operators.graph import closure, edges
from stratagraph.plans.extent import Extent
from stratagraph.queries import reference
from stratagraph.runtime import HadoopFiles, materialize, scratch
from stratagraph.schema import OID, EntityType, Field

TERMS = "go_id string, name string, namespace string, parents array<string>, tid bigint, stored_at timestamp_ntz"


def test_closure(spark, tmp_path):
    """Terms more than six links below a root, and beyond a cycle, are reached at their least depth."""
    parents = {f"T{i}": [f"T{i - 1}"] if i else None for i in range(10)} | {"T3": ["T2", "T8"], "U": ["T9", "T0"]}
    rows = [(g, "n", None, p, 1, datetime(2024, 1, 1)) for g, p in parents.items()]
    spark.createDataFrame(rows, TERMS).write.parquet(f"{tmp_path}/terms.parquet")
    got = [tuple(r) for r in reference.QUERIES["closure_depth"](spark, str(tmp_path)).select("seed", "node", "depth").collect()]
    assert sorted(got) == sorted([("T0", f"T{i}", i) for i in range(10)] + [("T0", "U", 1)])


def test_closure_bounds(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0), (3, 3), (None, 1), (1, None)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0,), (10,)], f"{OID} bigint")
    walk = lambda n: {tuple(r) for r in closure(links, seeds, max_depth=n).select("seed", "node", "depth").collect()}
    whole = {(0, i, i) for i in range(13)} | {(10, (10 + i) % 13, i) for i in range(13)}
    assert walk(None) == whole and all(walk(n) == {w for w in whole if w[2] <= n} for n in (0, 1, 4, 6))


def test_references_at_any_depth(spark):
    kind = EntityType("Deep", {"one": Field("bigint", ref="X"), "many": Field("array<bigint>", ref="X"), "by": Field("map<string,array<bigint>>", ref="X"), "in_": Field("struct<a:bigint,b:array<struct<c:bigint,d:string>>>", ref="X")})
    rows = spark.createDataFrame([(1, 7, [8, 8, None], {"k": [9], "l": None}, (10, [(11, "t"), (None, None)])), (2, None, None, None, None), (3, None, [], {}, (None, []))], f"{OID} bigint, " + ", ".join(f"{n} {f.type}" for n, f in kind.fields.items()))
    got = {tuple(r) for r in edges(Extent(rows, kind)).select("src", "field", "dst").collect()}
    assert got == {(1, "one", 7), (1, "many", 8), (1, "by", 9), (1, "in_", 10), (1, "in_", 11)}


def test_scratch(spark):
    with scratch(spark):
        path = materialize(spark.range(3), "gone").inputFiles()[0].rsplit("/", 1)[0]
        kept = HadoopFiles(spark, path).exists(path)
    assert kept and not HadoopFiles(spark, path).exists(path)
