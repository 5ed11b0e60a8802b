"""Random conditions against a plain sweep over the same rows."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stratagraph.errors import QueryError
from stratagraph.plans.extent import Extent
from stratagraph.predicates import All, Any_, Leaf, Negation, Ref
from stratagraph.schema import OID, EntityType, Field, fields

T = EntityType("T", {
    "n": Field("bigint", index=True), "x": Field("double", sorted=True), "s": Field("string", index=True),
    "b": Field("boolean"), "tags": Field("array<string>", index=True),
})
NUMBERS = [None, -3, 0, 1, 2, 7, 2**63 - 1]
FLOATS = [None, float("nan"), -1.5, 0.0, 1.0, 2.5, float("inf")]
STRINGS = [None, "", "a", "ab", "ba", "5"]
LISTS = [None, [], ["a"], ["a", None], ["ab", "b"]]
ROWS = [(i, NUMBERS[i % 7], FLOATS[(i // 2) % 7], STRINGS[(i // 3) % 6], [None, True, False][i % 3], LISTS[(i // 5) % 5]) for i in range(210)]


def truth(c, row) -> bool:
    if isinstance(c, All):
        return all(truth(p, row) for p in c.parts)
    if isinstance(c, Any_):
        return any(truth(p, row) for p in c.parts)
    if isinstance(c, Negation):
        return not truth(c.part, row)
    a, v = row[c.field], c.value
    if c.op == "==":
        return a == v
    if c.op == "!=":
        return a != v
    if c.op == "in":
        return any(a == x for x in v)
    if c.op == "contains":
        return v in a if isinstance(a, list) else isinstance(a, str) and v in a
    if c.op == "startswith":
        return isinstance(a, str) and a.startswith(v)
    if a is None or v is None:
        return False
    return {"<": a < v, "<=": a <= v, ">": a > v, ">=": a >= v}[c.op]


def leaf(field, ops, values):
    return st.builds(lambda op, v: Leaf(T, field, op, v), st.sampled_from(ops), st.sampled_from(values))


ORDER, EQ = ["<", "<=", ">", ">="], ["==", "!="]
NUMERIC = [*NUMBERS, *FLOATS, True, 2**63, -(2**70), 6.5]
LEAVES = st.one_of(
    leaf("n", ORDER + EQ, NUMERIC), leaf("x", ORDER + EQ, NUMERIC), leaf("b", EQ, [None, True, False, 1, 0.0, 3]), leaf("s", EQ + ORDER, STRINGS),
    leaf("n", EQ, ["5", [1]]), leaf("s", EQ, [5, True]), leaf("s", ["contains", "startswith"], STRINGS[1:]), leaf("n", ["contains", "startswith"], ["1"]),
    leaf("tags", ["contains"], ["a", "b", ""]), leaf("tags", EQ, LISTS),
    st.builds(lambda f, v: Leaf(T, f, "in", tuple(v)), st.sampled_from(["n", "s", "x"]), st.lists(st.sampled_from(NUMBERS + STRINGS + FLOATS), max_size=4)),
)
TREES = st.recursive(LEAVES, lambda x: st.one_of(st.builds(lambda a, b: a & b, x, x), st.builds(lambda a, b: a | b, x, x), st.builds(lambda a: ~a, x)), max_leaves=6)


@pytest.fixture(scope="module")
def extent(spark):
    rows = spark.createDataFrame(ROWS, f"{OID} bigint, n bigint, x double, s string, b boolean, tags array<string>").cache()
    return Extent(rows, T)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cs=st.lists(TREES, min_size=12, max_size=12))
def test_random_conditions(extent, cs):
    """Twelve conditions at a time share one job: each becomes a flag on every row."""
    from pyspark.sql import functions as F

    got = {r[0]: r[1:] for r in extent.rows.select(OID, *[F.coalesce(c.holds(), F.lit(False)).alias(f"t{i}") for i, c in enumerate(cs)], *[F.coalesce(c.fails(), F.lit(False)).alias(f"f{i}") for i, c in enumerate(cs)]).collect()}
    for oid, n, x, s, b, tags in ROWS:
        row = {"n": n, "x": x, "s": s, "b": b, "tags": tags}
        for i, c in enumerate(cs):
            want = truth(c, row)
            assert got[oid][i] is want and got[oid][len(cs) + i] is (not want), (c, row)


def test_windows_and_order(extent):
    got = [r[0] for r in extent.query(order_by=("n", "desc")).select(OID).collect()]
    key = {r[0]: r[1] for r in ROWS}
    want = sorted((o for o in key if key[o] is not None), key=lambda o: (-key[o], o)) + sorted(o for o in key if key[o] is None)
    assert got == want
    pages = [r[0] for k in (0, 50) for r in extent.query(order_by=("n", "desc"), limit=50, offset=k).select(OID).collect()]
    assert pages == want[:100]
    with pytest.raises(TypeError):
        extent.query(limit=True)
    with pytest.raises(ValueError):
        extent.query(offset=-1)
    with pytest.raises(QueryError):
        extent.query(order_by="tags")
    with pytest.raises(QueryError):
        extent.query(order_by=("n", "down"))


def test_refusals():
    t = fields(T)
    other = EntityType("Other", {"n": Field("bigint")})
    with pytest.raises(QueryError, match="parentheses"):
        _ = t.s == (t.n == 1)
    with pytest.raises(QueryError, match="one type"):
        _ = (t.n == 1) & (fields(other).n == 1)
    with pytest.raises(QueryError):
        bool(t.n == 1)
    with pytest.raises(QueryError):
        _ = t.missing
    with pytest.raises(QueryError):
        (t.s < 5).holds()
    with pytest.raises(QueryError):
        (t.n == Ref(None)).holds()


def test_lookups(spark, extent):
    u = EntityType("U", {"k": Field("string", unique=True), "v": Field("int")})
    x = Extent(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], f"{OID} bigint, k string, v int"), u)
    assert [r["v"] for r in x.get_many(["b", "zz", "b", None], "k").collect()] == [2, None, 2, None]
    assert x.get(k="a").count() == 1 and x.get(k="zz").count() == 0
    assert [r["v"] for r in x.deref([2, 9], strict=False).collect()] == [2, None]
    from stratagraph.errors import DanglingRef

    with pytest.raises(DanglingRef):
        x.deref([2, 9])
    assert sorted(r[0] for r in x.fetch([1, 3, 77]).select(OID).collect()) == [1, 3]
    assert len(list(extent.query_iter())) == len(ROWS) and math.isnan(ROWS[2][2])
    plan = x.explain(fields(u).k == "a")
    assert plan.indexed and not plan.residual


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id n", "double(id) x", "string(id) s").write.parquet(f"{tmp_path}/t")
    e = EntityType("P", {"n": Field("bigint", sorted=True), "x": Field("double"), "s": Field("string")})
    x = Extent.of_table(spark.read.parquet(f"{tmp_path}/t"), e, "n")
    plan = x.explain((fields(e).n > 5) & (fields(e).s == "7") & ~(fields(e).n == 9))
    assert any("GreaterThan(n,5)" in p and "EqualTo(s,7)" in p for p in plan.pushed)
