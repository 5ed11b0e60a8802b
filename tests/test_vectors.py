"""Search of many queries at once against a search of each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.functions import vectors

ROWS = "id bigint, v array<float>"


@pytest.mark.parametrize("block", [2048, 3])
def test_nearest_each(spark, block, monkeypatch):
    """Every query has its own list, whatever the blocks; equal vectors go by key."""
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(4)
    some = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]
    rows = spark.createDataFrame([*some, (900, None), (901, [0.0] * 4), (902, [1.0]), (903, [1.0, None, 1.0, 1.0])], ROWS).repartition(3)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("v").alias("vector"))
    got = {}
    for r in vectors.nearest_each(rows, "v", "id", queries, 7).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], round(r["score"], 9)))
    want = {i: [(r["id"], round(r["score"], 9)) for r in vectors.nearest(rows, "v", "id", v, 7).collect()] for i, v in some if i % 50 == 0 and any(v)}
    assert got == want and len(want) > 3


def test_fuse_ranked(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1)], "query int, key string, rank int")
    got = {r["key"]: r["score"] for r in vectors.fuse_ranked(ranked, "key").collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61})
