"""Exact vector search and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the rows serves, and rows scored at once against them (8 bytes a pair).
BLOCK_QUERIES, BLOCK_ROWS = 2048, 1024


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; null if a vector is null or the lengths differ."""
    wide = lambda x: x.cast("array<double>")
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, of another length, or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def nearest(rows: DataFrame, vector: str, key: str, query: list[float], k: int) -> DataFrame:
    """The k rows of greatest cosine to the query, ties by key; each task keeps its own k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(key, cosine(F.col(vector), q).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k)


def _matrix(vectors: pd.Series, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that have a cosine, and which they are: whole, not zero and, if given, of that width."""
    # nulls inside a vector come as NaN or None
    lists = [None if v is None else np.asarray(v, "float64") for v in vectors]
    good = np.array([v is not None and len(v) > 0 and (width is None or len(v) == width) and bool(np.isfinite(v).all()) and bool(v.any()) for v in lists], bool)
    return (np.stack([v for v, g in zip(lists, good) if g]) if good.any() else np.empty((0, width or 0))), good


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, summed in the order of the elements as dot() does, so that equal vectors score equally."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += a[:, i, None] * b[None, :, i]
    return out


def _own_norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * a[:, i]
    return np.sqrt(out)


def nearest_each(rows: DataFrame, vector: str, key: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, score, rank): for each query (query, vector) the k rows of greatest cosine, ties by key, ranks from 1.

    The queries come to the driver in blocks, and each block passes over all rows; each task keeps its own k per query,
    and the lists of the tasks are merged. Vectors that are null, zero or hold a null, NaN or infinity have no score,
    nor have vectors of different lengths.
    """
    spark = rows.sparkSession
    kinds = queries.schema["query"].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    schema = f"query {kinds[0]}, `{key}` {kinds[1]}, score double"
    # one length of vector to a block
    left = queries.where(F.col("vector").isNotNull()).select("query", "vector", F.size("vector").alias("n")).orderBy("n", "query").toLocalIterator()
    parts, ahead = [], []
    while block := ahead + list(islice(left, BLOCK_QUERIES - len(ahead))):
        same = [q for q in block if q["n"] == block[0]["n"]]
        ahead = block[len(same) :]
        matrix, good = _matrix(pd.Series([q["vector"] for q in same]))
        if good.any():
            shared = spark.sparkContext.broadcast((np.array([q["query"] for q, g in zip(same, good) if g], object), matrix, _own_norms(matrix)))
            parts.append(rows.select(key, vector).mapInPandas(_searcher(shared, key, vector, k), schema))
    if not parts:
        return spark.createDataFrame([], f"{schema}, rank int")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(key))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searcher(shared, key: str, vector: str, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, norms = shared.value
        least, found, waiting = np.full(len(ids), -np.inf), [], 0

        def best() -> pd.DataFrame:
            every = pd.concat(found).sort_values(["q", "score", key], ascending=[True, False, True])
            return every.groupby("q", sort=False).head(k)

        for b in batches:
            for start in range(0, len(b), BLOCK_ROWS):
                part = b.iloc[start : start + BLOCK_ROWS]
                against, good = _matrix(part[vector], matrix.shape[1])
                if not good.any():
                    continue
                scores = _dots(matrix, against) / (norms[:, None] * _own_norms(against)[None, :])
                if scores.shape[1] > k:
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                # all that tie with the least stay until the keys decide
                q, r = np.nonzero(scores >= least[:, None])
                found.append(pd.DataFrame({"q": q, key: part[key].to_numpy()[good][r], "score": scores[q, r]}))
                waiting += len(q)
                if waiting > 4 * k * len(ids):
                    found = [best()]
                    waiting = len(found[0])
                    full = found[0].groupby("q")["score"].agg(["size", "min"])
                    full = full[full["size"] == k]
                    least[full.index] = np.maximum(least[full.index], full["min"])
        if found:
            top = best()
            yield pd.DataFrame({"query": ids[top["q"]], key: top[key].to_numpy(), "score": top["score"].to_numpy()})

    return search


def fuse_ranked(found: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists that carry their ranks (key, rank), as fuse does it for lists that don't."""
    return found.groupBy(key).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def fuse(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, score): the sum of 1 / (k + rank), ranks from 1. Each list is ranked by itself."""
    named = reduce(DataFrame.unionByName, [x.select(key, "score", F.lit(n).alias("list")) for n, x in enumerate(lists)])
    order = Window.partitionBy("list").orderBy(F.desc("score"), F.asc(key))
    return fuse_ranked(named.withColumn("rank", F.row_number().over(order)), key, k)
