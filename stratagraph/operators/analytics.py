"""Aggregates over extents and measures of ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, total, mean, low, high) of a value per group; null groups are left out, null values are skipped."""
    c = F.col(f"`{value}`")
    return (
        rows.where(F.col(f"`{by}`").isNotNull())
        .groupBy(by)
        .agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"))
    )


def live_counts(versions: DataFrame, types: str, key: list[str], tid: str, deleted: str) -> DataFrame:
    """(type, n): live records per type from a log of versions."""
    now = versions.groupBy(types, *key).agg(F.max(F.struct(tid, deleted)).alias("v"))
    return now.where(~F.col("v")[deleted]).groupBy(types).agg(F.count("*").alias("n"))


def relevance(ranked: DataFrame, judged: DataFrame, k: int = 10, recall_at: int = 100) -> DataFrame:
    """(query, ndcg, precision, recall, mrr) of ranked (query, doc, score) against judged (query, doc, grade).

    Ties of score go to the lesser doc; a query with judged documents and no hit scores zero.
    """
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc"))
    hits = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, recall_at))
    hits = hits.join(judged, ["query", "doc"], "left").fillna(0, ["grade"])
    gain = F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0)
    got = hits.groupBy("query").agg(
        F.sum(gain).alias("dcg"),
        F.sum(F.when((F.col("rank") <= k) & (F.col("grade") > 0), 1).otherwise(0)).alias("good"),
        F.sum(F.when((F.col("rank") <= recall_at) & (F.col("grade") > 0), 1).otherwise(0)).alias("found"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
    )
    best = Window.partitionBy("query").orderBy(F.desc("grade"), F.asc("doc"))
    ideal = (
        judged.where("grade > 0")
        .withColumn("rank", F.row_number().over(best))
        .groupBy("query")
        .agg(F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("ideal"), F.count("*").alias("relevant"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "query", "left").select(
        "query", zero(F.col("dcg") / F.col("ideal")).alias("ndcg"), zero(F.col("good") / F.lit(float(k))).alias("precision"),
        zero(F.col("found") / F.col("relevant")).alias("recall"), zero(1.0 / F.col("first")).alias("mrr"),
    )
