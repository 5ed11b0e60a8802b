"""Problem 2: references to records that do not exist.

The live parent keys of a store are compressed into contiguous runs; a reference is matched to the last run that
starts at or before it, and is an orphan if it lies beyond that run's end. Runs are kept in blocks of BLOCK keys, so a
store of any size spreads over many groups and a group never has more than BLOCK keys.

Defined results: rows with a null key or a wrong checksum don't count; a payload that is no JSON array has no
references; a reference repeated within a field counts once; a field position beyond the shape, or a shape that is
missing, gives a null field; commit times that are null are taken from the same commit's other rows, else the month is
null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import intact_rows, latest, refs_of, split_fields
from ..runtime import if_small, materialize

BLOCK = 256


def live_records(objects: DataFrame, carry: tuple[str, ...] = ("cid", "payload")) -> DataFrame:
    """(store_id, oid, tid, *carry) of each record whose current version has a payload."""
    rows = intact_rows(objects).withColumn("_live", F.col("payload").isNotNull())
    return latest(rows, ["store_id", "oid"], ["tid", "_live"], list(carry)).where("_live").drop("_live")


def shapes(store_types: DataFrame) -> DataFrame:
    """(store_id, cid, name, fields): one row per shape; of rows that differ, the one recorded last."""
    rows = store_types.where(F.col("store_id").isNotNull() & F.col("cid").isNotNull()).select(
        "store_id", "cid", "recorded_at", "name", split_fields(F.col("fields")).alias("fields")
    )
    return latest(rows, ["store_id", "cid"], ["recorded_at"], ["name", "fields"]).drop("recorded_at")



def key_runs(keys: DataFrame) -> DataFrame:
    """(store_id, block, starts, ends): the sorted keys of each block as contiguous runs."""
    grouped = keys.groupBy("store_id", F.shiftright("oid", 8).alias("block")).agg(F.sort_array(F.collect_set("oid")).alias("k"))
    k = F.col("k")
    return grouped.select(
        "store_id",
        "block",
        F.filter(k, lambda x, i: (i == 0) | (F.get(k, i - 1) != x - 1)).alias("starts"),
        F.filter(k, lambda x, i: (i == F.size(k) - 1) | (F.get(k, i + 1) != x + 1)).alias("ends"),
    )


def orphan_refs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of refs (store_id, ref_oid, ...) that no run holds."""
    r = runs.select(F.col("store_id").alias("r_store_id"), F.col("block").alias("r_block"), "starts", "ends")
    on = (F.col("store_id") == F.col("r_store_id")) & (F.shiftright("ref_oid", 8) == F.col("r_block"))
    matched = refs.join(if_small(r), on, "left")
    preceding = F.size(F.filter("starts", lambda s: s <= F.col("ref_oid")))
    end = F.get("ends", preceding - 1)
    return matched.where(F.col("starts").isNull() | (preceding == 0) | (F.col("ref_oid") > end)).select(*refs.columns)


def find_orphans(objects: DataFrame, store_types: DataFrame) -> DataFrame:
    """(store_id, oid, tid, name, field, ref_oid) of each distinct reference in a live record to no live record."""
    live = live_records(objects).select("store_id", "oid", "tid", "cid", refs_of("payload").alias("refs"))
    live = materialize(live, "live-refs")
    runs = materialize(key_runs(live.select("store_id", "oid")), "key-runs")
    refs = live.select("store_id", "oid", "tid", "cid", F.inline("refs")).withColumnRenamed("ref", "ref_oid")
    # a target that very many records refer to is looked up once
    lost = materialize(orphan_refs(refs.select("store_id", "ref_oid").distinct(), runs), "lost")
    found = refs.join(if_small(lost), ["store_id", "ref_oid"], "left_semi")
    return (
        found.join(shapes(store_types), ["store_id", "cid"], "left")
        .select("store_id", "oid", "tid", "name", F.get("fields", F.col("pos")).alias("field"), "ref_oid")
        .dropDuplicates(["store_id", "oid", "field", "ref_oid"])
    )


def orphan_counts(objects: DataFrame, store_types: DataFrame, period: str = "yyyy-MM") -> DataFrame:
    """(name, month, orphans, targets): orphans per type name and period of commit (period: a date pattern)."""
    commits = objects.where(F.col("committed_at").isNotNull()).groupBy("store_id", "tid").agg(F.max("committed_at").alias("committed_at"))
    return (
        find_orphans(objects, store_types)
        .join(commits, ["store_id", "tid"], "left")
        .groupBy("name", F.date_format("committed_at", period).alias("month"))
        .agg(F.count("*").alias("orphans"), F.countDistinct("store_id", "ref_oid").alias("targets"))
    )
