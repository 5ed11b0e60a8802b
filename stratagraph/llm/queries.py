"""Queries of the text problems (6 to 8), with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read_table
from . import leakage, mixture, splitting


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("item_id", "doc_id")


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return found.withColumn("kind", F.when(F.col("edits") == 0, "exact").otherwise("proximity"))


def p6_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact phrases of 12 words over the texts as they stand."""
    found = leakage.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), leakage.bare_words, exact=True)
    return found.select("item_id", "doc_id", "words")


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(read_table(spark, d, "documents"), read_table(spark, d, "mix_plans"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).where("not feasible").select("plan_id", "source").distinct()


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_plans"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d)


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether each plan row kept its cap, and met its target to 0.5 % or one document at each of its counts if it could, else gave all it has."""
    largest = mixture.sized(read_table(spark, d, "documents")).groupBy("source").agg(F.max("tokens").alias("largest"))
    rows = _shares(spark, d).join(largest, "source", "left")
    near = F.abs(F.col("tokens") - F.col("target")) <= F.greatest(0.005 * F.col("target"), F.col("largest") * F.col("max_repeats"))
    met = F.when(F.col("feasible"), near).otherwise(F.col("tokens") < F.col("target"))
    return rows.select("plan_id", "source", F.round("target", 3).alias("target"), "feasible", (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), met.alias("met"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the mix itself holds of each plan row: no document beyond its cap, none that its source lacks."""
    mix = p7_mix(spark, d)
    docs = mixture.sized(read_table(spark, d, "documents")).select("doc_id", F.col("source").alias("own"), F.col("tokens").alias("size"))
    per = mix.join(docs, "doc_id").groupBy("plan_id", "source", "doc_id").agg(F.max("copy").alias("top"), F.count("*").alias("n"), F.max((F.col("own") != F.col("source")) | (F.col("size") != F.col("tokens"))).alias("wrong"))
    return per.groupBy("plan_id", "source").agg(F.max(F.col("top") != F.col("n")).alias("gaps"), F.max("wrong").alias("wrong"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.pieces(read_table(spark, d, "documents"), read_table(spark, d, "split_rules"))
    return cut.where("n_pieces > 1 and piece = 1").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(read_table(spark, d, "documents"), read_table(spark, d, "split_rules"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per document cut: its tokens, counted over what is new in each piece, and the pieces that break the limit, the overlap, or the text."""
    cut = p8_pieces(spark, d).join(read_table(spark, d, "documents").select("doc_id", F.col("text").alias("whole")), "doc_id")
    torn = F.col("text") != F.substring(F.col("whole"), F.col("start") + 1, F.col("end") - F.col("start"))
    off = (F.col("piece") > 1) & (F.col("overlap") != F.least(F.col("asked"), F.col("max_tokens") - 1))
    return cut.groupBy("doc_id").agg(
        F.sum(F.col("tokens") - F.col("overlap")).alias("tokens"), F.count_if(F.col("tokens") > F.col("max_tokens")).alias("over"), F.count_if(off).alias("off"), F.count_if(torn).alias("torn")
    )


QUERIES = {
    "p6_found": p6_found,
    "p6_passages": p6_passages,
    "p6_exact": p6_exact,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_kept": p7_kept,
    "p7_counts": p7_counts,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
    "p8_kept": p8_kept,
}

_SIZED = r"""
sized as (
  select doc_id, nullif(lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '') as source,
    coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\v\x{1c}-\x{1f}]+')), 0) as tokens
  from documents)"""

_RATES = """
rates as (
  select p.*, target_share * total_ratio * (select sum(tokens) from sized) as target, coalesce(s.available, 0) as available
  from (select distinct plan_id, lower(trim(source)) as source, target_share, max_repeats, total_ratio from mix_plans) p
  left join (select source, sum(tokens) as available from sized group by source) s using (source))"""

ORACLE = {
    "p6_exact": r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(concat_ws(' ', prompt, answer)), '[\p{L}\p{N}]+') as w from eval_items),
dw as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as j from d),
iw as (select item_id, unnest(w) as x, generate_subscripts(w, 1) as i from i),
-- the pairs of equal words on one diagonal, in runs
met as (select item_id, doc_id, i, j - i as diagonal, i - row_number() over (partition by item_id, doc_id, j - i order by i) as run
  from iw join (select * from dw where doc_id in (select doc_id from (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: w[k:k + 11])) as g from d where len(w) > 11)
    where g in (select unnest(list_transform(range(1, len(w) - 10), lambda k: w[k:k + 11])) from i where len(w) > 11))) using (x))
select item_id, doc_id, max(n)::int as words from (select item_id, doc_id, count(*) as n from met group by item_id, doc_id, diagonal, run) where n > 11 group by all""",
    "p7_found": "with " + _SIZED + "," + _RATES + """
select plan_id, source from rates where available * max_repeats < target""",
    "p7_kept": "with " + _SIZED + "," + _RATES + """
select plan_id, source, round(target, 3) as target, not (available * max_repeats < target) as feasible, true as capped, true as met from rates""",
    "p7_counts": "with " + _SIZED + "," + _RATES + """
select plan_id, source, false as gaps, false as wrong from rates where available > 0 and target > 0""",
    "p8_found": "with " + _SIZED + """
select s.doc_id from sized s join split_rules r on lower(trim(r.source)) = s.source where s.tokens > r.max_tokens""",
    "p8_kept": "with " + _SIZED + """
select s.doc_id, s.tokens, 0 as over, 0 as off, 0 as torn from sized s join split_rules r on lower(trim(r.source)) = s.source where s.tokens > r.max_tokens""",
}
