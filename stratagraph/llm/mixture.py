"""Problem 7: records of several sources mixed to target shares of all tokens.

Each row of a plan has a mean repetition rate: the tokens it should give over the tokens its source has. A document is
taken as often as the inverse of a Poisson distribution says at a number hashed from its id, the plan and a seed, so
the choice is the same on every run and needs no state. The distribution is cut at max_repeats and its mean is raised
so that the cut one meets the target; a rate the cap can't reach takes every document max_repeats times, and the plan
row is reported as not feasible. As the numbers are fixed, so is what a mean gives: one pass counts the tokens of each
plan row by their numbers (BINS parts, however many documents), and the mean at which they meet the target is solved
from these counts, so that a few large documents don't pull a share away. The copies are shuffled globally by another
hash.

Defined results: sources are compared without case and outer white space, documents without source are in no plan but
count among all tokens; null texts have no tokens; documents without tokens are never taken; a plan row with a null is
no row, repeated rows count once, a null max_repeats sets no cap; a source without documents can't give a share above
zero; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import if_small, materialize, spread
from .tokens import clean_source, token_count

SEED = 42
#: Parts of [0, 1) by which the tokens of a plan row are counted before its mean is set.
BINS = 4096
#: Standard deviations, and counts besides, beyond which a Poisson number is as good as impossible (below 1e-17).
FAR = (10, 40)


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens)."""
    return spread(documents.select("doc_id", "source", "text")).select("doc_id", clean_source(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens"))


def plan_rates(sizes: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, source, target_share, max_repeats, target, available, rate, feasible): one row per plan row.

    One pass over sizes (as sized gives them) counts the tokens of every source; what is shuffled is one row per source and task.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("tokens").alias("available")), "totals")
    every = totals.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
    rows = plans.select("plan_id", clean_source(F.col("source")).alias("source"), "target_share", "max_repeats", "total_ratio").distinct()
    rows = rows.where("plan_id is not null and source is not null and target_share is not null and total_ratio is not null")
    joined = rows.join(totals.where("source is not null"), "source", "left")
    target = F.col("target_share") * F.col("total_ratio") * F.lit(every)
    has = F.coalesce("available", F.lit(0))
    return joined.select(
        "plan_id", "source", "target_share", "max_repeats", target.alias("target"), has.alias("available"), F.when(has > 0, target / has).alias("rate")
    )


def poisson_cuts(mean: float, cap: int | None) -> tuple[int, np.ndarray]:
    """(base, cuts) of a Poisson distribution cut at cap: the count at a number u in [0, 1) is base and one for each cut <= u.

    The probabilities are summed from logarithms round the mean, so no mean is too large.
    """
    if not mean > 0:
        return 0, np.zeros(0)
    far = FAR[0] * math.sqrt(mean) + FAR[1]
    low, high = max(0, math.floor(mean - far)), math.ceil(mean + far)
    if cap is not None:
        if low >= cap:
            return max(cap, 0), np.zeros(0)
        high = min(high, cap - 1)
    k = np.arange(low + 1, high + 1)
    first = low * math.log(mean) - mean - math.lgamma(low + 1)
    return low, np.minimum(np.cumsum(np.exp(np.r_[first, first + np.cumsum(math.log(mean) - np.log(k))])), 1.0)


def cut_mean(rate: float, cap: int | None) -> float:
    """The mean of the Poisson distribution whose counts, cut at cap, have the mean rate (below cap)."""

    def reached(mean: float) -> float:
        base, cuts = poisson_cuts(mean, cap)
        return base + float((1 - cuts).sum())

    return _solved(reached, rate, rate)


def meeting_mean(target: float, cap: int | None, weight: np.ndarray) -> float | None:
    """The mean at which the tokens drawn meet the target. weight: the tokens whose numbers lie in each of BINS equal parts of [0, 1)."""
    edges, beyond = np.linspace(0, 1, len(weight) + 1), np.r_[weight[::-1].cumsum()[::-1], 0.0]
    if not beyond[0] > 0:
        return None

    def given(mean: float) -> float:
        base, cuts = poisson_cuts(mean, cap)
        return base * beyond[0] + float(np.interp(cuts, edges, beyond).sum())

    return _solved(given, target, target / beyond[0])


def _solved(f, want: float, start: float) -> float:
    """Where the rising function f reaches want."""
    low, high = 0.0, max(start, 1e-9)
    while f(high) < want * (1 - 1e-12) and high < 1e300:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < want else (low, mid)
    return high


CUTS = T.StructType([T.StructField("base", T.IntegerType()), T.StructField("cuts", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(CUTS)
def _cuts(rate: pd.Series, target: pd.Series, cap: pd.Series, bins: pd.Series) -> pd.DataFrame:
    rows = []
    for r, t, c, counted in zip(rate, target, cap, bins):
        c = None if pd.isna(c) else int(c)
        if c is not None and r >= c:
            rows.append((max(c, 0), []))
            continue
        weight = np.zeros(BINS)
        for b in counted if counted is not None else ():
            weight[b["bin"]] = b["tokens"]
        mean = meeting_mean(float(t), c, weight)
        base, cuts = poisson_cuts(cut_mean(float(r), c) if mean is None else mean, c)
        rows.append((base, cuts[cuts < 1].tolist()))
    return pd.DataFrame(rows, columns=["base", "cuts"])


def unit(*cols) -> Column:
    """A number in [0, 1) hashed from the columns."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _drawn(sizes: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    joined = sizes.where("tokens > 0 and source is not null").join(if_small(rates), "source")
    return joined.withColumn("u", unit("doc_id", "plan_id", F.lit(seed)))


def copies(sizes: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """(plan_id, source, doc_id, tokens, copies) of each document that a plan takes; rates as plan_rates gives them, written."""
    some = rates.where("rate > 0").select("plan_id", "source", "target", "rate", "max_repeats")
    tried = _drawn(sizes, some.where("max_repeats is null or rate < max_repeats").select("plan_id", "source"), seed)
    bins = tried.groupBy("plan_id", "source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("tokens").alias("tokens"))
    counted = bins.groupBy("plan_id", "source").agg(F.collect_list(F.struct("bin", "tokens")).alias("bins"))
    met = some.join(counted, ["plan_id", "source"], "left").withColumn("c", _cuts("rate", "target", "max_repeats", "bins"))
    cut = materialize(met.select("plan_id", "source", "c.base", "c.cuts"), "cuts")
    n = F.col("base") + F.size(F.filter("cuts", lambda c: c <= F.col("u")))
    return _drawn(sizes, cut, seed).select("plan_id", "source", "doc_id", "tokens", n.alias("copies")).where("copies > 0")


def mix(documents: DataFrame, plans: DataFrame, seed: int = SEED) -> DataFrame:
    """(plan_id, shuffle_key, doc_id, source, copy, tokens): every copy, in the global order of the mix."""
    sizes = materialize(sized(documents), "sizes")
    rates = materialize(plan_rates(sizes, plans), "rates")
    each = copies(sizes, rates, seed).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.xxhash64("plan_id", "doc_id", "copy", F.lit(seed + 1))
    return each.select("plan_id", key.alias("shuffle_key"), "doc_id", "source", "copy", "tokens").orderBy("plan_id", "shuffle_key", "doc_id", "copy")


def shares(documents: DataFrame, plans: DataFrame, seed: int = SEED) -> DataFrame:
    """(plan_id, source, target_share, share, target, tokens, documents, most_copies, max_repeats, feasible): what each plan row reached.

    share is of the tokens that the whole plan reached, target the tokens wanted of the source. A row is not feasible if
    every document of its source was drawn as often as it may be and the tokens still miss the target.
    """
    sizes = materialize(sized(documents), "sizes")
    rates = materialize(plan_rates(sizes, plans), "rates")
    got = copies(sizes, rates, seed).groupBy("plan_id", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents"), F.max("copies").alias("most_copies")
    )
    rows = rates.join(got, ["plan_id", "source"], "left").fillna(0, ["tokens", "documents", "most_copies"])
    rows = materialize(rows, "shares")
    whole = rows.groupBy("plan_id").agg(F.sum("tokens").alias("whole"))
    spent = F.col("tokens") >= F.col("available") * F.coalesce("max_repeats", F.when(F.col("available") == 0, 0))
    return rows.join(whole, "plan_id").select(
        "plan_id", "source", "target_share", F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)).alias("share"), "target", "tokens", "documents", "most_copies", "max_repeats",
        (~(F.coalesce(spent, F.lit(False)) & (F.col("tokens") < F.col("target")))).alias("feasible"),
    )
