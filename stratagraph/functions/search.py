"""Ranked full-text search over postings kept as a table.

A document has, per text field, a column of folded words (f_) and, if the field has a language, one of folded stems (s_).
Postings are clustered by term, so a search reads the row groups of its terms only. Scores are BM25 with the weights and
lengths below, equal to those of an FTS engine with the columns typename, f_*, s_*.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigDrift
from ..runtime import HadoopFiles, materialize, spread
from .text import TOKEN, fold, language, stem_folded, tokens

# BM25 parameters and column weights. Fixed values of the ranking.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {"f": 2.0, "s": 1.0}

POSTINGS = "oid bigint, col string, term string, at array<int>, n int"


def _words(text: str | None, lang: str | None, stems: bool) -> list[str]:
    return [stem_folded(t, lang) if stems else fold(t) for t in tokens(text)]


def _index_rows(columns: list[tuple[str, str, str | None, bool]]):
    """Arrow batches of (oid, texts) to postings, and per document one row without term that has its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            oids, total = batch["oid"].to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int32)
            for name, source, lang, stems in columns:
                lists = [_words(t, lang, stems) for t in batch[source].to_pylist()]
                sizes = np.array([len(x) for x in lists], np.int64)
                total += sizes.astype(np.int32)
                if not sizes.sum():
                    continue
                flat = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
                code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(lists)), sizes)
                at = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                order = np.lexsort((at, code, doc))
                doc, code = doc[order], code[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])
                ends = np.r_[first, len(code)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(oids[doc[first]], pa.int64()), pa.array([name] * len(first), pa.string()), flat.dictionary.take(pa.array(code[first])),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order])), pa.nulls(len(first), pa.int32()),
                    ],
                    names=["oid", "col", "term", "at", "n"],
                )
            none = [pa.nulls(batch.num_rows, t) for t in (pa.string(), pa.string(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(oids, pa.int64()), *none, pa.array(total)], names=["oid", "col", "term", "at", "n"])

    return run


def wanted_words(query: str) -> list[list[str]]:
    """What a query asks for: the words of each part in double quotes, which must adjoin, then every other word by itself. A quote that is never closed counts for nothing."""
    parts = query.split('"')
    if len(parts) % 2 == 0:
        parts[-2:] = [" ".join(parts[-2:])]
    together = [tokens(part) for part in parts[1::2]]
    return [words for words in together if words] + [[word] for part in parts[::2] for word in tokens(part)]


class FullTextIndex:
    """fulltext: type -> field -> language or None. Built by build(); postings (oid, type, col, term, at), lengths (oid, type, n)."""

    def __init__(self, fulltext: dict[str, dict[str, str | None]], postings: DataFrame, lengths: DataFrame):
        self.fulltext = {t: {f: language(x) for f, x in fields.items()} for t, fields in fulltext.items()}
        self.postings, self.lengths = postings, lengths

    @classmethod
    def build(cls, fulltext: dict[str, dict[str, str | None]], docs: dict[str, DataFrame]) -> FullTextIndex:
        """docs: type -> rows with `oid` and the type's text fields. A record whose texts are all null has no document."""
        posts, lens = [], []
        for typename, fields in fulltext.items():
            rows = docs[typename].where(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields]) & F.col("oid").isNotNull())
            cols = []
            for f, lang in fields.items():
                cols.append((f"f_{f}", f, None, False))
                if language(lang):
                    cols.append((f"s_{f}", f, language(lang), True))
            built = spread(rows.select(F.col("oid").cast("bigint").alias("oid"), *fields)).mapInArrow(_index_rows(cols), POSTINGS)
            built = materialize(built, "postings").withColumn("type", F.lit(typename))
            posts.append(built.where("term is not null").select("oid", "type", "col", "term", "at"))
            lens.append(built.where("term is null").select("oid", "type", (F.col("n") + len(tokens(typename))).alias("n")))
        return cls(fulltext, reduce(DataFrame.unionByName, posts), reduce(DataFrame.unionByName, lens))

    def save(self, path: str, tid: int | None = None) -> None:
        """Writes the index, its languages, and the transaction it was built at; the last file written makes it whole."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "col").write.parquet(f"{path}/postings")
        self.lengths.write.parquet(f"{path}/lengths")
        HadoopFiles(spark, path).write(f"{path}/index.json", json.dumps({"fulltext": self.fulltext, "tid": tid}))

    @classmethod
    def load(cls, spark: SparkSession, path: str, fulltext: dict[str, dict[str, str | None]], tid: int | None = None) -> FullTextIndex | None:
        """A saved index; None if it was built at another transaction than tid. Other fields or languages are refused: their words would be missed without a sign."""
        kept = json.loads(HadoopFiles(spark, path).read(f"{path}/index.json"))
        out = cls(fulltext, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))
        if kept["fulltext"] != out.fulltext:
            raise ConfigDrift(f"{path} was built for {kept['fulltext']}, not for {out.fulltext}")
        return out if tid is None or kept["tid"] == tid else None

    def refresh(self, changed: dict[str, DataFrame], gone: DataFrame) -> FullTextIndex:
        """The index after some records changed (as for build) and others went (oid)."""
        part = FullTextIndex.build({t: self.fulltext[t] for t in changed}, changed)
        out = reduce(DataFrame.union, [gone.select("oid"), *[r.select("oid") for r in changed.values()]]).distinct()
        keep = lambda rows: rows.join(out, "oid", "left_anti")
        return FullTextIndex(self.fulltext, keep(self.postings).unionByName(part.postings), keep(self.lengths).unionByName(part.lengths))

    def columns(self, typename: str | None = None) -> list[tuple[str, str | None]]:
        """The text columns of a type, or of all, each with the language whose stems it holds (None: folded words)."""
        types = [self.fulltext.get(typename, {})] if typename is not None else self.fulltext.values()
        return sorted({x for fields in types for f, lang in fields.items() for x in [(f"f_{f}", None)] + [(f"s_{f}", lang)] * bool(lang)}, key=str)

    def asked(self, query: str, typename: str | None = None) -> list[tuple]:
        """(phrase, unit, size, k, col, term): every unit of the query in the form of every column, word by word. Languages of one column that agree in a form ask once."""
        forms = {
            (n, col, tuple(stem_folded(w, lang) if lang else fold(w) for w in words)) for n, words in enumerate(wanted_words(query)) for col, lang in self.columns(typename)
        }
        return [(phrase, n, len(terms), k, col, term) for phrase, (n, col, terms) in enumerate(sorted(forms)) for k, term in enumerate(terms)]

    def scores(self, query: str, typename: str | None = None, match: str = "any") -> DataFrame:
        """(oid, type, score) of every match."""
        if match not in ("any", "all"):
            raise ValueError(f"match is 'any' or 'all', not {match!r}")
        spark = self.postings.sparkSession
        if not (rows := self.asked(query, typename)):
            return spark.createDataFrame([], "oid bigint, type string, score double")
        wanted = spark.createDataFrame(rows, "phrase int, unit int, size int, k int, col string, term string")
        units, terms = {r[1] for r in rows}, sorted({r[5] for r in rows})
        posts = self.postings.where(F.col("term").isin(terms))
        met = posts.join(F.broadcast(wanted), ["col", "term"])
        lists = met.groupBy("oid", "type", "phrase", "unit", "size", "col").agg(F.sort_array(F.collect_list(F.struct("k", "at"))).alias("w"))
        starts = F.filter(F.get("w", F.lit(0))["at"], lambda p: F.forall("w", lambda x: F.array_contains(x["at"], p + x["k"])))
        hits = lists.where(F.size("w") == F.col("size")).withColumn("times", F.size(starts)).where("times > 0")
        n = hits.groupBy("phrase").agg(F.count("*").alias("n"))
        if typename is not None:
            chosen = hits.where(F.col("type") == typename)
        else:
            chosen = hits
        docs, mean = self.lengths.agg(F.count("*"), F.avg("n")).first()
        idf = F.log((F.lit(docs) - F.col("n_p") + 0.5) / (F.col("n_p") + 0.5))
        tf = F.when(F.col("col").startswith("f_"), WEIGHTS["f"]).otherwise(WEIGHTS["s"]) * F.col("times")
        part = F.when(idf <= 0, LEAST_IDF).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(mean)))
        scored = (
            chosen.join(F.broadcast(n.withColumnRenamed("n", "n_p")), "phrase")
            .join(self.lengths.select("oid", "n"), "oid")
            .groupBy("oid", "type")
            .agg(F.sum(part).alias("score"), F.countDistinct("unit").alias("units"))
        )
        if match == "all":
            scored = scored.where(F.col("units") == len(units))
        return scored.select("oid", "type", "score")

    def search(self, query: str, typename: str | None = None, limit: int = 20, match: str = "any", readable: DataFrame | None = None, scan_cap: int | None = None) -> DataFrame:
        """The best matches, ties by oid. readable (oid) fences the search: only readable ones are given, and with scan_cap only those among so many best."""
        ranked = self.scores(query, typename, match).orderBy(F.desc("score"), F.asc("oid"))
        if readable is not None:
            fence = (ranked if scan_cap is None else ranked.limit(scan_cap)).join(readable.select("oid"), "oid", "left_semi")
            ranked = fence.orderBy(F.desc("score"), F.asc("oid"))
        return ranked.limit(limit)

    def highlighter(self, query: str, lang: str | None = None):
        """A function of a text column: the excerpt round the first match, its words in brackets; null without a match."""
        lang, units = language(lang), wanted_words(query)
        return F.pandas_udf(lambda s: s.map(lambda t: highlight(t, units, lang)), T.StringType())


def found_words(words: list[str], units: list[list[str]], lang: str | None = None) -> set[int]:
    """Which of the words a unit matches, by folded form or by stem; those of a unit of several words only where they adjoin."""
    out: set[int] = set()
    for form in (fold, partial(stem_folded, lang=lang)) if lang else (fold,):
        where: dict[str, set[int]] = {}
        for i, w in enumerate(words):
            where.setdefault(form(w), set()).add(i)
        for unit in units:
            starts = set.intersection(*[{i - k for i in where.get(form(w), ())} for k, w in enumerate(unit)])
            out |= {i + k for i in starts for k in range(len(unit))}
    return out


def highlight(text: str | None, units: list[list[str]], lang: str | None = None, before: int = 5, after: int = 7) -> str | None:
    """The text from so many words before the first match to so many from it on, each matched word in brackets, an ellipsis where it was cut."""
    shown = unicodedata.normalize("NFC", text or "")
    places = [m.span() for m in TOKEN.finditer(shown)]
    hits = sorted(found_words([shown[a:b].lower() for a, b in places], units, lang))
    if not hits:
        return None
    first, last = max(hits[0] - before, 0), min(hits[0] + after, len(places)) - 1
    start, stop = places[first][0] if first else 0, places[last][1] if last + 1 < len(places) else len(shown)
    excerpt = shown[start:stop]
    for a, b in reversed([places[i] for i in hits if i <= last]):
        excerpt = f"{excerpt[: a - start]}[{excerpt[a - start : b - start]}]{excerpt[b - start :]}"
    return "…" * (first > 0) + excerpt + "…" * (last + 1 < len(places))
