"""Problem 8: documents above their source's token limit cut into pieces within it.

A text is split at sections; parts still too long at paragraphs, lines, sentences, clauses, words, and last between any two
tokens. The parts are packed greedily up to the limit, so that what is new in a piece begins and ends at the coarsest
boundaries that do, and before it each piece repeats the last overlap_tokens tokens of the piece before: exactly so many,
or, with reach_back, up to twice as many where a natural boundary lies there.

Defined results: a null or blank text, or a document whose source is null, blank or without a rule, is no case; a rule
with a null or non-positive limit is no rule, of several rules for a source the least limit holds; a null or negative
overlap is none, one of the limit or more is cut to the limit less one token (`asked` has what the rule asks for,
`overlap` what a piece has); a text within the limit is not cut; pieces cover every token; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import if_small, spread
from .tokens import clean_source, spans, token_chunks, token_count

SECTION, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = range(7)
_SECTION = re.compile(r"\n\s*\n\s*\n|\n\s*(?=#{1,6}\s|-{3,}|={3,}|\*{3,})|\f")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\r?\n")
_SENTENCE_END = re.compile(r"[.!?…。]+[\"'»”’)\]]*$")
_CLAUSE_END = re.compile(r"[;:,]+[\"'»”’)\]]*$")

PIECES = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("piece", "start", "end", "tokens", "overlap")] + [T.StructField("text", T.StringType())]
    )
)


def boundary_levels(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """For each token but the first, the kind of boundary before it."""
    out = [SECTION]
    for (a, b), (c, _) in zip(spans, spans[1:]):
        if b == c:
            out.append(CHARACTER)
            continue
        gap = text[b:c]
        if "\n" in gap or "\r" in gap or "\f" in gap:
            gap = gap.replace("\r\n", "\n").replace("\r", "\n")
            ahead = gap + text[c : c + 7]
            out.append(SECTION if _SECTION.match(ahead) or _SECTION.search(gap) else PARAGRAPH if _PARAGRAPH.search(gap) else LINE)
        else:
            end = text[a:b]
            out.append(WORD if end[-1].isalnum() else SENTENCE if _SENTENCE_END.search(end) else CLAUSE if _CLAUSE_END.search(end) else WORD)
    return out


def split_units(levels: list[int], low: int, high: int, limit: int, level: int = SECTION) -> list[tuple[int, int]]:
    """Token ranges of at most limit tokens, cut at the coarsest boundaries that do."""
    out: list[tuple[int, int]] = []
    work = [(low, high, level)]
    while work:
        a, b, at = work.pop()
        if b - a <= limit:
            out.append((a, b))
        elif at > CHARACTER:
            work += [(x, min(x + limit, b), CHARACTER) for x in reversed(range(a, b, limit))]
        else:
            cuts = [a, *[i for i in range(a + 1, b) if levels[i] <= at], b]
            work += [(x, y, at + 1) for x, y in zip(reversed(cuts[:-1]), reversed(cuts[1:]))]
    return out


def split_spans(text: str, at: list[tuple[int, int]], limit: int, overlap: int, reach_back: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(first token, end token, start character, end character, tokens shared with the piece before) of each piece. at: where the tokens lie."""
    n = len(at)
    if n <= limit:
        return [(0, n, at[0][0], at[-1][1], 0)] if n else []
    overlap = max(0, min(overlap, limit - 1))
    reach = max(0, min(overlap, limit - 1 - overlap)) if reach_back else 0
    levels = boundary_levels(text, at)
    pieces: list[tuple[int, int, int]] = []
    start, end, shared = 0, 0, 0
    for a, b in split_units(levels, 0, n, limit - overlap - reach):
        if b - start > limit:
            pieces.append((start, end, shared))
            start = max(end - overlap, 0)
            if reach:
                near = range(start, max(end - overlap - reach, pieces[-1][0]), -1)
                start = min(near, key=lambda i: (min(max(levels[i], SENTENCE), WORD + (levels[i] > WORD)), -i), default=start)
            shared = end - start
        end = b
    pieces.append((start, end, shared))
    return [(s, e, at[s][0], at[e - 1][1], o) for s, e, o in pieces]


def _split(reach_back: bool):
    def one(text, chunks, most, share):
        return [
            {"piece": k, "start": a, "end": b, "tokens": e - s, "overlap": o, "text": text[a:b]}
            for k, (s, e, a, b, o) in enumerate(split_spans(text, spans(chunks), int(most), int(share), reach_back), 1)
        ]

    @F.pandas_udf(PIECES)
    def split_pieces(text: pd.Series, chunks: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(text, chunks, limit, overlap)])

    return split_pieces


def pieces(documents: DataFrame, rules: DataFrame, reach_back: bool = False) -> DataFrame:
    """(doc_id, source, max_tokens, asked, n_pieces, piece, start, end, tokens, overlap, text) of each document above its limit."""
    by_source = (
        rules.select(clean_source(F.col("source")).alias("source"), "max_tokens", F.greatest(F.coalesce("overlap_tokens", F.lit(0)), F.lit(0)).alias("asked"))
        .where("source is not null and max_tokens > 0")
        .groupBy("source")
        .agg(F.min(F.struct("max_tokens", "asked")).alias("r"))
        .select("source", "r.*")
    )
    docs = documents.select("doc_id", "text", clean_source(F.col("source")).alias("source")).where("source is not null and text is not null")
    long = spread(docs).join(if_small(by_source), "source").where(token_count(F.col("text")) > F.col("max_tokens"))
    cut = long.select("doc_id", "source", "max_tokens", "asked", _split(reach_back)("text", token_chunks(F.col("text")), "max_tokens", "asked").alias("p"))
    return cut.select("doc_id", "source", "max_tokens", "asked", F.size("p").alias("n_pieces"), F.inline("p"))
