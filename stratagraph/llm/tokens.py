"""Tokens of the WordPunct tokenizer: longest runs of letters, numbers and underscores, or of other characters that aren't white space.

There is one definition, and the JVM alone applies it: Python gets the tokens it needs as they were found there, so two
engines with other ideas of white space, or of which characters are letters, can't disagree about a text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.records import strip

# White space: the separators of Unicode and the controls U+0009 to U+000D, U+001C to U+001F and U+0085. Fixed values of the tokenizer.
SPACE = r"\p{Z}\t-\r\x1c-\x1f\x85"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"
#: A token with the white space before it: all of them in turn give the text up to its last token.
CHUNK = rf"[{SPACE}]*(?:{TOKEN})"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def token_count(text: Column) -> Column:
    """Tokens of a text, none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def token_chunks(text: Column) -> Column:
    """The tokens of a text, each with the white space before it."""
    return F.regexp_extract_all(text, F.lit(f"({CHUNK})"), F.lit(1))


def spans(chunks: list[str]) -> list[tuple[int, int]]:
    """Where each token of token_chunks begins and ends in the text."""
    out, at = [], 0
    for c in chunks:
        end = at + len(c)
        out.append((end - len(c.lstrip(BLANKS)), end))
        at = end
    return out


def clean_source(source: Column) -> Column:
    """A source without case and outer white space; null if nothing is left."""
    return F.nullif(F.lower(strip(source)), F.lit(""))
