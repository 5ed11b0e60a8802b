"""Column expressions over logged records: integrity, text cleaning, JSON payloads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REFS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("ref", T.LongType())]))


def intact(payload: Column, crc: Column) -> Column:
    """True if crc is the CRC-32 of the payload's UTF-8 bytes, or both are null."""
    return crc.eqNullSafe(F.crc32(payload.cast("binary")))


def intact_rows(objects: DataFrame) -> DataFrame:
    """Rows of a record log that count: undamaged, and with all three keys present."""
    return objects.where(
        F.col("store_id").isNotNull() & F.col("oid").isNotNull() & F.col("tid").isNotNull() & intact(F.col("payload"), F.col("crc"))
    )


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def leading_number(text: Column) -> Column:
    """The whole number a loosely written cell holds ('+12', ' 12', '12.0', 'tid=12', '{"tid": 12}'), null if none; one beyond bigint is the greatest bigint."""
    digits = F.regexp_extract(text, r"^[^0-9]*?(-?[0-9]{1,37})(\.[0-9]*)?[^0-9]*$", 1).try_cast("decimal(38,0)")
    end = lambda x: F.lit(x).cast("decimal(38,0)")
    return F.when(digits.isNotNull(), F.greatest(F.least(digits, end(2**63 - 1)), end(-(2**63)))).cast("bigint")


def split_fields(fields: Column) -> Column:
    """A field list written as a JSON array, or separated by U+001F or by commas."""
    loose = F.split(fields, F.when(fields.contains("\x1f"), F.lit("\x1f")).otherwise(F.lit(",")))
    names = F.when(strip(fields).startswith("["), F.from_json(fields, "array<string>")).otherwise(loose)
    return F.filter(F.transform(names, strip), lambda x: x != "")


def _walk(value, pos: int, out: set) -> None:
    stack = [value]
    while stack:
        x = stack.pop()
        if type(x) is dict:
            if len(x) == 1 and "$ref" in x:
                if type(x["$ref"]) is int and -(2**63) <= x["$ref"] < 2**63:
                    out.add((pos, x["$ref"]))
            else:
                stack.extend(x.values())
        elif type(x) is list:
            stack.extend(x)


def payload_refs(payload: str | None) -> list[tuple[int, int]]:
    """Distinct (field position, oid) of the references in one payload; none for null or unreadable text."""
    if not payload or '"$ref"' not in payload:
        return []
    try:
        row = json.loads(payload)
    except (ValueError, RecursionError):
        return []
    out: set = set()
    if type(row) is list:
        for pos, value in enumerate(row):
            if type(value) is dict or type(value) is list:
                _walk(value, pos, out)
    return sorted(out)


@F.pandas_udf(REFS)
def refs_of(payload: pd.Series) -> pd.Series:
    return payload.map(payload_refs)


KIND_NAMES = {"b": "bool", "i": "int", "f": "float", "s": "string", "r": "ref", "l": "list", "m": "map"}
_BY_TYPE = {bool: "b", int: "i", float: "f", str: "s", list: "l", type(None): "n"}


def kind_letters(payload: str | None) -> str | None:
    """One letter per field value of a payload (see KIND_NAMES; n for null); null if it is no JSON array."""
    if payload is None:
        return None
    try:
        row = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    if type(row) is not list:
        return None
    return "".join([_BY_TYPE.get(type(x)) or ("r" if len(x) == 1 and "$ref" in x else "m") for x in row])


@F.pandas_udf(T.StringType())
def kinds_of(payload: pd.Series) -> pd.Series:
    return payload.map(kind_letters)


def latest(rows: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """The row with the highest order per key; equal orders are settled by the carried values, so a rerun gives the same row.

    The aggregate combines on the map side, so a key that holds a third of all rows costs one row per task in the shuffle.
    """
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *carry)).alias("_top"))
    return top.select(*keys, *[F.col("_top")[c].alias(c) for c in [*order, *carry]])
