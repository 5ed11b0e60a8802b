"""Files as tables: CSV, JSON lines, XML, and OBO-style term files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("rowTag", row_tag).xml(path)


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """(go_id, name, namespace, parents) of the [Term] stanzas that aren't obsolete; stanzas are split by the reader, not by a task."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").contains("[Term]"))
    tag = lambda name: F.regexp_extract("value", rf"(?m)^{name}: (.*)$", 1)
    return stanza.where(~F.col("value").rlike(r"(?m)^is_obsolete: true")).select(
        tag("id").alias("go_id"), tag("name").alias("name"), tag("namespace").alias("namespace"),
        F.transform(F.expr(r"regexp_extract_all(value, '(?m)^is_a: ([^!\n]*)', 1)"), lambda p: F.trim(p)).alias("parents"),
    )
