"""Records to publish, read from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchflow.functions import record_json

# A record that cannot be read ends the job: left out or emptied, it would be lost without a word.
_STRICT = {"mode": "FAILFAST"}


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """``payload`` JSON text of each element of JSON array files, without a schema.

    An array cannot be split, so each file is one task's work and at most two gigabytes; a large input
    has to come as many files, or as JSON lines. Elements become variants one by one: their keys come out
    sorted, nulls and nested values stay. A file that is no JSON array fails the read. (The outer explode
    keeps the optimizer from parsing the file a second time to see whether the array is empty.)
    """
    elements = F.from_json("value", "array<variant>", _STRICT)
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode_outer(elements).alias("position", "record"))
        .where(F.col("position").isNotNull())
        .select("position", record_json(F.col("record")).alias("payload"))
    )


def json_line_records(spark: SparkSession, path: str) -> DataFrame:
    """``payload`` JSON text of each line of JSON lines files, which Spark splits as it likes."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(record_json(F.parse_json("value")).alias("payload"))


def typed_array_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``payload`` JSON text of each element of JSON array files whose schema is known."""
    records = spark.read.json(path, schema=schema, multiLine=True, **_STRICT)
    return records.select(record_json(F.struct(*schema.names)).alias("payload"))
