"""The ``events`` and ``nation`` tables read as calls for service and radio codes.

The tables hold no calls, so each call field is taken from a column that has the right shape: the event
type is the call type, 40 codes come from the user id with one of them made null, and the call time is
the event's minute, so that some calls are equal. The 25 nations are the code table; 15 codes are not in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchflow.functions import encode_value, record_json
from dispatchflow.schemas import CALL_RECORD

TOPIC_NAME = "calls"
TOPIC_PARTITIONS = 4


def _call_fields() -> dict[str, Column]:
    moment = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", moment)
    nothing = F.lit(None)
    return {
        "crime_id": F.col("event_id"),
        "original_crime_type_name": F.col("event_type"),
        "report_date": day,
        "call_date": day,
        "offense_date": day,
        "call_time": F.date_format(moment, "HH:mm"),
        "call_date_time": F.date_trunc("minute", moment),
        "disposition": F.expr("nullif(cast(user_id % 40 as string), '7')"),
        "address": F.col("props"),
        "city": nothing,
        "state": nothing,
        "agency_id": F.col("user_id"),
        "address_type": nothing,
        "common_location": nothing,
    }


def as_calls(events: DataFrame) -> DataFrame:
    """Events as call records."""
    fields = _call_fields()
    return events.select(*(fields[f.name].cast(f.dataType).alias(f.name) for f in CALL_RECORD))


def as_envelope(events: DataFrame) -> DataFrame:
    """Events as messages of a topic of four partitions, the event id giving partition and offset."""
    fields = _call_fields()
    record = F.struct(*(fields[f.name].cast(f.dataType).alias(f.name) for f in CALL_RECORD))
    return events.select(
        F.lit(None).cast("binary").alias("key"),
        encode_value(record_json(record)).alias("value"),
        F.lit(TOPIC_NAME).alias("topic"),
        F.expr(f"cast(event_id % {TOPIC_PARTITIONS} as int)").alias("partition"),
        F.expr(f"event_id div {TOPIC_PARTITIONS}").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def nations_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under the field names of a code file."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.col("n_nationkey").cast("string").alias("disposition_code"),
        F.col("n_name").alias("description"),
    )


def nation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the code table of the join."""
    return nations_table(spark, sf_dir).withColumnRenamed("disposition_code", "disposition")


def write_json_arrays(records: DataFrame, path: str, per_file: int) -> None:
    """Records as files of one JSON array each, of at most ``per_file`` records.

    Rows are told apart by their place in the scan, so no array can grow with a repeated key.
    """
    (
        records.withColumn("record", F.struct(*records.columns))
        .groupBy(F.expr(f"monotonically_increasing_id() div {per_file}").alias("file"))
        .agg(record_json(F.collect_list("record")).alias("value"))
        .write.partitionBy("file")
        .text(path)
    )


def write_json_array(records: DataFrame, path: str) -> None:
    """All records as one array in one file: texts are made by many tasks, one writes them, a record at a time."""
    texts = records.select(record_json(F.struct(*records.columns)).alias("text")).repartition(1)
    comma = F.when(F.monotonically_increasing_id() > 0, ",").otherwise("[")
    lines = texts.select(F.concat(comma, "text").alias("value"))
    end = records.sparkSession.sql("select ']' as value")
    lines.unionByName(end).coalesce(1).write.text(path)


def write_json_lines(records: DataFrame, path: str) -> None:
    """Records as JSON lines."""
    records.select(record_json(F.struct(*records.columns)).alias("value")).write.text(path)
