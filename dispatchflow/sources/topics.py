"""Topics: Kafka, or a folder of parquet files with the Kafka source's columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchflow.functions import encode_value
from dispatchflow.schemas import ENVELOPE, schema

#: Bytes of a row group of a folder topic.
ROW_GROUP = 16 * 1024 * 1024
# Clocks of driver and storage may be that far apart.
_OVERLAP = timedelta(hours=1)
_ROW_BITS = 33  # monotonically_increasing_id: the partition stands above 33 bits of row number


@dataclass(frozen=True)
class Topic:
    """A topic's name and where it lives: Kafka bootstrap servers, or a folder.

    ``options`` are settings of the Kafka client (``kafka.security.protocol``, ``kafka.client.id``) or of Spark's
    Kafka source and sink; reads and writes both pass them on.
    """

    name: str
    servers: str | None = None
    folder: str | None = None
    options: dict[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if (self.servers is None) == (self.folder is None):
            raise ValueError("a topic has either servers or a folder")
        if self.folder and self.options:
            raise ValueError(f"a folder topic has no options: {sorted(self.options)}")

    def refuse(self, **given) -> None:
        """Fail if an option is given that this kind of topic does not know."""
        for name, value in given.items():
            if value is not None:
                kind = "Kafka" if self.servers else "folder"
                raise ValueError(f"{name} means nothing for a {kind} topic")

    @property
    def path(self) -> str:
        return f"{self.folder.rstrip('/')}/{self.name}"


def kafka_read_options(
    topic: Topic,
    starting: str = "earliest",
    ending: str | None = None,
    max_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Options of the Kafka source.

    ``max_per_trigger`` offsets are shared out over the topic's partitions in proportion. With
    ``min_partitions`` above the topic's own number Spark splits the longest offset ranges, so that one
    busy partition is read by several tasks.
    """
    options = {
        "kafka.bootstrap.servers": topic.servers,
        "subscribe": topic.name,
        "startingOffsets": starting,
        "endingOffsets": ending,
        "maxOffsetsPerTrigger": max_per_trigger,
        "minPartitions": min_partitions,
    }
    return {name: str(value) for name, value in options.items() if value is not None} | topic.options


def kafka_write_options(topic: Topic) -> dict[str, str]:
    """Options of the Kafka sink."""
    return {"kafka.bootstrap.servers": topic.servers, "topic": topic.name} | topic.options


def topic_stream(
    spark: SparkSession,
    topic: Topic,
    starting: str | None = None,
    max_per_trigger: int | None = None,
    min_partitions: int | None = None,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """All messages of a topic and those to come.

    A first start reads a Kafka topic from ``starting``, else from the earliest offsets, and a folder always from
    its first file; a restart goes on where the checkpoint stands. The rate limit is ``max_per_trigger`` offsets
    for Kafka, ``max_files`` files or ``max_bytes`` bytes for a folder; what the kind of topic does not know is
    refused. A folder's files are taken in the order of their modification times, so with a limit they must have
    been written in the order of event time, as messages arrive in a Kafka topic.
    """
    if topic.servers:
        topic.refuse(max_files=max_files, max_bytes=max_bytes)
        options = kafka_read_options(
            topic, starting or "earliest", max_per_trigger=max_per_trigger, min_partitions=min_partitions
        )
        return spark.readStream.format("kafka").options(**options).load()
    topic.refuse(starting=starting, max_per_trigger=max_per_trigger, min_partitions=min_partitions)
    limits = {"maxFilesPerTrigger": max_files, "maxBytesPerTrigger": max_bytes}
    options = {name: str(value) for name, value in limits.items() if value is not None}
    return spark.readStream.schema(ENVELOPE).options(**options).parquet(topic.path)


def topic_batch(
    spark: SparkSession,
    topic: Topic,
    starting: str | None = None,
    ending: str | None = None,
    min_partitions: int | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """The messages a topic holds now, in at least ``min_partitions`` partitions.

    Those from ``starting`` (earliest) to before ``ending`` (latest): one of these two words, or offsets as the Kafka
    source has them, ``{"topic": {"0": 23, "1": -2}}``, where -2 is the earliest and -1 the latest. For a folder they
    may leave partitions out, which are read whole. ``since`` and ``until`` are times instead, the latter exclusive.

    A folder's files are in the order of partition and offset (see ``write_topic``), and the conditions reach the
    parquet reader: files and row groups that hold nothing of the range are not read.
    """
    if since and starting or until and ending:
        raise ValueError("a range begins and ends at offsets or at times, not at both")
    if topic.servers:
        options = kafka_read_options(topic, starting or "earliest", ending or "latest", min_partitions=min_partitions)
        for name, word, moment in (("startingTimestamp", "startingOffsets", since), ("endingTimestamp", "endingOffsets", until)):
            if moment:
                options[name] = str(round(moment.timestamp() * 1000))
                del options[word]
        return spark.read.format("kafka").options(**options).load()
    messages = spark.read.schema(ENVELOPE).parquet(topic.path)
    for condition in (
        _beyond(topic, starting, "starting"),
        _beyond(topic, ending, "ending"),
        None if since is None else F.col("timestamp") >= F.lit(since),
        None if until is None else F.col("timestamp") < F.lit(until),
    ):
        if condition is not None:
            messages = messages.where(condition)
    return spread(messages, min_partitions)


_EARLIEST, _LATEST = -2, -1


def _beyond(topic: Topic, offsets: str | None, side: str) -> Column | None:
    """The condition that a folder's messages are on the right side of some offsets; None if all are."""
    words = {"earliest": _EARLIEST, "latest": _LATEST}
    if offsets is None or words.get(offsets) == (_EARLIEST if side == "starting" else _LATEST):
        return None
    if offsets in words:
        return F.lit(False)
    try:
        said = json.loads(offsets)[topic.name]
        bounds = {int(partition): int(offset) for partition, offset in said.items()}
    except (ValueError, KeyError, AttributeError, TypeError) as error:
        raise ValueError(f"{side} is earliest, latest or offsets of {topic.name} as JSON, not {offsets}") from error
    kept = ~F.col("partition").isin(list(bounds)) if bounds else F.lit(True)
    for partition, offset in sorted(bounds.items()):
        own = F.col("partition") == partition
        if offset >= 0:
            kept = kept | (own & (F.col("offset") >= offset if side == "starting" else F.col("offset") < offset))
        elif (offset == _EARLIEST) == (side == "starting"):
            kept = kept | own
    return kept


def spread(frame: DataFrame, least: int | None) -> DataFrame:
    """The frame in at least so many partitions, so that parsing does not wait for a few large files.

    Rows are moved only if a scan has fewer pieces than wanted, which a large topic does not.
    """
    if not least or frame.rdd.getNumPartitions() >= least:
        return frame
    return frame.repartition(least)


def as_messages(records: DataFrame, topic_name: str) -> DataFrame:
    """Messages without a key from ``payload`` texts."""
    return records.select(
        F.lit(None).cast("binary").alias("key"),
        encode_value(F.col("payload")).alias("value"),
        F.lit(topic_name).alias("topic"),
    )


def write_topic(messages: DataFrame, topic: Topic, max_records_per_file: int = 0) -> None:
    """Append messages to a topic. The write ends when every message is stored.

    A Kafka broker assigns partition and offset. In a folder the writing task stands for the partition
    and the row's place in it for the offset, above what the partition already holds, which takes no shuffle;
    messages that already have them keep theirs. Writes to one folder come one after another.

    A folder's files are sorted by partition and offset, in row groups of ``ROW_GROUP`` bytes, so that a range is
    found by their bounds. The next offset of each partition is kept beside them, so that a write reads only what was
    written since the one before.
    """
    if topic.servers:
        (
            messages.select("key", "value")
            .write.format("kafka")
            .options(**kafka_write_options(topic))
            .save()
        )
        return
    placed = messages
    if "offset" not in messages.columns:
        row = F.monotonically_increasing_id()
        placed = messages.withColumn("__partition", F.shiftright(row, _ROW_BITS)).withColumn(
            "__offset", row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        )
        if (held := _held(messages.sparkSession, topic)) is not None:
            # One row for each partition, as many as a write has tasks.
            placed = placed.join(F.broadcast(held), "__partition", "left").withColumn(
                "__offset", F.col("__offset") + F.coalesce(F.col("__next"), F.lit(0))
            )
    assigned = {
        "partition": F.col("__partition"),
        "offset": F.col("__offset"),
        "timestamp": F.current_timestamp(),
        "timestampType": F.lit(0),
    }
    columns = [
        (F.col(f.name) if f.name in messages.columns else assigned[f.name]).cast(f.dataType).alias(f.name)
        for f in ENVELOPE
    ]
    rows = placed.select(*columns)
    if "offset" in messages.columns:
        rows = rows.sortWithinPartitions("partition", "offset")  # else they are in this order
    stored = rows.write.mode("append").option("parquet.block.size", ROW_GROUP)
    stored.option("maxRecordsPerFile", max_records_per_file).parquet(topic.path)


_OFFSETS = schema("partition long, next long, seen timestamp")


def _held(spark: SparkSession, topic: Topic) -> DataFrame | None:
    """The next offset of each partition of a folder topic; None if there is no such folder yet.

    It is kept in the topic's folder, with the time up to which files are in it; files changed since an hour before
    that time are read again, and the others are left out by their names' times alone. The table is written to two
    places in turn, so one of them is always whole.
    """
    try:
        stored = spark.read.schema(ENVELOPE).parquet(topic.path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    now = datetime.now(UTC)
    path = f"{topic.path}/_offsets"
    slot = 0
    known = spark.createDataFrame([], _OFFSETS)
    try:
        kept = spark.read.schema(T.StructType([*_OFFSETS, T.StructField("slot", T.IntegerType())])).json(path)
        newest = kept.agg(F.max_by("slot", "seen").alias("slot"), F.max("seen").alias("seen")).first()
        if newest.slot is not None:
            slot, known = 1 - newest.slot, kept.where(F.col("slot") == newest.slot).drop("slot")
            stored = stored.where(F.col("_metadata.file_modification_time") >= F.lit(newest.seen - _OVERLAP))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    counted = stored.groupBy(F.col("partition").cast("long").alias("partition")).agg((F.max("offset") + 1).alias("next"))
    counted = counted.unionByName(known.select("partition", "next")).groupBy("partition").agg(F.max("next").alias("next"))
    place = f"{path}/slot={slot}"
    counted.withColumn("seen", F.lit(now)).coalesce(1).write.mode("overwrite").json(place)
    written = spark.read.schema(_OFFSETS).json(place)
    return written.select(F.col("partition").alias("__partition"), F.col("next").alias("__next"))
