"""Registered queries: every operator of the package over the given tables, and the SQL each must equal."""

from __future__ import annotations

import json
import math
import sys
import time
from collections.abc import Callable
from contextlib import suppress
from dataclasses import replace
from datetime import timedelta
from pathlib import Path

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

sys.path.insert(0, str(Path(__file__).resolve().parent))

from dispatchflow.config import CALLS, CountSpec
from dispatchflow.functions import plain_time
from dispatchflow.operators import (
    call_events,
    distinct_events,
    drop_null_keys,
    flatten_window,
    parse_payload,
    tap_lines,
    window_counts,
)
from dispatchflow.plans import counts_plan, enriched_plan
from dispatchflow.schemas import CALL_RECORD
from dispatchflow.session import streaming_session, work_dir
from dispatchflow.sources import (
    Topic,
    as_messages,
    json_array_records,
    json_line_records,
    radio_codes,
    split_array_records,
    split_typed_records,
    spread,
    topic_batch,
    topic_stream,
    typed_array_records,
    write_topic,
)
from dispatchflow.sources.tables import (
    TOPIC_NAME,
    as_calls,
    as_envelope,
    events_table,
    nation_codes,
    nations_table,
    write_json_array,
    write_json_arrays,
    write_json_lines,
)
from dispatchflow.streaming import (
    ProgressLog,
    compact,
    open_windows,
    read_days,
    read_output,
    read_together,
    start_counts,
    start_counts_and_enriched,
    start_daily_counts,
    start_files,
    stop_between_batches,
)
from dispatchflow.streaming.run import COUNTS_QUERY, start_text

Query = Callable[[SparkSession, str], DataFrame]

# The calls' times are whole minutes, so counting by the minute gives the same.
BY_MINUTE = CountSpec(resolution="minute")
WIDE = CountSpec(window="60 minutes")
ONE_DAY = 9
# Bytes of the blocks that one large array is read in, so that small tables have several too.
ARRAY_BLOCK = 1 << 16
RECORDS_PER_ARRAY = 20_000
CODES_PER_ARRAY = 1_000
LIMITED_BATCHES = 5
# The streams take the events in time order, so many slices, a batch for each.
SLICES = 6
FILES_A_SLICE = 4
STATE_PARTITIONS = 8
STREAM_SECONDS = 3600


def _shown(frame: DataFrame) -> DataFrame:
    """Instants as plain times, windows as two columns, and no batch number: what the SQL yields."""
    flat = flatten_window(frame)
    return flat.select(
        *(
            plain_time(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in flat.schema
            if f.name != "batch_id"
        )
    )


def _utc(query: Query) -> Query:
    """The tables' times have no zone; read them as UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_envelope(spread(events_table(spark, sf_dir), spark.sparkContext.defaultParallelism))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = parse_payload(_envelope(spark, sf_dir), CALLS.payload_columns)
    return call_events(drop_null_keys(records))


# Batch operators


def _parse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(parse_payload(_envelope(spark, sf_dir)))


def _drop_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(drop_null_keys(parse_payload(_envelope(spark, sf_dir))))


def _distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(distinct_events(_events(spark, sf_dir)))


def _window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(counts_plan(_envelope(spark, sf_dir)))


def _enriched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(enriched_plan(_envelope(spark, sf_dir), nation_codes(spark, sf_dir)))


def _enriched_counts_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(enriched_plan(_envelope(spark, sf_dir), nation_codes(spark, sf_dir), BY_MINUTE))


def _wide_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour every five minutes, from panes."""
    return _shown(counts_plan(_envelope(spark, sf_dir), WIDE))


def _wide_window_counts_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(counts_plan(_envelope(spark, sf_dir), replace(WIDE, resolution="minute")))


def _text_time_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the minute where times are text with seconds, and calls of a full hour have none."""
    records = drop_null_keys(parse_payload(_envelope(spark, sf_dir)))
    seconds = F.make_dt_interval(secs=F.col("crime_id").cast("bigint") % 60)
    time = F.when(F.minute("call_date_time") != 0, F.col("call_date_time") + seconds)
    texts = records.withColumn("call_date_time", F.date_format(time, "yyyy-MM-dd HH:mm:ss"))
    return _shown(window_counts(call_events(texts, BY_MINUTE), BY_MINUTE))


def _topic_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic followed into text files."""
    folder = work_dir(spark, "tap")
    topic = _topic_in_slices(spark, sf_dir, folder)
    lines = tap_lines(topic_stream(streaming_session(spark, STATE_PARTITIONS), topic, max_files=FILES_A_SLICE))
    _finish(start_text(lines, f"{folder}/out", "tap", f"{folder}/checkpoint", trigger=None))
    return spark.read.text(f"{folder}/out").select(F.col("value").alias("line"))


# Files and topics


def _dim_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "codes")
    write_json_arrays(nations_table(spark, sf_dir), path, CODES_PER_ARRAY)
    return radio_codes(spark, path)


def _published(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Publish payloads to a new topic and parse what the topic then holds."""
    topic = Topic(TOPIC_NAME, folder=work_dir(spark, "topic"))
    write_topic(as_messages(records, topic.name), topic)
    return _shown(parse_payload(topic_batch(spark, topic)))


def _array_files(spark: SparkSession, sf_dir: str) -> str:
    path = work_dir(spark, "arrays")
    write_json_arrays(as_calls(events_table(spark, sf_dir)), path, RECORDS_PER_ARRAY)
    return path


def _publish_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, json_array_records(spark, _array_files(spark, sf_dir)))


def _publish_typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, typed_array_records(spark, _array_files(spark, sf_dir), CALL_RECORD))


def _large_array(spark: SparkSession, sf_dir: str) -> str:
    path = work_dir(spark, "array")
    write_json_array(as_calls(events_table(spark, sf_dir)), path)
    return path


def _publish_large_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls from one array in one file, read in blocks."""
    return _published(spark, split_array_records(spark, _large_array(spark, sf_dir), ARRAY_BLOCK))


def _publish_large_typed_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, split_typed_records(spark, _large_array(spark, sf_dir), CALL_RECORD, ARRAY_BLOCK))


def _publish_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "lines")
    write_json_lines(as_calls(events_table(spark, sf_dir)), path)
    return _published(spark, json_line_records(spark, path))


def _topic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "scan")
    topic = Topic(TOPIC_NAME, folder=f"{folder}/topics")
    write_topic(_envelope(spark, sf_dir), topic)
    messages = topic_stream(streaming_session(spark), topic)
    start_files(messages, f"{folder}/out", "scan", f"{folder}/checkpoint", trigger=None).awaitTermination()
    read = read_output(spark, f"{folder}/out")
    return read.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))


def _rate_limited_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per day read under a limit on files a batch, and whether every batch kept to the limit."""
    folder = work_dir(spark, "limited")
    topic = Topic(TOPIC_NAME, folder=f"{folder}/topics")
    per_file = math.ceil(events_table(spark, sf_dir).count() / (2 * LIMITED_BATCHES))
    write_topic(_envelope(spark, sf_dir), topic, max_records_per_file=max(per_file, 1))
    files = len(topic_batch(spark, topic).inputFiles())
    limit = math.ceil(files / LIMITED_BATCHES)
    stream = topic_stream(streaming_session(spark), topic, max_files=limit)
    read = stream.select(
        F.to_date(plain_time(F.col("timestamp"))).alias("call_date"), F.col("_metadata.file_path").alias("file")
    )
    start_files(read, f"{folder}/out", "limited", f"{folder}/checkpoint", trigger=None).awaitTermination()
    output = read_output(spark, f"{folder}/out")
    batches = output.groupBy("batch_id", "file").agg(F.lit(1).alias("one")).groupBy("batch_id").count()
    return output.groupBy("call_date").agg(F.count(F.lit(1)).alias("calls")).select(
        "call_date",
        "calls",
        batches.agg(F.count(F.lit(1)) == math.ceil(files / limit)).scalar().alias("batches_as_planned"),
        batches.agg(F.max("count") <= limit).scalar().alias("within_limit"),
    )


# Streams


def _finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for a query that ends by itself; a failure of it is raised."""
    if not query.awaitTermination(STREAM_SECONDS):
        query.stop()
        raise TimeoutError(f"{query.name} ran for more than {STREAM_SECONDS} s")
    return query


def _topic_in_slices(spark: SparkSession, sf_dir: str, folder: str) -> Topic:
    """All events as a topic that was written slice by slice in the order of time."""
    events = events_table(spark, sf_dir)
    topic = Topic(TOPIC_NAME, folder=f"{folder}/topics")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    bounds = [first + (last - first) * i / SLICES for i in range(1, SLICES)] if first else []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        slice_ = events
        if low is not None:
            slice_ = slice_.where(F.col("ts") >= F.lit(low))
        if high is not None:
            slice_ = slice_.where(F.col("ts") < F.lit(high))
        write_topic(as_envelope(slice_.repartition(FILES_A_SLICE)), topic)
    return topic


def _messages_in_slices(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    topic = _topic_in_slices(spark, sf_dir, folder)
    return topic_stream(streaming_session(spark, STATE_PARTITIONS), topic, max_files=FILES_A_SLICE)


def _stream_counts(spark: SparkSession, sf_dir: str, spec: CountSpec) -> DataFrame:
    folder = work_dir(spark, "counts")
    counts = counts_plan(_messages_in_slices(spark, sf_dir, folder), spec)
    _finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
    return _shown(read_output(spark, f"{folder}/out"))


def _stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_counts(spark, sf_dir, CALLS)


def _stream_counts_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_counts(spark, sf_dir, BY_MINUTE)


def _stream_counts_one_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of exact times with one state operator, the parts of a window added up where its batch is written."""
    folder = work_dir(spark, "parts")
    counts = counts_plan(_messages_in_slices(spark, sf_dir, folder), parts=True)
    _finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
    return _shown(read_output(spark, f"{folder}/out"))


def _stream_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that the stream of counts has not closed at the end, read from its state."""
    folder = work_dir(spark, "open")
    counts = counts_plan(_messages_in_slices(spark, sf_dir, folder))
    _finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
    return _shown(open_windows(spark, f"{folder}/checkpoint"))


def _stream_two_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outputs of a query that failed between its two writes and was run again, read together.

    ``same_after_failure``: after the failure a reader saw as many windows in both, though the first held more.
    """
    folder = work_dir(spark, "two")
    counts_folder, enriched_folder = f"{folder}/counts", f"{folder}/enriched"
    messages = _messages_in_slices(spark, sf_dir, folder)
    calls = []

    def failing(session: SparkSession) -> DataFrame:
        calls.append(1)
        if len(calls) == SLICES // 2:
            raise ConnectionError("the code table is out of reach")
        return nation_codes(session, sf_dir)

    def run(codes: Callable[[SparkSession], DataFrame]) -> StreamingQuery:
        return start_counts_and_enriched(
            counts_plan(messages, parts=True), codes, counts_folder, enriched_folder, f"{folder}/checkpoint", trigger=None
        )

    with suppress(StreamingQueryException):
        _finish(run(failing))
    counts, enriched = (frame.count() for frame in read_together(spark, counts_folder, enriched_folder))
    written = spark.read.parquet(counts_folder).count()
    _finish(run(lambda session: nation_codes(session, sf_dir)))
    counted, described = read_together(spark, counts_folder, enriched_folder)
    both = described.join(counted, counted.columns, "left_semi")
    return _shown(both).withColumn("same_after_failure", F.lit(counts == enriched and written > counts))


def _joined_stream(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    folder = work_dir(spark, how)
    query = start_counts_and_enriched(
        counts_plan(_messages_in_slices(spark, sf_dir, folder), parts=True),
        lambda session: nation_codes(session, sf_dir),
        f"{folder}/counts",
        f"{folder}/joined",
        f"{folder}/checkpoint",
        trigger=None,
        how=how,
    )
    _finish(query)
    return _shown(read_output(spark, f"{folder}/joined"))


def _stream_one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that begin on the tenth day, from output by day: a batch came twice, and days before were compacted."""
    folder = work_dir(spark, "daily")
    out, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    counts = counts_plan(_messages_in_slices(spark, sf_dir, folder), parts=True)
    _finish(start_daily_counts(counts, out, checkpoint, "daily", trigger=None))
    first = events_table(spark, sf_dir).agg(F.date_add(F.to_date(F.min("ts")), ONE_DAY)).first()[0]
    again = read_days(spark, out, first, first + timedelta(days=1)).drop("day")
    # The last try of a batch that is not committed, with rows that are already there.
    tried = again.withColumns({"day": F.lit(first), "run": F.lit("not-committed"), "batch_id": F.lit(0).cast("long")})
    tried.write.mode("append").partitionBy("day", "run", "batch_id").parquet(out)
    compact(spark, out, first + timedelta(days=2))
    return _shown(read_days(spark, out, first, first + timedelta(days=1)).drop("day"))


def _topic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the offsets of one partition of a topic, and none of the others."""
    topic = Topic(TOPIC_NAME, folder=work_dir(spark, "range"))
    write_topic(_envelope(spark, sf_dir), topic)
    quarter = events_table(spark, sf_dir).count() // 16
    low, high = ({"0": -1, "1": quarter, "2": -1, "3": -1}, {"1": 2 * quarter})
    messages = topic_batch(
        spark, topic, json.dumps({TOPIC_NAME: low}), json.dumps({TOPIC_NAME: high})
    )
    return messages.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))


def _topic_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of one day of a topic, by their times."""
    topic = Topic(TOPIC_NAME, folder=work_dir(spark, "times"))
    write_topic(_envelope(spark, sf_dir), topic)
    first = events_table(spark, sf_dir).agg(F.date_trunc("day", F.min("ts")).cast("timestamp")).first()[0]
    since = first + timedelta(days=ONE_DAY)
    messages = topic_batch(spark, topic, since=since, until=since + timedelta(days=1))
    return messages.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))


def _stream_known_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of known codes, with descriptions."""
    return _joined_stream(spark, sf_dir, "inner")


def _stream_unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of codes that the code table does not have."""
    return _joined_stream(spark, sf_dir, "left_anti")


def _stream_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with a processing-time trigger, stopped while messages are left, started again and run to their end.

    ``went_on``: the first run ended before the last slice, and the second began where it ended.
    """
    folder = work_dir(spark, "stopped")
    messages = _messages_in_slices(spark, sf_dir, folder)

    def start() -> StreamingQuery:
        counts = counts_plan(messages, parts=True)
        return start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger="1 second")

    first = start()
    until = time.monotonic() + STREAM_SECONDS
    while first.isActive and not first.recentProgress and time.monotonic() < until:
        time.sleep(0.05)
    stop_between_batches(first)
    done = [p.batchId for p in first.recentProgress if p.numInputRows]
    second = start()
    second.processAllAvailable()
    stop_between_batches(second)
    rest = [p.batchId for p in second.recentProgress if p.numInputRows]
    went_on = len(done) < SLICES and rest[:1] == [done[-1] + 1] and len(done) + len(rest) == SLICES
    return _shown(read_output(spark, f"{folder}/out")).withColumn("went_on", F.lit(went_on))


def _stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct calls as a stream of its own. Slices are in the order of time, so that no row is late."""
    folder = work_dir(spark, "distinct")
    records = parse_payload(_messages_in_slices(spark, sf_dir, folder), CALLS.payload_columns)
    events = distinct_events(call_events(drop_null_keys(records)))
    _finish(start_files(events, f"{folder}/out", "distinct", f"{folder}/checkpoint", trigger=None))
    return _shown(read_output(spark, f"{folder}/out"))


def _stream_enriched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "enriched")
    query = start_counts_and_enriched(
        counts_plan(_messages_in_slices(spark, sf_dir, folder)),
        lambda session: nation_codes(session, sf_dir),
        f"{folder}/counts",
        f"{folder}/enriched",
        f"{folder}/checkpoint",
        trigger=None,
    )
    _finish(query)
    return _shown(read_output(spark, f"{folder}/enriched"))


def _stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, then a second delivery of new events at old times: none of those may count."""
    folder = work_dir(spark, "late")
    topic = _topic_in_slices(spark, sf_dir, folder)

    def run() -> None:
        messages = topic_stream(streaming_session(spark, STATE_PARTITIONS), topic, max_files=FILES_A_SLICE)
        counts = counts_plan(messages)
        _finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))

    events = events_table(spark, sf_dir)
    run()
    newest = events.agg(F.max("ts")).scalar()
    shifted = events.where(F.col("ts") < newest - F.expr("interval 1 day")).withColumn(
        "event_type", F.concat("event_type", F.lit(" late"))
    )
    write_topic(as_envelope(shifted.repartition(FILES_A_SLICE)), topic)
    run()
    return _shown(read_output(spark, f"{folder}/out"))


def _stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a query that is run anew after each slice of the topic, and goes on where it ended."""
    folder = work_dir(spark, "restart")
    events = events_table(spark, sf_dir)
    middle = events.agg(F.percentile_approx("ts", 0.5)).scalar()
    topic = Topic(TOPIC_NAME, folder=f"{folder}/topics")
    for part in (F.col("ts") < middle, F.col("ts") >= middle):
        write_topic(as_envelope(events.where(part).repartition(FILES_A_SLICE)), topic)
        counts = counts_plan(topic_stream(streaming_session(spark, STATE_PARTITIONS), topic))
        _finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
    return _shown(read_output(spark, f"{folder}/out"))


def _publish_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, and different places of messages, of a topic that was published to twice."""
    topic = Topic(TOPIC_NAME, folder=work_dir(spark, "twice"))
    payloads = _envelope(spark, sf_dir).select(F.col("value").cast("string").alias("payload"))
    for _ in range(2):
        write_topic(as_messages(payloads, topic.name), topic)
    places = topic_batch(spark, topic).groupBy("partition", "offset").agg(F.count(F.lit(1)).alias("n"))
    return places.agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("places"))


def _progress_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a run's progress is the same every time: rows, batches with rows, and the last watermark."""
    folder = work_dir(spark, "progress")
    messages = _messages_in_slices(spark, sf_dir, folder)
    session = messages.sparkSession
    log = ProgressLog(session, f"{folder}/progress")
    session.streams.addListener(log)
    try:
        _finish(start_counts(counts_plan(messages), f"{folder}/out", f"{folder}/checkpoint", trigger=None))
        log.close()
    finally:
        session.streams.removeListener(log)
    kept = spark.read.parquet(f"{folder}/progress")
    return kept.groupBy("query").agg(
        F.sum("num_input_rows").alias("num_input_rows"),
        F.count_if(F.col("num_input_rows") > 0).alias("batches"),
        plain_time(F.max("watermark")).alias("watermark"),
        (F.max("state_rows") < F.sum("num_input_rows")).alias("state_below_input"),
        F.bool_and(F.col("end_offset").startswith("[")).alias("has_offsets"),
    )


_QUERIES: dict[str, Query] = {
    "parse_payload": _parse_payload,
    "drop_null_keys": _drop_null_keys,
    "distinct_events": _distinct_events,
    "window_counts": _window_counts,
    "enriched_counts": _enriched_counts,
    "enriched_counts_by_minute": _enriched_counts_by_minute,
    "wide_window_counts": _wide_window_counts,
    "wide_window_counts_by_minute": _wide_window_counts_by_minute,
    "text_time_counts": _text_time_counts,
    "topic_tap": _topic_tap,
    "dim_scan": _dim_scan,
    "publish_records": _publish_records,
    "publish_typed_records": _publish_typed_records,
    "publish_large_array": _publish_large_array,
    "publish_large_typed_array": _publish_large_typed_array,
    "publish_json_lines": _publish_json_lines,
    "topic_scan": _topic_scan,
    "rate_limited_batches": _rate_limited_batches,
    "stream_window_counts": _stream_window_counts,
    "stream_window_counts_by_minute": _stream_counts_by_minute,
    "stream_counts_one_state": _stream_counts_one_state,
    "stream_open_windows": _stream_open_windows,
    "stream_two_outputs": _stream_two_outputs,
    "stream_one_day": _stream_one_day,
    "topic_range": _topic_range,
    "topic_time_range": _topic_time_range,
    "stream_known_codes": _stream_known_codes,
    "stream_unknown_codes": _stream_unknown_codes,
    "stream_stopped": _stream_stopped,
    "stream_distinct_events": _stream_distinct_events,
    "stream_enriched_counts": _stream_enriched_counts,
    "stream_late_rows": _stream_late_rows,
    "stream_restart": _stream_restart,
    "publish_twice": _publish_twice,
    "progress_table": _progress_table,
}


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL over training data, where that subpackage, the pipeline and what they import are installed."""
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    try:
        from dispatchflow.llm import queries as own

        found |= own.QUERIES
        sql |= own.ORACLE
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ImportError as error:
        print(f"queries over training data are left out in part: {error}", file=sys.stderr)
    return found, sql


def entry(spark: SparkSession) -> DataFrame:
    """Sliding counts of distinct calls with the description of their code."""
    return queries()["enriched_counts"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """Every operator by name: a callable of session and table folder."""
    return {name: _utc(query) for name, query in (_QUERIES | _training_data()[0]).items()}


# The same in SQL

_CALLS = """
calls as (
  select cast(event_id as varchar) as crime_id,
         event_type as original_crime_type_name,
         cast(date_trunc('day', ts) as timestamp) as report_date,
         cast(date_trunc('day', ts) as timestamp) as call_date,
         cast(date_trunc('day', ts) as timestamp) as offense_date,
         strftime(ts, '%H:%M') as call_time,
         date_trunc('minute', ts) as call_date_time,
         nullif(cast(user_id % 40 as varchar), '7') as disposition,
         props as address,
         cast(null as varchar) as city,
         cast(null as varchar) as state,
         cast(user_id as varchar) as agency_id,
         cast(null as varchar) as address_type,
         cast(null as varchar) as common_location
  from events
)"""

_MESSAGES = (
    _CALLS
    + """,
messages as (
  select 'calls' as topic,
         cast(cast(crime_id as bigint) % 4 as integer) as partition,
         cast(crime_id as bigint) // 4 as "offset",
         cast(to_json({
           'crime_id': crime_id,
           'original_crime_type_name': original_crime_type_name,
           'report_date': strftime(report_date, '%Y-%m-%dT%H:%M:%S.%f'),
           'call_date': strftime(call_date, '%Y-%m-%dT%H:%M:%S.%f'),
           'offense_date': strftime(offense_date, '%Y-%m-%dT%H:%M:%S.%f'),
           'call_time': call_time,
           'call_date_time': strftime(call_date_time, '%Y-%m-%dT%H:%M:%S.%f'),
           'disposition': disposition,
           'address': address,
           'city': city,
           'state': state,
           'agency_id': agency_id,
           'address_type': address_type,
           'common_location': common_location
         }) as varchar) as value
  from calls
)"""
)

_DISTINCT = (
    _CALLS
    + """,
happened as (
  select distinct original_crime_type_name, disposition, call_date_time as call_date_time_ts
  from calls
  where original_crime_type_name is not null and disposition is not null
)"""
)

_COUNTS = (
    _DISTINCT
    + """,
placed as (
  select original_crime_type_name, disposition,
         time_bucket(interval 5 minutes, call_date_time_ts) - k * interval 5 minutes as window_start
  from happened, range(0, 2) as steps(k)
),
counts as (
  select original_crime_type_name, window_start, window_start + interval 10 minutes as window_end,
         disposition, count(*) as "count"
  from placed
  group by all
)"""
)

_WIDE_COUNTS = _COUNTS.replace("range(0, 2)", "range(0, 12)").replace("interval 10 minutes as", "interval 60 minutes as")
_CLOSED = "window_end <= (select max(call_date_time_ts) from happened) - interval 10 minutes"
_WITH_NAMES = (
    "select counts.*, n_name as description from counts "
    "left join nation on cast(n_nationkey as varchar) = disposition"
)


_TIMED_COUNTS = _COUNTS.replace(
    "disposition is not null", "disposition is not null and extract(minute from call_date_time) <> 0"
)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    all_calls = f"with {_CALLS} select * from calls"
    return _training_data()[1] | {
        "parse_payload": all_calls,
        "drop_null_keys": all_calls + " where original_crime_type_name is not null and disposition is not null",
        "distinct_events": f"with {_DISTINCT} select * from happened",
        "window_counts": f"with {_COUNTS} select * from counts",
        "enriched_counts": f"with {_COUNTS} {_WITH_NAMES}",
        "enriched_counts_by_minute": f"with {_COUNTS} {_WITH_NAMES}",
        "text_time_counts": f"with {_TIMED_COUNTS} select * from counts",
        "stream_distinct_events": f"with {_DISTINCT} select * from happened",
        "topic_tap": f"with {_MESSAGES} select concat(topic, ':', partition, ':', \"offset\", "
        "': key=null value=', value) as line from messages",
        "dim_scan": "select cast(n_nationkey as varchar) as disposition, n_name as description from nation",
        "publish_records": all_calls,
        "publish_typed_records": all_calls,
        "publish_json_lines": all_calls,
        "topic_scan": f"with {_MESSAGES} select * from messages",
        "rate_limited_batches": "select cast(ts as date) as call_date, count(*) as calls, "
        "true as batches_as_planned, true as within_limit from events group by 1",
        "stream_window_counts": f"with {_COUNTS} select * from counts where {_CLOSED}",
        "stream_window_counts_by_minute": f"with {_COUNTS} select * from counts where {_CLOSED}",
        "stream_enriched_counts": f"with {_COUNTS} {_WITH_NAMES} where {_CLOSED}",
        "stream_counts_one_state": f"with {_COUNTS} select * from counts where {_CLOSED}",
        "stream_open_windows": f"with {_COUNTS} select * from counts where not ({_CLOSED})",
        "stream_two_outputs": f"with {_COUNTS} {_WITH_NAMES.replace('n_name as', 'true as same_after_failure, n_name as')} where {_CLOSED}",
        "stream_one_day": f"with {_COUNTS} select * from counts where {_CLOSED} "
        f"and cast(window_start as date) = (select cast(min(ts) as date) + {ONE_DAY} from events)",
        "topic_range": f"with {_MESSAGES} select * from messages where partition = 1 "
        'and "offset" >= (select count(*) // 16 from events) and "offset" < 2 * (select count(*) // 16 from events)',
        "topic_time_range": f"with {_MESSAGES} select messages.* from messages "
        'join events on event_id = 4 * "offset" + partition '
        f"where cast(ts as date) = (select cast(min(ts) as date) + {ONE_DAY} from events)",
        "stream_known_codes": f"with {_COUNTS} {_WITH_NAMES} where {_CLOSED} and n_name is not null",
        "stream_unknown_codes": f"with {_COUNTS} select * from counts where {_CLOSED} "
        "and disposition not in (select cast(n_nationkey as varchar) from nation)",
        "stream_stopped": f"with {_COUNTS} select *, true as went_on from counts where {_CLOSED}",
        "wide_window_counts": f"with {_WIDE_COUNTS} select * from counts",
        "wide_window_counts_by_minute": f"with {_WIDE_COUNTS} select * from counts",
        "publish_large_array": all_calls,
        "publish_large_typed_array": all_calls,
        "stream_restart": f"with {_COUNTS} select * from counts where {_CLOSED}",
        "publish_twice": "select 2 * count(*) as messages, 2 * count(*) as places from events",
        "progress_table": f"with {_DISTINCT} select '{COUNTS_QUERY}' as query, "
        f"(select count(*) from events) as num_input_rows, {SLICES} as batches, "
        "(select max(call_date_time_ts) - interval 10 minutes from happened) as watermark, "
        "true as state_below_input, true as has_offsets",
        "stream_late_rows": f"with {_COUNTS} select * from counts where {_CLOSED}",
    }
