"""Command line: publish records, tap a topic, run the sliding counts."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dispatchflow.config import CountSpec
from dispatchflow.functions import plain_time
from dispatchflow.operators import flatten_window, tap_lines
from dispatchflow.plans import counts_plan, enriched_plan
from dispatchflow.schemas import CALL_RECORD
from dispatchflow.session import build_session, state_partitions, streaming_session
from dispatchflow.sources import (
    Topic,
    as_messages,
    builtin_codes,
    json_array_records,
    json_line_records,
    radio_codes,
    topic_batch,
    topic_stream,
    typed_array_records,
    write_topic,
)
from dispatchflow.streaming import (
    ProgressLog,
    start_console,
    start_counts,
    start_counts_and_enriched,
    start_printed_counts,
    wait_for_any,
)
from dispatchflow.streaming.run import COUNTS_QUERY, TRIGGER, print_rows, start_text

_READERS = {
    "array": json_array_records,
    "lines": json_line_records,
    "calls": lambda spark, path: typed_array_records(spark, path, CALL_RECORD),
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m dispatchflow")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, summary: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=summary)
        sub.add_argument("--topic", required=True)
        home = sub.add_mutually_exclusive_group(required=True)
        home.add_argument("--servers", help="Kafka bootstrap servers")
        home.add_argument("--folder", help="folder that holds the topic as parquet files")
        sub.add_argument("--option", action="append", default=[], metavar="K=V", help="Kafka: a client option")
        sub.add_argument("--master")
        sub.add_argument("--shuffle-partitions", type=int)
        return sub

    publish = command("publish", "send the records of JSON files as messages")
    publish.add_argument("--input", required=True)
    publish.add_argument("--format", choices=sorted(_READERS), default="array")

    tap = command("tap", "show a topic's messages as lines")
    tap.add_argument("--follow", action="store_true", help="go on with messages to come")
    tap.add_argument("--rows", type=int, help="show so many lines only; not with --follow or --output")
    tap.add_argument("--output", help="folder for the lines as text files; printed if left out")
    tap.add_argument("--starting", help="Kafka: first offsets")
    tap.add_argument("--ending", help="Kafka: last offsets, without --follow")
    tap.add_argument("--once", action="store_true", help="with --follow: take what the topic holds and end")
    tap.add_argument("--checkpoint", help="needed with --follow")

    history = command("history", "count over all messages a topic holds, open windows included")
    history.add_argument("--output", required=True)
    history.add_argument("--codes")

    live = command("stream", "count closed windows as messages arrive")
    live.add_argument("--checkpoint", required=True)
    live.add_argument("--output", help="folder for results; printed if left out")
    live.add_argument("--codes", help="JSON array files with the codes; the known radio codes if left out")
    live.add_argument("--plain", action="store_true", help="counts only, no descriptions")
    live.add_argument("--progress", help="folder for the progress table")
    live.add_argument("--trigger", default=TRIGGER)
    live.add_argument("--once", action="store_true", help="take what the topic holds and end")
    live.add_argument("--starting", help="Kafka: first offsets of a new checkpoint")
    live.add_argument("--max-per-trigger", type=int, help="Kafka: offsets a batch")
    live.add_argument("--min-partitions", type=int, help="Kafka: least number of read tasks")
    live.add_argument("--max-files", type=int, help="folder: files a batch")
    live.add_argument("--max-bytes", type=int, help="folder: bytes a batch")
    for sub in (history, live):
        sub.add_argument("--window", default=CountSpec.window)
        sub.add_argument("--slide", default=CountSpec.slide)
        sub.add_argument("--delay", default=CountSpec.delay)
        sub.add_argument("--resolution", choices=["second", "minute"], help="cut call times to this")
    return parser


def _codes(spark: SparkSession, path: str | None, spec: CountSpec) -> DataFrame:
    return radio_codes(spark, path, spec) if path else builtin_codes(spark, spec)


def _spec(args: argparse.Namespace) -> CountSpec:
    return CountSpec(window=args.window, slide=args.slide, delay=args.delay, resolution=args.resolution)


def _publish(spark: SparkSession, topic: Topic, args: argparse.Namespace) -> None:
    write_topic(as_messages(_READERS[args.format](spark, args.input), topic.name), topic)


def _tap(spark: SparkSession, topic: Topic, args: argparse.Namespace) -> None:
    if args.rows is not None and (args.follow or args.output):
        raise SystemExit("--rows is a preview: not with --follow or --output")
    if not args.follow:
        lines = tap_lines(topic_batch(spark, topic, args.starting, args.ending))
        if args.output:
            lines.write.text(args.output)
        else:
            print_rows(lines if args.rows is None else lines.limit(args.rows))
        return
    if not args.checkpoint:
        raise SystemExit("--follow needs --checkpoint")
    lines = tap_lines(topic_stream(spark, topic, args.starting))
    trigger = None if args.once else TRIGGER
    if args.output:
        query = start_text(lines, args.output, "tap", args.checkpoint, trigger)
    else:
        query = start_console(lines, "tap", args.checkpoint, trigger)
    query.awaitTermination()


def _history(spark: SparkSession, topic: Topic, args: argparse.Namespace) -> None:
    spec = _spec(args)
    messages = topic_batch(spark, topic, min_partitions=spark.sparkContext.defaultParallelism)
    counts = flatten_window(enriched_plan(messages, _codes(spark, args.codes, spec), spec))
    dated = counts.withColumn("window_date", F.to_date(plain_time(F.col("window_start"))))
    sized = dated.hint("rebalance", F.col("window_date"))
    sized.write.partitionBy("window_date").mode("overwrite").parquet(args.output)


def _start_stream(spark: SparkSession, topic: Topic, args: argparse.Namespace) -> StreamingQuery:
    spec = _spec(args)
    trigger = None if args.once else args.trigger
    messages = topic_stream(
        spark, topic, args.starting, args.max_per_trigger, args.min_partitions, args.max_files, args.max_bytes
    )
    if args.output and args.plain:
        return start_counts(counts_plan(messages, spec, parts=True), f"{args.output}/counts", args.checkpoint, trigger=trigger)
    if args.output:
        return start_counts_and_enriched(
            counts_plan(messages, spec, parts=True),
            lambda session: _codes(session, args.codes, spec),
            f"{args.output}/counts",
            f"{args.output}/enriched",
            args.checkpoint,
            spec,
            trigger=trigger,
        )
    if args.plain:
        return start_console(flatten_window(counts_plan(messages, spec)), COUNTS_QUERY, args.checkpoint, trigger)
    return start_printed_counts(
        counts_plan(messages, spec, parts=True),
        lambda session: _codes(session, args.codes, spec),
        args.checkpoint,
        spec,
        trigger=trigger,
    )


def _stream(spark: SparkSession, topic: Topic, args: argparse.Namespace) -> None:
    session = streaming_session(spark, args.shuffle_partitions or state_partitions(spark))
    log = ProgressLog(session, args.progress) if args.progress else None
    if log:
        session.streams.addListener(log)
    _start_stream(session, topic, args)
    try:
        wait_for_any(session)
    finally:
        for query in session.streams.active:
            query.stop()
        if log:
            log.close()


_COMMANDS = {"publish": _publish, "tap": _tap, "history": _history, "stream": _stream}


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session(f"dispatchflow-{args.command}", args.master, args.shuffle_partitions)
    options = dict(pair.split("=", 1) for pair in args.option)
    topic = Topic(args.topic, servers=args.servers, folder=args.folder, options=options)
    _COMMANDS[args.command](spark, topic, args)
