"""Starting streaming queries: append mode, a checkpoint always, one output folder per run and batch, and a commit log."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from dispatchflow.config import CALLS, CountSpec
from dispatchflow.operators import add_parts, flatten_window, with_descriptions
from dispatchflow.operators.enrich import CodeTableSize, check_how
from dispatchflow.streaming.commits import CommitLog, Commits, up_to

# Query names and trigger of the calls-for-service job.
COUNTS_QUERY = "Original Crime Type Count Aggregation"
ENRICHED_QUERY = "Join with radio codes"
TRIGGER = "30 seconds"


# By the run of a query, whether it has been asked to stop.
_ASKED: dict[str, threading.Event] = {}


class StoppedBetweenBatches(Exception):
    """A query was asked to stop and has not begun its next batch."""


def _writer(frame: DataFrame, name: str, checkpoint: str, trigger: str | None) -> DataStreamWriter:
    """Append: a window comes out once, when it is closed. Without a trigger, take what is there and end."""
    writer = frame.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)


def start_console(
    frame: DataFrame, name: str, checkpoint: str, trigger: str | None = TRIGGER
) -> StreamingQuery:
    """Print every row of each batch, one a line. Rows reach the driver a partition at a time."""

    def show(batch: DataFrame, batch_id: int) -> None:
        print_rows(batch, f"Batch: {batch_id}")

    return start_each(frame, show, name, checkpoint, trigger)


def print_rows(frame: DataFrame, title: str | None = None) -> None:
    """All rows as lines on the driver's output: the only column as it is, several between bars."""
    if title:
        print(f"{title}: {' | '.join(frame.columns)}", flush=True)
    for row in frame.toLocalIterator():
        print(" | ".join(str(value) for value in row), flush=True)


def start_printed_counts(
    counts: DataFrame,
    codes: Callable[[SparkSession], DataFrame],
    checkpoint: str,
    spec: CountSpec = CALLS,
    name: str = ENRICHED_QUERY,
    trigger: str | None = TRIGGER,
) -> StreamingQuery:
    """Print closed windows, and the same with descriptions, of each batch that has any."""

    def show(batch: DataFrame, batch_id: int) -> None:
        batch = add_parts(batch).persist()
        try:
            if not batch.isEmpty():
                print_rows(batch, f"Batch: {batch_id}, {COUNTS_QUERY}")
                joined = with_descriptions(batch, codes(batch.sparkSession), spec)
                print_rows(joined, f"Batch: {batch_id}, {name}")
        finally:
            batch.unpersist()

    return start_each(flatten_window(counts), show, name, checkpoint, trigger)


def start_each(
    frame: DataFrame,
    handle: Callable[[DataFrame, int], None],
    name: str,
    checkpoint: str,
    trigger: str | None = TRIGGER,
) -> StreamingQuery:
    """Hand each batch and its number to a function of the caller. After a failure a batch may come again."""
    asked = threading.Event()

    def between(batch: DataFrame, batch_id: int) -> None:
        if asked.is_set():
            raise StoppedBetweenBatches(f"before batch {batch_id}")
        handle(batch, batch_id)

    query = _writer(frame, name, checkpoint, trigger).foreachBatch(between).start()
    _ASKED[query.runId] = asked
    return query


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """AQE on for a while: Spark turns it off in a stateful query's session."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def _rebalanced(batch: DataFrame, path: str) -> None:
    """Write closed windows: few rows in as many pieces as there are state partitions.

    AQE merges the pieces, and splits a large one, into files of the advisory size.
    """
    with adaptive(batch.sparkSession):
        add_parts(batch).hint("rebalance").write.mode("overwrite").parquet(path)


def start_files(
    frame: DataFrame, folder: str, name: str, checkpoint: str, trigger: str | None = TRIGGER
) -> StreamingQuery:
    """Write each batch to ``folder`` as parquet, once also if the batch is run again."""
    commits = Commits(CommitLog.of(folder), checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if commits.open(spark, batch_id):
            batch.write.mode("overwrite").parquet(commits.place(folder, batch_id))
            commits.done(spark, batch_id, {folder: batch.schema})

    return start_each(frame, store, name, checkpoint, trigger)


def start_text(
    lines: DataFrame, folder: str, name: str, checkpoint: str, trigger: str | None = TRIGGER
) -> StreamingQuery:
    """Write lines as text files, a folder for each run and batch."""
    commits = Commits(CommitLog.of(folder), checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if commits.open(spark, batch_id):
            batch.write.mode("overwrite").text(commits.place(folder, batch_id))
            commits.done(spark, batch_id, {folder: batch.schema})

    return start_each(lines, store, name, checkpoint, trigger)


def start_counts(
    counts: DataFrame,
    folder: str,
    checkpoint: str,
    name: str = COUNTS_QUERY,
    trigger: str | None = TRIGGER,
) -> StreamingQuery:
    """Write closed windows, flattened, to ``folder``."""
    commits = Commits(CommitLog.of(folder), checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if commits.open(spark, batch_id):
            _rebalanced(batch, commits.place(folder, batch_id))
            commits.done(spark, batch_id, {folder: add_parts(batch).schema})

    return start_each(flatten_window(counts), store, name, checkpoint, trigger)


def start_counts_and_enriched(
    counts: DataFrame,
    codes: Callable[[SparkSession], DataFrame],
    counts_folder: str,
    enriched_folder: str,
    checkpoint: str,
    spec: CountSpec = CALLS,
    name: str = ENRICHED_QUERY,
    trigger: str | None = TRIGGER,
    how: str = "left",
) -> StreamingQuery:
    """One stateful query with two outputs: the closed windows, and the same with descriptions.

    The second output is made from the files of the first, so the state is gone through once and no
    cached block can be lost. ``codes`` is called for every batch: the code table is read, measured and
    checked anew each time. A batch without closed windows has no second output. Readers see a batch in both outputs
    or in neither: both are committed by one manifest. ``how`` is the join's, see ``with_descriptions``.
    """
    check_how(how, streaming=True)
    commits = Commits(CommitLog.of(counts_folder), checkpoint)
    commits.log.note(counts.sparkSession, enriched_folder)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not commits.open(spark, batch_id):
            return
        shape = add_parts(batch).schema
        path = commits.place(counts_folder, batch_id)
        _rebalanced(batch, path)
        closed = spark.read.schema(shape).parquet(path)
        known = codes(spark)
        # Without closed windows there is nothing that a code could multiply: the codes need no check.
        empty = closed.isEmpty()
        joined = with_descriptions(closed, known, spec, CodeTableSize(0, 0) if empty else None, how=how)
        if not empty:
            joined.write.mode("overwrite").parquet(commits.place(enriched_folder, batch_id))
        commits.done(spark, batch_id, {counts_folder: shape, enriched_folder: joined.schema})

    return start_each(flatten_window(counts), store, name, checkpoint, trigger)


def read_together(spark: SparkSession, *folders: str) -> list[DataFrame]:
    """Several outputs of one query as they stood after one and the same batch, whatever is being written.

    The frames hold the committed batches at the time of this call, and go on doing so; ``batch_id`` says which batch
    a row came with. Only the folders of those batches are read.
    """
    logs = {CommitLog.found(spark, folder) for folder in folders}
    if len(logs) != 1:
        raise ValueError(f"these are outputs of different queries: {', '.join(folders)}")
    runs, shapes = logs.pop().seen(spark)
    found = []
    for folder in folders:
        shape = shapes.get(folder.rstrip("/"))
        if shape is None:
            raise ValueError(f"no batch of {folder} is committed yet")
        placed = T.StructType([*shape, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())])
        found.append(spark.read.schema(placed).parquet(folder).where(up_to(runs)).drop("run"))
    return found


def read_output(spark: SparkSession, folder: str) -> DataFrame:
    """All committed batches of all runs in a folder; ``batch_id`` says which batch a row came with."""
    return read_together(spark, folder)[0]


def stop_between_batches(query: StreamingQuery) -> None:
    """Stop a query of ``start_each`` without cutting a batch off: the one at work is finished and committed.

    A query that waits for its next trigger is stopped at once. One whose batches follow each other ends where the
    next one begins, before anything of it is computed; the next start begins with that batch. A failure is raised.
    """
    _ASKED[query.runId].set()
    while query.isActive and query.status["isTriggerActive"]:
        time.sleep(0.01)
    query.stop()
    error = query.exception()
    if error and StoppedBetweenBatches.__name__ not in str(error):
        raise error


def wait_for_any(spark: SparkSession) -> None:
    """Wait until a query ends; a failure of any of them is raised."""
    spark.streams.awaitAnyTermination()
