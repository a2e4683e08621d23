"""A stream's output by day, and small batches of past days put together.

Folders are day, run and batch. A batch replaces its own folders and no others, so one that is tried again leaves what
it would have left alone; what is not committed is not read (see ``commits``). A reader of some days opens the folders
of those days only.

A stream writes a day in as many folders as it had batches. ``compact`` writes the days before a given one once more,
as one folder each, and then says so in a log of its own: from there on readers take the new folder instead of the
batches that it holds. Rows of such a day that come later stay in their batches and are read beside it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dispatchflow.operators import add_parts, flatten_window
from dispatchflow.schemas import schema
from dispatchflow.streaming.commits import CommitLog, Commits, _read
from dispatchflow.streaming.run import TRIGGER, adaptive, start_each

DAY, COMPACTED = "day", "compacted"
_LOG = "_compacted"
#: Days from ``first`` to before ``end`` are in ``generation``, with the batches of ``run`` up to ``last``.
GENERATION = schema("generation long, first date, end date, run string, last long")


def _written(rows: DataFrame, folder: str) -> None:
    """Rows with day, run and batch_id to their folders, replacing what these hold. AQE makes files of a day."""
    with adaptive(rows.sparkSession):
        dealt = rows.hint("rebalance", DAY)
        write = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        write.partitionBy(DAY, "run", "batch_id").parquet(folder)


def write_day_batch(batch: DataFrame, day: Column, commits: Commits, folder: str, batch_id: int) -> None:
    """Write a batch by days and commit it, if that is not done yet. Rows without a day are in the day null."""
    spark = batch.sparkSession
    if not commits.open(spark, batch_id):
        return
    placed = {DAY: day.cast("date"), "run": F.lit(commits.run), "batch_id": F.lit(batch_id).cast("long")}
    _written(add_parts(batch).withColumns(placed), folder)
    commits.done(spark, batch_id, {folder: add_parts(batch).schema})


def start_daily_counts(
    counts: DataFrame, folder: str, checkpoint: str, name: str, trigger: str | None = TRIGGER
) -> StreamingQuery:
    """Write closed windows, flattened, by the day on which they begin."""
    commits = Commits(CommitLog.of(folder), checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        write_day_batch(batch, F.col("window_start"), commits, folder, batch_id)

    return start_each(flatten_window(counts), store, name, checkpoint, trigger)


def generations(spark: SparkSession, folder: str) -> list:
    """What has been put together, a row for each time and run."""
    there = _read(spark, f"{folder.rstrip('/')}/{_LOG}", GENERATION)
    return there.orderBy("generation").collect() if there is not None else []


def _in_days(first: date | None, end: date | None) -> Column:
    within = F.lit(True)
    if first is not None:
        within = within & (F.col(DAY) >= F.lit(first))
    if end is not None:
        within = within & (F.col(DAY) < F.lit(end))
    return within


def read_days(
    spark: SparkSession, folder: str, first: date | None = None, end: date | None = None
) -> DataFrame:
    """Committed rows with their ``day``, of the days from ``first`` to before ``end``; each row once.

    The conditions are on folders only. There is one for each run and one for each ``compact`` of the days asked for.
    """
    runs, shapes = CommitLog.of(folder).seen(spark)
    shape = shapes.get(folder.rstrip("/"))
    if shape is None:
        raise ValueError(f"no batch of {folder} is committed yet")
    done = generations(spark, folder)
    if first is not None:
        done = [g for g in done if g.end > first]
    if end is not None:
        done = [g for g in done if g.first is None or g.first < end]
    kinds = [(DAY, T.DateType()), ("run", T.StringType()), ("batch_id", T.LongType())]
    placed = T.StructType([*shape, *(T.StructField(name, kind) for name, kind in kinds)])
    rows = spark.read.schema(placed).parquet(folder).where(_in_days(first, end))
    batch = F.col("batch_id")
    seen = F.lit(False)
    for run, last in sorted(runs.items()):
        own = (F.col("run") == run) & (batch <= last)
        for g in done:
            if g.run == run:
                # A day null is in no range of days, and stays in its batches.
                own = own & ~F.coalesce(_in_days(g.first, g.end) & (batch <= g.last), F.lit(False))
        seen = seen | own
    for generation in sorted({g.generation for g in done}):
        seen = seen | ((F.col("run") == COMPACTED) & (batch == generation))
    return rows.where(seen).drop("run", "batch_id")


def compact(spark: SparkSession, folder: str, end: date) -> int | None:
    """Put the batches of the days before ``end`` together that are not yet; the number of this time, None if none are.

    Each time takes the days since the time before. A compaction that fails has changed nothing for readers, and the
    next one replaces what it left. Readers that began before go on with the old folders, which are not removed.
    """
    runs, _ = CommitLog.of(folder).seen(spark)
    done = generations(spark, folder)
    first = max((g.end for g in done), default=None)
    if not runs or (first is not None and first >= end):
        return None
    generation = max((g.generation for g in done), default=-1) + 1
    days = read_days(spark, folder, first, end)
    placed = {"run": F.lit(COMPACTED), "batch_id": F.lit(generation).cast("long")}
    _written(days.withColumns(placed), folder)
    rows = [(generation, first, end, run, last) for run, last in sorted(runs.items())]
    spark.createDataFrame(rows, GENERATION).coalesce(1).write.mode("append").json(f"{folder.rstrip('/')}/{_LOG}")
    return generation
