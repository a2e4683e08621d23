"""Progress of streaming queries as rows."""

from __future__ import annotations

import math
import threading
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import StreamingQueryProgress

from dispatchflow.schemas import schema

PROGRESS_ROW = schema(
    "query string, batch_id long, num_input_rows long, input_rps double, processed_rps double, "
    "batch_ms long, watermark timestamp, state_rows long, rows_dropped long, start_offset string, end_offset string"
)


def _instant(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text).astimezone(UTC) if text else None


def _rate(value: float | None) -> float | None:
    return value if value is not None and math.isfinite(value) else None


def progress_row(progress: StreamingQueryProgress) -> tuple:
    """One progress report as a ``PROGRESS_ROW``. A rate that is not known yet is null."""
    return (
        progress.name,
        progress.batchId,
        progress.numInputRows,
        _rate(progress.inputRowsPerSecond),
        _rate(progress.processedRowsPerSecond),
        progress.durationMs.get("triggerExecution"),
        _instant(progress.eventTime.get("watermark")),
        sum(operator.numRowsTotal for operator in progress.stateOperators),
        sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators),
        _offsets(source.startOffset for source in progress.sources),
        _offsets(source.endOffset for source in progress.sources),
    )


def _offsets(offsets: Iterable[str | None]) -> str:
    """The offsets of a query's sources as a JSON array: Spark gives JSON text, or null at the start."""
    return f"[{', '.join(offset or 'null' for offset in offsets)}]"


def latest_progress(spark: SparkSession, *queries: StreamingQuery) -> DataFrame:
    """The reports Spark still holds of some queries: about the last hundred. ``ProgressLog`` keeps all."""
    rows = [progress_row(report) for query in queries for report in query.recentProgress]
    return spark.createDataFrame(rows, PROGRESS_ROW)


class ProgressLog(StreamingQueryListener):
    """Keeps the progress of every query of a session as a parquet table.

    Register it with ``spark.streams.addListener`` before the queries start, and ``close`` it after they
    end. Reports are written ``every`` so many, and when a query ends.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 20):
        self._spark = spark
        self._folder = folder
        self._every = every
        self._rows: list[tuple] = []
        self._running = 0
        self._change = threading.Condition()

    def _flush(self) -> None:
        """Write what is held; a failed write keeps it for the next."""
        if self._rows:
            frame = self._spark.createDataFrame(self._rows, PROGRESS_ROW).coalesce(1)
            frame.write.mode("append").parquet(self._folder)
            self._rows = []

    def close(self, timeout: float = 60) -> None:
        """Wait for the last reports, which Spark delivers on a thread of its own, and write them.

        If they do not come in time, what came is written and the call fails.
        """
        with self._change:
            ended = self._change.wait_for(lambda: self._running == 0, timeout)
            self._flush()
            if not ended:
                raise TimeoutError(f"{self._running} queries had not reported their end after {timeout} s")

    def onQueryStarted(self, event) -> None:
        with self._change:
            self._running += 1

    def onQueryProgress(self, event) -> None:
        with self._change:
            self._rows.append(progress_row(event.progress))
            if len(self._rows) >= self._every:
                self._flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._flush()
            self._running -= 1
            self._change.notify_all()
