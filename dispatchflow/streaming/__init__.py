"""Running the plans as streams, and their progress."""

from dispatchflow.streaming.daily import compact, read_days, start_daily_counts
from dispatchflow.streaming.progress import PROGRESS_ROW, ProgressLog, latest_progress, progress_row
from dispatchflow.streaming.run import (
    read_output,
    read_together,
    start_console,
    start_counts,
    start_counts_and_enriched,
    start_each,
    start_files,
    start_printed_counts,
    stop_between_batches,
    wait_for_any,
)
from dispatchflow.streaming.state import open_windows

__all__ = [
    "PROGRESS_ROW",
    "ProgressLog",
    "compact",
    "latest_progress",
    "open_windows",
    "progress_row",
    "read_days",
    "read_output",
    "read_together",
    "start_console",
    "start_counts",
    "start_counts_and_enriched",
    "start_daily_counts",
    "start_each",
    "start_files",
    "start_printed_counts",
    "stop_between_batches",
    "wait_for_any",
]
