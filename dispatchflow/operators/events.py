"""From records to the distinct events that are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchflow.config import CALLS, CountSpec
from dispatchflow.functions import event_instant


def drop_null_keys(records: DataFrame, spec: CountSpec = CALLS) -> DataFrame:
    """Records with both key fields. An empty text is a value and stays."""
    return records.na.drop(subset=list(spec.keys))


def call_events(records: DataFrame, spec: CountSpec = CALLS) -> DataFrame:
    """Type, code and event time of each record, the time cut to the resolution if there is one."""
    instant = event_instant(F.col(spec.time_col), records.schema[spec.time_col].dataType)
    if spec.resolution:
        instant = F.date_trunc(spec.resolution, instant)
    return records.select(*spec.keys, instant.alias(spec.event_time))


def distinct_events(events: DataFrame, spec: CountSpec = CALLS) -> DataFrame:
    """Each (type, code, event time) once.

    In batch the map side drops repeats before the shuffle, and the event time in the shuffle key spreads
    even one hot type and code. On a stream a plain ``distinct`` would keep every event for ever; here the
    watermark bounds it, at the price of dropping *rows* older than the watermark. The sliding count does
    not go through this operator on a stream, see ``window_counts``.
    """
    if not events.isStreaming:
        return events.distinct()
    return events.withWatermark(spec.event_time, spec.delay).dropDuplicates(events.columns)
