"""Sliding counts, plain and with descriptions. One definition for history and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dispatchflow.config import CALLS, CountSpec
from dispatchflow.operators import (
    call_events,
    drop_null_keys,
    parse_payload,
    window_counts,
    with_descriptions,
)


def counts_plan(envelope: DataFrame, spec: CountSpec = CALLS, parts: bool = False) -> DataFrame:
    """Messages to sliding counts of distinct events; ``parts`` as in ``window_counts``, for the sinks of ``streaming``."""
    records = drop_null_keys(parse_payload(envelope, spec.payload_columns), spec)
    return window_counts(call_events(records, spec), spec, parts)


def enriched_plan(envelope: DataFrame, codes: DataFrame, spec: CountSpec = CALLS) -> DataFrame:
    """The same counts with the description of each code."""
    return with_descriptions(counts_plan(envelope, spec), codes, spec)
