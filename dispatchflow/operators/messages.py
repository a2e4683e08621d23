"""From envelopes to records, and to lines a person can read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchflow.functions import decode_value, tap_line
from dispatchflow.schemas import CALL_RECORD, subset


def parse_payload(envelope: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The payload's fields as columns: all of the call record, or only those named.

    ``inline`` keeps the parsed struct behind a generator. Selecting ``struct.*`` instead would let the
    optimizer copy ``from_json`` into every later filter and projection, three parses a message here.
    """
    schema = subset(CALL_RECORD, columns) if columns else CALL_RECORD
    return envelope.select(F.inline(F.array(decode_value(F.col("value"), schema))))


def tap_lines(envelope: DataFrame) -> DataFrame:
    """One ``line`` per message: topic, partition, offset, key and value."""
    return envelope.select(tap_line("topic", "partition", "offset", "key", "value").alias("line"))
