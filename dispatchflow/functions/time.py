"""Event time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_instant(column: Column, dtype: T.DataType) -> Column:
    """A timestamp column whatever the payload declared: text is parsed, zone-less times are cast.

    A watermark needs the type ``timestamp``. Text that is no time becomes null, as ``from_json`` has it.
    """
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(column)
    return column.cast("timestamp")


def plain_time(column: Column) -> Column:
    """An instant as the session's wall-clock time, without a zone."""
    return column.cast("timestamp_ntz")
