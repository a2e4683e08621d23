"""JSON payloads in and out of a message's binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nulls stay as nulls, and timestamps keep their microseconds (the default cuts to milliseconds).
_WRITE_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def record_json(record: Column) -> Column:
    """A struct or variant as JSON text, nulls included."""
    return F.to_json(record, _WRITE_OPTIONS)


def encode_value(text: Column) -> Column:
    """JSON text as a message value: UTF-8 bytes."""
    return F.encode(text, "UTF-8")


def decode_value(value: Column, schema: T.StructType) -> Column:
    """A message value as a struct; null where the bytes are no JSON object."""
    return F.from_json(value.cast("string"), schema)


def tap_line(topic: str, partition: str, offset: str, key: str, value: str) -> Column:
    """One readable line for a message, from the names of its columns."""
    return F.format_string(
        "%s:%d:%d: key=%s value=%s",
        F.col(topic),
        F.col(partition),
        F.col(offset),
        F.col(key).cast("string"),
        F.col(value).cast("string"),
    )
