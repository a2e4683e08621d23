"""Declared schemas: the JSON payload, the code table and the message envelope."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T


def schema(fields: str) -> T.StructType:
    """A flat schema from ``name type`` pairs. (``StructType.fromDDL`` would need a running session.)"""
    made = T.StructType()
    for field in fields.split(","):
        name, kind = field.split()
        made.add(name, kind)
    return made


# Field names and types of the input files.

#: One call for service, as it stands in a message's JSON payload.
CALL_RECORD = schema(
    """
    crime_id string,
    original_crime_type_name string,
    report_date timestamp,
    call_date timestamp,
    offense_date timestamp,
    call_time string,
    call_date_time timestamp,
    disposition string,
    address string,
    city string,
    state string,
    agency_id string,
    address_type string,
    common_location string
    """
)

#: One radio code, as it stands in the code file.
RADIO_CODE = schema("disposition_code string, description string")

#: One message. The columns and types are those of Spark's Kafka source.
ENVELOPE = schema(
    "key binary, value binary, topic string, partition integer, offset long, "
    "timestamp timestamp, timestampType integer"
)


def subset(fields: T.StructType, columns: Iterable[str]) -> T.StructType:
    """The named fields of a schema, so that a parser fills in nothing else."""
    return T.StructType([fields[c] for c in columns])
