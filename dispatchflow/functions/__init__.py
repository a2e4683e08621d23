"""Column expressions: payload encoding and decoding, event time, message lines."""

from dispatchflow.functions.payload import decode_value, encode_value, record_json, tap_line
from dispatchflow.functions.time import event_instant, plain_time

__all__ = [
    "decode_value",
    "encode_value",
    "event_instant",
    "plain_time",
    "record_json",
    "tap_line",
]
