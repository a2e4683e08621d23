"""Where data comes from and goes to: topics, record files, code tables, the given tables."""

from dispatchflow.sources.arrays import array_elements, split_array_records, split_typed_records
from dispatchflow.sources.codes import builtin_codes, radio_codes
from dispatchflow.sources.records import json_array_records, json_line_records, typed_array_records
from dispatchflow.sources.topics import Topic, as_messages, spread, topic_batch, topic_stream, write_topic

__all__ = [
    "Topic",
    "array_elements",
    "as_messages",
    "builtin_codes",
    "json_array_records",
    "json_line_records",
    "radio_codes",
    "split_array_records",
    "split_typed_records",
    "spread",
    "topic_batch",
    "topic_stream",
    "typed_array_records",
    "write_topic",
]
