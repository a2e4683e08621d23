"""DataFrame to DataFrame operators. Each takes a batch or a streaming frame."""

from dispatchflow.operators.enrich import check_codes, with_descriptions
from dispatchflow.operators.events import call_events, distinct_events, drop_null_keys
from dispatchflow.operators.messages import parse_payload, tap_lines
from dispatchflow.operators.windows import add_parts, flatten_window, window_counts

__all__ = [
    "add_parts",
    "call_events",
    "check_codes",
    "distinct_events",
    "drop_null_keys",
    "flatten_window",
    "parse_payload",
    "tap_lines",
    "window_counts",
    "with_descriptions",
]
