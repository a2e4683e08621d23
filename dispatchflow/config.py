"""What is counted, and over which windows."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

#: Times a window may hold, at a known resolution, to be counted as the bits of whole numbers.
MAX_SLOTS = 1024

_UNIT_SECONDS = {"second": 1, "minute": 60}
_INTERVAL_SECONDS = _UNIT_SECONDS | {"hour": 3600, "day": 86400, "week": 604800, "millisecond": 1e-3}
_INTERVAL = re.compile(r"(\d+(?:\.\d+)?)\s+([a-z]+?)s?(?:\s+|$)")


def interval_seconds(text: str) -> float:
    """Seconds of an interval as Spark writes it: ``10 minutes``, ``interval 1 hour 30 minutes``, ``1 week``."""
    plain = re.sub(r"^interval\s+", "", text.strip().lower())
    parts = _INTERVAL.findall(plain)
    if not parts or _INTERVAL.sub("", plain) or any(unit not in _INTERVAL_SECONDS for _, unit in parts):
        raise ValueError(f"no interval of fixed length: {text}")
    return sum(float(n) * _INTERVAL_SECONDS[unit] for n, unit in parts)


@dataclass(frozen=True)
class CountSpec:
    """Columns and durations of the sliding count.

    Durations are texts such as ``10 minutes``. The defaults are those of the calls-for-service job: windows
    of ten minutes every five minutes, and a watermark ten minutes behind the newest event.

    ``resolution`` may say that times are kept by the ``second`` or ``minute``: finer times are cut to it,
    and what then is equal counts once. It allows a much cheaper count, see ``window_counts``. Without it
    times are compared to the microsecond.
    """

    type_col: str = "original_crime_type_name"
    code_col: str = "disposition"
    time_col: str = "call_date_time"
    window: str = "10 minutes"
    slide: str = "5 minutes"
    delay: str = "10 minutes"
    resolution: str | None = None

    def __post_init__(self):
        if self.resolution is not None and self.resolution not in _UNIT_SECONDS:
            raise ValueError(f"resolution is one of {sorted(_UNIT_SECONDS)}")

    @property
    def event_time(self) -> str:
        """Name of the event-time column once it is a timestamp."""
        return f"{self.time_col}_ts"

    @property
    def keys(self) -> tuple[str, str]:
        """Columns that must not be null."""
        return self.type_col, self.code_col

    @property
    def payload_columns(self) -> tuple[str, str, str]:
        """The only payload fields the count needs."""
        return self.type_col, self.code_col, self.time_col

    @property
    def unit_seconds(self) -> int | None:
        """Seconds between two neighbouring times, where a resolution is given."""
        return _UNIT_SECONDS[self.resolution] if self.resolution else None

    @property
    def slide_seconds(self) -> float:
        return interval_seconds(self.slide)

    @property
    def panes(self) -> int | None:
        """How many slides make up a window, where they do so without a rest."""
        micros, slide = (round(interval_seconds(text) * 1_000_000) for text in (self.window, self.slide))
        return micros // slide if micros % slide == 0 else None

    @property
    def slots(self) -> int | None:
        """How many different times a window can hold, where a resolution is given."""
        if not self.resolution:
            return None
        return math.ceil(interval_seconds(self.window) / self.unit_seconds)


CALLS = CountSpec()
