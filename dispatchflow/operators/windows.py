"""The sliding count of distinct events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from dispatchflow.config import CALLS, MAX_SLOTS, CountSpec
from dispatchflow.operators.events import distinct_events
from dispatchflow.operators.panes import pane_spec, windows_of_panes

#: Windows of this many slides are counted by panes in batch; at two no gain was measured.
PANES_FROM = 4
_WORD_BITS = 64  # a word's number is the slot's, shifted right by six


def window_counts(events: DataFrame, spec: CountSpec = CALLS, parts: bool = False) -> DataFrame:
    """Distinct events per type, sliding window and code: ``type, window, code, count``.

    Events without a time fall in no window. On a stream a window comes out once, when the watermark has
    passed its end. With ``parts`` a stream of exact times gives a window's count in several rows, with a column
    ``part``: they come out in one batch, and ``add_parts`` makes one of them there. So one state operator does.

    In batch, windows of PANES_FROM or more slides are counted by panes, see ``panes``.
    """
    if not events.isStreaming and (spec.panes or 0) >= PANES_FROM:
        return windows_of_panes(window_counts(events, pane_spec(spec)), spec).select(*_columns(spec))
    if spec.slots and spec.slots <= MAX_SLOTS:
        counted = _slot_counts(events, spec)
    elif events.isStreaming and parts:
        return _word_counts(events, spec).select(*_columns(spec), "part")
    elif events.isStreaming:
        counted = _instant_counts(events, spec)
    else:
        counted = _windowed(distinct_events(events, spec), spec).count()
    return counted.select(*_columns(spec))


def _columns(spec: CountSpec) -> list[str]:
    return [spec.type_col, "window", spec.code_col, "count"]


def add_parts(counts: DataFrame) -> DataFrame:
    """One row for each window of a batch: its parts added up, if it has any."""
    if "part" not in counts.columns:
        return counts
    keys = [name for name in counts.columns if name not in ("part", "count")]
    whole = counts.groupBy(*keys).agg(F.sum("count").alias("count"))
    return whole.select(*(name for name in counts.columns if name != "part"))


def _windowed(events: DataFrame, spec: CountSpec, *more: Column) -> GroupedData:
    window = F.window(spec.event_time, spec.window, spec.slide)
    return events.groupBy(spec.type_col, window, spec.code_col, *more)


def _watermarked(events: DataFrame, spec: CountSpec) -> DataFrame:
    return events.withWatermark(spec.event_time, spec.delay) if events.isStreaming else events


def _slot_counts(events: DataFrame, spec: CountSpec) -> DataFrame:
    """One aggregate for times of a known resolution: a bit per time of the window.

    A window holds at most ``slots`` neighbouring times, which all differ modulo ``slots``, so a time's
    remainder is its bit. Words of 64 bits are merged by ``bit_or``: repeats set a bit again, every group is
    one row of fixed size on the map side, in the shuffle and in the state, and one shuffle does.
    """
    slot = F.pmod(F.floor(F.unix_seconds(spec.event_time) / spec.unit_seconds), F.lit(spec.slots))
    words = [f"word_{n}" for n in range(math.ceil(spec.slots / _WORD_BITS))]
    marked = _watermarked(events, spec).withColumn("slot", slot.cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot") % _WORD_BITS)
    filled = [F.bit_or(F.when(F.shiftright("slot", 6) == n, bit)).alias(word) for n, word in enumerate(words)]
    bits = sum((F.coalesce(F.bit_count(word), F.lit(0)) for word in words), F.lit(0))
    return _windowed(marked, spec).agg(*filled).withColumn("count", bits.cast("bigint"))


def _instant_counts(events: DataFrame, spec: CountSpec) -> DataFrame:
    """Two chained windowed aggregates for a stream: first a group's distinct times, then their number.

    The first keeps one small state row per event time of an open window, so a hot group is spread over
    all state partitions, and its map side collapses repeats before the shuffle. It drops late rows by
    window and forgets a window when it closes. The second gets closed windows only and keeps nothing
    from one batch to the next. ``unix_micros`` is an exact stand-in for the time: as a second column
    that carries the watermark, the time itself would not be allowed among the keys.
    """
    instant = F.unix_micros(spec.event_time).alias("instant")
    instants = _windowed(_watermarked(events, spec), spec, instant).agg(F.count(F.lit(1)).alias("repeats"))
    return instants.groupBy(spec.type_col, "window", spec.code_col).count()


def _word_counts(events: DataFrame, spec: CountSpec) -> DataFrame:
    """One aggregate for a stream of exact times: a group's times by their neighbourhood, a bit for each of 64 microseconds.

    A time is its word (the ``part``) and its bit in it, so the set of times in a part is one whole number: a state row
    of fixed size, however many calls it holds. A hot group has as many parts as its times are apart, spread over
    all state partitions; repeats set a bit again on the map side.
    """
    instant = F.unix_micros(spec.event_time)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(instant, F.lit(_WORD_BITS)).cast("int"))
    marked = _watermarked(events, spec).withColumn("bit", bit)
    words = _windowed(marked, spec, F.shiftright(instant, 6).alias("part")).agg(F.bit_or("bit").alias("word"))
    return words.withColumn("count", F.bit_count("word").cast("bigint"))


def flatten_window(counts: DataFrame) -> DataFrame:
    """``window_start`` and ``window_end`` instead of the window struct."""
    columns = []
    for name in counts.columns:
        if name == "window":
            columns += [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
        else:
            columns.append(F.col(name))
    return counts.select(*columns)
