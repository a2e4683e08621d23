"""Wide sliding windows from panes.

Windows whose slide divides them are made of panes as long as the slide. An event lies in one pane, however many
windows hold it, and different panes have no time in common: a window's distinct events are those of its panes, added
up. So events are shuffled once, by pane, and what is copied into windows is a pane's count.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchflow.config import CountSpec


def pane_spec(spec: CountSpec) -> CountSpec:
    """The same count over windows that are one slide long and do not overlap."""
    return replace(spec, window=spec.slide)


def windows_of_panes(panes: DataFrame, spec: CountSpec) -> DataFrame:
    """type, window, code, count from the counts of panes (a ``window`` each, one slide long)."""
    back = F.explode(F.sequence(F.lit(0), F.lit(spec.panes - 1))).alias("back")
    placed = panes.select(spec.type_col, spec.code_col, "window", "count", back)
    micros = round(spec.slide_seconds * 1_000_000)
    start = F.timestamp_micros(F.unix_micros("window.start") - F.col("back").cast("bigint") * micros)
    length = F.lit(micros * spec.panes).cast("bigint")
    window = F.struct(start.alias("start"), F.timestamp_micros(F.unix_micros(start) + length).alias("end"))
    return (
        placed.select(spec.type_col, window.alias("window"), spec.code_col, "count")
        .groupBy(spec.type_col, "window", spec.code_col)
        .agg(F.sum("count").alias("count"))
    )
