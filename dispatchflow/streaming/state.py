"""What a stream still holds: open windows, read from the state of its last finished batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchflow.config import CALLS, CountSpec


def open_windows(spark: SparkSession, checkpoint: str, spec: CountSpec = CALLS) -> DataFrame:
    """``type, window, code, count`` of the windows that a counting stream has not given out yet.

    With the windows it has written, these are all windows of what it has read. The state is read as a table, a
    task for each of its partitions, and the stream may be running: it is that of the last batch then finished.
    Where times are of no known resolution the state has a row for each time, or for each part of them; these
    are added up by a shuffle with partial sums, so a hot group is no task's alone.
    """
    operators = spark.read.format("state-metadata").load(checkpoint)
    # Of two chained aggregates the one nearer to the source holds the open windows, and has the higher number.
    holder = operators.agg(F.max("operatorId")).first()[0]
    state = spark.read.format("statestore").option("operatorId", holder).load(checkpoint)
    words = len(state.schema["value"].dataType.fields)
    held = F.lit(1).cast("bigint")
    if words:
        shape = ", ".join(f"word_{n}: bigint" for n in range(words))
        value = F.col("value").cast(f"struct<{shape}>")
        held = sum((F.coalesce(F.bit_count(value[f"word_{n}"]), F.lit(0)) for n in range(words)), F.lit(0))
    keys = [spec.type_col, "window", spec.code_col]
    rows = state.select(*(F.col(f"key.{key}").alias(key) for key in keys), held.cast("bigint").alias("held"))
    return rows.groupBy(*keys).agg(F.sum("held").alias("count"))
