"""What the operators share: intermediate tables, ranks over all rows, text as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, work_dir

RANK_BUCKETS = 1024
# A key of this share of the rows is hot; 1 / HOT_SHARE keys at most are.
HOT_SHARE = 0.001
# Rows of a few columns of fixed size that are broadcast at most; their number is measured first.
BROADCAST_ROWS = 200_000
# What is left of a text's bytes for its terms: digits, a-z, A-Z as a-z and all beyond ASCII, else a space.
_TERM_BYTES = bytes(c + 32 if chr(c).isupper() and c < 128 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, its lineage cut."""
    spark = frame.sparkSession
    path = work_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def in_arrow(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with functions of this package."""
    ship_package(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def in_pandas(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with functions of this package."""
    ship_package(frame.sparkSession)
    return frame.mapInPandas(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of a batch takes little memory."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def plain_text(text: str | None) -> bytes:
    """UTF-8 of a text, nothing for null."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII digits and letters and of anything beyond ASCII, with A-Z in lower case."""
    return plain_text(text).translate(_TERM_BYTES).split()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def with_rank(frame: DataFrame, within: list[str], spread: Column, order: list[Column], rank: str) -> DataFrame:
    """Rows numbered from 0 without gaps within each value of ``within``, without one task per value.

    Rows are dealt to buckets by ``spread``; a bucket's numbers begin where those of the buckets before it end.
    The bucket sizes are the only rows that meet in one place: at most RANK_BUCKETS for each value of ``within``.
    """
    bucketed = frame.withColumn("__bucket", F.pmod(F.xxhash64(spread), F.lit(RANK_BUCKETS)).cast("int"))
    sizes = bucketed.groupBy(*within, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*within, "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    keys = [*within, "__bucket"]
    offsets = offsets.select(*(F.col(k).alias(f"__of_{k}") for k in keys), "__offset")
    place = Window.partitionBy(*keys).orderBy(*order)
    numbered = bucketed.withColumn("__place", F.row_number().over(place) - 1)
    match = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))
    joined = numbered.join(offsets, match)
    return joined.withColumn(rank, F.col("__offset") + F.col("__place")).drop(
        "__bucket", "__place", "__offset", *(f"__of_{k}" for k in keys)
    )


def free_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have, in any case of letters."""
    taken = {name.lower() for name in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without(rows: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows whose keys are not in ``gone``, a stored table; ``keys`` are expressions over rows by its column names.

    Nulls are equal to each other. A table of BROADCAST_ROWS or fewer goes to all tasks, so that whole texts are not
    shuffled for the sake of the few that go; a larger one is joined by shuffle.
    """
    names = {key: free_name(rows, f"__{key}") for key in keys}
    some = gone.select(*(F.col(key).alias(name) for key, name in names.items()))
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    same = reduce(Column.__and__, (keys[key].eqNullSafe(F.col(name)) for key, name in names.items()))
    return rows.join(some, same, "left_anti")


def with_hot_keys(
    rows: DataFrame, table: DataFrame, keys: list[str], holds: str, total: int, how: str = "left"
) -> DataFrame:
    """``rows`` joined with ``table``, whose keys are unique and whose column ``holds`` says how many rows have each.

    Keys that hold a share of HOT_SHARE of the ``total`` go by broadcast, 1 / HOT_SHARE of them at most, so that the
    others, which are shuffled, leave no task with much more than the rest.
    """
    hot = table.where(F.col(holds) >= F.lit(total * HOT_SHARE))
    rest = table.where(F.col(holds) < F.lit(total * HOT_SHARE))
    there = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return there.unionByName(others)


def in_order(frame: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Rows numbered from 1 in a total order: sorted by ranges, not in one task.

    A range's numbers begin where those of the ranges before it end; the sizes of the ranges, as many as there are
    partitions, are all that meets in one place.
    """
    dealt = stored(frame.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    numbered = dealt.withColumn("__place", place).join(F.broadcast(offsets), "__range")
    return numbered.withColumn(rank, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")
