"""Records of JSON arrays of any size, each file read by many tasks.

A file is read as text whose lines end in a closing brace, so that Spark splits it at any byte. What a block of bytes
does to brackets and strings depends on where it begins: outside of texts, in one, or after a backslash in one. So a
first pass sums up every block for each of the three; the sums of a file's blocks, a row for each, are put together in
their order and say how each block begins. A second pass then cuts the elements of the array where it stands one
bracket deep. An element that goes over the end of a block is joined from its parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchflow.functions import record_json
from dispatchflow.session import ship_package, streaming_session

OUTSIDE, INSIDE, ESCAPED = range(3)
# Bytes that are looked at together.
_CHUNK = 1 << 20
# Blocks for each core at most, while they are smaller than _BLOCK, the usual size of Spark's partitions of files.
_BLOCKS_A_CORE = 16
_BLOCK = 128 << 20
_OPEN, _CLOSE, _COMMA, _QUOTE, _BACKSLASH = (ord(c) for c in "[]," + '"\\')
_DEEPER, _HIGHER = (_OPEN, ord("{")), (_CLOSE, ord("}"))
# For each byte: the change of depth, and whether it is a bracket or comma.
_STEPS = np.isin(np.arange(256), _DEEPER).astype(np.int64) - np.isin(np.arange(256), _HIGHER)
_MARKED = (_STEPS != 0) | (np.arange(256) == _COMMA)


def array_elements(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """file, position (from 0), text of each element of the JSON arrays in files, one array a file.

    A file that is no array, or goes on after it, fails the read; so do elements without text. Blocks are as large as
    Spark's partitions of files. With ``block_bytes`` they may be that small, and grow with the files so that there are
    no more than a few for each core. An element is one value of the result, 2 GB at most; the array and the file have
    no such bound. Compressed files are read by one task each.
    """
    ship_package(spark)
    if block_bytes:
        own = _block_size(spark, path, block_bytes)
        spark = streaming_session(spark)
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.set(f"spark.sql.files.{name}", str(own))
    pieces = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.concat(F.col("value").cast("binary"), F.lit(b"}")).alias("data"),  # with the brace that ended the line
    )
    sums = pieces.mapInArrow(_summed, "file string, block bigint, size bigint, bytes bigint, sums string")
    begins = sums.groupBy("file").applyInPandas(_begun, "file string, block bigint, state int, depth bigint, element bigint, last bigint")
    # A row for each block: some 20 MB for 100 TB in blocks of 512 MB.
    placed = pieces.join(F.broadcast(begins), ["file", "block"])
    whole = placed.mapInArrow(_whole, _PARTS).select("file", F.col("element").alias("position"), "text")
    torn = placed.mapInArrow(_torn, _PARTS).groupBy("file", "element").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"), F.any_value("last").alias("last")
    )  # two of each block at most
    text = F.concat_ws("", F.transform("parts", lambda part: part["text"])).alias("text")
    torn = torn.select("file", F.col("element").alias("position"), text, "last")
    blank = F.trim(F.translate("text", "\t\n\r", "   ")) == ""
    torn = torn.where(~(blank & (F.col("last") == 0)))  # an array without elements
    return whole.unionByName(torn.drop("last"))


def _block_size(spark: SparkSession, path: str, least: int) -> int:
    """Bytes of a block: ``least``, or what gives _BLOCKS_A_CORE for each core, up to _BLOCK."""
    lengths = spark.read.format("binaryFile").load(path).select("length")  # contents are not read
    total = lengths.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    even = -(-total // (_BLOCKS_A_CORE * spark.sparkContext.defaultParallelism))
    return max(least, min(even, _BLOCK))


def split_array_records(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """position, ``payload`` JSON text of each element: keys sorted, nulls and nested values kept, no schema needed."""
    elements = array_elements(spark, path, block_bytes)
    return elements.select("position", record_json(F.parse_json("text")).alias("payload"))


def split_typed_records(
    spark: SparkSession, path: str, schema: T.StructType, block_bytes: int | None = None
) -> DataFrame:
    """``payload`` JSON text of each element of arrays whose schema is known."""
    record = F.from_json("text", schema, {"mode": "FAILFAST"})
    return array_elements(spark, path, block_bytes).select(record_json(record).alias("payload"))


@dataclass
class Marks:
    """Brackets and commas outside of texts in some bytes: where, what, and how deep before each, from 0."""

    places: np.ndarray
    kinds: np.ndarray
    before: np.ndarray
    depth: int
    state: int


def marks(data: bytes, state: int) -> Marks:
    """The marks of bytes that begin in a state; depth and state are those at their end."""
    skipped = state == ESCAPED and bool(data)
    bytes_ = np.frombuffer(data, np.uint8)[int(skipped) :]
    if state == ESCAPED and not skipped:
        return Marks(*(np.zeros(0, np.int64) for _ in range(3)), 0, ESCAPED)
    slashes = np.flatnonzero(bytes_ == _BACKSLASH)
    # Where the run of backslashes that each is in begins.
    first = np.append(True, np.diff(slashes) > 1)[: len(slashes)]
    runs = np.maximum.accumulate(np.where(first, slashes, 0))
    quotes = np.flatnonzero(bytes_ == _QUOTE)
    if len(slashes):
        after = np.flatnonzero((quotes > 0) & (bytes_[quotes - 1] == _BACKSLASH))
        run = runs[np.searchsorted(slashes, quotes[after]) - 1]
        quotes = np.delete(quotes, after[(quotes[after] - run) % 2 == 1])
    found = np.flatnonzero(_MARKED[bytes_])
    inside = (np.searchsorted(quotes, found) + (state != OUTSIDE)) % 2 == 1
    found = found[~inside]
    kinds = bytes_[found]
    steps = _STEPS[kinds]
    ends = np.cumsum(steps)
    last = OUTSIDE
    if (len(quotes) + (state != OUTSIDE)) % 2:
        open_slashes = len(bytes_) - int(runs[-1]) if len(slashes) and slashes[-1] == len(bytes_) - 1 else 0
        last = ESCAPED if open_slashes % 2 else INSIDE
    return Marks(found + skipped, kinds, ends - steps, int(ends[-1]) if len(ends) else 0, last)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """The bytes of each block in chunks, with what its rows have in common. Rows of a block lie next to each other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        others = [batch.column(name) for name in batch.schema.names if name != "data"]
        files = batch.column("file").dictionary_encode().indices.to_numpy()
        blocks = batch.column("block").to_numpy()
        firsts = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
        data = batch.column("data").cast(pa.large_binary())
        bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        for low, high in zip([0, *firsts.tolist()], [*firsts.tolist(), batch.num_rows], strict=True):
            key = tuple(column[low].as_py() for column in others)
            while low < high:
                row = min(max(int(np.searchsorted(bounds, bounds[low] + _CHUNK)), low + 1), high)
                yield key, data.buffers()[2][int(bounds[low]) : int(bounds[row])].to_pybytes()
                low = row


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and each state it may begin in: state and depth at its end, commas and openings by depth."""
    done: list[tuple] = []
    now, total, sums = None, 0, []
    for key, data in _chunks(batches):
        if key != now:
            if now:
                done.append((*now, total, json.dumps(sums)))
            now, total = key, 0
            sums = [[state, 0, {}, {}] for state in (OUTSIDE, INSIDE, ESCAPED)]
        total += len(data)
        ways = [marks(data, state) for state in (OUTSIDE, INSIDE, ESCAPED)]
        for own in sums:
            way = ways[own[0]]
            levels = way.before + own[1]
            for counts, some in ((own[2], way.kinds == _COMMA), (own[3], _STEPS[way.kinds] > 0)):
                lowest = int(levels.min(initial=0))
                n_of = np.bincount(levels[some] - lowest)
                for level in np.flatnonzero(n_of).tolist():
                    counts[str(level + lowest)] = counts.get(str(level + lowest), 0) + int(n_of[level])
            own[0], own[1] = way.state, own[1] + way.depth
    if now:
        done.append((*now, total, json.dumps(sums)))
    names = ["file", "block", "size", "bytes", "sums"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*done, strict=True)) if done else [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _begun(blocks: pd.DataFrame) -> pd.DataFrame:
    """How each block of a file begins: state, depth, and which element it is in; and the file's last element."""
    blocks = blocks.sort_values("block")
    state, depth, element, opened = OUTSIDE, 0, 0, 0
    rows = []
    for block, text in zip(blocks["block"], blocks["sums"], strict=True):
        rows.append((blocks["file"].iloc[0], block, state, depth, element))
        state, change, commas, openings = json.loads(text)[state]
        element += commas.get(str(1 - depth), 0)
        opened += openings.get(str(-depth), 0)
        depth += change
    # The brace put back after the last piece is one too many.
    whole = blocks["bytes"].sum() == blocks["size"].iloc[0] + 1
    if not whole or (state, depth, opened) != (OUTSIDE, -1, 1):
        raise ValueError(f"{blocks['file'].iloc[0]} is not one JSON array")
    return pd.DataFrame([(*row, element) for row in rows], columns=["file", "block", "state", "depth", "element", "last"])


_PARTS = "file string, block bigint, element bigint, text string, last bigint"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cut(batches, True)


def _torn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cut(batches, False)


def _cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The elements that begin and end in a block, or the parts of the others, two of each block at most."""
    rows: list[tuple] = []
    now, held = None, b""
    state = depth = element = 0
    begun = False

    def part(ends: bool) -> None:
        if begun and ends and not held.strip():
            if element == 0 and element == now[-1]:
                return  # an array without elements
            raise ValueError(f"{now[0]}: element {element} has no text")
        if held and whole == (begun and ends):
            rows.append((now[0], now[1], element, held.decode(), now[-1]))

    def outside() -> None:
        if held.strip() not in (b"", b"}"):
            raise ValueError(f"{now[0]} is not one JSON array")

    for key, data in _chunks(_without_size(batches)):
        if key != now:
            if now:
                part(False) if depth > 0 else outside()
            now, held, begun = key, b"", False
            _, _, state, depth, element, _ = key
        found = marks(data, state)
        levels = found.before + depth
        border = (levels == 1) & ((found.kinds == _COMMA) | np.isin(found.kinds, _HIGHER))
        border |= (levels == 0) & np.isin(found.kinds, _DEEPER)
        last = 0
        for place, kind in zip(found.places[border].tolist(), found.kinds[border].tolist(), strict=True):
            held += data[last:place]
            if kind in _DEEPER:
                outside()
                if kind != _OPEN:
                    raise ValueError(f"{now[0]} is not one JSON array")
                begun = True
            else:
                part(True)
                if kind == _COMMA:
                    element, begun = element + 1, True
                elif kind != _CLOSE:
                    raise ValueError(f"{now[0]} is not one JSON array")
            held, last = b"", place + 1
        held += data[last:]
        state, depth = found.state, depth + found.depth
        if len(rows) >= 4096:
            yield _batch(rows)
            rows = []
    if now:
        part(False) if depth > 0 else outside()
    yield _batch(rows)


def _without_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select([name for name in batch.schema.names if name != "size"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["file", "block", "element", "text", "last"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
