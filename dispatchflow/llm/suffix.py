"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller id, or
earlier in the same one. All strings of that length are told apart exactly, none by sample:

1. Anchors. Of the ``gram``-byte grams in a string, the one with the smallest hash is its anchor, so equal strings
   have equal anchors at equal places. Neighbouring strings mostly share theirs: a span is such a run of strings.
   Spans are shuffled by their anchor's hash. Of equal spans all but the first are repeats as a whole, and a span
   whose anchor nobody else has is none.
2. What is left are first spans whose anchor stands in different surroundings, the edges of repeats. Per anchor,
   their suffixes are sorted by merge sort: prefix polynomial hashes and binary search find how far two suffixes
   agree, so that a comparison takes logarithmic time, and neighbours' agreements are verified byte by byte.
   Strings are then equal if their suffixes lie in one run of sufficient agreement and what precedes the anchor is
   equal. Anchors with more spans than a task should sort are resolved string by string, with a shuffle instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, in_arrow, plain_text, stored

LENGTH = 100
GRAM = 24
# An anchor with more different spans is resolved by shuffling its strings.
SORTED_SPANS = 8192
_BLOCK = 1 << 19
_ROWS = 8192
_PLACE_BITS = np.uint64(24)


@dataclass(frozen=True)
class _Hash:
    """A polynomial hash modulo 2^64 over random byte values: prefix sums give the hash of any substring."""

    values: np.ndarray
    powers: np.ndarray
    inverses: np.ndarray

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.inverses[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((prefix[end] - prefix[start]) * self.powers[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=4)
def _hash(seed: int, size: int) -> _Hash:
    draw = np.random.default_rng(seed)
    base = int(draw.integers(1 << 62)) * 8 + 5 & (1 << 64) - 1
    back = pow(base, -1, 1 << 64)

    def powers(x: int) -> np.ndarray:
        out = np.full(size, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return _Hash(draw.integers(1 << 64, size=256, dtype=np.uint64), powers(base), powers(back))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window, by running minima from both ends of blocks of the window's width."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(x) - width + 1
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def _spans(parts: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """part, anchor hash, span hash, place of every span in the parts (row, offset, bytes of at least ``length``).

    ``place`` holds the first string's start, the number of strings less one, and the anchor's distance.
    """
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    sizes = np.array([len(p) for _, _, p in parts])
    begins = np.cumsum(sizes) - sizes
    room = max(2 * _BLOCK, 1 << int(len(data)).bit_length())
    first, second = _hash(1, room), _hash(2, room)
    at = np.arange(len(data) - gram + 1)
    grams = first.of(first.prefix(data), at, at + gram)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    ordered = (grams & ~low) | at.astype(np.uint64)
    anchors = (_sliding_min(ordered, length - gram + 1) & low).astype(np.int64)
    inside = np.zeros(len(anchors) + 2, bool)
    for begin, size in zip(begins, sizes, strict=True):
        inside[begin + 1 : begin + size - length + 2] = True
    changes = np.diff(anchors) != 0
    opens = inside[1:-1] & ~inside[:-2]
    opens[1:] |= inside[2:-1] & changes
    closes = inside[1:-1] & ~inside[2:]
    closes[:-1] |= inside[1:-2] & changes
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    anchor = anchors[starts]
    spans = second.of(second.prefix(data), starts, ends + length)
    shape = ((ends - starts).astype(np.uint64) << np.uint64(8)) | (anchor - starts).astype(np.uint64)
    part = np.searchsorted(begins, starts, side="right") - 1
    offset = starts - begins[part] + np.array([o for _, o, _ in parts])[part]
    place = (offset.astype(np.uint64) << np.uint64(16)) | shape
    return part, grams[anchor].view(np.int64), _mixed(spans + shape).view(np.int64), place.view(np.int64)


def _parts(texts: list[str | None], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """The texts in lots of about _BLOCK bytes; a longer text in blocks that overlap by a string less a byte."""
    lot, size = [], 0
    for row, text in enumerate(texts):
        data = plain_text(text)
        for offset in range(0, max(len(data) - length + 1, 0), _BLOCK):
            part = data[offset : offset + _BLOCK + length - 1]
            if size + len(part) > 2 * _BLOCK:
                yield lot
                lot, size = [], 0
            lot.append((row, offset, part))
            size += len(part)
    if lot:
        yield lot


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, span, id, place of all spans; ``span`` is null where an equal one comes earlier in the same lot.

    Those are known to be repeats before anything is shuffled, so that a passage that very many documents share
    sends one span for each lot of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.unique(np.array(batch.column("id").to_pylist()), return_inverse=True)[1] if len(batch) else None
            for lot in _parts(batch.column("text").to_pylist(), length):
                part, anchor, span, place = _spans(lot, length, gram)
                row = np.array([r for r, _, _ in lot])[part]
                order = np.lexsort((place, rank[row], span, anchor))
                same = (anchor[order][1:] == anchor[order][:-1]) & (span[order][1:] == span[order][:-1])
                again = np.zeros(len(order), bool)
                again[order[1:]] = same
                ids = batch.column("id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(span, mask=again), ids, pa.array(place)],
                    names=["anchor", "span", "id", "place"],
                )

    id_type = docs.schema["id"].dataType.simpleString()
    return in_arrow(docs, run, f"anchor bigint, span bigint, id {id_type}, place bigint")


def _sorted_out(spans: DataFrame) -> DataFrame:
    """anchor, id, place, open: repeated spans (open false), and first ones of an anchor with different spans (open).

    Goes through rows sorted by anchor, span, id and place with one row in mind, however many share an anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last first span, not yet known to be alone
        last = None  # the last row
        for batch in batches:
            table = pa.Table.from_batches([batch])
            known = table.column("span").is_null()
            yield from _marked(table.filter(known).drop_columns(["span"]), False)
            table = table.filter(table.column("span").is_valid())
            if last is not None:
                table = pa.concat_tables([last, table])
            if not table.num_rows:
                continue
            anchor, span, place = (table.column(c).to_numpy() for c in ("anchor", "span", "place"))
            ids = table.column("id").to_numpy()
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])
            again = np.zeros(len(anchor), bool)
            again[1:] = ~fresh[1:] & (place[1:] == place[:-1]) & (ids[1:] == ids[:-1])
            if last is not None:  # it has been dealt with
                fresh[0], again[0] = False, True
            last = table.slice(table.num_rows - 1)
            repeats = table.filter(pa.array(~fresh & ~again)).drop_columns(["span"])
            yield from _marked(repeats, False)
            firsts = table.filter(pa.array(fresh)).drop_columns(["span"])
            if held is not None:
                firsts = pa.concat_tables([held[0], firsts])
            if not firsts.num_rows:
                continue
            own = firsts.column("anchor").to_numpy()
            shared = np.zeros(len(own), bool)
            shared[1:] |= own[1:] == own[:-1]
            with_next = np.zeros(len(own), bool)
            with_next[:-1] = own[1:] == own[:-1]
            if held is not None:
                shared[0] |= held[1]
            done = (shared | with_next)[:-1]
            yield from _marked(firsts.slice(0, len(own) - 1).filter(pa.array(done)), True)
            held = (firsts.slice(len(own) - 1), bool(shared[-1]))
        if held is not None and held[1]:
            yield from _marked(held[0], True)

    keys = ["anchor", "span", "id", "place"]
    id_type = spans.schema["id"].dataType.simpleString()
    spread = F.when(F.col("span").isNull(), F.xxhash64("id", "place")).otherwise(F.col("anchor"))
    dealt = spans.repartition(spread).sortWithinPartitions(*keys).select(*keys)
    return in_arrow(dealt, run, f"anchor bigint, id {id_type}, place bigint, open boolean")


def _marked(table: pa.Table, flag: bool) -> Iterator[pa.RecordBatch]:
    if table.num_rows:
        table = table.append_column("open", pa.array(np.full(table.num_rows, flag)))
        yield from table.combine_chunks().to_batches()


def _shape(place: int) -> tuple[int, int, int]:
    """Start, number of strings, distance of the anchor."""
    return place >> 16, (place >> 8 & 255) + 1, place & 255


def _with_bytes(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """anchor, id, place, bytes of spans (anchor, id, place)."""
    wanted = spans.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("anchor", "place")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for row, (text, own) in enumerate(zip(texts, batch.column("spans").to_pylist(), strict=True)):
                data = plain_text(text)
                for low in range(0, len(own), _ROWS):
                    part = own[low : low + _ROWS]
                    cut = []
                    for one in part:
                        start, count, _ = _shape(one["place"])
                        cut.append(data[start : start + count - 1 + length])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([s["anchor"] for s in part], pa.int64()),
                            batch.column("id").take(pa.array([row] * len(part))),
                            pa.array([s["place"] for s in part], pa.int64()),
                            pa.array(cut, pa.binary()),
                        ],
                        names=["anchor", "id", "place", "bytes"],
                    )

    id_type = docs.schema["id"].dataType.simpleString()
    # Rows repeated as a whole are one document.
    joined = docs.join(wanted, docs["id"] == F.col("__id")).select("id", "text", "spans")
    found = in_arrow(joined, run, f"anchor bigint, id {id_type}, place bigint, bytes binary")
    return found


class _Suffix:
    """What follows an anchor, with hashes of all its prefixes."""

    __slots__ = ("data", "before", "hashes", "order", "anchor", "offsets")

    def __init__(self, piece: bytes, place: int, order: tuple, hashes: memoryview):
        start, count, distance = _shape(place)
        self.data, self.before, self.hashes = piece[distance:], piece[:distance], hashes
        self.order, self.anchor = order, start + distance
        self.offsets = range(max(distance - count + 1, 0), distance + 1)

    def common(self, other: _Suffix) -> int:
        """How many bytes agree, by binary search over the hashes."""
        low, high = 0, min(len(self.data), len(other.data))
        mine, theirs = self.hashes, other.hashes
        while low < high:
            mid = (low + high + 1) >> 1
            if mine[mid] == theirs[mid]:
                low = mid
            else:
                high = mid - 1
        return low


def _compared(a: _Suffix, b: _Suffix) -> int:
    n = a.common(b)
    x, y = a.data[n : n + 1], b.data[n : n + 1]
    return (x > y) - (x < y)


def _prefix_hashes(pieces: list[bytes], skips: list[int]) -> np.ndarray:
    """Row for row, the hash of every prefix of what follows the skipped bytes."""
    kind = _hash(3, 2 * _BLOCK)
    width = max(map(len, pieces))
    table = np.zeros((len(pieces), width), np.uint64)
    for row, (piece, skip) in enumerate(zip(pieces, skips, strict=True)):
        part = np.frombuffer(piece, np.uint8)[skip:]
        table[row, : len(part)] = kind.values[part]
    out = np.zeros((len(pieces), width + 1), np.uint64)
    np.cumsum(table * kind.powers[:width], axis=1, out=out[:, 1:])
    return out


def repeated_strings(group: list[_Suffix], length: int) -> Iterator[tuple[tuple, int]]:
    """(order of its document, start) of each string that starts earlier elsewhere in the group of an anchor."""
    ranked = sorted(group, key=cmp_to_key(_compared))
    agree = [a.common(b) for a, b in zip(ranked, ranked[1:], strict=False)]
    verified = all(
        a.data[:n] == b.data[:n] and _compared(a, b) == (a.data > b.data) - (a.data < b.data)
        for a, b, n in zip(ranked, ranked[1:], agree, strict=False)
    )
    if not verified:  # two different prefixes share a hash
        ranked = sorted(group, key=lambda s: s.data)
        agree = [_agreement(a.data, b.data) for a, b in zip(ranked, ranked[1:], strict=False)]
    member = {id(s): i for i, s in enumerate(ranked)}
    earliest = sorted(group, key=lambda s: (s.order, s.anchor))
    for offset in sorted({o for s in group for o in s.offsets}):
        run, runs = 0, [0]
        for n in agree:
            run += n < length - offset
            runs.append(run)
        seen = set()
        for suffix in earliest:
            if offset in suffix.offsets:
                key = (runs[member[id(suffix)]], suffix.before[len(suffix.before) - offset :])
                if key in seen:
                    yield suffix.order, suffix.anchor - offset
                seen.add(key)


def _agreement(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    same = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)
    return int(same.argmax()) if same.any() else n


def _suffix_sorted(spans: DataFrame, length: int) -> DataFrame:
    """id, place (of one string each) of repeats, from spans (anchor, id, place, bytes) dealt out by anchor."""

    def resolve(rows: list[dict]) -> pa.RecordBatch:
        hashes = _prefix_hashes([r["bytes"] for r in rows], [_shape(r["place"])[2] for r in rows])
        found, low = [], 0
        while low < len(rows):
            high = low
            while high < len(rows) and rows[high]["anchor"] == rows[low]["anchor"]:
                high += 1
            group = [_Suffix(r["bytes"], r["place"], (r["id"],), memoryview(hashes[i])) for i, r in enumerate(rows[low:high], low)]
            found += repeated_strings(group, length)
            low = high
        ids = pa.array([order[0] for order, _ in found], types["id"])
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([start << 16 for _, start in found], pa.int64())], names=["id", "place"]
        )

    types: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            types["id"] = batch.schema.field("id").type
            for row in batch.to_pylist():
                # Rows of an anchor stay together: at most SORTED_SPANS of them.
                if len(rows) >= _ROWS and row["anchor"] != rows[-1]["anchor"]:
                    yield resolve(rows)
                    rows = []
                if not rows or row != rows[-1]:
                    rows.append(row)
        if rows:
            yield resolve(rows)

    keys = ["anchor", "id", "place"]
    id_type = spans.schema["id"].dataType.simpleString()
    dealt = spans.repartition("anchor").sortWithinPartitions(*keys).select(*keys, "bytes")
    return in_arrow(dealt, run, f"id {id_type}, place bigint")


def _string_by_string(spans: DataFrame, length: int) -> DataFrame:
    """The same for anchors with many spans: every string is a row, and meets its equals by shuffle."""
    first = F.shiftright("place", 16)
    count = F.shiftright("place", 8).bitwiseAND(F.lit(255)).cast("int")
    strings = spans.select("id", first.alias("first"), "bytes", F.explode(F.sequence(F.lit(0), count)).alias("i"))
    strings = strings.select(
        "id", (F.col("first") + F.col("i")).alias("start"), F.substr("bytes", F.col("i") + 1, F.lit(length)).alias("string")
    ).distinct()
    nth = F.row_number().over(Window.partitionBy("string").orderBy("id", "start"))
    return strings.withColumn("nth", nth).where("nth > 1").select("id", F.shiftleft("start", 16).alias("place"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, sorted_spans: int = SORTED_SPANS) -> DataFrame:
    """id, place of all repeated strings of docs (id not null, text); ``place`` may stand for a run of strings."""
    found = stored(_sorted_out(_anchored(docs, length, gram)), "spans")
    edges = stored(_with_bytes(docs, found.where("open"), length), "edges")
    many = edges.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > sorted_spans).select("anchor")
    many = stored(many, "many")
    few = _suffix_sorted(edges.join(many, "anchor", "left_anti"), length)
    rest = _string_by_string(edges.join(many, "anchor", "left_semi"), length)
    return found.where("not open").select("id", "place").unionByName(few).unionByName(rest)


def _runs(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs of a document."""
    places = np.sort(places)
    starts = places >> 16
    ends = starts + (places >> 8 & 255) + length
    reach = np.maximum.accumulate(ends)
    opens = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    closes = np.append(opens[1:], len(starts)) - 1
    return list(zip(starts[opens].tolist(), reach[closes].tolist(), strict=True))


def cut_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    sorted_spans: int = SORTED_SPANS,
) -> DataFrame:
    """A row for each row of ``docs``: id, n_bytes, spans (removed byte runs: start, end), kept (bytes that stay).

    Null and empty texts have no bytes. Texts shorter than ``length`` have no repeats. Rows of one id must hold one
    text; a repeated row is the same document again and gets the same result. A row with a null id is nobody's
    copy and stays whole. An empty table gives no rows. Other columns are not read.
    """
    joined = _with_places(docs.select(id_column, text_column), id_column, text_column, length, gram, sorted_spans)
    source = joined.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), joined.columns[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for data, own in _with_runs(batch, "text", length):
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(_without(data, own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"],
            )

    id_type = source.schema["id"].dataType.simpleString()
    return in_arrow(
        source, run, f"id {id_type}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    )


def drop_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    sorted_spans: int = SORTED_SPANS,
) -> DataFrame:
    """All rows and columns of ``docs``, the texts without their repeats.

    A character stays if one of its bytes does. A text that is all repeats becomes empty; null stays null.
    """
    joined = _with_places(docs, id_column, text_column, length, gram, sorted_spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_column)
            texts = [
                None if data is None else _without(data, _whole_characters(data, own)).decode("utf-8", "replace")
                for data, own in _with_runs(batch, text_column, length, null=True)
            ]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns[:-1], names=batch.schema.names[:-1])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return in_arrow(joined, run, shape)


def _with_places(
    docs: DataFrame, id_column: str, text_column: str, length: int, gram: int, sorted_spans: int
) -> DataFrame:
    """The rows and, last, the places of each row's repeated strings, null if there are none."""
    if not gram < length <= 255:
        raise ValueError("a string has at most 255 bytes and is longer than a gram")
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = repeats(source.where("id is not null"), length, gram, sorted_spans)
    own, places = free_name(docs, "__id"), free_name(docs, "__places")
    gone = found.groupBy(F.col("id").alias(own)).agg(F.collect_list("place").alias(places))
    return docs.join(gone, F.col(id_column) == F.col(own), "left").select(*docs.columns, places)


def _with_runs(
    batch: pa.RecordBatch, text_column: str, length: int, null: bool = False
) -> Iterator[tuple[bytes | None, list[tuple[int, int]]]]:
    places = batch.column(batch.num_columns - 1)
    for row, text in enumerate(batch.column(text_column).to_pylist()):
        own = _runs(places[row].values.to_numpy(), length) if places[row].is_valid else []
        yield (None if null and text is None else plain_text(text)), own


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the characters that they hold in part."""
    whole = []
    for start, end in runs:
        while start < end and 0x80 <= data[start] < 0xC0:
            start += 1
        while start < end < len(data) and 0x80 <= data[end] < 0xC0:
            end -= 1
        whole.append((start, end))
    return whole
