"""SimHash near-duplicates, candidates by pigeonring filtering.

A fingerprint is cut into segments that lie on a ring. If two fingerprints differ in at most t of all bits, then
from some segment on every chain of l consecutive segments differs in at most l * t / m bits. With t < m such a
chain begins with an equal segment, so fingerprints meet by (segment, its bits), and what does not keep to the
budget of each longer chain goes before the whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, plain_text, stored, without
from .graph import components

SHINGLE_WORDS = 5
SEED = 42
# A bucket of more fingerprints is not compared pair by pair.
PAIRWISE = 128
_BLOCK = 1 << 15


def shingles(text: str | None, size: int) -> list[bytes]:
    """Word shingles of a text with A-Z in lower case, repeats included; the whole sequence if it is shorter."""
    words = plain_text(text).lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(part) for part in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> bytes:
    """64 bits, highest first: a bit is set if it is in over half the shingles' hashes, repeats included."""
    parts = shingles(text, size)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(parts), _BLOCK):
        data = b"".join([xxhash.xxh64_digest(p, SEED) for p in parts[start : start + _BLOCK]])
        bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(parts)).tobytes()


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS
) -> DataFrame:
    """id, fingerprint (8 bytes) of each row. No words, also null: all bits zero."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text, size) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(prints, pa.binary())], names=["id", "fingerprint"]
            )

    return in_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, fingerprint binary")


def _ring(bits: int, segments: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment."""
    edges = [bits * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(low: int, width: int) -> int:
    mask = ((1 << width) - 1) << low
    return mask - (1 << 64) if mask >> 63 else mask


def _chain_holds(first: Column, second: Column, start: int, ring: list[tuple[int, int]], most: int) -> Column:
    """From segment ``start`` on, every chain of l segments differs in at most l * most / m bits."""
    differ = first.bitwiseXOR(second)
    holds, mask = F.lit(True), 0
    for length in range(1, len(ring) + 1):
        mask |= _mask(*ring[(start + length - 1) % len(ring)])
        budget = length * most // len(ring)
        holds = holds & (F.bit_count(differ.bitwiseAND(F.lit(mask))) <= budget)
    return holds


def links(prints: DataFrame, most: int = 2, segments: int = 3, pairwise: int = PAIRWISE) -> DataFrame:
    """a, b of different 64-bit fingerprints (print bigint, id) whose links join all that differ in at most 2 bits.

    In a bucket of up to ``pairwise`` fingerprints, every pair that keeps to the chain budgets is compared. In a
    larger one, each fingerprint goes to the points it reaches by turning one bit or none outside of the segment;
    two fingerprints that differ in at most 2 bits share such a point, and those that share one differ in at
    most 2. A point has at most 65 fingerprints, so neither way grows with the square of a bucket.
    """
    if most != 2 or segments <= most:
        raise ValueError("buckets beyond the pairwise size are resolved for 2 bits and 3 or more segments")
    ring = _ring(64, segments)
    keys = F.array(*(F.col("print").bitwiseAND(F.lit(_mask(*s))) for s in ring))
    placed = prints.select("print", "id", F.posexplode(keys).alias("segment", "key"))
    crowded = (
        placed.groupBy("segment", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > pairwise).drop("n")
    )
    crowded = stored(crowded, "crowded")
    few = placed.join(crowded, ["segment", "key"], "left_anti")
    members = few.groupBy("segment", "key").agg(F.collect_list(F.struct("print", "id")).alias("all"))
    members = members.where(F.size("all") > 1)

    def pairs(start: int) -> Column:
        def partners(one: Column, i: Column) -> Column:
            later = F.slice(F.col("all"), i + 2, F.size("all"))
            near = F.filter(later, lambda two: _chain_holds(one["print"], two["print"], start, ring, most))
            return F.transform(near, lambda two: F.struct(one["id"].alias("a"), two["id"].alias("b")))

        return F.flatten(F.transform("all", partners))

    choice = F.when(F.col("segment") == 0, pairs(0))
    for i in range(1, segments):
        choice = choice.when(F.col("segment") == i, pairs(i))
    found = members.select(F.inline(choice))

    many = placed.join(crowded, ["segment", "key"], "left_semi")
    turns = F.when(F.col("segment") == 0, F.array(*(F.lit(t) for t in _turns(ring[0]))))
    for i in range(1, segments):
        turns = turns.when(F.col("segment") == i, F.array(*(F.lit(t) for t in _turns(ring[i]))))
    points = many.select(
        "id", "segment", F.explode(F.transform(turns, lambda t: F.col("print").bitwiseXOR(t))).alias("point")
    )
    shared = points.groupBy("segment", "point").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    starred = shared.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b")
    return found.unionByName(starred)


def _turns(segment: tuple[int, int]) -> list[int]:
    """Zero, and each single bit outside of the segment."""
    low, width = segment
    return [0] + [_mask(b, 1) for b in range(64) if not low <= b < low + width]


def near_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE_WORDS,
    most: int = 2,
    segments: int = 3,
) -> DataFrame:
    """id, print (bigint), component_id of each row: the smallest id reachable over links, its own included.

    Equal fingerprints are one node, so copies of a text cost no pairs. Rows without words share fingerprint zero.
    A null id is never a component's smallest id; where there is no other, ``component_id`` is null. Repeated rows
    come out as often as they go in. An empty table gives no rows.
    """
    prints = fingerprints(docs, id_column, text_column, size)
    value = F.conv(F.hex("fingerprint"), 16, -10).cast("bigint")
    prints = stored(prints.select("id", value.alias("print")), "prints")
    nodes = stored(prints.groupBy("print").agg(F.min("id").alias("id")), "nodes")
    roots = components(links(nodes.where("id is not null"), most, segments), "near")
    named = nodes.join(roots, F.col("id") == F.col("node"), "left").select(
        F.col("print").alias("of"), F.coalesce("root", "id").alias("component_id")
    )
    return prints.join(named, F.col("print") == F.col("of")).select("id", "print", "component_id")


def drop_near(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE_WORDS,
    most: int = 2,
    segments: int = 3,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component, those of the smallest id.

    Rows with a null id stay. Rows of one id stay or go together. Texts without words, null ones too, share a
    fingerprint and are one component. An empty table gives no rows.
    """
    found = stored(near_components(docs, id_column, text_column, size, most, segments), "near")
    return without(docs, found.where("id <> component_id").select("id").distinct(), {"id": F.col(id_column)})
