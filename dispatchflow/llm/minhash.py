"""MinHash near-duplicates by min-max hashing: of each permutation the smallest and the largest value are kept.

So half as many hash evaluations give a signature of the same length, and its estimate of the similarity is unbiased
and varies less. Bands are of smallest values of different permutations, or of largest ones, so that the values of a
band are independent of each other.

Documents with equal sets are one node. In every bucket all nodes are compared with its smallest, which is as many
comparisons as there are rows. Where the links found so far leave a bucket in more than one part, the nodes outside of
its largest part are compared with all nodes of other parts, in blocks, and a task gives a link only if it joins what
it has not joined yet. So every pair that shares a bucket is compared or already joined by verified links, and the
number of links does not grow with the square of a bucket. Links are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored, with_hot_keys
from .graph import components
from .simhash import shingles

SHINGLE_WORDS = 4
PERCENT = 80
# Values in a band, and permutations: two bands for each BAND of them. A pair of similarity 0.8 shares none of the
# 28 bands with a chance of (1 - 0.8 ** 5) ** 28, 1 in 67,000.
BAND = 5
PERMUTATIONS = 70
# Rows, and bytes of their sets, of a block in which nodes of one bucket are compared.
BLOCK_ROWS = 2048
BLOCK_BYTES = 1 << 24
# Members that are compared with their bucket's smallest in one task.
STAR = 256
_CHUNK = 4096
_draw = np.random.Generator(np.random.PCG64(12))
_XOR = _draw.integers(0, 2**64, PERMUTATIONS, np.uint64)[:, None]
_ODD = (_draw.integers(0, 2**64, PERMUTATIONS, np.uint64) | np.uint64(1))[:, None]


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different word shingles of a text."""
    data = b"".join([xxhash.xxh64_digest(s) for s in set(shingles(text, size))])
    return np.unique(np.frombuffer(data, ">u8").astype(np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest and largest value of a set under each permutation: two rows of PERMUTATIONS."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(PERMUTATIONS, np.uint64)
    for low in range(0, len(hashes), _CHUNK):
        mixed = (hashes[low : low + _CHUNK] ^ _XOR) * _ODD  # a bijection on 64 bits, as the next two steps are
        mixed ^= mixed >> np.uint64(29)
        mixed *= _ODD
        np.minimum(least, mixed.min(axis=1), out=least)
        np.maximum(most, mixed.max(axis=1), out=most)
    return np.stack([least, most])


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    """The estimate of two sets' Jaccard similarity by their signatures: the share of values that agree."""
    return float((one == two).mean())


def band_keys(values: np.ndarray) -> list[int]:
    """A 64-bit key for each band of a signature, of the band's number and its values."""
    bands = np.ascontiguousarray(values.reshape(-1, BAND))
    return np.frombuffer(b"".join([xxhash.xxh64_digest(b.tobytes(), i) for i, b in enumerate(bands)]), ">i8").tolist()


def signatures(source: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """id, n_shingles, digest (of the set; null for the empty one), bands (keys) of each row (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, digests, bands = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, size)
                counts.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                bands.append(band_keys(signature(hashes)) if len(hashes) else [])
            columns = [
                batch.column("id"),
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "digest", "bands"])

    kind = source.schema["id"].dataType.simpleString()
    return in_arrow(source, run, f"id {kind}, n_shingles bigint, digest binary, bands array<bigint>")


def near_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    block_rows: int = BLOCK_ROWS,
    star: int = STAR,
) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links, its own included), kept of each row of ``docs``.

    Two documents are linked if 100 times their sets' intersection is ``percent`` times their union or more. A text of
    fewer than ``size`` words is one shingle; a null text or one without words has an empty set and no link. Sets are
    of 64-bit hashes. Repeated rows come out as often as they go in, and rows of one id are one document. A null id is
    never a component's smallest; where there is no other, ``component_id`` is null and the row kept. An empty table
    gives no rows. Texts are read whole, however long. Other columns are not read.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = stored(signatures(source, size), "signatures")
    nodes = rows.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("id"),
        F.any_value("bands").alias("bands"),
        F.any_value("n_shingles").alias("n_shingles"),
        F.count(F.lit(1)).alias("rows"),
    )
    nodes = stored(nodes, "nodes")
    placed = nodes.where("id is not null").select("id", "n_shingles", F.explode("bands").alias("key"))
    buckets = placed.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members"))
    buckets = stored(buckets.where("members > 1"), "buckets")
    total = buckets.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    shared = stored(with_hot_keys(placed, buckets, ["key"], "members", total, "inner"), "shared")
    sets = stored(_sets(source, shared.select("id").distinct(), nodes, size), "sets")

    stars = shared.where("id <> least").select("least", "id").distinct()
    links = stored(_star_links(stars, sets, percent, star), "links")
    parts = components(links, "parts")
    more = stored(_other_links(shared, parts, sets, percent, block_rows), "more")
    if not more.isEmpty():
        parts = components(links.unionByName(more), "parts")
    named = nodes.join(parts, F.col("id") == F.col("node"), "left")
    named = named.select("digest", F.coalesce("root", "id").alias("component_id"), "rows")
    count = nodes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    found = with_hot_keys(rows.select("id", "n_shingles", "digest"), named, ["digest"], "rows", count)
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        "id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _sets(source: DataFrame, wanted: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """id and whole set (64-bit hashes, in the order of the machine) of the wanted nodes, made from their texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(text, size).tobytes() for text in batch.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_digest(s) for s in sets]
            columns = [batch.column("id"), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "set"])

    kind = source.schema["id"].dataType.simpleString()
    # The ids grow with the texts: they are merged at every size, and never broadcast.
    some = in_arrow(source.join(wanted.hint("merge"), "id", "left_semi"), run, f"id {kind}, digest binary, set binary")
    return some.join(nodes.select("id", "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(two) - common)


def _star_links(stars: DataFrame, sets: DataFrame, percent: int, star: int) -> DataFrame:
    """a, b of the pairs (least, id) that are alike. A task reads the set of ``least`` first, then its members' sets."""
    kind = sets.schema["id"].dataType.simpleString()
    sizes = stars.groupBy("least").agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes.withColumn("lots", F.ceil(F.col("n") / star).cast("int")), "stars")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    centres = sizes.select("least", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    centres = centres.select("least", "lot", F.lit(None).cast(kind).alias("id"), F.col("least").alias("of"))
    lots = with_hot_keys(stars, sizes, ["least"], "n", total)
    lot = F.pmod(F.xxhash64("id"), F.col("lots")).cast("int").alias("lot")
    members = lots.select("least", lot, "id", F.col("id").alias("of"))
    whole = sets.select(F.col("id").alias("of"), "set")
    both = centres.unionByName(members).join(whole, "of").select("least", "lot", "id", "set")
    dealt = both.repartition("least", "lot").sortWithinPartitions("least", "lot", F.col("id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            alike = []
            for id_, data in zip(batch.column("id").to_pylist(), batch.column("set").to_pylist(), strict=True):
                own = np.frombuffer(data, np.uint64)
                if id_ is None:
                    centre = own
                alike.append(id_ is not None and _alike(centre, own, percent))
            yield batch.select(["least", "id"]).filter(pa.array(alike, pa.bool_())).rename_columns(["a", "b"])

    return in_arrow(dealt, run, f"a {kind}, b {kind}")


def _other_links(shared: DataFrame, parts: DataFrame, sets: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """a, b of links that join parts (node, root) with a bucket in common.

    Rows of a bucket's largest part are not compared with each other, nor any of one part. So the largest part is dealt
    to blocks of its own, which meet only the blocks of other rows; those meet all.
    """
    keys = ["key"]
    kind = sets.schema["id"].dataType.simpleString()
    rooted = shared.join(parts, F.col("id") == F.col("node"), "left")
    rooted = rooted.select(*keys, "id", "n_shingles", F.coalesce("root", "id").alias("part"))
    counted = rooted.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("hashes"))
    split = counted.groupBy(*keys).agg(
        F.max_by(F.struct("part", "n", "hashes"), F.struct("n", "part")).alias("main"),
        *(F.sum(c).alias(c) for c in ("n", "hashes")),
    )
    most = F.greatest(F.lit(BLOCK_BYTES // 8), F.lit(1))
    blocks = {
        "main_blocks": F.greatest(F.col("main.n") / block_rows, F.col("main.hashes") / most),
        "other_blocks": F.greatest(
            (F.col("n") - F.col("main.n")) / block_rows, (F.col("hashes") - F.col("main.hashes")) / most
        ),
    }
    open_ = F.when(F.col("n") > 2, F.col("main.part")).alias("largest")  # of two, the one pair was compared
    split = split.select(*keys, "n", open_, *(F.ceil(c).cast("int").alias(name) for name, c in blocks.items()))
    split = stored(split, "split")
    total = split.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = with_hot_keys(rooted, split, keys, "n", total).where("largest is not null and other_blocks > 0")
    main = F.col("part") == F.col("largest")
    first = F.when(main, F.col("other_blocks")).otherwise(0)
    width = F.when(main, F.col("main_blocks")).otherwise(F.col("other_blocks"))
    block = (first + F.pmod(F.xxhash64("id"), width)).cast("int")
    rows = rows.withColumn("main", main).join(sets, "id")
    every = F.sequence(F.lit(0), F.col("other_blocks") - 1 + F.when(F.col("main"), 0).otherwise(F.col("main_blocks")))
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(every))
    pair = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    dealt = dealt.select(*keys, *pair, "block", "id", "part", "set")
    order = [*keys, "low", "high"]
    dealt = dealt.repartition(*order).sortWithinPartitions(*order, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        schema = None
        for batch in batches:
            type_ = batch.schema.field("id").type
            schema = pa.schema([("a", type_), ("b", type_)])
            for row in batch.to_pylist():
                if held and any(row[k] != held[0][k] for k in order):
                    yield pa.RecordBatch.from_pylist(_joining(held, percent), schema)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(_joining(held, percent), schema)

    return in_arrow(dealt, run, f"a {kind}, b {kind}").distinct()


def _joining(rows: list[dict], percent: int) -> list[dict]:
    """Links between rows of different parts, of one block or of two, that join what those before them do not."""
    sets = [np.frombuffer(row["set"], np.uint64) for row in rows]
    number, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    names: dict = {}
    part = np.array([names.setdefault(row["part"], len(names)) for row in rows])
    block = np.array([row["block"] for row in rows])
    two = rows[0]["low"] != rows[0]["high"]
    has = np.zeros(len(number), bool)
    found = []
    for at in np.flatnonzero(block == rows[0]["low"]).tolist():
        others = (block != block[at]) if two else (np.arange(len(rows)) > at)
        few, many = np.minimum(sizes, sizes[at]), np.maximum(sizes, sizes[at])
        others &= (part != part[at]) & (100 * few >= percent * many)
        others = np.flatnonzero(others)
        if not len(others):
            continue
        own = flat[ends[at] - sizes[at] : ends[at]]
        has[own] = True
        common = np.array([np.count_nonzero(has[flat[ends[o] - sizes[o] : ends[o]]]) for o in others.tolist()])
        has[own] = False
        for other in others[100 * common >= percent * (sizes[at] + sizes[others] - common)].tolist():
            if part[other] != part[at]:
                part[part == part[other]] = part[at]
                a, b = sorted((rows[at]["id"], rows[other]["id"]))
                found.append({"a": a, "b": b})
    return found
