"""Importance resampling towards a target: hashed n-gram features, counted once for each different line.

Texts are cut at newlines. The features of a different line are counted once, whatever number of documents hold it;
the corpus's counts are the lines' counts times their occurrences, and a document's are those of its lines added up.
N-grams that go over a line's end belong to no line: they are counted for each document and added.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, in_order, plain_text, slices, stored, terms, with_hot_keys

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10


def line_features(line: str | bytes, n: int, buckets: int = BUCKETS) -> tuple[int, list[int]]:
    """Words of a line, and the buckets of all its runs of 1 to ``n`` words, repeats included."""
    words = terms(line.decode("utf-8", "surrogatepass") if isinstance(line, bytes) else line)
    found = [crc32(w) % buckets for w in words]
    for k in range(2, n + 1):
        found += [crc32(b" ".join(words[i : i + k])) % buckets for i in range(len(words) - k + 1)]
    return len(words), found


def crossing_features(lines: list[bytes], n: int, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the runs of 2 to ``n`` words that go over the end of a line, each found in the line where it ends."""
    found: list[int] = []
    tail: list[bytes] = []
    for line in lines if n > 1 else ():
        words = terms(line.decode("utf-8", "surrogatepass"))
        both = tail + words[: n - 1]
        for end in range(len(tail) + 1, len(both) + 1):
            for start in range(max(0, end - n), len(tail)):
                found.append(crc32(b" ".join(both[start:end])) % buckets)
        tail = (tail + words)[-(n - 1) :]
    return found


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text: str = "text",
    n: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """id, n_features, weight, score, rank of each row of ``docs``; rank is null for rows that are not drawn.

    A bucket's gain is floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))), of S features of the documents
    and T of the target, s and t in the bucket. A document's weight is the floored mean of the gains of its features,
    0 without any. Its score adds Gumbel noise from a hash of its id, so that the ``percent`` highest scores of those
    with ``min_words`` words are a sample without replacement by the weights.

    Null and empty texts have no features and are not drawn. Equal scores go by ascending id, null last; a null id is
    hashed as no characters. Each of repeated rows has a rank of its own. Without documents there are no rows; without
    target texts, T is 0. Texts are read whole, however long. Other columns are not read.
    """
    lines, rows = counted(docs, id_column, text_column, n, buckets)
    aimed, aimed_rows = counted(target, None, target_text, n, buckets)
    gain = _gains(bucket_counts(lines, rows, n, buckets), bucket_counts(aimed, aimed_rows, n, buckets))
    scored = stored(_with_gains(lines, gain), "lines")
    total = scored.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
    held = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("line"))
    held = held.select("row", F.col("line.keys").alias("key"), F.col("line.times").alias("times"))
    joined = with_hot_keys(held, scored, ["key"], "occurrences", total)
    parts = ("gain", "n_features", "n_words")
    of_lines = joined.select("row", *((F.col("times") * F.col(c)).alias(c) for c in parts))
    own = _with_gains(rows.select("row", "id", "features"), gain).withColumn("n_words", F.lit(0))
    sums = own.unionByName(of_lines, allowMissingColumns=True).groupBy("row")
    sums = sums.agg(F.max("id").alias("id"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts))
    weight = F.when(F.col("n_features") == 0, 0).otherwise(
        F.expr("(gain - pmod(gain, n_features)) div greatest(n_features, 1)")
    )
    scores = sums.select("row", "id", "n_features", "n_words", weight.cast("long").alias("weight"))
    scores = stored(scores.withColumn("score", F.col("weight") + _noise(F.col("id"), seed)), "scores")
    able = scores.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    ranks = in_order(able.select("row", "id", "score"), order, "rank").where(F.col("rank") <= drawn)
    ranks = ranks.select("row", F.col("rank").cast("long").alias("rank"))
    return scores.join(ranks, "row", "left").select("id", "n_features", "weight", "score", "rank")


def counted(
    docs: DataFrame, id_column: str | None, text_column: str, n: int, buckets: int
) -> tuple[DataFrame, DataFrame]:
    """The different lines with words: key, occurrences, n_words, features. And a row for each document: row (a number
    of its own), id, keys and times of its different lines, features of the runs that cross lines.

    Features are buckets as 32-bit numbers, little-endian, repeats included. A key is the line's MD5, 16 bytes.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    cut = docs.select(F.explode(F.split(text, "\n")).alias("line")).where(F.col("line") != "")
    cut = cut.groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            rows = []
            for line, times in zip(batch.column("line").to_pylist(), batch.column("occurrences").to_pylist(), strict=True):
                words, found = line_features(line, n, buckets)
                if words:
                    rows.append((md5(plain_text(line)).digest(), times, words, np.array(found, "<u4").tobytes()))
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "occurrences", "n_words", "features"])

    lines = stored(in_arrow(cut, features, "key binary, occurrences bigint, n_words bigint, features binary"), "features")

    id_ = F.col(id_column) if id_column else F.lit(None).cast("long")
    source = docs.select(F.monotonically_increasing_id().alias("row"), id_.alias("id"), F.col(text_column).alias("text"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keys, times, cross = [], [], []
            for text in batch.column("text").to_pylist():
                cut = plain_text(text).split(b"\n")
                there = Counter(line for line in cut if line)
                keys.append([md5(line).digest() for line in there])
                times.append(list(there.values()))
                cross.append(np.array(crossing_features(cut, n, buckets), "<u4").tobytes())
            columns = [
                batch.column("row"),
                batch.column("id"),
                pa.array(keys, pa.list_(pa.binary())),
                pa.array(times, pa.list_(pa.int64())),
                pa.array(cross, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "keys", "times", "features"])

    kind = source.schema["id"].dataType.simpleString()
    schema = f"row bigint, id {kind}, keys array<binary>, times array<bigint>, features binary"
    return lines, stored(in_arrow(source, held, schema), "rows")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All features of a batch one after another, and how many each row has."""
    parts = batch.column("features").to_pylist()
    return np.frombuffer(b"".join(parts), "<u4").astype(np.int64), np.array([len(p) // 4 for p in parts], np.int64)


def bucket_counts(lines: DataFrame, rows: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Features of a corpus in each bucket: those of its lines times their occurrences, and those that cross lines.

    Every task adds up its own, so at most ``buckets`` rows come from it, and as many reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in slices(batches, 4096):
            found, sizes = _flat(batch)
            times = np.repeat(batch.column("occurrences").to_numpy(zero_copy_only=False), sizes)
            sums += np.bincount(found, times, buckets).astype(np.int64)  # exact below 2 ** 53
        there = np.flatnonzero(sums)
        columns = [pa.array(there.astype(np.int32)), pa.array(sums[there])]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "features"])

    source = lines.select("features", "occurrences")
    if n > 1:
        source = source.unionByName(rows.select("features", F.lit(1).cast("long").alias("occurrences")))
    parts = in_arrow(source, run, "bucket int, features bigint")
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("features").alias("features")).collect():
        counts[row.bucket] = row.features
    return counts


def _gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of each bucket's share in the target over that in the corpus, one feature added to each."""
    held, aimed = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * held / ((s + 1) * aimed))) for s, t in pairs], np.int64)


def _with_gains(frame: DataFrame, gains: np.ndarray) -> DataFrame:
    """The frame with n_features and gain, their gains added up, for each row's ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            found, sizes = _flat(batch)
            sums = np.concatenate([[0], np.cumsum(gains[found])])
            ends = np.cumsum(sizes)
            kept = [c for c in batch.schema.names if c != "features"]
            columns = [*(batch.column(c) for c in kept), pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_features", "gain"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in frame.schema if f.name != "features"]
    return in_arrow(frame, run, ", ".join([*kept, "n_features bigint", "gain bigint"]))


def _noise(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of a hash of the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((bits + 0.5) / 4294967296.0))).cast("long")
