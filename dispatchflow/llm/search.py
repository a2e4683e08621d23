"""Ranked lexical search, BM25 in whole numbers: accumulators from short lists, then documents at a time over long ones.

The documents' terms that any query asks for are stored once, with how often each is there. A task goes through them
in shards of ``SHARD`` documents and builds an inverted index of each. For a query, the shard's short lists are added
up term at a time; the sums are from then on one list with one bound. With the long lists it is read document at a
time: a window of documents is skipped if the bounds of the sums and of all lists cannot reach the lowest score that
still counts, and left as soon as the lists not read yet cannot lift any of its documents there. Every score that
comes out is exact, and a document left out has a lower one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored, terms, union_all

# Documents that are indexed together, and those of a window, which is skipped or read as one.
SHARD = 8192
WINDOW = 128
# A list is short if it holds at most this share of the shard.
SHORT = 1 / 16
# Bytes of query texts that are answered in one go over the documents.
QUERY_BYTES = 1 << 22


def ranked(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    k1_tenths: int = 8,
    b_percent: int = 75,
    query_bytes: int = QUERY_BYTES,
    shard: int = SHARD,
) -> DataFrame:
    """item, id, score, rank (from 1) of the ``k`` documents of highest score above 0 for each row of ``items``.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))), over N documents with terms; tf of them in a document
    count (10^9 tf) div (1000 tf + k1 m), where m is its length in percent of the mean, in the share b. Equal scores
    go by ascending id, null last. Null and empty texts have no terms; an item without terms that occur has no row, and
    an empty table gives none. Repeated documents are ranked one by one; each of repeated items has its own rows. Texts
    are read whole, however long. Other columns are not read.

    Queries are different texts, in blocks of about ``query_bytes``: a block's terms go to all tasks, and the
    documents are gone through once for each block.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    asked = items.select(F.col(item_column).alias("item"), F.col(item_text).alias("query")).where("query is not null")
    size = asked.agg(F.sum(F.octet_length("query"))).first()[0] or 0
    blocks = max(1, math.ceil(size / query_bytes))
    queries = asked.select("query").distinct().withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    found = [
        _answered(source, asked, queries.where(F.col("block") == block), k, k1_tenths, b_percent, shard)
        for block in range(blocks)
    ]
    return union_all(found)


def _answered(
    source: DataFrame, asked: DataFrame, queries: DataFrame, k: int, k1: int, b: int, shard: int
) -> DataFrame:
    texts = sorted(row.query for row in queries.select("query").collect())  # about QUERY_BYTES
    wanted = [Counter(terms(text)) for text in texts]
    number = {term: i for i, term in enumerate(sorted(set().union(*wanted)))}
    lists = stored(postings(source, number), "postings")
    count, length = lists.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = {row.term: row.df for row in _document_frequencies(lists, len(number)).collect()}  # a row for each term
    weights = [
        [(number[t], q * math.floor(1000 * math.log((2 * count + 2) / (2 * held[number[t]] + 1))))
         for t, q in query.items() if number[t] in held]
        for query in wanted
    ]
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in weights]
        kind = None
        for table in _sharded(batches, shard):
            kind = table.schema.field("id").type
            index = Index(table, count, length, k1, b)
            for of, query in zip(best, weights, strict=True):
                index.search(query, of, k)
        hits = [(q, score, id_) for q, of in enumerate(best) for score, id_ in of]
        if hits:
            q, scores, ids = zip(*hits, strict=True)
            columns = [pa.array(q, pa.int32()), pa.array(scores, pa.int64()), pa.array(ids, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "score", "id"])

    hits = in_arrow(lists, run, f"q int, score bigint, id {id_type}")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    hits = hits.withColumn("rank", place).where(F.col("rank") <= k)
    named = source.sparkSession.createDataFrame(list(enumerate(texts)), "q int, query string")
    rows = asked.join(F.broadcast(named), "query").join(hits, "q")
    return rows.select("item", "id", "score", "rank")


def postings(source: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """id, n (terms, with repeats), terms (numbers, ascending) and times (of each) of every document (id, text).

    Only terms that have a number are given. Numbers and times are 32-bit whole numbers, little-endian.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                known = sorted((number[t], c) for t, c in Counter(words).items() if t in number)
                pairs = np.array(known, "<u4").reshape(-1, 2)
                rows.append((len(words), pairs[:, 0].tobytes(), pairs[:, 1].tobytes()))
            n, numbers, times = zip(*rows, strict=True)
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(numbers, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "times"])

    id_type = source.schema["id"].dataType.simpleString()
    return in_arrow(source, run, f"id {id_type}, n bigint, terms binary, times binary")


def _document_frequencies(lists: DataFrame, vocabulary: int) -> DataFrame:
    """term, df: added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u4"), minlength=vocabulary)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(df[there])], names=["term", "df"])

    parts = in_arrow(lists.select("terms"), run, "term int, df bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def _sharded(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in slices(batches, shard):
        held.append(batch)
        rows += batch.num_rows
        if rows >= shard:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


class Index:
    """The inverted lists of a shard, with bounds for each window."""

    def __init__(self, table: pa.Table, count: int, length: int, k1: int, b: int):
        self.ids = table.column("id").to_pylist()
        self.rows = len(self.ids)
        self.windows = -(-self.rows // WINDOW)
        numbers, times = table.column("terms").to_pylist(), table.column("times").to_pylist()
        # In Python's whole numbers, since the product may pass 64 bits.
        norm = np.array([100 - b + b * n * count // max(length, 1) for n in table.column("n").to_pylist()], np.int64)
        term = np.frombuffer(b"".join(numbers), "<u4")
        doc = np.repeat(np.arange(self.rows), [len(part) // 4 for part in numbers])
        tf = np.frombuffer(b"".join(times), "<u4").astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        self.part = (1_000_000_000 * tf // (1000 * tf + k1 * norm[doc]))[order]
        there, starts = np.unique(term[order], return_index=True)
        ends = np.append(starts, len(term))[1:]
        self.span = dict(zip(there.tolist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _window_bounds(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each window begins in a long list, and the highest part of a document in it."""
        if term not in self.bounds:
            low, high = self.span[term]
            edges = low + np.searchsorted(self.doc[low:high], np.arange(self.windows + 1) * WINDOW)
            most = np.zeros(self.windows, np.int64)
            full = np.flatnonzero(edges[1:] > edges[:-1])
            most[full] = np.maximum.reduceat(self.part[low:high], edges[full] - low)
            self.bounds[term] = edges, most
        return self.bounds[term]

    def search(self, query: list[tuple[int, int]], best: list, k: int) -> None:
        """Enter the shard's documents into ``best`` (score, id), the ``k`` highest so far of a query (term, weight)."""
        sums = np.zeros(self.windows * WINDOW, np.int64)
        long = []
        for term, weight in query:
            if weight <= 0 or term not in self.span:
                continue
            low, high = self.span[term]
            if high - low <= SHORT * self.rows:
                sums[self.doc[low:high]] += weight * self.part[low:high]
            else:
                edges, most = self._window_bounds(term)
                long.append((int(most.max()) * weight, weight, edges, weight * most))
        long.sort(key=lambda x: -x[0])
        bounds = np.array([sums.reshape(-1, WINDOW).max(axis=1), *(x[3] for x in long)])
        rest = np.cumsum(bounds[::-1], axis=0)[::-1]  # of a list and all after it, by window
        # k sums are scores of k documents at least.
        floor = max(1, int(np.partition(sums, -k)[-k]) if len(sums) >= k else 1, best[-1][0] if len(best) >= k else 1)
        for window in np.flatnonzero(rest[0] >= floor).tolist():
            if rest[0, window] < floor:
                continue
            first = window * WINDOW
            scores = sums[first : first + WINDOW].copy()
            for i, (_, weight, edges, _) in enumerate(long, 1):
                if scores.max() + rest[i, window] < floor:
                    break
                low, high = edges[window], edges[window + 1]
                scores[self.doc[low:high] - first] += weight * self.part[low:high]
            else:
                hits = np.flatnonzero(scores >= floor)
                if len(hits):
                    best += [(int(scores[h]), self.ids[first + h]) for h in hits.tolist()]
                    best.sort(key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))
                    del best[k:]
                    if len(best) >= k:
                        floor = max(floor, best[-1][0])
