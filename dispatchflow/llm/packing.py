"""Lexical retrieval packing: windows of tokens filled with documents that share rare terms.

Documents are tokenized once and dealt out by a lexical signature, so that likely neighbours lie together. A task
goes through blocks of them; each block is a shard with a BM25 inverted index of its own, weighted by document
frequencies over the whole corpus. A seed document asks its shard for unused neighbours, which fill its window in
the order of their scores: whole ones while they fit, then a piece of the best one that does not. The rest of a cut
document goes on as a document. Every id lies in one piece, and windows are full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import in_arrow, slices, stored

_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_ROWS = 1 << 14
# Texts whose different words are encoded together.
_TEXTS = 2048
# Seeds after which documents that are used up leave a shard's index.
_FORGET = 128


@dataclass(frozen=True)
class PackingParams:
    """``shard_docs`` and ``shard_ids`` bound a shard, which has one document at least; k1 and b are BM25's."""

    window: int = 2048
    end_id: int = 1
    shard_docs: int = 2048
    shard_ids: int = 1 << 22
    k1: float = 1.2
    b: float = 0.75


def _signature(ids: np.ndarray) -> int:
    """The smallest hash of two ids next to each other: texts with many words in common often have it in common."""
    if len(ids) < 2:
        return -1
    pairs = (ids[:-1].astype(np.uint64) * _ODD[0] + ids[1:]) * _ODD[1]
    return int((pairs >> np.uint64(16)).min())


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """id, signature, ids (unsigned 16 or 32 bit) of each row, the end id included."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        kind = _kind(tokenizer)
        for batch in slices(batches, _TEXTS):
            signatures, found = [], []
            for data in own.plain_many(batch.column("text")):
                ids = np.frombuffer(data, "<u4")
                signatures.append(_signature(ids))
                found.append(np.append(ids, np.uint32(end_id)).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(signatures, pa.int64()), pa.array(found, pa.binary())],
                names=["id", "signature", "ids"],
            )

    id_type = source.schema["id"].dataType.simpleString()
    return in_arrow(source, run, f"id {id_type}, signature bigint, ids binary")


def _kind(tokenizer: str) -> str:
    """The narrowest type that holds the tokenizer's ids."""
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def document_frequencies(tokens: DataFrame, tokenizer: str) -> tuple[np.ndarray, int, int]:
    """How many documents hold each id, the number of documents, and of ids. One row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, size = _kind(tokenizer), encoder(tokenizer).tokenizer.get_vocab_size()
        held, docs, ids = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for data in batch.column("ids").to_pylist():
                own = np.frombuffer(data, kind)
                held[np.unique(own)] += 1
                docs, ids = docs + 1, ids + len(own)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, [-1, -2])), pa.array(np.append(held[some], [docs, ids]))], names=["term", "n"]
        )

    rows = in_arrow(tokens.select("ids"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.collect()}
    docs, ids = found.pop(-1, 0), found.pop(-2, 0)
    table = np.zeros(max(found, default=0) + 1, np.int64)
    table[list(found)] = list(found.values())
    return table, docs, ids


class _Shard:
    """A BM25 inverted index over the token arrays of a block of documents."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, average: float, params: PackingParams):
        self.size = len(texts)
        lengths = np.array([len(t) for t in texts])
        owner = np.repeat(np.arange(self.size), lengths)
        key, counts = np.unique(np.concatenate(texts).astype(np.int64) * self.size + owner, return_counts=True)
        term, self.docs = np.divmod(key, self.size)
        norm = params.k1 * (1 - params.b + params.b * lengths / average)
        self.weights = idf[term] * counts * (params.k1 + 1) / (counts + norm[self.docs])
        _, self.begins, place = np.unique(term, return_index=True, return_inverse=True)
        self.ends = np.append(self.begins[1:], len(term))
        # The terms of each document, as places in begins and ends; those of no other document are left out.
        elsewhere = np.flatnonzero((self.ends - self.begins > 1)[place])
        elsewhere = elsewhere[np.argsort(self.docs[elsewhere], kind="stable")]
        bounds = np.searchsorted(self.docs[elsewhere], np.arange(1, self.size))
        self.terms = np.split(place[elsewhere], bounds)

    def forget(self, used: np.ndarray) -> None:
        """Takes documents out of the index."""
        stays = ~used[self.docs]
        before = np.append(0, np.cumsum(stays))
        self.docs, self.weights = self.docs[stays], self.weights[stays]
        self.begins, self.ends = before[self.begins], before[self.ends]

    def neighbours(self, seed: int) -> np.ndarray:
        """Other documents by falling score for all terms of the seed."""
        own = self.terms[seed]
        spans = list(zip(self.begins[own].tolist(), self.ends[own].tolist(), strict=True))
        if not spans:
            return np.zeros(0, np.int64)
        docs = np.concatenate([self.docs[a:b] for a, b in spans])
        scores = np.bincount(docs, np.concatenate([self.weights[a:b] for a, b in spans]), self.size)
        scores[seed] = 0
        some = np.flatnonzero(scores)
        return some[np.argsort(-scores[some], kind="stable")]


class _Packer:
    """Fills windows block by block; a window may stay open from one block to the next."""

    def __init__(self, params: PackingParams, idf: np.ndarray, average: float, first: int):
        self.params, self.idf, self.average, self.sequence = params, idf, average, first
        self.open: list[tuple] = []  # id, start, ids, length of the document
        self.room = params.window
        self.rows: list[tuple] = []

    def place(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        self.open.append((doc[0], start, ids, doc[1]))
        self.room -= len(ids)
        if not self.room:
            self.close(self.open)
            self.open, self.room = [], self.params.window

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for identifier, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((identifier, start, len(ids), crc, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def block(self, docs: list[tuple]) -> None:
        """docs: id, length, first id that is left, all ids (less than a window of them is left)."""
        if not docs:
            return
        shard = _Shard([d[3] for d in docs], self.idf, self.average, self.params)
        begins, left = [d[2] for d in docs], [len(d[3]) - d[2] for d in docs]
        asked = 0

        def put(i: int, most: int) -> None:
            n = min(left[i], most)
            self.place(docs[i], begins[i], docs[i][3][begins[i] : begins[i] + n])
            begins[i] += n
            left[i] -= n

        for seed in range(len(docs)):
            while left[seed]:
                put(seed, self.room)
                if self.room == self.params.window:
                    continue  # just filled; what is left of the seed begins a window
                asked += 1
                if asked % _FORGET == 0:
                    shard.forget(np.array(left) == 0)
                cut = None
                for i in shard.neighbours(seed).tolist():
                    if left[i] and left[i] <= self.room:
                        put(i, self.room)
                        if self.room == self.params.window:
                            break
                    elif left[i] and cut is None:
                        cut = i
                else:
                    if cut is not None and left[cut]:
                        put(cut, self.room)

    def finish(self) -> None:
        """What is left in an open window goes to sequences of a power of two, which need no padding."""
        pieces, self.open = self.open, []
        left = self.params.window - self.room
        while left:
            size, taken = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                identifier, start, ids, total = pieces[0]
                n = min(size, len(ids))
                taken.append((identifier, start, ids[:n], total))
                size -= n
                pieces[0] = (identifier, start + n, ids[n:], total)
                if n == len(ids):
                    pieces.pop(0)
            self.close(taken)
        self.room = self.params.window


def pack(
    docs: DataFrame,
    tokenizer: str,
    params: PackingParams = PackingParams(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The pieces of all rows of ``docs``: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's ids end with ``end_id``; null and empty texts have that one only. A document of a window or more fills
    windows of its own, and its rest is packed; it is found, and asks for others, by all of its ids. Neighbours of
    equal score come in the order of the shard, by signature and id. Repeated rows and null ids are rows like any
    other. An empty table gives no rows; other columns are not read. Sequences hold ``window`` ids, or a power of two
    at the end of a task's rows.
    """
    if params.window & (params.window - 1):
        raise ValueError("the window is a power of two")
    tokens = stored(tokenized(docs, tokenizer, params.end_id, id_column, text_column), "tokens")
    held, count, ids = document_frequencies(tokens, tokenizer)
    idf = np.log1p((count - held + 0.5) / (held + 0.5))
    average = ids / max(count, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(params, idf, average, TaskContext.get().partitionId() << 40)
        kind, block, held_ids = _kind(tokenizer), [], 0
        types: dict = {}

        def rows(all_of_them: bool) -> Iterator[pa.RecordBatch]:
            while packer.rows and (all_of_them or len(packer.rows) >= _ROWS):
                part, packer.rows = packer.rows[:_ROWS], packer.rows[_ROWS:]
                columns = list(zip(*part, strict=True))
                arrays = [pa.array(columns[0], types["id"]), *(pa.array(c, pa.int64()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            types["id"] = batch.schema.field("id").type
            for identifier, data in zip(batch.column("id").to_pylist(), batch.column("ids"), strict=True):
                own = np.frombuffer(data.as_buffer(), kind)
                whole = len(own) - len(own) % params.window
                for start in range(0, whole, params.window):
                    packer.close([(identifier, start, own[start : start + params.window], len(own))])
                    yield from rows(False)
                if whole < len(own):
                    block.append((identifier, len(own), whole, own.copy()))
                    held_ids += len(own)
                if len(block) >= params.shard_docs or held_ids >= params.shard_ids:
                    packer.block(block)
                    block, held_ids = [], 0
                    yield from rows(False)
        packer.block(block)
        packer.finish()
        if packer.rows:
            yield from rows(True)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    id_type = tokens.schema["id"].dataType.simpleString()
    dealt = tokens.repartitionByRange("signature", "id").sortWithinPartitions("signature", "id").select("id", "ids")
    longs = ", ".join(f"{c} bigint" for c in names[1:])
    return in_arrow(dealt, run, f"id {id_type}, {longs}")
