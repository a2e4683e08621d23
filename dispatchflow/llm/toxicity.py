"""Toxicity by maximum-scoring segments of word log-odds.

Training takes a bounded sample of labelled rows. A token is a word or the beginning of one. Its score is its
log-odds between toxic and other documents under a Dirichlet prior that follows the tokens of both, lowered by
some standard errors. A word has the highest score of its tokens; words without one cost a little. Every maximal segment of a text is found in one pass over its words (Ruzzo and Tompa). Extreme-value
statistics of such segments (Karlin and Altschul) say how rare a segment is in a clean text of that length; the
excess of the best and of all significant segments goes through a logistic curve to give the score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, plain_text, stored

# Beginnings of words, in bytes, that are tokens too. A star marks them.
PREFIXES = (4, 5, 6)
_MEMORY = 200_000
_SPLIT = bytes(32 if chr(i) in ".,;:!?\"()[]{}|*%$#&<>=/\\~^+_" else i for i in range(256))


@dataclass(frozen=True)
class ToxicityParams:
    """``sample_rows`` bounds the labelled rows a model is fitted on, ``model_words`` the words it keeps."""

    sample_rows: int = 20_000
    model_words: int = 20_000
    fewest_documents: int = 3
    prior_share: float = 0.1
    errors: float = 2.0
    step: float = -0.05
    significant: float = 0.0


@dataclass(frozen=True)
class ToxicityModel:
    """Token scores, the Karlin-Altschul parameters of clean texts, and the weights of the logistic curve."""

    scores: dict[bytes, float]
    step: float
    decay: float
    scale: float
    significant: float
    weights: tuple[float, float, float]


def words_of(text: str | None) -> list[bytes]:
    return plain_text(text).lower().translate(_SPLIT).split()


def tokens_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


class WordScores(dict):
    """Scores of words as they are met, from scores of tokens; None for a word without. Forgets when full."""

    def __init__(self, tokens: dict[bytes, float]):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, word: bytes) -> float | None:
        if len(self) >= _MEMORY:
            self.clear()
        found = [self.tokens[t] for t in tokens_of(word) if t in self.tokens]
        self[word] = value = max(found, default=None)
        return value

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        return [(i, x) for i, x in enumerate(map(self.__getitem__, words)) if x is not None]


def segments(hits: list[tuple[int, float]], step: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), in linear time.

    ``hits`` are (place, score) of the scored words; each word between two hits scores ``step``.
    """
    found: list[list] = []  # first, last, sum before, sum up to its end
    total, before = 0.0, -1
    for place, score in hits:
        total += step * (place - before - 1)
        before = place
        left, total = total, total + score
        if score <= 0:
            continue
        now = [place, place, left, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def passages(words: list[bytes], model: ToxicityModel, memory: WordScores) -> list[tuple[int, int, float]]:
    """(first word, last word, excess over what a clean text of this length reaches) of significant segments."""
    hits = memory.hits(words)
    if not hits:
        return []
    expected = math.log(max(model.scale * len(words), 1e-9))
    rated = ((a, b, model.decay * score - expected) for a, b, score in segments(hits, model.step))
    return [x for x in rated if x[2] > model.significant]


def _rated(found: list[tuple[int, int, float]]) -> tuple[float, float]:
    """The best excess, and the sum of the others on a log scale."""
    if not found:
        return 0.0, 0.0
    excess = [x[2] for x in found]
    return max(excess), math.log1p(sum(excess) - max(excess))


def score(found: list[tuple[int, int, float]], model: ToxicityModel) -> float:
    """0 to 1 from the significant passages of a text."""
    best, more = _rated(found)
    x = model.weights[0] + model.weights[1] * best + model.weights[2] * more
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _decay(scores: np.ndarray, share: np.ndarray, step: float) -> float:
    """The positive root of sum(share * exp(x * score)) = 1 over a clean text's words."""

    def excess(x: float) -> float:
        return float((share * np.expm1(x * scores)).sum() + (1 - share.sum()) * math.expm1(x * step))

    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(low, 0.05)


def _logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-3) -> tuple[float, float, float]:
    """Weights of a logistic curve by Newton's method; the base rate where there is one label only."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(3)
    ridge = penalty * np.diag([0.01, 1, 1]) * max(len(x), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3), x.T @ (labels - p) - ridge @ w
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _sampled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """id, text, label of at most ``rows`` labelled rows, the ones with the smallest hash of their id."""
    one = labels.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = one.orderBy(F.xxhash64(F.col("id")), "id").limit(rows)
    known = F.broadcast(chosen.withColumnRenamed("id", "__id"))
    return docs.join(known, docs["id"] == F.col("__id")).select("id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """A model from docs (id, text) and labels (id, label 0 or 1).

    Equal texts of one label count once. Without rows of both labels no word has a score, and every text gets the
    share of toxic rows.
    """
    sample = stored(_sampled(docs, labels, params.sample_rows).dropDuplicates(["text", "label"]), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen[label].update({t for w in set(words_of(text)) for t in tokens_of(w)})
        for label, words in enumerate(seen):
            pairs = list(words.items())
            for start in range(0, len(pairs), 50_000):
                part = pairs[start : start + 50_000]
                counts = pa.array([n for _, n in part], pa.int64())
                none = pa.array([0] * len(part), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in part], pa.binary()), *((none, counts) if label else (counts, none))],
                    names=["word", "clean", "toxic"],
                )

    counted = in_arrow(sample.select("text", F.col("label").cast("int").alias("label")), count, "word binary, clean bigint, toxic bigint")
    counted = stored(counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words")
    sums = counted.agg(F.sum("clean"), F.sum("toxic")).first()
    clean, toxic = (float(x or 0) for x in sums)
    scores: dict[bytes, float] = {}
    share = np.zeros(0)
    if clean and toxic:
        prior = params.prior_share * toxic
        mass = (F.col("clean") + F.col("toxic")) * (prior / (clean + toxic))
        t, c = F.col("toxic") + mass, F.col("clean") + mass
        odds = F.log(t / (toxic + prior - t)) - F.log(c / (clean + prior - c))
        error = F.sqrt(1 / t + 1 / c)
        rated = counted.where(F.col("toxic") >= params.fewest_documents).select(
            "word", "clean", (odds - params.errors * error).alias("score"), (odds / error).alias("z")
        )
        rows = rated.where("score > 0").orderBy(F.desc("z"), "word").limit(params.model_words).collect()
        scores = {bytes(r["word"]): r["score"] for r in rows}
        share = np.array([r["clean"] for r in rows]) / clean
    decay = _decay(np.array(list(scores.values())), share, params.step) if scores else 1.0
    raw = ToxicityModel(scores, params.step, decay, 1.0, -math.inf, (0.0, 0.0, 0.0))
    measured = _measured(sample, raw)
    ordinary = measured[measured[:, 0] == 0]
    # Documents counted above x: scale * length * exp(-decay * x), read off where clean texts still have segments.
    scale = 1e-3
    if len(ordinary):
        tops = np.sort(ordinary[:, 2])[::-1]
        at = tops[min(len(tops) - 1, max(10, len(tops) // 100))]
        at = at if at > 0 else 1.0
        scale = max((ordinary[:, 2] >= at).sum(), 1) / max((ordinary[:, 1] * math.exp(-decay * at)).sum(), 1e-9)
    model = ToxicityModel(scores, params.step, decay, float(scale), params.significant, (0.0, 0.0, 0.0))
    rated = _measured(sample, model)
    labels_of = rated[:, 0] if len(rated) else np.zeros(1)
    features = rated[:, 2:4] if len(rated) else np.zeros((1, 2))
    return ToxicityModel(
        scores, params.step, decay, float(scale), params.significant, _logistic(features, labels_of)
    )


def _measured(sample: DataFrame, model: ToxicityModel) -> np.ndarray:
    """label, words, best, more of each row of the bounded sample; with no scale yet, best is the highest score."""
    plain = model.significant == -math.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordScores(model.scores)
        for batch in batches:
            rows = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = words_of(text)
                if plain:
                    found = segments(memory.hits(words), model.step)
                    best, more = max((s for _, _, s in found), default=0.0), 0.0
                else:
                    best, more = _rated(passages(words, model, memory))
                rows.append((float(label), float(len(words)), best, more))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * 4,
                names=["label", "words", "best", "more"],
            )

    found = in_arrow(sample.select("text", F.col("label").cast("int").alias("label")), run, "label double, words double, best double, more double")
    return np.array([tuple(r) for r in found.collect()], dtype=float).reshape(-1, 4)


def held_out(identifier) -> bool:
    return zlib.crc32(str(identifier).encode()) % 5 == 0


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    params: ToxicityParams = ToxicityParams(),
) -> DataFrame:
    """A row for each row of ``docs``: id, held_out, score, predicted, n_passages, passages.

    ``passages`` has first and last word and excess of every significant segment. Rows with crc32(id as text) mod 5
    of 0 are held out: their labels are not read. Null and empty texts get the score of a text without segments.
    Repeated rows come out as often as they go in; a null id is not held out and has no label. Empty tables give
    no rows, and without labels every score is a half. Other columns are not read.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    apart = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    model = train(texts, known.where(~apart), params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordScores(model.scores)
        for batch in batches:
            scores, found = [], []
            for text in batch.column("text").to_pylist():
                own = passages(words_of(text), model, memory)
                found.append([{"first": a, "last": b, "excess": x} for a, b, x in own])
                scores.append(score(own, model))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("excess", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(found, kind)],
                names=["id", "held_out", "score", "passages"],
            )

    id_type = texts.schema["id"].dataType.simpleString()
    scored = in_arrow(
        texts.withColumn("held_out", apart),
        run,
        f"id {id_type}, held_out boolean, score double, "
        "passages array<struct<first: bigint, last: bigint, excess: double>>",
    )
    return scored.select(
        "id",
        "held_out",
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
        "passages",
    )
