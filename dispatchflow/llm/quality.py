"""Quality rules: counts over the words of a text, and its divergence from what its language looks like.

A text's characters by class and its common words are two histograms. The reference of a language is the sum of
the histograms of all its documents, and documents without a language have one of their own. A document fails if the Jensen-Shannon distance (base 2, 0 to 1) of either
histogram to its language's reference is above a limit; texts too short to have a shape are not judged by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, in_pandas, plain_text, stored, with_hot_keys, without

# Frequent function words by language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er",
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from at which but have",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il ce sont avec être",
}
# Symbols counted one by one.
SYMBOLS = b"#*$%&|<>"
_SENTENCE = b".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "blank", "line", "sentence", "symbol", "control", "beyond ASCII")
_BREAKS = np.frombuffer(b" \t\n\v\f\r", np.uint8)
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _class_of() -> np.ndarray:
    table = np.full(256, 7)
    table[33:127] = 6
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[list(b" \t")] = 3
    table[list(b"\n\r\v\f")] = 4
    table[list(_SENTENCE)] = 5
    table[0xC0:] = 8
    table[0x80:0xC0] = 9  # inside a character
    return table


_CLASS_OF = _class_of()


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    Distances are judged from ``class_chars`` characters and ``common_words_from`` words on. Every language has a
    reference of character classes, and so have the documents without a language; common words are judged in
    the languages that have a list of them.
    """

    fewest_words: int = 10
    most_repeat_percent: int = 20
    class_chars: int = 200
    class_distance: float = 0.25
    common_words_from: int = 100
    common_distance: float = 0.29


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null has no words."""
    data = plain_text(text)
    return _base_counts(data, data.split(), np.bincount(np.frombuffer(data, np.uint8), minlength=256))


def _base_counts(data: bytes, words: list[bytes], octets: np.ndarray) -> tuple[int, int, int, int, int]:
    points = len(data) - int(octets[0x80:0xC0].sum())
    lines, seen = 0, set()
    for line in data.split(b"\n"):
        if line in seen:
            lines += 1
        elif line.split(None, 1):
            seen.add(line)
    return (
        len(words),
        points - int(octets[_BREAKS].sum()),
        int(octets[list(SYMBOLS)].sum()),
        lines,
        _repeat_words(words),
    )


def _repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = len(words) - width + 1
    if windows < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:windows]
    for step in range(1, width):  # pairs of (number of the window so far, next word), numbered anew
        _, key = np.unique(key * len(number) + ids[step : step + windows], return_inverse=True)
        if step > 1 and key.max() == windows - 1:
            return 0
    twice = np.flatnonzero(np.bincount(key)[key] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def _bins(common: dict[str, str]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(sorted({x.encode() for words in common.values() for x in words.split()}))}


def features(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    common: dict[str, str] | None = None,
) -> DataFrame:
    """id, language, content (hash of both), the base counts, ``classes`` and ``commons`` (histograms; the last of commons: other words)."""
    bins = _bins(common or COMMON_WORDS)
    source = docs.select(
        F.col(id_column).alias("id"),
        F.col(language_column).cast("string").alias("language"),
        F.col(text_column).alias("text"),
    ).withColumn("content", F.xxhash64("text", "language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, classes, commons = [], [], []
            for text in batch.column("text").to_pylist():
                data = plain_text(text)
                octets = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                words = data.split()
                counts.append(_base_counts(data, words, octets))
                classes.append(np.bincount(_CLASS_OF, weights=octets, minlength=10)[:9].astype(np.int64))
                found = Counter(filter(bins.__contains__, words))
                histogram = np.zeros(len(bins) + 1, np.int64)
                for word, n in found.items():
                    histogram[bins[word]] = n
                histogram[-1] = len(words) - sum(found.values())
                commons.append(histogram)
            arrays = [batch.column("id"), batch.column("language"), batch.column("content")]
            arrays += [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(_COLUMNS))]
            arrays += [pa.array(x, pa.list_(pa.int64())) for x in (classes, commons)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "language", "content", *_COLUMNS, "classes", "commons"])

    longs = ", ".join(f"{c} bigint" for c in _COLUMNS)
    id_type = source.schema["id"].dataType.simpleString()
    return in_arrow(
        source, run, f"id {id_type}, language string, content bigint, {longs}, classes array<bigint>, commons array<bigint>"
    )


def references(measured: DataFrame, common: dict[str, str]) -> DataFrame:
    """language, documents, class_reference, common_reference (null without a list of words): sums over all documents.

    A row for each language, and one for null. Sums are made where the rows lie before anything is shuffled.
    """

    def sums(column: str, bins: int):
        return F.array(*(F.sum(F.col(column)[i]) for i in range(bins)))

    return measured.groupBy("language").agg(
        F.count(F.lit(1)).alias("documents"),
        sums("classes", len(CLASSES)).alias("class_reference"),
        F.when(F.first("language").isin(sorted(common)), sums("commons", len(_bins(common)) + 1)).alias("common_reference"),
    )


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``counts`` to the reference, or its own; 0 where either has no counts."""
    sums = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(sums, 1)
    total = reference.sum(axis=-1, keepdims=True)
    q = np.broadcast_to(reference / np.maximum(total, 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    empty = (sums[:, 0] == 0) | (total[..., 0] == 0)
    return np.where(empty, 0.0, np.sqrt(np.clip((left + right) / 2, 0, 1)))


def judged(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    common: dict[str, str] | None = None,
) -> DataFrame:
    """A row for each row of ``docs``: id, content (hash of text and language), base counts, base_failed, class_distance, common_distance, kept.

    Null and empty texts have no words and fail. A distance is null where it is not judged: text too short, or, for
    common words, a language without a list. Repeated rows count in the references and come out as often as they go
    in. An empty table gives no rows. Other columns are not read.
    """
    own = common or COMMON_WORDS
    measured = stored(features(docs, id_column, text_column, language_column, own), "features")
    key = F.coalesce(F.concat(F.lit("="), "language"), F.lit("")).alias("key")  # null is a language too
    shapes = stored(references(measured, own).select(key, "documents", "class_reference", "common_reference"), "references")
    compared = with_hot_keys(measured.select("*", key), shapes, ["key"], "documents", measured.count())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            chars = frame["word_chars"].to_numpy()
            words = frame["n_words"].to_numpy()
            by_class = np.full(len(frame), np.nan)
            by_word = np.full(len(frame), np.nan)
            for out, side, reference, enough in (
                (by_class, "classes", "class_reference", chars >= rules.class_chars),
                (by_word, "commons", "common_reference", words >= rules.common_words_from),
            ):
                rows = np.flatnonzero(enough & frame[reference].notna().to_numpy())
                if len(rows):
                    counts, whole = (np.stack(frame[c].to_numpy()[rows]).astype(float) for c in (side, reference))
                    out[rows] = js_distance(counts, whole)
            failed = (words < rules.fewest_words) | (
                100 * frame["n_repeat_words"].to_numpy() > rules.most_repeat_percent * words
            )
            apart = (by_class > rules.class_distance) | (by_word > rules.common_distance)
            yield frame[["id", "content", *_COLUMNS]].assign(
                base_failed=failed, class_distance=by_class, common_distance=by_word, kept=~failed & ~apart
            )

    longs = ", ".join(f"{c} bigint" for c in _COLUMNS)
    id_type = measured.schema["id"].dataType.simpleString()
    result = in_pandas(
        compared,
        run,
        f"id {id_type}, content bigint, {longs}, base_failed boolean, class_distance double, common_distance double, kept boolean",
    )
    return result.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("class_distance", "common_distance")})


def keep_good(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` whose text passes all rules, with all their columns.

    Null and empty texts go. Repeated rows stay or go together. An empty table gives no rows.
    """
    verdicts = judged(docs, rules, id_column, text_column, language_column)
    bad = stored(verdicts.where("not kept").select("id", "content").distinct(), "bad")
    content = F.xxhash64(F.col(text_column), F.col(language_column).cast("string"))
    return without(docs, bad, {"id": F.col(id_column), "content": content})
