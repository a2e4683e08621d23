"""Importance resampling against counts of every text, one by one."""

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from small import SCHEMA, rows

from dispatchflow.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = [(1, "alpha the x9\nalpha the"), (2, "w1 w2 naïve"), (3, None), (4, "")]


def features(text, n, buckets):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), [crc32(g.encode()) % buckets for g in grams]


def brute(docs, target, n=1, buckets=10_000, min_words=20, percent=10):
    made = [(id_, *features(t, n, buckets)) for id_, t in docs]
    s = Counter(b for *_, f in made for b in f)
    t = Counter(b for _, text in target for b in features(text, n, buckets)[1])
    held, aimed = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * held / ((s[b] + 1) * aimed))) for b in s}
    found = []
    for id_, words, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"2024:{id_}".encode()).hexdigest()[:8], 16)
        found.append((id_, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    able = sorted((r for r in found if r[4] >= min_words), key=lambda r: (-r[3], r[0]))
    drawn = able[: percent * len(able) // 100]
    ranks = Counter()
    out = []
    for row in found:
        places = [i for i, r in enumerate(drawn, 1) if r is row]
        out.append((*row[:4], places[0] if places else None))
    return sorted(out, key=str)


def got(frame):
    assert frame.columns == ["id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGET, "item_id bigint, text string")


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 50), (2, 997, 40), (3, 50, 100)])
def test_as_every_text_counted(docs, target, n, buckets, percent):
    found = got(resampling.resampled(docs, target, n=n, buckets=buckets, percent=percent))
    want = brute([r[:2] for r in rows()], TARGET, n, buckets, percent=percent)
    # Of a repeated row either one may come first.
    assert found == want


def test_runs_over_the_ends_of_lines():
    text = b"a b\nc\n\n d e f\ng"
    words = text.split()
    for n in (1, 2, 3, 4):
        lines = text.split(b"\n")
        inside = [f for line in lines for f in resampling.line_features(line, n, 10**6)[1]]
        whole = [crc32(b" ".join(words[i : i + k])) % 10**6 for k in range(1, n + 1) for i in range(len(words) - k + 1)]
        assert Counter(inside + resampling.crossing_features(lines, n, 10**6)) == Counter(whole)


def test_a_line_of_many_documents_is_one_row(docs):
    lines, held = resampling.counted(docs, "doc_id", "text", 1, 100)
    cut = [line for r in rows() for line in (r[1] or "").split("\n") if WORD.search(line.lower())]
    assert lines.count() == len(set(cut))
    assert sorted(r.occurrences for r in lines.collect()) == sorted(Counter(cut).values())
    assert held.count() == len(rows())


def test_empty_tables(spark, docs, target):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resampled(none, target).count() == 0
    assert got(resampling.resampled(docs, target.limit(0), percent=50)) == brute([r[:2] for r in rows()], [], percent=50)


def test_ties_go_by_id(spark, target):
    words = " ".join(["same"] * 30)
    docs = spark.createDataFrame([(i, words) for i in (5, 5, 3, 9)] + [(None, words)], "doc_id bigint, text string")
    found = resampling.resampled(docs, target, percent=100).collect()
    assert sorted(r.rank for r in found) == [1, 2, 3, 4, 5]
    by_rank = sorted(found, key=lambda r: r.rank)
    assert [r.score for r in by_rank] == sorted((r.score for r in found), reverse=True)
