"""Ranked search against scores of every document, one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from small import SCHEMA, rows

from dispatchflow.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "alpha the x9"), (2, "BETA beta naïve w1 w2 w3"), (3, None), (4, ""), (5, "absent"), (2, "alpha the x9"), (6, "c7 one")]


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    number, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        hits = []
        for (id_, c), n in zip(counts, lengths, strict=True):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * number // total)))
            if score > 0:
                hits.append((-score, id_))
        found += [(item, id_, -s, r) for r, (s, id_) in enumerate(sorted(hits)[:k], 1)]
    return sorted(found)


def got(frame):
    assert frame.columns == ["item", "id", "score", "rank"]
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("shard, query_bytes", [(8192, 1 << 22), (7, 1 << 22), (5, 10)])
def test_as_every_document_scored(docs, items, shard, query_bytes):
    want = brute([r[:2] for r in rows()], ITEMS)
    assert len(want) > 30
    assert got(search.ranked(docs, items, shard=shard, query_bytes=query_bytes)) == want


def test_empty_tables(spark, docs, items):
    none = spark.createDataFrame([], SCHEMA)
    assert search.ranked(none, items).count() == 0
    assert search.ranked(docs, items.limit(0)).count() == 0
    assert search.ranked(none.select("doc_id", "text"), items.where("item_id = 3")).count() == 0


def test_null_id_loses_ties(spark, items):
    docs = spark.createDataFrame([(None, "alpha one"), (4, "alpha one"), (2, "alpha one")], "doc_id bigint, text string")
    found = search.ranked(docs, items.where("text = 'alpha the x9' and item_id = 1")).orderBy("rank").collect()
    assert [r.id for r in found] == [2, 4, None]


def test_windows_are_skipped_and_nothing_is_missed():
    """A shard of thousands with a few high documents: most windows go, and the best are those of a plain sum."""
    draw = random.Random(1)
    docs = [Counter(draw.choices(range(8), k=6)) for _ in range(4000)]
    for at in (1234, 3999):
        docs[at] = Counter({8: 9, **{t: 9 for t in range(8)}})
    table = pa.table(
        {
            "id": list(range(4000)),
            "n": [sum(d.values()) for d in docs],
            "terms": [np.array(sorted(d), "<u4").tobytes() for d in docs],
            "times": [np.array([d[t] for t in sorted(d)], "<u4").tobytes() for d in docs],
        }
    )
    index = search.Index(table, 4000, sum(sum(d.values()) for d in docs), 8, 75)
    length = sum(sum(d.values()) for d in docs)

    def score(d):
        norm = 25 + 75 * sum(d.values()) * 4000 // length
        return sum(7 * (10**9 * d[t] // (1000 * d[t] + 8 * norm)) for t in range(9) if d[t])

    best = []
    index.search([(t, 7) for t in range(9)], best, 2)
    assert best == sorted(((score(d), i) for i, d in enumerate(docs)), key=lambda x: (-x[0], x[1]))[:2]
    assert len(index.bounds) == 8  # the ninth list is short: it is summed, the others are read by window
