"""What readers of a stream's outputs see, what its state holds, and how it stops."""

import time

import pytest
from helpers import EVENT, at, brute_counts, call, rows, write_in_order
from pyspark.sql import functions as F

from dispatchflow.config import CALLS, CountSpec
from dispatchflow.operators import add_parts, window_counts, with_descriptions
from dispatchflow.plans import counts_plan
from dispatchflow.schemas import schema
from dispatchflow.session import streaming_session, work_dir
from dispatchflow.sources import Topic, topic_batch, topic_stream
from dispatchflow.streaming import (
    open_windows,
    read_output,
    read_together,
    start_counts,
    start_counts_and_enriched,
    start_files,
    stop_between_batches,
)
from dispatchflow.streaming.commits import CommitLog, Commits

LIMIT = 120
CODES = schema("disposition string, description string")
BATCHES = [
    [call("a", "X", at("00:01")), call("a", "X", at("00:01")), call("b", "Y", at("00:12"))],
    [call("a", "X", at("00:31")), call("a", "Z", at("00:32"))],
    [call("c", "Z", at("00:45"))],
    [call("d", "Q", at("02:00"))],
]


@pytest.fixture
def folder(spark):
    return work_dir(spark, "outputs")


@pytest.fixture
def topic(folder):
    return Topic("t", folder=f"{folder}/topics")


def codes(session):
    return session.createDataFrame([("X", "desc X"), ("Y", "desc Y")], CODES)


def messages(spark, topic, **limits):
    return topic_stream(streaming_session(spark), topic, **(limits or {"max_files": 1}))


def finish(query):
    assert query.awaitTermination(LIMIT)
    return query


def both(spark, topic, folder, codes=codes, parts=True, how="left"):
    return start_counts_and_enriched(
        counts_plan(messages(spark, topic), parts=parts), codes, f"{folder}/counts", f"{folder}/enriched",
        f"{folder}/checkpoint", trigger=None, how=how,
    )


def test_a_batch_is_seen_in_both_outputs_or_in_none(spark, topic, folder):
    write_in_order(spark, topic, BATCHES)
    tries = []

    def failing(session):
        tries.append(1)
        if len(tries) == 3:
            raise ConnectionError("no codes")
        return codes(session)

    query = both(spark, topic, folder, failing)
    with pytest.raises(Exception, match="no codes"):
        query.awaitTermination(LIMIT)
    seen = read_together(spark, f"{folder}/counts", f"{folder}/enriched")
    assert [f.count() for f in seen] == [0, 0]
    assert spark.read.parquet(f"{folder}/counts").count() > 0  # written, and not to be seen
    before = [rows(f) for f in seen]
    finish(both(spark, topic, folder))
    assert [rows(f) for f in seen] == before  # a frame stays what it was
    counts, enriched = read_together(spark, f"{folder}/counts", f"{folder}/enriched")
    assert rows(enriched.select(*counts.columns)) == rows(counts)
    want = [row for row in rows(counts_plan(topic_batch(spark, topic))) if row[2] <= "2024-01-01 01:50:00"]
    assert rows(counts.drop("batch_id")) == want


def test_a_committed_batch_is_not_written_again(spark, topic, folder):
    """The query ends after the commit and before its checkpoint knows: the batch comes again, its files stay."""
    write_in_order(spark, topic, BATCHES[:1])
    finish(start_files(messages(spark, topic), f"{folder}/out", "q", f"{folder}/checkpoint", trigger=None))
    files = sorted(read_output(spark, f"{folder}/out").inputFiles())
    commits = Commits(CommitLog.of(f"{folder}/out"), f"{folder}/checkpoint")
    assert not commits.open(spark, 0) and commits.open(spark, commits.last + 1)
    assert sorted(read_output(spark, f"{folder}/out").inputFiles()) == files


def test_the_log_does_not_grow_with_batches(spark, folder):
    frame = spark.range(3)
    log = CommitLog.of(f"{folder}/out")
    for batch in range(5):
        log.commit(spark, "r", batch, {f"{folder}/out": frame.schema})
        assert log.last(spark, "r") == batch
    assert log.manifests(spark).count() == 2
    assert log.last(spark, "other") == -1


def test_only_committed_folders_are_read(spark, topic, folder):
    write_in_order(spark, topic, BATCHES)
    finish(start_files(messages(spark, topic), f"{folder}/out", "q", f"{folder}/checkpoint", trigger=None))
    frame = read_output(spark, f"{folder}/out")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "batch_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError, match="different queries"):
        finish(start_files(messages(spark, topic), f"{folder}/two", "q2", f"{folder}/checkpoint2", trigger=None))
        read_together(spark, f"{folder}/out", f"{folder}/two")
    with pytest.raises(ValueError, match="committed yet"):
        read_output(spark, f"{folder}/nothing")
    with pytest.raises(ValueError, match="another commit log"):
        CommitLog.of(f"{folder}/out").note(spark, f"{folder}/two")


@pytest.mark.parametrize("resolution, parts", [(None, False), (None, True), ("minute", False), ("second", False)])
def test_open_windows_are_what_is_not_closed(spark, topic, folder, resolution, parts):
    write_in_order(spark, topic, BATCHES)
    spec = CountSpec(resolution=resolution)
    query = start_counts(counts_plan(messages(spark, topic), spec, parts), f"{folder}/out", f"{folder}/cp", trigger=None)
    finish(query)
    closed = rows(read_output(spark, f"{folder}/out").drop("batch_id"))
    held = rows(open_windows(spark, f"{folder}/cp", spec))
    assert {row[0] for row in held} == {"d"}
    assert sorted(closed + held) == rows(counts_plan(topic_batch(spark, topic), spec))


def test_parts_need_one_state_operator_and_no_large_row(spark, topic, folder):
    """A group of hundreds of times, to the microsecond: one operator, a whole number in each row of its state."""
    times = [at("00:03").replace(microsecond=i * 1000 + i % 3) for i in range(400)]
    write_in_order(spark, topic, [[call("a", "X", t) for t in times], [call("a", "X", times[5]), call("d", "Q", at("02:00"))]])
    counts = counts_plan(messages(spark, topic), parts=True)
    query = finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
    assert {len(p.stateOperators) for p in query.recentProgress} == {1}
    out = [row for row in rows(read_output(spark, f"{folder}/out").drop("batch_id")) if row[0] == "a"]
    assert [row[4] for row in out] == ["400", "400"]
    state = spark.read.format("statestore").option("batchId", 0).load(f"{folder}/checkpoint")
    assert state.schema["value"].dataType.simpleString() == "struct<bit_or:bigint>"
    assert state.count() == 2 * len({(t.second * 10**6 + t.microsecond) >> 6 for t in times})


def test_wide_windows_from_panes(spark):
    import random

    draw = random.Random(8)
    events = [
        (draw.choice("ab"), draw.choice("XYZ"), at("00:00") + draw.random() * (at("05:00") - at("00:00"))) for _ in range(300)
    ]
    events += [("a", "X", at("00:05")), ("a", "X", at("00:05")), ("a", "X", at("01:00")), ("b", "Z", None)]
    frame = spark.createDataFrame(events, EVENT).repartition(3)
    for window, slide in ((60, 5), (20, 5), (60, 60), (15, 10)):
        spec = CountSpec(window=f"{window} minutes", slide=f"{slide} minutes")
        assert rows(window_counts(frame, spec)) == brute_counts(events, window, slide)
    minutes = [(k, c, t and t.replace(second=0, microsecond=0)) for k, c, t in events]
    spec = CountSpec(window="60 minutes", resolution="minute")
    cut = spark.createDataFrame(minutes, EVENT)
    assert rows(window_counts(cut, spec)) == brute_counts(minutes, 60, 5)
    plan = window_counts(frame, CountSpec(window="60 minutes"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # events are not copied into windows
    assert CountSpec(window="15 minutes", slide="10 minutes").panes is None


@pytest.mark.parametrize("how, types", [("inner", "ab"), ("left_semi", "ab"), ("left_anti", "ac"), ("left", "abc")])
def test_kinds_of_joins_on_a_stream(spark, topic, folder, how, types):
    write_in_order(spark, topic, BATCHES)
    finish(both(spark, topic, folder, how=how))
    out = read_output(spark, f"{folder}/enriched")
    assert {row.original_crime_type_name for row in out.collect()} == set(types)
    assert ("description" in out.columns) == (how in ("inner", "left"))
    if how == "left_anti":
        assert {row.disposition for row in out.collect()} == {"Z"}


@pytest.mark.parametrize("how", ["right", "full", "cross"])
def test_joins_that_a_stream_cannot_have_are_refused_before_it_starts(spark, topic, folder, how):
    write_in_order(spark, topic, BATCHES[:1])
    before = len(spark.streams.active)
    with pytest.raises(ValueError, match=how):
        both(spark, topic, folder, how=how)
    assert len(spark.streams.active) == before


def test_right_and_full_joins_in_batch(spark, topic):
    write_in_order(spark, topic, BATCHES)
    counts = counts_plan(topic_batch(spark, topic))
    more = codes(spark).union(spark.createDataFrame([("UNUSED", "never")], CODES))
    full = with_descriptions(counts, more, how="full")
    assert full.where("disposition = 'UNUSED' and count is null").count() == 1
    assert full.where("description is null").count() == counts.where("disposition in ('Z', 'Q')").count()
    right = with_descriptions(counts, more, how="right")
    assert right.count() == counts.where("disposition in ('X', 'Y')").count() + 1


def test_add_parts_leaves_whole_counts_alone(spark):
    frame = spark.createDataFrame([("a", 2), ("a", 3)], "k string, count bigint")
    assert add_parts(frame) is frame
    parts = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 1)], "k string, part bigint, count bigint")
    assert rows(add_parts(parts)) == [("a", "5"), ("b", "1")]


def test_a_busy_query_stops_between_batches_and_goes_on(spark, topic, folder):
    write_in_order(spark, topic, [[call("a", "X", at(f"{h:02}:{m:02}"))] for h in range(2) for m in (0, 20, 40)])

    def start():
        counts = counts_plan(messages(spark, topic), parts=True)
        return start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger="0 seconds")

    first = start()
    while not first.recentProgress and first.isActive:
        time.sleep(0.02)
    stop_between_batches(first)
    done = [p.batchId for p in first.recentProgress if p.numInputRows]
    assert not first.isActive and 1 <= len(done) < 6
    second = start()
    second.processAllAvailable()
    stop_between_batches(second)
    assert [p.batchId for p in second.recentProgress if p.numInputRows][0] == done[-1] + 1
    want = [row for row in rows(counts_plan(topic_batch(spark, topic))) if row[2] <= "2024-01-01 01:30:00"]
    assert rows(read_output(spark, f"{folder}/out").drop("batch_id")) == want


def test_a_failure_is_raised_by_the_stop(spark, topic, folder):
    write_in_order(spark, topic, BATCHES[:2])

    def failing(session):
        raise ConnectionError("no codes")

    query = both(spark, topic, folder, failing)
    with pytest.raises(Exception, match="no codes"):
        query.awaitTermination(LIMIT)
    with pytest.raises(Exception, match="no codes"):
        stop_between_batches(query)
