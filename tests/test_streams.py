import random
from datetime import timedelta

import pytest
from helpers import DAY, at, brute_counts, call, rows, with_batch, write_in_order
from pyspark.sql import functions as F

from dispatchflow.config import CountSpec
from dispatchflow.operators import distinct_events, enrich, parse_payload, tap_lines, window_counts
from dispatchflow.operators.events import call_events, drop_null_keys
from dispatchflow.plans import counts_plan, enriched_plan
from dispatchflow.schemas import schema
from dispatchflow.streaming.commits import CommitLog, Commits
from dispatchflow.session import state_partitions, streaming_session, work_dir
from dispatchflow.sources import Topic, topic_batch, topic_stream
from dispatchflow.streaming import (
    PROGRESS_ROW,
    ProgressLog,
    latest_progress,
    read_output,
    start_counts,
    start_counts_and_enriched,
    start_each,
    start_files,
    wait_for_any,
)

CODES = schema("disposition string, description string")
LIMIT = 120

# (type, code, time) by batch; a null code is dropped, (d,Q) stays open
LATE = [
    [("a", "X", "00:01"), ("a", "X", "00:01"), ("a", None, "00:02"), ("b", "Y", "00:12")],
    [("a", "X", "00:31")],
    [("a", "X", "00:02"), ("a", "X", "00:14"), ("c", "Z", "00:45")],
    [("a", "X", "00:14:30"), ("a", "X", "00:01"), ("c", "Z", "00:22"), ("d", "Q", "02:00")],
]
CLOSED = {
    2: ["a,X,00:00,2", "a,X,00:05,1", "a,X,00:10,1", "a,X,23:55,2", "b,Y,00:05,1", "b,Y,00:10,1"],
    3: ["a,X,00:25,1", "c,Z,00:15,1", "c,Z,00:20,1"],
    4: ["a,X,00:30,1", "c,Z,00:40,1", "c,Z,00:45,1"],
}


def codes_of(spark):
    return spark.createDataFrame([("X", "desc X"), ("Y", "desc Y")], CODES)


def messages(batches):
    return [[call(kind, code, at(clock)) for kind, code, clock in batch] for batch in batches]


def finish(query):
    assert query.awaitTermination(LIMIT)
    return query


@pytest.fixture
def topic(spark):
    return Topic("t", folder=work_dir(spark, "topics"))


@pytest.fixture
def folder(spark):
    return work_dir(spark, "run")


def test_late_rows(spark, topic, folder):
    write_in_order(spark, topic, messages(LATE))
    counts = counts_plan(topic_stream(streaming_session(spark), topic, max_files=1))
    query = finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
    assert with_batch(read_output(spark, f"{folder}/out")) == CLOSED
    progress = latest_progress(spark, query).orderBy("batch_id").collect()
    assert [p["num_input_rows"] for p in progress] == [4, 1, 3, 4, 0]
    marks = [p["watermark"].strftime("%H:%M") for p in progress]
    assert marks == ["00:00", "00:02", "00:21", "00:35", "01:50"]
    assert sum(p["rows_dropped"] for p in progress) > 0


def test_late_rows_at_a_resolution(spark, topic, folder):
    """The fixture's one time that is no whole minute, 00:14:30, comes too late to count anyway."""
    write_in_order(spark, topic, messages(LATE))
    stream = topic_stream(streaming_session(spark), topic, max_files=1)
    counts = counts_plan(stream, CountSpec(resolution="minute"))
    finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
    assert with_batch(read_output(spark, f"{folder}/out")) == CLOSED


def test_two_outputs_from_one_query(spark, topic, folder):
    write_in_order(spark, topic, messages(LATE))
    counts = counts_plan(topic_stream(streaming_session(spark), topic, max_files=1))
    finish(
        start_counts_and_enriched(
            counts, codes_of, f"{folder}/counts", f"{folder}/enriched", f"{folder}/checkpoint", trigger=None
        )
    )
    enriched = read_output(spark, f"{folder}/enriched")
    assert with_batch(read_output(spark, f"{folder}/counts")) == CLOSED
    assert with_batch(enriched) == CLOSED
    assert {(r["disposition"], r["description"]) for r in enriched.collect()} == {
        ("X", "desc X"),
        ("Y", "desc Y"),
        ("Z", None),
    }


@pytest.mark.parametrize("limit", [enrich.BROADCAST_ROWS, 0], ids=["broadcast", "shuffled"])
def test_join_inside_the_stream(spark, topic, folder, monkeypatch, limit):
    monkeypatch.setattr(enrich, "BROADCAST_ROWS", limit)
    write_in_order(spark, topic, messages(LATE))
    session = streaming_session(spark)
    enriched = enriched_plan(topic_stream(session, topic, max_files=1), codes_of(session))
    writer = enriched.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    finish(writer.trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start())
    found = spark.read.parquet(f"{folder}/out")
    assert found.count() == sum(len(lines) for lines in CLOSED.values())
    assert found.where("description is null").select("disposition").distinct().collect()[0][0] == "Z"


def test_restart_equals_one_run(spark, topic, folder):
    for number, batch in enumerate(messages(LATE)):
        write_in_order(spark, topic, [batch] if number == 0 else [[]] * number + [batch])
        counts = counts_plan(topic_stream(streaming_session(spark), topic))
        finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
    # Each run ends with a batch without input, so the watermark moves one batch sooner and the late
    # (a,X,00:02) and (c,Z,00:22) find their windows closed. All else is as in one run.
    found = sorted(",".join(line) for line in flat_lines(read_output(spark, f"{folder}/out")))
    assert found == sorted(
        ["a,X,23:55,1", "a,X,00:00,1", "b,Y,00:05,1", "b,Y,00:10,1", "a,X,00:25,1"]
        + ["a,X,00:30,1", "c,Z,00:40,1", "c,Z,00:45,1"]
    )


def flat_lines(frame):
    return [line.split(",") for lines in with_batch(frame).values() for line in lines]


def random_calls(seed, number):
    """Calls in the order of their time, a third of them the same type and code."""
    pick = random.Random(seed)
    made = []
    for _ in range(number):
        when = DAY + timedelta(seconds=pick.randrange(0, 8 * 3600, 30))
        hot = pick.random() < 0.4
        made.append(("hot", "H", when) if hot else (pick.choice("abc"), pick.choice(["X", "Y", None]), when))
    return sorted(made, key=lambda event: event[2])


def test_stream_equals_closed_part_of_batch(spark, topic, folder):
    events = random_calls(3, 4000)
    cuts = [0, 900, 1000, 2500, 4000]
    parts = [[call(*event) for event in events[a:b]] for a, b in zip(cuts, cuts[1:])]
    write_in_order(spark, topic, parts)
    counts = counts_plan(topic_stream(streaming_session(spark), topic, max_files=1))
    query = finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
    newest = max(when for kind, code, when in events if code is not None)
    wanted = [row for row in brute_counts(events) if row[2] <= str(newest - timedelta(minutes=10))]
    assert rows(read_output(spark, f"{folder}/out").drop("batch_id")) == wanted
    assert rows(counts_plan(topic_batch(spark, topic))) == brute_counts(events)
    # State holds open windows only, and the second aggregate keeps nothing from batch to batch.
    states = [[s.numRowsTotal for s in p.stateOperators] for p in query.recentProgress]
    assert all(last == 0 for last, _ in states)
    assert states[-1][1] < 150


def plainly(events):
    """Distinct before the watermark: the count as one would first write it."""
    window = F.window("call_date_time_ts", "10 minutes", "5 minutes")
    watermarked = events.distinct().withWatermark("call_date_time_ts", "10 minutes")
    return watermarked.groupBy("original_crime_type_name", window, "disposition").count()


def test_disorder_is_counted_as_the_plain_way_counts_it(spark, topic, folder):
    """Batches overlap in time by more than the delay, so some calls are late and some windows are not closed."""
    pick = random.Random(1)
    batches = []
    for number in range(5):
        spread = [number * 20 + pick.gauss(0, 12) for _ in range(40)]
        times = [DAY + timedelta(seconds=round(max(minutes, 0) * 60 / 30) * 30) for minutes in spread]
        batches.append([call(pick.choice("ab"), pick.choice(["X", "Y"]), when) for when in times])
    write_in_order(spark, topic, batches)

    def run(name, plan):
        records = parse_payload(topic_stream(streaming_session(spark), topic, max_files=1))
        counts = plan(call_events(drop_null_keys(records)))
        out = f"{folder}/{name}"
        query = finish(start_counts(counts, out, f"{out}-checkpoint", trigger=None))
        return with_batch(read_output(spark, out)), query

    wanted, query = run("plain", plainly)
    assert sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators) > 0
    assert run("chained", window_counts)[0] == wanted
    assert run("bits", lambda events: window_counts(events, CountSpec(resolution="second")))[0] == wanted


def test_unaltered_distinct_would_keep_its_state(spark, topic, folder):
    """What the chained aggregates are there to avoid: ``distinct`` before the watermark never forgets."""
    write_in_order(spark, topic, [[call(*e) for e in random_calls(3, 1000)]])
    session = streaming_session(spark)
    records = parse_payload(topic_stream(session, topic))
    plain = call_events(drop_null_keys(records)).distinct()
    naive = plain.withWatermark("call_date_time_ts", "10 minutes").groupBy("original_crime_type_name").count()
    writer = naive.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    query = finish(writer.trigger(availableNow=True).format("noop").start())
    assert max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators) > 500


def test_distinct_on_a_stream_is_bounded(spark, topic, folder):
    write_in_order(spark, topic, messages(LATE))
    records = parse_payload(topic_stream(streaming_session(spark), topic, max_files=1))
    events = distinct_events(call_events(drop_null_keys(records)))
    query = finish(start_files(events, f"{folder}/out", "distinct", f"{folder}/checkpoint", trigger=None))
    out = rows(read_output(spark, f"{folder}/out").drop("batch_id"))
    assert [row[:2] for row in out].count(("a", "X")) == len({row for row in out if row[:2] == ("a", "X")})
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 1


def test_batch_written_again_replaces_itself_and_no_other_run(spark, topic, folder):
    write_in_order(spark, topic, messages(LATE[:1]))
    stream = topic_stream(streaming_session(spark), topic)
    for attempt in ("first", "second"):
        # A new checkpoint begins with batch 0 again: its rows come beside those of the first.
        finish(start_files(stream, f"{folder}/out", attempt, f"{folder}/{attempt}", trigger=None))
    assert read_output(spark, f"{folder}/out").count() == 8
    commits = Commits(CommitLog.of(f"{folder}/out"), f"{folder}/first")
    assert not commits.open(spark, commits.last)  # a batch that is committed is not written again
    assert commits.last >= 0
    batch = topic_batch(spark, topic)
    for _ in range(2):  # a batch that is tried twice, and then committed
        batch.write.mode("overwrite").parquet(commits.place(f"{folder}/out", commits.last + 1))
        assert read_output(spark, f"{folder}/out").count() == 8
    commits.done(spark, commits.last + 1, {f"{folder}/out": batch.schema})
    assert read_output(spark, f"{folder}/out").count() == 12


def test_small_partitions_are_written_as_few_files(spark, topic, folder):
    write_in_order(spark, topic, messages(LATE))
    counts = counts_plan(topic_stream(streaming_session(spark), topic, max_files=1))
    finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
    written = spark.read.parquet(f"{folder}/out/run=*/batch_id=2").inputFiles()
    assert len(written) == 1


def test_repeated_code_ends_the_query(spark, topic, folder):
    write_in_order(spark, topic, messages(LATE))

    def twice(session):
        return codes_of(session).union(codes_of(session))

    query = start_counts_and_enriched(
        counts_plan(topic_stream(streaming_session(spark), topic, max_files=1)),
        twice,
        f"{folder}/counts",
        f"{folder}/enriched",
        f"{folder}/checkpoint",
        trigger=None,
    )
    with pytest.raises(Exception, match="repeat a disposition"):
        query.awaitTermination(LIMIT)


def test_any_failure_ends_the_wait(spark, topic, folder):
    write_in_order(spark, topic, messages(LATE[:1]))
    session = streaming_session(spark)

    def fail(batch, batch_id):
        raise RuntimeError("sink is gone")

    session.streams.resetTerminated()
    start_each(topic_stream(session, topic), fail, "failing", f"{folder}/checkpoint")
    with pytest.raises(Exception, match="sink is gone"):
        wait_for_any(session)
    session.streams.resetTerminated()


def test_messages_are_handed_to_a_function(spark, topic, folder):
    write_in_order(spark, topic, [["{}", "[]"], ["1"]])
    seen = []

    def handle(batch, batch_id):
        seen.append((batch_id, sorted(r["line"] for r in batch.collect())))

    lines = tap_lines(topic_stream(streaming_session(spark), topic, max_files=1))
    finish(start_each(lines, handle, "tap", f"{folder}/checkpoint", trigger=None))
    assert seen == [(0, ["t:0:0: key=null value={}", "t:0:1: key=null value=[]"]), (1, ["t:0:2: key=null value=1"])]


def test_rate_limit_takes_files_in_order(spark, topic, folder):
    write_in_order(spark, topic, [["{}"] * n for n in (5, 1, 7, 2, 3)])
    stream = topic_stream(streaming_session(spark), topic, max_files=2)
    finish(start_files(stream, f"{folder}/out", "limited", f"{folder}/checkpoint", trigger=None))
    sizes = read_output(spark, f"{folder}/out").groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [tuple(r) for r in sizes] == [(0, 6), (1, 9), (2, 3)]


def test_rate_limit_by_bytes(spark, topic, folder):
    write_in_order(spark, topic, [["{}"] * 5] * 3)
    stream = topic_stream(streaming_session(spark), topic, max_bytes=1000)
    finish(start_files(stream, f"{folder}/out", "limited", f"{folder}/checkpoint", trigger=None))
    assert read_output(spark, f"{folder}/out").groupBy("batch_id").count().count() == 3


def test_progress_log(spark, topic, folder):
    write_in_order(spark, topic, messages(LATE))
    session = streaming_session(spark)
    log = ProgressLog(session, f"{folder}/progress", every=2)
    session.streams.addListener(log)
    try:
        counts = counts_plan(topic_stream(session, topic, max_files=1))
        query = finish(start_counts(counts, f"{folder}/out", f"{folder}/checkpoint", trigger=None))
        log.close()
    finally:
        session.streams.removeListener(log)
    kept = spark.read.parquet(f"{folder}/progress").orderBy("batch_id")
    assert kept.schema == PROGRESS_ROW
    columns = ["query", "batch_id", "num_input_rows", "watermark", "state_rows", "rows_dropped"]
    shown = latest_progress(spark, query).orderBy("batch_id")
    assert kept.select(columns).collect() == shown.select(columns).collect()


def test_state_partitions(spark):
    session = streaming_session(spark, 3)
    assert session.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
    assert state_partitions(spark) == 2
    session.conf.set("spark.sql.shuffle.partitions", "200")
    assert state_partitions(session) == 200


def test_work_dir_is_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "x").startswith(f"{shared}/x-")
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_stream_and_batch_share_their_columns(spark, topic):
    write_in_order(spark, topic, messages(LATE[:1]))
    stream = counts_plan(topic_stream(spark, topic))
    assert stream.isStreaming
    batch = counts_plan(topic_batch(spark, topic))
    assert stream.schema.simpleString() == batch.schema.simpleString()


def test_every_report_of_many_batches_is_kept(spark, topic, folder):
    write_in_order(spark, topic, [["{}"]] * 104)
    session = streaming_session(spark, 1)
    log = ProgressLog(session, f"{folder}/progress")
    session.streams.addListener(log)
    try:
        stream = topic_stream(session, topic, max_files=1)
        finish(start_each(stream, lambda batch, batch_id: batch.count(), "many", f"{folder}/checkpoint", trigger=None))
        log.close()
    finally:
        session.streams.removeListener(log)
    kept = spark.read.parquet(f"{folder}/progress").where("num_input_rows > 0")
    assert kept.selectExpr("sum(num_input_rows)", "count(distinct end_offset)").first()[:] == (104, 104)


def test_unended_queries_fail_the_close(spark, folder):
    log = ProgressLog(spark, f"{folder}/progress")
    log.onQueryStarted(None)
    with pytest.raises(TimeoutError):
        log.close(0.1)
