"""Output by day, compaction, ranges of folder topics, and where a second write goes on."""

import json
from datetime import date, datetime, timedelta

import pytest
from helpers import call, rows, write_in_order
from pyspark.sql import functions as F

from dispatchflow.plans import counts_plan
from dispatchflow.session import streaming_session, work_dir
from dispatchflow.sources import Topic, as_messages, topic_batch, topic_stream, write_topic
from dispatchflow.sources.topics import _held, kafka_read_options
from dispatchflow.streaming import compact, read_days, start_daily_counts
from dispatchflow.streaming.commits import CommitLog, Commits
from dispatchflow.streaming.daily import generations, write_day_batch

LIMIT = 120
DAYS = [date(2024, 1, d) for d in (1, 2, 3, 4)]


@pytest.fixture
def folder(spark):
    return work_dir(spark, "days")


@pytest.fixture
def topic(folder):
    return Topic("t", folder=f"{folder}/topics")


def run(spark, topic, folder):
    counts = counts_plan(topic_stream(streaming_session(spark), topic, max_files=1), parts=True)
    query = start_daily_counts(counts, f"{folder}/out", f"{folder}/checkpoint", "daily", trigger=None)
    assert query.awaitTermination(LIMIT)


def batches(first, last):
    return [
        [call("a", "X", datetime(2024, 1, day, hour, m)) for m in (3, 20, 44)] for day in range(first, last + 1) for hour in (1, 13)
    ]


def want(spark, topic, days):
    found = rows(counts_plan(topic_batch(spark, topic)))
    newest = datetime(2024, 1, max(d.day for d in DAYS), 13, 44) - timedelta(minutes=10)
    return [r for r in found if r[1][:10] in {str(d) for d in days} and r[2] <= str(newest)]


def opened(frame):
    return [r[0] for r in frame.select(F.input_file_name()).distinct().collect()]


def got(spark, folder, first=None, end=None):
    return rows(read_days(spark, f"{folder}/out", first, end).drop("day"))


def test_days_batches_and_compaction(spark, topic, folder):
    write_in_order(spark, topic, batches(1, 4))
    run(spark, topic, folder)
    assert got(spark, folder) == want(spark, topic, DAYS)
    before = [got(spark, folder, d, d + timedelta(days=1)) for d in DAYS]
    assert before == [want(spark, topic, [d]) for d in DAYS]
    old = read_days(spark, f"{folder}/out")  # a reader that began before

    assert compact(spark, f"{folder}/out", DAYS[2]) == 0
    assert compact(spark, f"{folder}/out", DAYS[1]) is None  # done already
    assert [got(spark, folder, d, d + timedelta(days=1)) for d in DAYS] == before
    assert compact(spark, f"{folder}/out", DAYS[3]) == 1
    assert got(spark, folder) == want(spark, topic, DAYS)
    assert rows(old.drop("day")) == want(spark, topic, DAYS)
    assert [(g.first, g.end) for g in generations(spark, f"{folder}/out")] == [(None, DAYS[2]), (DAYS[2], DAYS[3])]
    files = opened(read_days(spark, f"{folder}/out", DAYS[0], DAYS[1]))
    assert len(files) == 1 and "/run=compacted/batch_id=0/" in files[0]


def test_one_day_opens_the_folders_of_that_day(spark, topic, folder):
    write_in_order(spark, topic, batches(1, 4))
    run(spark, topic, folder)
    frame = read_days(spark, f"{folder}/out", DAYS[1], DAYS[2])
    assert opened(frame) and all(f"/day={DAYS[1]}/" in f for f in opened(frame))
    plan = frame._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(day" in plan.toString()
    frame.collect()
    files = int(plan.collectLeaves().apply(0).metrics().apply("numFiles").value())
    assert files <= len(frame.inputFiles()) / 2  # of all days


def test_a_batch_that_is_tried_again_replaces_itself(spark, folder):
    out = f"{folder}/out"
    spark.createDataFrame([("id",)], "value string").coalesce(1).write.text(f"{folder}/checkpoint/metadata")
    frame = spark.createDataFrame([(1, datetime(2024, 1, 1, 5)), (2, datetime(2024, 1, 2, 5)), (3, None)], "x int, at timestamp")
    commits = Commits(CommitLog.of(out), f"{folder}/checkpoint")
    for _ in range(2):  # a try without a commit, then the same batch with one
        commits.open(spark, 0)
        placed = {"day": F.col("at").cast("date"), "run": F.lit(commits.run), "batch_id": F.lit(0).cast("long")}
        write = frame.withColumns(placed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        write.partitionBy("day", "run", "batch_id").parquet(out)
        with pytest.raises(ValueError, match="committed yet"):
            read_days(spark, out)
    write_day_batch(frame, F.col("at"), commits, out, 0)
    assert sorted(r.x for r in read_days(spark, out).collect()) == [1, 2, 3]
    write_day_batch(frame.where("x = 1"), F.col("at"), commits, out, 1)
    assert sorted(r.x for r in read_days(spark, out).collect()) == [1, 1, 2, 3]
    compact(spark, out, date(2024, 1, 3))
    assert sorted(r.x for r in read_days(spark, out).collect()) == [1, 1, 2, 3]
    write_day_batch(frame.where("x <= 2"), F.col("at"), commits, out, 2)  # late, for days that are put together
    assert sorted(r.x for r in read_days(spark, out).collect()) == [1, 1, 1, 2, 2, 3]
    assert [r.x for r in read_days(spark, out, date(2024, 1, 2)).collect()] == [2, 2]


def messages(spark, count, parts):
    rows_ = spark.range(count, numPartitions=parts).selectExpr("cast(id as string) as payload")
    return as_messages(rows_, "t")


def places(frame):
    return sorted((r.partition, r.offset) for r in frame.collect())


def offsets(bounds):
    return json.dumps({"t": bounds})


def test_ranges_of_offsets(spark, topic):
    write_topic(messages(spark, 60, 3), topic)
    every = [(p, o) for p in range(3) for o in range(20)]
    assert places(topic_batch(spark, topic)) == every
    assert places(topic_batch(spark, topic, "earliest", "latest")) == every
    assert places(topic_batch(spark, topic, "latest")) == places(topic_batch(spark, topic, ending="earliest")) == []
    found = topic_batch(spark, topic, offsets({"0": 5, "1": -1}), offsets({"0": 7, "2": -2}))
    assert places(found) == [(0, 5), (0, 6)]
    found = topic_batch(spark, topic, offsets({"0": -2, "1": 18}), offsets({"0": 2, "2": 1, "1": -1}))
    assert places(found) == [(0, 0), (0, 1), (1, 18), (1, 19), (2, 0)]
    for wrong in ("newest", '{"other": {"0": 1}}', "[1]", '{"t": 5}'):
        with pytest.raises(ValueError, match="offsets of t"):
            topic_batch(spark, topic, wrong)


def test_ranges_of_times(spark, topic):
    moments = [datetime(2024, 1, 1, h) for h in range(10)]
    rows_ = [(None, bytearray(b"x"), "t", 0, i, at, 0) for i, at in enumerate(moments)]
    from dispatchflow.schemas import ENVELOPE

    write_topic(spark.createDataFrame(rows_, ENVELOPE).repartition(2), topic)
    found = topic_batch(spark, topic, since=moments[3], until=moments[5])
    assert [o for _, o in places(found)] == [3, 4]
    assert [o for _, o in places(topic_batch(spark, topic, since=moments[8]))] == [8, 9]
    with pytest.raises(ValueError, match="not at both"):
        topic_batch(spark, topic, starting="earliest", since=moments[0])


def test_a_range_reads_few_row_groups(spark, topic):
    write_topic(messages(spark, 40_000, 8), topic, max_records_per_file=1000)
    found = topic_batch(spark, topic, offsets({str(p): -1 for p in range(8) if p != 3}), offsets({"3": 1500}))
    found = found.where(F.col("offset") >= 1200)
    assert found.count() == 300
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    scan = plan.collectLeaves().apply(0)
    read = int(scan.metrics().apply("numOutputRows").value())
    assert 300 <= read <= 2000  # of 40,000: two of forty files


def test_a_write_reads_only_what_is_new(spark, topic):
    assert _held(spark, topic) is None
    for n in range(1, 4):
        write_topic(messages(spark, 30, 3), topic)
        assert places(topic_batch(spark, topic)) == [(p, o) for p in range(3) for o in range(10 * n)]
    kept = spark.read.json(f"{topic.path}/_offsets")
    assert sorted({r.slot for r in kept.select("slot").collect()}) == [0, 1]
    # Files changed long before the table was kept are not opened: a broken one does no harm.
    import os

    files = [f for f in os.listdir(topic.path) if f.endswith(".parquet")]
    old = min(files, key=lambda f: os.stat(f"{topic.path}/{f}").st_mtime_ns)
    with open(f"{topic.path}/{old}", "wb") as file:
        file.write(b"no parquet")
    os.utime(f"{topic.path}/{old}", (1_600_000_000, 1_600_000_000))
    found = {r["__partition"]: r["__next"] for r in _held(spark, topic).collect()}
    assert found == {0: 30, 1: 30, 2: 30}


def test_kafka_times(monkeypatch, spark):
    asked = {}

    class Reader:
        def format(self, kind):
            return self

        def options(self, **options):
            asked.update(options)
            return self

        def load(self):
            return None

    class Session:
        read = Reader()

    topic_batch(Session(), Topic("t", servers="a:1"), since=datetime.fromisoformat("2024-01-01T00:00:00+00:00"))
    assert asked["startingTimestamp"] == "1704067200000" and "startingOffsets" not in asked
    assert asked["endingOffsets"] == "latest" and kafka_read_options(Topic("t", servers="a:1"))["startingOffsets"] == "earliest"


