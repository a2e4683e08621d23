import random
from datetime import timedelta

import pytest
from helpers import DAY, EVENT, at, brute_counts, call, envelope, rows
from pyspark.sql import functions as F

from dispatchflow.config import CountSpec
from dispatchflow.operators import check_codes, enrich, flatten_window, window_counts, with_descriptions
from dispatchflow.operators.events import call_events, drop_null_keys
from dispatchflow.plans import counts_plan, enriched_plan
from dispatchflow.schemas import schema

CODES = schema("disposition string, description string")


def starts(spark, when):
    events = spark.createDataFrame([("a", "X", when)], EVENT)
    counts = flatten_window(window_counts(events))
    return sorted(r[0] for r in counts.select(F.date_format("window_start", "HH:mm")).collect())


def test_windows_of_a_time(spark):
    assert starts(spark, at("00:03")) == ["00:00", "23:55"]
    assert starts(spark, at("00:05")) == ["00:00", "00:05"]
    assert starts(spark, None) == []


def some_events(seed, number=3000):
    """Random events, half of them of one type and code, a third of them the very same call."""
    pick = random.Random(seed)
    made = []
    for _ in range(number):
        draw = pick.random()
        when = DAY + timedelta(seconds=pick.randrange(0, 7200, 20))
        if draw < 0.33:
            made.append(("hot", "H", at("00:30")))
        elif draw < 0.5:
            made.append(("hot", "H", when))
        else:
            made.append((pick.choice(["a", "b", "", None]), pick.choice(["X", "Y", None]), when))
    return made


@pytest.mark.parametrize("window, slide", [(10, 5), (10, 10), (60, 30), (10, 4)])
def test_counts_equal_brute_force(spark, window, slide):
    events = some_events(window + slide)
    frame = spark.createDataFrame(events, EVENT).repartition(5).na.drop(subset=["original_crime_type_name", "disposition"])
    spec = CountSpec(window=f"{window} minutes", slide=f"{slide} minutes")
    assert rows(window_counts(frame, spec)) == brute_counts(events, window, slide)


@pytest.mark.parametrize("resolution, window, slide", [("minute", 10, 5), ("second", 10, 5), ("second", 10, 4)])
def test_counts_at_a_resolution_equal_brute_force(spark, resolution, window, slide):
    events = some_events(11)
    unit = {"minute": 60, "second": 1}[resolution]
    cut = [
        (kind, code, when - timedelta(seconds=(when - DAY).total_seconds() % unit)) for kind, code, when in events
    ]
    records = spark.createDataFrame(events, EVENT).withColumnRenamed("call_date_time_ts", "call_date_time")
    spec = CountSpec(window=f"{window} minutes", slide=f"{slide} minutes", resolution=resolution)
    counts = window_counts(call_events(drop_null_keys(records.repartition(3)), spec), spec)
    assert rows(counts) == brute_counts(cut, window, slide)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ObjectHashAggregate" not in plan


def test_every_bit_of_a_window(spark):
    """A window filled to the last second, and one filled but for a second at either end."""
    seconds = range(0, 600)
    events = [("a", "X", DAY + timedelta(seconds=s)) for s in seconds]
    events += [("b", "X", DAY + timedelta(seconds=s)) for s in seconds[1:-1]]
    frame = spark.createDataFrame(events * 2, EVENT)
    spec = CountSpec(window="10 minutes", slide="10 minutes", resolution="second")
    assert [row[4] for row in rows(window_counts(frame, spec))] == ["600", "598"]


def test_a_window_of_too_many_times_is_counted_as_without_resolution(spark):
    spec = CountSpec(window="1 hour", slide="1 hour", resolution="second")
    assert spec.slots == 3600
    events = some_events(13)
    frame = spark.createDataFrame(events, EVENT).na.drop(subset=["original_crime_type_name", "disposition"])
    assert rows(window_counts(frame, spec)) == brute_counts(events, 60, 60)


def test_resolutions():
    assert CountSpec().slots is None
    assert CountSpec(resolution="minute").slots == 10
    with pytest.raises(ValueError):
        CountSpec(resolution="day")


def test_plan_from_messages(spark):
    values = [
        call("a", "X", at("00:01"), crime_id="1"),
        call("a", "X", at("00:01"), crime_id="2"),
        call("a", None, at("00:01")),
        call(None, "X", at("00:01")),
        call("a", "X", "bogus"),
        call("", "Q", at("00:02")),
    ]
    counts = counts_plan(envelope(spark, values))
    assert counts.columns == ["original_crime_type_name", "window", "disposition", "count"]
    assert [r[0:1] + r[3:] for r in rows(counts)] == [("", "Q", "1"), ("", "Q", "1"), ("a", "X", "1"), ("a", "X", "1")]
    codes = spark.createDataFrame([("X", "desc X")], CODES)
    enriched = enriched_plan(envelope(spark, values), codes)
    assert enriched.columns == ["disposition", "original_crime_type_name", "window", "count", "description"]
    assert {(r["disposition"], r["description"]) for r in enriched.collect()} == {("X", "desc X"), ("Q", None)}


def test_only_needed_fields_are_parsed(spark):
    plan = counts_plan(envelope(spark, [call("a", "X", at("00:01"))]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
    assert "address" not in plan


def test_repeats_collapse_before_the_shuffle(spark):
    events = spark.createDataFrame([("hot", "H", at("00:30"))] * 1000, EVENT)
    plan = window_counts(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    first = plan.rindex("Exchange hashpartitioning")
    assert "HashAggregate(keys=[original_crime_type_name" in plan[first:]


def many_counts(spark):
    events = spark.createDataFrame(some_events(7), EVENT).na.drop(subset=["original_crime_type_name", "disposition"])
    return window_counts(events)


def test_unknown_codes_stay(spark):
    counts = many_counts(spark)
    codes = spark.createDataFrame([("X", "Cancel"), ("H", "Cancel"), (None, "nothing")], CODES)
    enriched = with_descriptions(counts, codes)
    assert enriched.count() == counts.count()
    assert {(r[0], r[1]) for r in enriched.select("disposition", "description").distinct().collect()} == {
        ("X", "Cancel"),
        ("H", "Cancel"),
        ("Y", None),
    }


def test_repeated_code_fails(spark):
    codes = spark.createDataFrame([("X", "one"), ("X", "two")], CODES)
    with pytest.raises(ValueError, match="repeat a disposition"):
        with_descriptions(many_counts(spark), codes)


def test_large_code_table_is_joined_by_shuffle(spark, monkeypatch):
    counts = many_counts(spark)
    codes = spark.createDataFrame([("X", "dx"), ("H", "dh")], CODES)
    broadcast = with_descriptions(counts, codes)
    assert check_codes(codes).rows == 2
    assert check_codes(codes).text_bytes == 6
    monkeypatch.setattr(enrich, "BROADCAST_ROWS", 1)
    assert not check_codes(codes).broadcastable
    salted = with_descriptions(counts, codes)
    assert "salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert salted.columns == broadcast.columns
    assert rows(salted) == rows(broadcast)


def test_empty_code_table(spark):
    assert check_codes(spark.createDataFrame([], CODES)).text_bytes == 0
