from datetime import datetime

import pytest
from helpers import DAY, EVENT, at, call, envelope, rows
from pyspark.sql import functions as F

from dispatchflow.functions import event_instant, plain_time
from dispatchflow.operators import call_events, distinct_events, drop_null_keys, parse_payload, tap_lines
from dispatchflow.schemas import CALL_RECORD, schema, subset

NAMES = {"t": "original_crime_type_name", "d": "disposition", "ts": "call_date_time", "n": "crime_id"}


def renamed(text):
    """The edge cases are written with one-letter keys."""
    for short, name in NAMES.items():
        text = text and text.replace(f'"{short}":', f'"{name}":')
    return text


# value, then type, code, time and id, and whether the null drop keeps it
EDGE_CASES = [
    ('{"t":"a","d":"X","ts":"2018-12-31T23:57:00.000","n":7}', "a", "X", datetime(2018, 12, 31, 23, 57), "7", True),
    ('{"t":"a","d":"X","ts":"bogus","n":"q"}', "a", "X", None, "q", True),
    ("not json", None, None, None, None, False),
    ('{"t":"a"}', "a", None, None, None, False),
    (None, None, None, None, None, False),
    ('{"t":"a","d":"X","ts":"2018-12-31T23:57:00.000Z"}', "a", "X", datetime(2018, 12, 31, 23, 57), None, True),
    ('{"T":"a"}', None, None, None, None, False),
    ('[{"t":"z","d":"Y"}]', None, None, None, None, False),
    ('{"t":{"a":1},"d":"X"}', '{"a":1}', "X", None, None, True),
    ('{"t":"","d":"X"}', "", "X", None, None, True),
    ('{"t":"a","d":"X","ts":1546300620}', "a", "X", datetime(2018, 12, 31, 23, 57), None, True),
    ('{"t":"a","d":"X","ts":"2018-12-31"}', "a", "X", datetime(2018, 12, 31), None, True),
]


@pytest.mark.parametrize("columns", [None, list(NAMES.values())], ids=["all fields", "needed fields"])
def test_edge_cases(spark, columns):
    values = [renamed(case[0]) for case in EDGE_CASES]
    parsed = parse_payload(envelope(spark, values), columns)
    wanted = [tuple(str(v) for v in case[1:5]) for case in EDGE_CASES]
    shown = parsed.select("original_crime_type_name", "disposition", plain_time(F.col("call_date_time")), "crime_id")
    assert [tuple(str(v) for v in row) for row in shown.collect()] == wanted
    assert drop_null_keys(parsed).count() == sum(case[5] for case in EDGE_CASES) == 7


def test_bad_unused_field_costs_nothing(spark):
    value = call("a", "X", at("00:01"), report_date="never", extra=[1, 2])
    record = parse_payload(envelope(spark, [value])).first()
    assert record["report_date"] is None
    assert record["original_crime_type_name"] == "a"


def test_all_call_fields_come_out(spark):
    parsed = parse_payload(envelope(spark, [call("a", "X", at("00:01"))]))
    assert parsed.schema == CALL_RECORD
    assert len(parsed.columns) == 14
    assert subset(CALL_RECORD, ["city"]).names == ["city"]


def test_json_is_parsed_once(spark):
    records = drop_null_keys(parse_payload(envelope(spark, [call("a", "X", at("00:01"))])))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_call_events_names_the_event_time(spark):
    records = parse_payload(envelope(spark, [call("a", "X", at("00:01"))]))
    events = call_events(records)
    assert events.schema == EVENT
    assert events.first()["call_date_time_ts"] is not None


@pytest.mark.parametrize(
    "kind, value, wanted",
    [
        ("string", "2024-01-01 00:03:00", "2024-01-01 00:03:00"),
        ("string", "soon", "None"),
        ("timestamp_ntz", at("00:03"), "2024-01-01 00:03:00"),
        ("timestamp", DAY, "2024-01-01 00:00:00"),
    ],
)
def test_event_instant(spark, kind, value, wanted):
    frame = spark.createDataFrame([(value,)], schema(f"t {kind}"))
    instant = frame.select(event_instant(F.col("t"), frame.schema["t"].dataType).alias("i"))
    assert instant.schema["i"].dataType.typeName() == "timestamp"
    assert str(instant.select(plain_time(F.col("i"))).first()[0]) == wanted


def test_distinct_events(spark):
    events = spark.createDataFrame(
        [("a", "X", at("00:01"))] * 50 + [("a", "X", at("00:02")), ("a", "Y", at("00:01"))] * 2, EVENT
    )
    assert len(rows(distinct_events(events))) == 3


def test_tap_lines(spark):
    frame = envelope(spark, ['{"a": "é"}', None])
    keyed = frame.withColumn("key", F.when(F.col("offset") == 1, F.encode(F.lit("k"), "UTF-8")))
    assert [r["line"] for r in tap_lines(keyed).collect()] == [
        't:0:0: key=null value={"a": "é"}',
        "t:0:1: key=k value=null",
    ]
