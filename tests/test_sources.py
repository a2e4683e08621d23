import json

import pytest
from helpers import DAY, payloads

from dispatchflow.config import interval_seconds
from dispatchflow.operators import check_codes, parse_payload
from dispatchflow.schemas import CALL_RECORD, ENVELOPE
from dispatchflow.sources import (
    Topic,
    as_messages,
    builtin_codes,
    json_array_records,
    json_line_records,
    radio_codes,
    spread,
    topic_batch,
    topic_stream,
    typed_array_records,
    write_topic,
)
from dispatchflow.sources.topics import kafka_read_options, kafka_write_options


def values(spark, topic):
    return sorted(bytes(r["value"]).decode() for r in topic_batch(spark, topic).collect())


def test_array_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = '\n[{"b":1,"a":null,"z":{"q":[1,2]}}, {"b":"s","c":1.50}]\n'
    (tmp_path / "in" / "one.json").write_text(text)
    (tmp_path / "in" / "none.json").write_text("[]")
    records = json_array_records(spark, str(tmp_path / "in")).orderBy("position").collect()
    assert [tuple(r) for r in records] == [
        (0, '{"a":null,"b":1,"z":{"q":[1,2]}}'),
        (1, '{"b":"s","c":1.5}'),
    ]


def test_array_is_parsed_once(spark, tmp_path):
    (tmp_path / "one.json").write_text("[]")
    plan = json_array_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_broken_array_fails(spark, tmp_path):
    (tmp_path / "one.json").write_text('[{"a":1}, {"a":')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        json_array_records(spark, str(tmp_path)).collect()


def test_larger_array(spark, tmp_path):
    records = [{"n": n, "text": "x" * 1000, "s": "ü\n\"", "none": None} for n in range(30_000)]
    (tmp_path / "one.json").write_text(json.dumps(records, indent=1))
    found = json_array_records(spark, str(tmp_path))
    assert found.count() == 30_000
    assert json.loads(found.where("position = 29999").first()["payload"]) == records[-1]


def test_line_records(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"b": 1, "a": null}\n\n{"b": "é"}\n')
    found = sorted(r["payload"] for r in json_line_records(spark, str(tmp_path)).collect())
    assert found == ['{"a":null,"b":1}', '{"b":"é"}']


def test_broken_line_fails(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"b": 1}\n{"b"\n')
    with pytest.raises(Exception, match="MALFORMED"):
        json_line_records(spark, str(tmp_path)).collect()


def test_typed_records_keep_nulls_and_microseconds(spark, tmp_path):
    call = {"crime_id": "1", "call_date_time": "2018-12-31T23:57:00.123456", "city": None}
    (tmp_path / "one.json").write_text(json.dumps([call]))
    payload = json.loads(typed_array_records(spark, str(tmp_path), CALL_RECORD).first()["payload"])
    assert payload["call_date_time"] == "2018-12-31T23:57:00.123456"
    assert list(payload) == CALL_RECORD.names
    assert payload["city"] is None


@pytest.mark.parametrize("text", ['[{"crime_id":"1"', '[{"call_date_time":"soon"}]'])
def test_broken_typed_record_fails(spark, tmp_path, text):
    (tmp_path / "one.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        typed_array_records(spark, str(tmp_path), CALL_RECORD).collect()


def test_publish_then_parse_gives_the_records(spark, tmp_path):
    calls = [
        {"crime_id": str(n), "original_crime_type_name": 'a "b"', "disposition": None if n % 2 else "ü"}
        for n in range(10)
    ]
    (tmp_path / "in.json").write_text(json.dumps(calls, indent="\t"))
    topic = Topic("calls", folder=str(tmp_path / "topics"))
    write_topic(as_messages(json_array_records(spark, str(tmp_path / "in.json")), "calls"), topic)
    parsed = parse_payload(topic_batch(spark, topic)).select(list(calls[0])).collect()
    assert sorted((r.asDict() for r in parsed), key=lambda r: r["crime_id"]) == calls


def test_folder_topic_numbers_its_messages(spark, tmp_path):
    topic = Topic("t", folder=str(tmp_path))
    frame = spark.range(1000, numPartitions=3).selectExpr("cast(id as string) as payload")
    write_topic(as_messages(frame, "t"), topic, max_records_per_file=100)
    stored = topic_batch(spark, topic)
    assert stored.schema == ENVELOPE
    assert len(stored.inputFiles()) >= 10
    places = [(r["partition"], r["offset"]) for r in stored.collect()]
    assert len(set(places)) == 1000
    assert {p for p, _ in places} == {0, 1, 2}
    assert max(o for _, o in places) < 400
    first = stored.first()
    assert (first["key"], first["topic"], first["timestampType"]) == (None, "t", 0)
    assert first["timestamp"] is not None


def test_folder_topic_keeps_given_places(spark, tmp_path):
    topic = Topic("t", folder=str(tmp_path))
    placed = spark.createDataFrame([(None, bytearray(b"{}"), "t", 7, 42, DAY, 1)], ENVELOPE)
    write_topic(placed, topic)
    write_topic(as_messages(payloads(spark, ["[]"]), "t"), topic)
    assert values(spark, topic) == ["[]", "{}"]
    assert {(r["partition"], r["offset"]) for r in topic_batch(spark, topic).collect()} == {(7, 42), (0, 0)}


def test_few_files_are_spread(spark, tmp_path):
    topic = Topic("t", folder=str(tmp_path))
    write_topic(as_messages(payloads(spark, ["{}"] * 100), "t"), topic)
    assert topic_batch(spark, topic).rdd.getNumPartitions() == 1
    assert topic_batch(spark, topic, min_partitions=3).rdd.getNumPartitions() == 3
    wide = spark.range(100, numPartitions=5)
    assert spread(wide, 4) is wide


def test_topic_is_kafka_or_folder():
    with pytest.raises(ValueError):
        Topic("t")
    with pytest.raises(ValueError):
        Topic("t", servers="a:1", folder="/x")


def test_kafka_options():
    topic = Topic("calls", servers="a:9092,b:9092")
    assert kafka_read_options(topic, max_per_trigger=200) == {
        "kafka.bootstrap.servers": "a:9092,b:9092",
        "subscribe": "calls",
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "200",
    }
    assert kafka_read_options(topic, "latest", "latest", min_partitions=64) == {
        "kafka.bootstrap.servers": "a:9092,b:9092",
        "subscribe": "calls",
        "startingOffsets": "latest",
        "endingOffsets": "latest",
        "minPartitions": "64",
    }


@pytest.mark.parametrize(
    "use",
    [
        topic_stream,
        topic_batch,
        lambda spark, topic: write_topic(as_messages(payloads(spark, ["{}"]), "t"), topic),
    ],
    ids=["stream", "batch", "write"],
)
def test_kafka_is_asked_for(spark, use):
    """The connector is no part of Spark's own jars; without it Spark says what is missing."""
    with pytest.raises(Exception, match="(?i)kafka"):
        use(spark, Topic("t", servers="localhost:1"))


def test_code_file(spark, tmp_path):
    path = tmp_path / "codes.json"
    path.write_text('\n[\n\t{\n\t\t"disposition_code":"ABA",\n\t\t"description":"Abated"\n\t},\n\t{"disposition_code":"22","more":1}\n]')
    codes = radio_codes(spark, str(path))
    assert codes.columns == ["disposition", "description"]
    assert sorted(map(tuple, codes.collect())) == [("22", None), ("ABA", "Abated")]


def test_known_codes(spark):
    codes = builtin_codes(spark)
    assert check_codes(codes).rows == 19
    assert sorted(r["disposition"] for r in codes.where("description = 'Cancel'").collect()) == ["22", "CAN"]


def test_second_write_goes_on_with_offsets(spark, tmp_path):
    topic = Topic("t", folder=str(tmp_path))
    for _ in range(3):
        write_topic(as_messages(spark.range(100, numPartitions=2).selectExpr("'{}' as payload"), "t"), topic)
    places = topic_batch(spark, topic).select("partition", "offset")
    assert places.count() == places.distinct().count() == 300


def test_kafka_client_options_go_to_reads_and_writes():
    topic = Topic("t", servers="a:1", options={"kafka.security.protocol": "SSL", "kafka.client.id": "x"})
    for options in (kafka_read_options(topic), kafka_write_options(topic)):
        assert options["kafka.security.protocol"] == "SSL"
        assert options["kafka.client.id"] == "x"
    assert kafka_write_options(topic)["topic"] == "t"


def test_options_that_mean_nothing_are_refused(spark, tmp_path):
    folder = Topic("t", folder=str(tmp_path))
    for wrong in ({"starting": "latest"}, {"max_per_trigger": 2}, {"min_partitions": 2}):
        with pytest.raises(ValueError, match="folder"):
            topic_stream(spark, folder, **wrong)
    for wrong in ({"max_files": 1}, {"max_bytes": 1}):
        with pytest.raises(ValueError, match="Kafka"):
            topic_stream(spark, Topic("t", servers="a:1"), **wrong)
    with pytest.raises(ValueError, match="options"):
        Topic("t", folder="/x", options={"kafka.client.id": "x"})


def test_intervals_are_read_as_spark_writes_them():
    for text, seconds in (("1 week", 604800), ("interval 10 minutes", 600), ("1 hour 30 minutes", 5400)):
        assert interval_seconds(text) == seconds
    with pytest.raises(ValueError):
        interval_seconds("1 month")
