import json
import subprocess
import sys
from pathlib import Path

import pytest
from helpers import at, brute_counts, rows

from dispatchflow.cli import main

REPO = Path(__file__).resolve().parents[1]
CALLS = [("a", "CAN", "00:01"), ("a", "CAN", "00:01"), ("a", "22", "00:12"), ("b", "?", "00:14"), ("b", None, "00:15")]
CALLS += [("c", "ND", "01:00")]


@pytest.fixture
def home(spark, tmp_path):
    names = ["original_crime_type_name", "disposition", "call_date_time"]
    records = [dict(zip(names, (kind, code, at(clock).isoformat()))) for kind, code, clock in CALLS]
    (tmp_path / "calls.json").write_text("\n" + json.dumps(records, indent="\t"))
    (tmp_path / "codes.json").write_text('\n[{"disposition_code":"?","description":"Question"}]')
    return tmp_path


def topic(home):
    return ["--topic", "calls", "--folder", f"{home}/topics"]


def publish(home, kind):
    main(["publish", *topic(home), "--input", f"{home}/calls.json", "--format", kind])


def events():
    return [(kind, code, at(clock)) for kind, code, clock in CALLS]


def with_description(counts, meaning):
    return sorted((code, kind, *rest, meaning.get(code, "None")) for kind, *rest, code, count in counts for rest in [[*rest, count]])


def test_history(spark, home):
    publish(home, "calls")
    main(["history", *topic(home), "--output", f"{home}/out", "--codes", f"{home}/codes.json"])
    found = rows(spark.read.parquet(f"{home}/out").drop("window_date"))
    assert found == with_description(brute_counts(events()), {"?": "Question"})


def test_stream_with_known_codes(spark, home):
    publish(home, "array")
    main(
        ["stream", *topic(home), "--output", f"{home}/out", "--checkpoint", f"{home}/checkpoint", "--once"]
        + ["--progress", f"{home}/progress"]
    )
    closed = [row for row in brute_counts(events()) if row[2] <= str(at("00:50"))]
    assert rows(spark.read.parquet(f"{home}/out/counts").drop("batch_id", "run")) == closed
    meaning = {"CAN": "Cancel", "22": "Cancel"}
    found = rows(spark.read.parquet(f"{home}/out/enriched").drop("batch_id", "run"))
    assert found == with_description(closed, meaning)
    progress = spark.read.parquet(f"{home}/progress")
    assert progress.selectExpr("sum(num_input_rows)").first()[0] == len(CALLS)


def test_stream_of_plain_counts_goes_on_where_it_stopped(spark, home):
    command = ["stream", *topic(home), "--output", f"{home}/out", "--checkpoint", f"{home}/checkpoint", "--once"]
    command += ["--plain", "--window", "1 hour", "--slide", "30 minutes", "--delay", "0 seconds"]
    publish(home, "array")
    main(command)
    closed = [row for row in brute_counts(events(), 60, 30) if row[2] <= str(at("01:00"))]
    assert rows(spark.read.parquet(f"{home}/out/counts").drop("batch_id", "run")) == closed
    publish(home, "array")
    main(command)
    assert rows(spark.read.parquet(f"{home}/out/counts").drop("batch_id", "run")) == closed


def test_tap(spark, home, capsys):
    publish(home, "array")
    main(["tap", *topic(home), "--rows", "3"])
    shown = capsys.readouterr().out
    assert 'calls:0:0: key=null value={"call_date_time":"2024-01-01T00:01:00","disposition":"CAN"' in shown
    assert len([line for line in shown.splitlines() if "key=null" in line]) == 3


def test_tap_shows_every_message(spark, home, capsys):
    records = [{"n": i} for i in range(57)]
    (home / "calls.json").write_text(json.dumps(records))
    publish(home, "array")
    main(["tap", *topic(home)])
    assert len(capsys.readouterr().out.splitlines()) == 57
    follow = ["tap", *topic(home), "--follow", "--once"]
    main([*follow, "--checkpoint", f"{home}/shown"])
    assert capsys.readouterr().out.count("key=null") == 57
    main([*follow, "--checkpoint", f"{home}/kept", "--output", f"{home}/lines"])
    assert spark.read.text(f"{home}/lines").count() == 57


def test_preview_does_not_move_a_checkpoint(home):
    with pytest.raises(SystemExit):
        main(["tap", *topic(home), "--follow", "--checkpoint", f"{home}/c", "--rows", "3"])


def test_printed_stream(spark, home):
    publish(home, "array")
    command = [sys.executable, "-m", "dispatchflow", "stream", *topic(home), "--once", "--master", "local[2]"]
    command += ["--checkpoint", f"{home}/checkpoint", "--shuffle-partitions", "2"]
    shown = subprocess.run(command, cwd=REPO, capture_output=True, text=True, timeout=300, check=True).stdout
    assert "Sliding" not in shown and "Batch: " in shown
    assert "a | 2023-12-31 23:55:00 | 2024-01-01 00:05:00 | CAN | 1" in shown
    assert "CAN | a | 2023-12-31 23:55:00 | 2024-01-01 00:05:00 | 1 | Cancel" in shown


def test_a_topic_needs_a_home():
    with pytest.raises(SystemExit):
        main(["tap", "--topic", "calls"])
