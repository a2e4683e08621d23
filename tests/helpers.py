"""Small inputs, and a plain Python count to compare with."""

import json
import os
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dispatchflow.operators import flatten_window
from dispatchflow.schemas import ENVELOPE, schema
from dispatchflow.sources import as_messages, write_topic

EVENT = schema("original_crime_type_name string, disposition string, call_date_time_ts timestamp")
DAY = datetime(2024, 1, 1)


def at(clock: str) -> datetime:
    """A time on the fixture's day: ``HH:MM`` or ``HH:MM:SS``."""
    parts = [int(p) for p in clock.split(":")]
    return DAY + timedelta(hours=parts[0], minutes=parts[1], seconds=parts[2] if len(parts) > 2 else 0)


def call(kind, code, when, **more) -> str:
    """A call's JSON payload."""
    moment = when.isoformat() if isinstance(when, datetime) else when
    return json.dumps({"original_crime_type_name": kind, "disposition": code, "call_date_time": moment, **more})


def payloads(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], schema("payload string")).coalesce(1)


def envelope(spark, values):
    """Messages of topic ``t``, one for each value, in one partition."""
    rows = [
        (None, None if v is None else bytearray(v.encode()), "t", 0, i, DAY, 0) for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, ENVELOPE)


def write_in_order(spark, topic, batches):
    """One file a batch, the files' times increasing."""
    seen = set()
    for number, texts in enumerate(batches):
        write_topic(as_messages(payloads(spark, texts), topic.name), topic)
        for name in sorted(os.listdir(topic.path)):
            if name.endswith(".parquet") and name not in seen:
                seen.add(name)
                moment = 1_700_000_000 + number * 10
                os.utime(f"{topic.path}/{name}", (moment, moment))


def rows(frame):
    """A frame's rows as a sorted list of tuples of text."""
    plain = flatten_window(frame) if "window" in frame.columns else frame
    return sorted(tuple(str(v) for v in row) for row in plain.collect())


def brute_counts(events, window_minutes=10, slide_minutes=5):
    """Distinct times per (type, window start, code), by going through the events one by one."""
    window, slide = timedelta(minutes=window_minutes), timedelta(minutes=slide_minutes)
    groups = defaultdict(set)
    for kind, code, when in events:
        if kind is None or code is None or when is None:
            continue
        start = DAY + ((when - DAY) // slide) * slide
        while start + window > when:
            groups[kind, start, start + window, code].add(when)
            start -= slide
    return sorted((str(k), str(s), str(e), str(c), str(len(v))) for (k, s, e, c), v in groups.items())


def with_batch(frame):
    """``batch: type, code, window start, count`` lines, as the late-data fixture is written."""
    flat = frame.select(
        "batch_id",
        "original_crime_type_name",
        "disposition",
        F.date_format("window_start", "HH:mm").alias("start"),
        "count",
    )
    found = defaultdict(list)
    for row in flat.collect():
        found[row["batch_id"]].append(",".join(str(v) for v in row[1:]))
    return {batch: sorted(lines) for batch, lines in found.items()}
