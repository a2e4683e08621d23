"""JSON arrays read in blocks, against Python's own reader."""

import json
import random

import pyarrow as pa
import pytest

from dispatchflow.schemas import schema
from dispatchflow.session import work_dir
from dispatchflow.sources import array_elements, arrays, split_array_records, split_typed_records
from dispatchflow.sources.arrays import ESCAPED, INSIDE, OUTSIDE, marks

ODD = [
    {"a": 'quote " and \\" and \\\\', "b": [1, [2, {"c": "]},{["}]], "z": None},
    {"a": "ends in a backslash \\", "b": "}"},
    {"a": "\\\\\\\" }, { \"", "b": {}},
    [], [[]], {}, 12, -1.5e3, "text, with [brackets] {and} braces", "", None, True,
    {"é": "straße 東京 🙂", "": {"x": {"y": {"z": [{}]}}}},
]


def written(spark, text, name="array.json"):
    from pathlib import Path

    folder = Path(work_dir(spark, "arrays").removeprefix("file://"))
    folder.mkdir(parents=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"{folder}/{name}"


def elements(spark, path, block):
    rows = sorted((r.position, r.text) for r in array_elements(spark, path, block).collect())
    assert [position for position, _ in rows] == list(range(len(rows)))
    return [json.loads(text) for _, text in rows]


def made(seed, count):
    draw = random.Random(seed)

    def value(depth):
        kind = draw.randrange(6 if depth < 3 else 4)
        if kind < 2:
            return "".join(draw.choices('ab"\\{}[],: \né', k=draw.randrange(12)))
        if kind == 2:
            return draw.choice([None, True, 0, 7.25, -3])
        if kind == 4:
            return [value(depth + 1) for _ in range(draw.randrange(4))]
        return {value_key(): value(depth + 1) for _ in range(draw.randrange(4))}

    def value_key():
        return "".join(draw.choices('k"\\}{,', k=3))

    return [value(0) for _ in range(count)]


@pytest.mark.parametrize("block", [11, 333, None])
@pytest.mark.parametrize("indent", [None, 2])
def test_elements_as_a_json_reader_has_them(spark, block, indent):
    for records in (ODD, made(1, 60)):
        for ascii_ in (True, False):
            path = written(spark, "\n " + json.dumps(records, indent=indent, ensure_ascii=ascii_) + " \n")
            assert elements(spark, path, block) == records


def test_a_file_is_read_by_many_tasks(spark):
    path = written(spark, json.dumps(made(2, 500)))
    frame = array_elements(spark, path, 200)
    assert frame.rdd.getNumPartitions() > 10
    assert elements(spark, path, 200) == made(2, 500)


def test_several_files_and_arrays_without_elements(spark):
    from pathlib import Path

    one = Path(written(spark, "[1, 2]"))
    (one.parent / "two.json").write_text(' [\n {"a": 1} ]')
    (one.parent / "none.json").write_text("[" + " " * 50 + "]")
    for block in (5, None):
        found = array_elements(spark, str(one.parent), block).collect()
        assert sorted((r.file.rpartition("/")[2], r.position, r.text.strip()) for r in found) == [
            ("array.json", 0, "1"), ("array.json", 1, "2"), ("two.json", 0, '{"a": 1}'),
        ]


@pytest.mark.parametrize(
    "text",
    ['[{"a": 1}', '[{"a": 1}]}', '{"a": [1]}', "[1][2]", "[1] x", "x [1]", "[1,,2]", "[1,]", '["open]', "[1]]", "12", "[1] } {", "[{]}"],
)
def test_what_is_no_array_fails(spark, text):
    for block in (3, None):
        with pytest.raises(Exception, match="JSON array|has no text|MALFORMED|cannot be parsed"):
            split_array_records(spark, written(spark, text), block).collect()


def test_payloads(spark):
    records = [{"b": 1, "a": None, "z": {"q": [1, 2]}}, {"b": 3, "c": 1.5}]
    path = written(spark, json.dumps(records))
    for block in (5, None):
        rows = sorted(split_array_records(spark, path, block).collect())
        assert [r.payload for r in rows] == ['{"a":null,"b":1,"z":{"q":[1,2]}}', '{"b":3,"c":1.5}']
        typed = split_typed_records(spark, path, schema("b long, c double"), block).collect()
        assert sorted(r.payload for r in typed) == ['{"b":1,"c":null}', '{"b":3,"c":1.5}']
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        split_typed_records(spark, written(spark, '[{"b": "x"}]'), schema("b long")).collect()


def test_states_follow_each_other():
    """Cut anywhere, the second half begins as the first ends, and the marks are those of the whole."""
    text = json.dumps(ODD).encode()
    whole = marks(text, OUTSIDE)
    seen = set()
    for cut in range(len(text) + 1):
        one = marks(text[:cut], OUTSIDE)
        two = marks(text[cut:], one.state)
        seen.add(one.state)
        assert [*one.places, *(two.places + cut)] == whole.places.tolist()
        assert one.depth + two.depth == whole.depth == 0 and two.state == whole.state == OUTSIDE
    assert seen == {OUTSIDE, INSIDE, ESCAPED}
    assert marks(b"", ESCAPED).state == ESCAPED


def test_blocks_grow_with_the_file(spark):
    """The number of tasks depends on the cores, not on the size of the file over the smallest block."""
    records = made(3, 3000)
    path = written(spark, json.dumps(records))
    frame = array_elements(spark, path, 11)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert frame.rdd.getNumPartitions() <= 17 * spark.sparkContext.defaultParallelism + shuffled
    assert elements(spark, path, 11) == records


def test_rows_of_a_block_go_together():
    rows = [("a", 0, b"[1}"), ("a", 0, b"}"), ("a", 5, b"x}"), ("b", 5, b"}"), ("b", 5, b"y}"), ("c", 0, b"z}")]
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["file", "block", "data"])
    found = [(("a", 0), b"[1}}"), (("a", 5), b"x}"), (("b", 5), b"}y}"), (("c", 0), b"z}")]
    assert list(arrays._chunks(iter([batch, batch.slice(6)]))) == found
    assert list(arrays._chunks(iter([batch.slice(1, 2)]))) == [(("a", 0), b"}"), (("a", 5), b"x}")]
