"""Every registered query over a small folder: its SQL, or its columns, types and rows."""

import duckdb
import pytest
from small import rows

from dispatchflow.llm.queries import ORACLE, QUERIES

TYPES = {
    "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op3_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_html": "page_id bigint, url string, text string, n_chars bigint",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_suffix": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_exact": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op11_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op12_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op13_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    found = rows()[:-1]
    docs = spark.createDataFrame([(r[0], r[1], "en", "s", len(r[1] or "")) for r in found], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (2, 2, "user", "")]
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    html = "<html><body><div class='nav'><a href='/'>Home</a></div><article><p>A long paragraph of text &amp; more.</p></article></body></html>"
    spark.createDataFrame([(1, "u1", html), (2, "u2", None)], "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, "alpha the x9"), (2, "w1 w2 w3 naïve"), (3, None)], "item_id bigint, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    labels = [(r[0], 1, i % 2) for i, r in enumerate(found)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def test_all_are_here():
    assert set(TYPES) == set(QUERIES)


@pytest.mark.parametrize("name", list(TYPES))
def test_query(spark, folder, name):
    frame = QUERIES[name](spark, folder)
    kinds = dict(frame.dtypes)
    for column in TYPES[name].split(", "):
        assert kinds[column.split()[0]] == column.split()[1]
    found = frame.collect()
    if "doc_id" in kinds and name not in ("op1_packing", "op11_search"):
        assert sorted(r.doc_id for r in found) == sorted(r[0] for r in rows()[:-1])
    if name == "op1_packing":
        assert {r.doc_id for r in found} == {r[0] for r in rows()[:-1]}
    if name == "op2_chat":
        assert sorted(r.conv_id for r in found) == [-7, 1, 2]
    if name in ORACLE:
        database = duckdb.connect()
        for table in ("documents", "benchmark", "conversations"):
            database.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
        answer = database.execute(ORACLE[name])
        names = [column[0] for column in answer.description]
        assert sorted(names) == sorted(frame.columns)
        want = sorted(tuple(str(row[names.index(c)]) for c in frame.columns) for row in answer.fetchall())
        assert sorted(tuple(str(v) for v in r) for r in found) == want
