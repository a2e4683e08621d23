"""The pipeline over a small table: every stage's decisions take effect."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(words[700:800])
    rows = [(1, " ".join(words[:200]) + " " + passage), (2, " ".join(words[:200]) + "  " + passage)]
    rows += [(3, " ".join(words[:200]) + " " + passage + " end"), (4, " ".join(words[300:500]) + " " + passage)]
    rows += [(5, "too short"), (6, "same words here again now " * 40), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        seen.append(sorted(r.doc_id for r in kept.collect()))
    assert seen == [[1, 2, 3, 4], [1, 3, 4], [1, 4], [1, 4]]
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert passage in texts[1][0] and passage[20:-20] not in texts[4][0]
    assert texts[4][1] == len(texts[4][0])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {1, 4}


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_empty_table_and_tables_of_which_nothing_stays(spark, tmp_path):
    for name, rows in (("none", []), ("bad", [(1, None, "en", "s", 0), (None, "", None, None, None), (2, "few words", "en", "s", 9)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0


def test_other_columns_stay_and_null_ids_lose_to_equal_texts(spark, tmp_path):
    text, alone = (" ".join(f"{letter}{i}" for i in range(200)) for letter in "wv")
    rows = [(i, text, "en", "s", len(text), f"r{i}", b"k") for i in (5, 3)]
    rows += [(None, text, "en", "s", 1, "r", b"k"), (None, alone, "en", "s", 1, "a", b"k")]
    docs = spark.createDataFrame([*rows, rows[-1]], f"{SCHEMA}, id string, __id binary")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert sorted((r.id, r.doc_id, r.text) for r in kept.collect()) == [("a", None, alone), ("r3", 3, text)]
