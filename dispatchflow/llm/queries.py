"""Queries over the whole tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chat,
    exact,
    minhash,
    packing,
    pages,
    quality,
    resampling,
    search,
    sharding,
    simhash,
    suffix,
    toxicity,
)
from .common import in_arrow, slices

TOKENIZER = "word_bpe_49k.json"
CHAT_RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.withColumnRenamed("id", "doc_id")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ranks = chat.Ranks(public_tokenizers.path(CHAT_RANKS), public_tokenizers.PATTERN)
    trees, known = chat.formatted(rows.unionByName(extra), ranks)
    return known.join(chat.read_back(trees, ranks), "path").drop("path")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.decoder(path)
        for batch in slices(batches):
            rows = [bpe.ids_of(data) for data in batch.column("ids").to_pylist()]
            shown = [hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for ids in rows]
            decoded = [hashlib.sha256(own.decode(ids).encode()).hexdigest() for ids in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(list(map(len, rows)), pa.int64()), pa.array(shown), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return in_arrow(encoded, digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages")
    page = F.struct("page_id", "url")
    texts = pages.extracted(rows.select(page.alias("page"), "html"), "page")
    return texts.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_components(_table(spark, sf_dir, "documents"), size=3, most=2, segments=3)
    shown = F.lpad(F.lower(F.hex("print")), 16, "0")
    return near.select(F.col("id").alias("doc_id"), shown.alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(_table(spark, sf_dir, "documents"))
    return rows.withColumnRenamed("id", "doc_id").drop("content")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"), 8)
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.cut_repeats(_table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", "n_passages")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_groups(_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)
    return hits.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_documents(_table(spark, sf_dir, "documents"), size=4, percent=80)
    return rows.withColumnRenamed("id", "doc_id")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    rows = resampling.resampled(docs, target, n=1, buckets=10_000, min_words=20, percent=10, seed=2024)
    return rows.withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_bpe": op3_bpe,
    "op4_html": op4_html,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_suffix": op8_suffix,
    "op9_toxicity": op9_toxicity,
    "op10_exact": op10_exact,
    "op11_search": op11_search,
    "op12_minhash": op12_minhash,
    "op13_resampling": op13_resampling,
}

def _escaped(text: str) -> str:
    """SQL of a text's form between a template's marks."""
    found = f"replace({text}, '\\', '\\\\')"
    for control in chat.CONTROL:
        found = f"replace({found}, '{control}', '{control[0]}\\{control[1:]}')"
    return found


ORACLE = {
    "op2_chat": f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as "text" from conversations
  union all
  select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
),
learned as (
  select conv_id, string_agg(case when role = 'assistant' then "text" else '' end, '' order by turn) as learned,
         string_agg(role || chr(10) || "text" || chr(10), '' order by turn) as turns,
         count(*) as n_turns,
         sum(length({_escaped("role")}) + length({_escaped('"text"')}) + {len(chat.TURN + chat.TEXT + chat.END)}) as chars
  from said group by 1
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(learned) as loss_chars,
       sha256(learned) as loss_sha256, cast(chars as bigint) as formatted_chars
from learned
""",
    "op8_suffix": """
with bytes as (
  select doc_id, hex(encode(coalesce("text", ''))) as h, octet_length(encode(coalesce("text", ''))) as n from documents
),
cuts as (select doc_id, h, n, unnest(range(0, n // 512 + 1)) as p from bytes),
pieces as (select doc_id, n, p, substr(h, 1024 * p + 1, 1224) as piece from cuts),
places as (select doc_id, p, piece, unnest(range(0, least(512, greatest(n - 99 - 512 * p, 0)))) as i from pieces),
strings as (
  select doc_id, 512 * p + i as start,
         row_number() over (partition by substr(piece, 2 * i + 1, 200) order by doc_id, 512 * p + i) as nth
  from places
),
again as (select doc_id, start from strings where nth > 1),
begun as (
  select doc_id, start, start > 100 + coalesce(lag(start) over (partition by doc_id order by start), -101) as begins
  from again
),
numbered as (select doc_id, start, sum(begins::int) over (partition by doc_id order by start) as run from begun),
runs as (select doc_id, run, min(start) as low, max(start) + 100 as high from numbered group by 1, 2),
between_runs as (
  select doc_id, coalesce(lag(high) over (partition by doc_id order by low), 0) as a, low as b from runs
  union all
  select doc_id, coalesce(max(high), 0), any_value(n) from bytes left join runs using (doc_id) group by 1
),
kept as (
  select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as left_over
  from between_runs join bytes using (doc_id) group by 1
),
removed as (select doc_id, sum(high - low) as n_removed, count(*) as n_spans from runs group by 1)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(left_over)) as kept_sha256
from bytes join kept using (doc_id) left join removed using (doc_id)
""",
    "op10_exact": r"""
with texts as (
  select doc_id, sha256(regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents
),
found as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from texts group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from texts join found using (text_sha256)
""",
    "op11_search": r"""
with doc_terms as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
),
lengths as (select doc_id, count(*) as n from doc_terms group by 1),
totals as (select count(*) as docs, cast(sum(n) as bigint) as length from lengths),
asked as (
  select item_id, unnest(regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
),
query as (select item_id, term, count(*) as times from asked group by 1, 2),
held as (select doc_id, term, count(*) as tf from doc_terms where term in (select term from query) group by 1, 2),
weights as (
  select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1))) as bigint) as w
  from held, totals group by term, docs
),
parts as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length))) as part
  from held join weights using (term) join lengths using (doc_id), totals
),
scores as (
  select item_id, doc_id, cast(sum(times * part) as bigint) as score from query join parts using (term) group by 1, 2
),
ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank,
         doc_id, score
  from scores where score > 0
)
select * from ranked where rank <= 10
""",
    "op12_minhash": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
           else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as shingle
  from words
),
sizes as (select doc_id, count(*) as n from shingles group by 1),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * common >= 80 * (x.n + y.n - common)
),
edges as (select a, b from links union select b, a from links),
reached as (
  select doc_id, doc_id as other from documents
  union
  select reached.doc_id, edges.b from reached join edges on edges.a = reached.other
),
smallest as (select doc_id, min(other) as component_id from reached group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from smallest left join sizes using (doc_id)
""",
    "op13_resampling": r"""
with crc_table as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as steps
  from (select unnest(range(0, 256)) as i)
),
texts as (
  select 'd' as side, doc_id as id, "text" from documents union all select 'b', item_id, "text" from benchmark
),
words as (
  select side, id, unnest(regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
  from texts
),
hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode(word))),
           lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint)),
           lambda c, x: xor(c >> 8, steps[1 + (xor(c, x) & 255)])), 4294967295) % 10000 as bucket
  from (select distinct word from words), crc_table
),
counts as (
  select bucket, count(*) filter (where side = 'd') as s, count(*) filter (where side = 'b') as t
  from words join hashed using (word) group by 1
),
gains as (
  select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + 10000))::double / ((s + 1) * (sum(t) over () + 10000))::double))::bigint as gain
  from counts
),
sums as (
  select id as doc_id, count(*) as n_features, sum(gain)::bigint as gain
  from words join hashed using (word) join gains using (bucket) where side = 'd' group by 1
),
scored as (
  select doc_id, coalesce(n_features, 0) as n_features,
         coalesce((gain - (gain % n_features + n_features) % n_features) // n_features, 0) as weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as noise
  from documents left join sums using (doc_id)
),
placed as (
  select doc_id, row_number() over (order by weight + noise desc, doc_id) as place, count(*) over () as able
  from scored where n_features >= 20
)
select doc_id, n_features, weight, weight + noise as score, case when place <= 10 * able // 100 then place end as rank
from scored left join placed using (doc_id)
""",
}
