"""From raw documents to packed training sequences: quality rules, three kinds of deduplication, packing.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns pieces. Null and
empty texts go with the quality rules; a table that is empty, or of which nothing is kept, goes through all stages and
gives no pieces. Of equal texts a row with a null id stays only where none has an id; near copies and repeated strings
are not looked for in rows with a null id. Columns beyond those of documents are kept, whatever they are called, up to
the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchflow.llm import exact, packing, quality, simhash, suffix
from dispatchflow.llm.common import stored

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the divergence limits."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, the one of smallest id."""
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts joined by fingerprints of three-word shingles that differ in 2 bits or fewer, the one of smallest id."""
    return simhash.drop_near(docs, size=3, most=2)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier too; ``n_chars`` follows."""
    cut = suffix.drop_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack),
]

# Windows filled by score and a hash that DuckDB does not have are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
