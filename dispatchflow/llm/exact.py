"""Exact deduplication with the frequent texts split off.

Misra-Gries counters find every digest that more than a fixed share of the rows may hold. Those candidates are
counted exactly, and the ones that really are frequent go to all tasks by broadcast, so their rows are decided
where they lie. All other digests are shuffled; none of them has more than that share of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored, without

# A digest is frequent from this share of the rows; there are 1,000 frequent digests at most.
SUPPORT = 0.001
_SPACE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with each run of white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " "), 256))


def frequent_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """digest, keep_id, group_size of each digest that holds at least ``support`` of the rows.

    At most 1 / support rows. The Misra-Gries summary misses none; false candidates go when counted. It counts
    digests as hex text: its counters tell byte arrays apart by object, so that no count of a binary column grows.
    """
    rows = digests.count()
    summary = digests.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], support)
    candidates = summary.select(F.explode("digest_freqItems").alias("hex")).select(F.unhex("hex").alias("digest"))
    return (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= F.lit(support * rows))
    )


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """A row for each row of ``docs``: id, digest, keep_id, group_size, kept.

    Null and empty texts are equal. A null id never wins against another; a group of null ids only has a null
    ``keep_id`` and keeps them. A repeated row counts in ``group_size`` and is kept if its id is the smallest.
    An empty table gives no rows. Other columns are not read.
    """
    digests = stored(
        docs.select(F.col(id_column).alias("id"), text_digest(F.col(text_column)).alias("digest")), "digests"
    )
    return _grouped(digests, stored(frequent_digests(digests, support), "frequent"))


def _grouped(digests: DataFrame, frequent: DataFrame) -> DataFrame:
    there = digests.join(F.broadcast(frequent), "digest")
    rest = digests.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.withColumn("keep_id", F.min("id").over(group)).withColumn(
        "group_size", F.count(F.lit(1)).over(group)
    )
    return there.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_exact(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of a repeated row one stays.

    Groups are those of ``exact_groups``, of ids and digests only. Copies of frequent texts are decided map-side. The
    rows that go are taken out where they lie as long as they are few (see ``without``), so whole texts are not shuffled.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_digest(F.col(text_column)).alias("digest"))
    digests = stored(rows, "digests")
    found = _grouped(digests, stored(frequent_digests(digests, support), "frequent"))
    found = found.groupBy("id", "digest").agg(F.any_value("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    unlike = stored(found.where("not kept or copies > 1"), "unlike")
    keys = {"id": F.col(id_column), "digest": text_digest(F.col(text_column))}
    left = without(docs, unlike, keys)
    repeated = unlike.where("kept")
    if repeated.isEmpty():
        return left
    names = {key: free_name(docs, f"__{key}") for key in keys}
    again = docs.withColumns({names[key]: value for key, value in keys.items()})
    copies = repeated.select(*(F.col(key).alias(f"{names[key]}_") for key in keys))
    same = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names.values()))
    one = again.join(copies, same, "left_semi").dropDuplicates(list(names.values())).drop(*names.values())
    return left.unionByName(one)
