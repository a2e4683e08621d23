"""Balanced label propagation: linked documents move together while shards keep exactly even row counts.

Every row starts in a shard by its number, so shards differ by one row at most. In each round a linked row asks
for the shard that holds most of the rows it is linked to. Moves are admitted by count: as many from shard i to j
as from j to i, and beyond that what shard j can still take. Rows without links fill what is left at the end.
Links are groups of rows; a group is a hub that its rows vote through, so no pairs are made.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_hot_keys, with_rank

ROUNDS = 12


def _ask(members: DataFrame, labels: DataFrame, allowed: list[int]) -> DataFrame:
    """row, shard, target: where most of its links are, among ``allowed`` shards and its own. Movers only."""
    held = members.join(labels, "row").groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    # One entry for each shard at most, however large the group.
    entry = F.struct("shard", "n", F.xxhash64("group", "shard").alias("tie"))
    profile = held.groupBy("group").agg(F.collect_list(entry).alias("profile"), F.sum("n").alias("holds"))
    # A large group's profile goes to its rows, wherever they are.
    asked = with_hot_keys(members, profile, ["group"], "holds", members.count(), "inner")
    votes = asked.join(labels, "row").select("row", "shard", F.explode("profile").alias("at"))
    votes = votes.where(F.col("at.shard").isin(allowed) | (F.col("at.shard") == F.col("shard")))
    scores = votes.groupBy("row", "shard", F.col("at.shard").alias("to")).agg(
        F.sum("at.n").alias("score"), F.min("at.tie").alias("tie")
    )
    best = scores.groupBy("row", "shard").agg(F.max_by("to", F.struct("score", "tie")).alias("target"))
    return best.where("shard <> target")


def _admitted(demand: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may go from i to j: exchanges in full, then what is free in j, most wanted first."""
    quota = {(i, j): min(n, demand.get((j, i), 0)) for (i, j), n in demand.items()}
    left = list(free)
    for (i, j), n in sorted(demand.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - quota[i, j], left[j])
        quota[i, j] += more
        left[j] -= more
    return {move: n for move, n in quota.items() if n}


def propagate(members: DataFrame, labels: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Labels (row, shard) after the rounds. members: row, group. room: most linked rows of each shard.

    What reaches the driver in a round is one count for each shard and for each pair of shards. Rounds alternate
    between all shards and only those with room, so that a group larger than a shard fills shards one by one.
    """
    shards, still = len(room), 0
    for turn in range(rounds):
        load = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        free = [room[s] - load.get(s, 0) for s in range(shards)]
        allowed = list(range(shards)) if turn % 2 == 0 else [s for s in range(shards) if free[s] > 0]
        movers = stored(_ask(members, labels, allowed), "movers")
        wanted = movers.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n")).collect()
        quota = _admitted({(r["shard"], r["target"]): r["n"] for r in wanted}, free)
        still = 0 if quota else still + 1
        if still == 2:
            break
        if not quota:
            continue
        ranked = with_rank(movers, ["shard", "target"], F.struct(F.col("row"), F.lit(turn)), [F.col("row")], "nth")
        most = F.coalesce(
            *(F.when((F.col("shard") == i) & (F.col("target") == j), F.lit(n)) for (i, j), n in quota.items()), F.lit(0)
        )
        moved = ranked.where(F.col("nth") < most).select("row", "target")
        labels = stored(
            labels.join(moved, "row", "left").select("row", F.coalesce("target", "shard").alias("shard")), "labels"
        )
    return labels


def balanced_shards(rows: DataFrame, members: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """row, shard for all of ``rows`` (row: numbers from 0 without gaps); members: row, group, links to follow."""
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    linked = members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(with_hot_keys(members, linked, ["group"], "n", total, "inner").select("row", "group"), "members")
    start = members.select("row").distinct().select("row", F.pmod("row", F.lit(shards)).cast("int").alias("shard"))
    labels = propagate(members, stored(start, "labels"), quota, rounds)
    load = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = list(accumulate(quota[s] - load.get(s, 0) for s in range(shards)))
    rest = rows.select("row").join(labels.select("row"), "row", "left_anti")
    rest = with_rank(rest, [], F.col("row"), [F.col("row")], "nth")
    place = F.coalesce(*(F.when(F.col("nth") < end, F.lit(s)) for s, end in enumerate(ends)))
    return labels.unionByName(rest.select("row", place.cast("int").alias("shard")))


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one more; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def shard_documents(
    docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """A row for each row of ``docs``: id, size, text_crc32, shard, slot. Equal texts are linked.

    Row counts of shards differ by one at most; slots of a shard count from 0 without gaps. Null and empty texts
    are equal. Repeated rows and null ids are rows like any other. An empty table gives no rows; other columns are
    not read. A group larger than a shard is cut into as few shards as there is room in.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    source = docs.select(
        F.col(id_column).alias("id"),
        text_size(F.col(text_column)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("group"),
    )
    source = stored(source, "documents")
    order = [F.col("id"), F.col("group")]
    rows = stored(with_rank(source, [], F.struct("id", "group"), order, "row"), "rows")
    placed = balanced_shards(rows, rows.select("row", "group"), shards, rounds)
    named = rows.join(placed, "row")
    return with_rank(named, ["shard"], F.col("row"), [F.col("row")], "slot").drop("row", "group")
