"""Chat formatting as prefix trees of tokens.

Conversations that begin with the same turns share them. Sorted by the digests of their turns, conversations lie in
the depth-first order of the tree they form, so a task that reads a sorted range writes each shared turn once:
a new conversation goes on from the turns it has in common with the one before. Trees come in parts of bounded size.
A part that goes on with a tree does not write the turns above it again, it names them by their keys, also where the
part before it was another task's. A part has token ids, a position id for each, and its nodes, one for each turn:
where it lies, the earlier intervals it may attend to, and what of it is under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b64decode
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, in_arrow, stored

# What a text must not hold unescaped, the template's own marks first.
TURN, TEXT, END = "[TURN]", "[TEXT]", "</s>"
CONTROL = (TURN, TEXT, END, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED_ROLE = "assistant"
PART_IDS = 1 << 18
# Tasks that the parts which need one hot turn are spread over.
_SPREAD = 64
_BEGINS = re.compile(r"([\[<])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_ESCAPES = re.compile(r"\\(\\?)")
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)
_BLOCK = 1 << 16
_ROWS = 256

_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_HELD = pa.struct([("key", pa.binary()), ("position", pa.int64()), ("length", pa.int64()), ("loss", _INTERVAL)])
_NODE = pa.struct(
    [
        ("key", pa.binary()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("position", pa.int64()),
        ("parent", pa.int64()),
        ("held", pa.int64()),
        ("attends", pa.list_(_INTERVAL)),
        ("loss", _INTERVAL),
    ]
)
_LEAF = pa.struct([("path", pa.string()), ("node", pa.int64())])
_PART = pa.schema(
    [
        ("task", pa.int32()),
        ("nth", pa.int64()),
        ("ids", pa.list_(pa.int32())),
        ("positions", pa.list_(pa.int32())),
        ("held", pa.list_(_HELD)),
        ("nodes", pa.list_(_NODE)),
        ("leaves", pa.list_(_LEAF)),
        ("first", pa.list_(pa.binary())),
        ("last", pa.list_(pa.binary())),
    ]
)
_SPAN = "struct<start: bigint, end: bigint>"
_DRAFT = (
    "task int, nth bigint, ids array<int>, positions array<int>, "
    f"held array<struct<key: binary, position: bigint, length: bigint, loss: {_SPAN}>>, "
    "nodes array<struct<key: binary, start: bigint, end: bigint, position: bigint, parent: bigint, held: bigint, "
    f"attends: array<{_SPAN}>, loss: {_SPAN}>>, "
    "leaves array<struct<path: string, node: bigint>>, first array<binary>, last array<binary>"
)


def escape(text: str) -> str:
    """Backslashes doubled, and a single one set into each control string."""
    return _BEGINS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPES.sub(r"\1", text)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


@dataclass(frozen=True)
class Ranks:
    """A byte-level vocabulary: a file with a token in base64 and its id on each line, and how texts are split first."""

    path: str
    pattern: str


class _Tokens:
    """Texts to ids and back without loss: the vocabulary has all bytes, and no string of a text is special."""

    def __init__(self, ranks: Ranks):
        import tiktoken

        with open(ranks.path, "rb") as lines:
            known = {b64decode(token): int(i) for token, i in (line.split() for line in lines if line.strip())}
        if any(bytes([b]) not in known for b in range(256)):
            raise ValueError("the vocabulary does not have all bytes")
        self.coder = tiktoken.Encoding("chat", pat_str=ranks.pattern, mergeable_ranks=known, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Blocks of a long text are encoded each on its own, as what the pattern looks through must be bounded."""
        blocks = (text[low : low + _BLOCK] for low in range(0, len(text), _BLOCK))
        return np.array([i for block in blocks for i in self.coder.encode_ordinary(block)], np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode()


@lru_cache(maxsize=2)
def tokens(ranks: Ranks) -> _Tokens:
    """One for each worker process and vocabulary."""
    return _Tokens(ranks)


@dataclass
class _Turn:
    """A turn of the path that is open: its node in the part being written, or None if an earlier part has it."""

    key: bytes
    position: int
    length: int
    loss: dict | None  # counted from the turn's first token
    node: int | None


class _Forest:
    """Writes trees in parts: conversations come in depth-first order."""

    def __init__(self, own: _Tokens, part_ids: int):
        self.own, self.part_ids = own, part_ids
        self.digests: list[bytes] = []  # of the path that is open
        self.open: list[_Turn] = []  # its turns
        self.nth = -1
        self._begin()

    def _begin(self) -> None:
        """A new part, which holds nothing of the turns that are open."""
        self.nth += 1
        self.held = [_above(t.key, t.position, t.length, t.loss) for t in self.open]
        for turn in self.open:
            turn.node = None
        self.ids: list[np.ndarray] = []
        self.positions: list[np.ndarray] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []

    def add(self, path: str, digests: list[bytes], turns: list[tuple[str, str]]) -> dict | None:
        """The part before, if this conversation begins another."""
        shared = 0
        while shared < min(len(digests), len(self.digests)) and digests[shared] == self.digests[shared]:
            shared += 1
        done = None
        if self.leaves and (not shared or self.size >= self.part_ids):
            done = self.part()
            del self.open[shared:]
            self._begin()
        if not self.leaves:
            self.first = digests
        del self.open[shared:]
        for digest, (role, text) in zip(digests[shared:], turns[shared:], strict=True):
            before = self.own.encode(f"{TURN}{escape(role)}{TEXT}")
            self._write(digest, before, self.own.encode(escape(text)), self.own.encode(END), role == LEARNED_ROLE)
        self.digests = digests
        self.leaves.append({"path": path, "node": self.open[-1].node if self.open else None})
        return done

    def _write(self, digest: bytes, before: np.ndarray, said: np.ndarray, after: np.ndarray, learned: bool) -> None:
        above = self.open[-1] if self.open else None
        parent = self.nodes[above.node] if above and above.node is not None else None
        length, start = len(before) + len(said) + len(after), self.size
        position = above.position + above.length if above else 0
        key = hashlib.md5((above.key if above else b"") + digest).digest()
        loss = {"start": len(before), "end": len(before) + len(said)} if learned else None
        self.nodes.append(
            {
                "key": key,
                "start": start,
                "end": start + length,
                "position": position,
                "parent": above.node if above else None,
                "held": parent["held"] if parent else len(self.open),
                "attends": _with_interval(parent["attends"], parent["start"], parent["end"]) if parent else [],
                "loss": {"start": start + loss["start"], "end": start + loss["end"]} if loss else None,
            }
        )
        self.open.append(_Turn(key, position, length, loss, len(self.nodes) - 1))
        self.ids += [before, said, after]
        self.positions.append(np.arange(position, position + length, dtype=np.int32))
        self.size += length

    def part(self) -> dict:
        return {
            "nth": self.nth,
            "ids": np.concatenate([np.zeros(0, np.int32), *self.ids]),
            "positions": np.concatenate([np.zeros(0, np.int32), *self.positions]),
            "held": self.held,
            "nodes": self.nodes,
            "leaves": self.leaves,
            "first": self.first if not self.nth else None,
            "last": self.digests,
        }


def _above(key: bytes, position: int, length: int, loss: dict | None) -> dict:
    return {"key": key, "position": position, "length": length, "loss": loss}


def _with_interval(intervals: list[dict], start: int, end: int) -> list[dict]:
    if intervals and intervals[-1]["end"] == start:
        return [*intervals[:-1], {"start": intervals[-1]["start"], "end": end}]
    return [*intervals, {"start": start, "end": end}]


def _moved(span: dict, by: int) -> dict:
    return {"start": span["start"] - by, "end": span["end"] - by}


def _without_first(part: dict, turns: int) -> dict:
    """The part without its first turns, which an earlier part has: the first conversation writes its own in order."""
    gone, nodes = part["nodes"][:turns], []
    cut = gone[-1]["end"]
    for node in part["nodes"][turns:]:
        parent, held = node["parent"], 0
        if parent is not None:
            held = parent + 1 if parent < turns else nodes[parent - turns]["held"]
            parent = parent - turns if parent >= turns else None
        seen = [{"start": max(s["start"], cut), "end": s["end"]} for s in node["attends"] if s["end"] > cut]
        nodes.append(
            {
                **node,
                **_moved(node, cut),
                "parent": parent,
                "held": held,
                "attends": [_moved(s, cut) for s in seen],
                "loss": _moved(node["loss"], cut) if node["loss"] else None,
            }
        )
    held = [
        _above(n["key"], n["position"], n["end"] - n["start"], _moved(n["loss"], n["start"]) if n["loss"] else None)
        for n in gone
    ]
    leaves = [{"path": f["path"], "node": None if f["node"] is None else f["node"] - turns} for f in part["leaves"]]
    short = {"ids": part["ids"][cut:], "positions": part["positions"][cut:]}
    return {**part, **short, "held": held, "nodes": nodes, "leaves": leaves}


def _batches(parts: Iterator[dict], part_ids: int = PART_IDS) -> Iterator[pa.RecordBatch]:
    """Small parts go together, up to as many ids as one of full size has."""
    lot, size = [], 0
    for part in parts:
        lot.append(part)
        size += len(part["ids"])
        if size >= part_ids or len(lot) >= _ROWS:
            yield _batch(lot)
            lot, size = [], 0
    if lot:
        yield _batch(lot)


def _batch(parts: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([part[field.name] for part in parts], field.type) for field in _PART]
    return pa.RecordBatch.from_arrays(columns, schema=_PART)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, with ids and positions as arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            found = row.drop_columns(["ids", "positions"]).to_pylist()[0]
            for name in ("ids", "positions"):
                found[name] = row.column(name).flatten().to_numpy()
            yield found


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, path (digest of all turns), turns of rows (conv_id, turn, role, text).

    A conversation's turns are in the order of ``turn``, null first, equal ones by role and text. Null roles and texts
    are empty; a null conv_id is a conversation. Repeated rows are repeated turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    said = ordered.select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )
    return said.withColumn("path", F.sha2(F.to_json("turns"), 256))


def trees(conversations: DataFrame, ranks: Ranks, part_ids: int = PART_IDS) -> DataFrame:
    """part, ids, positions, held, nodes, leaves of the prefix trees of conversations (path, turns), each path once.

    Each turn of a tree is in one part, however many tasks and parts the tree is cut into. A part ends where the first
    turn changes, or when it has ``part_ids`` tokens and its conversation ends, so a very long conversation makes a
    long part. ``held`` are the turns above, which earlier parts have, from the root on: key, first position, length,
    and the loss in tokens from the turn's start. A node's ``held`` says how many of them it goes on from; ``parent``
    and ``attends`` are of the part's own. Intervals and loss are counted in tokens. An empty table gives no parts.

    Each turn's mark with its role, its text and its end are encoded on their own, a text in blocks of _BLOCK characters.
    """
    digest = F.transform("turns", lambda t: F.unhex(F.md5(F.concat(F.length(t["role"]), F.lit(":"), t["role"], t["text"]))))
    ordered = conversations.select("path", "turns").dropDuplicates(["path"]).withColumn("order", digest)
    dealt = ordered.repartitionByRange("order", "path").sortWithinPartitions("order", "path")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        task = {"task": TaskContext.get().partitionId()}
        forest = _Forest(tokens(ranks), part_ids)
        for batch in batches:
            for row in batch.to_pylist():
                done = forest.add(row["path"], row["order"], [(t["role"], t["text"]) for t in row["turns"]])
                if done:
                    yield done | task
        if forest.leaves:
            yield forest.part() | task

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(written(batches))

    return _joined(stored(in_arrow(dealt, write, _DRAFT), "drafts"))


def _joined(drafts: DataFrame) -> DataFrame:
    """Parts of all tasks: the first of a task does without the turns that the task before it has written already.

    Two paths of digests for each task are all that meets in one place.
    """
    ends = drafts.groupBy("task").agg(F.max("first").alias("first"), F.max_by("last", "nth").alias("last"))
    before = F.lag("last").over(Window.orderBy("task"))
    alike = F.zip_with("first", "before", F.equal_null)
    unlike = F.array_position(alike, F.lit(False))
    # Paths of different lengths differ where the shorter one ends, as the longer is compared with null there.
    shared = F.when(F.col("before").isNull(), 0).when(unlike > 0, unlike - 1).otherwise(F.size("first"))
    borders = ends.withColumn("before", before).select("task", F.lit(0).cast("bigint").alias("nth"), shared.cast("bigint").alias("shared"))
    told = drafts.join(F.broadcast(stored(borders, "borders")), ["task", "nth"], "left")
    kept = told.where("coalesce(shared, 0) = 0").select(*drafts.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_without_first(part, part["shared"]) for part in _rows(batches))

    whole = kept.unionByName(in_arrow(told.where("shared > 0"), cut, _DRAFT))
    return whole.select(F.concat_ws("-", "task", "nth").alias("part"), "ids", "positions", "held", "nodes", "leaves")


def _turns_above(found: DataFrame) -> DataFrame:
    """part, above: the ids of each turn that a part holds elsewhere, from the root on."""
    asked = found.select("part", F.posexplode("held").alias("place", "turn"))
    asked = stored(asked.select("part", "place", F.col("turn.key").alias("key")), "held")

    def last_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a later part can go on from is above the last conversation of this one, or is it.
        for part in _rows(batches):
            on_path = _ancestry(part["nodes"], part["leaves"][-1]["node"])
            ids = [part["ids"][n["start"] : n["end"]] for n in on_path]
            columns = [pa.array([n["key"] for n in on_path], pa.binary()), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids"])

    turns = in_arrow(found.select("ids", "positions", "nodes", "leaves"), last_path, "key binary, ids array<int>")
    least = max(2, int(asked.count() * HOT_SHARE))
    # At most 1 / HOT_SHARE keys, however many parts there are.
    hot = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("key", F.lit(True).alias("hot"))
    hot = F.broadcast(hot)
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("part"), F.lit(_SPREAD))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(_SPREAD - 1))).otherwise(F.array(F.lit(0)))
    here = asked.join(hot, "key", "left").select("part", "place", "key", spread.alias("salt"))
    there = turns.join(asked.select("key").distinct(), "key", "left_semi").join(hot, "key", "left")
    there = there.select("key", "ids", F.explode(copies).alias("salt"))
    known = here.join(there, ["key", "salt"]).groupBy("part")
    return known.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "ids"))), lambda t: t["ids"]).alias("above"))


def read_back(found: DataFrame, ranks: Ranks) -> DataFrame:
    """path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each leaf, from the parts alone.

    ``found`` is gone through three times. Parts that hold turns elsewhere get them by their keys.
    """
    no_turns = F.array().cast("array<array<int>>")
    held = found.where("size(held) > 0").join(_turns_above(found), "part")
    whole = found.where("size(held) = 0").withColumn("above", no_turns).unionByName(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(ranks)
        for part in _rows(batches):
            ids, nodes = part["ids"], part["nodes"]
            above = [np.array(turn, np.int32) for turn in part["above"]]
            columns: list[list] = [[] for _ in names]
            for leaf in part["leaves"]:
                shown, learned = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
                if leaf["node"] is not None:
                    node = nodes[leaf["node"]]
                    spans = _with_interval(node["attends"], node["start"], node["end"])
                    for turn, what in zip(above[: node["held"]], part["held"], strict=False):
                        shown.append(turn)
                        if what["loss"]:
                            learned.append(turn[what["loss"]["start"] : what["loss"]["end"]])
                    shown += [ids[s["start"] : s["end"]] for s in spans]
                    loss = [n["loss"] for n in _ancestry(nodes, leaf["node"]) if n["loss"]]
                    learned += [ids[s["start"] : s["end"]] for s in loss]
                formatted = own.decode(np.concatenate(shown))
                turns, answers = parsed(formatted), unescape(own.decode(np.concatenate(learned)))
                said = "".join(f"{role}\n{what}\n" for role, what in turns)
                values = (leaf["path"], len(turns), _digest(said), len(answers), _digest(answers), len(formatted))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return in_arrow(
        whole,
        run,
        "path string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint",
    )


def _ancestry(nodes: list[dict], node: int | None) -> list[dict]:
    """From the first of the part's own above the node to the node."""
    found = []
    at = node
    while at is not None:
        found.append(nodes[at])
        at = nodes[at]["parent"]
    return found[::-1]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def formatted(rows: DataFrame, ranks: Ranks, part_ids: int = PART_IDS) -> tuple[DataFrame, DataFrame]:
    """Parts of the trees of all conversations of rows (conv_id, turn, role, text), and the path of each conversation."""
    known = stored(paths(rows.select("conv_id", "turn", "role", "text")), "conversations")
    return trees(known, ranks, part_ids), known.select("conv_id", "path")
