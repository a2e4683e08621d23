"""Descriptions for codes: a left join with the code table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchflow.config import CALLS, CountSpec

#: Largest code table that is broadcast, in rows and in bytes of text.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
JOINS = ("left", "inner", "left_semi", "left_anti", "right", "full")


@dataclass(frozen=True)
class CodeTableSize:
    """Measured size of a code table."""

    rows: int
    text_bytes: int

    @property
    def broadcastable(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.text_bytes <= BROADCAST_BYTES


def check_codes(codes: DataFrame, spec: CountSpec = CALLS) -> CodeTableSize:
    """Measure a code table; fail if a code stands in it twice, since the join would multiply counts."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in codes.columns), F.lit(0))
    found = codes.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(spec.code_col).alias("named"),
        F.count_distinct(spec.code_col).alias("codes"),
        F.coalesce(F.sum(size), F.lit(0)).alias("text_bytes"),
    ).first()
    if found["named"] != found["codes"]:
        raise ValueError(f"{found['named'] - found['codes']} rows repeat a {spec.code_col} of the code table")
    return CodeTableSize(rows=found["rows"], text_bytes=found["text_bytes"])


def check_how(how: str, streaming: bool) -> None:
    """Fail on a join that is not known, or that a stream cannot have.

    A right or full join gives codes that no count has. On a stream such a code could only be given when the stream
    has ended, and batch by batch it would come with every batch: so it is refused before a query starts.
    """
    if how not in JOINS:
        raise ValueError(f"a join with the codes is one of {', '.join(JOINS)}, not {how}")
    if streaming and how in ("right", "full"):
        raise ValueError(f"a stream has no {how} join with the codes: it never knows which codes stay without counts")


def with_descriptions(
    counts: DataFrame,
    codes: DataFrame,
    spec: CountSpec = CALLS,
    size: CodeTableSize | None = None,
    salts: int = 16,
    how: str = "left",
) -> DataFrame:
    """Every count with its code's description, null where the code is unknown.

    ``how`` may also be ``inner`` (only known codes), ``left_semi`` (the same without a description), ``left_anti``
    (only unknown codes, without one), or in batch ``right`` and ``full`` (codes that no count has, too).

    The code table is broadcast when its measured size allows. Otherwise the join shuffles, with the
    counts of one code spread over ``salts`` sub-keys and each code repeated for them, so that a hot code
    does not end in one task.
    """
    check_how(how, counts.isStreaming)
    size = size or check_codes(codes, spec)
    # What is kept whole cannot be broadcast, and its rows may not be repeated for salts.
    if how in ("right", "full"):
        return counts.join(codes, on=spec.code_col, how=how)
    if size.broadcastable:
        return counts.join(F.broadcast(codes), on=spec.code_col, how=how)
    others = [c for c in counts.columns if c != spec.code_col]
    salted = counts.withColumn("salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    spread = codes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, on=[spec.code_col, "salt"], how=how).drop("salt")
