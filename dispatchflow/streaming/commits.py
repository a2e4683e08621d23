"""The commit log of file outputs: which batches a reader may see.

A batch's folders can be there in part: one output written, the other not, or a try that failed. So a batch counts
only once a manifest for it stands in the log, and the manifest is written after everything else. Batches of a run
are committed in their order, so what a reader may see of a run is all up to its last committed batch: one number for
each run, whatever the number of batches, and a filter on partition columns that Spark applies to folders.

A run's manifests go to two places in turn. While one is written anew the other holds the commit before, so a reader
always finds one, and the log does not grow with the batches. Several outputs of one query share a log; the others
hold a note of where it is. A committed batch is not written again: if it comes once more, after a failure between the
manifest and the checkpoint, its folders stay as they are and no reader loses them for a moment.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchflow.schemas import schema

MANIFEST = schema("output string, columns string, batch_id long")
_PLACED = T.StructType([*MANIFEST, T.StructField("run", T.StringType()), T.StructField("slot", T.IntegerType())])
# Names that begin with an underscore are no data to Spark's readers.
_LOG, _NOTE = "_commits", "_commits_at"


def _read(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame | None:
    """A small JSON table; None if there is none yet."""
    try:
        return spark.read.schema(fields).option("ignoreMissingFiles", "true").json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


@dataclass(frozen=True)
class CommitLog:
    """The log in a folder."""

    path: str

    @classmethod
    def of(cls, output: str) -> CommitLog:
        """The log that stands in an output's own folder."""
        return cls(f"{output.rstrip('/')}/{_LOG}")

    @classmethod
    def found(cls, spark: SparkSession, output: str) -> CommitLog:
        """The log that an output belongs to: its own, or the one its note names."""
        note = _read(spark, f"{output.rstrip('/')}/{_NOTE}", schema("log string"))
        said = note.first() if note is not None else None
        return cls(said["log"]) if said else cls.of(output)

    def note(self, spark: SparkSession, output: str) -> None:
        """Say in an output's folder that this is its log. An output stays with the log it began with."""
        if self == CommitLog.of(output) or CommitLog.found(spark, output) == self:
            return
        if CommitLog.of(output).manifests(spark) is not None or CommitLog.found(spark, output) != CommitLog.of(output):
            raise ValueError(f"{output} belongs to another commit log")
        frame = spark.createDataFrame([(self.path,)], schema("log string")).coalesce(1)
        frame.write.mode("overwrite").json(f"{output.rstrip('/')}/{_NOTE}")

    def manifests(self, spark: SparkSession) -> DataFrame | None:
        """output, columns (its schema as JSON), batch_id, run, slot: for each output, the last two commits of each run."""
        return _read(spark, self.path, _PLACED)

    def last(self, spark: SparkSession, run: str) -> int:
        """The last batch that a run has committed, -1 before the first."""
        there = self.manifests(spark)
        found = there.where(F.col("run") == run).agg(F.max("batch_id")).first()[0] if there is not None else None
        return -1 if found is None else found

    def commit(self, spark: SparkSession, run: str, batch_id: int, outputs: dict[str, T.StructType]) -> None:
        """Let readers see a batch whose outputs (folder and schema) are all written."""
        rows = [(folder.rstrip("/"), fields.json(), batch_id) for folder, fields in outputs.items()]
        manifest = spark.createDataFrame(rows, MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").json(f"{self.path}/run={run}/slot={batch_id % 2}")

    def seen(self, spark: SparkSession) -> tuple[dict[str, int], dict[str, T.StructType]]:
        """The last committed batch of each run, and the newest schema of each output. Read once: a few rows for each run."""
        there = self.manifests(spark)
        rows = sorted(there.collect(), key=lambda row: row.batch_id) if there is not None else []
        shapes = {row.output: T.StructType.fromJson(json.loads(row["columns"])) for row in rows}
        return {row.run: row.batch_id for row in rows}, shapes


@dataclass
class Commits:
    """The commits of one query: what its run is called and how far it has come is read once."""

    log: CommitLog
    checkpoint: str
    run: str | None = None
    last: int = -1

    def open(self, spark: SparkSession, batch_id: int) -> bool:
        """Whether a batch is still to be written."""
        if self.run is None:
            # A short name for the query that the checkpoint belongs to: it has written its id there when it started.
            said = spark.read.text(f"{self.checkpoint.rstrip('/')}/metadata").first()[0]
            self.run = hashlib.sha256(said.encode()).hexdigest()[:16]
            self.last = self.log.last(spark, self.run)
        return batch_id > self.last

    def place(self, folder: str, batch_id: int) -> str:
        """The folder of a batch in an output: the run's and the batch's own, since every checkpoint counts from 0."""
        return f"{folder.rstrip('/')}/run={self.run}/batch_id={batch_id}"

    def done(self, spark: SparkSession, batch_id: int, outputs: dict[str, T.StructType]) -> None:
        self.log.commit(spark, self.run, batch_id, outputs)
        self.last = batch_id


def up_to(runs: dict[str, int]) -> Column:
    """Whether a row (run, batch_id) is of a committed batch."""
    allowed = F.lit(False)
    for run, last in sorted(runs.items()):
        allowed = allowed | ((F.col("run") == run) & (F.col("batch_id") <= last))
    return allowed
