"""Sessions, and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(
    app: str,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings these jobs rely on.

    Streaming state goes to RocksDB with changelog checkpoints, so that it lives off the heap and a batch
    uploads only what it changed.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in (settings | (conf or {})).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def state_partitions(spark: SparkSession) -> int:
    """How many partitions a new streaming query keeps its state in.

    The number is fixed for the life of a checkpoint and AQE does not adapt it. It is the session's
    ``spark.sql.shuffle.partitions``, whatever that is; what happens to be up when a query starts plays no part.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def streaming_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A child session for one streaming query: the caller's settings, its own state partitions.

    A query copies its session's settings when it starts, so the number of state partitions has to be set
    on the session; a child session leaves the caller's as it is.
    """
    wanted = partitions or state_partitions(spark)
    child = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            child.conf.set(name, value)
    child.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return child


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers of all executors, once for a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_package_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._package_shipped = True


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder, under ``spark.checkpoint.dir``, that every executor can reach.

    Without that setting a local session gets a temporary folder; on a cluster a folder of one machine
    would lose data, so there the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="dispatchflow-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
