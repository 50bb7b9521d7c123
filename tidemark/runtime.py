"""What every query needs of its session: importable workers, bounded Arrow batches, shared scratch space.

``scratch_dir`` and ``cut`` follow the cluster's ``spark.checkpoint.dir``, or else the folder that the context's
checkpoints go to. Only where neither is set and the master is local (a laptop, a test) do they fall back to a folder of
their own on the local disk; on a cluster that raises.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Rows of one Arrow batch; with texts of a few KB this keeps a batch at a few MB, and bytes bound the rest.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
#: A join broadcasts no file above the first size (its rows are larger), no shuffled rows above the second: what is
#: broadcast passes through the driver, in every step anew.
BROADCAST_FILE, BROADCAST_ROWS = 256 << 10, 1 << 20
#: What one part of a spread table is meant for, in bytes of its file; grouped in memory, these are about a hundredfold.
PART_BYTES = 1 << 20
_FOLDER: ContextVar[str] = ContextVar("folder", default="")
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
_BROADCAST_LATER = "spark.sql.adaptive.autoBroadcastJoinThreshold"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound Arrow batches and broadcasts, name a checkpoint folder; idempotent."""
    sc = spark.sparkContext
    parts = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    allowed = _bytes(spark.conf.get(_BROADCAST))
    later = _bytes(spark.conf.get(_BROADCAST_LATER, None) or str(allowed))
    if later > BROADCAST_ROWS:
        spark.conf.set(_BROADCAST_LATER, str(BROADCAST_ROWS))
    if allowed > BROADCAST_FILE:
        spark.conf.set(_BROADCAST, str(BROADCAST_FILE))
    scratch_dir(spark)
    return spark


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` shuffled by the columns ``by`` into as many parts as its size asks for, so that what a task groups by them
    doesn't grow with the table; where one part will do, as it is."""
    parts = math.ceil(plan_bytes(df) / PART_BYTES)
    return df if parts <= 1 else df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *by)


def _bytes(setting: str) -> int:
    """Bytes of a size setting such as 64m or 1048576b."""
    digits = setting.strip().lower().removesuffix("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    return int(digits[:-1] if scale else digits) << scale


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = getattr(sc, "_tidemark_scratch", None)
    if held is None:
        held = sc.getCheckpointDir()
        if held is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            held = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            sc.setCheckpointDir(held + "/checkpoints")
        sc._tidemark_scratch = held
    return held


@contextmanager
def written_under(folder: str) -> Iterator[None]:
    """Tables that ``cut`` writes meanwhile, in this thread, go to a folder of that name, which ``forget`` deletes."""
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)


def forget(spark: SparkSession, folder: str) -> None:
    """Delete the tables written under ``folder``; what still reads them fails from then on."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/cut/{folder}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Bytes of a plan's rows as the optimiser estimates them; those of its files for a table just written."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and return the written table: lineage ends there.

    The table survives lost executors, carries true size statistics for later joins, and the shuffle
    files of the plan that made it can go as soon as it is written.
    """
    spark = df.sparkSession
    path = "/".join(filter(None, [scratch_dir(spark), "cut", _FOLDER.get(), uuid.uuid4().hex]))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
