"""Session settings and storage shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Spark guesses a scan's size from its compressed files, and keys in zstd Parquet take some eighty times as much once they are broadcast: up to so many bytes of files
#: a table is broadcast unseen; a larger one only where it has been shuffled and measured.
UNSEEN_BROADCAST = 256 << 10
#: Bytes of files that one task reads and of shuffled rows that one task takes at most, for the same reason: ids fill some ten to twenty times as much in a task's sorters and hash tables.
TASK_FILES, TASK_SHUFFLED = 16 << 20, 32 << 20
#: Parts of a shuffle before small ones are joined to ``TASK_SHUFFLED``: with a few fixed parts a task would grow with the table. Up to 200 are written without a sort in memory.
SHUFFLE_PARTS = 200


def build_session(name: str = "strataweave", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; every value may be overridden."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": str(UNSEEN_BROADCAST),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()


def measured_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings of ``spark``, in which a table is broadcast by its measured size, not by that of its files, and tasks take so many bytes at most, however large the tables are.

    ``spark`` is left as it is. A threshold that is lower already stays, and so does a number of initial parts.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    most = spark.conf.get(static)
    if not most.startswith("-") and in_bytes(most) > UNSEEN_BROADCAST:
        own.conf.set(adaptive, spark.conf.get(adaptive, None) or most)
        own.conf.set(static, str(UNSEEN_BROADCAST))
    for key, bound in (("spark.sql.files.maxPartitionBytes", TASK_FILES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_SHUFFLED)):
        if in_bytes(spark.conf.get(key)) > bound:
            own.conf.set(key, str(bound))
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if not spark.conf.get(parts, None):
        own.conf.set(parts, str(max(SHUFFLE_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return own


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the one set on the context.

    Only where neither is set on one machine (tests) is a temporary folder made and set; on a cluster, whose machines would each have a
    folder of their own, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="strataweave-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = f"file://{found}"
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, and unlike a cached frame it survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def _file_system(stored: DataFrame):
    context = stored.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def discard(stored: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    files, path = _file_system(stored)
    files.delete(path, True)


def exists(stored: DataFrame) -> bool:
    """Whether what ``materialize`` wrote is still there."""
    files, path = _file_system(stored)
    return files.exists(path)


def in_bytes(size: str) -> int:
    """Bytes of a size as Spark's settings give it, such as 750m or 8g."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)b?\s*", size.lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def megabytes(size: str) -> int:
    """MB of a size as Spark's settings give it."""
    return in_bytes(size) >> 20


def ship_package(spark: SparkSession) -> None:
    """Give executors this package where they would not find it on their own path."""
    root = Path(__file__).resolve().parent
    parent = str(root.parent)
    known = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p is not None]
    context = spark.sparkContext
    if parent in known or getattr(context, "_strataweave_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='strataweave-')}/strataweave", "zip", parent, root.name)
    context.addPyFile(archive)
    context._strataweave_shipped = True
