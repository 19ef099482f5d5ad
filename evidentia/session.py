"""Session defaults, the shared scratch folder, and shipping of this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED_ATTR = "_evidentia_shipped"
#: Rows that a Python worker holds at a time, unless the cluster sets its own number: texts can be long.
BATCH_ROWS = "2000"
#: Rows of a large table for which an exchange has a part of its own, unless the cluster sets its own number of parts.
PART_ROWS = 250_000
_PARTS_KEY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes up to which small parts are joined then, and bytes of a file that a task reads: keys pack well, and a task holds
#: ten times as much.
PART_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "32m"}
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cpus: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evidentia")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is configured and all runs in one process."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="evidentia-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared folder."""
    return f"{scratch_root(spark)}/evidentia-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a columnar table to the shared folder and read it back (column pruning stays possible)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def forget(table: DataFrame) -> None:
    """Delete the files of a `written` table that nothing reads any more."""
    spark, path = table.sparkSession, table._scratch
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sized(table: DataFrame) -> DataFrame:
    """The table; exchanges begin with a part for every PART_ROWS of its rows, so that what a task sorts or sums does not
    grow with the table. The adaptive planner joins small parts, and the number never falls below that of the session."""
    spark = table.sparkSession
    if not spark.sparkContext.getConf().contains(_PARTS_KEY):
        known = max(int(spark.conf.get(key, "1")) for key in ("spark.sql.shuffle.partitions", _PARTS_KEY))
        parts = -(-table.count() // PART_ROWS)
        if parts > known:
            spark.conf.set(_PARTS_KEY, str(parts))
            for key, size in PART_BYTES.items():
                if not spark.sparkContext.getConf().contains(key):
                    spark.conf.set(key, size)
    return table


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' Python path, once per context, and keep Python batches small."""
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH_KEY):
        spark.conf.set(_BATCH_KEY, BATCH_ROWS)
    if getattr(context, _SHIPPED_ATTR, False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="evidentia-ship-"), "evidentia_src.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"evidentia/{path.relative_to(root)}")
    context.addPyFile(target)
    setattr(context, _SHIPPED_ATTR, True)
