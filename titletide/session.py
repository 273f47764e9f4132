"""Session helpers: settings for a local run, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings a session of its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("titletide")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.titletide.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, else the one its context was given.

    Only a run inside one machine may go without: it gets a temporary folder, removed when Python ends. Anywhere else a
    missing setting is an error, as a folder of one machine is invisible to the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="titletide-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def forget(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared store, wherever it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows written as Parquet under the shared folder and read back: a lineage cut that keeps column pruning
    and statistics, survives lost executors and is read as often as needed. Removed when Python ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    atexit.register(_forget_quietly, spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def _forget_quietly(spark: SparkSession, folder: str) -> None:
    """At the end of Python, when the session may be gone already: a mounted folder needs no session."""
    local = re.sub("^file:/+", "/", folder)
    if local.startswith("/"):
        shutil.rmtree(local, ignore_errors=True)
    else:
        with contextlib.suppress(Exception):
            forget(spark, folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows read back from a reliable checkpoint, so that loops do not grow the plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
