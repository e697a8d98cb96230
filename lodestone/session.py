"""Session helpers: a builder with the settings the library expects, lineage cuts, and worker imports."""

from __future__ import annotations

import importlib
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings the session."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    """Has the file system remove a folder when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints within spark.checkpoint.dir, which all executors share; a folder of ours only in local mode.

    What is set here is removed when the driver ends.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        sc.setCheckpointDir(shared)
        _remove_at_end(spark, sc._jsc.sc().getCheckpointDir().get())
    return sc._jsc.sc().getCheckpointDir().get()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder within the shared checkpoint folder, which is removed when the driver ends."""
    at = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _remove_at_end(spark, at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df to the shared checkpoint folder and reads it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder: smaller than a checkpoint where strings repeat, and read by column.

    The table is removed when the driver ends.
    """
    at = folder(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan of few partitions laid out by keys over all cores, for work that costs more than moving its rows.

    A scan with at least as many partitions as there are cores stays as it is: beyond some megabytes a core nothing is moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def worker(module: str, name: str, *args) -> Callable:
    """A function for mapInPandas that imports module in the worker and runs module.name(batches, *args).

    The module is imported, not pickled, so that what it keeps per process (vocabularies, models) is built once a worker.
    """
    root = ROOT

    def run(batches):
        if root not in sys.path:
            sys.path.append(root)
        yield from getattr(importlib.import_module(module), name)(batches, *args)

    return run


def prepare_workers(spark: SparkSession) -> None:
    """On a cluster, sends the package to the executors through the shared folder, on whatever file system it is; nothing to do in local mode."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_lodestone_sent", False):
        return
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(os.path.join(ROOT, "lodestone")):
            for f in files:
                if not f.endswith(".pyc"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), ROOT))
    send(spark, f"{ensure_checkpoint_dir(spark)}/lodestone-{sc.applicationId}.zip", data.getvalue())
    sc._lodestone_sent = True


def send(spark: SparkSession, target: str, data: bytes) -> None:
    """Writes a package to target, a path of any Hadoop file system, and has all workers import from it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addPyFile(target)
