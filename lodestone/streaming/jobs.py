"""Streaming jobs: deduplicated appends, windowed counts with late data, sustained conditions, keyed latest state.

Each job reads a file source, runs until what is there is read (trigger availableNow) and writes Parquet with a checkpoint in the shared
folder; started again with the same folders it goes on where it stopped, and what was written is not written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import folder


def source(spark: SparkSession, path: str, name: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the Parquet table name in path, a file or a folder of files, with the schema that it has now."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    is_folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/{name}").schema).option("maxFilesPerTrigger", files_at_once)
    return stream.parquet(f"{path}/{name}") if is_folder else stream.option("pathGlobFilter", name).parquet(path)


def run(stream: DataFrame, mode: str = "append", target: str | None = None) -> DataFrame:
    """Runs stream over all that is there, however long that takes, and gives what it wrote."""
    spark = stream.sparkSession
    target = target or folder(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/out")


def deduplicated(stream: DataFrame, identity: list[str], time: str, horizon: str) -> DataFrame:
    """The first row of each identity; an identity is forgotten horizon after its time."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(identity)


def windowed(stream: DataFrame, keys: list[str], time: str, length: str, late: str) -> DataFrame:
    """keys, start, n: rows per tumbling window, given out once no row of the window may come any more."""
    w = F.window(time, length)
    return stream.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def each_batch(stream: DataFrame, change: Callable[[DataFrame, int], None], target: str | None = None) -> None:
    """Gives every micro-batch to change(batch, number), which must do the same if it sees a number again."""
    target = target or folder(stream.sparkSession, "batches")
    query = stream.writeStream.foreachBatch(change).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    query.awaitTermination()


STATE = T.StructType([T.StructField("since", T.LongType()), T.StructField("last", T.LongType()), T.StructField("samples", T.LongType())])
OUT = "key string, start_us long, end_us long, samples long"


def sustained_state(key: tuple, batches: Iterator[pd.DataFrame], state, least_us: int, reset_us: int) -> Iterator[pd.DataFrame]:
    """For applyInPandasWithState: stretches in which ok held at every sample, given out when they end."""
    since, last, samples = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values("at_us")
    out = []

    def close() -> None:
        if since is not None and last - since >= least_us:
            out.append((str(key[0]), since, last, samples))

    for at, ok in zip(rows["at_us"].tolist(), rows["ok"].tolist()):
        if not ok or (last is not None and at - last > reset_us):
            close()
            since, samples = None, 0
        if ok:
            since = at if since is None else since
            samples += 1
        last = at
    state.update((since, last, samples))
    yield pd.DataFrame(out, columns=["key", "start_us", "end_us", "samples"])


def sustained(stream: DataFrame, key: str, least_us: int, reset_us: int) -> DataFrame:
    """key, start_us, end_us, samples of ended stretches of stream (key, at_us, ok); rows of a key must come in order between batches."""

    def step(k, batches, state):
        yield from sustained_state(k, batches, state, least_us, reset_us)

    return stream.groupBy(key).applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
