"""Objects in storage: listings, ranges and generations over any Hadoop file system (file:, s3a:, gs:, abfss:)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.catalog import cursor, cursor_key, keyset_page


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """key, size, modified, generation of the objects under root whose key begins with the literal prefix; contents are not read.

    Only the folder that the prefix names is listed. Objects without bytes do not come out, as Spark's file sources pass over empty files.
    """
    base, step = root.rstrip("/"), prefix.rpartition("/")[0]
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{step}" if step else base)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "key string, size long, modified timestamp, generation string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{base}/{step}" if step else base).select("path", "modificationTime", "length")
    plain = F.lit(base.split(":", 1)[-1].lstrip("/") if ":" in base.split("/")[0] else base.lstrip("/"))
    key = F.expr("substring(path, instr(path, __at) + length(__at) + 1)")
    x = files.withColumn("__at", plain).withColumn("key", key).drop("__at")
    generation = F.sha2(F.concat_ws(":", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")), 256)
    return x.where(F.col("key").startswith(prefix)).select("key", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), generation.alias("generation"))


def list_page(spark: SparkSession, root: str, prefix: str = "", after: str | None = None, limit: int = 1000) -> tuple[list, str | None]:
    """(the next limit objects under a prefix in the order of keys, the cursor of the page behind them or None).

    A cursor belongs to its root and prefix; used with others it is refused.
    """
    bound = {"prefix": prefix}
    key = tuple(cursor_key(after, root, bound)) if after else None
    rows = keyset_page(list_objects(spark, root, prefix), ["key"], key, limit + 1).collect()
    page = rows[:limit]
    return page, cursor(root, bound, [page[-1].key]) if len(rows) > limit else None


def read_ranges(spark: SparkSession, root: str, offset: int, length: int) -> DataFrame:
    """path and data of a byte range of every object under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.substring("content", offset + 1, length).alias("data"))
