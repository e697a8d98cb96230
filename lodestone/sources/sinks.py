"""Sinks: published generations, upserts, canonical JSON with digests, metrics.

A table is a folder of generations and numbered pointer files. A rebuild writes a new generation, writes its name beside the pointers and
gives that file the next number, which only one writer can: a rename does not replace a file that is there. Readers take the highest number, so
they see the old or the new rows and never nothing or a mixture; a lost executor or a failed job leaves the pointers as they were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current-"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> int:
    """The highest pointer of root; 0 if there is none."""
    at, fs = _fs(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n.removeprefix(POINTER)) for n in names if n.startswith(POINTER) and n.removeprefix(POINTER).isdigit()), default=0)


def publish(df: DataFrame, root: str, after: int | None = None) -> str:
    """Writes df as the next generation of root and makes it the current one.

    after: the pointer that df was made from; another writer's pointer behind it is an error, as publishing would lose its rows.
    """
    spark, name = df.sparkSession, f"generation-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    fresh, fs = _fs(spark, f"{root}/_{name}")
    out = fs.create(fresh, False)
    out.write(bytearray(name.encode()))
    out.close()
    while True:
        number = (latest(spark, root) if after is None else after) + 1
        pointer, _ = _fs(spark, f"{root}/{POINTER}{number:012d}")
        if not fs.exists(pointer) and fs.rename(fresh, pointer):
            return name
        if after is not None:
            fs.delete(fresh, False)
            raise RuntimeError(f"another generation of {root} was published meanwhile")


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The current generation of root, or that of a pointer; None if there is none."""
    number = latest(spark, root) if number is None else number
    if not number:
        return None
    pointer, fs = _fs(spark, f"{root}/{POINTER}{number:012d}")
    stream = fs.open(pointer)
    name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return spark.read.parquet(f"{root}/{name}")


def upsert(changes: DataFrame, root: str, keys: list[str], deleted: str | None = None) -> str:
    """Publishes a generation in which rows of changed keys are replaced; keys whose deleted column is true are only removed.

    Changes have one row per key. Doing the same change again gives the same rows. Of two upserts at one time the later one fails.
    """
    spark = changes.sparkSession
    new = changes.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else changes
    number = latest(spark, root)
    old = current(spark, root, number)
    return publish(new if old is None else old.join(changes.select(*keys), keys, "left_anti").unionByName(new), root, number)


def canonical_json(df: DataFrame) -> Column:
    """One JSON text per row with its columns in the order of their names; nulls are left out."""
    return F.to_json(F.struct(*sorted(df.columns)))


def export_json(df: DataFrame, path: str) -> DataFrame:
    """Writes canonical JSON lines and gives rows and digest, which do not depend on the order of rows or on the partitioning.

    The digest is that of the sums of the halves of each line's SHA-256.
    """
    lines = df.select(canonical_json(df).alias("value"))
    lines.write.text(path)
    h = F.sha2("value", 256)
    part = [F.sum(F.conv(F.substring(h, at, 8), 16, 10).cast("decimal(38,0)")).cast("string") for at in range(1, 65, 8)]
    back = df.sparkSession.read.text(path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", *part), 256).alias("digest"))


def metric_lines(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Lines of a text exposition of metrics: name{label="value",...} value."""
    shown = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(name + "{"), shown, F.lit("} "), F.col(value).cast("string")).alias("line"))
