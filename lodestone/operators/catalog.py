"""Scans, pages, predicates, joins and set operations over catalog tables.

All are compositions of built-in operators, so that filters and columns reach the Parquet scan and aggregates combine map-side.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_scan(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column begins with the literal prefix: pushed to the scan as StringStartsWith; wildcards mean nothing."""
    return df.where(F.col(column).startswith(prefix)) if prefix else df


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next limit rows in the order of keys, strictly behind after."""
    if after is not None:
        behind = F.lit(False)
        for k in reversed(range(len(keys))):
            behind = (F.col(keys[k]) > F.lit(after[k])) | ((F.col(keys[k]) == F.lit(after[k])) & behind)
        df = df.where(behind)
    return df.orderBy(*keys).limit(limit)


def cursor(resource: str, filters: dict, last_key: list) -> str:
    """An opaque cursor bound to a resource and its filters."""
    mark = hashlib.sha256(json.dumps(filters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return base64.urlsafe_b64encode(json.dumps({"filters": mark, "last_key": last_key, "resource": resource, "version": 1}, sort_keys=True).encode()).decode().rstrip("=")


def cursor_key(text: str, resource: str, filters: dict) -> list:
    """The last key of a cursor; ValueError if it belongs to another resource or other filters."""
    try:
        got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError as e:
        raise ValueError("no cursor") from e
    if cursor(resource, filters, got.get("last_key")) != text:
        raise ValueError("the cursor belongs to another listing")
    return got["last_key"]


def glob_match(c: Column, pattern: str) -> Column:
    """Whether the whole text matches a file-name pattern with *, ? and [...]."""
    import fnmatch

    return c.rlike("(?s)^" + fnmatch.translate(pattern).replace("(?s:", "(?:").replace("\\Z", "").replace("\\z", "") + "$")


def path_pattern(pattern: str) -> str:
    """A regular expression for dotted paths: * is one step, ** any number of steps."""
    steps = ["(?:[^.]+\\.)*[^.]+" if s == "**" else "[^.]+" if s == "*" else re.escape(s) for s in pattern.split(".")]
    return "^" + "\\.".join(steps) + "$"


def hash_sample(df: DataFrame, identity: Column, rate: float) -> DataFrame:
    """The rows whose SHA-256, read as a fraction, is below rate: the same rows in every run and order."""
    if rate >= 1:
        return df
    return df.where(F.sha2(identity, 256) < F.lit(f"{int(rate * (1 << 256)):064x}"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by order (then by the other columns): an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__x"))
    return best.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in df.columns if c not in keys])


def first_write_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the least by order: an append that repeats an identity changes nothing."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__x"))
    return best.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in df.columns if c not in keys])


def prefixes_of(key: Column, longest: int) -> Column:
    """All prefixes of key of at most longest characters, the empty one too."""
    return F.transform(F.sequence(F.lit(0), F.least(F.length(key), F.lit(longest))), lambda n: F.substring(key, F.lit(1), n))


#: Lengths of scopes' prefixes up to which a key is cut at those lengths alone.
FEW_LENGTHS = 256


def prefix_join(objects: DataFrame, scopes: DataFrame, bucket: str = "bucket", key: str = "object_key", few_lengths: int = FEW_LENGTHS) -> DataFrame:
    """objects joined with scopes (scope_bucket or null, scope_prefix) that hold them, as an equi-join on prefixes.

    Each key is cut at the lengths that some scope's prefix has, so a theta join's pairs never come up; where the lengths are more than
    few_lengths, at every length up to the longest prefix.
    """
    lengths = [r[0] for r in scopes.select(F.length(F.coalesce("scope_prefix", F.lit(""))).alias("n")).distinct().orderBy("n").limit(few_lengths + 1).collect()]
    if len(lengths) > few_lengths:
        longest = scopes.agg(F.max(F.length("scope_prefix"))).collect()[0][0]
        at = prefixes_of(F.col(key), longest)
    else:
        at = F.array(*[F.when(F.length(key) >= n, F.substring(F.col(key), 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    o = objects.withColumn("__prefix", F.explode(F.array_compact(at))).withColumn("__bucket", F.explode(F.array(F.col(bucket), F.lit(None).cast("string"))))
    s = scopes.withColumn("__p", F.coalesce("scope_prefix", F.lit("")))
    return o.join(s, (F.col("__prefix") == F.col("__p")) & F.col("__bucket").eqNullSafe(F.col("scope_bucket"))).drop("__prefix", "__bucket", "__p")


def oldest(df: DataFrame, time: str, identity: str, limit: int) -> DataFrame:
    """The limit oldest rows, ties by identity: what a bounded prune takes next."""
    return df.where(F.col(time).isNotNull()).orderBy(time, identity).limit(limit)


def bounded_metadata(m: Column, most: int = 16_384) -> Column:
    """A map as JSON, {} if it is longer than most bytes; and whether it was cut."""
    text = F.to_json(m)
    return F.struct(F.when(F.octet_length(text) <= most, text).otherwise(F.lit("{}")).alias("json"), F.coalesce(F.octet_length(text) > most, F.lit(False)).alias("truncated"))


def without_keys(m: Column, hidden: list[str]) -> Column:
    """A map without the hidden keys."""
    return F.map_filter(m, lambda k, _: ~k.isin(hidden))


def contiguous_extents(chunks: DataFrame) -> DataFrame:
    """Per manifest: chunks, bytes, and where an extent does not start at the end of the one before (chunk_index from 0 without holes).

    A manifest may be very long: sums run within blocks of chunk_index and over the blocks, never over a whole manifest in one task.
    """
    c = chunks.select("manifest_id", "chunk_index", "byte_offset", "byte_length").distinct().withColumn("block", F.expr("chunk_index div 1024"))
    within = Window.partitionBy("manifest_id", "block").orderBy("chunk_index", "byte_offset", "byte_length")
    blocks = c.groupBy("manifest_id", "block").agg(F.sum("byte_length").alias("size"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("manifest_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("manifest_id", "block", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("size_before"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n_before"))
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("in_block", F.coalesce(F.sum("byte_length").over(so_far), F.lit(0))).withColumn("place", F.row_number().over(within) - 1).join(blocks, ["manifest_id", "block"])
    wrong = (F.col("byte_offset") != F.col("size_before") + F.col("in_block")) | (F.col("chunk_index") != F.col("n_before") + F.col("place"))
    return c.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("byte_length").alias("bytes"), F.count_if(wrong).alias("breaks"))
