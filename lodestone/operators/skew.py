"""Joins that stay even when one key holds a large part of all rows.

Keys with at least HOT_ROWS rows are listed with their counts. The list has at most rows / HOT_ROWS keys and is cut at MOST_KEYS, the
most frequent ones, so it may be broadcast whatever the data's size; a key that is not in it has fewer than HOT_ROWS rows, or
fewer than one MOST_KEYS-th of all rows. Two joins use it: skew_join sends the few rows of the other side that hot keys meet to
where the many rows are, which then move nowhere; salted_join, for other sides with wide rows, spreads the rows of a hot key over as
many parts as its count asks for. No row is dropped or sampled, and how rows are spread depends on their values alone, so a
task that is run again does the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut

#: Rows of a key from which it is hot, and of which one part of it has about as many.
HOT_ROWS = 100_000
#: The longest list of hot keys that is broadcast.
MOST_KEYS = 200_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, hot_rows: int = HOT_ROWS, most: int = MOST_KEYS) -> DataFrame:
    """keys, __salts: the keys of counts (one row per key, its rows in n) with at least hot_rows rows, and into how many parts to spread them."""
    found = counts.where(F.col(n) >= hot_rows).orderBy(F.col(n).desc(), *keys).limit(most)
    return found.select(*keys, F.ceil(F.col(n) / F.lit(hot_rows)).cast("int").alias("__salts"))


def skew_join(big: DataFrame, unique: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """big joined with unique (one row per key, narrow) on keys, equal and not null: rows of hot keys stay where they are.

    how: inner or left. hot: as from hot_keys; it is read three times, so it should be cut. Exact copies do no harm, whatever their number.
    Column names other than keys must not clash.
    """
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    hot = hot.where(known).select(*keys)
    met = F.broadcast(hot.join(unique, keys, how))  # at most a row per hot key
    out = big.join(met, keys).unionByName(big.where(known).join(F.broadcast(hot), keys, "left_anti").join(unique, keys, how))
    if how == "left":  # rows without a key meet nothing and need not come together
        out = out.unionByName(big.where(f"NOT ({known})").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in unique.schema.fields if f.name not in keys]))
    return out


def hot_join(big: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """skew_join with the hot keys counted first: one more pass over the keys of big, summed map-side."""
    return skew_join(big, unique, keys, cut(hot_keys(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys, "__n", hot_rows)), how)


def salted_join(big: DataFrame, unique: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """big, without exact copies, joined with unique (one row per key) on keys, equal and not null: rows of hot keys are spread by a hash.

    how: inner or left. hot: as from hot_keys; it is broadcast. Column names other than keys must not clash.
    """
    marked = F.broadcast(hot.select(*keys, "__salts"))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c, t in big.dtypes if not t.startswith("map")]), F.col("__salts")).cast("int")
    left = big.join(marked, keys, "left").withColumn("__salt", F.coalesce(spread, F.lit(0))).drop("__salts")
    right = unique.join(marked, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0))))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
