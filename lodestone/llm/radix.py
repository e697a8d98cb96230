"""Percentiles of very large numeric columns, by radix selection.

Doubles are mapped to 64-bit integers of the same order. A first histogram counts the leading 16 bits per group; from its running
sums each percentile knows the digit that holds its rank and its rank within it. Only rows with such a digit go on to the histogram
of the next 16 bits, and so on. After four digits the value is known exactly: the bound on the error is 0. Stopped after fewer bits,
the value lies in a known range of doubles. A histogram is a sum of counts, so histograms of partitions or days add up to that of all.

The percentile p of n values is the value of rank ceil(n * p), by integer arithmetic (percentiles are given in thousandths).

No group meets in one task: histograms are summed map-side and have at most 65,536 rows per group or followed digit. The digits
followed are broadcast only if they are few (groups times percentiles, counted); otherwise they are joined, rows of hot ones staying in place.

Defined cases: null and NaN are no values, infinities are; -0.0 counts as 0.0; null groups are groups; of several rows of an id the one
with the least (groups, value) counts; groups without values do not come out; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import HOT_ROWS, hot_keys, skew_join
from lodestone.session import cut, stored

#: Thousandths: the median and the 90th, 95th, 99th and 99.9th percentile.
PERCENTILES = (500, 900, 950, 990, 999)
DIGIT = 16
#: Digits followed at once that may be broadcast: about 100 bytes each.
BROADCAST_ROWS = 50_000


def order_key(value: Column) -> Column:
    """A long with the order of a double that is neither null nor NaN."""

    def ordered(values: pd.Series) -> pd.Series:
        bits = (values.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
        return pd.Series(np.where(bits < 0, ~bits ^ np.int64(-(1 << 63)), bits))

    return F.pandas_udf(ordered, "long")(value)


def key_value(key: Column) -> Column:
    """The double of an order key."""

    def back(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy(dtype=np.int64)
        return pd.Series(np.where(k < 0, ~(k ^ np.int64(-(1 << 63))), k).view(np.float64))

    return F.pandas_udf(back, "double")(key)


def _coded(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")).alias(c)


def _decoded(c: str, to: str = "string") -> Column:
    return F.when(F.col(c) != "-", F.substring(c, 2, (1 << 31) - 1)).cast(to).alias(c)


def keyed(df: DataFrame, groups: list[str], value: str, unique: str | None = None) -> DataFrame:
    """groups (coded, never null) and key of each value; with unique, one row per value of that column."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    if unique:
        one = F.min(F.struct(*groups, value)).alias("one")  # copies are few: no map-side combine
        rows = rows.select(unique, *groups, value).repartition(unique).groupBy(unique).agg(one).select("one.*")
    return rows.select(*map(_coded, groups), order_key(F.col(value)).alias("key"))


def histogram(rows: DataFrame, groups: list[str], bits: int) -> DataFrame:
    """groups, prefix, n: rows per group and leading bits of the key. Histograms of parts add up: union and sum n."""
    return rows.groupBy(*groups, F.shiftright("key", 64 - bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def merged(histograms: DataFrame, groups: list[str]) -> DataFrame:
    """The sum of histograms over all columns but groups and prefix."""
    return histograms.groupBy(*groups, "prefix").agg(F.sum("n").alias("n"))


def _followed(hist: DataFrame, targets: DataFrame, within: list[str], digit: str) -> DataFrame:
    """targets (within, rank, ...) with the digit that holds the rank, its rows in m, and the rank within it."""
    running = Window.partitionBy(*within).orderBy(digit)
    h = hist.withColumn("upto", F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    found = targets.join(h, within).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return found.withColumn("rank", F.col("rank") - (F.col("upto") - F.col("n"))).withColumnRenamed("n", "m").drop("upto")


def _ranked(hist: DataFrame, groups: list[str], percentiles: tuple[int, ...]) -> DataFrame:
    totals = hist.groupBy(*groups).agg(F.sum("n").alias("count"))
    each = F.explode(F.array(*[F.lit(p) for p in percentiles])).alias("p")
    return totals.select(*groups, "count", each).withColumn("rank", F.expr("(count * p + 999) div 1000"))


def estimate(hist: DataFrame, groups: list[str], bits: int, percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """groups, p, count, low, high: doubles between which the exact percentile lies, from a histogram of so many leading bits."""
    found = _followed(hist, _ranked(hist, groups, percentiles), groups, "prefix")
    low = F.shiftleft("prefix", 64 - bits)
    return found.select(*map(_decoded, groups), "p", "count", key_value(low).alias("low"), key_value(low + F.lit((1 << (64 - bits)) - 1)).alias("high"))


def radix_select(rows: DataFrame, groups: list[str], percentiles: tuple[int, ...] = PERCENTILES, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """groups (coded), p, count, value: the exact percentiles of rows as from keyed, of which all are read for the first two digits.

    For the later digits only what the second kept is left: the keys under the first digits followed, each with its number.
    """
    hist = histogram(rows, groups, DIGIT)
    at = cut(_followed(hist, _ranked(hist, groups, percentiles), groups, "prefix"))
    few = at.count() <= broadcast_rows
    left = None
    for bits in range(2 * DIGIT, 65, DIGIT):
        places = cut(at.groupBy(*groups, "prefix").agg(F.max("m").alias("m")))
        known = (rows.withColumn("k", F.lit(1).cast("long")) if left is None else left).withColumn("prefix", F.shiftright("key", 64 - bits + DIGIT))
        if few:
            kept = known.join(F.broadcast(places.drop("m")), [*groups, "prefix"])
        else:
            kept = skew_join(known, places.drop("m"), [*groups, "prefix"], cut(hot_keys(places, [*groups, "prefix"], "m", hot_rows)))
        if left is None:
            left = stored(kept.groupBy(*groups, "key").agg(F.sum("k").alias("k")))
            kept = left.withColumn("prefix", F.shiftright("key", 64 - bits + DIGIT))
        digit = F.shiftright("key", 64 - bits).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("digit")
        hist = kept.groupBy(*groups, "prefix", digit).agg(F.sum("k").alias("n"))
        at = _followed(hist, at.drop("m"), [*groups, "prefix"], "digit")
        at = cut(at.withColumn("prefix", F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit"))).drop("digit"))
    return at.select(*groups, "p", "count", key_value(F.col("prefix")).alias("value"))


def percentiles_of(df: DataFrame, groups: list[str], value: str, unique: str | None = None, percentiles: tuple[int, ...] = PERCENTILES, **limits: int) -> DataFrame:
    """groups (as strings), n and one column per percentile, as p50 or p99_9: exact."""
    rows = stored(keyed(df, groups, value, unique))
    found = radix_select(rows, groups, percentiles, **limits)
    names = {p: f"p{p / 10:g}".replace(".", "_") for p in percentiles}
    columns = [F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()]
    return found.groupBy(*groups).agg(F.max("count").alias("n"), *columns).select(*map(_decoded, groups), "n", *names.values())
