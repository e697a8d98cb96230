"""Differences between two copies of a table, by hierarchical checksums.

The keys are laid out on a line by a 64-bit hash, so that ranges of the line hold about as many keys each, whatever the keys look like.
Each side is brought to one row per key once, of which its place on the line and a hash of the whole row are kept. The checksum of a
range is its rows and the sums of two numbers made of each row's hash; sums of neighbouring ranges add up. From the root on, ranges
whose checksums differ are split into 2**STEP parts and equal ones are left alone; each level sums only what stands under ranges that
differed on the level above. The depth follows from the number of rows, so that a last range holds one row or none: fields are
compared only for the rows of the last ranges that differ, about those that do differ, and only those rows are read again.

Ranges that differ are broadcast as long as they are counted to be few; more of them are joined.

Hashes decide nothing alone: equal sums of two numbers of 64 bits and equal counts make a range equal; the chance that a
difference hides in them is about 2**-64 for any one range.

Defined cases: of several rows of a key the one with the latest time counts (at equal times the greatest values, in the order of
the fields); null differs from any value but not from null; null keys are keys; empty tables are one side that misses all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, stored

#: Bits by which a range is split at each step down, and by which last ranges outnumber the rows.
STEP, SPARE = 12, 2
#: Ranges that differ of which so many may be broadcast: 8 bytes each.
BROADCAST_RANGES = 2_000_000
_SUMS = ["n", "h1_lo", "h1_hi", "h2_lo", "h2_hi"]


def latest(df: DataFrame, keys: list[str], fields: list[str], time: str) -> DataFrame:
    """One row per key with the fields of its latest row: an aggregate with map-side combine, no window."""
    best = F.max(F.struct(F.col(time), *fields)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{n}").alias(n) for n in fields])


def place_of(keys: list[str]) -> Column:
    """Where a key lies on the line."""
    return F.xxhash64(*keys)


def range_of(place: Column | str, depth: int) -> Column:
    """The number of the range of a level of 2**depth ranges that a place falls into."""
    return F.shiftrightunsigned(place, 64 - depth) if depth else F.lit(0).cast("long")


def placed(rows: DataFrame, keys: list[str], fields: list[str], sign: int) -> DataFrame:
    """place, h, sign of rows (one per key): h is a hash of the whole row, in which null is no value."""
    nulls = [F.col(c).isNull() for c in [*keys, *fields]]
    return rows.select(place_of(keys).alias("place"), F.xxhash64(F.lit(1), *keys, *fields, *nulls).alias("h"), F.lit(sign).cast("byte").alias("sign"))


def _sums(rows: DataFrame, depth: int) -> DataFrame:
    """Signed checksums of the ranges of a level; halves of the hashes are summed, so that none overflows."""
    numbers = {"h1": F.col("h"), "h2": F.xxhash64(F.lit(2), "h", "place")}
    halves = [f(numbers[h]) * F.col("sign") for h in numbers for f in (lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)), lambda x: F.shiftright(x, 32))]
    return rows.groupBy(range_of("place", depth).alias("range")).agg(F.sum("sign").alias("n"), *[F.sum(x).alias(name) for x, name in zip(halves, _SUMS[1:])])


def _under(rows: DataFrame, place: Column, ranges: DataFrame, depth: int, few: bool) -> DataFrame:
    """The rows whose place lies under one of the ranges of a level."""
    return rows.join(F.broadcast(ranges) if few else ranges, range_of(place, depth) == ranges["range"], "left_semi")


def differing_ranges(both: DataFrame, rows: int, step: int = STEP, broadcast_ranges: int = BROADCAST_RANGES) -> tuple[DataFrame, int, bool]:
    """(the last ranges in which the sides differ, their depth, whether they are few), by descent from the root; both: placed rows of the two sides."""
    last = min(63, max(0, math.ceil(math.log2(max(1, rows)))) + SPARE)
    differs = F.greatest(*[F.col(c) != 0 for c in _SUMS])
    depth, left, ranges, few = 0, both, None, True
    while depth < last or ranges is None:
        depth = min(last, depth + step)
        ranges = cut(_sums(left, depth).where(differs).select("range"))
        few = ranges.count() <= broadcast_ranges
        if depth < last:
            left = _under(both, F.col("place"), ranges, depth, few)
    return ranges, depth, few


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], left_time: str, right_time: str, names: tuple[str, str] = ("left", "right"), step: int = STEP, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """keys, difference: missing_in_<name> for keys of one side only, and the name of each field that differs, one row each.

    left and right: keys, fields (already in the form in which they are compared) and a time. Which rows of a key count is said above.
    """
    a, b = under_differing_ranges(left, right, keys, fields, left_time, right_time, step, broadcast_ranges)
    a = a.select(*keys, F.struct(*fields).alias("__a"), F.lit(True).alias("__in_a"))
    b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*fields).alias("__b"), F.lit(True).alias("__in_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    pairs = a.join(b, same, "full")
    found = F.when(F.col("__in_b").isNull(), F.array(F.lit(f"missing_in_{names[1]}"))).when(F.col("__in_a").isNull(), F.array(F.lit(f"missing_in_{names[0]}"))).otherwise(
        F.array_compact(F.array(*[F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), F.lit(f)) for f in fields]))
    )
    shown = [F.when(F.col("__in_a").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return pairs.select(*shown, F.explode(found).alias("difference"))


def under_differing_ranges(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], left_time: str, right_time: str, step: int = STEP, broadcast_ranges: int = BROADCAST_RANGES) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides, one per key, that stand under last ranges in which the sides differ: what is left to be compared."""
    clean = [df.select(*keys, *fields, t) for df, t in ((left, left_time), (right, right_time))]
    ones = [placed(latest(df, keys, fields, t), keys, fields, sign) for df, t, sign in zip(clean, (left_time, right_time), (1, -1))]
    both = stored(ones[0].unionByName(ones[1]))
    ranges, depth, few = differing_ranges(both, both.count() // 2, step, broadcast_ranges)
    a, b = (latest(_under(df, place_of(keys), ranges, depth, few), keys, fields, t) for df, t in zip(clean, (left_time, right_time)))
    return a, b
