"""Aggregates over event streams: trailing windows, sampling weights, freshness, rates, gaps, concurrency, sessions.

Whole tables are aggregated at once; one conditional aggregate serves all windows and kinds, so the data is read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import order

HOUR_US = 3_600_000_000
#: Trailing windows in hours.
WINDOWS = {"1h": 1, "24h": 24, "7d": 168}


def trailing_windows(events: DataFrame, keys: list[str], kinds: list[str], as_of_us: Column, windows: dict[str, int] = WINDOWS, retention_hours: int = 720) -> DataFrame:
    """Per key: events, first and last time, least sample rate, and per window and kind the count and the sum of 1 / sample_rate.

    events: keys, kind, at_us, sample_rate. A window is (as_of - w, as_of]; so is the retention. Later events do not count.
    """
    kept = events.where((F.col("at_us") > as_of_us - retention_hours * HOUR_US) & (F.col("at_us") <= as_of_us))
    per_row = []
    for name, hours in windows.items():
        here = F.col("at_us") > as_of_us - hours * HOUR_US
        per_row += [F.count_if(here).alias(f"n_{name}"), F.coalesce(F.sum(F.when(here, 1 / F.col("sample_rate"))), F.lit(0.0)).alias(f"w_{name}")]
    # First per kind, so that a row meets a window's condition once and not once for every kind.
    k = kept.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"), F.min("at_us").alias("first"), F.max("at_us").alias("last"), F.min("sample_rate").alias("least"), *per_row)
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    each = []
    for name in windows:
        for kind in kinds:
            here = f"CASE WHEN kind = {text(kind)} THEN"
            each += [F.expr(f"coalesce(sum({here} n_{name} END), 0) AS `{kind}_{name}`"), F.expr(f"round(coalesce(sum({here} w_{name} END), 0D), 6) AS `{kind}_{name}_weight`")]
    return k.groupBy(*keys).agg(F.sum("n").alias("events"), F.min("first").alias("first_us"), F.max("last").alias("last_us"), F.min("least").alias("least_rate"), *each)


def freshness(last_us: Column, as_of_us: Column, fresh_hours: int) -> Column:
    """missing without an event, future behind as_of, fresh up to and at the bound, else stale."""
    age = as_of_us - last_us
    return F.when(last_us.isNull(), "missing").when(age < 0, "future").when(age <= fresh_hours * HOUR_US, "fresh").otherwise("stale")


def sliding_counts(events: DataFrame, keys: list[str], time: str, length: str, slide: str, *aggregates: Column) -> DataFrame:
    """keys, start, and aggregates over sliding windows."""
    return events.groupBy(*keys, F.window(time, length, slide).alias("w")).agg(*aggregates).select(*keys, F.col("w.start").alias("start"), *[c for c in events.groupBy(*keys).agg(*aggregates).columns if c not in keys])


def gaps_over(df: DataFrame, keys: list[str], at_us: str, block_us: int = 24 * HOUR_US) -> DataFrame:
    """Per key: events, distinct times, and the longest time between two successive ones.

    Runs in blocks of time: the longest gap within a block, and between the last event of a block and the first of the next.
    """
    t = df.select(*keys, F.col(at_us).alias("t")).where("t IS NOT NULL").groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.expr(f"t div {block_us}"))
    within = Window.partitionBy(*keys, "block").orderBy("t")
    b = t.withColumn("gap", F.col("t") - F.lag("t").over(within)).groupBy(*keys, "block").agg(F.max("gap").alias("gap"), F.min("t").alias("first"), F.max("t").alias("last"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("times"))
    over = Window.partitionBy(*keys).orderBy("block")
    b = b.withColumn("between", F.col("first") - F.lag("last").over(over))
    return b.groupBy(*keys).agg(F.sum("n").alias("events"), F.sum("times").alias("times"), F.coalesce(F.max(F.greatest("gap", "between")), F.lit(0)).alias("longest_gap_us"))


def sustained(samples: DataFrame, keys: list[str], at_us: str, holds: Column, least_us: int, reset_us: int, block_us: int = 24 * HOUR_US) -> DataFrame:
    """Stretches over which holds was true at every sample for at least least_us, without a pause of more than reset_us.

    keys, start_us, end_us, samples. Gaps and islands by two prefix sums, in blocks of time and over a key's blocks.
    """
    block = F.expr(f"t div {block_us}")
    x = samples.select(*keys, F.col(at_us).alias("t"), holds.alias("ok")).where("t IS NOT NULL").groupBy(*keys, "t").agg(F.min("ok").alias("ok"))
    x = order.with_before(x, keys, ["t"], ["t", "ok"], block)
    breaks = ~F.col("ok") | (F.col("t") - F.col("before.t") > reset_us) | ~F.col("before.ok")
    x = order.with_running(x.withColumn("breaks", F.coalesce(breaks, F.lit(True)).cast("int")), keys, ["t"], "breaks", block, "part")
    runs = x.where("ok").groupBy(*keys, "part").agg(F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.count(F.lit(1)).alias("samples"))
    return runs.where(F.col("end_us") - F.col("start_us") >= least_us).drop("part")


def peak_concurrency(intervals: DataFrame, block_us: int = HOUR_US) -> DataFrame:
    """Per entity the greatest number of intervals open at one time (ends before starts at the same instant), of (entity, start_us, end_us)."""
    end = F.col("end_us")
    kept = intervals.where(F.col("start_us").isNotNull() & (end.isNull() | (end > F.col("start_us"))))
    signs = F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))
    e = kept.select("entity", F.explode(signs).alias("e")).select("entity", "e.t", "e.d").where("t IS NOT NULL").groupBy("entity", "t").agg(F.sum("d").alias("d")).withColumn("block", F.expr(f"t div {block_us}"))
    within = Window.partitionBy("entity", "block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    b = e.withColumn("p", F.sum("d").over(within)).groupBy("entity", "block").agg(F.max("p").alias("high"), F.sum("d").alias("d"))
    over = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("peak", F.col("high") + F.coalesce(F.sum("d").over(over), F.lit(0))).groupBy("entity").agg(F.max("peak").alias("peak"))


def overlap_join(left: DataFrame, right: DataFrame, width_us: int) -> DataFrame:
    """left (l_start, l_end) joined with right (r_start, r_end) where they overlap: equi-join on the time slots of width_us that both touch.

    A pair comes up in each slot both touch and is kept in the first of them. Ends are exclusive; all four are known.
    """

    def slots(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(b) > F.col(a)).withColumn("__slot", F.explode(F.sequence(F.expr(f"floor({a} / {width_us})").cast("long"), F.expr(f"floor(({b} - 1) / {width_us})").cast("long"))))

    x = slots(left, "l_start", "l_end").join(slots(right, "r_start", "r_end"), "__slot")
    first = F.expr(f"floor(greatest(l_start, r_start) / {width_us})")
    return x.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("__slot") == first)).drop("__slot")


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The q-quantile interpolated within cumulative buckets (keys, le, n with n rows up to le)."""
    w = Window.partitionBy(*keys).orderBy("le")
    b = buckets.withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("total", F.max("n").over(Window.partitionBy(*keys)))
    rank = F.col("total") * q
    hit = b.where((F.col("n") >= rank) & (F.col("below") < rank))
    return hit.groupBy(*keys).agg(F.min(F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("below")) / (F.col("n") - F.col("below"))).alias("quantile"))
