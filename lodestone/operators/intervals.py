"""Overlapping and gapped time intervals: merged periods and gaps by a sweep.

Each interval becomes a plus event at its start and a minus event at its end; the prefix sum of the signs is the number of open
intervals. Where it rises from zero a period begins, where it falls to zero one ends, and the time to the next event is a gap.

An entity may hold a third of all rows, so no window runs over an entity's events. Time is laid out in blocks, of an hour or as much shorter
as the number of rows in the time they span asks for; within (entity, block) the sums start at zero, and a block is summed up in one row: total, lowest prefix and what follows the last
lowest place. A window over an entity's blocks, of which there are at most span / block length, carries open counts and open starts on.

Defined cases: rows without start, or with an end not after the start, are ignored; without end an interval stays open (end -1);
exact copies count once; intervals that touch form one period; a null entity is an entity; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The time of the minus event of an interval that stays open.
FOREVER = (1 << 63) - 1
#: The longest block, and the events of one that are aimed at if all intervals were of one entity and spread evenly.
BLOCK_US, BLOCK_EVENTS = 3_600_000_000, 1_000_000


def block_length(intervals: DataFrame) -> int:
    """The length of the blocks for intervals (start_us), from their number and span; it changes no result."""
    n, low, high = intervals.agg(F.count("start_us"), F.min("start_us"), F.max("start_us")).collect()[0]
    return BLOCK_US if not n else max(1, min(BLOCK_US, (high - low) * BLOCK_EVENTS // (2 * n)))


def boundary_events(intervals: DataFrame, block_us: int = BLOCK_US) -> DataFrame:
    """entity (coded), block, t, starts, delta: one row per entity and time, from intervals (entity, start_us, end_us)."""
    end = F.coalesce("end_us", F.lit(FOREVER))
    coded = F.coalesce(F.concat(F.lit("="), F.col("entity").cast("string")), F.lit("-")).alias("entity")  # never null, so that it can be joined on
    kept = intervals.where(F.col("start_us").isNotNull() & (end > F.col("start_us"))).select(coded, "start_us", end.alias("end_us")).distinct()
    plus_minus = F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("s"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(0).alias("s"), F.lit(-1).alias("d")))
    events = kept.select("entity", F.explode(plus_minus).alias("e")).select("entity", "e.*")
    return (
        events.groupBy("entity", "t").agg(F.sum("s").alias("starts"), F.sum("d").alias("delta")).withColumn("block", F.expr(f"t div {block_us}")).select("entity", "block", "t", "starts", "delta")
    )


def sweep(intervals: DataFrame, block_us: int | None = None) -> DataFrame:
    """Periods and gaps of intervals (entity, start_us, end_us): entity, kind, start_us, end_us, intervals.

    kind period: one continuous stretch and the number of distinct intervals in it; kind gap: between two periods, intervals 0.
    """
    block_us = block_length(intervals) if block_us is None else block_us
    within = Window.partitionBy("entity", "block").orderBy("t")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    events = (
        boundary_events(intervals, block_us).withColumn("p", F.sum("delta").over(so_far)).withColumn("s", F.sum("starts").over(so_far)).withColumn("next_t", F.lead("t").over(within))
    )
    low = F.struct("p", (-F.col("t")).alias("nt"), "s", "next_t")
    blocks = events.groupBy("entity", "block").agg(
        F.sum("delta").alias("b_delta"), F.sum("starts").alias("b_starts"), F.min("t").alias("b_first"), F.min(low).alias("low")
    )
    over = Window.partitionBy("entity").orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("a", F.coalesce(F.sum("b_delta").over(before), F.lit(0))).withColumn("s0", F.coalesce(F.sum("b_starts").over(before), F.lit(0))).withColumn("next_block_t", F.lead("b_first").over(over))
    zero = F.col("a") + F.col("low.p") == 0
    opened = F.when(zero & F.col("low.next_t").isNotNull(), F.struct(F.col("low.next_t").alias("t"), (F.col("s0") + F.col("low.s")).alias("s"))).when(~zero & (F.col("a") == 0), F.struct(F.col("b_first").alias("t"), F.col("s0").alias("s")))
    blocks = blocks.withColumn("opened", opened).withColumn("carried", F.last("opened", ignorenulls=True).over(before)).select(F.col("entity").alias("b_entity"), F.col("block").alias("b_block"), "a", "s0", "next_block_t", "carried")
    rows = events.join(blocks, (events["entity"] == blocks["b_entity"]) & (events["block"] == blocks["b_block"])).drop("b_entity", "b_block")
    active = F.col("a") + F.col("p")
    rows = rows.withColumn("after", active).withColumn("opening", F.when(active - F.col("delta") == 0, F.struct(F.col("t").alias("t"), (F.col("s0") + F.col("s") - F.col("starts")).alias("s"))))
    rows = rows.withColumn("since", F.coalesce(F.last("opening", ignorenulls=True).over(so_far), F.col("carried"))).withColumn("next_any", F.coalesce("next_t", "next_block_t"))
    closing = rows.where(F.col("after") == 0)
    shown_end = F.when(F.col("t") == FOREVER, F.lit(-1)).otherwise(F.col("t"))
    period = F.struct(F.lit("period").alias("kind"), F.col("since.t").alias("start_us"), shown_end.alias("end_us"), (F.col("s0") + F.col("s") - F.col("since.s")).alias("intervals"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("t").alias("start_us"), F.col("next_any").alias("end_us"), F.lit(0).cast("long").alias("intervals"))
    entity = F.when(F.col("entity") != "-", F.substring("entity", 2, (1 << 31) - 1)).alias("entity")
    return closing.select(entity, F.explode(F.when(F.col("next_any").isNotNull(), F.array(period, gap)).otherwise(F.array(period))).alias("x")).select("entity", "x.*")


def merged_and_gaps(intervals: DataFrame, block_us: int | None = None) -> DataFrame:
    """entity, kind, start_us, end_us: periods of at least two different intervals as merged, and the gaps."""
    kind = F.when(F.col("kind") == "period", F.lit("merged")).otherwise(F.col("kind"))
    return sweep(intervals, block_us).where((F.col("kind") == "gap") | (F.col("intervals") >= 2)).select("entity", kind.alias("kind"), "start_us", "end_us")
