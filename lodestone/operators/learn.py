"""Small supervised learning over tables: splits, metrics, class balance, exact one-level trees.

Counts that decide ties are compared as integers (cross-multiplied in decimal), so that row order and partitioning change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import order
from lodestone.session import cut, prepare_workers, stored, worker


def confusion(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """Per group tn, fp, fn, tp and the derived rates; a rate without cases is null."""
    t, g = F.col(truth), F.col(guess)
    x = df.groupBy(*by).agg(F.count_if(~t & ~g).alias("tn"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(t & g).alias("tp"))
    recall, specificity = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return (
        x.withColumn("accuracy", F.round(F.try_divide(F.col("tp") + F.col("tn"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")), 6))
        .withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6))
        .withColumn("recall", F.round(recall, 6))
        .withColumn("balanced_accuracy", F.round((recall + specificity) / 2, 6))
    )


def class_balance(df: DataFrame, by: list[str], truth: str, least: int, most_ratio: int) -> DataFrame:
    """Per group the cases of each class, whether the smaller has at least so many, and whether the ratio is bounded (by integers)."""
    x = df.groupBy(*by).agg(F.count_if(F.col(truth)).alias("positive"), F.count_if(~F.col(truth)).alias("negative"))
    small, large = F.least("positive", "negative"), F.greatest("positive", "negative")
    return x.withColumn("sufficient", (small >= least) & (large <= small * most_ratio))


def split_by_time(df: DataFrame, start: Column, end: Column, validation: Column, test: Column) -> DataFrame:
    """df with split: train, validation or test by start; purged where the label's window [start, end) reaches into the next split."""
    which = F.when(start >= test, "test").when(start >= validation, F.when(end > test, "purged").otherwise("validation")).otherwise(F.when(end > validation, "purged").otherwise("train"))
    return df.withColumn("split", which)


def best_stump(df: DataFrame, features: list[str], truth: str) -> DataFrame:
    """The split (feature, threshold) that leaves the least class-balanced Gini impurity; ties go to the lower feature and threshold.

    Values are counted per feature before anything is ordered; running counts go over distinct values. Impurity is compared as the
    fraction it is: with balanced weights a side of p of P positives and n of N negatives weighs pN + nP and adds
    2 pN nP / (pN + nP), and the sum of both sides is ordered by exact decimal quotients.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)]))
    counts = df.where(F.col(truth).isNotNull()).select(F.col(truth).cast("int").alias("y"), each.alias("x")).where(F.col("x.v").isNotNull()).groupBy("x.feature", "x.v").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    w = Window.partitionBy("feature").orderBy("v")
    so_far, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("feature")
    c = counts.select("feature", "v", F.sum("p").over(so_far).alias("lp"), F.sum("n").over(so_far).alias("ln"), F.sum("p").over(whole).alias("P"), F.sum("n").over(whole).alias("N"), F.lead("v").over(w).alias("next_v")).where("next_v IS NOT NULL")

    def side(p: Column, n: Column) -> Column:
        a, b = (p * F.col("N")).cast("decimal(20,0)"), (n * F.col("P")).cast("decimal(20,0)")
        return F.coalesce(F.try_divide(a.cast("double") * b.cast("double"), (a + b).cast("double")), F.lit(0.0))

    impurity = side(F.col("lp"), F.col("ln")) + side(F.col("P") - F.col("lp"), F.col("N") - F.col("ln"))
    best = c.select(F.min(F.struct(F.round(impurity, 3).alias("impurity"), "feature", F.col("v").alias("threshold"), "lp", "ln", "P", "N")).alias("b"))
    return best.select("b.*").where("feature IS NOT NULL")


_SPLIT = "feature int, low double, high double, lp long, ln long, tp long, tn long"


def best_split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over splits: the best of the partition by exact fractions, equal ones by the lower feature and value."""
    best = None
    for b in batches:
        for r in b.itertuples(index=False):
            lp, ln, p, n = int(r.lp), int(r.ln), int(r.tp), int(r.tn)
            weight = lp * n + ln * p
            rank = (-Fraction((lp * n - ln * p) ** 2, weight * (2 * p * n - weight)), r.feature, r.low)
            if best is None or rank < best[0]:
                best = (rank, r)
    if best is not None:
        yield pd.DataFrame([best[1]], columns=list(best[1]._fields))


def exact_stump(df: DataFrame, features: list[str], truth: str, least_leaf: int = 2) -> DataFrame:
    """feature, threshold and the cases of both sides of the split that leaves the least class-balanced Gini impurity; one row.

    With p of P positives and n of N negatives on the left and W = pN + nP, the impurity of both sides falls as (pN - nP)^2 / (W (2PN - W))
    rises, so this fraction is compared: those whose double is within 1e-9 of the greatest are compared by integers of any size. Ties go to
    the lower feature and value. The threshold is the midpoint of the values around it, or the lower one where there is none between. Sides have
    least_leaf rows at least. Where no split is better than none, feature and threshold are null and the left side has all rows.

    Distinct values are counted first and laid out in ranges; running counts go within ranges and over the ranges.
    """
    prepare_workers(df.sparkSession)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)]))
    rows = df.where(F.col(truth).isNotNull()).select(F.col(truth).cast("long").alias("y"), each.alias("x")).select("y", "x.feature", "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    counts = rows.groupBy("feature", "v").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    c = stored(counts.repartitionByRange("feature", "v").withColumn("range", F.spark_partition_id()))
    totals = c.groupBy("feature").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    x = order.with_before(c, ["feature"], ["v"], ["v"], F.col("range"))
    for n in ("p", "n"):
        x = order.with_running(x, ["feature"], ["v"], n, F.col("range"), f"all_{n}")
    x = x.where("before IS NOT NULL").join(F.broadcast(totals), "feature").select("feature", F.col("before.v").alias("low"), F.col("v").alias("high"), (F.col("all_p") - F.col("p")).alias("lp"), (F.col("all_n") - F.col("n")).alias("ln"), "tp", "tn")  # totals: a row per feature
    w = F.col("lp").cast("double") * F.col("tn") + F.col("ln").cast("double") * F.col("tp")
    d = F.col("lp").cast("decimal(38,0)") * F.col("tn") - F.col("ln").cast("decimal(38,0)") * F.col("tp")
    x = x.withColumn("gain", d.cast("double") * d.cast("double") / (w * (2.0 * F.col("tp") * F.col("tn") - w))).where((F.col("gain") > 0) & (F.col("lp") + F.col("ln") >= least_leaf) & (F.col("tp") + F.col("tn") - F.col("lp") - F.col("ln") >= least_leaf))
    x = cut(x)
    near = x.where(F.col("gain") >= x.agg(F.max("gain")).scalar() * (1 - 1e-9)).drop("gain")
    best = near.mapInPandas(worker(__name__, "best_split_batches"), _SPLIT).coalesce(1).mapInPandas(worker(__name__, "best_split_batches"), _SPLIT)  # a row per partition
    middle = F.col("low") / 2 + F.col("high") / 2
    shown = best.select("feature", F.when((middle >= F.col("low")) & (middle < F.col("high")), middle).otherwise(F.col("low")).alias("threshold"), F.col("lp").alias("left_positive"), F.col("ln").alias("left_negative"), (F.col("tp") - F.col("lp")).alias("right_positive"), (F.col("tn") - F.col("ln")).alias("right_negative"))
    leaf = totals.where("feature = 0").select(F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), F.col("tp").alias("left_positive"), F.col("tn").alias("left_negative"), F.lit(0).cast("long").alias("right_positive"), F.lit(0).cast("long").alias("right_negative"))
    return shown.unionByName(leaf).orderBy(F.col("feature").asc_nulls_last()).limit(1)


def normalised(value: Column, over: list[str]) -> Column:
    """(v - least) / (greatest - least) within a group; 0 where all are equal."""
    w = Window.partitionBy(*over)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).when(value.isNotNull(), F.lit(0.0))
