"""Mixing sources to target weights.

The size of a document is its number of tokens. Each source gets a budget: its target share of the total. Documents of a source
are put in random order by a hash of their id; distributed prefix sums of the sizes along this order tell for each document what
has been spent before it, and the source is cut where its budget ends. A source smaller than its budget is repeated, in whole
epochs and a cut last one, at most max_repeats times; what it then still lacks is reported.

The random order is laid out in blocks per source by the leading bits of the hash, as many that a block has about BLOCK_ROWS rows if
all documents were of one source; so a source with a third of all rows is many even tasks. Sizes are summed per block, prefix sums run
over the blocks of a source and then within each block. The number of blocks changes no result.

The cut falls between documents: the last document is taken whole if more than half of it fits, so a source misses its budget by half
a document at most, and max_repeats is never exceeded.

Defined cases: documents without tokens (null and empty texts) cannot add to a share and are left out; sources that mix_targets does
not name are left out; a named source without documents comes out in the report with share 0; of repeated rows of mix_targets the
one with the greatest share counts; null sources are no sources; equal documents are different documents if their ids differ.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut

#: Rows of a block of a source's random order, if all rows were of that source.
BLOCK_ROWS = 20_000


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct(F.col("target_share").alias("s"), F.col("max_repeats").alias("m"))).alias("x"))
    return t.select("source", F.coalesce("x.s", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("x.m", F.lit(0)), F.lit(0)).alias("max_repeats"))


def shuffled(sizes: DataFrame, seed: int = 0) -> DataFrame:
    """sizes (doc_id, source, tokens; read twice, so it should be cut) with a hash-random place: key and block, the same in every run."""
    key = F.xxhash64(F.lit(seed), "doc_id")
    bits = max(4, math.ceil(math.log2(max(1, sizes.count()) / BLOCK_ROWS)))
    return sizes.where(F.col("tokens") > 0).select("doc_id", "source", "tokens", key.alias("key")).withColumn("block", F.shiftrightunsigned("key", 64 - bits))


def budgets(placed: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per source of targets its documents, size, budget, whole epochs and the rest of the budget; and per block what is before it.

    total_tokens: size of the mixture aimed at; the size of all documents of the named sources if not given.
    """
    per_block = placed.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("tokens").alias("largest"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_block.select("source", "block", F.coalesce(before, F.lit(0)).alias("before"))
    per_source = _targets(targets).join(per_block.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"), F.max("largest").alias("largest")), "source", "left").na.fill(0, ["tokens", "docs", "largest"])
    total = F.lit(total_tokens).cast("long") if total_tokens is not None else F.sum("tokens").over(Window.partitionBy())  # a row per named source
    plan = per_source.withColumn("budget", F.round(F.col("target_share") * total).cast("long"))
    plan = plan.withColumn("grant", F.least("budget", F.col("tokens") * F.col("max_repeats")))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("grant div tokens")).otherwise(F.lit(0)))
    return plan.withColumn("rest", F.col("grant") - F.col("epochs") * F.col("tokens")), starts


def _mixed(sizes: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """The plan per source, and doc_id, source, tokens, repeats."""
    placed = shuffled(sizes.join(F.broadcast(_targets(targets).select("source")), "source", "left_semi"), seed)
    plan, starts = budgets(placed, targets, total_tokens)
    plan = cut(plan)  # a row per named source
    offsets = starts.join(plan.select("source", "epochs", "rest", "max_repeats"), "source")
    order = Window.partitionBy("source", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("in_block", F.coalesce(F.sum("tokens").over(order), F.lit(0))).join(offsets, ["source", "block"])
    spent = F.col("before") + F.col("in_block")
    last = (2 * (F.col("rest") - spent) > F.col("tokens")).cast("int")
    repeats = F.least(F.col("epochs") + last, F.col("max_repeats")).cast("int")
    return plan, rows.withColumn("repeats", repeats).where(F.col("repeats") > 0).select("doc_id", "source", "tokens", "repeats")


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, tokens, repeats: how often each document stands in the mixture; documents that do not are left out."""
    return _mixed(sizes, targets, total_tokens, seed)[1]


def shares(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """Per named source: target and reached share, budget and tokens taken, documents, how often they are repeated at most,
    what could be taken and the tokens of its largest document."""
    plan, mixed = _mixed(sizes, targets, total_tokens, seed)
    taken = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("taken_tokens"), F.sum("repeats").alias("taken_docs"), F.max("repeats").alias("most_repeats"))
    x = plan.select("source", "target_share", "max_repeats", F.col("docs").alias("source_docs"), F.col("tokens").alias("source_tokens"), F.col("budget").alias("budget_tokens"), F.col("grant").alias("granted_tokens"), "largest").join(taken, "source", "left").na.fill(0, ["taken_tokens", "taken_docs", "most_repeats"])
    everything = F.sum("taken_tokens").over(Window.partitionBy())  # a row per named source
    return x.withColumn("reached_share", F.when(everything > 0, F.col("taken_tokens") / everything).otherwise(F.lit(0.0))).withColumn("missing_tokens", F.greatest(F.col("budget_tokens") - F.col("taken_tokens"), F.lit(0)))
