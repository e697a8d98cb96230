"""Hash chains, causal ancestry and continuity of logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut, prepare_workers, worker

GENESIS = "0" * 64


def entry_hash(previous: Column, payload: Column) -> Column:
    """The hash of an entry: SHA-256 of the previous hash and the digest of the payload."""
    return F.sha2(F.concat_ws(":", previous, F.sha2(payload, 256)), 256)


def chain_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over owner, payload, each owner's rows together and in order: its entries from the genesis on."""
    owner, sequence, before = None, 0, GENESIS
    for b in batches:
        rows = []
        for o, payload in zip(b["owner"].tolist(), b["payload"].tolist()):
            if o != owner:
                owner, sequence, before = o, 0, GENESIS
            digest = hashlib.sha256(f"{before}:{hashlib.sha256(payload.encode()).hexdigest()}".encode()).hexdigest()
            sequence += 1
            rows.append((o, sequence, before, digest, payload))
            before = digest
        yield pd.DataFrame(rows, columns=["owner", "sequence", "previous_hash", "entry_hash", "payload"])


def chained(rows: DataFrame, order: list[str]) -> DataFrame:
    """owner, sequence, previous_hash, entry_hash, payload: a chain per owner (rows: owner string, payload string not null, order columns).

    A chain is made one entry after another, so an owner's rows run through one task, in batches; owners run side by side.
    """
    prepare_workers(rows.sparkSession)
    placed = rows.repartition("owner").sortWithinPartitions("owner", *order).select("owner", "payload")
    return placed.mapInPandas(worker(__name__, "chain_batches"), "owner string, sequence long, previous_hash string, entry_hash string, payload string")


def reconcile(entries: DataFrame, events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """event_id, fault of ledger entries (sequence, kind, event_id, payload_digest) against events and tombstones (event_id, digest).

    A full outer join, so that what is missing and what is untracked comes out on both sides. Kinds: event and baseline_event enter an
    event, retention and baseline_tombstone take it out; the last entry of each sort tells the digest.
    """
    born, gone = F.col("kind").isin("event", "baseline_event"), F.col("kind").isin("retention", "baseline_tombstone")
    at = F.col("sequence")
    known = entries.where(born | gone).groupBy("event_id").agg(
        F.count_if(born).alias("births"),
        F.count_if(gone).alias("removals"),
        F.max_by("payload_digest", F.when(born, at)).alias("born_digest"),
        F.max_by("payload_digest", F.when(gone, at)).alias("gone_digest"),
        F.min(F.when(born, at)).alias("first_birth"),
        F.max(F.when(born, at)).alias("last_birth"),
        F.min(F.when(gone, at)).alias("first_removal"),
        F.min(F.when(F.col("kind") == "retention", at)).alias("first_retention"),
    )
    e = events.select("event_id", F.col("digest").alias("event_digest"), F.lit(True).alias("event"))
    t = tombstones.select("event_id", F.col("digest").alias("tombstone_digest"), F.lit(True).alias("tombstone"))
    x = known.join(e, "event_id", "full").join(t, "event_id", "full")
    born, gone = F.coalesce("births", F.lit(0)) > 0, F.coalesce("removals", F.lit(0)) > 0
    event, tombstone = F.col("event").isNotNull(), F.col("tombstone").isNotNull()
    faults = F.array_compact(
        F.array(
            F.when((F.col("births") > 1) | (F.col("last_birth") > F.col("first_removal")), F.lit("duplicate_event")),
            F.when((F.col("removals") > 1) | (F.col("first_retention") < F.coalesce("first_birth", F.col("first_retention") + 1)), F.lit("invalid_retention")),
            F.when(born & gone & event, F.lit("retained_event_reappeared")),
            F.when(born & ~gone & ~event, F.lit("missing_event")),
            F.when(born & ~gone & event & ~F.col("event_digest").eqNullSafe(F.col("born_digest")), F.lit("event_digest_mismatch")),
            F.when(gone & ~tombstone, F.lit("missing_tombstone")),
            F.when(gone & tombstone & ~F.col("tombstone_digest").eqNullSafe(F.col("gone_digest")), F.lit("tombstone_digest_mismatch")),
            F.when(event & ~born, F.lit("untracked_event")),
            F.when(tombstone & ~gone, F.lit("untracked_tombstone")),
        )
    )
    return x.select("event_id", F.explode(faults).alias("fault"))


def chain_faults(entries: DataFrame, block: int = 100_000, by: tuple[str, ...] = ()) -> DataFrame:
    """by, sequence, fault of a hash chain (sequence, previous_hash, entry_hash, payload) per by: gap, broken_link, edited, repeated.

    Each entry names its predecessor by number, so links are checked in blocks of sequence numbers; a block's first entry meets the last of
    the block before by an equi-join of one row per block.
    """
    e = entries.withColumn("__block", F.expr(f"sequence div {block}"))
    w = Window.partitionBy(*by, "__block").orderBy("sequence", "entry_hash")
    ends = e.groupBy(*by, "__block").agg(F.max(F.struct("sequence", "entry_hash")).alias("x"))
    over = Window.partitionBy(*by).orderBy("__block")  # a row per block of sequence numbers
    ends = ends.select(*by, "__block", F.lag("x").over(over).alias("carried"))
    e = e.withColumn("in_block", F.lag(F.struct("sequence", "entry_hash")).over(w)).join(ends, [*by, "__block"]).withColumn("before", F.coalesce("in_block", "carried"))
    faults = F.array_compact(
        F.array(
            F.when(F.col("sequence") == F.col("before.sequence"), F.lit("repeated")),
            F.when(F.col("sequence") > F.coalesce("before.sequence", F.lit(0)) + 1, F.lit("gap")),
            F.when(F.col("previous_hash") != F.coalesce("before.entry_hash", F.lit(GENESIS)), F.lit("broken_link")),
            F.when(F.col("entry_hash") != entry_hash(F.col("previous_hash"), F.col("payload")), F.lit("edited")),
        )
    )
    return e.select(*by, "sequence", F.explode(faults).alias("fault"))


def ancestry(edges: DataFrame) -> DataFrame:
    """node, root, depth of a forest (node, parent or null) by pointer doubling: each round doubles the distance looked back.

    Nodes on or below a cycle, or whose parent is unknown, have root null. Rounds go on until all are done; a node that is open after
    as many rounds as the number of nodes has binary digits looks back further than there are nodes, so it is on or below a cycle.
    """
    known = edges.select("node", "parent").distinct()
    p = known.join(known.select(F.col("node").alias("parent"), F.lit(1).alias("there")), "parent", "left").select("node", F.when(F.col("parent").isNull(), F.col("node")).when(F.col("there") == 1, F.col("parent")).alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent").isNull().alias("done"))
    p = cut(p)
    for _ in range(p.count().bit_length() + 1):
        open_now = p.where("NOT done AND up IS NOT NULL")
        if open_now.isEmpty():
            break
        u = p.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("end"))
        q = open_now.join(u, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("done"))
        p = cut(p.where("done OR up IS NULL").unionByName(q))
    return p.select("node", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))
