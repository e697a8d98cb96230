"""References to records that do not exist.

Changes become signed deltas per key: a reference made is +1 reference, one removed -1; a record that appears is +1 existence, one that
is reclaimed or deleted -1. The sums per key are the state. It is kept as a published table, and a later batch of deltas is added to
it without reading the old rows again. A key with positive references and no existence is an orphan. Besides the sums the
state has the first time of existence and of reference, which tell references made before their record came.

Defined cases: null references are none; a key that is blank after trimming is a key like any other; exact copies of a row
count as often as they stand there and come out once; a time that cannot be read is unknown and makes no reference early;
a record without a readable time counts as always there; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.keys import instant_us, plain_key
from lodestone.operators.skew import HOT_ROWS, hot_join, hot_keys, skew_join
from lodestone.session import cut
from lodestone.sources import sinks

STATE = ["target", "key", "refs", "exists", "first_exists_us", "first_ref_us"]


def reference_deltas(refs: DataFrame) -> DataFrame:
    """Deltas of references: target, key, ref_us, and optionally delta (+1 made, -1 removed)."""
    delta = F.col("delta") if "delta" in refs.columns else F.lit(1)
    return refs.select("target", "key", delta.cast("long").alias("refs"), F.lit(0).cast("long").alias("exists"), F.lit(None).cast("long").alias("first_exists_us"), F.when(delta > 0, F.col("ref_us")).alias("first_ref_us"))


def existence_deltas(records: DataFrame) -> DataFrame:
    """Deltas of records: target, key, created_us, and either delta (+1 appeared, -1 gone) or gone (both at once, a delta each)."""
    if "delta" not in records.columns:
        both = F.when(F.coalesce(F.col("gone"), F.lit(False)), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
        records = records.select("target", "key", "created_us", F.explode(both).alias("delta"))
    first = F.when(F.col("delta") > 0, F.coalesce("created_us", F.lit(-(1 << 63))))
    return records.select("target", "key", F.lit(0).cast("long").alias("refs"), F.col("delta").cast("long").alias("exists"), first.alias("first_exists_us"), F.lit(None).cast("long").alias("first_ref_us"))


def fold(*deltas: DataFrame) -> DataFrame:
    """The state after all deltas, of which an earlier state may be one: a sum per key with map-side combine."""
    union = deltas[0].select(*STATE)
    for d in deltas[1:]:
        union = union.unionByName(d.select(*STATE))
    return union.groupBy("target", "key").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"), F.min("first_exists_us").alias("first_exists_us"), F.min("first_ref_us").alias("first_ref_us"))


def advance(root: str, *deltas: DataFrame) -> DataFrame:
    """Adds a batch of deltas to the state published at root, publishes the new state and gives it; the first batch makes the state.

    What is read is the state and the batch, not the rows of earlier batches. Keys without references and existence stay, with their times.
    """
    spark = deltas[0].sparkSession
    number = sinks.latest(spark, root)
    old = sinks.current(spark, root, number)
    sinks.publish(fold(*deltas) if old is None else fold(old, *deltas), root, number)
    return sinks.current(spark, root)


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist: the current orphan report."""
    return state.where((F.col("refs") > 0) & (F.col("exists") <= 0))


def suspects(state: DataFrame) -> DataFrame:
    """Keys that are referred to and are gone, or came after the first reference to them."""
    return state.where((F.col("refs") > 0) & ((F.col("exists") <= 0) | (F.col("first_exists_us") > F.col("first_ref_us"))))


def orphans(refs: DataFrame, state: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of refs whose key is gone or came later than the reference, once each.

    refs: target, key, ref_us and what names the record. The references of a hot key move nowhere before they are made distinct.
    """
    bad = cut(suspects(state))
    hot = cut(hot_keys(bad, ["target", "key"], "refs", hot_rows))
    joined = skew_join(refs, bad.select("target", "key", "exists", "first_exists_us"), ["target", "key"], hot)
    return joined.where((F.col("exists") <= 0) | (F.col("first_exists_us") > F.col("ref_us"))).select(*refs.columns).distinct()


def with_time_of(big: DataFrame, key: str, owners: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """big with ref_us from owners (key, created_us): the first time of each owner; null if there is no such owner.

    Rows of an owner with many move nowhere; those without an owner's key keep a null.
    """
    first = owners.groupBy("key").agg(F.min("created_us").alias("ref_us")).withColumnRenamed("key", "__owner")
    return hot_join(big.withColumnRenamed(key, "__owner"), first, ["__owner"], "left", hot_rows).drop("__owner")


def catalog_references(object_contents: DataFrame, chunks: DataFrame, manifests: DataFrame, reservations: DataFrame) -> DataFrame:
    """All references of the catalog: table_name, target, record_key, ref_key, key, ref_us; null references left out."""
    o = object_contents.where(F.col("manifest_id").isNotNull()).select(
        F.lit("object_contents").alias("table_name"), F.lit("content_manifests").alias("target"), F.col("object_id").alias("record_key"), F.col("manifest_id").alias("ref_key"), plain_key(F.col("manifest_id")).alias("key"), instant_us(F.col("updated_at")).alias("ref_us")
    )
    b = reservations.where(F.col("budget_id").isNotNull()).select(
        F.lit("budget_reservations").alias("table_name"), F.lit("budget_definitions").alias("target"), F.concat_ws("/", "move_id", "attempt").alias("record_key"), F.col("budget_id").alias("ref_key"), plain_key(F.col("budget_id")).alias("key"), instant_us(F.col("created_at")).alias("ref_us")
    )
    c = chunks.where(F.col("chunk_sha256").isNotNull()).select(
        F.lit("content_manifest_chunks").alias("table_name"), F.lit("content_blobs").alias("target"), F.concat_ws("/", "manifest_id", "chunk_index").alias("record_key"), F.col("chunk_sha256").alias("ref_key"), plain_key(F.col("chunk_sha256")).alias("key"), plain_key(F.col("manifest_id")).alias("__manifest")
    )
    owners = manifests.select(plain_key(F.col("manifest_id")).alias("key"), instant_us(F.col("created_at")).alias("created_us"))
    return o.unionByName(b).unionByName(with_time_of(c, "__manifest", owners))


def catalog_records(manifests: DataFrame, blobs: DataFrame, definitions: DataFrame) -> DataFrame:
    """All records that the catalog's references may name: target, key, created_us, gone."""
    m = manifests.select(F.lit("content_manifests").alias("target"), plain_key(F.col("manifest_id")).alias("key"), instant_us(F.col("created_at")).alias("created_us"), F.lit(False).alias("gone"))
    s = blobs.select(F.lit("content_blobs").alias("target"), plain_key(F.col("sha256")).alias("key"), instant_us(F.col("created_at")).alias("created_us"), F.col("unreferenced_at").isNotNull().alias("gone"))
    d = definitions.select(F.lit("budget_definitions").alias("target"), plain_key(F.col("budget_id")).alias("key"), instant_us(F.col("created_at")).alias("created_us"), F.lit(False).alias("gone"))
    return m.unionByName(s).unionByName(d).where(F.col("key").isNotNull())


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table and month of the reference; month is null where its time is unknown."""
    month = F.date_format(F.timestamp_micros("ref_us"), "yyyy-MM")
    return found.groupBy("table_name", month.alias("month")).agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("target", "key").alias("keys"))
