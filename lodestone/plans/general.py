"""Queries of the general data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.keys import instant_us, micros, plain_key
from lodestone.operators import copydiff, intervals, references
from lodestone.session import folder, stored
from lodestone.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return references.catalog_records(
        table(spark, d, "content_manifests", "manifest_id", "created_at"), table(spark, d, "content_blobs", "sha256", "created_at", "unreferenced_at"), table(spark, d, "budget_definitions", "budget_id", "created_at")
    )


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """All references with their times, stored once: both the state and the orphans are made from them."""
    return stored(
        references.catalog_references(
            table(spark, d, "object_contents", "object_id", "manifest_id", "updated_at"),
            table(spark, d, "content_manifest_chunks", "manifest_id", "chunk_index", "chunk_sha256"),
            table(spark, d, "content_manifests", "manifest_id", "created_at"),
            table(spark, d, "budget_reservations", "budget_id", "move_id", "attempt", "created_at"),
        )
    )


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = _refs(spark, d)
    state = references.fold(references.reference_deltas(refs), references.existence_deltas(_records(spark, d)))
    return refs, references.orphans(refs, state)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference of the catalog."""
    return _references(spark, d)[1].select("table_name", "record_key", "ref_key").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month."""
    return references.orphan_report(_references(spark, d)[1])


#: The instant that parts the two batches of p1_after_changes: 2025-01-01 UTC.
BATCH_US = 1_735_689_600_000_000


def p1_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """The orphan keys after two batches of changes: those up to BATCH_US make the state, those behind it are added to what was published.

    Changes: a reference at its time, a record at its creation and again where it was reclaimed; what has no readable time is in the first batch.
    """
    refs, root = _refs(spark, d), folder(spark, "reference-state")
    m = table(spark, d, "content_manifests", "manifest_id", "created_at").select(F.lit("content_manifests").alias("target"), plain_key(F.col("manifest_id")).alias("key"), instant_us(F.col("created_at")).alias("at_us"), F.lit(1).alias("delta"))
    b = table(spark, d, "content_blobs", "sha256", "created_at", "unreferenced_at").select(F.lit("content_blobs").alias("target"), plain_key(F.col("sha256")).alias("key"), F.explode(F.array(F.struct(instant_us(F.col("created_at")).alias("at_us"), F.lit(1).alias("delta")), F.when(F.col("unreferenced_at").isNotNull(), F.struct(instant_us(F.col("unreferenced_at")).alias("at_us"), F.lit(-1).alias("delta"))))).alias("c")).where("c IS NOT NULL").select("target", "key", "c.*")
    g = table(spark, d, "budget_definitions", "budget_id", "created_at").select(F.lit("budget_definitions").alias("target"), plain_key(F.col("budget_id")).alias("key"), instant_us(F.col("created_at")).alias("at_us"), F.lit(1).alias("delta"))
    records = m.unionByName(b).unionByName(g).where("key IS NOT NULL").withColumn("created_us", F.col("at_us"))
    state = None
    for late in (False, True):
        batch = [x.where((F.col(at) > BATCH_US) if late else (F.col(at).isNull() | (F.col(at) <= BATCH_US))) for x, at in ((refs, "ref_us"), (records, "at_us"))]
        state = references.advance(root, references.reference_deltas(batch[0]), references.existence_deltas(batch[1]))
    return references.orphan_keys(state).select("target", "key", "refs", "exists")


def _holdings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    compared = [plain_key(F.col("tier")).alias("tier"), F.col("size"), plain_key(F.col("checksum")).alias("checksum")]
    inventory = table(spark, d, "inventory", "bucket", "object_key", "tier", "size", "checksum", "updated_at").select("bucket", "object_key", *compared, "updated_at")
    sightings = table(spark, d, "sightings", "bucket", "object_key", "tier", "size", "checksum", "seen_at").select("bucket", "object_key", *compared, "seen_at")
    return inventory, sightings


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """What differs between the catalog's inventory and what storage shows."""
    inventory, sightings = _holdings(spark, d)
    return copydiff.differences(inventory, sightings, ["bucket", "object_key"], ["tier", "size", "checksum"], "updated_at", "seen_at", ("inventory", "sightings"))


def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    """The differences counted per bucket and kind."""
    return p3_found(spark, d).groupBy("bucket", "difference").agg(F.count(F.lit(1)).alias("objects"))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "movement", "job_id", "started_at", "completed_at").select(F.concat(F.lit("movement:"), "job_id").alias("entity"), micros(F.col("started_at")).alias("start_us"), micros(F.col("completed_at")).alias("end_us"))
    h = table(spark, d, "legal_holds", "bucket", "object_key", "prefix", "created_at", "released_at")
    part = [F.coalesce(c, F.lit("")) for c in ("bucket", "object_key", "prefix")]
    # A release that cannot be read ends nowhere known: the row is left out like one without a start.
    h = h.where(F.col("released_at").isNull() | instant_us(F.col("released_at")).isNotNull()).select(F.concat(F.lit("legal_holds:"), F.concat_ws("|", *part)).alias("entity"), instant_us(F.col("created_at")).alias("start_us"), instant_us(F.col("released_at")).alias("end_us"))
    return m.unionByName(h)


def _named(df: DataFrame) -> DataFrame:
    at = F.instr("entity", ":")
    return df.select(F.expr("substring(entity, 1, instr(entity, ':') - 1)").alias("table_name"), F.expr("substring(entity, instr(entity, ':') + 1)").alias("entity_key"), *[c for c in df.columns if c != "entity"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Merged periods and gaps of the calls of each job and the holds on each scope."""
    return _named(intervals.merged_and_gaps(_intervals(spark, d)))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per job or scope: its periods, its gaps, and the time covered by closed periods and lost in gaps."""
    length = F.col("end_us") - F.col("start_us")
    x = intervals.sweep(_intervals(spark, d))
    out = x.groupBy("entity").agg(
        F.count_if(F.col("kind") == "period").alias("periods"), F.count_if(F.col("kind") == "gap").alias("gaps"), F.coalesce(F.sum(F.when((F.col("kind") == "period") & (F.col("end_us") >= 0), length)), F.lit(0)).alias("covered_us"), F.coalesce(F.sum(F.when(F.col("kind") == "gap", length)), F.lit(0)).alias("gap_us")
    )
    return _named(out)


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_after_changes, p3_found, p3_summary, p4_found, p4_coverage)}

_REFS = r"""
WITH manifests AS (SELECT lower(trim(manifest_id, E' \t\r\n ')) AS key, min(created_at::TIMESTAMPTZ) AS made FROM content_manifests GROUP BY 1),
blobs AS (SELECT lower(trim(sha256, E' \t\r\n ')) AS key, min(created_at::TIMESTAMPTZ) AS made, sum(CASE WHEN unreferenced_at IS NULL THEN 1 ELSE 0 END) AS live FROM content_blobs GROUP BY 1),
budgets AS (SELECT lower(trim(budget_id, E' \t\r\n ')) AS key, min(created_at::TIMESTAMPTZ) AS made FROM budget_definitions GROUP BY 1),
refs AS (
  SELECT 'object_contents' AS table_name, object_id AS record_key, manifest_id AS ref_key, updated_at::TIMESTAMPTZ AS seen, m.key IS NULL AS gone, m.made AS made
  FROM object_contents o LEFT JOIN manifests m ON lower(trim(o.manifest_id, E' \t\r\n ')) = m.key WHERE manifest_id IS NOT NULL
  UNION ALL
  SELECT 'content_manifest_chunks', c.manifest_id || '/' || c.chunk_index, chunk_sha256, m.made, b.key IS NULL OR b.live <= 0, b.made
  FROM content_manifest_chunks c LEFT JOIN manifests m ON lower(trim(c.manifest_id, E' \t\r\n ')) = m.key LEFT JOIN blobs b ON lower(trim(c.chunk_sha256, E' \t\r\n ')) = b.key WHERE chunk_sha256 IS NOT NULL
  UNION ALL
  SELECT 'budget_reservations', move_id || '/' || attempt, r.budget_id, r.created_at::TIMESTAMPTZ, d.key IS NULL, d.made
  FROM budget_reservations r LEFT JOIN budgets d ON lower(trim(r.budget_id, E' \t\r\n ')) = d.key WHERE r.budget_id IS NOT NULL),
found AS (SELECT DISTINCT table_name, record_key, ref_key, seen FROM refs WHERE gone OR made > seen)
"""

_DIFF = r"""
WITH i AS (SELECT bucket, object_key, lower(trim(tier, E' \t\r\n ')) AS tier, size, lower(trim(checksum, E' \t\r\n ')) AS checksum, TRUE AS here FROM inventory QUALIFY row_number() OVER (PARTITION BY bucket, object_key ORDER BY updated_at DESC, tier DESC, size DESC, checksum DESC) = 1),
s AS (SELECT bucket, object_key, lower(trim(tier, E' \t\r\n ')) AS tier, size, lower(trim(checksum, E' \t\r\n ')) AS checksum, TRUE AS here FROM sightings QUALIFY row_number() OVER (PARTITION BY bucket, object_key ORDER BY seen_at DESC, tier DESC, size DESC, checksum DESC) = 1),
x AS (SELECT coalesce(i.bucket, s.bucket) AS bucket, coalesce(i.object_key, s.object_key) AS object_key, i.here AS hi, s.here AS hs, i.tier AS t1, s.tier AS t2, i.size AS z1, s.size AS z2, i.checksum AS c1, s.checksum AS c2 FROM i FULL JOIN s ON i.bucket = s.bucket AND i.object_key = s.object_key),
found AS (
  SELECT bucket, object_key, 'missing_in_sightings' AS difference FROM x WHERE hs IS NULL
  UNION ALL SELECT bucket, object_key, 'missing_in_inventory' FROM x WHERE hi IS NULL
  UNION ALL SELECT bucket, object_key, 'tier' FROM x WHERE hi AND hs AND t1 IS DISTINCT FROM t2
  UNION ALL SELECT bucket, object_key, 'size' FROM x WHERE hi AND hs AND z1 IS DISTINCT FROM z2
  UNION ALL SELECT bucket, object_key, 'checksum' FROM x WHERE hi AND hs AND c1 IS DISTINCT FROM c2)
"""

_SPANS = """
WITH raw AS (
  SELECT 'movement' AS table_name, job_id AS entity_key, epoch_us(started_at) AS s, epoch_us(completed_at) AS e FROM movement
  UNION ALL
  SELECT 'legal_holds', coalesce(bucket, '') || '|' || coalesce(object_key, '') || '|' || coalesce(prefix, ''), epoch_us(created_at::TIMESTAMPTZ), epoch_us(released_at::TIMESTAMPTZ) FROM legal_holds),
spans AS (SELECT DISTINCT table_name, entity_key, s, coalesce(e, 9223372036854775807) AS e FROM raw WHERE s IS NOT NULL AND (e IS NULL OR e > s)),
reach AS (SELECT *, max(e) OVER (PARTITION BY table_name, entity_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
island AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY table_name, entity_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM reach),
period AS (SELECT table_name, entity_key, part, min(s) AS s, max(e) AS e, count(*) AS n FROM island GROUP BY ALL),
x AS (SELECT *, lead(s) OVER (PARTITION BY table_name, entity_key ORDER BY s) AS next_s FROM period)
"""

SQL = {
    "p1_found": _REFS + "SELECT DISTINCT table_name, record_key, ref_key FROM found",
    "p1_report": _REFS + "SELECT table_name, strftime(timezone('UTC', seen), '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT lower(trim(ref_key, E' \\t\\r\\n\\u00a0'))) AS keys FROM found GROUP BY 1, 2",
    "p1_after_changes": r"""
WITH refs AS (
  SELECT 'content_manifests' AS target, lower(trim(manifest_id, E' \t\r\n ')) AS key, 1 AS r, 0 AS e FROM object_contents WHERE manifest_id IS NOT NULL
  UNION ALL SELECT 'content_blobs', lower(trim(chunk_sha256, E' \t\r\n ')), 1, 0 FROM content_manifest_chunks WHERE chunk_sha256 IS NOT NULL
  UNION ALL SELECT 'budget_definitions', lower(trim(budget_id, E' \t\r\n ')), 1, 0 FROM budget_reservations WHERE budget_id IS NOT NULL
  UNION ALL SELECT 'content_manifests', lower(trim(manifest_id, E' \t\r\n ')), 0, 1 FROM content_manifests
  UNION ALL SELECT 'content_blobs', lower(trim(sha256, E' \t\r\n ')), 0, CASE WHEN unreferenced_at IS NULL THEN 1 ELSE 0 END FROM content_blobs
  UNION ALL SELECT 'budget_definitions', lower(trim(budget_id, E' \t\r\n ')), 0, 1 FROM budget_definitions)
SELECT target, key, sum(r)::BIGINT AS refs, sum(e)::BIGINT AS exists FROM refs GROUP BY 1, 2 HAVING sum(r) > 0 AND sum(e) <= 0""",
    "p3_found": _DIFF + "SELECT * FROM found",
    "p3_summary": _DIFF + "SELECT bucket, difference, count(*) AS objects FROM found GROUP BY 1, 2",
    "p4_found": _SPANS + "SELECT table_name, entity_key, 'merged' AS kind, s AS start_us, CASE WHEN e = 9223372036854775807 THEN -1 ELSE e END AS end_us FROM x WHERE n >= 2 UNION ALL SELECT table_name, entity_key, 'gap', e, next_s FROM x WHERE next_s IS NOT NULL",
    "p4_coverage": _SPANS + "SELECT table_name, entity_key, count(*) AS periods, count(next_s) AS gaps, coalesce(sum(CASE WHEN e < 9223372036854775807 THEN e - s END), 0)::BIGINT AS covered_us, coalesce(sum(next_s - e), 0)::BIGINT AS gap_us FROM x GROUP BY 1, 2",
}
