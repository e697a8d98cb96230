"""Queries over the catalog tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.keys import cas_key, instant_us, is_digest
from lodestone.operators import catalog as c
from lodestone.operators.skew import hot_join
from lodestone.sources.tables import table

PREFIX, PAGE = "q1/", 50


def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    """Objects under a literal prefix."""
    return c.prefix_scan(table(spark, d, "inventory", "bucket", "object_key", "size"), "object_key", PREFIX).distinct()


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of PAGE objects behind a key."""
    return c.keyset_page(table(spark, d, "inventory", "bucket", "object_key").distinct(), ["bucket", "object_key"], ("bkt-eu", "q1/"), PAGE)


def object_content(spark: SparkSession, d: str) -> DataFrame:
    """Objects with the manifest and blob of their content."""
    o = table(spark, d, "object_contents", "object_id", "manifest_id").distinct()
    m = table(spark, d, "content_manifests", "manifest_id", "content_sha256", "chunk_count").distinct()
    b = table(spark, d, "content_blobs", "sha256", "size").distinct()
    x = hot_join(o, m, ["manifest_id"]).withColumnRenamed("content_sha256", "sha256")
    return hot_join(x, b, ["sha256"]).select("object_id", "manifest_id", "sha256", "size", "chunk_count")


def content_or_none(spark: SparkSession, d: str) -> DataFrame:
    """Objects with or without their manifest, counted by representation."""
    o = table(spark, d, "object_contents", "object_id", "manifest_id").distinct()
    m = table(spark, d, "content_manifests", "manifest_id", "representation").distinct()
    return hot_join(o, m, ["manifest_id"], "left").groupBy(F.coalesce("representation", F.lit("none")).alias("representation")).agg(F.count(F.lit(1)).alias("objects"))


def reference_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Stored against counted references of each blob, with issue codes; counts are made before the joins."""
    m = table(spark, d, "content_manifests", "manifest_id", "content_sha256").distinct()
    o = table(spark, d, "object_contents", "object_id", "manifest_id").distinct()
    roots = hot_join(o, m, ["manifest_id"]).groupBy(F.col("content_sha256").alias("sha256")).agg(F.count(F.lit(1)).alias("object_refs"))
    chunks = table(spark, d, "content_manifest_chunks", "manifest_id", "chunk_index", "chunk_sha256").distinct().groupBy(F.col("chunk_sha256").alias("sha256")).agg(F.count(F.lit(1)).alias("chunk_refs"))
    b = table(spark, d, "content_blobs", "sha256", "reference_count", "unreferenced_at").distinct()
    x = b.join(roots, "sha256", "left").join(chunks, "sha256", "left").na.fill(0, ["object_refs", "chunk_refs"]).withColumn("expected", F.col("object_refs") + F.col("chunk_refs"))
    issues = F.filter(
        F.array(
            F.when(F.col("reference_count") != F.col("expected"), F.lit("count_mismatch")),
            F.when((F.col("expected") > 0) & F.col("unreferenced_at").isNotNull(), F.lit("referenced_but_released")),
            F.when((F.col("expected") == 0) & F.col("unreferenced_at").isNull(), F.lit("release_time_missing")),
            F.when(F.col("unreferenced_at").isNotNull() & instant_us(F.col("unreferenced_at")).isNull(), F.lit("release_time_unreadable")),
        ),
        lambda i: i.isNotNull(),
    )
    return x.withColumn("issues", F.array_join(issues, ",")).where("issues <> ''").select("sha256", "reference_count", "object_refs", "chunk_refs", "expected", "issues")


def reference_delta(spark: SparkSession, d: str) -> DataFrame:
    """D3, G1: added and removed edges of blobs summed, where they do not cancel."""
    added = table(spark, d, "content_manifest_chunks", "manifest_id", "chunk_index", "chunk_sha256").distinct().where("chunk_sha256 IS NOT NULL").select(F.col("chunk_sha256").alias("sha256"), F.lit(1).alias("delta"))
    stored = table(spark, d, "content_blobs", "sha256", "reference_count").distinct().select("sha256", (-F.col("reference_count")).alias("delta"))
    return added.select("sha256", F.col("delta").cast("long")).unionByName(stored).groupBy("sha256").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def manifest_chunks_present(spark: SparkSession, d: str) -> DataFrame:
    """Manifests with their root blob, their chunks and those of them that have a blob (the blobs joined twice)."""
    m = table(spark, d, "content_manifests", "manifest_id", "content_sha256", "chunk_count").distinct()
    root = table(spark, d, "content_blobs", "sha256").distinct().select(F.col("sha256").alias("root"))
    part = root.select(F.col("root").alias("chunk_sha256"), F.lit(True).alias("part"))
    ch = table(spark, d, "content_manifest_chunks", "manifest_id", "chunk_index", "chunk_sha256").distinct()
    per = hot_join(ch, part, ["chunk_sha256"], "left").groupBy("manifest_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("part").alias("present"))
    x = m.join(root, F.col("content_sha256") == F.col("root")).join(per, "manifest_id", "left").na.fill(0, ["chunks", "present"])
    return x.select("manifest_id", "chunk_count", "chunks", "present", (F.col("chunks") == F.col("chunk_count")).alias("complete"))


def left_anti_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Manifests that no object uses."""
    return table(spark, d, "content_manifests", "manifest_id").distinct().join(table(spark, d, "object_contents", "manifest_id"), "manifest_id", "left_anti")


def extent_running_sum(spark: SparkSession, d: str) -> DataFrame:
    """Manifests with the number of places where their extents are not contiguous."""
    return c.contiguous_extents(table(spark, d, "content_manifest_chunks"))


def duplicate_content_groups(spark: SparkSession, d: str) -> DataFrame:
    """Objects that share a content digest."""
    g = table(spark, d, "golden", "id", "content_sha256").distinct().groupBy("content_sha256").agg(F.count(F.lit(1)).alias("objects"), F.min("id").alias("first_id")).where("objects > 1")
    return g


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with equal text, by digest."""
    x = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return x.groupBy("sha256").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_id")).where("documents > 1")


def cas_keys(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed keys, and whether the stored one and the digest are well formed."""
    b = table(spark, d, "content_blobs", "sha256", "cas_key").distinct()
    return b.select("sha256", cas_key(F.col("sha256")).alias("cas_key"), (F.col("cas_key") == cas_key(F.col("sha256"))).alias("agrees"), is_digest(F.col("sha256")).alias("is_digest"))


def key_inventory(spark: SparkSession, d: str) -> DataFrame:
    """All keys of catalog and storage with where they are known, counted per bucket."""
    i = table(spark, d, "inventory", "bucket", "object_key").withColumn("side", F.lit(1))
    s = table(spark, d, "sightings", "bucket", "object_key").withColumn("side", F.lit(2))
    keys = i.unionByName(s).groupBy("bucket", "object_key").agg(F.max(F.when(F.col("side") == 1, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("side") == 2, 1).otherwise(0)).alias("b"))
    return keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.expr("a = 1 AND b = 0")).alias("catalog_only"), F.count_if(F.expr("a = 0 AND b = 1")).alias("storage_only"), F.count_if(F.expr("a = 1 AND b = 1")).alias("both"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the catalog that storage lacks, with multiplicity, and keys that both have."""
    i, s = table(spark, d, "inventory", "bucket", "object_key"), table(spark, d, "sightings", "bucket", "object_key")
    less = i.exceptAll(s).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("except_all"))
    both = i.intersect(s).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("intersect"))
    return less.unionByName(both)


def scope_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    """Objects counted per budget scope (bucket or any, key prefix)."""
    b = table(spark, d, "budget_definitions", "budget_id", "definition").distinct()
    scopes = b.select("budget_id", F.get_json_object("definition", "$.bucket").alias("scope_bucket"), F.get_json_object("definition", "$.prefix").alias("scope_prefix"))
    o = table(spark, d, "inventory", "bucket", "object_key").distinct()
    return c.prefix_join(o, scopes).groupBy("budget_id").agg(F.count(F.lit(1)).alias("objects"))


def held_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects on which a hold without release lies, by object or prefix; each once."""
    h = table(spark, d, "legal_holds", "bucket", "object_key", "prefix", "released_at").where("released_at IS NULL").distinct()
    o = table(spark, d, "inventory", "bucket", "object_key").distinct()
    exact = h.where("object_key IS NOT NULL").select("bucket", "object_key")
    scopes = h.where("object_key IS NULL").select(F.col("bucket").alias("scope_bucket"), F.coalesce("prefix", F.lit("")).alias("scope_prefix")).distinct()
    under = c.prefix_join(o, scopes).select("bucket", "object_key")
    return o.join(exact.unionByName(under).distinct(), ["bucket", "object_key"], "left_semi")


def oldest_reservations(spark: SparkSession, d: str) -> DataFrame:
    """the 500 oldest reservations, which a bounded prune takes next."""
    r = table(spark, d, "budget_reservations", "move_id", "attempt", "created_at").select(F.concat_ws("/", "move_id", "attempt").alias("id"), instant_us(F.col("created_at")).alias("at_us")).distinct()
    return c.oldest(r, "at_us", "id", 500)


def latest_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The latest content of each object."""
    o = table(spark, d, "object_contents", "object_id", "manifest_id", "updated_at").select("object_id", instant_us(F.col("updated_at")).alias("at_us"), "manifest_id")
    return c.latest_per_key(o, ["object_id"], ["at_us"])


def first_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first reservation of each move and attempt."""
    r = table(spark, d, "budget_reservations", "move_id", "attempt", "budget_id", "created_at").select("move_id", "attempt", instant_us(F.col("created_at")).alias("at_us"), "budget_id")
    return c.first_write_wins(r, ["move_id", "attempt"], ["at_us"])


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the samples, chosen by hash; the sampling is the operator."""
    s = table(spark, d, "samples", "sample_id", "metric").distinct()
    return c.hash_sample(s, F.concat(F.lit("7:"), F.col("sample_id").cast("string")), 0.1).groupBy("metric").agg(F.count(F.lit(1)).alias("kept"))


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    """Objects by bucket, MIME type, metadata value and language."""
    g = table(spark, d, "golden", "id", "bucket", "key", "mime", "size", "object_metadata", "document_metadata")
    keep = (F.col("mime") == "application/pdf") & (F.col("object_metadata")["department"] == "legal") & (F.col("document_metadata.language") == "en") & F.col("size").isNotNull()
    return g.where(keep).select("id", "bucket", "key", "size").distinct()


def metadata_public(spark: SparkSession, d: str) -> DataFrame:
    """Metadata without hidden keys, bounded in size."""
    g = table(spark, d, "golden", "id", "object_metadata")
    m = c.bounded_metadata(c.without_keys(F.col("object_metadata"), ["retention_years"]), 30)
    return g.select("id", m.alias("m")).select("id", F.col("m.truncated").alias("truncated"), F.when(F.col("m.json") == "{}", 0).otherwise(1).alias("shown")).distinct()


def glob_names(spark: SparkSession, d: str) -> DataFrame:
    """Keys by file-name pattern."""
    return table(spark, d, "inventory", "bucket", "object_key").distinct().where(c.glob_match(F.col("object_key"), "q?/*.xml")).groupBy("bucket").agg(F.count(F.lit(1)).alias("objects"))


def blob_lifetimes(spark: SparkSession, d: str) -> DataFrame:
    """Chunk references joined with their blob where the manifest came while the blob was there (equi-join with inequalities)."""
    m = table(spark, d, "content_manifests", "manifest_id", "created_at").select("manifest_id", instant_us(F.col("created_at")).alias("made_us")).distinct()
    b = table(spark, d, "content_blobs", "sha256", "created_at", "unreferenced_at").select("sha256", instant_us(F.col("created_at")).alias("from_us"), instant_us(F.col("unreferenced_at")).alias("to_us")).distinct()
    ch = table(spark, d, "content_manifest_chunks", "manifest_id", "chunk_index", F.col("chunk_sha256").alias("sha256")).distinct()
    x = hot_join(hot_join(ch, m, ["manifest_id"]), b, ["sha256"]).where((F.col("made_us") >= F.col("from_us")) & (F.col("to_us").isNull() | (F.col("made_us") < F.col("to_us"))))
    return x.groupBy("sha256").agg(F.count(F.lit(1)).alias("live_refs"))


QUERIES = {f.__name__: f for f in (prefix_scan, keyset_page, object_content, content_or_none, reference_reconcile, reference_delta, manifest_chunks_present, left_anti_orphans, extent_running_sum, duplicate_content_groups, duplicate_texts, cas_keys, key_inventory, set_operations, scope_prefix_join, held_objects, oldest_reservations, latest_manifest, first_write_wins, hash_sample, metadata_filter, metadata_public, glob_names, blob_lifetimes)}

SQL = {
    "prefix_scan": "SELECT DISTINCT bucket, object_key, size FROM inventory WHERE starts_with(object_key, 'q1/')",
    "keyset_page": "SELECT DISTINCT bucket, object_key FROM inventory WHERE (bucket, object_key) > ('bkt-eu', 'q1/') ORDER BY bucket, object_key LIMIT 50",
    "object_content": "SELECT o.object_id, o.manifest_id, b.sha256, b.size, m.chunk_count FROM (SELECT DISTINCT object_id, manifest_id FROM object_contents) o JOIN (SELECT DISTINCT manifest_id, content_sha256, chunk_count FROM content_manifests) m USING (manifest_id) JOIN (SELECT DISTINCT sha256, size FROM content_blobs) b ON m.content_sha256 = b.sha256",
    "content_or_none": "SELECT coalesce(representation, 'none') AS representation, count(*) AS objects FROM (SELECT DISTINCT object_id, manifest_id FROM object_contents) o LEFT JOIN (SELECT DISTINCT manifest_id, representation FROM content_manifests) m USING (manifest_id) GROUP BY 1",
    "reference_reconcile": """
WITH roots AS (SELECT content_sha256 AS sha256, count(*) AS n FROM (SELECT DISTINCT object_id, manifest_id FROM object_contents) JOIN (SELECT DISTINCT manifest_id, content_sha256 FROM content_manifests) USING (manifest_id) GROUP BY 1),
parts AS (SELECT chunk_sha256 AS sha256, count(*) AS n FROM (SELECT DISTINCT manifest_id, chunk_index, chunk_sha256 FROM content_manifest_chunks) GROUP BY 1),
x AS (SELECT b.sha256, b.reference_count, b.unreferenced_at, coalesce(roots.n, 0) AS object_refs, coalesce(parts.n, 0) AS chunk_refs FROM (SELECT DISTINCT sha256, reference_count, unreferenced_at FROM content_blobs) b LEFT JOIN roots ON roots.sha256 = b.sha256 LEFT JOIN parts ON parts.sha256 = b.sha256),
y AS (SELECT sha256, reference_count, object_refs, chunk_refs, object_refs + chunk_refs AS expected, concat_ws(',', CASE WHEN reference_count <> object_refs + chunk_refs THEN 'count_mismatch' END, CASE WHEN object_refs + chunk_refs > 0 AND unreferenced_at IS NOT NULL THEN 'referenced_but_released' END, CASE WHEN object_refs + chunk_refs = 0 AND unreferenced_at IS NULL THEN 'release_time_missing' END, CASE WHEN unreferenced_at IS NOT NULL AND try_cast(unreferenced_at AS TIMESTAMPTZ) IS NULL THEN 'release_time_unreadable' END) AS issues FROM x)
SELECT * FROM y WHERE issues <> ''""",
    "reference_delta": "SELECT sha256, sum(delta)::BIGINT AS delta FROM (SELECT chunk_sha256 AS sha256, 1 AS delta FROM (SELECT DISTINCT manifest_id, chunk_index, chunk_sha256 FROM content_manifest_chunks WHERE chunk_sha256 IS NOT NULL) UNION ALL SELECT sha256, -reference_count FROM (SELECT DISTINCT sha256, reference_count FROM content_blobs)) GROUP BY 1 HAVING sum(delta) <> 0",
    "manifest_chunks_present": "SELECT m.manifest_id, m.chunk_count, coalesce(p.chunks, 0) AS chunks, coalesce(p.present, 0) AS present, coalesce(p.chunks, 0) = m.chunk_count AS complete FROM (SELECT DISTINCT manifest_id, content_sha256, chunk_count FROM content_manifests) m JOIN (SELECT DISTINCT sha256 FROM content_blobs) r ON r.sha256 = m.content_sha256 LEFT JOIN (SELECT manifest_id, count(*) AS chunks, count(b.sha256) AS present FROM (SELECT DISTINCT manifest_id, chunk_index, chunk_sha256 FROM content_manifest_chunks) ch LEFT JOIN (SELECT DISTINCT sha256 FROM content_blobs) b ON b.sha256 = ch.chunk_sha256 GROUP BY 1) p ON p.manifest_id = m.manifest_id",
    "left_anti_orphans": "SELECT DISTINCT manifest_id FROM content_manifests m WHERE NOT EXISTS (SELECT 1 FROM object_contents o WHERE o.manifest_id = m.manifest_id)",
    "extent_running_sum": "SELECT manifest_id, count(*) AS chunks, sum(byte_length)::BIGINT AS bytes, count(*) FILTER (byte_offset <> before OR chunk_index <> k) AS breaks FROM (SELECT *, coalesce(sum(byte_length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER w - 1 AS k FROM (SELECT DISTINCT manifest_id, chunk_index, byte_offset, byte_length FROM content_manifest_chunks) WINDOW w AS (PARTITION BY manifest_id ORDER BY chunk_index, byte_offset, byte_length)) GROUP BY 1",
    "duplicate_content_groups": "SELECT content_sha256, count(*) AS objects, min(id) AS first_id FROM (SELECT DISTINCT id, content_sha256 FROM golden) GROUP BY 1 HAVING count(*) > 1",
    "duplicate_texts": "SELECT sha256(text) AS sha256, count(*) AS documents, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "cas_keys": "SELECT DISTINCT sha256, 'cas/v1/sha256/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3) AS cas_key, cas_key = 'cas/v1/sha256/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3) AS agrees, regexp_full_match(sha256, '[0-9a-f]{64}') AS is_digest FROM content_blobs",
    "key_inventory": "SELECT coalesce(i.bucket, s.bucket) AS bucket, count(*) AS keys, count(*) FILTER (s.bucket IS NULL) AS catalog_only, count(*) FILTER (i.bucket IS NULL) AS storage_only, count(*) FILTER (i.bucket IS NOT NULL AND s.bucket IS NOT NULL) AS both FROM (SELECT DISTINCT bucket, object_key FROM inventory) i FULL JOIN (SELECT DISTINCT bucket, object_key FROM sightings) s ON i.bucket = s.bucket AND i.object_key = s.object_key GROUP BY 1",
    "set_operations": "SELECT bucket, count(*) AS n, 'except_all' AS what FROM (SELECT bucket, object_key FROM inventory EXCEPT ALL SELECT bucket, object_key FROM sightings) GROUP BY 1 UNION ALL SELECT bucket, count(*), 'intersect' FROM (SELECT bucket, object_key FROM inventory INTERSECT SELECT bucket, object_key FROM sightings) GROUP BY 1",
    "scope_prefix_join": "SELECT b.budget_id, count(*) AS objects FROM (SELECT DISTINCT budget_id, definition ->> '$.bucket' AS bucket, coalesce(definition ->> '$.prefix', '') AS prefix FROM budget_definitions) b JOIN (SELECT DISTINCT bucket, object_key FROM inventory) o ON (b.bucket IS NULL OR b.bucket = o.bucket) AND starts_with(o.object_key, b.prefix) GROUP BY 1",
    "held_objects": "SELECT DISTINCT o.bucket, o.object_key FROM inventory o WHERE EXISTS (SELECT 1 FROM legal_holds h WHERE h.released_at IS NULL AND h.bucket = o.bucket AND (h.object_key = o.object_key OR (h.object_key IS NULL AND starts_with(o.object_key, coalesce(h.prefix, '')))))",
    "oldest_reservations": "SELECT DISTINCT move_id || '/' || attempt AS id, epoch_us(created_at::TIMESTAMPTZ) AS at_us FROM budget_reservations ORDER BY at_us, id LIMIT 500",
    "latest_manifest": "SELECT object_id, epoch_us(updated_at::TIMESTAMPTZ) AS at_us, manifest_id FROM object_contents QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY epoch_us(updated_at::TIMESTAMPTZ) DESC, manifest_id DESC NULLS LAST) = 1",
    "first_write_wins": "SELECT move_id, attempt, epoch_us(created_at::TIMESTAMPTZ) AS at_us, budget_id FROM budget_reservations QUALIFY row_number() OVER (PARTITION BY move_id, attempt ORDER BY epoch_us(created_at::TIMESTAMPTZ), budget_id NULLS FIRST) = 1",
    "hash_sample": "SELECT metric, count(*) AS kept FROM (SELECT DISTINCT sample_id, metric FROM samples) WHERE sha256('7:' || sample_id) < '%064x' GROUP BY 1" % int(0.1 * (1 << 256)),
    "metadata_filter": "SELECT DISTINCT id, bucket, key, size FROM golden WHERE mime = 'application/pdf' AND object_metadata['department'] = 'legal' AND document_metadata.language = 'en' AND size IS NOT NULL",
    "metadata_public": "SELECT DISTINCT id, coalesce(octet_length(encode(j)) > 30, FALSE) AS truncated, CASE WHEN octet_length(encode(j)) > 30 OR j = '{}' THEN 0 ELSE 1 END AS shown FROM (SELECT id, '{' || array_to_string(list_transform(list_filter(map_entries(object_metadata), lambda e: e.key <> 'retention_years'), lambda e: '\"' || e.key || '\":\"' || e.value || '\"'), ',') || '}' AS j FROM golden)",
    "glob_names": "SELECT bucket, count(*) AS objects FROM (SELECT DISTINCT bucket, object_key FROM inventory) WHERE object_key GLOB 'q?/*.xml' GROUP BY 1",
    "blob_lifetimes": "SELECT b.sha256, count(*) AS live_refs FROM (SELECT DISTINCT manifest_id, chunk_index, chunk_sha256 FROM content_manifest_chunks) ch JOIN (SELECT DISTINCT manifest_id, created_at::TIMESTAMPTZ AS made FROM content_manifests) m USING (manifest_id) JOIN (SELECT DISTINCT sha256, created_at::TIMESTAMPTZ AS f, unreferenced_at::TIMESTAMPTZ AS t FROM content_blobs) b ON b.sha256 = ch.chunk_sha256 AND m.made >= b.f AND (b.t IS NULL OR m.made < b.t) GROUP BY 1",
}
