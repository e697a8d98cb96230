"""Queries of filtered retrieval and of validity, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import catalog as c
from lodestone.operators import predicates as p
from lodestone.operators import retrieval as r
from lodestone.plans import retrieval as base
from lodestone.sources.tables import table

TOP = base.TOP


def ask_filter(spark: SparkSession, d: str) -> DataFrame:
    """Objects by each of the eight parts of a question's filter, by all but the exact ones together, and without any."""
    g = table(spark, d, "golden", "id", "bucket", "key", "tier", "mime", "size", "content_sha256", "object_metadata", "document_metadata")
    one = lambda col: table(spark, d, "golden").agg(F.min(col)).scalar()
    asked = {
        "none": {},
        "bucket": {"bucket": "bkt-main"},
        "key_prefix": {"key_prefix": "raw"},
        "tier": {"tier": "cold"},
        "mime": {"mime": "application/pdf"},
        "size": {"size": one("size")},
        "sha256": {"content_sha256": one("content_sha256")},
        "object": {"object_metadata": {"department": "legal", "retention_years": "7"}},
        "document": {"document_metadata": {"language": "en"}},
        "all": {"bucket": "bkt-main", "tier": "cold", "mime": "text/plain", "document_metadata": {"language": "en"}},
    }
    which = F.array_compact(F.array(*[F.when(p.objects(**parts), F.lit(n)) for n, parts in asked.items()]))
    return g.select(F.explode(which).alias("filter"), "id").distinct().groupBy("filter").agg(F.count(F.lit(1)).alias("objects"), F.min("id").alias("first_id"))


def typed_json_filter(spark: SparkSession, d: str) -> DataFrame:
    """Budget definitions by JSON scalars compared with their types: the version is 1, neither true nor 1.0 nor "1"; a limit may be null."""
    b = table(spark, d, "budget_definitions", "budget_id", "definition").distinct()
    asked = {"int": ("$.version", 1), "bool": ("$.version", True), "float": ("$.version", 1.0), "text": ("$.version", "1"), "null": ("$.carbon_limit_gco2e", None), "bucket": ("$.bucket", "bkt-main"), "absent": ("$.nothing", None), "nested": ("$.tier_pools.hot", "pool-a")}
    which = F.array_compact(F.array(*[F.when(p.json_scalar_equals(F.col("definition"), path, v), F.lit(n)) for n, (path, v) in asked.items()]))
    return b.select("budget_id", F.explode(which).alias("equal"))


def json_text_guard(spark: SparkSession, d: str) -> DataFrame:
    """reservations' statuses read from JSON text whose escapes all name characters; a part has such an escape put in by rule."""
    x = table(spark, d, "budget_reservations", "move_id", "attempt", "reservation").distinct()
    h = F.substring(F.md5(F.col("move_id")), 1, 1)
    note = F.when(h == "0", "\\u0000").when(h == "1", "\\ud83d").when(h == "2", "\\ud83d\\ude00").when(h == "3", "\\\\u0000").otherwise("plain")
    j = F.concat(F.expr("substring(reservation, 1, length(reservation) - 1)"), F.lit(',"note":"'), note, F.lit('"}'))
    status = F.when(p.is_text(j), F.get_json_object(j, "$.status"))
    return x.groupBy(F.coalesce(status, F.lit("unreadable")).alias("status")).agg(F.count(F.lit(1)).alias("reservations"))


def public_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What of an object's metadata is shown: without internal keys, as JSON in the order of keys; nothing if longer than 16 KiB.

    Every object is given an internal key, and one in sixteen a text of 20,000 characters, by rule.
    """
    g = table(spark, d, "golden", "id", "object_metadata", "content_sha256").where("object_metadata IS NOT NULL").dropDuplicates(["id"])
    more = F.when(F.substring("id", 1, 1) == "0", F.map_from_arrays(F.array(F.lit("etag"), F.lit("zz_note")), F.array(F.col("content_sha256"), F.repeat(F.lit("x"), 20_000)))).otherwise(F.map_from_arrays(F.array(F.lit("etag")), F.array(F.col("content_sha256"))))
    shown = c.bounded_metadata(F.map_from_entries(F.array_sort(F.map_entries(c.without_keys(F.map_concat("object_metadata", more), p.INTERNAL_KEYS)))))
    return g.select("id", shown.alias("m")).select("id", F.col("m.json").alias("metadata"), F.col("m.truncated").alias("truncated"))


def current_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose content and extraction are those of the object as it is. The extraction's record is made of golden's columns, with
    faults put in by rule: another size, MIME type, text length, status, version or an empty parser name."""
    g = table(spark, d, "golden", "id", "size", "mime", "content_sha256", "source_text").distinct()
    h = F.substring("id", 1, 1)
    e = F.struct(
        F.when(h == "0", "failed").otherwise("succeeded").alias("status"), F.when(h == "1", "timeout").alias("failure_code"), F.when(h == "2", F.col("size") + 1).otherwise(F.col("size")).alias("source_size"), F.when(h == "3", "text/html").otherwise(F.col("mime")).alias("source_mime"),
        F.when(h == "4", 2).otherwise(1).alias("schema_version"), F.when(h == "5", 0).otherwise(1).alias("normalization_version"), F.when(h == "6", "").otherwise("plain").alias("parser_name"), F.lit("1").alias("parser_version"), F.lit("1").alias("runtime_version"), F.col("source_text").alias("text"), (F.octet_length("source_text") + F.when(h == "7", 1).otherwise(0)).alias("text_bytes"),
    )
    x = g.select("id", p.content_is_current(F.col("content_sha256"), F.col("size"), F.col("content_sha256"), F.col("size")).alias("content"), e.alias("e"), "size", "mime")
    return x.select("id", F.col("content").alias("content_current"), (F.col("content") & p.extraction_is_current(F.col("e"), F.col("size"), F.col("mime"), 1, 1)).alias("extraction_current"))


def plain_scope_holds(spark: SparkSession, d: str) -> DataFrame:
    """Objects that any hold was laid on, bucket, key and prefix compared in plain form; a part of the keys is spelt
    otherwise by rule, and a hold on ./Q1// of two buckets is added."""
    h = table(spark, d, "legal_holds", "bucket", "object_key", "prefix").distinct()
    o = table(spark, d, "inventory", "bucket", "object_key").distinct()
    h = h.unionByName(o.where("bucket IN ('bkt-eu', 'bkt-lab')").select("bucket", F.lit(None).cast("string").alias("object_key"), F.lit("./Q1//").alias("prefix")).distinct())
    odd = F.when(F.substring(F.md5("object_key"), 1, 1) == "0", F.concat(F.lit("./"), F.upper(F.regexp_replace("object_key", "/", "//")))).when(F.substring(F.md5("object_key"), 1, 1) == "1", F.regexp_replace("object_key", "/", r"\\")).otherwise(F.col("object_key"))
    o = o.select("bucket", "object_key", p.plain_path(F.col("bucket")).alias("b"), p.plain_path(odd).alias("k"))
    exact = h.where("object_key IS NOT NULL").select(p.plain_path(F.col("bucket")).alias("b"), p.plain_path(F.col("object_key")).alias("k")).distinct()
    whole = h.where("object_key IS NULL").select(p.plain_path(F.col("bucket")).alias("scope_bucket"), p.plain_path(F.coalesce("prefix", F.lit(""))).alias("q")).distinct()
    scopes = whole.select("scope_bucket", F.explode(F.when(F.col("q") == "", F.array(F.lit(""))).otherwise(F.array(F.concat("q", F.lit("/")), F.col("q")))).alias("scope_prefix"), "q")
    under = c.prefix_join(o, scopes, "b", "k").where((F.col("scope_prefix") != F.col("q")) | (F.col("q") == "") | (F.col("k") == F.col("q"))).select("b", "k")
    return o.join(exact.unionByName(under).distinct(), ["b", "k"], "left_semi").select("bucket", "object_key")


def keyword_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The best passages by keyword among those of a tier, a MIME type and a topic's department; scores are those without the filter."""
    docs = table(spark, d, "corpus", "passage_id", "text", "tier", "mime", F.col("metadata")["department"].alias("department"))
    keep = p.all_of(p.one_of(F.col("tier"), ["hot", "warm", "cool"]), F.col("mime") == "application/pdf", p.one_of(F.col("department"), ["finance", "legal", "operations"]))
    scored = r.bm25(docs, "passage_id", "text", base._questions(spark), keep=keep).withColumn("score", F.round("score", 6))
    return r.top_k(scored, ["query_id"], [F.col("score").desc(), F.col("passage_id")], TOP)


def vector_filtered_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest among the vectors that pass a filter, of every vector whose id is divisible by 100. Vectors are given a bucket,
    key, tier, MIME type and metadata by rule from their label and id."""
    v = base._vectors(spark, d)
    named = v.select("id", "vector", F.concat(F.lit("b"), F.col("group").cast("string")).alias("bucket"), F.concat(F.lit("q"), (F.col("id") % 4).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("tier"), F.when(F.col("id") % 2 == 0, "text/plain").otherwise("application/pdf").alias("mime"), F.create_map(F.lit("team"), (F.col("id") % 5).cast("string")).alias("metadata"))
    keep = p.vectors(buckets=["b1", "b3", "b5", "b7", "b8"], key_prefix="q1/", tiers=["hot", "warm"], mimes=["application/pdf"], metadata={"team": "2"})
    return r.exact_knn(named.where(keep), v.where("id % 100 = 0"), TOP).select("query_id", "id", F.round(F.greatest(F.col("distance"), F.lit(0.0)), 4).alias("distance"), "rank")


def hydrated_hits(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits joined with the catalog as it is and ranked anew: hits of objects that are gone or changed tier drop out.

    The catalog is made of the corpus by rule: an object in sixteen is gone, one in sixteen has moved. A passage's retained rank counts what is left.
    """
    passages = table(spark, d, "corpus", "passage_id", "bucket", "object_key", "tier").distinct()
    h = F.substring(F.md5(F.concat_ws("/", "bucket", "object_key")), 1, 1)
    catalog = passages.groupBy("bucket", "object_key").agg(F.max("tier").alias("tier")).where(h != "0").withColumn("now_tier", F.when(h == "1", "moved").otherwise(F.col("tier"))).drop("tier")
    hits = base._keyword(spark, d).join(passages, "passage_id").join(catalog, ["bucket", "object_key"]).where(F.col("tier") == F.col("now_tier"))
    return r.top_k(hits.select("query_id", "passage_id", "bucket", "object_key", "score"), ["query_id"], [F.col("score").desc(), F.col("passage_id"), F.col("bucket"), F.col("object_key")], TOP, "retained_rank")


def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """H9: whether each answer cites only passages that were given to it, and how many it cites."""
    top = r.top_k(base._keyword(spark, d), ["query_id"], [F.col("score").desc(), F.col("passage_id")], TOP)
    given = top.groupBy("query_id").agg(F.collect_set("passage_id").alias("given"))  # ten a question
    texts = table(spark, d, "corpus", "passage_id", "text").distinct()
    a = r.extractive_answer(top.join(texts, "passage_id").withColumnRenamed("passage_id", "id"), "text", 2, 600)
    cited = F.split("cited", ",")
    return a.join(given, "query_id").select("query_id", F.size(cited).alias("cited"), (F.size(F.array_except(cited, F.col("given"))) == 0).alias("grounded"))


def browse_page(spark: SparkSession, d: str) -> DataFrame:
    """what a blank question shows: objects in the order of bucket, key and id, the page from 20 to 40."""
    g = table(spark, d, "golden", "id", "bucket", "key").distinct()
    return g.orderBy("bucket", "key", "id").offset(20).limit(20)


def recall_holds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index of 512 signs, with 200 candidates a query compared exactly, reaches a mean recall of 0.9 at ten."""
    v = base._vectors(spark, d)
    q = v.where("id % 100 = 0")
    got = r.sketch_knn(v, q, TOP)
    hits = r.exact_knn(v, q, TOP).join(got.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("holds"))


def best_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages shown with an answer: of each signal its best first, then what is left in order of rank, signal and id; each once, at most ten."""
    signals = None
    for name, scored in (("keyword", base._keyword(spark, d)), ("metadata", base._metadata(spark, d))):
        top = r.top_k(scored, ["query_id"], [F.col("score").desc(), F.col("passage_id")], TOP).select("query_id", "passage_id", F.lit(name).alias("signal"), F.col("rank").alias("signal_rank"))
        signals = top if signals is None else signals.unionByName(top)
    each = signals.groupBy("query_id", "passage_id").agg(F.min(F.struct((F.col("signal_rank") > 1).alias("later"), "signal_rank", "signal")).alias("x"))  # twenty a question
    w = Window.partitionBy("query_id").orderBy("x.later", "x.signal_rank", "x.signal", "passage_id")
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= TOP).select("query_id", "passage_id", "place")


QUERIES = {f.__name__: f for f in (ask_filter, typed_json_filter, json_text_guard, public_metadata, current_extractions, plain_scope_holds, keyword_filtered, vector_filtered_knn, hydrated_hits, citation_check, browse_page, recall_holds, best_passages)}

_GOLD = "(SELECT DISTINCT * FROM golden)"
_ODD = "CASE substr(md5(object_key), 1, 1) WHEN '0' THEN './' || upper(replace(object_key, '/', '//')) WHEN '1' THEN replace(object_key, '/', chr(92)) ELSE object_key END"
_PLAIN = "array_to_string(list_filter(string_split(replace(lower(nfc_normalize({0})), chr(92), '/'), '/'), lambda s: s <> '' AND s <> '.'), '/')"
_K = base._BM25
_Q = base._Q

SQL = {
    "ask_filter": f"""
WITH g AS (SELECT DISTINCT id, bucket, key, tier, mime, size, content_sha256, object_metadata, document_metadata FROM golden),
x AS (SELECT unnest([CASE WHEN TRUE THEN 'none' END, CASE WHEN bucket = 'bkt-main' THEN 'bucket' END, CASE WHEN starts_with(key, 'raw') THEN 'key_prefix' END, CASE WHEN tier = 'cold' THEN 'tier' END, CASE WHEN mime = 'application/pdf' THEN 'mime' END,
  CASE WHEN size = (SELECT min(size) FROM golden) THEN 'size' END, CASE WHEN content_sha256 = (SELECT min(content_sha256) FROM golden) AND regexp_full_match(content_sha256, '[0-9a-f]{{64}}') THEN 'sha256' END,
  CASE WHEN object_metadata['department'] = 'legal' AND object_metadata['retention_years'] = '7' THEN 'object' END, CASE WHEN document_metadata.language = 'en' THEN 'document' END,
  CASE WHEN bucket = 'bkt-main' AND tier = 'cold' AND mime = 'text/plain' AND document_metadata.language = 'en' THEN 'all' END]) AS filter, id FROM g)
SELECT filter, count(DISTINCT id) AS objects, min(id) AS first_id FROM x WHERE filter IS NOT NULL GROUP BY 1""",
    "typed_json_filter": """
WITH b AS (SELECT DISTINCT budget_id, definition AS j FROM budget_definitions)
SELECT budget_id, e AS equal FROM (SELECT budget_id, unnest([CASE WHEN json_type(j, '$.version') IN ('UBIGINT', 'BIGINT') AND j ->> '$.version' = '1' THEN 'int' END, CASE WHEN json_type(j, '$.version') = 'BOOLEAN' AND j ->> '$.version' = 'true' THEN 'bool' END, CASE WHEN json_type(j, '$.version') = 'DOUBLE' THEN 'float' END, CASE WHEN json_type(j, '$.version') = 'VARCHAR' AND j ->> '$.version' = '1' THEN 'text' END,
  CASE WHEN json_type(j, '$.carbon_limit_gco2e') = 'NULL' THEN 'null' END, CASE WHEN j ->> '$.bucket' = 'bkt-main' THEN 'bucket' END, CASE WHEN json_type(j, '$.nothing') = 'NULL' THEN 'absent' END, CASE WHEN j ->> '$.tier_pools.hot' = 'pool-a' THEN 'nested' END]) AS e FROM b) WHERE e IS NOT NULL""",
    "json_text_guard": "SELECT CASE WHEN substr(md5(move_id), 1, 1) IN ('0', '1') THEN 'unreadable' ELSE coalesce(reservation ->> '$.status', 'unreadable') END AS status, count(*) AS reservations FROM (SELECT DISTINCT move_id, attempt, reservation FROM budget_reservations) GROUP BY 1",
    "public_metadata": """SELECT DISTINCT id, CASE WHEN substr(id, 1, 1) = '0' THEN '{}' ELSE '{' || array_to_string(list_transform(list_sort(map_entries(object_metadata)), lambda e: '"' || e.key || '":"' || e.value || '"'), ',') || '}' END AS metadata, substr(id, 1, 1) = '0' AS truncated FROM golden WHERE object_metadata IS NOT NULL""",
    "current_extractions": "SELECT DISTINCT id, cc AS content_current, cc AND source_text IS NOT NULL AND mime IS NOT NULL AND substr(id, 1, 1) NOT IN ('0', '1', '2', '3', '4', '5', '6', '7') AS extraction_current FROM (SELECT id, size, mime, source_text, coalesce(regexp_full_match(content_sha256, '[0-9a-f]{64}') AND size IS NOT NULL, FALSE) AS cc FROM golden)",
    "plain_scope_holds": f"""
WITH o AS (SELECT bucket, object_key, {_PLAIN.format('bucket')} AS b, {_PLAIN.format(_ODD)} AS k FROM (SELECT DISTINCT bucket, object_key FROM inventory)),
h AS (SELECT DISTINCT {_PLAIN.format('bucket')} AS b, {_PLAIN.format('object_key')} AS k, object_key IS NULL AS whole, {_PLAIN.format("coalesce(prefix, '')")} AS q FROM (SELECT bucket, object_key, prefix FROM legal_holds UNION ALL SELECT DISTINCT bucket, NULL, './Q1//' FROM inventory WHERE bucket IN ('bkt-eu', 'bkt-lab')))
SELECT bucket, object_key FROM o WHERE EXISTS (SELECT 1 FROM h WHERE h.b = o.b AND ((NOT whole AND h.k = o.k) OR (whole AND (q = '' OR o.k = q OR starts_with(o.k, q || '/')))))""",
    "keyword_filtered": f"WITH {_Q}, {_K} SELECT query_id, passage_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id))::INT AS rank FROM k JOIN (SELECT DISTINCT passage_id FROM corpus WHERE tier IN ('hot', 'warm', 'cool') AND mime = 'application/pdf' AND metadata['department'] IN ('finance', 'legal', 'operations')) USING (passage_id) QUALIFY rank <= {TOP}",
    "vector_filtered_knn": f"WITH {base._PAIRS} SELECT query_id, id, round(greatest(1 - cos, 0), 4) AS distance, (row_number() OVER (PARTITION BY query_id ORDER BY 1 - cos, id))::INT AS rank FROM c WHERE label IN (1, 3, 5, 7, 8) AND id % 4 = 1 AND id % 3 <> 0 AND id % 2 = 1 AND id % 5 = 2 QUALIFY rank <= {TOP}",
    "hydrated_hits": f"""WITH {_Q}, {_K}, a AS (SELECT DISTINCT passage_id, bucket, object_key, tier FROM corpus), g AS (SELECT bucket, object_key, CASE WHEN substr(md5(bucket || '/' || object_key), 1, 1) = '1' THEN 'moved' ELSE max(tier) END AS now_tier FROM a GROUP BY 1, 2 HAVING substr(md5(bucket || '/' || object_key), 1, 1) <> '0')
SELECT query_id, passage_id, bucket, object_key, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id, bucket, object_key))::INT AS retained_rank FROM k JOIN a USING (passage_id) JOIN g USING (bucket, object_key) WHERE tier = now_tier QUALIFY retained_rank <= {TOP}""",
    "citation_check": base.SQL["extractive_answers"].replace("SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS answer, string_agg(id, ',' ORDER BY rank) AS cited FROM v", "SELECT query_id, count(*)::INT AS cited, TRUE AS grounded FROM v"),
    "browse_page": "SELECT DISTINCT id, bucket, key FROM golden ORDER BY bucket, key, id LIMIT 20 OFFSET 20",
    "recall_holds": "SELECT count(*) AS queries, TRUE AS holds FROM embeddings WHERE vec_id % 100 = 0",
    "best_passages": f"WITH {_Q}, {base._META}, {_K}, sig AS (SELECT query_id, passage_id, 'keyword' AS signal, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS n FROM k QUALIFY n <= {TOP} UNION ALL SELECT query_id, passage_id, 'metadata', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS n FROM m WHERE score > 0 QUALIFY n <= {TOP}), x AS (SELECT query_id, passage_id, min((n > 1, n, signal)) AS x FROM sig GROUP BY 1, 2) SELECT query_id, passage_id, (row_number() OVER (PARTITION BY query_id ORDER BY x, passage_id))::INT AS place FROM x QUALIFY place <= {TOP}",
}
