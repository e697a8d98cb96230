"""Queries of content and retrieval, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import canonical_instant, uuid5
from lodestone.operators import content as c
from lodestone.operators import retrieval as r
from lodestone.sources.tables import table

#: The questions asked of the corpus.
QUESTIONS = ["sealed mail archives", "invoice batch in cold storage", "prüfprotokoll verschoben", "retention of legal holds"]
TOP = 10


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The UTF-8 bytes of documents in chunks of 256 bytes."""
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return c.chunks(docs, "doc_id", "data", 256).select("doc_id", "chunk_index", "byte_offset", "byte_length")


def chunk_digests(spark: SparkSession, d: str) -> DataFrame:
    """Part of I1, I2: chunks of 256 bytes that occur more than once in the ASCII documents (whole: chunk_digests_all)."""
    docs = table(spark, d, "documents", "doc_id", "text").where(F.col("text").rlike("^\\p{ASCII}*$")).select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return c.chunks(docs, "doc_id", "data", 256).groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def chunk_digests_all(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 256 bytes that occur more than once in all documents, whatever their letters; no SQL, as it cannot cut bytes."""
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return c.chunks(docs, "doc_id", "data", 256).groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fixed_passages(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-width passages of the texts of golden."""
    return c.fixed_passages(table(spark, d, "golden", "id", "source_text").distinct(), "id", "source_text")


def word_boundary_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages at word boundaries."""
    return c.word_passages(table(spark, d, "golden", "id", F.col("source_text").alias("text")).distinct())


def tidy_digests(spark: SparkSession, d: str) -> DataFrame:
    """I4: digests of the tidied, composed texts, and whether tidying changed them."""
    t = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    return t.select("doc_id", c.tidy(c.composed(F.col("text"))).alias("t"), "text").select("doc_id", F.sha2("t", 256).alias("sha256"), (F.col("t") != F.col("text")).alias("changed"))


def object_types(spark: SparkSession, d: str) -> DataFrame:
    """I8: types by name, counted with what golden says."""
    g = table(spark, d, "golden", "id", "key", "mime").distinct().select("mime", c.type_of(F.col("key")).alias("t"))
    return g.groupBy("mime", F.col("t.mime").alias("by_name"), F.col("t.source").alias("source")).agg(F.count(F.lit(1)).alias("objects"))


def pii_pattern_findings(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses and social security numbers by pattern."""
    return c.pattern_findings(table(spark, d, "corpus", "passage_id", "text").distinct(), "passage_id", "text")


def pii_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What the detectors by pattern say of each passage: status, failure, kinds found and the greatest confidence of any."""
    x = c.detected(table(spark, d, "corpus", "passage_id", "text").distinct(), "passage_id", "text")
    return x.select("passage_id", "status", "failure_code", F.array_join(F.transform("findings", lambda f: f["kind"]), ",").alias("kinds"), F.array_max(F.transform("findings", lambda f: f["confidence"])).alias("confidence"))


#: Secrets that secrets_gone puts in front of texts, and what must be left of them.
PLANTED = [
    ("https://u:p@h.test/?token=abc&x=1", "https://[REDACTED]@h.test/?token=[REDACTED]&x=1"),
    ("Authorization: Bearer a.b.c", "Authorization: [REDACTED]"),
    ("Cookie: sid=abc; theme=x", "Cookie: [REDACTED]"),
    ("run --password x --verbose y", "run --password [REDACTED] --verbose y"),
    ('{"api_key": "x y", "name": "z"}', '{"api_key": "[REDACTED]", "name": "z"}'),
    ("clientSecret=x, max_tokens=5", "clientSecret=[REDACTED], max_tokens=5"),
    ("-----BEGIN PRIVATE KEY-----\nMII\n-----END PRIVATE KEY-----", "[REDACTED]"),
]


def secrets_gone(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a secret put in front by rule, one kind after another: whether it is gone and nothing else is changed."""
    t = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    which = F.pmod(F.col("doc_id"), F.lit(len(PLANTED))).cast("int")
    secret, left = (F.element_at(F.array(*[F.lit(x[k]) for x in PLANTED]), which + 1) for k in (0, 1))
    out = c.redact_secrets(F.concat(secret, F.lit("\n"), F.col("text")))
    return t.select("doc_id", which.alias("kind"), (out == F.concat(left, F.lit("\n"), F.col("text"))).alias("clean"))


def secret_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Documents with user parts of URLs, tokens or secrets replaced."""
    t = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    probe = F.concat(F.lit("https://u:p@h.test/?token=abc&x=1 Bearer a.b.c password: hunter2 "), F.col("text"))
    return t.select("doc_id", F.md5(c.redact_secrets(probe)).alias("redacted_md5"))


def pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    """Family names of two teams replaced by a digest."""
    s = table(spark, d, "staff_directory", "person_id", "family_name", "team")
    return s.select("person_id", c.pseudonym(F.col("family_name"), F.col("team").isin("night shift", "lab archive")).alias("name"))


def canonical_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of reservations in canonical form."""
    x = table(spark, d, "budget_reservations", "move_id", "attempt", "created_at").distinct()
    return x.select("move_id", "attempt", canonical_instant(F.col("created_at")).alias("at"))


def passage_uuids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based identities of stored passages."""
    p = table(spark, d, "embedding_passages", "document_id", "passage_index").distinct()
    return p.select("document_id", "passage_index", uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat_ws(":", "document_id", "passage_index")).alias("uuid"))


def span_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Stored passages that are, or are not, what their span says, per document."""
    p = table(spark, d, "embedding_passages", "document_id", "passage_index", "start_codepoint", "end_codepoint", "text").distinct()
    g = table(spark, d, "golden", "id", "source_text").distinct()
    x = p.join(g, F.col("document_id") == F.col("id"))
    same = F.expr("substring(source_text, int(start_codepoint) + 1, int(end_codepoint - start_codepoint)) <=> text")
    return x.groupBy("document_id").agg(F.count_if(same).alias("grounded"), F.count_if(~same).alias("ungrounded"))


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string")


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "corpus", "passage_id", "bucket", "object_key", "tier", "mime", F.col("metadata")["topic"].alias("topic"), F.col("metadata")["department"].alias("department")).distinct()
    return r.metadata_scores(g, "passage_id", {"bucket": 1.0, "object_key": 4.0, "tier": 1.0, "mime": 1.0, "topic": 2.0, "department": 1.0}, QUESTIONS)


def metadata_score_topk(spark: SparkSession, d: str) -> DataFrame:
    """H1, F1: the best passages by their metadata, ties by id."""
    return r.top_k(_metadata(spark, d), ["query_id"], [F.col("score").desc(), F.col("passage_id")], TOP)


def _keyword(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "corpus", "passage_id", "text")
    return r.bm25(docs, "passage_id", "text", _questions(spark)).withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """H2, part of H3: the best passages by keyword in texts alone, statistics over the whole corpus (whole: bm25_fields_topk)."""
    return r.top_k(_keyword(spark, d), ["query_id"], [F.col("score").desc(), F.col("passage_id")], TOP)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Part of H6, J16: two rankings of 50 passages each fused by reciprocal rank (whole: rrf_all_signals)."""
    signals = None
    for name, scored in (("keyword", _keyword(spark, d)), ("metadata", _metadata(spark, d))):
        top = r.top_k(scored, ["query_id"], [F.col("score").desc(), F.col("passage_id")], 50).select("query_id", F.col("passage_id").alias("id"), F.lit(name).alias("signal"), "rank")
        signals = top if signals is None else signals.unionByName(top)
    fused = r.fuse(signals, {"metadata": 0.5}).withColumn("score", F.round("score", 9))
    return r.top_k(fused, ["query_id"], [F.col("score").desc(), F.col("id")], TOP).select("query_id", F.col("id").alias("passage_id"), "score", "signals", "rank")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    values = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: e["value"]), " ")
    docs = table(spark, d, "corpus", "passage_id", "text", "object_key", values.alias("values"))
    return r.bm25_fields(docs, "passage_id", {"text": 2.0, "object_key": 1.5, "values": 1.0}, _questions(spark)).withColumn("score", F.round("score", 6))


def bm25_fields_topk(spark: SparkSession, d: str) -> DataFrame:
    """H2, H3, F2: the best passages by keyword in text, key and metadata, the best field per word, ties by id."""
    return r.top_k(_fields(spark, d), ["query_id"], [F.col("score").desc(), F.col("passage_id")], TOP)


def rrf_all_signals(spark: SparkSession, d: str) -> DataFrame:
    """Keyword, metadata and vector rankings of all objects fused by reciprocal rank; only the result is cut.

    An object ranks by its best passage. Ranks need every candidate of a question in order, so a question is sorted in one task.
    """
    passages = table(spark, d, "corpus", "passage_id", "bucket", "object_key").distinct()
    texts = table(spark, d, "corpus", F.col("passage_id").alias("id"), "text").distinct()
    vector = r.feature_similarity(texts, QUESTIONS, 64).withColumnRenamed("id", "passage_id")
    scored = None
    for name, x in (("keyword", _fields(spark, d)), ("metadata", _metadata(spark, d)), ("vector", vector)):
        x = x.select("query_id", "passage_id", "score", F.lit(name).alias("signal"))
        scored = x if scored is None else scored.unionByName(x)
    objects = scored.join(passages, "passage_id").groupBy("query_id", "signal", F.struct("bucket", "object_key").alias("id")).agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "signal").orderBy(F.col("score").desc(), "id")
    fused = r.fuse(objects.withColumn("rank", F.row_number().over(w)), {"metadata": 0.5}).withColumn("score", F.round("score", 9))
    return r.top_k(fused, ["query_id"], [F.col("score").desc(), F.col("id")], TOP).select("query_id", "id.bucket", "id.object_key", "score", "signals", "rank")


def extractive_answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer to each question from its best passages."""
    top = r.top_k(_keyword(spark, d), ["query_id"], [F.col("score").desc(), F.col("passage_id")], TOP)
    texts = table(spark, d, "corpus", "passage_id", "text").distinct()
    return r.extractive_answer(top.join(texts, "passage_id").withColumnRenamed("passage_id", "id"), "text", 2, 600)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("group"))


def vector_exact_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    v = _vectors(spark, d)
    return r.exact_knn(v, v.where("id % 100 = 0"), TOP).select("query_id", "id", F.round(F.greatest(F.col("distance"), F.lit(0.0)), 4).alias("distance"), "rank")


def max_similarity_per_label(spark: SparkSession, d: str) -> DataFrame:
    """The best similarity per label of every vector whose id is divisible by 100."""
    v = _vectors(spark, d)
    return r.best_per_group(v, v.where("id % 100 = 0")).select("query_id", F.col("group").alias("label"), F.round("similarity", 4).alias("similarity"))


def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at ten of the index of signs against exact search, per query (recall_holds is checked by SQL)."""
    v = _vectors(spark, d)
    q = v.where("id % 100 = 0")
    got = r.sketch_knn(v, q, TOP)
    exact = r.exact_knn(v, q, TOP)
    hits = exact.join(got.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by label with the number that are valid, and the mean inner product of unit vectors with themselves."""
    u = r.unit(F.col("vector"))
    return _vectors(spark, d).select(F.col("group").alias("label"), u.alias("u")).groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count("u").alias("valid"), F.round(F.avg(r.dot(F.col("u"), F.col("u"))), 6).alias("self_similarity"))


def feature_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Part of H10: words of the corpus as 64 hashed features (whole: feature_hash_vectors)."""
    return r.feature_hash(table(spark, d, "corpus", "passage_id", "text").distinct(), "passage_id", "text", 64).withColumn("value", F.round("value", 6))


def feature_hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the corpus as 64 hashed features of tokens, token pairs and a bias; the buckets that are not zero."""
    docs = table(spark, d, "corpus", F.col("passage_id").alias("id"), "text").distinct()
    v = r.feature_vectors(docs, 64).select(F.col("id").alias("passage_id"), F.posexplode("vector").alias("bucket", "value"))
    return v.where("value <> 0").select("passage_id", F.col("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (text_chunks, chunk_digests, chunk_digests_all, fixed_passages, word_boundary_passages, tidy_digests, object_types, pii_pattern_findings, pii_outcomes, secrets_gone, secret_redaction, pseudonyms, canonical_times, passage_uuids, span_grounding, metadata_score_topk, bm25_topk, bm25_fields_topk, rrf_fusion, rrf_all_signals, extractive_answers, vector_exact_knn, max_similarity_per_label, ann_recall, vector_norms, feature_hash_embedding, feature_hash_vectors)}

_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in enumerate(QUESTIONS)) + ") t(query_id, query))"
_W = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) <= {1})"
_FIELDS = " + ".join(
    f"({w}::DOUBLE * len(list_intersect(list_distinct({_W.format('query', 40)}), {_W.format(f, 1 << 20)})) / greatest(len({_W.format('query', 40)}), 1) + CASE WHEN contains(lower({f}), lower(query)) THEN {w}::DOUBLE ELSE 0 END)"
    for f, w in (("coalesce(bucket, '')", 1), ("coalesce(object_key, '')", 4), ("coalesce(tier, '')", 1), ("coalesce(mime, '')", 1), ("coalesce(topic, '')", 2), ("coalesce(department, '')", 1))
)
_META = f"m AS (SELECT query_id, passage_id, round({_FIELDS}, 6) AS score FROM q, (SELECT DISTINCT passage_id, bucket, object_key, tier, mime, metadata['topic'] AS topic, metadata['department'] AS department FROM corpus))"
_BM25 = f"""d AS (SELECT passage_id, {_W.format("coalesce(text, '')", 40)} AS w FROM (SELECT DISTINCT passage_id, text FROM corpus)), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT passage_id, term, len(any_value(w)) AS length, count(*) AS tf FROM (SELECT passage_id, w, unnest(w) AS term FROM d) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
k AS (SELECT query_id, passage_id, round(sum(ln(1 + (s.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / s.mean))), 6) AS score FROM (SELECT query_id, unnest(list_distinct({_W.format("query", 40)})) AS term FROM q) JOIN p USING (term) JOIN f USING (term), s GROUP BY 1, 2)"""
_BM25F = f"""df AS (SELECT DISTINCT passage_id, text, object_key, array_to_string(list_transform(list_sort(map_entries(metadata)), lambda e: e.value), ' ') AS vals FROM corpus),
fd AS (SELECT passage_id, 'text' AS field, 2.0::DOUBLE AS boost, {_W.format("coalesce(text, '')", 40)} AS w FROM df UNION ALL SELECT passage_id, 'object_key', 1.5::DOUBLE, {_W.format("coalesce(object_key, '')", 40)} FROM df UNION ALL SELECT passage_id, 'vals', 1.0::DOUBLE, {_W.format("coalesce(vals, '')", 40)} FROM df),
fs AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM fd GROUP BY 1), fp AS (SELECT passage_id, field, boost, term, count(*) AS tf, any_value(length) AS length FROM (SELECT passage_id, field, boost, len(w) AS length, unnest(w) AS term FROM fd) GROUP BY 1, 2, 3, 4), ff AS (SELECT field, term, count(*) AS df FROM fp GROUP BY 1, 2),
fw AS (SELECT passage_id, term, max(boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS weight FROM fp JOIN ff USING (field, term) JOIN fs USING (field) GROUP BY 1, 2),
kf AS (SELECT query_id, passage_id, round(sum(weight), 6) AS score FROM (SELECT query_id, unnest({_W.format("query", 40)}) AS term FROM q) JOIN fw USING (term) GROUP BY 1, 2)"""
_PLACE, _SIGN = "('0x' || substr(h, 1, 16))::UBIGINT % 64", "CASE WHEN ('0x' || substr(h, 18, 1))::INT % 2 = 1 THEN 1 ELSE -1 END"
_HASHED = f"""ht AS (SELECT passage_id, regexp_extract_all(replace(replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), 'ς', 'σ'), chr(181), chr(956)), '[\\p{{L}}\\p{{N}}_]+') AS w FROM (SELECT DISTINCT passage_id, text FROM corpus)),
hf AS (SELECT passage_id, unnest(list_concat(['__bias__'], w, list_transform(range(1, len(w)), lambda i: w[i] || chr(31) || w[i + 1]))) AS f FROM ht),
hs AS (SELECT passage_id, ({_PLACE})::BIGINT AS bucket, sum({_SIGN})::DOUBLE AS n FROM (SELECT passage_id, sha256(f) AS h FROM hf) GROUP BY 1, 2), hv AS (SELECT passage_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY passage_id)) AS value FROM hs)"""
_COS = "list_sum(list_transform(range(1, 65), lambda i: a.v[i]::DOUBLE * b.v[i]::DOUBLE)) / sqrt(list_sum(list_transform(a.v, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(b.v, lambda x: x::DOUBLE * x::DOUBLE)))"
_PAIRS = f"c AS (SELECT a.id AS query_id, b.id AS id, b.label AS label, {_COS} AS cos FROM (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0) a, (SELECT vec_id AS id, embedding AS v, label FROM embeddings) b)"

SQL = {
    "text_chunks": "SELECT doc_id, k AS chunk_index, k * 256 AS byte_offset, least(256, n - k * 256) AS byte_length FROM (SELECT doc_id, n, unnest(range((n + 255) // 256)) AS k FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL))",
    "chunk_digests": "SELECT sha256(substr(text, (k * 256 + 1)::BIGINT, 256)) AS sha256, count(*) AS n FROM (SELECT text, unnest(range((length(text) + 255) // 256)) AS k FROM documents WHERE octet_length(encode(text)) = length(text) AND length(text) > 0) GROUP BY 1 HAVING count(*) > 1",
    "fixed_passages": "SELECT id, k AS passage_index, k * 900 AS start_codepoint, least(n, k * 900 + 1000) AS end_codepoint FROM (SELECT id, n, unnest(range(greatest(1, ceil((n - 100) / 900)::BIGINT))) AS k FROM (SELECT DISTINCT id, length(source_text) AS n FROM golden WHERE length(source_text) > 0))",
    "chunk_digests_all": "SELECT sha256(unhex(substr(h, (k * 512 + 1)::BIGINT, 512))) AS sha256, count(*) AS n FROM (SELECT h, unnest(range((length(h) + 511) // 512)) AS k FROM (SELECT hex(encode(text)) AS h FROM documents WHERE length(text) > 0)) GROUP BY 1 HAVING count(*) > 1",
    "secrets_gone": f"SELECT doc_id, (doc_id % {len(PLANTED)})::INT AS kind, TRUE AS clean FROM documents WHERE text IS NOT NULL",
    "pii_outcomes": rf"""
WITH c AS (SELECT DISTINCT passage_id, text FROM corpus), x AS (SELECT passage_id, text,
  len(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9._%+@-])', '\1\1', 'g'), '(^|[^A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}($|[^A-Za-z0-9])')) > 0 AS e,
  len(list_filter(regexp_extract_all(regexp_replace(text, '([^0-9-])', '\1\1', 'g'), '(^|[^0-9-])([0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})($|[^0-9-])', 2), lambda m: NOT (m[1:3] IN ('000', '666') OR m[1:1] = '9' OR m[5:6] = '00' OR m[8:11] = '0000'))) > 0 AS s FROM c)
SELECT passage_id, CASE WHEN text IS NULL THEN 'unknown' ELSE 'succeeded' END AS status, NULL::VARCHAR AS failure_code, coalesce(concat_ws(',', CASE WHEN e THEN 'email' END, CASE WHEN s THEN 'us_ssn' END), '') AS kinds, CASE WHEN e THEN 0.9::DOUBLE WHEN s THEN 0.85::DOUBLE END AS confidence FROM x""",
    "word_boundary_passages": r"""
WITH RECURSIVE g AS (SELECT DISTINCT id, source_text AS t, length(source_text) AS n FROM golden WHERE length(source_text) > 0),
w AS (
  SELECT id, t, n, 0::BIGINT AS a, 0::BIGINT AS b FROM g
  UNION ALL
  SELECT id, t, n, a, CASE WHEN a + 1200 >= n THEN n WHEN length(x2) > 0 THEN a + 600 + length(x2) WHEN length(x1) > 0 THEN a + 600 + length(x1) WHEN length(x0) > 0 THEN a + 600 + length(x0) ELSE a + 1200 END AS b
  FROM (SELECT id, t, n, a, regexp_extract(z, '(?s)^.*\n\n') AS x2, regexp_extract(z, '(?s)^.*\n') AS x1, regexp_extract(z, '(?s)^.* ') AS x0 FROM (SELECT id, t, n, a, substring(t, a + 601, 600) AS z FROM (SELECT id, t, n, CASE WHEN b = 0 THEN 0 ELSE greatest(a + 1, b - 120) END AS a FROM w WHERE b < n)))),
p AS (SELECT id, a, b, substring(t, a + 1, b - a) AS x FROM w WHERE b > 0),
q AS (SELECT id, a + length(regexp_extract(x, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]*')) AS s, b - length(regexp_extract(x, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]*$')) AS e FROM p)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s, e) - 1)::BIGINT AS ordinal, s AS start_codepoint, e AS end_codepoint FROM q WHERE e > s""",
    "passage_uuids": """
WITH p AS (SELECT DISTINCT document_id, passage_index, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(document_id || ':' || passage_index)) AS h FROM embedding_passages)
SELECT document_id, passage_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(h, 17, 1))::INT % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM p""",
    "tidy_digests": r"""SELECT doc_id, sha256(t) AS sha256, t <> text AS changed FROM (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '\t', ' ', 'g'), '[\x00-\x09\x0B-\x1F\x7F]', '', 'g'), ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM documents WHERE text IS NOT NULL)""",
    "object_types": "SELECT mime, CASE lower(split_part(key, '.', -1)) " + " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in c.TYPES.items()) + " ELSE 'application/octet-stream' END AS by_name, CASE WHEN lower(split_part(key, '.', -1)) IN (" + ", ".join(f"'{s}'" for s in c.TYPES) + ") THEN 'name' ELSE 'fallback' END AS source, count(*) AS objects FROM (SELECT DISTINCT id, key, mime FROM golden) GROUP BY ALL",
    "pseudonyms": "SELECT person_id, CASE WHEN team IN ('night shift', 'lab archive') THEN '[REDACTED:' || sha256(family_name) || ']' ELSE family_name END AS name FROM staff_directory",
    "canonical_times": "SELECT move_id, attempt, strftime(timezone('UTC', created_at::TIMESTAMPTZ), '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM (SELECT DISTINCT move_id, attempt, created_at FROM budget_reservations)",
    "span_grounding": "SELECT document_id, count(*) FILTER (substring(source_text, start_codepoint + 1, end_codepoint - start_codepoint) IS NOT DISTINCT FROM text) AS grounded, count(*) FILTER (substring(source_text, start_codepoint + 1, end_codepoint - start_codepoint) IS DISTINCT FROM text) AS ungrounded FROM (SELECT DISTINCT document_id, passage_index, start_codepoint, end_codepoint, text FROM embedding_passages) JOIN (SELECT DISTINCT id, source_text FROM golden) ON document_id = id GROUP BY 1",
    "metadata_score_topk": f"WITH {_Q}, {_META} SELECT query_id, passage_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id))::INT AS rank FROM m WHERE score > 0 QUALIFY rank <= {TOP}",
    "bm25_topk": f"WITH {_Q}, {_BM25} SELECT query_id, passage_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id))::INT AS rank FROM k QUALIFY rank <= {TOP}",
    "bm25_fields_topk": f"WITH {_Q}, {_BM25F} SELECT query_id, passage_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id))::INT AS rank FROM kf QUALIFY rank <= {TOP}",
    "feature_hash_vectors": f"WITH {_HASHED} SELECT passage_id, bucket, round(value, 6) AS value FROM hv WHERE value <> 0",
    "rrf_all_signals": f"""WITH {_Q}, {_META}, {_BM25F}, {_HASHED}, qt AS (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), lambda w: TRUE) AS w FROM q), qf AS (SELECT query_id, unnest(list_concat(['__bias__'], w, list_transform(range(1, len(w)), lambda i: w[i] || chr(31) || w[i + 1]))) AS f FROM qt),
qs AS (SELECT query_id, ({_PLACE})::BIGINT AS bucket, sum({_SIGN})::DOUBLE AS n FROM (SELECT query_id, sha256(f) AS h FROM qf) GROUP BY 1, 2), qv AS (SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS value FROM qs),
vs AS (SELECT query_id, passage_id, round(coalesce(sum(qv.value * hv.value), 0), 9) AS score FROM (SELECT DISTINCT passage_id FROM corpus) JOIN q ON TRUE LEFT JOIN qv USING (query_id) LEFT JOIN hv USING (passage_id, bucket) GROUP BY 1, 2),
g AS (SELECT query_id, passage_id, score, 'keyword' AS signal, 1.0::DOUBLE AS w FROM kf UNION ALL SELECT query_id, passage_id, score, 'metadata', 0.5::DOUBLE FROM m WHERE score > 0 UNION ALL SELECT query_id, passage_id, score, 'vector', 1.0::DOUBLE FROM vs),
o AS (SELECT query_id, signal, w, bucket, object_key, max(score) AS score FROM g JOIN (SELECT DISTINCT passage_id, bucket, object_key FROM corpus) USING (passage_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, bucket, object_key) AS rank FROM o),
x AS (SELECT query_id, bucket, object_key, round(sum(w / (60 + rank)), 9) AS score, string_agg(signal, ',' ORDER BY signal) AS signals FROM r GROUP BY 1, 2, 3) SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bucket, object_key))::INT AS rank FROM x QUALIFY rank <= {TOP}""",
    "rrf_fusion": f"WITH {_Q}, {_META}, {_BM25}, g AS (SELECT query_id, passage_id, 'keyword' AS signal, 1.0::DOUBLE AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM k QUALIFY rank <= 50 UNION ALL SELECT query_id, passage_id, 'metadata', 0.5::DOUBLE, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM m WHERE score > 0 QUALIFY rank <= 50), x AS (SELECT query_id, passage_id, round(sum(w / (60 + rank)), 9) AS score, string_agg(signal, ',' ORDER BY signal) AS signals FROM g GROUP BY 1, 2) SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id))::INT AS rank FROM x QUALIFY rank <= {TOP}",
    "extractive_answers": f"WITH {_Q}, {_BM25}, t AS (SELECT query_id, passage_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)) AS rank FROM k QUALIFY rank <= {TOP}), u AS (SELECT query_id, text, min(rank) AS rank, arg_min(passage_id, rank) AS id FROM t JOIN (SELECT DISTINCT passage_id, text FROM corpus) USING (passage_id) WHERE text IS NOT NULL GROUP BY 1, 2), v AS (SELECT *, row_number() OVER w AS place, sum(length(text)) OVER w AS n FROM u WINDOW w AS (PARTITION BY query_id ORDER BY rank)) SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS answer, string_agg(id, ',' ORDER BY rank) AS cited FROM v WHERE place <= 2 AND n <= 600 GROUP BY 1",
    "vector_exact_knn": f"WITH {_PAIRS} SELECT query_id, id, round(greatest(1 - cos, 0), 4) AS distance, (row_number() OVER (PARTITION BY query_id ORDER BY 1 - cos, id))::INT AS rank FROM c QUALIFY rank <= {TOP}",
    "max_similarity_per_label": f"WITH {_PAIRS} SELECT query_id, label, round(max(cos), 4) AS similarity FROM c GROUP BY 1, 2",
    "vector_norms": "SELECT label, count(*) AS vectors, count(*) FILTER (list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0) AS valid, 1.0::DOUBLE AS self_similarity FROM embeddings GROUP BY 1",
    "feature_hash_embedding": f"WITH t AS (SELECT passage_id, sha256(w) AS h FROM (SELECT passage_id, unnest({_W.format('text', 40)}) AS w FROM (SELECT DISTINCT passage_id, text FROM corpus WHERE text IS NOT NULL))), v AS (SELECT passage_id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS n FROM t GROUP BY 1, 2 HAVING n <> 0) SELECT passage_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY passage_id)), 6)::DOUBLE AS value FROM v",
}
