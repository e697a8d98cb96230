"""Queries of the text and numeric problems of large collections, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import bpe, lookalike, mixing, pii, radix, splitting
from lodestone.session import cut, prepare_workers, spread, worker
from lodestone.sources.tables import table


def _free_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts of golden and corpus, copies of rows too: the results are made distinct, which moves less than the texts."""
    g = spread(table(spark, d, "golden", "id", "source_text"), "id").select(F.lit("golden").alias("table_name"), F.col("id").alias("record_id"), F.col("source_text").alias("text"))
    c = spread(table(spark, d, "corpus", "passage_id", "text"), "passage_id").select(F.lit("corpus").alias("table_name"), F.col("passage_id").alias("record_id"), "text")
    return g.unionByName(c)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Where texts mention personal information."""
    return pii.find_mentions(_free_text(spark, d), table(spark, d, "staff_directory")).select("table_name", "record_id", "kind", "start_codepoint").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders for personal information; equal texts of a record once."""
    return pii.redacted(_free_text(spark, d), table(spark, d, "staff_directory")).distinct()


def p2_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Per table its texts, and those whose redaction is as long as the text without its mentions and with their placeholders."""
    texts, staff = cut(_free_text(spark, d).where("text IS NOT NULL").distinct()), table(spark, d, "staff_directory")
    keyed = texts.select(F.concat_ws("|", "table_name", "record_id", F.sha2("text", 256)).alias("record_id"), "table_name", "text")
    lost = pii.find_mentions(keyed, staff).groupBy("record_id").agg(F.sum(F.col("end_codepoint") - F.col("start_codepoint") - F.length("kind") - 2).alias("less"), F.count(F.lit(1)).alias("n"))
    out = pii.redacted(keyed, staff).select("record_id", F.length("text").alias("length"), "mentions")
    x = keyed.join(out, "record_id").join(lost, "record_id", "left")
    right = (F.length("text") - F.coalesce("less", F.lit(0)) == F.col("length")) & (F.coalesce("n", F.lit(0)) == F.col("mentions"))
    return x.groupBy("table_name").agg(F.count(F.lit(1)).alias("texts"), F.count_if(right).alias("consistent"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return splitting.one_text(table(spark, d, "golden", "id", "source_text").select(F.col("id").alias("document_id"), F.col("source_text").alias("text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored passages that break the rules of splitting."""
    passages = table(spark, d, "embedding_passages", "document_id", "passage_index", "start_codepoint", "end_codepoint", "text")
    return splitting.audit(passages, _texts(spark, d)).select("document_id", "passage_index").distinct()


def p5_proposed(spark: SparkSession, d: str) -> DataFrame:
    """Stored passages that end unnaturally, with the natural boundary that the search of their window proposes instead."""
    passages = table(spark, d, "embedding_passages", "document_id", "passage_index", "start_codepoint", "end_codepoint", "text")
    found = splitting.audit(passages, _texts(spark, d)).where(F.array_contains("faults", "unnatural_end"))
    return found.select("document_id", "passage_index", "proposed_end").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every text, cut at the valleys of lexical cohesion."""
    return splitting.split(_texts(spark, d))


def p5_pieces_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per text its length and what its pieces promise: they cover it, none is too long, each shares the overlap with the one before,
    each has the text of its span, and none ends between two characters while its tail holds a blank."""
    pieces = splitting.split(_texts(spark, d))
    w = Window.partitionBy("document_id").orderBy("passage_index")  # the pieces of one text
    t = _texts(spark, d).where(F.length("text") > 0).withColumnRenamed("text", "whole")
    x = pieces.withColumn("before", F.lag("end_codepoint").over(w)).withColumn("last", F.lead("passage_index").over(w).isNull()).join(t, "document_id")
    s, e = F.col("start_codepoint"), F.col("end_codepoint")
    tail = F.greatest(s, e - splitting.TAIL)
    inner = ~F.col("last") & ~F.expr("substring(whole, int(end_codepoint), 2)").rlike("[ \r\n]") & F.substring("whole", (tail + 1).cast("int"), (e - tail).cast("int")).rlike("[ \r\n]")
    broken = (e - s > splitting.LIMIT) | (s != F.coalesce(F.col("before") - splitting.OVERLAP, F.lit(0))) | (F.col("last") & (e != F.length("whole"))) | (F.col("text") != F.substring("whole", (s + 1).cast("int"), (e - s).cast("int"))) | inner
    return x.groupBy("document_id").agg(F.max(F.length("whole")).cast("long").alias("length"), F.count_if(broken).alias("broken"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples", "sample_id", "cohort", "metric", "value", "observed_at").withColumn("day", F.to_date("observed_at"))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per cohort and metric."""
    return radix.percentiles_of(_samples(spark, d), ["cohort", "metric"], "value", "sample_id")


def p6_daily(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per cohort, metric and day of observation."""
    return radix.percentiles_of(_samples(spark, d), ["cohort", "metric", "day"], "value", "sample_id").withColumn("day", F.col("day").cast("date"))


#: Leading bits of the daily histograms: sign, exponent and 10 bits of the mantissa, so a bound is off by a factor of 1 + 2**-10 at most.
DAILY_BITS = 22


def p6_days_together(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the percentiles per cohort and metric, from histograms made per day and added up."""
    daily = radix.histogram(radix.keyed(_samples(spark, d), ["cohort", "metric", "day"], "value", "sample_id"), ["cohort", "metric", "day"], DAILY_BITS)
    return radix.estimate(cut(radix.merged(daily, ["cohort", "metric"])), ["cohort", "metric"], DAILY_BITS)


def p6_bounds_hold(spark: SparkSession, d: str) -> DataFrame:
    """Whether each exact percentile lies within the bounds from the days put together, and these within the stated error: 2**-9 of the value, or 1e-300 at zero."""
    exact = p6_percentiles(spark, d)
    names = {p: f"p{p / 10:g}".replace(".", "_") for p in radix.PERCENTILES}
    exact = exact.select("cohort", "metric", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(n).alias("value")) for p, n in names.items()])).alias("x")).select(F.col("cohort").alias("c"), F.col("metric").alias("m"), "x.*")
    b = p6_days_together(spark, d)
    x = b.join(exact, b["cohort"].eqNullSafe(exact["c"]) & b["metric"].eqNullSafe(exact["m"]) & (b["p"] == exact["p"]), "full")
    holds = (F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high")) & (F.col("high") - F.col("low") <= F.abs("value") / 512 + F.lit(1e-300))
    return x.select(F.col("c").alias("cohort"), F.col("m").alias("metric"), exact["p"].alias("p"), F.coalesce(holds, F.lit(False)).alias("holds"))


def p7_ids(spark: SparkSession, d: str, folder: str = bpe.FOLDER, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """The token ids of every document."""
    prepare_workers(spark)
    bpe.ship(spark, folder, vocabulary)
    return spread(table(spark, d, "documents", "doc_id", "text"), "doc_id").mapInPandas(worker(bpe.__name__, "encode_batches", "doc_id", "text", folder, vocabulary), "doc_id long, ids array<int>")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    prepare_workers(spark)
    bpe.ship(spark, bpe.FOLDER, bpe.VOCABULARY)
    named = F.broadcast(table(spark, d, "mix_targets", "source").distinct())  # a row per named source
    docs = spread(table(spark, d, "documents", "doc_id", "source", "text"), "doc_id").join(named, "source", "left_semi")
    return cut(docs.select("doc_id", "source", "text").mapInPandas(worker(bpe.__name__, "count_batches", "text", bpe.FOLDER, bpe.VOCABULARY), "doc_id long, source string, tokens long"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document stands in the mixture of mix_targets."""
    return mixing.mixture(_sizes(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of the mixture."""
    return mixing.shares(_sizes(spark, d), table(spark, d, "mix_targets")).drop("granted_tokens", "largest")


def p8_promises(spark: SparkSession, d: str) -> DataFrame:
    """Per named source whether what was taken misses what can be taken by half a document at most, and no document is repeated too often."""
    x = mixing.shares(_sizes(spark, d), table(spark, d, "mix_targets"))
    return x.select("source", (2 * F.abs(F.col("taken_tokens") - F.col("granted_tokens")) <= F.col("largest")).alias("within_half_a_document"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same and differ in their characters."""
    return lookalike.same_look_pairs(spread(table(spark, d, "documents", "doc_id", "text"), "doc_id"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a double of other characters: their class, its different texts and how many documents each is linked with."""
    return lookalike.same_look_classes(spread(table(spark, d, "documents", "doc_id", "text"), "doc_id"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in one form, and whether that changed it."""
    c = lookalike.with_canonical(table(spark, d, "documents", "doc_id", "text"))
    return c.select("doc_id", F.col("canonical").alias("text"), (~F.col("text").eqNullSafe(F.col("canonical"))).alias("changed"))


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p2_consistent, p5_found, p5_proposed, p5_pieces, p5_pieces_kept, p6_percentiles, p6_daily, p6_days_together, p6_bounds_hold, p7_ids, p8_mixture, p8_shares, p8_promises, p9_found, p9_classes, p9_canonical)}

_RANKED = """
WITH v AS (SELECT sample_id, min({{cohort: cohort, metric: metric, day: observed_at::DATE, value: value}}) AS x FROM samples WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY sample_id),
r AS (SELECT x.cohort AS cohort, x.metric AS metric, {day} x.value AS value, row_number() OVER w AS k, count(*) OVER (PARTITION BY x.cohort, x.metric {by}) AS n FROM v WINDOW w AS (PARTITION BY x.cohort, x.metric {by} ORDER BY x.value))
SELECT cohort, metric, {shown} n, max(CASE WHEN k = (n * 500 + 999) // 1000 THEN value END) AS p50, max(CASE WHEN k = (n * 900 + 999) // 1000 THEN value END) AS p90, max(CASE WHEN k = (n * 950 + 999) // 1000 THEN value END) AS p95, max(CASE WHEN k = (n * 990 + 999) // 1000 THEN value END) AS p99, max(CASE WHEN k = (n * 999 + 999) // 1000 THEN value END) AS p99_9
FROM r GROUP BY ALL
"""

SQL = {
    "p5_found": r"""
WITH g AS (SELECT id, max(source_text) AS t FROM golden GROUP BY id),
p AS (SELECT DISTINCT document_id, passage_index, start_codepoint AS s, end_codepoint AS e, text FROM embedding_passages),
o AS (SELECT p.*, lag(e) OVER w AS before, row_number() OVER w = 1 AS is_first, lead(1) OVER w IS NULL AS is_last, g.t FROM p LEFT JOIN g ON g.id = document_id WINDOW w AS (PARTITION BY document_id ORDER BY passage_index, s, e, text))
SELECT DISTINCT document_id, passage_index FROM o
WHERE e - s > 1000 OR t IS NULL OR text IS DISTINCT FROM substring(t, s + 1, e - s) OR s <> CASE WHEN is_first THEN 0 ELSE before - 100 END OR (is_last AND e <> length(t))
  OR (e < length(t) AND NOT regexp_matches(substring(t, e, 2), '[ \r\n]') AND regexp_matches(substring(t, greatest(s, e - 300) + 1, e - greatest(s, e - 300)), '[ \r\n]'))
""",
    "p2_consistent": "SELECT table_name, count(*) AS texts, count(*) AS consistent FROM (SELECT DISTINCT 'golden' AS table_name, id, source_text FROM golden WHERE source_text IS NOT NULL UNION ALL SELECT DISTINCT 'corpus', passage_id, text FROM corpus WHERE text IS NOT NULL) GROUP BY 1",
    "p5_pieces_kept": "SELECT id AS document_id, max(length(source_text)) AS length, 0 AS broken FROM (SELECT id, max(source_text) AS source_text FROM golden GROUP BY 1) WHERE length(source_text) > 0 GROUP BY 1",
    "p6_bounds_hold": "SELECT DISTINCT cohort, metric, p, TRUE AS holds FROM samples, (VALUES (500), (900), (950), (990), (999)) v(p) WHERE value IS NOT NULL AND NOT isnan(value)",
    "p8_promises": "SELECT DISTINCT source, TRUE AS within_half_a_document, TRUE AS within_repeats FROM mix_targets WHERE source IS NOT NULL",
    "p6_percentiles": _RANKED.format(day="", by="", shown=""),
    "p6_daily": _RANKED.format(day="x.day AS day,", by=", x.day", shown="day,"),
}
