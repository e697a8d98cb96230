"""Queries of logs and learning, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import micros
from lodestone.operators import learn, ledger
from lodestone.sources.tables import table

DAY_US = 86_400_000_000


def _calls(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "movement", "call_id", "direction", "cohort", "attempt_number", "size_bytes", "started_at", "completed_at", "success", "verified").distinct()
    return m.where("started_at IS NOT NULL AND success IS NOT NULL").withColumn("at_us", micros(F.col("started_at"))).withColumn("log_size", F.log1p("size_bytes")).withColumn("hour", F.hour(F.col("started_at").cast("timestamp")))


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A rule (first attempt of at most 64 KiB succeeds) against what happened, per direction."""
    m = _calls(spark, d).withColumn("guess", (F.col("attempt_number") == 1) & (F.col("size_bytes") <= 65536))
    return learn.confusion(m, ["direction"], "success", "guess")


def class_balance(spark: SparkSession, d: str) -> DataFrame:
    """Classes per cohort."""
    return learn.class_balance(_calls(spark, d), ["cohort"], "success", 20, 20)


def time_splits(spark: SparkSession, d: str) -> DataFrame:
    """Training, validation and test by time, with calls purged whose window reaches into the next."""
    m = _calls(spark, d)
    a, b = F.lit(1_735_689_600_000_000), F.lit(1_751_328_000_000_000)
    s = learn.split_by_time(m, F.col("at_us"), F.col("at_us") + DAY_US, a, b)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("calls"), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"))


def stump_best_split(spark: SparkSession, d: str) -> DataFrame:
    """The best single split of calls by success."""
    b = learn.best_stump(_calls(spark, d), ["attempt_number", "size_bytes", "hour"], "success")
    return b.select("impurity", "feature", "threshold", F.col("lp").alias("left_positive"), F.col("ln").alias("left_negative"))


def stump_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The best split applied to all calls, per direction."""
    m = _calls(spark, d)
    model = learn.best_stump(m, ["attempt_number"], "success")
    share = F.try_divide(F.col("lp").cast("double"), F.col("P")) >= F.try_divide(F.col("ln").cast("double"), F.col("N"))
    left = model.select(F.struct("threshold", share.alias("yes")).alias("m")).scalar()
    g = m.withColumn("m", left).withColumn("guess", F.when(F.col("attempt_number") <= F.col("m.threshold"), F.col("m.yes")).otherwise(~F.col("m.yes")))
    return g.groupBy("direction").agg(F.count_if("guess").alias("yes"), F.count_if(F.col("guess") == F.col("success")).alias("right"))


def minmax_objective_score(spark: SparkSession, d: str) -> DataFrame:
    """Prices of parts scaled within their brand, and the first of each brand."""
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_retailprice", "p_size")
    s = p.withColumn("score", F.round(0.5 * learn.normalised(F.col("p_retailprice"), ["p_brand"]) + 0.5 * learn.normalised(F.col("p_size").cast("double"), ["p_brand"]), 9))
    w = Window.partitionBy("p_brand").orderBy(F.col("score").asc_nulls_last(), "p_partkey")
    return s.withColumn("place", F.row_number().over(w)).where("place <= 3").select("p_brand", "place", "p_partkey", "score")


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Features of calls, rounded."""
    return _calls(spark, d).select("call_id", F.round("log_size", 6).alias("log_size"), "hour", F.round(F.sqrt("attempt_number"), 6).alias("root_attempt"))


def duplicate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Logical moves that appear under several jobs."""
    m = table(spark, d, "movement", "job_id", "logical_move_id").distinct()
    return m.groupBy("logical_move_id").agg(F.count(F.lit(1)).alias("jobs")).where("jobs > 1")


def causal_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """Each attempt of a move with the attempt it goes back to and its depth; counted by depth."""
    m = table(spark, d, "movement", "logical_move_id", "attempt_number").distinct()
    e = m.select(F.concat_ws("#", "logical_move_id", "attempt_number").alias("node"), F.when(F.col("attempt_number") > 1, F.concat_ws("#", "logical_move_id", F.col("attempt_number") - 1)).alias("parent"))
    return ledger.ancestry(e).groupBy(F.coalesce("depth", F.lit(-1)).alias("depth")).agg(F.count(F.lit(1)).alias("attempts"))


def hash_chain_check(spark: SparkSession, d: str) -> DataFrame:
    """Part of E5: the order of events by their id, as a chain of links without payloads; a copy is a fault (whole: hash_chain_faults)."""
    b = table(spark, d, "events", "event_id", "event_type").select((F.col("event_id") + 1).alias("sequence"), "event_type")
    linked = b.select("sequence", F.sha2(F.concat(F.lit("p"), (F.col("sequence") - 1).cast("string")), 256).alias("previous_hash"), F.sha2(F.concat(F.lit("p"), F.col("sequence").cast("string")), 256).alias("entry_hash"), F.col("event_type").alias("payload"))
    faults = ledger.chain_faults(linked)
    return faults.where("fault <> 'edited'").groupBy("fault").agg(F.count(F.lit(1)).alias("entries"))


def hash_chain_faults(spark: SparkSession, d: str) -> DataFrame:
    """A ledger per user over all columns of events, read again after changes; what the chain tells of them, counted.

    The tables hold no ledger, so it is made here, and the changes are put in by rule: one entry in 101 has its payload changed, one in 103 is
    lost, one in 107 comes twice.
    """
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    payload = F.to_json(F.struct("event_id", "ts", "user_id", "event_type", "value", "props"), {"ignoreNullFields": "false"})
    made = ledger.chained(e.select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("owner"), payload.alias("payload"), "event_id"), ["event_id", "payload"])
    number = F.get_json_object("payload", "$.event_id").cast("long")
    left = made.withColumn("n", number).where("n IS NULL OR n % 103 <> 1")
    changed = left.withColumn("payload", F.when(F.col("n") % 101 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    read = changed.withColumn("times", F.explode(F.when(F.col("n") % 107 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("n", "times")
    return ledger.chain_faults(read, by=("owner",)).groupBy("fault").agg(F.count(F.lit(1)).alias("entries"))


def star_revenue(spark: SparkSession, d: str) -> DataFrame:
    """An eight-way join of the star tables: revenue by region and year."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    p = table(spark, d, "part", "p_partkey", "p_type").where("p_type = 'ECONOMY'")
    n, r = table(spark, d, "nation", "n_nationkey", "n_regionkey"), table(spark, d, "region")
    x = li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy(F.col("r_name").alias("region"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("s_nationkey").alias("supplier_nations"))


QUERIES = {f.__name__: f for f in (confusion_metrics, class_balance, time_splits, stump_best_split, stump_predictions, minmax_objective_score, feature_vectors, duplicate_evidence, causal_ancestry, hash_chain_check, hash_chain_faults, star_revenue)}

_M = "m AS (SELECT DISTINCT call_id, direction, cohort, attempt_number, size_bytes, started_at, completed_at, success, verified, epoch_us(started_at) AS at_us FROM movement WHERE started_at IS NOT NULL AND success IS NOT NULL)"
_STUMP = "v AS (SELECT f AS feature, v::DOUBLE AS v, sum(success::INT) AS p, sum(1 - success::INT) AS n FROM ({0}) GROUP BY 1, 2), c AS (SELECT feature, v, sum(p) OVER w AS lp, sum(n) OVER w AS ln, sum(p) OVER (PARTITION BY feature) AS tp, sum(n) OVER (PARTITION BY feature) AS tn, lead(v) OVER w AS nv FROM v WINDOW w AS (PARTITION BY feature ORDER BY v)), g AS (SELECT *, round(coalesce((lp * tn)::DOUBLE * (ln * tp)::DOUBLE / nullif((lp * tn + ln * tp)::DOUBLE, 0), 0) + coalesce(((tp - lp) * tn)::DOUBLE * ((tn - ln) * tp)::DOUBLE / nullif(((tp - lp) * tn + (tn - ln) * tp)::DOUBLE, 0), 0), 3) AS impurity FROM c WHERE nv IS NOT NULL)"

SQL = {
    "confusion_metrics": f"WITH {_M}, x AS (SELECT direction, count(*) FILTER (NOT success AND NOT g) AS tn, count(*) FILTER (NOT success AND g) AS fp, count(*) FILTER (success AND NOT g) AS fn, count(*) FILTER (success AND g) AS tp FROM (SELECT *, attempt_number = 1 AND size_bytes <= 65536 AS g FROM m) GROUP BY 1) SELECT *, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM x",
    "class_balance": f"WITH {_M}, x AS (SELECT cohort, count(*) FILTER (success) AS positive, count(*) FILTER (NOT success) AS negative FROM m GROUP BY 1) SELECT *, least(positive, negative) >= 20 AND greatest(positive, negative) <= least(positive, negative) * 20 AS sufficient FROM x",
    "time_splits": f"WITH {_M} SELECT CASE WHEN at_us >= 1751328000000000 THEN 'test' WHEN at_us >= 1735689600000000 THEN CASE WHEN at_us + 86400000000 > 1751328000000000 THEN 'purged' ELSE 'validation' END WHEN at_us + 86400000000 > 1735689600000000 THEN 'purged' ELSE 'train' END AS split, count(*) AS calls, min(at_us) AS first_us, max(at_us) AS last_us FROM m GROUP BY 1",
    "stump_best_split": f"WITH {_M}, {_STUMP.format('SELECT 0 AS f, attempt_number AS v, success FROM m UNION ALL SELECT 1, size_bytes, success FROM m UNION ALL SELECT 2, hour(started_at), success FROM m')} SELECT impurity, feature, v AS threshold, lp::BIGINT AS left_positive, ln::BIGINT AS left_negative FROM g ORDER BY impurity, feature, v LIMIT 1",
    "stump_predictions": f"WITH {_M}, {_STUMP.format('SELECT 0 AS f, attempt_number AS v, success FROM m')}, b AS (SELECT v AS t, lp / tp >= ln / tn AS yes FROM g ORDER BY impurity, feature, v LIMIT 1), x AS (SELECT direction, success, CASE WHEN attempt_number <= t THEN yes ELSE NOT yes END AS guess FROM m, b) SELECT direction, count(*) FILTER (guess) AS yes, count(*) FILTER (guess = success) AS right FROM x GROUP BY 1",
    "minmax_objective_score": "WITH s AS (SELECT p_brand, p_partkey, round(0.5::DOUBLE * CASE WHEN max(p_retailprice) OVER w > min(p_retailprice) OVER w THEN (p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w) ELSE 0 END + 0.5::DOUBLE * CASE WHEN max(p_size) OVER w > min(p_size) OVER w THEN (p_size - min(p_size) OVER w)::DOUBLE / (max(p_size) OVER w - min(p_size) OVER w) ELSE 0 END, 9) AS score FROM part WINDOW w AS (PARTITION BY p_brand)) SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY score NULLS LAST, p_partkey))::INT AS place, p_partkey, score FROM s QUALIFY place <= 3",
    "feature_vectors": f"WITH {_M} SELECT call_id, round(ln(1 + size_bytes::DOUBLE), 6) AS log_size, hour(started_at)::INT AS hour, round(sqrt(attempt_number), 6) AS root_attempt FROM m",
    "duplicate_evidence": "SELECT logical_move_id, count(DISTINCT job_id) AS jobs FROM movement GROUP BY 1 HAVING count(DISTINCT job_id) > 1",
    "causal_ancestry": "WITH RECURSIVE e AS (SELECT DISTINCT logical_move_id AS l, attempt_number AS a FROM movement), t AS (SELECT l, a, 0::BIGINT AS depth FROM e WHERE a <= 1 UNION ALL SELECT e.l, e.a, t.depth + 1 FROM t JOIN e ON e.l = t.l AND e.a = t.a + 1 WHERE e.a > 1) SELECT coalesce(depth, -1) AS depth, count(*) AS attempts FROM e LEFT JOIN t USING (l, a) GROUP BY 1",
    "hash_chain_check": "SELECT fault, count(*) AS entries FROM (SELECT unnest([CASE WHEN event_id = b THEN 'repeated' END, CASE WHEN event_id > coalesce(b, -1) + 1 THEN 'gap' END, CASE WHEN b IS NULL OR b <> event_id - 1 THEN 'broken_link' END]) AS fault FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS b FROM events)) WHERE fault IS NOT NULL GROUP BY 1",
    "hash_chain_faults": """
WITH e AS (SELECT event_id AS n, coalesce(event_id % 103 = 1, FALSE) AS lost, lag(coalesce(event_id % 103 = 1, FALSE)) OVER (PARTITION BY coalesce(user_id::VARCHAR, '') ORDER BY event_id) AS after_lost FROM events),
x AS (SELECT count(*) FILTER (n % 101 = 0) + count(*) FILTER (n % 101 = 0 AND n % 107 = 2) AS edited, count(*) FILTER (n % 107 = 2) AS repeated, count(*) FILTER (after_lost) AS gap FROM e WHERE NOT lost)
SELECT fault, entries FROM (SELECT unnest(['edited', 'repeated', 'gap', 'broken_link']) AS fault, unnest([edited, repeated, gap, gap + repeated])::BIGINT AS entries FROM x) WHERE entries > 0""",
    "star_revenue": "SELECT r_name AS region, year(o_orderdate)::INT AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT s_nationkey) AS supplier_nations FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_type = 'ECONOMY' GROUP BY 1, 2",
}
