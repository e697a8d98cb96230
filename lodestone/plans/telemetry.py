"""Queries over events, samples and calls, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import micros
from lodestone.operators import access as a
from lodestone.operators import order
from lodestone.sources.tables import table

KINDS = ["click", "error", "purchase", "signup", "view"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select("event_id", "user_id", F.col("event_type").alias("kind"), micros(F.col("ts")).alias("at_us"), F.when(F.col("value") < 100, 1.0).otherwise(0.25).alias("sample_rate"), "value")


def _with_as_of(events: DataFrame) -> DataFrame:
    """events with the last time of all in as_of_us, a scalar subquery."""
    return events.withColumn("as_of_us", events.agg(F.max("at_us")).scalar())


def access_window_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Per user the events of each kind in trailing windows, weighted by sampling."""
    e = _with_as_of(_events(spark, d))
    return a.trailing_windows(e, ["user_id"], KINDS, F.col("as_of_us"))


def access_recency(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since the last event of each user, and its freshness."""
    e = _with_as_of(_events(spark, d)).groupBy("user_id").agg(F.max("at_us").alias("last_us"), F.max("as_of_us").alias("as_of_us"), F.min("sample_rate").alias("least"))
    return e.select("user_id", F.expr("(as_of_us - last_us) div 1000000").alias("recency_s"), a.freshness(F.col("last_us"), F.col("as_of_us"), 6).alias("state"), (F.col("least") < 1).alias("sampled"))


def sliding_rate_window(spark: SparkSession, d: str) -> DataFrame:
    """Events a second over one hour, every quarter of an hour, by kind."""
    e = table(spark, d, "events", "ts", "event_type")
    return a.sliding_counts(e, ["event_type"], "ts", "1 hour", "15 minutes", F.count(F.lit(1)).alias("n")).withColumn("rate", F.round(F.col("n") / 3600, 6))


def bad_event_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of failed calls per day and direction, the burn rate against 99 percent, and the budget left."""
    m = table(spark, d, "movement", "call_id", "direction", "started_at", "success").distinct().where("started_at IS NOT NULL")
    x = m.groupBy("direction", F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.count_if("success").alias("good"))
    bad = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(F.col("good"), F.col("calls"))))
    return x.withColumn("bad_ratio", F.round(bad, 6)).withColumn("burn_rate", F.round(bad / 0.01, 4)).withColumn("budget_left", F.round(1 - bad / 0.01, 4))


def multi_window_alert(spark: SparkSession, d: str) -> DataFrame:
    """T4: hours in which the share of failed calls is high both over that hour and over the six up to it."""
    m = table(spark, d, "movement", "call_id", "started_at", "success").distinct().where("started_at IS NOT NULL")
    h = m.groupBy(F.expr("floor(unix_micros(cast(started_at as timestamp)) / 21600000000)").alias("slot")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("bad"))
    six = h.select(F.explode(F.sequence(F.col("slot"), F.col("slot") + 5)).alias("slot"), F.col("calls").alias("c"), F.col("bad").alias("b")).groupBy("slot").agg(F.sum("c").alias("long_calls"), F.sum("b").alias("long_bad"))
    x = h.join(six, "slot")
    return x.where((F.col("bad") * 100 > F.col("calls") * 10) & (F.col("long_bad") * 100 > F.col("long_calls") * 8)).select("slot", "calls", "bad", "long_calls", "long_bad")


BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0]


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples", "sample_id", "metric", "value").distinct().where("value IS NOT NULL AND NOT isnan(value) AND value >= 0")
    le = F.coalesce(*[F.when(F.col("value") <= b, F.lit(b)) for b in BOUNDS], F.lit(1e12))
    w = Window.partitionBy("metric").orderBy("le").rowsBetween(Window.unboundedPreceding, 0)  # 15 buckets a metric
    return s.groupBy("metric", le.alias("le")).agg(F.count(F.lit(1)).alias("k")).select("metric", "le", F.sum("k").over(w).alias("n"))


def histogram_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative histogram of 14 fixed bounds (the last bucket has no bound: 1e12)."""
    return _buckets(spark, d)


def histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The 95th percentile interpolated from the buckets."""
    return a.histogram_quantile(_buckets(spark, d), ["metric"], 0.95).select("metric", F.round("quantile", 6).alias("p95"))


def gap_and_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per cohort and metric the longest time without a sample."""
    s = table(spark, d, "samples", "cohort", "metric", "observed_at").withColumn("at_us", micros(F.col("observed_at")))
    return a.gaps_over(s, ["cohort", "metric"], "at_us")


def slot_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Per kind the hours from its first to its last event, those with events, and the share."""
    e = table(spark, d, "events", "event_type", "ts").select(F.col("event_type").alias("kind"), F.expr("floor(unix_micros(cast(ts as timestamp)) / 3600000000)").alias("slot"))
    x = e.groupBy("kind").agg((F.max("slot") - F.min("slot") + 1).alias("expected"), F.countDistinct("slot").alias("seen"))
    return x.withColumn("coverage", F.round(F.col("seen") / F.col("expected"), 6))


def sustained_condition(spark: SparkSession, d: str) -> DataFrame:
    """Users whose events stayed above 40 for at least an hour with no pause over a day."""
    e = _events(spark, d)
    return a.sustained(e, ["user_id"], "at_us", F.col("value") > 40, a.HOUR_US, 24 * a.HOUR_US)


def max_concurrency_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Per job the most calls running at one time."""
    m = table(spark, d, "movement", "call_id", "job_id", "started_at", "completed_at").distinct()
    return a.peak_concurrency(m.select(F.col("job_id").alias("entity"), micros(F.col("started_at")).alias("start_us"), micros(F.col("completed_at")).alias("end_us"))).select(F.col("entity").alias("job_id"), "peak")


def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Closed calls that ran while a phase did; phases are the thirds of the months, from the first start to the last end. Counted per phase."""
    m = table(spark, d, "movement", "call_id", "started_at", "completed_at").distinct().select("call_id", micros(F.col("started_at")).alias("l_start"), micros(F.col("completed_at")).alias("l_end")).where("l_start IS NOT NULL AND l_end IS NOT NULL")
    month = lambda c: F.trunc(F.timestamp_micros(c), "month")
    days = m.where("l_end > l_start").agg(F.min("l_start").alias("a"), F.max("l_end").alias("b")).select(F.explode(F.sequence(month(F.col("a")), month(F.col("b")), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    phases = days.select(F.explode(F.array(*[F.struct((F.unix_micros(F.date_add("month", k * 10).cast("timestamp"))).alias("r_start"), F.unix_micros((F.date_add("month", k * 10 + 10) if k < 2 else F.add_months("month", 1)).cast("timestamp")).alias("r_end")) for k in range(3)])).alias("p")).select("p.*")
    return a.overlap_join(m, phases, 10 * 24 * a.HOUR_US).groupBy("r_start").agg(F.count(F.lit(1)).alias("calls"))


def attempt_chain_check(spark: SparkSession, d: str) -> DataFrame:
    """Part of T16, E6: moves whose attempts have holes, several successes or a success before the last (whole: attempt_chain_faults)."""
    m = table(spark, d, "movement", "call_id", "logical_move_id", "attempt_number", "started_at", "success").distinct()
    x = m.groupBy("logical_move_id").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("attempt_number").alias("attempts"), F.min("attempt_number").alias("least"), F.max("attempt_number").alias("most"), F.count_if("success").alias("successes"), F.max(F.when(F.col("success"), F.col("attempt_number"))).alias("won"))
    return x.select("logical_move_id", "calls", ((F.col("least") != 1) | (F.col("most") - F.col("least") + 1 != F.col("attempts"))).alias("holes"), (F.col("successes") > 1).alias("several"), F.coalesce(F.col("won") < F.col("most"), F.lit(False)).alias("early")).where("holes OR several OR early")


def attempt_chain_faults(spark: SparkSession, d: str) -> DataFrame:
    """Moves whose attempts have holes, several successes, a success before the last, times that fall, or a wrong end.

    start_falls, end_falls: an attempt starts or ends before one of lower number; unknown times are passed over. wrong_end: an attempt whose
    terminal state says otherwise than its success, or a terminal state before the last attempt.
    """
    m = table(spark, d, "movement", "call_id", "logical_move_id", "attempt_number", "started_at", "completed_at", "success", "terminal_state").distinct()
    n = F.col("attempt_number")
    agrees = F.coalesce(F.col("terminal_state") == "succeeded", F.lit(False)).eqNullSafe(F.col("success"))
    x = m.groupBy("logical_move_id", "attempt_number").agg(F.count(F.lit(1)).alias("calls"), F.count_if("success").alias("successes"), F.min("started_at").alias("start"), F.max("started_at").alias("last_start"), F.min("completed_at").alias("end"), F.max("completed_at").alias("last_end"), F.bool_and(agrees).alias("agree"), F.count("terminal_state").alias("terminal"))
    w = Window.partitionBy("logical_move_id").orderBy("attempt_number")  # a row per attempt of a move
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.select("*", (F.col("start") < F.max("last_start").over(before)).alias("sf"), (F.col("end") < F.max("last_end").over(before)).alias("ef"), F.lead(n).over(w).isNotNull().alias("followed"))
    flags = {
        "holes": (F.min(n) != 1) | (F.max(n) - F.min(n) + 1 != F.count(n)),
        "several": F.sum("successes") > 1,
        "early": F.coalesce(F.max(F.when(F.col("successes") > 0, n)) < F.max(n), F.lit(False)),
        "start_falls": F.coalesce(F.bool_or("sf"), F.lit(False)),
        "end_falls": F.coalesce(F.bool_or("ef"), F.lit(False)),
        "wrong_end": F.bool_or(~F.col("agree") | (F.col("followed") & (F.col("terminal") > 0))),
    }
    return x.groupBy("logical_move_id").agg(F.sum("calls").alias("calls"), *[f.alias(k) for k, f in flags.items()]).where(" OR ".join(flags))


def job_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per job its latest call, the number of calls and the most attempts."""
    m = table(spark, d, "movement", "call_id", "job_id", "attempt_number", "started_at", "success", "terminal_state").distinct()
    last = F.max(F.struct(F.coalesce(micros(F.col("started_at")), F.lit(-1)).alias("at_us"), "attempt_number", "call_id", F.coalesce("terminal_state", F.lit("open")).alias("state"))).alias("last")
    return m.groupBy("job_id").agg(last, F.count(F.lit(1)).alias("calls"), F.max("attempt_number").alias("most_attempts")).select("job_id", F.col("last.state").alias("state"), F.col("last.call_id").alias("last_call"), "calls", "most_attempts")


def lag_state_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How often an event of one kind follows one of another kind of the same user."""
    e = _events(spark, d)
    x = order.with_before(e, ["user_id"], ["at_us", "event_id"], ["kind"], F.expr(f"at_us div {24 * a.HOUR_US}")).where("before.kind IS NOT NULL")
    return x.groupBy(F.col("before.kind").alias("from_kind"), F.col("kind").alias("to_kind")).agg(F.count(F.lit(1)).alias("n"))


def load_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Per cohort and metric the samples, the failed ones, and whether 99 percent succeeded, by integers alone."""
    s = table(spark, d, "samples", "sample_id", "cohort", "metric", "value").distinct().where("value IS NOT NULL AND NOT isnan(value)")
    x = s.groupBy("cohort", "metric").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("value") == -1).alias("failed"))
    return x.withColumn("enough", ((F.col("samples") - F.col("failed")) * 1000 >= F.col("samples") * 990))


def max_unless_unknown(spark: SparkSession, d: str) -> DataFrame:
    """The greatest value per metric, but for metrics with a sample that has no value."""
    s = table(spark, d, "samples", "metric", "value")
    unknown = s.where("value IS NULL").select("metric").distinct()
    return s.where("NOT isnan(value)").groupBy("metric").agg(F.max("value").alias("most")).join(unknown, "metric", "left_anti")


def ingestion_lag(spark: SparkSession, d: str) -> DataFrame:
    """Per metric the mean and the greatest time from observation to receipt, and how many came more than a day late."""
    s = table(spark, d, "samples", "sample_id", "metric", "observed_at", "received_at").distinct().where("observed_at IS NOT NULL AND received_at IS NOT NULL")
    lag = micros(F.col("received_at")) - micros(F.col("observed_at"))
    return s.groupBy("metric").agg(F.count(F.lit(1)).alias("samples"), F.max(lag).alias("most_us"), F.expr("cast(sum(unix_micros(cast(received_at as timestamp)) - unix_micros(cast(observed_at as timestamp))) as bigint) div count(1)").alias("mean_us"), F.count_if(lag > 24 * a.HOUR_US).alias("late"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Per user the sessions between pauses of two hours, and the longest by events."""
    e = table(spark, d, "events", "user_id", "ts")
    s = e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def audit_page(spark: SparkSession, d: str) -> DataFrame:
    """The newest errors and purchases of January's second week behind a cursor (time, id), 100 a page."""
    e = table(spark, d, "events", "event_id", "ts", "event_type", "user_id").where(F.col("event_type").isin("error", "purchase"))
    e = e.where((F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")))
    mark = F.lit("2024-01-13 12:00:00").cast("timestamp_ntz")
    e = e.where((F.col("ts") < mark) | ((F.col("ts") == mark) & (F.col("event_id") < 5000)))
    return e.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("event_id", "event_type", "user_id")


def offset_page(spark: SparkSession, d: str) -> DataFrame:
    """orders by price, the page from 200 to 250."""
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(200).limit(50)


def workload(spark: SparkSession, d: str) -> DataFrame:
    """A reproducible workload of 10,000 requests: kinds by cycle, sizes by hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("w:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return spark.range(10_000).select("id", F.element_at(F.array(F.lit("put"), F.lit("get"), F.lit("head")), (F.col("id") % 3 + 1).cast("int")).alias("kind"), F.when(h % 100 < 50, 256).when(h % 100 < 80, 1024).otherwise(4096).alias("bytes"))


def before_after(spark: SparkSession, d: str) -> DataFrame:
    """Per metric the largest value before and after the middle of 2025, and whether it grew by a tenth at most."""
    s = table(spark, d, "samples", "metric", "value", "observed_at").where("value IS NOT NULL AND NOT isnan(value)")
    cut = F.lit("2025-06-30").cast("timestamp_ntz")
    x = s.groupBy("metric").agg(F.max(F.when(F.col("observed_at") < cut, F.col("value"))).alias("before"), F.max(F.when(F.col("observed_at") >= cut, F.col("value"))).alias("after"))
    return x.withColumn("bounded", F.col("after") * 100 <= F.col("before") * 110)


def evidence_join(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose job has a call that was never verified, and jobs with verified calls alone."""
    m = table(spark, d, "movement", "call_id", "job_id", "verified").distinct()
    bad = m.where("NOT verified").select("job_id").distinct()
    touched = m.join(bad, "job_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("calls of jobs with an unverified call"))
    clean = m.select("job_id").distinct().join(bad, "job_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("jobs with verified calls alone"))
    return touched.unionByName(clean)


def eligible_slots(spark: SparkSession, d: str) -> DataFrame:
    """Five-hour slots of each kind with at least 20 events whose values are all positive."""
    e = table(spark, d, "events", "event_type", "ts", "value")
    x = e.groupBy("event_type", F.window("ts", "5 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))
    return x.where("n >= 20 AND least > 0").select("event_type", F.col("w.start").alias("start"), "n")


QUERIES = {f.__name__: f for f in (access_window_aggregate, access_recency, sliding_rate_window, bad_event_ratio, multi_window_alert, histogram_buckets, histogram_quantile, gap_and_coverage, slot_completeness, sustained_condition, max_concurrency_sweep, interval_overlap_join, attempt_chain_check, attempt_chain_faults, job_status_rollup, lag_state_transitions, load_evaluation, max_unless_unknown, ingestion_lag, sessions, audit_page, offset_page, workload, before_after, evidence_join, eligible_slots)}

_E = "e AS (SELECT event_id, user_id, event_type AS kind, epoch_us(ts) AS at_us, value, CASE WHEN value < 100 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS sample_rate, max(epoch_us(ts)) OVER () AS as_of FROM events)"
_CELLS = ", ".join(
    f"count(*) FILTER (kind = '{k}' AND at_us > as_of - {h}::BIGINT * 3600000000) AS {k}_{w}, round(coalesce(sum(1 / sample_rate) FILTER (kind = '{k}' AND at_us > as_of - {h}::BIGINT * 3600000000), 0), 6)::DOUBLE AS {k}_{w}_weight"
    for w, h in a.WINDOWS.items()
    for k in KINDS
)
_BUCKETS = "b AS (SELECT metric, CASE " + " ".join(f"WHEN value <= {b} THEN {b}::DOUBLE" for b in BOUNDS) + " ELSE 1e12::DOUBLE END AS le, count(*) AS k FROM (SELECT DISTINCT sample_id, metric, value FROM samples WHERE value IS NOT NULL AND NOT isnan(value) AND value >= 0) GROUP BY ALL), c AS (SELECT metric, le, (sum(k) OVER (PARTITION BY metric ORDER BY le))::BIGINT AS n FROM b)"
_CALLS = "(SELECT DISTINCT call_id, job_id, logical_move_id, attempt_number, direction, started_at, completed_at, success, terminal_state FROM movement)"

SQL = {
    "access_window_aggregate": f"WITH {_E} SELECT user_id, count(*) AS events, min(at_us) AS first_us, max(at_us) AS last_us, min(sample_rate) AS least_rate, {_CELLS} FROM e WHERE at_us > as_of - 720::BIGINT * 3600000000 GROUP BY 1",
    "access_recency": f"WITH {_E}, u AS (SELECT user_id, max(as_of) - max(at_us) AS age, min(sample_rate) AS least FROM e GROUP BY 1) SELECT user_id, age // 1000000 AS recency_s, CASE WHEN age <= 6::BIGINT * 3600000000 THEN 'fresh' ELSE 'stale' END AS state, least < 1 AS sampled FROM u",
    "sliding_rate_window": "SELECT event_type, start, count(*) AS n, round(count(*) / 3600, 6) AS rate FROM (SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS start FROM events, range(4) r(k)) GROUP BY 1, 2",
    "bad_event_ratio": "SELECT direction, day, calls, good, round(b, 6) AS bad_ratio, round(b / 0.01::DOUBLE, 4) AS burn_rate, round(1 - b / 0.01::DOUBLE, 4) AS budget_left FROM (SELECT direction, started_at::DATE AS day, count(*) AS calls, count(*) FILTER (success) AS good, greatest(0, least(1, 1 - good / calls)) AS b FROM " + "(SELECT DISTINCT call_id, direction, started_at, success FROM movement) WHERE started_at IS NOT NULL GROUP BY 1, 2)",
    "multi_window_alert": "WITH h AS (SELECT floor(epoch_us(started_at) / 21600000000)::BIGINT AS slot, count(*) AS calls, count(*) FILTER (NOT success) AS bad FROM (SELECT DISTINCT call_id, started_at, success FROM movement) WHERE started_at IS NOT NULL GROUP BY 1), x AS (SELECT *, (sum(calls) OVER w)::BIGINT AS long_calls, (sum(bad) OVER w)::BIGINT AS long_bad FROM h WINDOW w AS (ORDER BY slot RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT * FROM x WHERE bad * 100 > calls * 10 AND long_bad * 100 > long_calls * 8",
    "histogram_buckets": f"WITH {_BUCKETS} SELECT * FROM c",
    "histogram_quantile": f"WITH {_BUCKETS}, x AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, max(n) OVER (PARTITION BY metric) * 0.95::DOUBLE AS rank FROM c WINDOW w AS (PARTITION BY metric ORDER BY le)) SELECT metric, round(min(low + (le - low) * (rank - below) / (n - below)), 6) AS p95 FROM x WHERE n >= rank AND below < rank GROUP BY 1",
    "gap_and_coverage": "WITH t AS (SELECT cohort, metric, epoch_us(observed_at) AS t, count(*) AS n FROM samples WHERE observed_at IS NOT NULL GROUP BY ALL), g AS (SELECT *, t - lag(t) OVER (PARTITION BY cohort, metric ORDER BY t) AS gap FROM t) SELECT cohort, metric, sum(n)::BIGINT AS events, count(*) AS times, coalesce(max(gap), 0) AS longest_gap_us FROM g GROUP BY 1, 2",
    "slot_completeness": "SELECT kind, max(slot) - min(slot) + 1 AS expected, count(DISTINCT slot) AS seen, round(count(DISTINCT slot) / (max(slot) - min(slot) + 1), 6) AS coverage FROM (SELECT event_type AS kind, epoch_us(ts) // 3600000000 AS slot FROM events) GROUP BY 1",
    "sustained_condition": f"WITH {_E}, t AS (SELECT user_id, at_us AS t, bool_and(value > 40) AS ok FROM e GROUP BY 1, 2), b AS (SELECT *, coalesce(NOT ok OR t - lag(t) OVER w > 86400000000 OR NOT lag(ok) OVER w, TRUE) AS brk FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t)), p AS (SELECT *, sum(brk::INT) OVER (PARTITION BY user_id ORDER BY t) AS part FROM b) SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS samples FROM p WHERE ok GROUP BY user_id, part HAVING max(t) - min(t) >= 3600000000",
    "max_concurrency_sweep": f"WITH e AS (SELECT job_id, epoch_us(started_at) AS t, 1 AS d FROM {_CALLS} WHERE started_at IS NOT NULL AND (completed_at IS NULL OR completed_at > started_at) UNION ALL SELECT job_id, epoch_us(completed_at), -1 FROM {_CALLS} WHERE completed_at > started_at), n AS (SELECT job_id, t, sum(d) AS d FROM e GROUP BY 1, 2) SELECT job_id, max(p)::BIGINT AS peak FROM (SELECT job_id, sum(d) OVER (PARTITION BY job_id ORDER BY t) AS p FROM n) GROUP BY 1",
    "interval_overlap_join": "WITH months AS (SELECT m::DATE AS m FROM (SELECT unnest(generate_series(date_trunc('month', min(started_at)), date_trunc('month', max(completed_at)), INTERVAL 1 MONTH)) AS m FROM movement WHERE completed_at > started_at)), phases AS (SELECT epoch_us((m + (k * 10)::INT)::TIMESTAMP) AS s, CASE WHEN k < 2 THEN epoch_us((m + (k * 10 + 10)::INT)::TIMESTAMP) ELSE epoch_us((m + INTERVAL 1 MONTH)::TIMESTAMP) END AS e FROM months, range(3) r(k)) SELECT s AS r_start, count(*) AS calls FROM phases p JOIN (SELECT DISTINCT call_id, epoch_us(started_at) AS a, epoch_us(completed_at) AS b FROM movement WHERE completed_at > started_at) c ON c.a < p.e AND p.s < c.b GROUP BY 1",
    "attempt_chain_check": "SELECT * FROM (SELECT logical_move_id, count(*) AS calls, min(attempt_number) <> 1 OR max(attempt_number) - min(attempt_number) + 1 <> count(DISTINCT attempt_number) AS holes, count(*) FILTER (success) > 1 AS several, coalesce(max(attempt_number) FILTER (success) < max(attempt_number), FALSE) AS early FROM (SELECT DISTINCT call_id, logical_move_id, attempt_number, started_at, success FROM movement) GROUP BY 1) WHERE holes OR several OR early",
    "attempt_chain_faults": "WITH m AS (SELECT DISTINCT call_id, logical_move_id AS l, attempt_number AS a, started_at AS s, completed_at AS e, success, terminal_state AS t FROM movement), p AS (SELECT DISTINCT y.l, y.s < x.s AS sf, y.e < x.e AS ef, x.t IS NOT NULL AS bt FROM m x JOIN m y ON x.l = y.l AND x.a < y.a), q AS (SELECT l, coalesce(bool_or(sf), FALSE) AS start_falls, coalesce(bool_or(ef), FALSE) AS end_falls, bool_or(bt) AS bt FROM p GROUP BY 1), g AS (SELECT l, count(*) AS calls, min(a) <> 1 OR max(a) - min(a) + 1 <> count(DISTINCT a) AS holes, count(*) FILTER (success) > 1 AS several, coalesce(max(a) FILTER (success) < max(a), FALSE) AS early, bool_or(coalesce(t = 'succeeded', FALSE) IS DISTINCT FROM success) AS bad FROM m GROUP BY 1) SELECT * FROM (SELECT g.l AS logical_move_id, calls, holes, several, early, coalesce(start_falls, FALSE) AS start_falls, coalesce(end_falls, FALSE) AS end_falls, bad OR coalesce(bt, FALSE) AS wrong_end FROM g LEFT JOIN q ON g.l = q.l) WHERE holes OR several OR early OR start_falls OR end_falls OR wrong_end",
    "job_status_rollup": f"SELECT job_id, coalesce(arg_max(coalesce(terminal_state, 'open'), (coalesce(epoch_us(started_at), -1), attempt_number, call_id)), 'open') AS state, arg_max(call_id, (coalesce(epoch_us(started_at), -1), attempt_number, call_id)) AS last_call, count(*) AS calls, max(attempt_number) AS most_attempts FROM (SELECT DISTINCT call_id, job_id, attempt_number, started_at, success, terminal_state FROM movement) GROUP BY 1",
    "lag_state_transitions": "SELECT before AS from_kind, kind AS to_kind, count(*) AS n FROM (SELECT event_type AS kind, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY 1, 2",
    "load_evaluation": "SELECT cohort, metric, count(*) AS samples, count(*) FILTER (value = -1) AS failed, (count(*) - count(*) FILTER (value = -1)) * 1000 >= count(*) * 990 AS enough FROM (SELECT DISTINCT sample_id, cohort, metric, value FROM samples) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2",
    "max_unless_unknown": "SELECT metric, max(value) AS most FROM samples WHERE NOT isnan(value) AND metric NOT IN (SELECT metric FROM samples WHERE value IS NULL) GROUP BY 1",
    "ingestion_lag": "SELECT metric, count(*) AS samples, max(g) AS most_us, (sum(g) // count(*))::BIGINT AS mean_us, count(*) FILTER (g > 86400000000) AS late FROM (SELECT metric, epoch_us(received_at) - epoch_us(observed_at) AS g FROM (SELECT DISTINCT sample_id, metric, observed_at, received_at FROM samples) WHERE observed_at IS NOT NULL AND received_at IS NOT NULL) GROUP BY 1",
    "sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), p AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS part FROM g), s AS (SELECT user_id, part, count(*) AS n FROM p GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM s GROUP BY 1",
    "audit_page": "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('error', 'purchase') AND ts >= '2024-01-08' AND ts < '2024-01-15' AND (ts < '2024-01-13 12:00:00' OR (ts = '2024-01-13 12:00:00' AND event_id < 5000)) ORDER BY ts DESC, event_id DESC LIMIT 100",
    "offset_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 200",
    "workload": "SELECT id, ['put', 'get', 'head'][id % 3 + 1] AS kind, CASE WHEN h % 100 < 50 THEN 256 WHEN h % 100 < 80 THEN 1024 ELSE 4096 END AS bytes FROM (SELECT id, ('0x' || substr(sha256('w:' || id), 1, 8))::BIGINT AS h FROM range(10000) r(id))",
    "before_after": "SELECT metric, max(value) FILTER (observed_at < '2025-06-30') AS before, max(value) FILTER (observed_at >= '2025-06-30') AS after, max(value) FILTER (observed_at >= '2025-06-30') * 100 <= max(value) FILTER (observed_at < '2025-06-30') * 110 AS bounded FROM samples WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1",
    "evidence_join": "WITH m AS (SELECT DISTINCT call_id, job_id, verified FROM movement), b AS (SELECT DISTINCT job_id FROM m WHERE NOT verified) SELECT count(*) AS n, 'calls of jobs with an unverified call' AS what FROM m WHERE job_id IN (FROM b) UNION ALL SELECT count(DISTINCT job_id), 'jobs with verified calls alone' FROM m WHERE job_id NOT IN (FROM b)",
    "eligible_slots": "SELECT event_type, time_bucket(INTERVAL '5 hours', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 20 AND min(value) > 0",
}
