"""Queries over jobs, their events, decisions and copies, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import hooks
from lodestone.functions.keys import instant_us, micros, plain_key
from lodestone.operators import learn, order
from lodestone.operators import predicates as p
from lodestone.plans.learning import DAY_US, _calls
from lodestone.sources import sinks
from lodestone.sources.tables import table

#: The states of a move and those that may follow each.
NEXT = {"prepared": ["transferred", "failed"], "transferred": ["verified", "failed"], "verified": ["committed", "failed"], "committed": ["cleanup", "failed"], "cleanup": ["completed", "failed"], "completed": [], "failed": []}
#: The phase of each event of a job's life, by which events of one attempt and time are ordered.
PHASES = {"queued": 0, "started": 1, "failure": 2, "retry": 3, "dead_lettered": 4, "succeeded": 5}


def _movement(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "movement", "call_id", "job_id", "logical_move_id", "attempt_number", "direction", "cohort", "size_bytes", "started_at", "completed_at", "success", "verified", "terminal_state").distinct()


def _job_events(spark: SparkSession, d: str) -> DataFrame:
    """The life of each job as events: queued with its first call, a start for each call, and success, failure with retry, or failure alone."""
    m = _movement(spark, d).where("started_at IS NOT NULL").withColumn("at_us", micros(F.col("started_at"))).withColumn("end_us", micros(F.col("completed_at")))
    e = lambda kind, at, error=F.lit(None).cast("string"), retry=F.lit(None).cast("boolean"): F.struct(F.lit(kind).alias("kind"), at.alias("at_us"), F.lit(PHASES[kind]).alias("phase"), error.alias("error"), retry.alias("retryable"))
    failed = ~F.col("success")
    error = F.when(F.col("verified"), F.lit("store.TimeoutError")).otherwise(F.lit("store.DigestError"))
    end = F.coalesce("end_us", "at_us")
    each = F.array_compact(F.array(F.when(F.col("attempt_number") == 1, e("queued", F.col("at_us"))), e("started", F.col("at_us")), F.when(F.col("success") & F.col("end_us").isNotNull(), e("succeeded", F.col("end_us"))), F.when(failed, e("failure", end, error, F.col("verified"))), F.when(failed & F.col("verified"), e("retry", end)), F.when(failed & ~F.col("verified") & (F.col("attempt_number") >= 3), e("dead_lettered", end))))
    return m.select("job_id", "call_id", F.col("attempt_number").alias("attempt"), F.explode(each).alias("e")).select("job_id", "call_id", "attempt", "e.*")


def _statuses(events: DataFrame) -> DataFrame:
    """job_id, status, attempt, retryable, error_type: the latest event by (attempt, time, phase) tells the status; of the failures the latest
    known retryable and error count, and only where the job failed or is tried again. An aggregate with map-side combine."""
    at = F.struct("attempt", "at_us", "phase", "call_id")
    x = events.groupBy("job_id").agg(
        F.max_by("kind", at).alias("kind"), F.max("attempt").alias("attempt"), F.max_by("retryable", F.when(F.col("retryable").isNotNull(), at)).alias("retryable"), F.max_by("error", F.when(F.col("error").isNotNull(), at)).alias("error"), F.min(F.when(F.col("kind") == "queued", F.col("at_us"))).alias("queued_us")
    )
    status = F.when(F.col("kind") == "succeeded", "succeeded").when(F.col("kind") == "dead_lettered", "failed").when(F.col("kind") == "retry", "retrying").when(F.col("kind").isin("started", "failure"), "running").otherwise("queued")
    bad = status.isin("failed", "retrying")
    return x.select("job_id", status.alias("status"), "attempt", F.when(bad, F.col("retryable")).alias("retryable"), F.when(bad, F.substring_index("error", ".", -1)).alias("error_type"), "queued_us")


def job_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Each job's status (queued, running, retrying, failed, succeeded), attempts, and what is known of its last failure."""
    return _statuses(_job_events(spark, d)).drop("queued_us")


def job_history_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of 50 jobs queued before an instant, the newest first, each once with its status."""
    s = _statuses(_job_events(spark, d))
    mark = (F.lit(1_750_000_000_000_000), F.lit("job-5"))
    return s.where(p.events(behind=mark, time="queued_us", identity="job_id")).orderBy(F.col("queued_us").desc(), F.col("job_id").desc()).limit(50)


def job_page(spark: SparkSession, d: str) -> DataFrame:
    """Calls by state and a prefix of their job's id, in the order of time and id, the first 100 behind a cursor."""
    m = _movement(spark, d).where("started_at IS NOT NULL").withColumn("at_us", micros(F.col("started_at"))).withColumn("state", F.coalesce("terminal_state", F.lit("open")))
    m = m.where(p.all_of(p.one_of(F.col("state"), ["open", "succeeded"]), F.col("job_id").startswith("job-1"), (F.col("at_us") > 1_710_000_000_000_000) | ((F.col("at_us") == 1_710_000_000_000_000) & (F.col("call_id") > "call-5"))))
    return m.orderBy("at_us", "call_id").limit(100).select("call_id", "job_id", "state", "at_us")


def audit_query(spark: SparkSession, d: str) -> DataFrame:
    """The newest 100 log events of a direction, cohort and list of kinds and outcomes, in a half-open time, behind a (time, id)."""
    m = _movement(spark, d).where("started_at IS NOT NULL").select(F.col("call_id").alias("event_id"), F.col("direction").alias("actor_id"), F.col("cohort").alias("policy_name"), F.lit("mover").alias("actor_type"), F.when(F.col("attempt_number") > 1, "move.retried").otherwise("move.started").alias("event_type"), F.when(F.col("success"), "success").otherwise("failure").alias("outcome"), micros(F.col("started_at")).alias("occurred_at"), "job_id")
    keep = p.events({"actor_id": "cold-to-warm", "actor_type": "mover"}, ["move.retried", "move.started"], ["success", "failure"], F.lit(1_704_067_200_000_000), F.lit(1_767_225_600_000_000), (F.lit(1_750_000_000_000_000), F.lit("call-8")))
    return m.where(keep).orderBy(F.col("occurred_at").desc(), F.col("event_id").desc()).limit(100).select("event_id", "job_id", "event_type", "outcome", "occurred_at")


def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    """Open calls whose lease of a day was over at the last start of all, counted per direction."""
    m = _movement(spark, d).where("started_at IS NOT NULL").withColumn("at_us", micros(F.col("started_at")))
    m = m.withColumn("now_us", m.agg(F.max("at_us")).scalar())
    return m.where(p.all_of(F.col("completed_at").isNull(), F.col("at_us") + DAY_US < F.col("now_us"))).groupBy("direction").agg(F.count(F.lit(1)).alias("stale"))


def scan_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What a scan may say of each move: not while a call of it is open, not of the source after the latest succeeded, nor of its target where that failed."""
    m = _movement(spark, d)
    state = F.when(F.col("completed_at").isNull(), "open").when(F.col("success"), "completed").otherwise("failed")
    jobs = m.select(F.col("logical_move_id").alias("move"), F.struct(F.coalesce(micros(F.col("started_at")), F.lit(-1)).alias("at"), "attempt_number", "call_id").alias("order"), state.alias("state"), F.col("completed_at").isNotNull().alias("terminal"))
    return p.scan_is_authoritative(jobs, ["move"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("moves"))


def invalid_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Changes of state that no move may make, counted. A move's states follow from its calls in the order of attempts: prepared, then
    failed, or transferred, verified and, where it ended, completed; a success that skips committed and cleanup, and what follows an end, is none."""
    m = _movement(spark, d).where("logical_move_id IS NOT NULL")
    states = F.when(~F.col("success"), F.array(F.lit("prepared"), F.lit("failed"))).when(F.col("terminal_state").isNull(), F.array(F.lit("prepared"), F.lit("transferred"), F.lit("verified"))).otherwise(F.array(F.lit("prepared"), F.lit("transferred"), F.lit("verified"), F.lit("completed")))
    s = m.select("logical_move_id", "attempt_number", "call_id", F.posexplode(states).alias("step", "state"))
    s = order.with_before(s, ["logical_move_id"], ["attempt_number", "call_id", "step"], ["state"], F.expr("attempt_number div 64"))
    edges = spark.createDataFrame([(a, b) for a, after in NEXT.items() for b in after], "from_state string, to_state string")
    seen = s.where("before IS NOT NULL").groupBy(F.col("before.state").alias("from_state"), F.col("state").alias("to_state")).agg(F.count(F.lit(1)).alias("changes"))
    return seen.join(F.broadcast(edges), ["from_state", "to_state"], "left_anti")  # a row per edge


def move_sequence_faults(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of a move that do not follow the one before by one, or whose cause is another. The cause of an attempt is the call before
    it; in one move of thirteen it is changed by rule."""
    m = _movement(spark, d).groupBy("logical_move_id", "attempt_number").agg(F.min("call_id").alias("call_id"))
    x = order.with_before(m, ["logical_move_id"], ["attempt_number"], ["attempt_number", "call_id"], F.expr("attempt_number div 64"))
    odd = F.pmod(F.conv(F.substring(F.md5("call_id"), 1, 4), 16, 10).cast("int"), F.lit(13)) == 0
    cause = F.when(odd, F.col("call_id")).otherwise(F.col("before.call_id"))
    faults = F.array_compact(F.array(F.when(F.col("attempt_number") != F.coalesce(F.col("before.attempt_number") + 1, F.lit(1)), F.lit("sequence_gap")), F.when(F.col("before").isNotNull() & (cause != F.col("before.call_id")), F.lit("causation_mismatch"))))
    return x.select("logical_move_id", "attempt_number", F.explode(faults).alias("fault"))


def decision_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label of each move's decision: not applicable outside the cohorts that move, pending while its window of 30 days is open at
    the last instant of all, observed with the outcome of the last call that ended in it, else missing; counted."""
    m = _movement(spark, d).where("started_at IS NOT NULL").withColumn("at_us", micros(F.col("started_at"))).withColumn("end_us", micros(F.col("completed_at")))
    m = m.withColumn("as_of", m.agg(F.max("at_us")).scalar())
    first = F.min("at_us").alias("decided_us")
    x = m.groupBy("logical_move_id").agg(first, F.max("as_of").alias("as_of"), F.max("cohort").alias("cohort"))
    ends = m.where("end_us IS NOT NULL").select("logical_move_id", "end_us", "attempt_number", "call_id", "success")
    last = ends.join(x.select("logical_move_id", "decided_us"), "logical_move_id").where(F.col("end_us") < F.col("decided_us") + 30 * DAY_US).groupBy("logical_move_id").agg(F.max_by("success", F.struct("end_us", "attempt_number", "call_id")).alias("outcome"))
    y = x.join(last, "logical_move_id", "left")
    status = F.when(F.col("cohort") == "nominal", "not_applicable").when(F.col("as_of") < F.col("decided_us") + 30 * DAY_US, "pending").when(F.col("outcome").isNotNull(), "observed").otherwise("missing")
    return y.groupBy(status.alias("status"), F.when(status == "observed", F.col("outcome")).alias("value")).agg(F.count(F.lit(1)).alias("moves"))


def metrics_by_policy(spark: SparkSession, d: str) -> DataFrame:
    """The rule's confusion metrics grouped by the digest of a policy's identity as canonical JSON."""
    m = _calls(spark, d).withColumn("guess", (F.col("attempt_number") == 1) & (F.col("size_bytes") <= 65536))
    identity = m.select(F.coalesce("cohort", F.lit("")).alias("name"), F.lit("first-attempt").alias("implementation"), F.lit("1").alias("version"))
    digest = F.sha2(F.to_json(F.struct(F.lit("first-attempt").alias("implementation"), F.coalesce("cohort", F.lit("")).alias("name"), F.lit("1").alias("version"))), 256)
    assert sorted(identity.columns) == ["implementation", "name", "version"]
    return learn.confusion(m.withColumn("policy_sha256", digest), ["policy_sha256"], "success", "guess")


def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    """Per split whether a learned rule (first attempts succeed) may replace the recorded one (first attempts of at most 64 KiB succeed):
    classes covered, a gain in balanced accuracy, no loss of accuracy, no more bytes moved, no forbidden move."""
    m = _calls(spark, d).withColumn("rule", (F.col("attempt_number") == 1) & (F.col("size_bytes") <= 65536)).withColumn("learned", F.col("attempt_number") == 1)
    s = learn.split_by_time(m, F.col("at_us"), F.col("at_us") + DAY_US, F.lit(1_735_689_600_000_000), F.lit(1_751_328_000_000_000)).where("split IN ('validation', 'test')")
    yes = F.col("success")

    def count(c):
        return F.count_if(c).cast("long")

    x = s.groupBy("split").agg(count(yes).alias("p"), count(~yes).alias("n"), *[count(yes & F.col(g)).alias(f"{g}_tp") for g in ("rule", "learned")], *[count(~yes & ~F.col(g)).alias(f"{g}_tn") for g in ("rule", "learned")], *[F.sum(F.when(F.col(g), F.col("size_bytes")).otherwise(0)).alias(f"{g}_bytes") for g in ("rule", "learned")], count(F.col("learned") & F.col("direction").isNull()).alias("violations"))
    balanced = {g: F.try_divide(F.col(f"{g}_tp"), F.col("p")) + F.try_divide(F.col(f"{g}_tn"), F.col("n")) for g in ("rule", "learned")}
    right = {g: F.col(f"{g}_tp") + F.col(f"{g}_tn") for g in ("rule", "learned")}
    return x.select("split", ((F.col("p") >= 20) & (F.col("n") >= 20)).alias("class_coverage"), F.coalesce((balanced["learned"] - balanced["rule"]) / 2 >= 0.01, F.lit(False)).alias("balanced_accuracy_gain"), (right["learned"] >= right["rule"]).alias("accuracy_no_regression"), (F.col("learned_bytes") <= F.col("rule_bytes")).alias("movement_bytes_no_increase"), (F.col("violations") == 0).alias("allowed_tier_violations_zero"))


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Seven features of each object of the catalog: its size, whether its type and its sightings are known and fresh, whether they are
    partial, how many there are and how old the last is. Unknown is 0 beside a flag that says so."""
    i = table(spark, d, "inventory", "bucket", "object_key", "size", "updated_at").groupBy("bucket", "object_key").agg(F.max(F.struct("updated_at", "size")).alias("x"))
    s = table(spark, d, "sightings", "bucket", "object_key", "seen_at", "checksum").distinct().groupBy("bucket", "object_key").agg(F.count(F.lit(1)).alias("seen"), F.max("seen_at").alias("last"), F.count_if(F.col("checksum").isNull()).alias("unknown"))
    now = table(spark, d, "sightings").agg(F.max(micros(F.col("seen_at")))).scalar()
    age = F.expr("(now - last_us) / 1000000")
    x = i.join(s, ["bucket", "object_key"], "left").withColumn("now", now).withColumn("last_us", micros(F.col("last")))
    fresh = F.coalesce(age <= 90 * 86400, F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return x.select("bucket", "object_key", F.round(F.log1p(F.greatest(F.coalesce("x.size", F.lit(0)), F.lit(0))), 6).alias("log_size"), flag(F.substring_index("object_key", ".", -1).isin("pdf", "csv", "xml", "log", "json")).alias("type_known"), flag(fresh).alias("fresh"), flag(F.col("unknown") > 0).alias("partial"), F.round(F.when(fresh, F.log1p("seen")).otherwise(0.0), 6).alias("log_seen"), flag(fresh & F.col("last_us").isNotNull()).alias("age_known"), F.round(F.when(fresh, F.log1p(age)).otherwise(0.0), 6).alias("log_age"))


def exact_stump(spark: SparkSession, d: str) -> DataFrame:
    """The best single split with leaves of two rows at least, compared as exact fractions; the threshold is the midpoint of its values."""
    return learn.exact_stump(_calls(spark, d), ["attempt_number", "size_bytes", "hour"], "success")


def reference_transitions(spark: SparkSession, d: str) -> DataFrame:
    """D3, G1: the references that blobs gain and lose by all changes of objects' contents: a root edge and one for each chunk of the old
    manifest is taken, those of the new one are given; where they do not cancel."""
    o = table(spark, d, "object_contents", "object_id", "manifest_id", "updated_at").select("object_id", "manifest_id", F.coalesce(instant_us(F.col("updated_at")), F.lit(-1)).alias("at_us")).distinct()
    o = order.with_before(o.withColumn("m", F.coalesce("manifest_id", F.lit(""))), ["object_id"], ["at_us", "m"], ["manifest_id"], F.expr(f"at_us div {30 * DAY_US}"))
    change = o.where("before IS NOT NULL").select(F.explode(F.array(F.struct(F.col("before.manifest_id").alias("manifest_id"), F.lit(-1).alias("delta")), F.struct("manifest_id", F.lit(1).alias("delta")))).alias("c")).select("c.*").where("manifest_id IS NOT NULL")
    net = change.groupBy("manifest_id").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    roots = table(spark, d, "content_manifests", "manifest_id", F.col("content_sha256").alias("sha256")).distinct()
    chunks = table(spark, d, "content_manifest_chunks", "manifest_id", "chunk_index", F.col("chunk_sha256").alias("sha256")).distinct().drop("chunk_index")
    edges = roots.unionByName(chunks).where("sha256 IS NOT NULL")
    return edges.join(net, "manifest_id").groupBy("sha256").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def reference_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a reconciliation: blobs, bytes, wrong counts, and those that may be reclaimed: not referred to and released for 30 days."""
    from lodestone.plans.catalog import reference_reconcile

    b = table(spark, d, "content_blobs", "sha256", "size", "reference_count", "unreferenced_at").distinct()
    bad = reference_reconcile(spark, d).groupBy("sha256").agg(F.max(F.col("issues").contains("count_mismatch")).alias("wrong"), F.max("expected").alias("expected"))
    now = 1_767_225_600_000_000
    x = b.join(bad, "sha256", "left").withColumn("refs", F.coalesce("expected", "reference_count"))
    free = p.all_of(F.col("refs") == 0, instant_us(F.col("unreferenced_at")) <= now - 30 * DAY_US)
    return x.agg(F.count(F.lit(1)).alias("blobs"), F.sum("size").alias("bytes"), F.count_if(F.coalesce("wrong", F.lit(False))).alias("wrong_counts"), F.count_if(free).alias("reclaimable"), F.coalesce(F.sum(F.when(free, F.col("size"))), F.lit(0)).alias("reclaimable_bytes"))


def consistency_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings on each key of catalog and storage by reason and severity, counted: the latest row of the catalog against what storage
    shows in each tier; a key that is seen in several tiers is one too."""
    i = table(spark, d, "inventory", "bucket", "object_key", "tier", "size", "checksum", "updated_at").groupBy("bucket", "object_key").agg(F.max(F.struct("updated_at", plain_key(F.col("tier")).alias("tier"), "size", plain_key(F.col("checksum")).alias("checksum"))).alias("i"))
    s = table(spark, d, "sightings", "bucket", "object_key", "tier", "size", "checksum", "seen_at").groupBy("bucket", "object_key").agg(F.max(F.struct("seen_at", plain_key(F.col("tier")).alias("tier"), "size", plain_key(F.col("checksum")).alias("checksum"))).alias("s"), F.countDistinct(plain_key(F.col("tier"))).alias("tiers"))
    x = i.join(s, ["bucket", "object_key"], "full")
    both = F.col("i").isNotNull() & F.col("s").isNotNull()
    tell = lambda when, reason, severity: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(reason).alias("reason"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(
        tell(F.col("s").isNull(), "storage_missing", "critical"), tell(F.col("i").isNull(), "catalog_missing", "warning"), tell(F.col("tiers") > 1, "several_tiers", "warning"), tell(both & (F.col("i.tier") != F.col("s.tier")), "tier_mismatch", "critical"), tell(both & (F.col("i.size") != F.col("s.size")), "size_mismatch", "critical"), tell(both & (F.col("i.checksum") != F.col("s.checksum")), "checksum_mismatch", "critical"),
        tell(both & F.col("i.tier").isNull(), "catalog_tier_unknown", "info"), tell(both & F.col("s.tier").isNull(), "storage_tier_unknown", "info"), tell(both & F.col("i.size").isNull(), "catalog_size_unknown", "info"), tell(both & F.col("s.size").isNull(), "storage_size_unknown", "info"), tell(both & F.col("i.checksum").isNull(), "catalog_checksum_unknown", "info"), tell(both & F.col("s.checksum").isNull(), "storage_checksum_unknown", "info"), tell(both & (F.col("s.seen_at") < F.col("i.updated_at")), "sighting_stale", "info"),
    ))
    return x.select("bucket", F.explode(found).alias("f")).groupBy("bucket", "f.reason", "f.severity").agg(F.count(F.lit(1)).alias("keys"))


def simulation_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Baseline (the catalog's tier) against proposed (the tier storage shows) per object: bytes and objects of each tier and the deltas."""
    i = table(spark, d, "inventory", "bucket", "object_key", "tier", "size", "updated_at").groupBy("bucket", "object_key").agg(F.max(F.struct("updated_at", plain_key(F.col("tier")).alias("tier"), "size")).alias("i"))
    s = table(spark, d, "sightings", "bucket", "object_key", "tier", "seen_at").groupBy("bucket", "object_key").agg(F.max(F.struct("seen_at", plain_key(F.col("tier")).alias("tier"))).alias("s"))
    x = i.join(s, ["bucket", "object_key"]).select(F.coalesce("i.size", F.lit(0)).alias("size"), F.explode(F.array(F.struct(F.lit("baseline").alias("scenario"), F.col("i.tier").alias("tier")), F.struct(F.lit("proposed").alias("scenario"), F.col("s.tier").alias("tier")))).alias("x"))
    sums = x.groupBy(F.coalesce("x.tier", F.lit("unknown")).alias("tier")).agg(*[f(F.when(F.col("x.scenario") == n, v)).alias(f"{n}_{t}") for n in ("baseline", "proposed") for t, f, v in (("objects", F.count, F.lit(1)), ("bytes", F.sum, F.col("size")))])
    return sums.na.fill(0).withColumn("delta_objects", F.col("proposed_objects") - F.col("baseline_objects")).withColumn("delta_bytes", F.col("proposed_bytes") - F.col("baseline_bytes"))


def passage_star(spark: SparkSession, d: str) -> DataFrame:
    """Passages with their document, its objects of the same bucket in the catalog, their sightings, holds of the bucket and sums per bucket."""
    ps = table(spark, d, "embedding_passages", "passage_id", "document_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("passages"))
    g = table(spark, d, "golden", "id", "bucket", "tier").distinct()
    per = ps.join(g, F.col("document_id") == F.col("id")).groupBy("bucket").agg(F.sum("passages").alias("passages"), F.count(F.lit(1)).alias("documents"), F.countDistinct("tier").alias("tiers"))
    inv = table(spark, d, "inventory", "bucket", "object_key").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("catalogued"))
    see = table(spark, d, "sightings", "bucket", "object_key").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("seen"))
    hold = table(spark, d, "legal_holds", "bucket", "hold_id").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("holds"))
    cor = table(spark, d, "corpus", "bucket", "passage_id").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("corpus_passages"))
    return per.join(inv, "bucket").join(see, "bucket").join(hold, "bucket", "left").join(cor, "bucket", "left").na.fill(0)


def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    """The wait before each failed call's next attempt: doubled per attempt up to a minute, with a jitter of a tenth to both sides by hash."""
    m = _movement(spark, d).where("NOT success").select("call_id", "attempt_number")
    u = F.conv(F.substring(F.sha2("call_id", 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return m.select("call_id", F.round(hooks.backoff_seconds(F.col("attempt_number"), 2.0, 60.0, 0.1, u), 6).alias("wait_s"))


def idempotency_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of each move of an object from the catalog's tier to the one storage shows: a digest of namespace, object and tiers."""
    i = table(spark, d, "inventory", "bucket", "object_key", "tier", "updated_at").groupBy("bucket", "object_key").agg(F.max(F.struct("updated_at", plain_key(F.col("tier")).alias("tier"))).alias("i"))
    s = table(spark, d, "sightings", "bucket", "object_key", "tier", "seen_at").groupBy("bucket", "object_key").agg(F.max(F.struct("seen_at", plain_key(F.col("tier")).alias("tier"))).alias("s"))
    x = i.join(s, ["bucket", "object_key"]).where(F.col("i.tier") != F.col("s.tier"))
    return x.select("bucket", "object_key", F.sha2(F.concat_ws("\x1f", F.lit("move-v1"), "bucket", "object_key", "i.tier", "s.tier"), 256).alias("idempotency_key"))


def absent_series(spark: SparkSession, d: str) -> DataFrame:
    """Series of samples (cohort and metric) that have been silent for ten days at the last observation of all."""
    s = table(spark, d, "samples", "cohort", "metric", "observed_at").where("cohort IS NOT NULL AND observed_at IS NOT NULL").withColumn("at_us", micros(F.col("observed_at")))
    s = s.groupBy("cohort", "metric").agg(F.max("at_us").alias("last_us"))
    return s.withColumn("now_us", F.max("last_us").over(Window.partitionBy())).where(F.col("now_us") - F.col("last_us") > 10 * DAY_US).select("cohort", "metric", "last_us")


def hold_expiries(spark: SparkSession, d: str) -> DataFrame:
    """When each hold ends that is kept for a number of days: null where the sum is beyond what an instant can be."""
    h = table(spark, d, "legal_holds", "hold_id", "created_at").distinct().withColumn("at_us", instant_us(F.col("created_at")))
    days = F.when(F.substring(F.md5("hold_id"), 1, 1) == "0", F.lit(10**9)).otherwise(F.lit(90)).cast("long")
    end = F.try_add(F.col("at_us"), F.try_multiply(days, F.lit(DAY_US)))
    return h.select("hold_id", "at_us", end.alias("ends_us"), F.coalesce(end <= 1_767_225_600_000_000, F.lit(False)).alias("over"))


def canonical_digests(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each person's record as canonical JSON: keys in order, no blanks."""
    s = table(spark, d, "staff_directory", "person_id", "given_name", "family_name", "team")
    return s.select("person_id", F.sha2(sinks.canonical_json(s), 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (job_statuses, job_history_page, job_page, audit_query, stale_runs, scan_verdicts, invalid_transitions, move_sequence_faults, decision_labels, metrics_by_policy, promotion_gates, feature_matrix, exact_stump, reference_transitions, reference_totals, consistency_findings, simulation_deltas, passage_star, retry_delays, idempotency_keys, absent_series, hold_expiries, canonical_digests)}

_M = "(SELECT DISTINCT call_id, job_id, logical_move_id, attempt_number, direction, cohort, size_bytes, started_at, completed_at, success, verified, terminal_state FROM movement)"
_EVENTS = f"""
m AS (SELECT *, epoch_us(started_at) AS s, epoch_us(completed_at) AS e FROM {_M} WHERE started_at IS NOT NULL),
ev AS (SELECT job_id, call_id, attempt_number AS a, s AS at_us, 0 AS phase, 'queued' AS kind, NULL AS err, NULL::BOOLEAN AS retry FROM m WHERE attempt_number = 1
  UNION ALL SELECT job_id, call_id, attempt_number, s, 1, 'started', NULL, NULL FROM m
  UNION ALL SELECT job_id, call_id, attempt_number, e, 5, 'succeeded', NULL, NULL FROM m WHERE success AND e IS NOT NULL
  UNION ALL SELECT job_id, call_id, attempt_number, coalesce(e, s), 2, 'failure', CASE WHEN verified THEN 'TimeoutError' ELSE 'DigestError' END, verified FROM m WHERE NOT success
  UNION ALL SELECT job_id, call_id, attempt_number, coalesce(e, s), 3, 'retry', NULL, NULL FROM m WHERE NOT success AND verified
  UNION ALL SELECT job_id, call_id, attempt_number, coalesce(e, s), 4, 'dead_lettered', NULL, NULL FROM m WHERE NOT success AND NOT verified AND attempt_number >= 3),
st AS (SELECT job_id, arg_max(kind, (a, at_us, phase, call_id)) AS kind, max(a) AS attempt, arg_max(retry, (a, at_us, phase, call_id)) FILTER (retry IS NOT NULL) AS retry, arg_max(err, (a, at_us, phase, call_id)) FILTER (err IS NOT NULL) AS err, min(at_us) FILTER (kind = 'queued') AS queued_us FROM ev GROUP BY 1),
js AS (SELECT job_id, CASE kind WHEN 'succeeded' THEN 'succeeded' WHEN 'dead_lettered' THEN 'failed' WHEN 'retry' THEN 'retrying' WHEN 'queued' THEN 'queued' ELSE 'running' END AS status, attempt, CASE WHEN kind IN ('dead_lettered', 'retry') THEN retry END AS retryable, CASE WHEN kind IN ('dead_lettered', 'retry') THEN err END AS error_type, queued_us FROM st)"""
_PK = "lower(trim({0}, E' \\t\\r\\n '))"
_I = f"i AS (SELECT bucket, object_key, {_PK.format('tier')} AS tier, size, {_PK.format('checksum')} AS checksum, updated_at, TRUE AS here FROM inventory QUALIFY row_number() OVER (PARTITION BY bucket, object_key ORDER BY updated_at DESC, {_PK.format('tier')} DESC NULLS LAST, size DESC NULLS LAST, {_PK.format('checksum')} DESC NULLS LAST) = 1)"
_S = f"s AS (SELECT bucket, object_key, {_PK.format('tier')} AS tier, size, {_PK.format('checksum')} AS checksum, seen_at, TRUE AS here FROM sightings QUALIFY row_number() OVER (PARTITION BY bucket, object_key ORDER BY seen_at DESC, {_PK.format('tier')} DESC NULLS LAST, size DESC NULLS LAST, {_PK.format('checksum')} DESC NULLS LAST) = 1)"
_C = "c AS (SELECT DISTINCT call_id, direction, cohort, attempt_number, size_bytes, success, epoch_us(started_at) AS at_us, hour(started_at) AS hour FROM movement WHERE started_at IS NOT NULL AND success IS NOT NULL)"

SQL = {
    "job_statuses": f"WITH {_EVENTS} SELECT job_id, status, attempt, retryable, error_type FROM js",
    "job_history_page": f"WITH {_EVENTS} SELECT * FROM js WHERE queued_us < 1750000000000000 OR (queued_us = 1750000000000000 AND job_id < 'job-5') ORDER BY queued_us DESC, job_id DESC LIMIT 50",
    "job_page": f"SELECT call_id, job_id, coalesce(terminal_state, 'open') AS state, epoch_us(started_at) AS at_us FROM {_M} WHERE coalesce(terminal_state, 'open') IN ('open', 'succeeded') AND starts_with(job_id, 'job-1') AND (epoch_us(started_at), call_id) > (1710000000000000, 'call-5') ORDER BY at_us, call_id LIMIT 100",
    "audit_query": f"SELECT call_id AS event_id, job_id, CASE WHEN attempt_number > 1 THEN 'move.retried' ELSE 'move.started' END AS event_type, CASE WHEN success THEN 'success' ELSE 'failure' END AS outcome, epoch_us(started_at) AS occurred_at FROM {_M} WHERE direction = 'cold-to-warm' AND epoch_us(started_at) >= 1704067200000000 AND epoch_us(started_at) < 1767225600000000 AND (epoch_us(started_at), call_id) < (1750000000000000, 'call-8') ORDER BY occurred_at DESC, event_id DESC LIMIT 100",
    "stale_runs": f"SELECT direction, count(*) AS stale FROM {_M} WHERE completed_at IS NULL AND epoch_us(started_at) + 86400000000 < (SELECT max(epoch_us(started_at)) FROM movement) GROUP BY 1",
    "scan_verdicts": f"SELECT CASE WHEN live THEN 'live' WHEN last THEN 'superseded' ELSE 'failed' END AS verdict, count(*) AS moves FROM (SELECT logical_move_id, bool_or(completed_at IS NULL) AS live, arg_max(success, (coalesce(epoch_us(started_at), -1), attempt_number, call_id)) AS last FROM {_M} GROUP BY 1) GROUP BY 1",
    "invalid_transitions": f"""WITH s AS (SELECT logical_move_id AS l, attempt_number AS a, call_id AS c, unnest(st) AS state, generate_subscripts(st, 1) AS k FROM (SELECT *, CASE WHEN NOT success THEN ['prepared', 'failed'] WHEN terminal_state IS NULL THEN ['prepared', 'transferred', 'verified'] ELSE ['prepared', 'transferred', 'verified', 'completed'] END AS st FROM {_M} WHERE logical_move_id IS NOT NULL)),
x AS (SELECT lag(state) OVER (PARTITION BY l ORDER BY a, c, k) AS from_state, state AS to_state FROM s)
SELECT from_state, to_state, count(*) AS changes FROM x WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN ({', '.join(f"('{a}', '{b}')" for a, after in NEXT.items() for b in after)}) GROUP BY 1, 2""",
    "move_sequence_faults": f"""WITH m AS (SELECT logical_move_id, attempt_number, min(call_id) AS c FROM {_M} GROUP BY 1, 2), x AS (SELECT *, lag(attempt_number) OVER w AS pa, lag(c) OVER w AS pc FROM m WINDOW w AS (PARTITION BY logical_move_id ORDER BY attempt_number)),
y AS (SELECT logical_move_id, attempt_number, unnest([CASE WHEN attempt_number <> coalesce(pa + 1, 1) THEN 'sequence_gap' END, CASE WHEN pa IS NOT NULL AND ('0x' || substr(md5(c), 1, 4))::INT % 13 = 0 THEN 'causation_mismatch' END]) AS fault FROM x) SELECT * FROM y WHERE fault IS NOT NULL""",
    "decision_labels": f"""WITH m AS (SELECT *, epoch_us(started_at) AS s, epoch_us(completed_at) AS e FROM {_M} WHERE started_at IS NOT NULL), x AS (SELECT logical_move_id, min(s) AS d, max(cohort) AS cohort FROM m GROUP BY 1), l AS (SELECT logical_move_id, arg_max(success, (e, attempt_number, call_id)) AS o FROM m JOIN x USING (logical_move_id) WHERE e < d + 30 * 86400000000 GROUP BY 1),
y AS (SELECT CASE WHEN cohort = 'nominal' THEN 'not_applicable' WHEN (SELECT max(s) FROM m) < d + 30 * 86400000000 THEN 'pending' WHEN o IS NOT NULL THEN 'observed' ELSE 'missing' END AS status, o FROM x LEFT JOIN l USING (logical_move_id))
SELECT status, CASE WHEN status = 'observed' THEN o END AS value, count(*) AS moves FROM y GROUP BY 1, 2""",
    "metrics_by_policy": f"WITH {_C}, g AS (SELECT sha256('{{\"implementation\":\"first-attempt\",\"name\":\"' || coalesce(cohort, '') || '\",\"version\":\"1\"}}') AS policy_sha256, success, attempt_number = 1 AND size_bytes <= 65536 AS g FROM (SELECT DISTINCT call_id, cohort, attempt_number, size_bytes, success, direction, at_us FROM c)), x AS (SELECT policy_sha256, count(*) FILTER (NOT success AND NOT g) AS tn, count(*) FILTER (NOT success AND g) AS fp, count(*) FILTER (success AND NOT g) AS fn, count(*) FILTER (success AND g) AS tp FROM g GROUP BY 1) SELECT *, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM x",
    "promotion_gates": f"""WITH {_C}, s AS (SELECT *, CASE WHEN at_us >= 1751328000000000 THEN 'test' WHEN at_us >= 1735689600000000 THEN CASE WHEN at_us + 86400000000 > 1751328000000000 THEN 'purged' ELSE 'validation' END ELSE 'other' END AS split, attempt_number = 1 AND size_bytes <= 65536 AS rule, attempt_number = 1 AS learned FROM c),
x AS (SELECT split, count(*) FILTER (success) AS p, count(*) FILTER (NOT success) AS n, count(*) FILTER (success AND rule) AS rtp, count(*) FILTER (NOT success AND NOT rule) AS rtn, count(*) FILTER (success AND learned) AS ltp, count(*) FILTER (NOT success AND NOT learned) AS ltn, coalesce(sum(size_bytes) FILTER (rule), 0) AS rb, coalesce(sum(size_bytes) FILTER (learned), 0) AS lb FROM s WHERE split IN ('validation', 'test') GROUP BY 1)
SELECT split, p >= 20 AND n >= 20 AS class_coverage, coalesce((ltp / p + ltn / n - rtp / p - rtn / n) / 2 >= 0.01, FALSE) AS balanced_accuracy_gain, ltp + ltn >= rtp + rtn AS accuracy_no_regression, lb <= rb AS movement_bytes_no_increase, TRUE AS allowed_tier_violations_zero FROM x""",
    "feature_matrix": """WITH i AS (SELECT bucket, object_key, arg_max(coalesce(size, -1), (updated_at, coalesce(size, -1))) AS size FROM inventory GROUP BY 1, 2), s AS (SELECT bucket, object_key, count(*) AS seen, epoch_us(max(seen_at)) AS last, count(*) FILTER (checksum IS NULL) AS unknown FROM (SELECT DISTINCT bucket, object_key, seen_at, checksum FROM sightings) GROUP BY 1, 2),
x AS (SELECT i.bucket, i.object_key, i.size, s.seen, s.unknown, ((SELECT max(epoch_us(seen_at)) FROM sightings) - s.last) / 1000000 AS age FROM i LEFT JOIN s ON i.bucket = s.bucket AND i.object_key = s.object_key)
SELECT bucket, object_key, round(ln(1 + greatest(size, 0)::DOUBLE), 6) AS log_size, coalesce(list_last(string_split(object_key, '.')) IN ('pdf', 'csv', 'xml', 'log', 'json'), FALSE)::DOUBLE AS type_known, coalesce(age <= 90 * 86400, FALSE)::DOUBLE AS fresh, coalesce(unknown > 0, FALSE)::DOUBLE AS partial, round(CASE WHEN age <= 90 * 86400 THEN ln(1 + seen::DOUBLE) ELSE 0 END, 6) AS log_seen, coalesce(age <= 90 * 86400, FALSE)::DOUBLE AS age_known, round(CASE WHEN age <= 90 * 86400 THEN ln(1 + age) ELSE 0 END, 6) AS log_age FROM x""",
    "exact_stump": f"""WITH {_C}, v AS (SELECT f AS feature, v::DOUBLE AS v, sum(success::INT) AS p, sum(1 - success::INT) AS n FROM (SELECT 0 AS f, attempt_number AS v, success FROM c UNION ALL SELECT 1, size_bytes, success FROM c UNION ALL SELECT 2, hour, success FROM c) GROUP BY 1, 2),
r AS (SELECT feature, v, (sum(p) OVER w)::HUGEINT AS lp, (sum(n) OVER w)::HUGEINT AS ln, (sum(p) OVER (PARTITION BY feature))::HUGEINT AS tp, (sum(n) OVER (PARTITION BY feature))::HUGEINT AS tn, lead(v) OVER w AS nv FROM v WINDOW w AS (PARTITION BY feature ORDER BY v)),
g AS (SELECT *, ((lp * tn - ln * tp) * (lp * tn - ln * tp) * 1000000000) // ((lp * tn + ln * tp) * (2 * tp * tn - lp * tn - ln * tp)) AS gain FROM r WHERE nv IS NOT NULL AND lp + ln >= 2 AND tp + tn - lp - ln >= 2)
SELECT feature::INT AS feature, v / 2 + nv / 2 AS threshold, lp::BIGINT AS left_positive, ln::BIGINT AS left_negative, (tp - lp)::BIGINT AS right_positive, (tn - ln)::BIGINT AS right_negative FROM g ORDER BY gain DESC, feature, v LIMIT 1""",
    "reference_transitions": """WITH o AS (SELECT DISTINCT object_id, manifest_id, coalesce(epoch_us(updated_at::TIMESTAMPTZ), -1) AS t FROM object_contents), x AS (SELECT manifest_id AS new, lag(manifest_id) OVER w AS old, row_number() OVER w AS k FROM o WINDOW w AS (PARTITION BY object_id ORDER BY t, coalesce(manifest_id, ''))),
e AS (SELECT manifest_id, sum(d) AS d FROM (SELECT old AS manifest_id, -1 AS d FROM x WHERE k > 1 UNION ALL SELECT new, 1 FROM x WHERE k > 1) WHERE manifest_id IS NOT NULL GROUP BY 1 HAVING sum(d) <> 0),
b AS (SELECT DISTINCT manifest_id, content_sha256 AS sha256, -1 AS k FROM content_manifests UNION ALL SELECT DISTINCT manifest_id, chunk_sha256, chunk_index FROM content_manifest_chunks)
SELECT sha256, sum(d)::BIGINT AS delta FROM b JOIN e USING (manifest_id) WHERE sha256 IS NOT NULL GROUP BY 1 HAVING sum(d) <> 0""",
    "consistency_findings": f"""WITH {_I}, {_S}, n AS (SELECT bucket, object_key, count(DISTINCT {_PK.format('tier')}) AS tiers FROM sightings GROUP BY 1, 2),
x AS (SELECT coalesce(i.bucket, s.bucket) AS bucket, i.here AS ih, s.here AS sh, n.tiers, i.tier AS it, s.tier AS t2, i.size AS iz, s.size AS sz, i.checksum AS ic, s.checksum AS sc, seen_at < updated_at AS stale FROM i FULL JOIN s ON i.bucket = s.bucket AND i.object_key = s.object_key LEFT JOIN n ON n.bucket = s.bucket AND n.object_key = s.object_key),
f AS (SELECT bucket, unnest([CASE WHEN sh IS NULL THEN 'storage_missing' END, CASE WHEN ih IS NULL THEN 'catalog_missing' END, CASE WHEN tiers > 1 THEN 'several_tiers' END, CASE WHEN it <> t2 THEN 'tier_mismatch' END, CASE WHEN iz <> sz THEN 'size_mismatch' END, CASE WHEN ic <> sc THEN 'checksum_mismatch' END, CASE WHEN ih AND sh AND it IS NULL THEN 'catalog_tier_unknown' END, CASE WHEN ih AND sh AND t2 IS NULL THEN 'storage_tier_unknown' END, CASE WHEN ih AND sh AND iz IS NULL THEN 'catalog_size_unknown' END, CASE WHEN ih AND sh AND sz IS NULL THEN 'storage_size_unknown' END, CASE WHEN ih AND sh AND ic IS NULL THEN 'catalog_checksum_unknown' END, CASE WHEN ih AND sh AND sc IS NULL THEN 'storage_checksum_unknown' END, CASE WHEN stale THEN 'sighting_stale' END]) AS reason FROM x)
SELECT bucket, reason, CASE WHEN reason IN ('catalog_missing', 'several_tiers') THEN 'warning' WHEN reason LIKE '%mismatch' OR reason = 'storage_missing' THEN 'critical' ELSE 'info' END AS severity, count(*) AS keys FROM f WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
    "simulation_deltas": f"""WITH {_I}, {_S}, b AS (SELECT coalesce(i.size, 0) AS z, coalesce(i.tier, 'unknown') AS a, coalesce(s.tier, 'unknown') AS b FROM i JOIN s ON i.bucket = s.bucket AND i.object_key = s.object_key), t AS (SELECT a AS tier, 1 AS bo, z AS bb, 0 AS po, 0 AS pb FROM b UNION ALL SELECT b, 0, 0, 1, z FROM b)
SELECT tier, sum(bo)::BIGINT AS baseline_objects, sum(bb)::BIGINT AS baseline_bytes, sum(po)::BIGINT AS proposed_objects, sum(pb)::BIGINT AS proposed_bytes, (sum(po) - sum(bo))::BIGINT AS delta_objects, (sum(pb) - sum(bb))::BIGINT AS delta_bytes FROM t GROUP BY 1""",
    "passage_star": "WITH per AS (SELECT bucket, sum(n)::BIGINT AS passages, count(*) AS documents, count(DISTINCT tier) AS tiers FROM (SELECT document_id, count(*) AS n FROM (SELECT DISTINCT passage_id, document_id FROM embedding_passages) GROUP BY 1) JOIN (SELECT DISTINCT id, bucket, tier FROM golden) ON document_id = id GROUP BY 1) SELECT per.bucket, passages, documents, tiers, i.n AS catalogued, s.n AS seen, coalesce(h.n, 0) AS holds, coalesce(c.n, 0) AS corpus_passages FROM per JOIN (SELECT bucket, count(*) AS n FROM (SELECT DISTINCT bucket, object_key FROM inventory) GROUP BY 1) i USING (bucket) JOIN (SELECT bucket, count(*) AS n FROM (SELECT DISTINCT bucket, object_key FROM sightings) GROUP BY 1) s USING (bucket) LEFT JOIN (SELECT bucket, count(*) AS n FROM (SELECT DISTINCT bucket, hold_id FROM legal_holds) GROUP BY 1) h USING (bucket) LEFT JOIN (SELECT bucket, count(*) AS n FROM (SELECT DISTINCT bucket, passage_id FROM corpus) GROUP BY 1) c USING (bucket)",
    "retry_delays": f"SELECT call_id, round(least(60.0::DOUBLE, 2.0::DOUBLE * 2 ** (attempt_number - 1)) * (1 + 0.1::DOUBLE * (2 * (('0x' || substr(sha256(call_id), 1, 8))::BIGINT::DOUBLE / 4294967296) - 1)), 6) AS wait_s FROM {_M} WHERE NOT success",
    "idempotency_keys": f"WITH {_I}, {_S} SELECT i.bucket, i.object_key, sha256(concat_ws(chr(31), 'move-v1', i.bucket, i.object_key, i.tier, s.tier)) AS idempotency_key FROM i JOIN s ON i.bucket = s.bucket AND i.object_key = s.object_key WHERE i.tier <> s.tier",
    "absent_series": "SELECT cohort, metric, max(epoch_us(observed_at)) AS last_us FROM samples WHERE cohort IS NOT NULL AND observed_at IS NOT NULL GROUP BY 1, 2 HAVING (SELECT max(epoch_us(observed_at)) FROM samples WHERE cohort IS NOT NULL) - max(epoch_us(observed_at)) > 864000000000",
    "hold_expiries": "SELECT hold_id, t AS at_us, CASE WHEN substr(md5(hold_id), 1, 1) = '0' THEN NULL ELSE t + 90 * 86400000000 END AS ends_us, coalesce(substr(md5(hold_id), 1, 1) <> '0' AND t + 90 * 86400000000 <= 1767225600000000, FALSE) AS over FROM (SELECT DISTINCT hold_id, created_at, epoch_us(created_at::TIMESTAMPTZ) AS t FROM legal_holds)",
    "canonical_digests": """SELECT person_id, sha256('{"family_name":"' || family_name || '","given_name":"' || given_name || '","person_id":' || person_id || ',"team":"' || team || '"}') AS sha256 FROM staff_directory""",
}
SQL["reference_totals"] = f"""WITH bad AS (SELECT sha256, bool_or(contains(issues, 'count_mismatch')) AS wrong, max(expected) AS expected FROM ({__import__('lodestone.plans.catalog', fromlist=['SQL']).SQL['reference_reconcile']}) GROUP BY 1),
x AS (SELECT b.*, coalesce(wrong, FALSE) AS wrong, coalesce(expected, reference_count) = 0 AND epoch_us(unreferenced_at::TIMESTAMPTZ) <= 1767225600000000 - 30 * 86400000000 AS free FROM (SELECT DISTINCT sha256, size, reference_count, unreferenced_at FROM content_blobs) b LEFT JOIN bad USING (sha256))
SELECT count(*) AS blobs, sum(size)::BIGINT AS bytes, count(*) FILTER (wrong) AS wrong_counts, count(*) FILTER (free) AS reclaimable, coalesce(sum(size) FILTER (free), 0)::BIGINT AS reclaimable_bytes FROM x"""
