"""Queries that do the whole job where an older one, bound to its SQL, does a part."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import content, ledger, retrieval


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_chunk_digests_of_all_documents(spark, tmp_path):
    texts = ["é" * 300, "é" * 300, "a" * 256 + "ü", "a" * 256 + "ö", "x" + "é" * 128, "", None]
    put(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    data = [t.encode() for t in texts if t]
    want = Counter(hashlib.sha256(b[k : k + 256]).hexdigest() for b in data for k in range(0, len(b), 256))
    got = {r.sha256: r.n for r in entry.queries()["chunk_digests_all"](spark, str(tmp_path)).collect()}
    assert got == {h: n for h, n in want.items() if n > 1}
    assert len(got) == 3


def test_chain_faults_of_real_payloads(spark, tmp_path):
    rows = [(i, 7, "click", float(i), "{}") for i in range(1000)] + [(i, 8, "view", None, None) for i in range(1000, 1010)]
    put(spark, tmp_path, "events", rows, "event_id long, user_id long, event_type string, value double, props string")
    events = spark.read.parquet(f"{tmp_path}/events.parquet").withColumn("ts", F.timestamp_seconds("event_id"))
    events.write.parquet(f"{tmp_path}/more/events.parquet")
    got = {r.fault: r.entries for r in entry.queries()["hash_chain_faults"](spark, f"{tmp_path}/more").collect()}
    left = [i for i, *_ in rows if i % 103 != 1]
    edited = sum((2 if i % 107 == 2 else 1) for i in left if i % 101 == 0)
    repeated = sum(i % 107 == 2 for i in left)
    gaps = sum(i % 103 == 1 for i, *_ in rows)
    assert got == {"edited": edited, "repeated": repeated, "gap": gaps, "broken_link": gaps + repeated}


def test_ledger_against_events_and_tombstones(spark):
    entries = [(1, "event", "fine", "a"), (2, "event", "lost", "a"), (3, "event", "edited", "a"), (4, "event", "kept out", "a"), (5, "retention", "kept out", "t"), (6, "event", "back", "a"), (7, "retention", "back", "t"), (8, "event", "bare", "a"), (9, "retention", "bare", "t"), (10, "baseline_tombstone", "old", "t"), (11, "retention", "unborn", "t"), (12, "event", "twice", "a"), (13, "event", "twice", "a")]
    events = [("fine", "a"), ("edited", "b"), ("back", "a"), ("stray", "a"), ("twice", "a")]
    tombstones = [("kept out", "t"), ("back", "t"), ("old", "x"), ("unborn", "t"), ("loose", "t")]
    got = ledger.reconcile(spark.createDataFrame(entries, "sequence long, kind string, event_id string, payload_digest string"), *[spark.createDataFrame(x, "event_id string, digest string") for x in (events, tombstones)])
    assert sorted(map(tuple, got.collect())) == [
        ("back", "retained_event_reappeared"),
        ("bare", "missing_tombstone"),
        ("edited", "event_digest_mismatch"),
        ("loose", "untracked_tombstone"),
        ("lost", "missing_event"),
        ("old", "tombstone_digest_mismatch"),
        ("stray", "untracked_event"),
        ("twice", "duplicate_event"),
        ("unborn", "invalid_retention"),
    ]


def test_attempts_whose_times_fall_or_end_disagrees(spark, tmp_path):
    rows = [("ok", 1, 1, 2, False, None), ("ok", 2, 3, 4, True, "succeeded"), ("falls", 1, 5, 6, False, None), ("falls", 2, None, None, False, None), ("falls", 3, 4, 7, True, "succeeded"), ("ends", 1, 1, 9, False, None), ("ends", 2, 2, 8, True, "succeeded"), ("state", 1, 1, 2, True, None), ("state2", 1, 1, 2, False, "succeeded"), ("before", 1, 1, 2, False, "failed"), ("before", 2, 2, 3, True, "succeeded")]
    schema = "logical_move_id string, attempt_number int, s int, e int, success boolean, terminal_state string"
    m = spark.createDataFrame(rows, schema).select(F.concat("logical_move_id", "attempt_number").alias("call_id"), "*", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("e").alias("completed_at"))
    m.write.parquet(f"{tmp_path}/movement.parquet")
    got = {r.logical_move_id: {k for k, v in r.asDict().items() if v is True} for r in entry.queries()["attempt_chain_faults"](spark, str(tmp_path)).collect()}
    assert got == {"falls": {"start_falls"}, "ends": {"end_falls"}, "state": {"wrong_end"}, "state2": {"wrong_end"}, "before": {"wrong_end"}}


def hashed(text, d=64):
    """H10 word for word."""
    t = re.findall(r"[\w]+", unicodedata.normalize("NFC", text or "").casefold())
    v = [0.0] * d
    for f in ["__bias__", *t, *[f"{a}\x1f{b}" for a, b in zip(t, t[1:])]]:
        h = hashlib.sha256(f.encode()).digest()
        v[int.from_bytes(h[:8], "big") % d] += 1.0 if h[8] & 1 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else [1.0] + v[1:]


CORPUS = "passage_id string, bucket string, object_key string, tier string, mime string, metadata map<string,string>, text string"


def test_feature_hash_of_every_text(spark, tmp_path):
    texts = ["tape cold", "cold tape", "", None, "?!", "x" * 60, "Straße E\u0301", "strasse é", "cold_tape"]
    put(spark, tmp_path, "corpus", [(str(i), "b", "k", "t", "m", {}, t) for i, t in enumerate(texts)], CORPUS)
    got = {}
    for r in entry.queries()["feature_hash_vectors"](spark, str(tmp_path)).collect():
        got.setdefault(int(r.passage_id), {})[r.bucket] = r.value
    assert got == {i: {b: round(x, 6) for b, x in enumerate(hashed(t)) if x} for i, t in enumerate(texts)}
    assert got[0] != got[1] and got[2] == got[3] == got[4] and got[6] == got[7]
    cancels = next(w for w in map(str, range(99)) if retrieval._placed(w)[1] != retrieval._placed("__bias__")[1])
    assert list(retrieval.feature_vector(cancels, 1)) == [1.0]


def test_keyword_over_three_fields(spark):
    docs = [("a", "sealed mail", "x/y", None), ("b", "other words here", "sealed/mail.txt", "mail"), ("c", None, "z", "archives archives"), ("d", "", "q", "")]
    q = spark.createDataFrame([(0, "sealed mail archives archives")], "query_id long, query string")
    got = {r.id: r.score for r in retrieval.bm25_fields(spark.createDataFrame(docs, "id string, text string, key string, meta string"), "id", {"text": 2.0, "key": 1.5, "meta": 1.0}, q).collect()}
    cut = [[re.findall(r"[a-z]+", t or "") for t in d[1:]] for d in docs]

    def score(doc, word):
        out = 0.0
        for f, boost in enumerate((2.0, 1.5, 1.0)):
            df, mean, tf = sum(word in c[f] for c in cut), sum(len(c[f]) for c in cut) / 4, cut[doc][f].count(word)
            if tf:
                out = max(out, boost * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(cut[doc][f]) / mean)))
        return out

    want = {d[0]: sum(score(i, w) for w in "sealed mail archives archives".split()) for i, d in enumerate(docs)}
    assert got.keys() == {"a", "b", "c"} and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_fusion_of_all_ranks_and_signals(spark, tmp_path):
    rows = [(f"p{i:03}", "b", f"k{i:03}", "t", "m", {"topic": "sealed mail"}, "nothing") for i in range(80)] + [("q", "b", "q", "t", "m", {"topic": "archives"}, "sealed mail archives"), ("q2", "b", "q", "t", "m", {"topic": "archives"}, "else")]
    put(spark, tmp_path, "corpus", rows, CORPUS)
    got = [r for r in entry.queries()["rrf_all_signals"](spark, str(tmp_path)).collect() if r.query_id == 0]
    assert sorted(r["rank"] for r in got) == list(range(1, 11))
    low = next(r for r in got if r.object_key == "q")  # last of 81 by metadata, first by the others
    assert (low.object_key, low.signals, low.score) == ("q", "keyword,metadata,vector", round(1 / 61 + 0.5 / (60 + 81) + 1 / 61, 9))


def test_every_kind_of_secret_is_redacted(spark):
    cases = {
        "a -----BEGIN RSA PRIVATE KEY-----\nMII\n-----END RSA PRIVATE KEY----- b": "a [REDACTED] b",
        "Cookie: sid=abc; theme=x\nnext": "Cookie: [REDACTED]\nnext",
        "Set-Cookie: sid=abc": "Set-Cookie: [REDACTED]",
        "Authorization: Digest abc": "Authorization: [REDACTED]",
        "run --password x --verbose y": "run --password [REDACTED] --verbose y",
        "run --api-key=x -p x": "run --api-key=[REDACTED] -p [REDACTED]",
        '{"password": "x y", "name": "z"}': '{"password": "[REDACTED]", "name": "z"}',
        "clientSecret=x, awsSecretAccessKey: y": "clientSecret=[REDACTED], awsSecretAccessKey: [REDACTED]",
        "a=token=abc": "a=token=[REDACTED]",
        "max_tokens=5 token_count: 3 idempotency_key=k": "max_tokens=5 token_count: 3 idempotency_key=k",
        "ftp://user@h/?sig=1;code=2&page=3": "ftp://[REDACTED]@h/?sig=[REDACTED];code=[REDACTED]&page=3",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string")
    assert [(r.got, r.want) for r in df.select(content.redact_secrets(F.col("t")).alias("got"), "want").collect() if r.got != r.want] == []
