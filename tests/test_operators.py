"""Operators against plain Python on small and awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import keys
from lodestone.operators import access, catalog, content, learn, ledger, retrieval, skew


def test_keys_and_instants(spark):
    df = spark.createDataFrame([(" AbC ", "2024-01-13T04:22:55.127835-05:30"), (None, "2024-03-19 04:58:34Z"), ("", "never")], "k string, t string")
    got = df.select(keys.plain_key(F.col("k")).alias("k"), keys.canonical_instant(F.col("t")).alias("t"), keys.instant_us(F.col("t")).alias("us")).collect()
    assert [x.k for x in got] == ["abc", None, ""]
    assert [x.t for x in got] == ["2024-01-13T09:52:55.127835Z", "2024-03-19T04:58:34.000000Z", None]
    assert got[2].us is None and got[1].us == 1710824314000000


def test_uuid5_is_the_standard_one(spark):
    names = ["", "a", "größe", "x" * 200]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [x.u for x in df.select(keys.uuid5(str(uuid.NAMESPACE_DNS), F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_a_join(spark, how):
    r = random.Random(1)
    big = [(r.choice(["hot", "a", "b", None]), i) for i in range(500)]
    b, u = spark.createDataFrame(big, "k string, i long"), spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, v long")
    hot = skew.hot_keys(b.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", most=2, hot_rows=1)
    got = [(x.i, x.v) for x in skew.salted_join(b, u, ["k"], hot, how).collect()]
    table = {"hot": 1, "a": 2}
    assert len(got) == len(set(got)) and set(got) == {(i, table.get(k)) for k, i in big if how == "left" or k in table}


def test_pages_cursors_and_patterns(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "a"), ("b", "%"), ("b", "ab")], "k string, o string")
    assert [tuple(x) for x in catalog.keyset_page(df, ["k", "o"], ("a", "x"), 3).collect()] == [("a", "y"), ("b", "%"), ("b", "a")]
    assert [x.o for x in catalog.prefix_scan(df, "o", "%").collect()] == ["%"]
    c = catalog.cursor("objects", {"bucket": "b"}, ["b", "a"])
    assert catalog.cursor_key(c, "objects", {"bucket": "b"}) == ["b", "a"]
    for wrong in (("jobs", {"bucket": "b"}), ("objects", {})):
        with pytest.raises(ValueError):
            catalog.cursor_key(c, *wrong)
    with pytest.raises(ValueError):
        catalog.cursor_key("!!", "objects", {})
    p = catalog.path_pattern("a.*.c.**")
    assert re.match(p, "a.b.c.d") and re.match(p, "a.b.c.d.e") and not re.match(p, "a.c.d") and not re.match(p, "a.b.c")


def test_prefix_join_is_the_theta_join(spark):
    objects = [("b1", k) for k in ["", "q1/", "q1/a", "q2", "größe/x", "%"]] + [("b2", "q1/a")]
    scopes = [(1, "b1", "q1/"), (2, None, "q"), (3, None, None), (4, "b2", ""), (5, "b1", "größe"), (6, "b1", "q1/a/long"), (7, None, "%")]
    o, s = spark.createDataFrame(objects, "bucket string, object_key string"), spark.createDataFrame(scopes, "id long, scope_bucket string, scope_prefix string")
    got = sorted((x.bucket, x.object_key, x.id) for x in catalog.prefix_join(o, s).collect())
    assert got == sorted((b, k, i) for b, k in objects for i, sb, sp in scopes if (sb is None or sb == b) and k.startswith(sp or ""))
    assert catalog.prefix_join(o, s.limit(0)).collect() == []


def test_extents_across_blocks(spark):
    rows = [("m", i, i * 10, 10) for i in range(3000)] + [("hole", 0, 0, 5), ("hole", 2, 5, 5), ("off", 0, 1, 4), ("off", 1, 5, 1)]
    df = spark.createDataFrame(rows + rows[:9], "manifest_id string, chunk_index long, byte_offset long, byte_length long")
    got = {x.manifest_id: (x.chunks, x.breaks) for x in catalog.contiguous_extents(df).collect()}
    assert got == {"m": (3000, 0), "hole": (2, 1), "off": (2, 2)}


def test_chunks_passages_and_grounding(spark):
    data = [("e", ""), ("s", "abc"), ("x", "a" * 512), ("u", "größe👍" * 100), ("n", None)]
    df = spark.createDataFrame(data, "id string, text string")
    got = sorted((x.id, x.chunk_index, x.byte_length, x.sha256) for x in content.chunks(df.withColumn("b", F.encode("text", "UTF-8")), "id", "b", 256).collect())
    want = []
    for i, t in data:
        raw = (t or "").encode()
        want += [(i, k // 256, len(raw[k : k + 256]), hashlib.sha256(raw[k : k + 256]).hexdigest()) for k in range(0, len(raw), 256)]
    assert got == sorted(want)
    spans = {}
    for x in content.fixed_passages(df, "id", "text", 100, 10).collect():
        spans.setdefault(x.id, []).append((x.passage_index, x.start_codepoint, x.end_codepoint))
    assert set(spans) == {"s", "x", "u"} and sorted(spans["s"]) == [(0, 0, 3)]
    for i, s in spans.items():
        s.sort()
        assert s[-1][2] == len(dict(data)[i]) and all(b[1] == a[2] - 10 for a, b in zip(s, s[1:]))


def test_word_passages_end_at_blanks():
    text = ("word " * 300 + "\n\n" + "line\n" * 200) * 2 + "x" * 3000
    spans = content.word_passages_of(text, 300, 30)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(e - s <= 300 for s, e in spans)
    assert all(e == len(text) or text[e].isspace() or "x" * 200 in text[s:e] for s, e in spans)
    assert content.word_passages_of("") == [] and content.word_passages_of("   ") == []


def test_text_operators(spark):
    raw = "a\r\nb\tc  d\x07 \n\n\n\n é "
    df = spark.createDataFrame([(raw,), (None,), ("",)], "t string")
    got = [x.t for x in df.select(content.tidy(content.composed(F.col("t"))).alias("t")).collect()]
    assert got == ["a\nb c d\n\né", None, ""]
    r = spark.createDataFrame([("see https://u:pw@h.test/p?token=abc&x=1 and Bearer ab.cd password: hunter2, ok",)], "t string").select(content.redact_secrets(F.col("t")).alias("t")).collect()[0].t
    assert r == "see https://[REDACTED]@h.test/p?token=[REDACTED]&x=1 and Bearer [REDACTED] password: [REDACTED], ok"
    f = spark.createDataFrame([("1", "a@b.test, x 123-45-6789 000-12-3456 912-12-1234 123-00-1234 1123-45-6789"), ("2", "user@ @home"), ("3", None)], "id string, t string")
    assert sorted(tuple(x) for x in content.pattern_findings(f, "id", "t").collect()) == [("1", "email", 1), ("1", "us_ssn", 1)]


def test_bm25_and_fusion_by_hand(spark):
    docs = [("a", "cold mail archive"), ("b", "mail mail invoice"), ("c", None), ("d", "nothing here")]
    d, q = spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame([(0, "Mail archive"), (1, "absent")], "query_id long, query string")
    got = {x.id: x.score for x in retrieval.bm25(d, "id", "text", q).collect()}
    mean = 8 / 4
    idf = lambda n: math.log(1 + (4 - n + 0.5) / (n + 0.5))
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert set(got) == {"a", "b"} and abs(got["a"] - idf(2) * part(1, 3) - idf(1) * part(1, 3)) < 1e-9 and abs(got["b"] - idf(2) * part(2, 3)) < 1e-9
    s = spark.createDataFrame([(0, "a", "k", 1), (0, "b", "k", 2), (0, "b", "m", 1)], "query_id long, id string, signal string, rank int")
    f = {x.id: (round(x.score, 9), x.signals) for x in retrieval.fuse(s, {"m": 0.5}).collect()}
    assert f == {"a": (round(1 / 61, 9), "k"), "b": (round(1 / 62 + 0.5 / 61, 9), "k,m")}


def test_knn_is_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    g = np.random.default_rng(0)
    x = g.normal(size=(60, 8)).round(3)
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(100, None), (101, [0.0] * 8)] + [(102, [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in retrieval.exact_knn(df, df.where("id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    known = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and np.linalg.norm(v)]
    for i, v in known:
        if i % 10 == 0:
            best = [j for _, j in sorted((round(1 - float(v @ w), 12), j) for j, w in known)[:5]]
            assert [j for _, j in sorted(got[i])] == best
    assert 100 not in got and retrieval.exact_knn(df, df.limit(0), 5).collect() == []


def test_index_recall(spark):
    g = np.random.default_rng(1)
    centres = g.normal(size=(12, 16))
    x = centres[g.integers(0, 12, 800)] + 0.3 * g.normal(size=(800, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(800)], "id long, vector array<double>")
    q = df.where("id % 100 = 0")
    got = {(r.query_id, r.id) for r in retrieval.cell_knn(df, q, 10, retrieval.fit_cells(df, 12), 4).collect()}
    exact = {(r.query_id, r.id) for r in retrieval.exact_knn(df, q, 10).collect()}
    assert len(got & exact) / len(exact) >= 0.9


def test_concurrency_gaps_overlap_and_sustained(spark):
    r = random.Random(8)
    spans = [(r.choice("ab"), s := r.randint(0, 90), s + r.randint(-1, 20) if r.random() < 0.95 else None) for _ in range(80)]
    df = spark.createDataFrame(spans, "entity string, start_us long, end_us long")
    for block in (5, 1000):
        got = {x.entity: x.peak for x in access.peak_concurrency(df, block).collect()}
        kept = [(e, s, math.inf if t is None else t) for e, s, t in spans if t is None or t > s]
        assert got == {k: max(sum(1 for e, s, t in kept if e == k and s <= at < t) for _, at, _ in kept) for k in "ab"}
    times = spark.createDataFrame([("k", t) for t in (0, 5, 5, 30, 31, 100, None)] + [("one", 7)], "k string, t long")
    for block in (3, 10_000):
        assert {tuple(x) for x in access.gaps_over(times, ["k"], "t", block).collect()} == {("k", 6, 5, 69), ("one", 1, 1, 0)}
    left = spark.createDataFrame([(i, a, b) for i, (_, a, b) in enumerate(spans) if b is not None], "i long, l_start long, l_end long")
    right = spark.createDataFrame([(j, j * 7, j * 7 + 12) for j in range(12)], "j long, r_start long, r_end long")
    got = sorted((x.i, x.j) for x in access.overlap_join(left, right, 10).collect())
    assert got == sorted((i, j) for i, (_, a, b) in enumerate(spans) if b is not None and b > a for j in range(12) if a < j * 7 + 12 and j * 7 < b)
    s = spark.createDataFrame([("k", t, v) for t, v in ((0, 1), (10, 1), (20, 0), (30, 1), (45, 1), (200, 1), (201, 1), (210, 1))], "k string, t long, v int")
    assert sorted(tuple(x) for x in access.sustained(s, ["k"], "t", F.col("v") == 1, 10, 60).collect()) == [("k", 0, 10, 2), ("k", 30, 45, 2), ("k", 200, 210, 3)]


def test_learning(spark):
    rows = [(True, True)] * 3 + [(True, False)] * 2 + [(False, False)] * 4 + [(False, True)]
    m = learn.confusion(spark.createDataFrame(rows, "t boolean, g boolean"), [], "t", "g").collect()[0]
    assert (m.tp, m.fn, m.tn, m.fp, m.accuracy, m.recall) == (3, 2, 4, 1, 0.7, 0.6)
    data = [(float(i), 3.0, i >= 7) for i in range(10)]
    for k in range(3):
        random.Random(k).shuffle(data)
        b = learn.best_stump(spark.createDataFrame(data, "x double, c double, y boolean"), ["c", "x"], "y").collect()[0]
        assert (b.feature, b.threshold, b.impurity) == (1, 6.0, 0.0)
    assert learn.best_stump(spark.createDataFrame([(1.0, True)], "x double, y boolean"), ["x"], "y").collect() == []


def test_chains_and_ancestry(spark):
    entries, before = [], ledger.GENESIS
    for i in range(1, 30):
        h = hashlib.sha256(f"{before}:{hashlib.sha256(f'p{i}'.encode()).hexdigest()}".encode()).hexdigest()
        entries.append((i, before, h, f"p{i}"))
        before = h
    schema = "sequence long, previous_hash string, entry_hash string, payload string"
    for block in (4, 1000):
        assert ledger.chain_faults(spark.createDataFrame(entries, schema), block).collect() == []
        bad = [e for e in entries if e[0] != 9]
        bad[3] = (*bad[3][:3], "edited")
        assert {tuple(x) for x in ledger.chain_faults(spark.createDataFrame(bad, schema), block).collect()} == {(4, "edited"), (10, "gap"), (10, "broken_link")}
    edges = [("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("lost", "nowhere"), ("x", "y"), ("y", "x"), ("z", "x")] + [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    got = {x.node: (x.root, x.depth) for x in ledger.ancestry(spark.createDataFrame(edges, "node string, parent string")).collect()}
    assert got["c"] == ("r", 3) and got["n39"] == ("n0", 39) and all(got[k] == (None, None) for k in ("lost", "x", "y", "z"))


def test_hooks_and_unknowns(spark):
    from lodestone.functions import hooks

    df = spark.createDataFrame([(1, "12"), (2, "x"), (3, "345")], "id long, t string")
    assert sorted((x.id, x.n) for x in hooks.apply(df, "tests.hook_samples:lengths", "t", "n", "long").collect()) == [(1, 2), (2, 1), (3, 3)]
    got = {x.id: (x.n, x.n_error) for x in hooks.apply(df, "tests.hook_samples:numbers", "t", "n", "long", keep_errors=True).collect()}
    assert got == {1: (12, None), 2: (None, "ValueError"), 3: (345, None)}
    assert [x.id for x in hooks.pending(df, df.where("id < 3"), ["id"]).collect()] == [3]
    b = spark.createDataFrame([(1,), (3,), (5000,)], "a int").select(hooks.backoff_seconds(F.col("a"), 0.5, 60.0).alias("s")).collect()
    assert [x.s for x in b] == [0.5, 2.0, 60.0]
    s = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int").groupBy("k").agg(hooks.sum_or_null(F.col("v")).alias("s")).collect()
    assert {x.k: x.s for x in s} == {"a": None, "b": 2}
