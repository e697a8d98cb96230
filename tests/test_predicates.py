"""Filters, orders over blocks, exact splits and limits that are none any more, against plain Python."""

from __future__ import annotations

import json
import random
import unicodedata
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog, learn, ledger, order, retrieval
from lodestone.operators import predicates as p
from lodestone.sources import sinks


def test_json_scalars_are_compared_with_their_types(spark):
    values = [True, False, 1, 0, 1.0, 1.5, "1", "true", None, "é", 10**15]
    texts = [json.dumps({"a": {"b": v}}) for v in values] + ["no json", "{}", None, '{"a": [1]}', '{"a": {"b": {}}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for v in values:
        got = {r.i for r in df.where(p.json_scalar_equals(F.col("t"), "$.a.b", v)).collect()}
        assert got == {i for i, w in enumerate(values) if type(w) is type(v) and w == v}, v


def test_escapes_that_name_no_character(spark):
    rows = [(r'"a\u0000"', False), (r'"\ud83d"', False), (r'"\ude00"', False), (r'"😀"', True), (r'"\\u0000"', True), (r'"\\\u0000"', False), ('"plain"', True), (None, False), (r'"\ud83d😀"', False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert [r.t for r in df.select("t", "want", p.is_text(F.col("t")).alias("got")).collect() if r.got != r.want] == []


OBJECT = "bucket string, key string, tier string, mime string, size long, content_sha256 string, object_metadata map<string,string>, document_metadata struct<language:string>"


def test_object_filters_are_conjunctions(spark):
    r = random.Random(3)
    pick = lambda *v: r.choice([*v, None])
    rows = [(pick("a", "b"), pick("x/1", "y/2", "x%"), pick("hot", "cold"), pick("m", "n"), pick(1, 2), pick("f" * 64, "F" * 64), pick({"k": "v"}, {"k": "w", "l": "v"}, {}), pick(("en",), ("de",))) for _ in range(300)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, " + OBJECT)
    asked = {"bucket": "a", "key_prefix": "x", "tier": "hot", "mime": "m", "size": 1, "content_sha256": "f" * 64, "object_metadata": {"k": "v"}, "document_metadata": {"language": "en"}}
    tests = [lambda x: x[0] == "a", lambda x: (x[1] or "").startswith("x"), lambda x: x[2] == "hot", lambda x: x[3] == "m", lambda x: x[4] == 1, lambda x: x[5] == "f" * 64, lambda x: (x[6] or {}).get("k") == "v", lambda x: x[7] is not None and x[7][0] == "en"]
    for chosen in [range(8), *[[k] for k in range(8)], [], [0, 2, 7], [1, 6]]:
        parts = {k: v for i, (k, v) in enumerate(asked.items()) if i in chosen}
        assert {x.i for x in df.where(p.objects(**parts)).collect()} == {i for i, x in enumerate(rows) if all(tests[k](x) for k in chosen)}
    keep = p.vectors(buckets=["a"], keys=["x/1", "y/2"], key_prefix="x", tiers=["hot", "cold"], mimes=["m"], metadata={"k": "v"}, names={"metadata": "object_metadata"})
    assert {x.i for x in df.where(keep).collect()} == {i for i, x in enumerate(rows) if x[0] == "a" and x[1] == "x/1" and x[2] and x[3] == "m" and (x[6] or {}).get("k") == "v"}
    assert df.where(p.vectors(buckets=[])).count() == 0 and df.where(p.vectors()).count() == 300


def test_event_filters(spark):
    rows = [(i, t, k, o) for i, (t, k, o) in enumerate([(5, "a", "ok"), (5, "b", "bad"), (7, "a", None), (9, "c", "ok"), (None, "a", "ok")])]
    df = spark.createDataFrame(rows, "event_id int, occurred_at int, event_type string, outcome string")
    ids = lambda **w: sorted(r.event_id for r in df.where(p.events(**w)).collect())
    assert ids() == [0, 1, 2, 3, 4] and ids(types=["a"], outcomes=["ok"]) == [0, 4] and ids(since=F.lit(5), until=F.lit(9)) == [0, 1, 2]
    assert ids(behind=(F.lit(5), F.lit(1))) == [0] and ids(equal={"event_type": "c"}) == [3] and ids(types=[]) == []


def test_scopes_in_plain_form(spark):
    rows = [("./A//b/", "a/b"), ("a\\B", "a/b"), ("STRASSE/É", "strasse/é"), ("straße/É", "strasse/é"), ("", ""), (None, None), ("a/../b", "a/../b")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r for r in df.select("t", "want", p.plain_path(F.col("t")).alias("got")).collect() if r.got != r.want and unicodedata.normalize("NFC", r.got) != r.want] == []


def test_extractions_that_are_current(spark):
    good = ("succeeded", None, 5, "m", 1, 1, "p", "1", "1", "é", 2)
    faults = [(0, "failed"), (1, "timeout"), (2, 6), (3, "n"), (4, 2), (5, 0), (6, ""), (7, None), (9, None), (10, 3)]
    rows = [(0, good)] + [(i + 1, (*good[:k], v, *good[k + 1 :])) for i, (k, v) in enumerate(faults)] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, e struct<status:string,failure_code:string,source_size:long,source_mime:string,schema_version:int,normalization_version:int,parser_name:string,parser_version:string,runtime_version:string,text:string,text_bytes:long>")
    assert [r.i for r in df.where(p.extraction_is_current(F.col("e"), F.lit(5), F.lit("m"), 1, 1)).collect()] == [0]


def test_scan_authority(spark):
    jobs = spark.createDataFrame([("a", 1, "failed", True), ("a", 2, "open", False), ("b", 1, "failed", True), ("b", 2, "completed", True), ("c", 1, "completed", True), ("c", 2, "failed", True), ("d", 1, "cancelled", True)], "k string, order int, state string, terminal boolean")
    assert {tuple(r) for r in p.scan_is_authoritative(jobs, ["k"]).collect()} == {("a", "live"), ("b", "superseded"), ("c", "failed"), ("d", "free")}


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_what_stands_before_in_blocks_of_any_width(spark, width):
    r = random.Random(width)
    rows = [(r.choice(["a", "a", "b", None]), r.randint(-20, 60), i, r.choice([1, 2, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    block = F.floor(F.col("t") / width)
    got = {x.i: (x.before and (x.before.i, x.before.v), x.so_far) for x in order.with_running(order.with_before(df, ["k"], ["t", "i"], ["i", "v"], block).withColumn("n", F.coalesce("v", F.lit(0))), ["k"], ["t", "i"], "n", block).collect()}
    want, last, sums = {}, {}, {}
    for k, _, i, v in sorted(rows, key=lambda x: (x[1], x[2])):
        sums[k] = sums.get(k, 0) + (v or 0)
        want[i] = (last.get(k), sums[k])
        last[k] = (i, v)
    assert got == want
    assert order.with_before(df.limit(0), ["k"], ["t", "i"], ["i"], block).collect() == []


def brute_stump(rows, least):
    pos, neg = sum(y for *_, y in rows), sum(1 - y for *_, y in rows)
    best = None
    for f in range(2):
        values = sorted({x[f] for x in rows if x[f] is not None})
        tp, tn = sum(x[2] for x in rows if x[f] is not None), sum(1 - x[2] for x in rows if x[f] is not None)
        for a, b in zip(values, values[1:]):
            left = [x[2] for x in rows if x[f] is not None and x[f] <= a]
            lp, ln = sum(left), len(left) - sum(left)
            if len(left) < least or tp + tn - len(left) < least:
                continue
            impurity = sum(Fraction(2 * q * tn * m * tp, q * tn + m * tp) if q + m else 0 for q, m in ((lp, ln), (tp - lp, tn - ln)))
            if impurity < tp * tn:
                gain = Fraction((lp * tn - ln * tp) ** 2, (lp * tn + ln * tp) * (2 * tp * tn - lp * tn - ln * tp))
                if best is None or gain > best[0]:
                    best = (gain, f, a / 2 + b / 2, lp, ln, tp - lp, tn - ln)
    return best[1:] if best else (None, None, pos, neg, 0, 0)


@pytest.mark.parametrize("seed", range(4))
def test_exact_stump_is_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(0, 6), r.choice([0.5, 1.25, None, 7.0]), r.randint(0, 1)) for _ in range(60)] if seed else [(1, 2.0, 0), (1, 2.0, 1), (1, 2.0, 1)]
    df = spark.createDataFrame(rows, "a int, b double, y int")
    assert tuple(learn.exact_stump(df, ["a", "b"], "y", 3).collect()[0]) == brute_stump(rows, 3)


def test_prefixes_of_more_lengths_than_are_listed(spark):
    objects = spark.createDataFrame([("b", "x" * n) for n in range(40)], "bucket string, object_key string")
    scopes = spark.createDataFrame([(None if n % 2 else "b", "x" * n) for n in range(0, 40, 3)] + [("c", "x"), ("b", None)], "scope_bucket string, scope_prefix string")
    few, many = (sorted(map(str, catalog.prefix_join(objects, scopes, few_lengths=k).collect())) for k in (256, 2))
    assert few == many and len(few) == sum(40 - n for n in range(0, 40, 3)) + 40


def test_ancestry_of_chains_and_cycles(spark):
    chain = [(f"n{i:04}", f"n{i - 1:04}" if i else None) for i in range(1500)]
    edges = spark.createDataFrame(chain + [("c1", "c2"), ("c2", "c1"), ("below", "c1"), ("lost", "nowhere")], "node string, parent string")
    got = {r.node: (r.root, r.depth) for r in ledger.ancestry(edges).collect()}
    assert all(got[n] == ("n0000", i) for i, (n, _) in enumerate(chain))
    assert all(got[n] == (None, None) for n in ("c1", "c2", "below", "lost"))


def test_published_generations_are_never_lost(spark, tmp_path):
    root = f"{tmp_path}/t"
    row = lambda v: spark.createDataFrame([(v,)], "v int")
    assert sinks.current(spark, root) is None
    sinks.publish(row(1), root)
    seen = sinks.latest(spark, root)
    sinks.publish(row(2), root)  # another writer
    with pytest.raises(RuntimeError):
        sinks.publish(row(3), root, seen)
    assert [r.v for r in sinks.current(spark, root).collect()] == [2] and [r.v for r in sinks.current(spark, root, seen).collect()] == [1]


def test_sketches_find_most_neighbours(spark):
    g = np.random.default_rng(2)
    v = g.normal(size=(1500, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9000, [0.0] * 32), (9001, None)], "id long, vector array<double>")
    q = df.where("id % 100 = 0")
    got = {(r.query_id, r.id) for r in retrieval.sketch_knn(df, q, 10).collect()}
    want = {(r.query_id, r.id) for r in retrieval.exact_knn(df, q, 10).collect()}
    assert len(want) == 150 and len(got & want) / len(want) >= 0.9
    cells = retrieval.fit_cells(df, 12)
    parts = [sorted(map(str, retrieval.cell_knn(df, q, 10, cells, 12, n).collect())) for n in (50_000, 7)]
    assert parts[0] == parts[1] and len(parts[0]) == 150
    assert retrieval.sketch_knn(df, q.limit(0), 10).collect() == [] and retrieval.exact_knn(df.limit(0), q, 10).collect() == []


def test_filters_change_no_keyword_score(spark):
    docs = spark.createDataFrame([(i, "cold tape " * (i % 3) + "archive " * (i % 5), i % 2) for i in range(40)], "id int, text string, side int")
    q = spark.createDataFrame([(0, "cold archive archive")], "query_id long, query string")
    whole = {r.id: r.score for r in retrieval.bm25(docs, "id", "text", q).collect()}
    kept = {r.id: r.score for r in retrieval.bm25(docs, "id", "text", q, keep=F.col("side") == 1).collect()}
    assert kept == {i: s for i, s in whole.items() if i % 2} and kept


def test_times_fail_outside_utc(spark):
    from lodestone.functions.keys import instant_us

    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="Tokyo"):
            instant_us(F.col("x"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_package_is_sent_through_the_shared_folder(spark, tmp_path):
    import io
    import zipfile

    from lodestone.session import send

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("sent_by_test/__init__.py", "VALUE = 7\n")
    send(spark, f"file://{tmp_path}/sent.zip", data.getvalue())

    def value(batches):
        import sent_by_test

        for b in batches:
            yield b.assign(v=sent_by_test.VALUE)

    assert [r.v for r in spark.range(1).mapInPandas(value, "id long, v int").collect()] == [7]
