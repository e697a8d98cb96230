"""Listings, generations, upserts, exports and streams on small folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import listing, sinks
from lodestone.streaming import jobs


def test_listing_and_ranges(spark, tmp_path):
    for key, data in {"q1/a.txt": b"hello", "q1/größe b.bin": b"\x00\x01\x02", "q10/c": b"!", "x": b"zz"}.items():
        p = tmp_path / "objects" / key
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {x.key: x.size for x in listing.list_objects(spark, str(tmp_path / "objects")).collect()}
    assert {k: v for k, v in got.items() if "b.bin" not in k} == {"q1/a.txt": 5, "q10/c": 1, "x": 2} and len(got) == 4
    assert {x.key for x in listing.list_objects(spark, str(tmp_path / "objects"), "q10").collect()} == {"q10/c"}
    assert sorted(bytes(x.data) for x in listing.read_ranges(spark, str(tmp_path / "objects"), 1, 3).collect()) == [b"", b"\x01\x02", b"ell", b"z"]


def test_generations_and_upserts(spark, tmp_path):
    root = str(tmp_path / "index")
    assert sinks.current(spark, root) is None
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    sinks.publish(a, root)
    change = spark.createDataFrame([(2, "B", False), (3, "c", False), (1, None, True)], "k long, v string, gone boolean")
    for _ in range(2):
        sinks.upsert(change, root, ["k"], "gone")
        assert sorted(tuple(x) for x in sinks.current(spark, root).collect()) == [(2, "B"), (3, "c")]


def test_export_is_canonical_and_stable(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "é"), (1, 0.5, "x")], "b long, a double, c string")
    one = sinks.export_json(df, str(tmp_path / "one")).collect()[0]
    two = sinks.export_json(df.select("c", "a", "b").repartition(3).orderBy("b"), str(tmp_path / "two")).collect()[0]
    assert one == two and one.rows == 2
    lines = sorted(spark.read.text(str(tmp_path / "one")).collect())
    assert [json.loads(x.value) for x in lines] == [{"a": 0.5, "b": 1, "c": "x"}, {"b": 2, "c": "é"}] and list(json.loads(lines[0].value)) == ["a", "b", "c"]
    m = sinks.metric_lines(spark.createDataFrame([('a"b', 3)], "l string, n long"), "calls", ["l"], "n").collect()
    assert m[0].line == 'calls{l="a\\"b"} 3'


def test_streams_restart_without_repeating(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, i * 1_000_000) for i in ids], "id long, us long").select("id", F.timestamp_micros("us").alias("at")).coalesce(1)
    rows(1, 2, 2).write.parquet(str(tmp_path / "in.parquet"))
    read = lambda: jobs.deduplicated(jobs.source(spark, str(tmp_path), "in.parquet"), ["id"], "at", "1 hour")
    target = str(tmp_path / "job")
    assert sorted(x.id for x in jobs.run(read(), target=target).collect()) == [1, 2]
    rows(2, 3).write.mode("append").parquet(str(tmp_path / "in.parquet"))
    assert sorted(x.id for x in jobs.run(read(), target=target).collect()) == [1, 2, 3]


def test_sustained_state_over_batches(spark, tmp_path):
    data = [("k", t, v) for t, v in ((0, True), (10, True), (20, False), (30, True), (45, True), (200, True), (210, True), (220, False))]
    for n, part in enumerate((data[:2], data[2:5], data[5:])):
        spark.createDataFrame(part, "key string, at_us long, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "s.parquet"))
    got = jobs.run(jobs.sustained(jobs.source(spark, str(tmp_path), "s.parquet"), "key", 10, 60)).collect()
    assert sorted(tuple(x) for x in got) == [("k", 0, 10, 2), ("k", 30, 45, 2), ("k", 200, 210, 2)]


def test_each_batch_feeds_an_index(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(str(tmp_path / "c.parquet"))
    root = str(tmp_path / "idx")
    jobs.each_batch(jobs.source(spark, str(tmp_path), "c.parquet"), lambda df, _: sinks.upsert(df, root, ["k"]))
    assert sinks.current(spark, root).count() == 2


def test_pages_of_a_listing(spark, tmp_path):
    for k in ("a/1.txt", "a/2.txt", "a/b/3.txt", "ab.txt", "c.txt"):
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(k)
    root, got, at = f"file:{tmp_path}", [], None
    while True:
        page, at = listing.list_page(spark, root, "a", at, 2)
        got += [r.key for r in page]
        if at is None:
            break
    assert got == ["a/1.txt", "a/2.txt", "a/b/3.txt", "ab.txt"]
    _, at = listing.list_page(spark, root, "a", None, 1)
    with pytest.raises(ValueError):
        listing.list_page(spark, root, "b", at)
    assert [r.key for r in listing.list_objects(spark, root, "a/b/").collect()] == ["a/b/3.txt"]
    assert listing.list_page(spark, root, "no/such/") == ([], None)
