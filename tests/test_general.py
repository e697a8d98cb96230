"""The general operators against brute force on small and awkward tables."""

from __future__ import annotations

import random

import pytest

from lodestone.operators import copydiff, intervals, references


def brute_sweep(rows):
    by = {}
    for e, s, t in set(rows):
        if s is not None and (t is None or t > s):
            by.setdefault(e, set()).add((s, float("inf") if t is None else t))
    out = set()
    for e, spans in by.items():
        periods = []
        for s, t in sorted(spans):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], t)
                periods[-1][2] += 1
            else:
                periods.append([s, t, 1])
        for k, (s, t, n) in enumerate(periods):
            out.add((e, "period", s, -1 if t == float("inf") else t, n))
            if k + 1 < len(periods):
                out.add((e, "gap", t, periods[k + 1][0], 0))
    return out


def test_blocks_are_shorter_where_rows_are_many(spark, monkeypatch):
    df = spark.createDataFrame([("x", 1_000_000 * k, None) for k in range(100)], "entity string, start_us long, end_us long")
    monkeypatch.setattr(intervals, "BLOCK_EVENTS", 20)
    assert intervals.block_length(df) == 9_900_000 and intervals.block_length(df.limit(0)) == intervals.BLOCK_US and intervals.block_length(df.limit(1)) == 1
    assert len(intervals.sweep(df).collect()) == 1


@pytest.mark.parametrize("block_us", [None, 1, 7, 40, 10_000])
def test_sweep_is_brute_force_in_any_block_length(spark, block_us):
    r = random.Random(block_us or 0)
    rows = []
    for _ in range(400):
        s = r.randint(-50, 400)
        rows.append((r.choice(["a", "b", "c", None]), None if r.random() < 0.05 else s, None if r.random() < 0.02 else s + r.randint(-3, 12)))
    rows += rows[:40]  # exact copies
    df = spark.createDataFrame(rows, "entity string, start_us long, end_us long")
    got = {tuple(x) for x in intervals.sweep(df, block_us).collect()}
    assert got == brute_sweep(rows)


def test_sweep_of_nothing_and_touching(spark):
    empty = spark.createDataFrame([], "entity string, start_us long, end_us long, kind string")
    assert intervals.sweep(empty).collect() == []
    df = spark.createDataFrame([("x", 1, 5, "clash"), ("x", 5, 9, "clash")], empty.schema)
    assert [tuple(x) for x in intervals.merged_and_gaps(df).collect()] == [("x", "merged", 1, 9)]
    nested = spark.createDataFrame([("x", 1, 50, ""), ("x", 2, 3, ""), ("x", 60, None, ""), ("x", 70, 80, "")], empty.schema)
    assert {tuple(x) for x in intervals.merged_and_gaps(nested).collect()} == {("x", "merged", 1, 50), ("x", "gap", 50, 60), ("x", "merged", 60, -1)}


def brute_diff(left, right):
    def last(rows):
        best = {}
        for k, v, t in rows:
            best[k] = max(best.get(k, (t, v)), (t, v), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        return {k: v for k, (_, v) in best.items()}

    a, b = last(left), last(right)
    return {(k, "missing_in_r") for k in a.keys() - b.keys()} | {(k, "missing_in_l") for k in b.keys() - a.keys()} | {(k, "v") for k in a.keys() & b.keys() if a[k] != b[k]}


@pytest.mark.parametrize(("step", "broadcast_ranges"), [(1, 10**6), (4, 0), (12, 10**6)])
def test_copydiff_is_brute_force(spark, step, broadcast_ranges):
    r = random.Random(step)
    keys = [f"k{i}" for i in range(300)] + [None, ""]
    left = [(k, r.choice(["x", "y", None]), 1) for k in keys if r.random() < 0.97]
    right = [(k, v if r.random() < 0.95 else "z", 1) for k, v, _ in left if r.random() < 0.97] + [("only", None, 5)]
    right += right[:50] + [(k, "newer", 9) for k, _, _ in right[:3]]
    a = spark.createDataFrame(left, "k string, v string, t long")
    b = spark.createDataFrame(right, "k string, v string, t long")
    got = {tuple(x) for x in copydiff.differences(a, b, ["k"], ["v"], "t", "t", ("l", "r"), step, broadcast_ranges).collect()}
    assert got == brute_diff(left, right)


def test_copydiff_reads_few_rows_again(spark):
    """Of 50,000 keys on each side, of which 500 differ, fewer than twice so many come to the comparison of fields."""
    a = spark.range(50_000).selectExpr("concat('key/', id) AS k", "id AS v", "1 AS t")
    b = a.selectExpr("k", "CASE WHEN v % 100 = 7 THEN v + 1 ELSE v END AS v", "t")
    left, right = copydiff.under_differing_ranges(a, b, ["k"], ["v"], "t", "t")
    assert 500 <= left.count() < 1000 and 500 <= right.count() < 1000
    assert copydiff.differences(a, b, ["k"], ["v"], "t", "t").count() == 500


def test_copydiff_of_equal_and_empty(spark):
    a = spark.createDataFrame([("k", 1, "v")], "k string, t long, v string")
    none = a.limit(0)
    assert copydiff.differences(a, a, ["k"], ["v"], "t", "t").collect() == []
    assert [tuple(x) for x in copydiff.differences(a, none, ["k"], ["v"], "t", "t").collect()] == [("k", "missing_in_right")]
    assert copydiff.differences(none, none, ["k"], ["v"], "t", "t").collect() == []


@pytest.mark.parametrize("hot_rows", [1, 100_000])
def test_orphans_with_and_without_salting(spark, hot_rows):
    refs = spark.createDataFrame([("t", "A", f"r{i}", "gone", 5) for i in range(50)] + [("t", "A", "early", "late", 5), ("t", "A", "ok", "late", 30), ("t", "A", "timeless", "late", None), ("t", "A", "fine", "there", 1), ("t", "A", "re", "reclaimed", 9), ("t", "A", "fine", "there", 1)], "table_name string, target string, record_key string, key string, ref_us long")
    records = spark.createDataFrame([("A", "late", 20, False), ("A", "there", 0, False), ("A", "there", 0, False), ("A", "reclaimed", 0, True), ("A", "reclaimed", 0, True), ("B", "gone", 0, False)], "target string, key string, created_us long, gone boolean")
    state = references.fold(references.reference_deltas(refs), references.existence_deltas(records))
    got = {x.record_key for x in references.orphans(refs, state, hot_rows).collect()}
    assert got == {f"r{i}" for i in range(50)} | {"early", "re"}
    # a later batch of deltas: the missing record arrives, one reference is removed
    more = references.fold(state, references.existence_deltas(spark.createDataFrame([("A", "gone", 0, False)], records.schema)), references.reference_deltas(spark.createDataFrame([("A", "reclaimed", 9, -1)], "target string, key string, ref_us long, delta int")))
    assert {(x.key) for x in references.suspects(more).collect()} == {"late"}


def test_a_published_state_takes_later_batches(spark, tmp_path):
    """Batches added one after another give the state of all of them at once."""
    r = random.Random(4)
    refs = [("A", r.choice("pqrs"), r.randint(0, 9), r.choice([1, 1, 1, -1])) for _ in range(60)]
    records = [("A", r.choice("pqrstu"), r.randint(0, 9), r.choice([1, 1, -1])) for _ in range(20)]
    make = lambda a, b: (references.reference_deltas(spark.createDataFrame(a, "target string, key string, ref_us long, delta int")), references.existence_deltas(spark.createDataFrame(b, "target string, key string, created_us long, delta int")))
    root = f"{tmp_path}/state"
    for k in range(3):
        state = references.advance(root, *make(refs[k * 20 : k * 20 + 20], records[k * 7 : k * 7 + 7]))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(state) == key(references.fold(*make(refs, records)))
    assert key(references.orphan_keys(state)) == [x for x in key(state) if x[2] > 0 and x[3] <= 0]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [1, 3, 1000])
def test_skew_joins_are_plain_joins(spark, how, hot_rows):
    """With copies, hot keys and keys without a partner."""
    from lodestone.operators import skew

    r = random.Random(7)
    big = spark.createDataFrame([(r.choice(["a", "a", "a", "b", "c", None, "x"]), r.randint(0, 4)) for _ in range(200)], "k string, v int")
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("y", 3.0)], "k string, w double")
    hot = skew.hot_keys(big.where("k IS NOT NULL").groupBy("k").count(), ["k"], "count", hot_rows)
    want = sorted(map(str, big.join(one, "k", how).collect()))
    assert sorted(map(str, skew.skew_join(big, one, ["k"], hot, how).collect())) == want
    assert sorted(map(str, skew.salted_join(big, one, ["k"], hot, how).collect())) == want
    assert {x["__salts"] for x in skew.hot_keys(big.groupBy("k").count().where("k = 'a'"), ["k"], "count", 10).collect()} == {-(-big.where("k = 'a'").count() // 10)}


def test_references_of_empty_tables(spark):
    refs = spark.createDataFrame([], "table_name string, target string, record_key string, key string, ref_us long")
    records = spark.createDataFrame([], "target string, key string, created_us long, gone boolean")
    state = references.fold(references.reference_deltas(refs), references.existence_deltas(records))
    assert references.orphans(refs, state).collect() == []
    assert references.orphan_report(refs).collect() == []
