"""Tokens, mixtures, look-alikes, splitting and percentiles against independent computations."""

from __future__ import annotations

import base64
import math
import random
import unicodedata

import numpy as np
import pytest

from lodestone.llm import bpe, lookalike, mixing, radix, splitting

WORDS = "the lease keeper quarantined a sealed bundle; naïve Größe Übergabe données ключ λόγος 日本語のテスト 👩‍💻 🗂️ 0042 don't we'll   <|endoftext|>".split(" ")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{bpe.FOLDER}/{bpe.VOCABULARY}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(r, n):
    return "".join(r.choice([" ", "\n", "  ", "", "\t"]) + r.choice(WORDS) for _ in range(n))


def test_prefix_encoding_is_the_public_one(tiktoken_encoding):
    e, r = bpe.encoder(), random.Random(7)
    texts = [random_text(r, r.randint(0, 60)) for _ in range(300)] + ["a" * 3000, "=" * 999, " " * 50, "\x00́", "ab" * 2000]
    for t in texts:
        assert e.encode(t) == tiktoken_encoding.encode_ordinary(t)
        assert e.count(t) == len(e.encode(t))
    assert e.encode(None) == e.encode("") == []


def test_appends_and_edits_are_exact(tiktoken_encoding):
    e, r = bpe.encoder(), random.Random(11)
    for _ in range(150):
        text = random_text(r, 12)
        enc = e.start(text)
        for _ in range(5):
            new = random_text(r, r.randint(0, 2))[: r.randint(0, 9)]
            if r.random() < 0.5:
                enc.append(new)
                text += new
            else:
                i = r.randint(0, len(text))
                j = min(len(text), i + r.randint(0, 8))
                enc.edit(i, j, new)
                text = text[:i] + new + text[j:]
            assert enc.text == text and enc.ids() == tiktoken_encoding.encode_ordinary(text)


def test_ids_of_nulls_and_empties(spark, data):
    from lodestone.llm.queries import p7_ids

    rows = p7_ids(spark, data).collect()
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.ids == [] for r in rows if not docs[r.doc_id]) and any(not t for t in docs.values())


def brute_mix(sizes, targets, total):
    # shares by simple sums, without an order: only whole epochs and the size of the cut can be told
    out = {}
    named = {s for s, _, _ in targets}
    if total is None:
        total = sum(t for _, s, t in sizes if s in named)
    for s, share, cap in targets:
        size = sum(t for _, x, t in sizes if x == s)
        out[s] = (min(round(share * total), size * cap), size)
    return out


@pytest.mark.parametrize("total", [None, 500, 100_000])
def test_mixture_reaches_shares_within_half_a_document(spark, total):
    r = random.Random(3)
    sizes = [(i, r.choice("aaaabbcd"), r.randint(0, 20)) for i in range(2000)]
    targets = [("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.2, 2), ("absent", 0.1, 5)]
    s = spark.createDataFrame(sizes, "doc_id long, source string, tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    got = mixing.mixture(s, t, total).collect()
    caps = {x: c for x, _, c in targets}
    assert len({x.doc_id for x in got}) == len(got) and all(1 <= x.repeats <= caps[x.source] for x in got) and all(x.source != "d" for x in got)
    for source, (grant, _) in brute_mix(sizes, targets, total).items():
        taken = sum(x.tokens * x.repeats for x in got if x.source == source)
        assert abs(taken - grant) <= 10, source
    for source in "ab":  # within a source repeats differ by one at most
        n = [x.repeats for x in got if x.source == source]
        assert max(n) - min(n) <= 1
    report = {x.source: x for x in mixing.shares(s, t, total).collect()}
    assert report["absent"].reached_share == 0 and abs(sum(x.reached_share for x in report.values()) - 1) < 1e-9
    assert mixing.mixture(s.limit(0), t).collect() == [] and len(mixing.shares(s.limit(0), t).collect()) == 4


SAME = [("ﬁle Ⅳ 20 ℃", "file IV 20 °C"), ("ｆｕｌｌ　ｗｉｄｔｈ！", "full width!"), ("été", "été"), ("no break here", "no break here"), ("раss", "pass"), ("Κelvin K", "Kelvin K"), ("in​vis­i﻿ble", "invisible"), ("ｶﾞｷﾞ", "ガギ"), ("19 µs", "19 μs")]
OTHER = [("x²", "x2"), ("①", "1"), ("Ab", "ab"), ("é", "e"), ("ß", "ss"), ("a-b", "a–b"), ("a\nb", "a b"), ("O", "0"), ("👩‍💻", "👩💻"), ("l", "I"), ("a\tb", "a b")]


def test_same_look_and_other_look():
    for a, b in SAME:
        assert lookalike.canonical(a) == lookalike.canonical(b), (a, b)
    for a, b in OTHER:
        assert lookalike.canonical(a) != lookalike.canonical(b), (a, b)
    assert lookalike.canonical(None) is None and lookalike.canonical("") == ""


def test_spliced_segments_equal_whole_normalisation():
    r = random.Random(5)
    parts = list("abc ȩ́́​‍️ﬁｶﾞＡ 的Ⅳаο가각👩💻🏽🗂\n\x00") + ["👩‍💻", "👩🏽‍💻"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        c = lookalike.canonical(t)
        assert c == lookalike.canonical_whole(t), ascii(t)
        assert unicodedata.is_normalized("NFC", c)


def test_pairs_are_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([x for p in SAME + OTHER for x in p] + ["file IV 20 °C"] * 5 + ["f​ile IV 20 °C", None, "", "​", " ", " "])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s and t and s != t and lookalike.canonical_whole(s) == lookalike.canonical_whole(t) and lookalike.canonical_whole(s).strip()}
    for hot, many in ((1, 1), (2, 1_000), (100_000, 1), (100_000, 1_000)):
        assert {tuple(x) for x in lookalike.same_look_pairs(df, hot_rows=hot, many_texts=many).collect()} == want
    assert lookalike.same_look_pairs(df.limit(0)).collect() == []
    partners = {}
    for a, b in want:
        partners.setdefault(a, set()).add(b)
        partners.setdefault(b, set()).add(a)
    text = dict(rows)
    members = lambda d: {x for x in text if text[x] and text[x].strip() and lookalike.canonical_whole(text[x]) == lookalike.canonical_whole(text[d])}
    classes = {(d, min(members(d)), len({text[x] for x in members(d)}), len(p)) for d, p in partners.items()}
    for hot in (1, 100_000):
        assert {tuple(x) for x in lookalike.same_look_classes(df, hot_rows=hot).collect()} == classes
    assert lookalike.same_look_classes(df.limit(0)).collect() == []


def test_a_form_with_many_texts(spark):
    """All pairs of one form's texts, whatever the parts they are spread over."""
    rows = [(i, "word" + "\u200b" * i) for i in range(70)] + [(70 + i, "word") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s != t}
    for hot, many in ((7, 9), (100_000, 1_000)):
        assert {tuple(x) for x in lookalike.same_look_pairs(df, hot_rows=hot, many_texts=many).collect()} == want


def test_every_document_is_canonical_as_a_whole(spark, data):
    """On the texts of the tables: splices equal the normalisation of every character, and doing it again changes nothing."""
    from lodestone.llm.queries import p9_canonical

    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = p9_canonical(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.text == (docs[r.doc_id] and lookalike.canonical_whole(docs[r.doc_id])) and r.changed == (r.text != docs[r.doc_id]) and lookalike.canonical(r.text) == r.text


def test_pieces_cover_the_text_and_end_naturally():
    r = random.Random(9)
    for k in range(200):
        text = "".join(r.choice(["Word", "längeres Wort", "日本。", "👍", "x" * r.randint(1, 400)]) + r.choice([" ", ". ", "\n\n", "", ".", " "]) for _ in range(r.randint(0, 300)))
        cut = splitting.pieces(text)
        if not text:
            assert cut == []
            continue
        assert cut[0][0] == 0 and cut[-1][1] == len(text)
        for i, (s, e) in enumerate(cut):
            assert 0 < e - s <= 1000
            if i:
                assert s == cut[i - 1][1] - 100
            if e < len(text):
                natural = text[e - 1] in " \n\r" or text[e] in " \n\r"
                assert natural or not any(b in text[max(s, e - 300) : e] for b in " \n\r")


def test_deepest_valley_is_where_the_topic_changes():
    a = " ".join(f"The {w} lease keeper moved a sealed bundle to storage." for w in ["old", "new", "big"] * 4)
    b = " ".join(f"Our {w} garden grows tomatoes beside tall roses." for w in ["red", "wet", "warm"] * 6)
    text = a + " " + b
    (_, end), *_ = splitting.pieces(text)
    assert abs(end - len(a) - 1) <= 2


def test_depths_are_those_of_climbing_both_ways():
    """Peaks found in one pass are those of climbing from each gap, and equal sentences take no longer than others."""

    def climbed(similar):
        out = []
        for i, s in enumerate(similar):
            peaks = []
            for step in (-1, 1):
                j = i
                while 0 <= j + step < len(similar) and similar[j + step] >= similar[j]:
                    j += step
                peaks.append(similar[j])
            out.append(sum(peaks) - 2 * s)
        return out

    r = random.Random(8)
    for _ in range(60):
        text = " ".join(" ".join(r.choice("ab cd ef gh".split()) for _ in range(r.randint(1, 9))) + "." for _ in range(r.randint(0, 40)))
        at = splitting.gaps(text)
        words = [(m.group().casefold(), m.end()) for m in splitting._WORD.finditer(text)]
        similar = []
        for g in at:
            k = sum(e <= g for _, e in words)
            a, b = (splitting.Counter(w for w, _ in part) for part in (words[max(0, k - 40) : k], words[k : k + 40]))
            dot = sum(n * b[w] for w, n in a.items())
            similar.append(dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0)
        assert splitting.depths(text, at) == climbed(similar)
    at = splitting.gaps(text := "The same sentence again. " * 20_000)
    assert len(splitting.depths(text, at)) == len(at) == 19_999


def test_audit_is_brute_force(spark):
    r = random.Random(2)
    texts = {f"d{k}": "".join(r.choice(["ab ", "cd\n", "e" * 350, "👍 ", "。"] if k % 2 else ["日本語。", "文。" * 40, "e" * 90, "語" * 200] + ["ab "] * (k % 4)) for _ in range(r.randint(0, 200))) for k in range(24)} | {"null": None}
    stored = []
    for d, t in texts.items():
        for i, (s, e) in enumerate(splitting.pieces(t)):
            bend = r.choice([0, 0, 0, 1, -1])
            stored.append((d, i, s, e + bend, (t[s : e + bend] if r.random() < 0.9 else "other")))
    stored += stored[:5] + [("missing", 0, 0, 3, "abc"), ("null", 0, 0, 1, "a"), ("d0", 7000, 5, 9, "x")]

    def bad(rows):
        out = set()
        by = {}
        for x in sorted(set(rows)):
            by.setdefault(x[0], []).append(x)
        for d, xs in by.items():
            t = texts.get(d)
            for k, (_, i, s, e, p) in enumerate(xs):
                open_end = k == len(xs) - 1 and (t is None or e != len(t))
                inner = t is not None and e < len(t) and e > s and not (t[e - 1] in " \n\r" or t[e] in " \n\r") and any(b in t[max(s, e - 300) : e] for b in " \n\r")
                if e - s > 1000 or t is None or p != t[s:e] or s != (xs[k - 1][3] - 100 if k else 0) or open_end or inner:
                    out.add((d, i))
        return out

    p = spark.createDataFrame(stored, "document_id string, passage_index long, start_codepoint long, end_codepoint long, text string")
    t = spark.createDataFrame(list(texts.items()), "document_id string, text string")
    for hot, together in ((1, 2), (100_000, 256), (100_000, 1)):
        got = splitting.audit(p, t, hot_rows=hot, together=together).collect()
        assert {(x.document_id, x.passage_index) for x in got} == bad(stored)
        for x in got:  # what the search proposes is a boundary of the text
            if "unnatural_end" in x.faults:
                assert splitting.is_boundary(texts[x.document_id], x.proposed_end)
    assert splitting.audit(p.limit(0), t).collect() == []


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "hot_rows": 1}, {"broadcast_rows": 0}])
def test_percentiles_are_exact(spark, limits):
    r = random.Random(4)
    values = [0.0, -0.0, -1.0, 1e-4, 1e14, math.inf, -math.inf, 5e-324, math.nan, None]
    rows = [(i, r.choice(["a", "a", "a", None]), r.choice("xyz"), r.choice(values) if r.random() < 0.4 else r.gauss(0, 10.0 ** r.randint(-3, 8))) for i in range(3000)]
    rows += [(9001, "b", "one", 3.5), (9002, "b", "none", None)] + rows[:100]
    df = spark.createDataFrame(rows, "sample_id long, g string, h string, v double")
    got = {(x.g, x.h): x for x in radix.percentiles_of(df, ["g", "h"], "v", "sample_id", **limits).collect()}
    by = {}
    for _, g, h, v in {x[0]: x for x in rows}.values():
        if v is not None and not math.isnan(v):
            by.setdefault((g, h), []).append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        vs.sort()
        for p, name in zip(radix.PERCENTILES, ("p50", "p90", "p95", "p99", "p99_9")):
            assert got[k][name] == vs[-(-len(vs) * p // 1000) - 1]
        assert got[k].n == len(vs)
    assert radix.percentiles_of(df.limit(0), ["g", "h"], "v", "sample_id").collect() == []


def test_daily_histograms_add_up_and_bound(spark):
    r = random.Random(6)
    rows = [(i, "g", i % 7, r.choice([-1.0, 0.0, r.expovariate(1e-3), -r.random()])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, day int, v double")
    k = radix.keyed(df, ["g", "day"], "v", "id")
    parts = radix.histogram(k.where("day in ('=0', '=1')"), ["g", "day"], 22).unionByName(radix.histogram(k.where("day not in ('=0', '=1')"), ["g", "day"], 22))
    vs = np.sort([x[3] for x in rows])
    for x in radix.estimate(radix.merged(parts, ["g"]), ["g"], 22).collect():
        exact = vs[-(-len(vs) * x.p // 1000) - 1]
        assert x.low <= exact <= x.high and abs(x.high - x.low) <= abs(exact) * 2**-9.9 + 1e-300
