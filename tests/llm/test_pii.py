"""The mention model: decoding and training against brute force, held-out accuracy, exact checks, redaction."""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pytest

from lodestone.llm import crf, labelled, pii
from tests.llm import heldout

GRAMMAR = labelled.Grammar(20)
FEATURES = crf.Features(GRAMMAR.listed["given"], GRAMMAR.listed["family"])
TABLES = "/root/testdata/sf0.1"


def test_viterbi_is_brute_force():
    g = np.random.default_rng(3)
    first = np.array([0, 1, 4, 9, 9 + 6])
    score, step, opening = g.normal(size=(15, 3)).astype(np.float32), g.normal(size=(3, 3)).astype(np.float32), g.normal(size=3).astype(np.float32)
    got = crf.viterbi(score, first, step, opening)
    for a, b in zip(first, first[1:]):
        best = max(itertools.product(range(3), repeat=b - a), key=lambda y: opening[y[0]] + sum(score[a + i, v] for i, v in enumerate(y)) + sum(step[u, v] for u, v in zip(y, y[1:])))
        assert tuple(got[a:b]) == best


def test_expectations_are_brute_force():
    g = np.random.default_rng(5)
    first = np.array([0, 1, 4, 8])
    score, step, opening = g.normal(size=(8, 3)), g.normal(size=(3, 3)), g.normal(size=3)
    got, pairs, opens = crf._expected(score, first, step, opening)
    want, all_pairs, all_opens = np.zeros_like(score), np.zeros((3, 3)), np.zeros(3)
    for a, b in zip(first, first[1:]):
        ways = list(itertools.product(range(3), repeat=b - a))
        weight = np.exp([opening[y[0]] + sum(score[a + i, v] for i, v in enumerate(y)) + sum(step[u, v] for u, v in zip(y, y[1:])) for y in ways])
        for y, p in zip(ways, weight / weight.sum()):
            all_opens[y[0]] += p
            for i, v in enumerate(y):
                want[a + i, v] += p
            for u, v in zip(y, y[1:]):
                all_pairs[u, v] += p
    assert np.allclose(got, want) and np.allclose(pairs, all_pairs) and np.allclose(opens, all_opens)


def test_training_learns_a_small_table():
    marked = ["call [person_name|Ann Lee] now", "mail [email|a@b.test] today", "nothing here", "call [person_name|Bob Ray] today"] * 3
    m = pii.fit(marked, GRAMMAR.listed, rounds=60, least=1)
    for s in marked:
        text, want = labelled.parse(s)
        assert pii.mentions([text], FEATURES, m) == [want]


def scored(marked, f):
    parsed = [labelled.parse(s) for s in marked]
    got = pii.mentions([t for t, _ in parsed], f)
    want = [{(s, k) for s, z, k in m if pii.holds(k, t[s:z])} for t, m in parsed]
    found = [{(s, k) for s, _, k in m} for m in got]
    right = sum(len(a & b) for a, b in zip(want, found))
    return right / sum(map(len, want)), right / sum(map(len, found))


def test_accuracy_on_the_same_grammar():
    """Sentences of another seed: other names, numbers and neighbours, the same rules."""
    g = labelled.Grammar(991)
    recall, precision = scored([g.text() for _ in range(600)], crf.Features(g.listed["given"], g.listed["family"]))
    assert recall > 0.95 and precision > 0.95


def test_held_out_accuracy():
    """Sentences written by hand that none of the rules makes, in three sets, the last not looked at before the last training."""
    sets = [(heldout.MARKED, heldout.STAFF), (heldout.LATER, heldout.LATER_STAFF), (heldout.LAST, heldout.LAST_STAFF)]
    results = [scored(marked, crf.Features(staff["given"], staff["family"])) for marked, staff in sets]
    assert all(recall >= least and precision >= 0.95 for (recall, precision), least in zip(results, (0.9, 0.9, 0.85)))


def test_labelled_table_owes_nothing_to_the_tables():
    """No person's name and no four words in a row of the tables stand in it."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.exists(TABLES):
        pytest.skip("no tables here")
    texts = [t for (t,) in duckdb.sql(f"SELECT source_text FROM '{TABLES}/golden.parquet' UNION ALL SELECT text FROM '{TABLES}/corpus.parquet' UNION ALL SELECT text FROM '{TABLES}/documents.parquet'").fetchall() if t]
    word = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

    def fours(text):
        w = [x.casefold() for x in word.findall(text) if len(x) > 2]
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    marked, _ = labelled.sentences(4000)
    mine = set().union(*(fours(re.sub(r"\[\w+\|[^\]]*\]", "zzz", s)) for s in marked))
    words, theirs = set(), set()
    for t in set(texts):
        words |= set(word.findall(t))
        theirs |= fours(t) & mine
    assert not theirs
    staff = {x for r in duckdb.sql(f"SELECT given_name, family_name FROM '{TABLES}/staff_directory.parquet'").fetchall() for x in r}
    assert not {n for n in [*GRAMMAR.pool["given"], *GRAMMAR.pool["family"], *labelled.WORD_NAMES] if n in staff or n in words}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Her social security number is 551-40-7388.", [("identity_number", "551-40-7388")]),
        ("Her social security number is 666-40-7388.", []),
        ("Her social security number is 551-00-7388.", []),
        ("Her social security number is 951-40-7388.", []),
        ("Call (303) 555-0144 and ask for help.", [("phone", "(303) 555-0144")]),
        ("Call us (0161 555 0187) today.", [("phone", "0161 555 0187")]),
        ("Write to zed.quirk42 at lab dot quint dot example today.", [("email", "zed.quirk42 at lab dot quint dot example")]),
        ("In May the driver sold 2 tickets. Bill the council at the end of June.", []),
    ],
)
def test_mentions(text, want):
    assert [(k, text[s:z]) for s, z, k in pii.mentions([text], FEATURES)[0]] == want


def test_redaction_changes_nothing_else():
    for text, _ in (labelled.parse(s) for s in labelled.sentences(300, seed=5)[0]):
        found = pii.mentions([text], FEATURES)[0]
        out = pii.redact(text, found)
        at = 0
        for s, z, kind in found:
            before, _, out = out.partition(f"<{kind.upper()}>")
            assert before == text[at:s]
            at = z
        assert out == text[at:]
    assert pii.redact("abc", []) == "abc"


def test_long_tokens_runs_and_paragraphs_count_whole():
    f = crf.Features(GRAMMAR.listed["given"], GRAMMAR.listed["family"])
    assert f.of_token("a" * 900 + "b")[1] != f.of_token("a" * 901 + "b"[:0] + "c")[1] and f.of_run("1-" * 90 + "1")[1] != f.of_run("1-" * 91 + "1")[1]
    lead = "照合サービスは確認した。" * 40
    text = f"{lead}mailto:zed.quirk+holds@kiln.invalid"
    e = crf.Encoded([text], f)
    at = e.run[[text[s] for s in e.start].index("@")]
    ends = [*f.runs.begin, len(f.runs.flat)]
    assert f.runs.flat[ends[at] : ends[at + 1]] == [crf.zlib.crc32(x.encode()) for x in f.of_run("mailto:zed.quirk+holds@kiln.invalid")[1]]
    assert [(k, text[s:z]) for s, z, k in pii.mentions([text], f)[0]] == [("email", "zed.quirk+holds@kiln.invalid")]
    local = "x" * 300 + ".y" * 50
    assert [(s, k) for s, _, k in pii.mentions([f"Write to {local}@lake.example today."], f)[0]] == [(9, "email")]
    # one paragraph of far more than 4,096 tokens is one sequence, and is labelled as brute force labels it: as the same text in pieces
    one = "The wooden bridge opened. " * 2000 + "Call (303) 555-0144 and ask for help. " + "The wooden bridge opened. " * 1000
    assert len(crf.Encoded([one], f).first) == 2
    assert [(k, one[s:z]) for s, z, k in pii.mentions([one], f)[0]] == [("phone", "(303) 555-0144")]


def test_a_staff_list_of_any_length(spark):
    """A list that is not sent to the workers is joined with the words of the texts, with the same result."""
    texts = [labelled.parse(s)[0] for s in labelled.sentences(200, seed=6)[0]]
    df = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)] + [("t", "0", texts[0]), ("t", "none", None), (None, "empty", "")], "table_name string, record_id string, text string")
    names = [(g, f) for g, f in zip(GRAMMAR.pool["given"], GRAMMAR.pool["family"])] + [(None, "Vault-Orrin"), ("Anna-Lo", None)]
    staff = spark.createDataFrame(names, "given_name string, family_name string")
    for name in ("find_mentions", "redacted"):
        few, many = (sorted(map(tuple, getattr(pii, name)(df, staff, most).collect()), key=str) for most in (100_000, 1))
        assert few == many and few
    assert pii.find_mentions(df.limit(0), staff, 1).collect() == []


def test_frames_with_nulls_empties_copies_and_long_texts(spark):
    long = "The wooden bridge opened. " * 3000 + "Call (303) 555-0144 and ask for help.\n\n" + "x" * 20000
    rows = [("t", "null", None), ("t", "empty", ""), ("t", "blank", " \n "), ("t", "long", long), ("t", "a", "Thanks,\nOttla"), ("t", "a", "Thanks,\nOttla"), (None, None, "Dear Berit Hallow,\nyour parcel was sold.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "table_name string, record_id string, text string, kind int")
    staff = spark.createDataFrame([("Ottla", "Berin"), (None, None)], "given_name string, family_name string")
    got = pii.find_mentions(df, staff).collect()
    assert {x.record_id for x in got} == {"long", "a", None} and len([x for x in got if x.record_id == "a"]) == 2
    one = next(x for x in got if x.record_id == "long")
    assert long[one.start_codepoint : one.end_codepoint] == one.mention == "(303) 555-0144"
    back = {x.record_id: x for x in pii.redacted(df, staff).collect()}
    assert back["null"].text is None and back["empty"].text == "" and back["a"].text == "Thanks,\n<PERSON_NAME>" and back["long"].mentions == 1
    assert pii.find_mentions(df.limit(0), staff).collect() == []
    assert pii.find_mentions(df, staff.limit(0)).count() > 0
