"""Personal information inside free text: mentions and typed placeholders.

Mentions are found by a linear-chain conditional random field (crf.py) that was trained from the labelled table (labelled.py); its weights
lie beside this file and are made anew by `python -m lodestone.llm.pii`. A list of staff, as far as there is one, is a feature
among others: persons no list has are found by what stands around them. An exact check follows the model: an address of mail must
have a sign or word for its at and dot, a phone or identity number its digits, a 3-2-4 number its allowed groups.

Redaction puts <KIND> in the place of each mention and leaves every other character as it is.

Defined cases: null and empty texts have no mentions; redacted null stays null; overlapping mentions do not occur, as each character
has one label; equal texts are labelled alike.
"""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import crf, labelled
from lodestone.operators.skew import hot_keys, salted_join
from lodestone.session import prepare_workers, worker

LABELS = ["O"] + [f"{p}-{k}" for k in labelled.KINDS for p in "BI"]
WEIGHTS = "pii_weights.npz"
#: A staff list of at most so many persons is sent to the workers; a longer one is joined with the words of the texts.
MOST_SHIPPED = 100_000
#: Characters of text that a worker labels at a time.
CHARACTERS = 400_000


def gold(e: crf.Encoded, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """The labels of the tokens, from the marked mentions of each text."""
    out = np.zeros(len(e.token), dtype=np.int64)
    at = 0
    for k, mentions in enumerate(spans):
        while at < len(out) and e.text_of[at] < k:
            at += 1
        stop = at
        while stop < len(out) and e.text_of[stop] == k:
            stop += 1
        for s, t, kind in mentions:
            inside = np.nonzero((e.start[at:stop] >= s) & (e.end[at:stop] <= t))[0] + at
            if len(inside):
                out[inside] = LABELS.index(f"I-{kind}")
                out[inside[0]] = LABELS.index(f"B-{kind}")
    return out


def fit(sentences: list[str], listed: dict[str, set[str]], **options) -> dict[str, np.ndarray]:
    """Trains on marked sentences with a staff list."""
    parsed = [labelled.parse(s) for s in sentences]
    f = crf.Features(listed["given"], listed["family"])
    e = crf.Encoded([t for t, _ in parsed], f)
    w, step, opening = crf.train(e, f, gold(e, [m for _, m in parsed]), len(LABELS), **options)
    return {"weights": w, "step": step, "opening": opening}


@lru_cache(maxsize=1)
def model() -> dict[str, np.ndarray]:
    """The trained weights, loaded once a process."""
    data = pkgutil.get_data("lodestone.llm", WEIGHTS)
    with np.load(io.BytesIO(data)) as z:
        used = np.zeros((crf.TABLE, len(LABELS)), dtype=np.float32)
        used[z["rows"]] = z["values"]
        return {"weights": used, "step": z["step"], "opening": z["opening"]}


@lru_cache(maxsize=2)
def features(given: tuple[str, ...], family: tuple[str, ...]) -> crf.Features:
    """Features with a list of names; what they have seen is kept in the process."""
    return crf.Features(given, family)


_AT = re.compile(r"@|\bat\b", re.I)
_DOT = re.compile(r"\.|\bdot\b", re.I)
_SSN = re.compile(r"(\d{3})[- ]?(\d{2})[- ]?(\d{4})")


def holds(kind: str, text: str) -> bool:
    """The exact check of a mention."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return bool(_AT.search(text) and _DOT.search(text)) and len(text) > 5
    if kind == "phone":
        return digits >= 7
    if kind == "identity_number":
        m = _SSN.fullmatch(text)
        return digits >= 1 and sum(c.isalnum() for c in text) >= 7 and not (m and (m[1] in ("000", "666") or m[1] >= "900" or m[2] == "00" or m[3] == "0000"))
    if kind == "street_address":
        return digits >= 1 and any(c.isupper() for c in text)
    return any(c.isalpha() for c in text)


def mentions(texts: list[str], features: crf.Features, m: dict[str, np.ndarray] | None = None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the mentions of each text, in code points."""
    m = m or model()
    e = crf.Encoded(texts, features)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not len(e.token):
        return out
    label = crf.viterbi(crf.scores(e, features, m["weights"]), e.first, m["step"], m["opening"])
    opens = np.zeros(len(label), dtype=bool)
    opens[e.first[:-1]] = True
    kind = (label + 1) // 2  # 0 none, else the kind
    begins = (label > 0) & ((label % 2 == 1) | opens | (kind != np.concatenate([[0], kind[:-1]])))
    for b in np.nonzero(begins)[0]:
        t = b + 1
        while t < len(label) and label[t] > 0 and not begins[t]:
            t += 1
        k, s, z = int(e.text_of[b]), int(e.start[b]), int(e.end[t - 1])
        s, z = _trimmed(texts[k], s, z, labelled.KINDS[kind[b] - 1])
        name = labelled.KINDS[kind[b] - 1]
        if z <= s or not holds(name, texts[k][s:z]) or (name in ("identity_number", "street_address") and _INSIDE.search(texts[k][max(0, s - 1) : s])):
            continue
        last = out[k][-1] if out[k] else None
        if last and s < last[1]:  # extended into the one before: the two are one
            out[k][-1] = (last[0], max(z, last[1]), last[2])
        elif last and name == last[2] == "person_name" and texts[k][last[1] : s] == ", ":  # family name, given name
            out[k][-1] = (last[0], z, name)
        else:
            out[k].append((s, z, name))
    return out


#: A sign after which no number or address starts: it would be the inside of a longer code.
_INSIDE = re.compile(r"[A-Za-z0-9+/=]$")
_IN_LOCAL = re.compile(r"[\w.+%-]")


def _trimmed(text: str, s: int, z: int, kind: str) -> tuple[int, int]:
    """The mention from its first sign on: a sign that belongs to it but is no token of it is taken in, one that does not is left out."""
    if kind == "phone":
        while s < z and not (text[s].isdigit() or text[s] in "+("):
            s += 1
        if text[s : s + 1] == "(" and ")" not in text[s:z]:  # a bracket around the mention
            s += 1
        return s - (s > 0 and text[s - 1] == "+"), z
    while s < z and not text[s].isalnum():
        s += 1
    if kind == "email":  # the local part goes back to its beginning, however long it is
        while s > 0 and _IN_LOCAL.match(text[s - 1]):
            s -= 1
        while s < z and not text[s].isalnum():
            s += 1
    return s, z


def _pieces(b: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    size = b[text].str.len().fillna(0).cumsum()
    for _, part in b.groupby((size // CHARACTERS).astype(int), sort=False):
        yield part


def names(staff: DataFrame, most: int = MOST_SHIPPED) -> tuple[list[str], list[str]] | None:
    """Given and family names of a staff list that is short enough to be sent to the workers; None if it is longer."""
    one = staff.select("given_name", "family_name").distinct().limit(most + 1).collect()
    if len(one) > most:
        return None
    return sorted({x.given_name for x in one if x.given_name}), sorted({x.family_name for x in one if x.family_name})


def word_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over text_key, text: each text's distinct words in the form of lists of names."""
    for b in batches:
        rows = [(k, w) for k, t in zip(b["text_key"], b["text"]) for w in {crf.plain_word(m.group()) for m in crf.TOKEN.finditer(t or "") if m.group()[0].isalpha()}]
        yield pd.DataFrame(rows, columns=["text_key", "word"])


def name_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over given_name, family_name: the words that a list of them adds, with what they are."""
    for b in batches:
        f = crf.Features([g for g in b["given_name"] if g], [n for n in b["family_name"] if n])
        yield pd.DataFrame([(w, True, False) for w in sorted(f.given)] + [(w, False, True) for w in sorted(f.family)], columns=["word", "given", "family"])


def with_listed(texts: DataFrame, staff: DataFrame) -> DataFrame:
    """texts with listed: the words of each text that a staff list of any length has; the words are joined with the list.

    Equal texts are looked up once. A word that stands in a third of all texts is spread by salt.
    """
    keyed = texts.select("table_name", "record_id", "text", F.sha2("text", 256).alias("text_key"))
    words = keyed.where(F.length("text") > 0).groupBy("text_key").agg(F.first("text").alias("text")).mapInPandas(worker(__name__, "word_batches"), "text_key string, word string")
    listed = staff.select("given_name", "family_name").mapInPandas(worker(__name__, "name_batches"), "word string, given boolean, family boolean").groupBy("word").agg(F.max("given").alias("given"), F.max("family").alias("family"))
    hot = hot_keys(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), ["word"], "n")
    found = salted_join(words, listed, ["word"], hot).groupBy("text_key").agg(F.collect_list(F.struct("word", "given", "family")).alias("listed"))
    return keyed.join(found, "text_key", "left").select("table_name", "record_id", "text", "listed")


def _parts(b: pd.DataFrame, staff: tuple[list[str], list[str]] | None) -> Iterator[tuple[pd.DataFrame, list]]:
    """Parts of a batch with the mentions of their texts; without a staff list each batch brings the listed words of its texts."""
    for part in _pieces(b, "text"):
        if staff is None:
            f = crf.Features()
            for words in part["listed"]:
                for w in words if words is not None else ():
                    f.given |= {w["word"]} if w["given"] else set()
                    f.family |= {w["word"]} if w["family"] else set()
        else:
            f = features(*map(tuple, staff))
        yield part, mentions([t or "" for t in part["text"]], f)


def mention_batches(batches: Iterator[pd.DataFrame], staff: tuple[list[str], list[str]] | None) -> Iterator[pd.DataFrame]:
    """For mapInPandas over table_name, record_id, text (and listed, if staff is None): the mentions."""
    for b in batches:
        for part, found in _parts(b, staff):
            rows = [(a, r, k, s, z, t[s:z]) for a, r, t, ms in zip(part["table_name"], part["record_id"], part["text"], found) for s, z, k in ms]
            yield pd.DataFrame(rows, columns=["table_name", "record_id", "kind", "start_codepoint", "end_codepoint", "mention"])


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for each mention."""
    out, at = [], 0
    for s, z, kind in sorted(found):
        out += [text[at:s], f"<{kind.upper()}>"]
        at = z
    return "".join(out) + text[at:]


def redact_batches(batches: Iterator[pd.DataFrame], staff: tuple[list[str], list[str]] | None) -> Iterator[pd.DataFrame]:
    """For mapInPandas over table_name, record_id, text (and listed): the redacted texts and how many mentions they had."""
    for b in batches:
        for part, found in _parts(b, staff):
            yield pd.DataFrame({"table_name": part["table_name"], "record_id": part["record_id"], "text": [None if t is None else redact(t, x) for t, x in zip(part["text"], found)], "mentions": [len(x) for x in found]})


def _through(texts: DataFrame, staff: DataFrame, name: str, schema: str, most_shipped: int) -> DataFrame:
    prepare_workers(texts.sparkSession)
    rows, listed = texts.select("table_name", "record_id", "text"), names(staff, most_shipped)
    return (rows if listed is not None else with_listed(rows, staff)).mapInPandas(worker(__name__, name, listed), schema)


def find_mentions(texts: DataFrame, staff: DataFrame, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """table_name, record_id, kind, start_codepoint, end_codepoint, mention of texts (table_name, record_id, text)."""
    schema = "table_name string, record_id string, kind string, start_codepoint long, end_codepoint long, mention string"
    return _through(texts.where(F.length("text") > 0), staff, "mention_batches", schema, most_shipped)


def redacted(texts: DataFrame, staff: DataFrame, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """table_name, record_id, text with placeholders, number of mentions."""
    return _through(texts, staff, "redact_batches", "table_name string, record_id string, text string, mentions int", most_shipped)


if __name__ == "__main__":
    from pathlib import Path

    m = fit(*labelled.sentences())
    rows = np.nonzero(np.abs(m["weights"]).max(axis=1) > 0.03)[0]
    np.savez_compressed(Path(__file__).with_name(WEIGHTS), rows=rows.astype(np.int32), values=m["weights"][rows].astype(np.float16), step=m["step"], opening=m["opening"])
