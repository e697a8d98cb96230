"""One form for texts that look the same.

Canonical form of a text: width, composed and joined forms are resolved, invisible characters dropped, non-breaking blanks made plain,
letters of other scripts written with the Latin letter of the same shape, and the result composed (NFC). Raised and circled
digits, accents, letter case, punctuation and line breaks look different and stay.

Most text is stable. A character class, built once by rule from the Unicode properties of every code point (its quick-check for the
canonical form), finds the unstable places; each segment reaches from the last stable starter before such a place to the next stable
starter behind it, only these segments are normalised, and they are spliced into the unchanged rest. ASCII text has none.

Defined cases: null stays null; empty text stays empty; texts without a visible character have the empty form or blanks only and make
no pair; exact copies are no difference.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.skew import HOT_ROWS, hot_keys, salted_join, skew_join
from lodestone.session import cut, prepare_workers, worker

#: Letters of other scripts and the Latin letter of the same shape, as the public list of confusable characters has them.
SAME_SHAPE = {
    "Cyrillic": {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ӏ": "l"},
    "Greek": {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J", "Ϲ": "C", "ο": "o", "ν": "v", "ϳ": "j", "ϲ": "c"},
    "Armenian": {"Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g"},
    "Cherokee": {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z"},
    "Coptic": {"Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c"},
    "Lisu": {"ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U"},
}
_LATIN = {ord(a): b for letters in SAME_SHAPE.values() for a, b in letters.items()}
#: Characters whose one-character compatibility form looks the same, beside the Roman numerals U+2160 to U+217F.
_SAME_LOOK_ALONE = {0xB5}
#: Control characters that are white space or a line break and so are seen.
_SEEN_CONTROLS = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85}
_JOINER, _EMOJI_STYLE = "\u200d", "\ufe0f"


def _invisible(ch: str) -> bool:
    cp = ord(ch)
    if ud.category(ch) == "Cc":
        return cp not in _SEEN_CONTROLS
    return ud.category(ch) == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x180B, 0x180C, 0x180D)


def _pictograph(ch: str) -> bool:
    return ud.category(ch) in ("So", "Sk") and ord(ch) >= 0x2190


def _resolved(ch: str) -> str:
    """One character without width, joined, no-break and composed forms."""
    d = ud.decomposition(ch)
    if not d:
        return ch
    tag, _, rest = d.rpartition("> ")
    parts = [chr(int(x, 16)) for x in rest.split()]
    cp = ord(ch)
    joined = tag == "<compat" and (len(parts) > 1 and parts[0] != " " and not 0x2474 <= cp <= 0x24B5 or cp in _SAME_LOOK_ALONE or 0x2160 <= cp <= 0x217F)
    if not tag or joined or tag in ("<wide", "<narrow", "<noBreak", "<initial", "<medial", "<final", "<isolated"):
        return "".join(map(_resolved, parts))
    return ch


@lru_cache(maxsize=200_000)
def _form_of(ch: str) -> str:
    if _invisible(ch):
        return ""
    return _resolved(ch).translate(_LATIN)


def _normalised(segment: str) -> str:
    if _JOINER in segment:  # kept only where it joins two pictographs into one
        out = []
        for i, ch in enumerate(segment):
            if ch == _JOINER and 0 < i < len(segment) - 1 and _pictograph(segment[i + 1]):
                before = i - 2 if segment[i - 1] == _EMOJI_STYLE and i > 1 else i - 1
                if _pictograph(segment[before]):
                    out.append(ch)
                    continue
            out.append(_form_of(ch))
        return ud.normalize("NFC", "".join(out))
    return ud.normalize("NFC", "".join(map(_form_of, segment)))


#: Code points that can be unstable lie in these ranges; the rest are unified ideographs, syllables in composed form, private or unassigned.
_RANGES = ((0x00, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xE000, 0xE001), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))


@lru_cache(maxsize=1)
def _unstable() -> re.Pattern:
    """Segments with a character that is not in canonical form or may combine with what is before it, with one character of context.

    A joiner also needs what is behind it.
    """
    every = [chr(cp) for a, b in _RANGES for cp in range(a, b)]
    second = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for ch in every:
        d = ud.decomposition(ch)
        if d and not d.startswith("<") and " " in d:
            second.add(int(d.split()[1], 16))
    found = [ord(ch) for ch in every if ord(ch) in second or ud.combining(ch) or ud.normalize("NFC", _form_of(ch)) != ch]
    ranges, k = [], 0
    while k < len(found):
        j = k
        while j + 1 < len(found) and found[j + 1] == found[j] + 1:
            j += 1
        ranges.append(f"\\U{found[k]:08x}-\\U{found[j]:08x}")
        k = j + 1
    u = "".join(ranges)
    return re.compile(f"[^{u}]?[{u}]+(?:(?<=\\u200d)[^{u}][{u}]*)*")


#: A stretch that may hold an unstable segment: characters beyond visible ASCII, with the character before them.
_STRETCH = re.compile(r"[\t-\r\x20-\x7e]?[^\t-\r\x20-\x7e]+")


@lru_cache(maxsize=200_000)
def _stretch(text: str) -> str:
    return _unstable().sub(lambda m: _normalised(m.group()), text)


def canonical(text: str | None) -> str | None:
    """The canonical form of a text."""
    if not text:
        return text
    return _STRETCH.sub(lambda m: _stretch(m.group()) if len(m.group()) <= 64 else _stretch.__wrapped__(m.group()), text)


def canonical_whole(text: str) -> str:
    """The same by normalising every character, for tests."""
    return _normalised(text)


def canonical_batches(batches: Iterator[pd.DataFrame], text: str, to: str) -> Iterator[pd.DataFrame]:
    """For mapInPandas: the rows with the canonical form of text in column to."""
    for b in batches:
        yield b.assign(**{to: [canonical(t) for t in b[text]]})


def with_canonical(df: DataFrame, text: str = "text", to: str = "canonical") -> DataFrame:
    """df with the canonical form of text in a column named to, which replaces one of that name."""
    df = df.drop(to)
    prepare_workers(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(worker(__name__, "canonical_batches", text, to), f"{fields}, `{to}` string")


#: Exact texts of one form from which the pairs of a form are spread, and of which a part has about as many.
MANY_TEXTS = 1_000


def _looks(docs: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, form, exact of each document with something to see; form, exact, n documents, least id of the texts that share their form).

    Texts are compared by SHA-256. Only forms with at least two exact texts are left, so a group of exact copies alone, however large,
    stays behind before anything is joined.
    """
    c = with_canonical(docs.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.col(text).alias("text")))
    keyed = cut(c.where(F.col("canonical").rlike(r"(?U)\S")).select("id", F.unhex(F.sha2("canonical", 256)).alias("form"), F.unhex(F.sha2("text", 256)).alias("exact")))
    texts = cut(keyed.groupBy("form", "exact").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")))
    several = texts.groupBy("form").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("form")
    return keyed, cut(texts.join(several, "form", "left_semi"))


def same_look_pairs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS, many_texts: int = MANY_TEXTS) -> DataFrame:
    """doc_id_a, doc_id_b (a < b): documents that look the same and are not equal character by character.

    Exact texts are paired first, then their documents. The texts of a form with many, and the documents of a text with many, are spread
    over parts by their number, while the fewer on the other side are repeated for each part.
    """
    keyed, texts = _looks(docs, id_column, text)
    crowded = hot_keys(texts.groupBy("form").agg(F.count(F.lit(1)).alias("texts")), ["form"], "texts", many_texts)
    other = texts.select("form", F.col("exact").alias("other"), F.col("n").alias("m"))
    marked = texts.select("form", "exact", "n").join(F.broadcast(crowded), "form", "left")
    marked = marked.select("form", "exact", "n", F.coalesce(F.pmod(F.xxhash64("exact"), F.col("__salts")).cast("int"), F.lit(0)).alias("part"))
    other = other.join(F.broadcast(crowded), "form", "left").select("form", "other", "m", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0)))).alias("part"))
    # Each pair of texts once, the one with more documents first; it says into how many parts its documents are spread.
    pairs = cut(marked.join(other, ["form", "part"]).where(F.struct("n", "exact") > F.struct("m", "other")).select("form", "exact", "other", F.ceil(F.col("n") / F.lit(hot_rows)).cast("int").alias("parts")))
    hot = cut(hot_keys(texts, ["form", "exact"], "n", hot_rows))
    members = cut(keyed.join(texts.select("form", "exact"), ["form", "exact"], "left_semi"))
    first = salted_join(members.withColumnRenamed("id", "one"), pairs, ["form", "exact"], hot).select("one", "form", F.col("other").alias("exact"), F.pmod(F.xxhash64("one"), F.col("parts")).cast("int").alias("part"))
    repeated = pairs.groupBy("form", F.col("other").alias("exact")).agg(F.max("parts").alias("parts"))
    second = salted_join(members.withColumnRenamed("id", "two"), repeated, ["form", "exact"], hot).select("two", "form", "exact", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = first.join(second, ["form", "exact", "part"])
    return found.select(F.least("one", "two").alias("doc_id_a"), F.greatest("one", "two").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()


def same_look_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, class_id, texts, links: each document with a double of other characters, the least id of its class, the class's different
    texts, and how many documents look the same as it and differ. One row per document, whatever the size of a class."""
    keyed, texts = _looks(docs, id_column, text)
    forms = texts.groupBy("form").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("documents"))
    known = cut(texts.select("form", "exact", "n").join(forms, "form"))
    joined = skew_join(keyed, known, ["form", "exact"], cut(hot_keys(known, ["form", "exact"], "n", hot_rows)))
    return joined.select(F.col("id").alias("doc_id"), "class_id", "texts", (F.col("documents") - F.col("n")).alias("links")).distinct()
