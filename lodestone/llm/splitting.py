"""Splitting long texts at natural boundaries, by lexical cohesion.

At every gap between sentences or lines the words before and behind are compared: the cosine of the word counts of two blocks of
BLOCK words. A gap without a blank, as after an ideographic full stop, ends a piece only where the TAIL before it holds no blank. Where
the similarity falls into a valley the topic changes; a valley's depth is how far it lies below the peaks on both sides. A piece ends at
the natural boundary of its size window, which is the later half of the size limit: at the deepest valley; where no sentence
ends there, at the last blank; and only where there is no blank at all, at the limit itself. The next piece starts overlap code points
before that end.

The audit of stored pieces runs the same search over the TAIL before each stored end that is no boundary itself: if it finds a natural
boundary there, the stored end is faulty, and what was found is proposed in its place.

Defined cases: null and empty texts have no pieces; a text within the limit is one piece; pieces are cut from the text as it is and
give it back when joined without their overlaps; blanks are spaces and line breaks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import HOT_ROWS, hot_keys, salted_join
from lodestone.session import cut, prepare_workers, worker

LIMIT, OVERLAP, BLOCK, TAIL = 1000, 100, 40, 300
#: Stored passages of one document that follow each other within a block; the order of blocks carries over their ends.
INDEX_BLOCK = 1024
_WORD = re.compile(r"\w+")
_GAP = re.compile(r"(?<=[.!?。！？…])[ \r\n]+|[\r\n]+|(?<=[。！？])(?=[^ \r\n])")
_BLANKS = " \n\r"
_BLANK = re.compile(r"[ \r\n]+")


def gaps(text: str) -> list[int]:
    """Where a sentence or line starts: natural boundaries between which cohesion is measured."""
    return [m.end() for m in _GAP.finditer(text) if 0 < m.end() < len(text)]


def depths(text: str, at: list[int], block: int = BLOCK) -> list[float]:
    """The depth of the similarity valley at each gap; 0 where there is none."""
    words, ends = [], []
    for m in _WORD.finditer(text):
        words.append(m.group().casefold())
        ends.append(m.end())
    similar, k = [], 0
    for g in at:
        while k < len(ends) and ends[k] <= g:
            k += 1
        a, b = Counter(words[max(0, k - block) : k]), Counter(words[k : k + block])
        dot = sum(n * b[w] for w, n in a.items() if w in b)
        similar.append(dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0)
    n = len(similar)
    left, right = similar[:], similar[:]  # the peaks to both sides: one pass each, as a peak beyond a neighbour that is no lower is that neighbour's
    for i in range(1, n):
        if similar[i - 1] >= similar[i]:
            left[i] = left[i - 1]
    for i in range(n - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            right[i] = right[i + 1]
    return [a + b - 2 * s for a, b, s in zip(left, right, similar)]


def is_boundary(text: str, at: int) -> bool:
    """Whether text can end at a place by itself: at its own end, or beside a blank."""
    return at >= len(text) or text[at] in _BLANKS or (at > 0 and text[at - 1] in _BLANKS)


def natural_boundary(text: str, low: int, high: int, at: list[int], depth: list[float], floor: int, first: int = 0) -> int | None:
    """The natural boundary behind low and up to high: the deepest valley of cohesion, the later of equal ones, else the last blank; None if there is none.

    at, depth: the gaps of the text and their depths, looked at from the first one on. A gap without a blank is none if there is a blank in the
    TAIL before it, back to floor.
    """
    best = None
    while first < len(at) and at[first] <= low:
        first += 1
    while first < len(at) and at[first] <= high:
        g = at[first]
        if (best is None or depth[first] >= depth[best]) and (is_boundary(text, g) or not _BLANK.search(text, max(floor, g - TAIL), g)):
            best = first
        first += 1
    if best is not None:
        return at[best]
    end = max(text.rfind(b, low, high) for b in _BLANKS) + 1
    return end if end > low else None


def natural_end(text: str, start: int, limit: int, at: list[int], depth: list[float], first: int = 0) -> int:
    """The end of a piece from start: the natural boundary of the later half of the limit, else the limit."""
    found = natural_boundary(text, start + limit // 2, start + limit, at, depth, start, first)
    return start + limit if found is None else found


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece in code points."""
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    if overlap >= limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    at = gaps(text)
    depth = depths(text, at)
    out, start, first = [], 0, 0
    while len(text) - start > limit:
        while first < len(at) and at[first] <= start:
            first += 1
        end = natural_end(text, start, limit, at, depth, first)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


def split_batches(batches: Iterator[pd.DataFrame], limit: int, overlap: int) -> Iterator[pd.DataFrame]:
    """For mapInPandas over document_id, text: document_id, passage_index, start_codepoint, end_codepoint, text."""
    columns = ["document_id", "passage_index", "start_codepoint", "end_codepoint", "text"]
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.iloc[at : at + 256]
            yield pd.DataFrame([(d, i, s, e, t[s:e]) for d, t in zip(part["document_id"], part["text"]) for i, (s, e) in enumerate(pieces(t, limit, overlap))], columns=columns)


PIECES = "document_id string, passage_index long, start_codepoint long, end_codepoint long, text string"


def split(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of texts (document_id, text)."""
    prepare_workers(texts.sparkSession)
    return texts.select("document_id", "text").where(F.length("text") > 0).mapInPandas(worker(__name__, "split_batches", limit, overlap), PIECES)


def one_text(texts: DataFrame) -> DataFrame:
    """One row per document_id of texts: exact copies and other versions of a document leave the greatest text."""
    return texts.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max("text").alias("text"))


def in_order(passages: DataFrame) -> DataFrame:
    """Stored passages, exact copies once, with prev_end of the passage before and whether they are the last of their document.

    A document may hold any number of rows: windows run within blocks of passage_index and over the blocks, not over the document.
    """
    p = passages.select("document_id", "passage_index", "start_codepoint", "end_codepoint", "text").distinct().withColumn("block", F.expr(f"passage_index div {INDEX_BLOCK}"))
    order = ["passage_index", "start_codepoint", "end_codepoint", "text"]
    within = Window.partitionBy("document_id", "block").orderBy(*order)
    over = Window.partitionBy("document_id").orderBy("block")
    blocks = p.groupBy("document_id", "block").agg(F.max(F.struct(*order)).alias("x"))
    blocks = blocks.select("document_id", "block", F.lag("x.end_codepoint").over(over).alias("carried"), F.lag("block").over(over).isNotNull().alias("has_before"), F.lead("block").over(over).isNull().alias("last_block"))
    p = p.withColumn("in_block", F.lag("end_codepoint").over(within)).withColumn("place", F.row_number().over(within)).withColumn("last_here", F.lead(F.lit(1)).over(within).isNull())
    p = p.join(blocks, ["document_id", "block"])
    inner = F.col("place") > 1
    return p.select("document_id", "block", "place", *order, F.when(inner, F.col("in_block")).otherwise(F.col("carried")).alias("prev_end"), (~inner & ~F.col("has_before")).alias("is_first"), (F.col("last_here") & F.col("last_block")).alias("is_last"))


def faulty_end(source: str, start: int, end: int, tail: int = TAIL) -> int | None:
    """The natural boundary beside a blank that a piece source[start:end] should have ended at; None if it ends naturally or its tail has none.

    The end of a sentence without a blank, as after an ideographic full stop, is none here: a stored end is held against blanks alone.
    """
    if is_boundary(source, end):
        return None
    piece, low = source[start:end], max(0, end - start - tail)
    window = [g for g in gaps(piece) if is_boundary(piece, g)]
    return None if (found := natural_boundary(piece, low, len(piece), window, depths(piece, window), 0)) is None else start + found


def audit_batches(batches: Iterator[pd.DataFrame], limit: int, overlap: int, tail: int) -> Iterator[pd.DataFrame]:
    """For mapInPandas over document_id, whole, stored (passages in order, with what stands before them): the faults of each passage
    and the end that the search of its window proposes."""
    for b in batches:
        rows = []
        for document, whole, stored in zip(b["document_id"], b["whole"], b["stored"]):
            length = len(whole) if whole is not None else -1
            for r in stored:
                start, end, faults = r["start_codepoint"], r["end_codepoint"], []
                if end - start > limit:
                    faults.append("too_long")
                if whole is None or start < 0 or end < start or r["text"] != whole[start:end]:
                    faults.append("other_text")
                if start != (0 if r["is_first"] else (r["prev_end"] if r["prev_end"] is not None else 0) - overlap):
                    faults.append("wrong_start")
                if r["is_last"] and end != length:
                    faults.append("open_end")
                proposed = None
                if whole is not None and 0 <= start < end < length:
                    proposed = faulty_end(whole, start, end, tail)
                    if proposed is not None:
                        faults.append("unnatural_end")
                if faults:
                    rows.append((document, r["passage_index"], faults, end if proposed is None else proposed))
        yield pd.DataFrame(rows, columns=["document_id", "passage_index", "faults", "proposed_end"])


#: Stored passages of one document that are audited together, with one copy of the document's text.
TOGETHER = 256


def audit(passages: DataFrame, texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tail: int = TAIL, hot_rows: int = HOT_ROWS, together: int = TOGETHER) -> DataFrame:
    """document_id, passage_index, faults, proposed_end of each stored passage that breaks the rules; texts: document_id, text.

    A document's text goes to each group of so many of its passages once and is sliced there.
    """
    prepare_workers(passages.sparkSession)
    p = in_order(passages).withColumn("part", F.expr(f"(place - 1) div {together}"))
    each = F.struct("passage_index", "start_codepoint", "end_codepoint", "text", "prev_end", "is_first", "is_last")
    grouped = p.groupBy("document_id", "block", "part").agg(F.collect_list(each).alias("stored"))
    counts = passages.groupBy("document_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(together)).alias("n"))
    hot = cut(hot_keys(counts, ["document_id"], "n", max(1, hot_rows // together)))
    joined = salted_join(grouped, one_text(texts).withColumnRenamed("text", "whole"), ["document_id"], hot, "left")
    schema = "document_id string, passage_index long, faults array<string>, proposed_end long"
    return joined.select("document_id", "whole", "stored").mapInPandas(worker(__name__, "audit_batches", limit, overlap, tail), schema)
