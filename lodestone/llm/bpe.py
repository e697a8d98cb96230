"""Byte-pair encoding with a public vocabulary, by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token with which the encoding of that prefix can end. Going through the
piece byte by byte, the last token of each prefix is stored: of the tokens that match there, the one whose pair with the last
token of the prefix before it is itself a valid encoding. The token list is then read backwards from the end. Stored this way
an encoding can be continued exactly when bytes are appended, and after an edit only the pieces around it are encoded anew.

A pair of tokens is valid if the merges, applied to the bytes of both, give this pair again; verdicts are kept per process.
Since merges never cross pieces of the pre-splitting pattern, each piece stands alone and frequent pieces are kept as well.

Defined cases: null and empty text give an empty list; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import SparkSession

#: Fixed value: the pattern by which the public vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files lie, unless a query is told otherwise.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Pieces and pair verdicts kept in a process; beyond, the caches start anew. They save time and change no result.
KEPT_PIECES, KEPT_PAIRS, LONGEST_KEPT = 400_000, 1_000_000, 64


class PrefixEncoder:
    """Encodes with the ranks of a .tiktoken file; pattern splits the text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.words = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The merges in order of rank, applied to a short byte string."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1]), i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def valid_pair(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b together are encoded as just these two."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            known = self._pairs[(a, b)] = self.merge(self.words[a] + self.words[b]) == [a, b]
        return known

    def last_tokens(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """last[i]: the token with which the encoding of data[:i + 1] ends. last: what is known of a prefix of data, continued in place."""
        last = [] if last is None else last
        ranks = self.ranks
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):  # the longest candidate first
                token = ranks.get(data[start:end])
                if token is not None and (start == 0 or self.valid_pair(last[start - 1], token)):
                    last.append(token)
                    break
        return last

    def read_back(self, last: list[int]) -> list[int]:
        """The tokens of the whole, from the last tokens of its prefixes."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.words[token])
        return out[::-1]

    def piece(self, text: str) -> tuple[int, ...]:
        """The tokens of one piece."""
        known = self._pieces.get(text)
        if known is None:
            data = text.encode("utf-8")
            whole = self.ranks.get(data)
            known = (whole,) if whole is not None and self._whole(data, whole) else tuple(self.read_back(self.last_tokens(data)))
            if len(text) <= LONGEST_KEPT:
                if len(self._pieces) >= KEPT_PIECES:
                    self._pieces.clear()
                self._pieces[text] = known
        return known

    def _whole(self, data: bytes, token: int) -> bool:
        return len(data) == 1 or self.last_tokens(data)[-1] == token

    def encode(self, text: str | None) -> list[int]:
        """The tokens of a text."""
        out: list[int] = []
        if text:
            known, piece = self._pieces.get, self.piece
            for p in self.pattern.findall(text):
                out += known(p) or piece(p)
        return out

    def count(self, text: str | None) -> int:
        """The number of tokens of a text."""
        known, piece = self._pieces.get, self.piece
        return sum(len(known(p) or piece(p)) for p in self.pattern.findall(text)) if text else 0

    def start(self, text: str = "") -> Encoding:
        """An encoding that can be appended to and edited."""
        return Encoding(self, text)


class Encoding:
    """The encoding of a text by pieces, each with the last tokens of its prefixes."""

    #: Pieces before a change that may come out differently: white space belongs to what follows it.
    REACH = 2

    def __init__(self, encoder: PrefixEncoder, text: str):
        self.encoder, self.text, self.spans, self.last = encoder, "", [], []
        self.append(text)

    def ids(self) -> list[int]:
        """The tokens of the text as it is now."""
        return [t for last in self.last for t in self.encoder.read_back(last)]

    def append(self, more: str) -> None:
        """Adds text at the end; a last piece that only grows is continued from its stored prefixes."""
        old, self.text = self.text, self.text + more
        keep = max(0, len(self.spans) - self.REACH)
        known = {s: (e, last) for (s, e), last in zip(self.spans[keep:], self.last[keep:])}
        del self.spans[keep:], self.last[keep:]
        offset = self.spans[-1][1] if self.spans else 0
        for m in self.encoder.pattern.finditer(self.text, offset):
            was = known.get(m.start())
            last = list(was[1]) if was and was[0] <= m.end() and old[m.start() : was[0]] == self.text[m.start() : was[0]] else None
            self.spans.append(m.span())
            self.last.append(self.encoder.last_tokens(m.group().encode("utf-8"), last))

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]; pieces are encoded anew from REACH before the edit until they fall in step with the old ones."""
        old_spans, old_last, shift = self.spans, self.last, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        first = max(0, sum(1 for _, e in old_spans if e <= start) - self.REACH)
        again = {s: k for k, (s, _) in enumerate(old_spans) if s >= end}
        self.spans, self.last = old_spans[:first], old_last[:first]
        at = old_spans[first][0] if first < len(old_spans) else (old_spans[-1][1] if old_spans else 0)
        for m in self.encoder.pattern.finditer(self.text, at):
            k = again.get(m.start() - shift)
            if k is not None and m.start() >= start + len(new):  # the pattern looks only forward: from here on all pieces are the old ones
                self.spans += [(s + shift, e + shift) for s, e in old_spans[k:]]
                self.last += old_last[k:]
                return
            self.spans.append(m.span())
            self.last.append(self.encoder.last_tokens(m.group().encode("utf-8")))


@lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> PrefixEncoder:
    """The encoder of a vocabulary file, loaded once a process: from folder, or where that is not, from what ship() sent."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return PrefixEncoder(ranks, PATTERN)


def ship(spark: SparkSession, folder: str, vocabulary: str) -> None:
    """On a cluster, sends the vocabulary to workers that may not have the driver's folder."""
    sc, path = spark.sparkContext, os.path.join(folder, f"{vocabulary}.tiktoken")
    if not sc.master.startswith("local[") and sc.master != "local" and os.path.exists(path) and path not in (sent := getattr(sc, "_lodestone_vocabularies", set())):
        sc.addFile(path)
        sc._lodestone_vocabularies = sent | {path}


def encode_batches(batches: Iterator[pd.DataFrame], id_column: str, text: str, folder: str, vocabulary: str) -> Iterator[pd.DataFrame]:
    """For mapInPandas: id and ids of each row."""
    e = encoder(folder, vocabulary)
    for b in batches:
        yield pd.DataFrame({id_column: b[id_column], "ids": [e.encode(t) for t in b[text]]})


def count_batches(batches: Iterator[pd.DataFrame], text: str, folder: str, vocabulary: str) -> Iterator[pd.DataFrame]:
    """For mapInPandas: the rows with tokens in place of the text."""
    e = encoder(folder, vocabulary)
    for b in batches:
        yield b.drop(columns=[text]).assign(tokens=[e.count(t) for t in b[text]])
