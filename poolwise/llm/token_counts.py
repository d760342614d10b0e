"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols.

Of every piece of a text the adjacent pair of lowest merge rank is popped and joined until no pair is left; the
count is the piece's bytes less its merges, and no identifier is ever emitted.  A pair's rank is read off the
vocabulary's merge list, pieces come from its splitting pattern, and strings of its special tokens count as one
token each, which is what the vocabulary's own library does by default.

A null or empty text has no tokens.  Nothing is shuffled; a task holds one batch of texts, the merge table and a
bounded table of pieces already counted.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Pieces whose counts a Python worker remembers (about 150 MB), and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 1_000_000, 40

#: The splitting pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Texts without letters from here on are split by an equal pattern of plain character ranges, which is faster.
LATIN_END = 0x250


def latin_pattern() -> str:
    """``PATTERN`` with its classes written out as ranges below ``LATIN_END``."""
    def ranges(kind: str) -> str:
        inside = [unicodedata.category(chr(c))[0] == kind for c in range(LATIN_END)]
        return "".join(f"\\u{c:04x}" for c in range(LATIN_END) if inside[c])

    letter, number, space = ranges("L"), ranges("N"), r"\t-\r \x85\xa0"
    return (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such a vocabulary: itself, or the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class Counted(dict):
    """Counts of pieces; a piece not yet known is counted when it is asked for."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, piece: str) -> int:
        count = self.count(piece.encode())
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = count
        return count


class Merges:
    """The merge table of a vocabulary file's text, and the counts of pieces."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        symbol: dict[str, int] = {letter: i for i, letter in enumerate(byte_letters())}
        self.byte = list(range(256))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = symbol.setdefault(left + right, len(symbol))
            self.pairs.setdefault((symbol.setdefault(left, len(symbol)), symbol.setdefault(right, len(symbol))), (rank, made))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split_any, self.split_latin = regex.compile(PATTERN).findall, re.compile(latin_pattern()).findall
        self.beyond = regex.compile(rf"[^\u0000-\u{LATIN_END - 1:04x}]").search
        self.known = Counted(self.count_bytes)

    def count_bytes(self, piece: bytes) -> int:
        """Symbols left of a piece after all merges."""
        n = len(piece)
        symbols, pairs = list(piece), self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                found = pairs.get((made, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], made, symbols[k]))
            h = before[i]
            if h >= 0:
                found = pairs.get((symbols[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], symbols[h], made))
        return left

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = [text]
        total = 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        split = self.split_any if self.beyond(text) else self.split_latin
        for part in parts:
            total += sum(map(self.known.__getitem__, split(part)))
        return total


_made: dict[int, Merges] = {}


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512, column: str = "text") -> DataFrame:
    """All columns of ``docs`` and n_bytes, n_tokens, over_limit; columns of these names in ``docs`` are replaced, others stay as they are.

    A null text counts as empty.  Rows are counted one by one, so repeated rows come back as often; no rows give none.
    ``vocabulary_path`` is read on the driver (a vocabulary has a few MB) and broadcast.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = hash(shared.value)
        if key not in _made:
            _made.clear()
            _made[key] = Merges(shared.value)
        merges = _made[key]
        for texts in batches:
            yield pd.Series([merges.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (docs.withColumn("n_tokens", count(text)).withColumn("n_bytes", F.octet_length(text).cast("long"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
