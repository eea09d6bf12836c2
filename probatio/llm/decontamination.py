"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by k = floor(rate * m) edits. Cut into k + 1 pieces, at least
one piece survives any k edits unchanged, so every passage within k edits is found by looking for exact pieces (one
Aho-Corasick pass over a document, for all items at once). Around each hit Myers' bit-parallel algorithm computes the
exact edit distance of the item to the best passage.

Items are the stated query set, documents the corpus: documents never move between tasks, and items are broadcast in
blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import free_name

#: Edits allowed for a character of an item.
ERROR_RATE = 0.08
#: Most characters of items that are broadcast together: a Python worker needs about 90 bytes for each.
BLOCK_CHARS = 1_000_000

_SPACE = re.compile(r"\s")
HITS = "array<struct<item_id:long,distance:int,start:int,length:int>>"


def normalise(text: str) -> str:
    """Lower case, every white-space character a blank; as many code points as before, so offsets hold."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return _SPACE.sub(" ", low)


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of the k + 1 near-equal pieces."""
    cuts = [i * len(text) // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit-parallel matcher of one item."""

    def __init__(self, text: str, k: int):
        self.m, self.k = len(text), k
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.last = (1 << self.m) - 1, 1 << (self.m - 1)

    def best(self, text: str, start: int, stop: int, anchored: bool = False) -> tuple[int, int]:
        """The least distance to a passage of text[start:stop], and its first end; anchored: passages that begin at start."""
        plus, minus, score = self.full, 0, self.m
        least, end = self.m, start
        masks, full, last = self.masks, self.full, self.last
        carry = 1 if anchored else 0
        for j in range(start, stop):
            eq = masks.get(text[j], 0)
            x = eq | minus
            d0 = ((((x & plus) + plus) ^ plus) | x) & full
            hp, hn = (minus | ~(d0 | plus)) & full, plus & d0
            if hp & last:
                score += 1
            elif hn & last:
                score -= 1
            hp = (hp << 1) | carry
            plus = ((hn << 1) | ~(d0 | hp)) & full
            minus = hp & d0 & full
            if score < least:
                least, end = score, j + 1
        return least, end


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, found = [], {}
        self.patterns: dict[tuple[int, bool], Pattern] = {}
        for item_id, text in items:
            text = normalise(text)
            k = int(rate * len(text))
            n = len(self.items)
            self.items.append((item_id, text, k))
            for at, piece in pieces(text, k):
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """The best passage for every item within its budget: least distance, then first end."""
        if not text or not self.items:
            return []
        text = normalise(text)
        diagonals: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                diagonals.setdefault(n, set()).add(end + 1 - size - at)
        return sorted(hit for n, starts in diagonals.items() if (hit := self._verify(text, n, sorted(starts))))

    def _pattern(self, n: int, backward: bool) -> Pattern:
        """The bit masks of an item, made when it is first met; only the latest few are kept."""
        if (n, backward) not in self.patterns:
            if len(self.patterns) >= 512:
                self.patterns.clear()
            _, text, k = self.items[n]
            self.patterns[n, backward] = Pattern(text[::-1] if backward else text, k)
        return self.patterns[n, backward]

    def _verify(self, text: str, n: int, starts: list[int]) -> tuple[int, int, int, int] | None:
        item_id, item, k = self.items[n]
        m = len(item)
        spans: list[list[int]] = []
        for s in starts:
            low, high = max(0, s - k), min(len(text), s + m + k)
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        least, end = k + 1, -1
        for low, high in spans:
            if (at := text.find(item, low, high)) >= 0:
                return item_id, 0, at, m
            if high - low >= m - k:
                d, e = self._pattern(n, False).best(text, low, high)
                if d < least:
                    least, end = d, e
        if least > k:
            return None
        # The passage begins where the reversed item, matched backwards from its end, is as near.
        reverse = text[max(0, end - m - k) : end][::-1]
        length = self._pattern(n, True).best(reverse, 0, len(reverse), anchored=True)[1]
        return item_id, least, end - length, length


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS):
    """The items with text, a list for each block of at most about ``block_chars`` characters."""
    rows = items.select("item_id", "text").where(F.length("text") > 0)
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    for i in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        yield [(row["item_id"], row["text"]) for row in block.orderBy("item_id", "text").toLocalIterator()]


def match_columns(items: DataFrame, text: Column, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> list[Column]:
    """A column of hits (item_id, distance, start, length) for every block of items."""
    spark = items.sparkSession
    return [F.pandas_udf(_finder(spark.sparkContext.broadcast((block, rate))), HITS)(text) for block in item_blocks(items, block_chars)]


def _finder(shared):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(*shared.value)
        for texts in batches:
            yield texts.map(matcher.find)

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return find


def contaminations(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, length: the best passage of every item that a document holds within budget.

    ``start`` and ``length`` are code points of the document's text. Null or empty texts on either side match
    nothing. An item shorter than 1 / rate characters must occur exactly. Ties go to the first end; repeated
    documents or items are matched each; other columns are ignored; an empty table on either side gives no rows.
    """
    found = None
    for column in match_columns(items, F.col("text"), rate, block_chars):
        hits = docs.select("doc_id", "text").select("doc_id", F.explode(column).alias("hit")).select("doc_id", "hit.*")
        found = hits if found is None else found.unionByName(hits)
    return found


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    columns, hits = docs.columns, free_name(docs, "hits")
    for column in match_columns(items, F.col("text"), rate, block_chars):
        docs = docs.withColumn(hits, column).where(F.size(hits) == 0).select(*(f"`{c}`" for c in columns))
    return docs
