"""Benchmark decontamination by pigeonhole edit matching.

A text that holds a test item with at most k edits holds at least one of the item's k + 1 pieces
unchanged. All pieces are looked for at once in one pass over each whole text; around each hit
Myers' bit-parallel algorithm finds the smallest edit distance to any part of the text there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import prepare

# edits allowed per character of an item
ERROR_RATE = 0.05
# shorter items (normalised) are found as whole words only, without edits
SHORT_ITEM_CHARS = 20
# characters of items searched at once; more items take more passes over the texts
BLOCK_CHARS = 500_000

_OTHER = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    """Lower-case letters and digits, all else one space."""
    return _OTHER.sub(" ", text.lower()).strip()


def distance_within(pattern: str, text: str, limit: int) -> int | None:
    """Smallest edit distance of `pattern` to any substring of `text`, or None if above `limit`.

    Myers' bit vectors: bit i of `up` and `down` says whether the distance of the first i + 1
    characters of the pattern is one more or one less than that of the first i.
    """
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = mask, 0, m
    best = score
    for c in text:
        same = at.get(c, 0)
        level = (((same & up) + up) ^ up) | same
        right_up = down | ~(level | up) & mask
        right_down = up & level
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
            if score < best:
                best = score
        right_up = right_up << 1 & mask  # a match may begin anywhere: nothing is shifted in
        right_down = right_down << 1 & mask
        cross = same | down
        up = right_down | ~(cross | right_up) & mask
        down = right_up & cross
    return best if best <= limit else None


class Matcher:
    """Finds items in texts with at most `rate` edits per character."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items, pieces = [], {}
        for item_id, text in items:
            n = len(text)
            k = int(rate * n) if n >= SHORT_ITEM_CHARS else 0
            at = len(self.items)
            self.items.append((item_id, text, k))
            for j in range(k + 1):
                lo, hi = j * n // (k + 1), (j + 1) * n // (k + 1)
                pieces.setdefault(text[lo:hi], []).append((at, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, edits) of every item that the whole text holds."""
        if not text or not self.items:
            return []
        text = normalise(text)
        near: dict[int, list[tuple[int, int]]] = {}
        short: set[int] = set()
        for end, (size, where) in self.automaton.iter(text):
            for at, offset in where:
                _, item, k = self.items[at]
                if len(item) < SHORT_ITEM_CHARS:
                    if text[max(0, end - size):end + 1 - size] in ("", " ") and text[end + 1:end + 2] in ("", " "):
                        short.add(at)
                    continue
                lo = max(0, end + 1 - size - offset - k)
                hi = min(len(text), end + 1 - size - offset + len(item) + k)
                windows = near.setdefault(at, [])
                if windows and lo <= windows[-1][1] and lo >= windows[-1][0]:
                    windows[-1] = (windows[-1][0], max(hi, windows[-1][1]))
                else:
                    windows.append((lo, hi))
        found = [(self.items[at][0], 0) for at in sorted(short)]
        for at, windows in near.items():
            item_id, item, k = self.items[at]
            best = None
            for lo, hi in windows:
                part = text[lo:hi]
                edits = 0 if item in part else distance_within(item, part, k)
                if edits is not None and (best is None or edits < best):
                    best = edits
                if best == 0:
                    break
            if best is not None:
                found.append((item_id, best))
        return found


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for r in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        text = normalise(r.text or "")
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.item_id, text))
        size += len(text)
    if block:
        yield block


def _matches(docs: DataFrame, block: list[tuple[int, str]], rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(block, rate)
            rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.find(t)]
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())], names=["doc_id", "item_id", "edits"])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint, edits int")


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits for every document and test item in it.

    docs: doc_id, text; benchmark: item_id, text; other columns are not looked at. Texts are compared
    as lower-case letters and digits. Null and empty texts hold nothing, null items and those without
    letter or digit are not searched; items under SHORT_ITEM_CHARS characters are held only as whole
    words without edits. Texts of any length are searched whole. A repeated document row or item row gives repeated result rows. Empty
    tables give an empty result. The benchmark is read in blocks of `block_chars` characters, each
    searched in one pass over the documents.
    """
    prepare(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = None
    for block in _blocks(benchmark, block_chars):
        hits = _matches(plain, block, rate)
        found = hits if found is None else found.union(hits)
    return found if found is not None else docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, edits int")


def _clean_udf(block: list[tuple[int, str]], rate: float):
    made: list[Matcher] = []

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Matcher(block, rate))
        return pd.Series([not made[0].find(t) for t in texts], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no test item, with all their columns, whatever their names.

    Decided row by row where each row is read; nothing is shuffled. Cases as in contaminations().
    """
    prepare(docs.sparkSession)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    out, text = docs.toDF(*plain), plain[docs.columns.index("text")]
    for block in _blocks(benchmark, block_chars):
        out = out.filter(_clean_udf(block, rate)(F.col(text).cast("string")))
    return out.toDF(*docs.columns)
