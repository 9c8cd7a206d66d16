"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; hashes are joined over the whole corpus, and
sentences covered by any but the first occurrence of a repeated run are removed.

A sentence ends at `.`, `!`, `?` before white space, or at a line end, and is cut further so that any
`WINDOW` consecutive words hold a cut: where none of them ends a sentence, after the one of the smallest
hash. Whether a place is cut depends on fewer than `WINDOW` words to either side, so the pieces inside a
passage are the same wherever it stands, and a piece has at most `WINDOW` words. Any 51 words hold a run:
36 of them are cut alike whatever stands around, and a first cut and a run after it take at most 32.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import folders_made, folders_since, prepare, remove_folders, stored

SENTENCES = 3
MIN_WORDS = 15
WINDOW = 8  # a power of two; 6 * WINDOW - 1 words hold a run of three pieces, whatever stands around

_MARKS = ".!?…。！？"
_WORD = re.compile(r"\S+")
_LINE = re.compile(r"\n")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def sentences(text: str) -> tuple[list[int], list[int], list[bytes]]:
    """(end of each piece in characters, its words, its words lower-cased); pieces cover the text."""
    low = [w.encode("utf-8", "surrogatepass") for w in text.lower().split()]
    if not low:
        return [], [], []
    stops = [m.end() for m in _WORD.finditer(text)]
    if len(stops) != len(low):  # a letter whose lower case is white space
        low = [m[0].lower().encode("utf-8", "surrogatepass") for m in _WORD.finditer(text)]
    crc = zlib.crc32
    cut = np.array([text[e - 1] in _MARKS for e in stops])
    ends = np.array(stops)
    # the word before each line end, if there is one
    before = np.searchsorted(ends, [m.start() for m in _LINE.finditer(text)], "right") - 1
    cut[before[before >= 0]] = True
    n = len(low)
    if n >= WINDOW:
        # the smallest of each window, of equal ones the last; sentence ends come before all others
        least = np.where(cut, 0, np.array([crc(w) for w in low], np.int64) + 1) << 30 | np.arange(n, 0, -1)
        step = 1
        while step < WINDOW:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        cut[n - (least & (1 << 30) - 1)] = True
    cut[-1] = True
    last = np.flatnonzero(cut)
    first = np.r_[0, last[:-1] + 1]
    keys = [b" ".join(low[a:b]) for a, b in zip(first.tolist(), (last + 1).tolist())]
    found = ends[last].tolist()
    found[-1] = len(text)
    return found, (last + 1 - first).tolist(), keys


def spans(text: str | None, n: int = SENTENCES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit and 32-bit hash per run, [begin, end] in characters per run).

    From every sentence one run: `n` sentences, or more where these have under `min_words` words.
    """
    none = np.empty((0, 2), np.int64), np.empty((0, 2), np.int32)
    if not text:
        return none
    ends, sizes, keys = sentences(text)
    if len(keys) < n:
        return none
    words = np.r_[0, np.cumsum(sizes)]
    starts = np.arange(len(keys) - n + 1)
    stops = np.maximum(starts + n, np.searchsorted(words, words[starts] + min_words))
    fits = stops <= len(keys)
    starts, stops = starts[fits], stops[fits]
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(keys), _FACTOR)], dtype=np.uint64)
    # sums of hash * factor^place; multiplied by the inverse power a run's sum no longer tells its place
    total = np.cumsum(np.concatenate([np.zeros((1, 2), np.uint64), raw * powers[:-1, None]]), axis=0, dtype=np.uint64)
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(keys), np.uint64(pow(int(_FACTOR), -1, 1 << 64)))], dtype=np.uint64)
    found = (total[stops] - total[starts]) * inverse[starts, None] + (stops - starts).astype(np.uint64)[:, None]
    found[:, 1] >>= np.uint64(32)
    at = np.array([0, *ends])
    return found.view(np.int64), np.stack([at[starts], at[stops]], axis=1).astype(np.int32)


def all_spans(docs: DataFrame, n: int, min_words: int) -> DataFrame:
    """h1, h2, doc_id, text_hash, first, stop of every run of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [spans(t, n, min_words) for t in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(h) for h, _ in found]))
            h = np.concatenate([h for h, _ in found])
            where = np.concatenate([w for _, w in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1].astype(np.uint32).view(np.int32)), batch.column(0).take(at),
                 batch.column(1).take(at), pa.array(where[:, 0]), pa.array(where[:, 1])],
                names=["h1", "h2", "doc_id", "text_hash", "first", "stop"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash(text).alias("text_hash"), text.alias("text")).mapInArrow(
        run, "h1 bigint, h2 int, doc_id bigint, text_hash int, first int, stop int")


_RUN = "h1 bigint, h2 int, doc_id bigint, text_hash int, first int, stop int"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of one partition → kind 0: those that occurred before in it; 1: its first row; 2: where its last run began.

    Rows at the very place of a run's first occurrence are equal rows and no repeats.
    """
    part, head, start = TaskContext.get().partitionId(), None, None

    def out(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), *rows.columns], names=["kind", "part", *rows.schema.names])

    for batch in batches:
        if not batch.num_rows:
            continue
        if head is None:
            head = start = batch.slice(0, 1)
            yield out(1, head)
        # the row at which the last run began stands before the batch
        rows = pa.Table.from_batches([start, batch]).combine_chunks().to_batches()[0]
        h1, h2 = (rows.column(c).to_numpy() for c in (0, 1))
        begins = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        began = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
        ids = rows.column(2)
        doc = np.column_stack([np.array(ids.is_null()), ids.fill_null(0).to_numpy(), rows.column(3).to_numpy(), rows.column(4).to_numpy()])
        again = (doc != doc[began]).any(axis=1)
        if again.any():
            yield out(0, rows.filter(pa.array(again)))
        start = rows.slice(int(began[-1]), 1)
    if head is not None:
        yield out(2, start)


def repeated_spans(docs: DataFrame, n: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, first, stop of every run that occurred before, in order of doc_id and place.

    Runs are sorted by ranges over hashes, document and place, so a frequent run is spread over tasks
    like any other, and every row but the first of its hashes is a repeat. Two rows per partition
    reach the driver and settle the borders.
    """
    order = ["h1", "h2", "doc_id", "text_hash", "first"]
    mark = folders_made()
    rows = stored(all_spans(docs, n, min_words), "spans")
    used = folders_since(mark)
    found = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_repeats, f"kind int, part int, {_RUN}"), "repeats")
    remove_folders(docs.sparkSession, used)
    edges = found.filter("kind > 0").orderBy("part", "kind").collect()
    late, last = [], None
    for head, end in zip(edges[::2], edges[1::2]):
        place = lambda r: (r.doc_id, r.text_hash, r["first"])
        goes_on = last is not None and (head.h1, head.h2) == (last.h1, last.h2)
        if goes_on and place(head) != place(last):
            late.append((*place(head), head.stop))
        if not goes_on or (end.h1, end.h2) != (head.h1, head.h2):
            last = end
    repeats = found.filter("kind = 0").select("doc_id", "text_hash", "first", "stop")
    return repeats.union(docs.sparkSession.createDataFrame(late, repeats.schema)) if late else repeats


def covered_runs(ids: DataFrame, n: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, covered: the repeated runs of each document, each once however many rows are equal."""
    run = F.col("first").cast("bigint") * (1 << 32) + F.col("stop")
    # a set, so that a document has at most as many as its sentences
    return repeated_spans(ids, n, min_words).groupBy("doc_id", "text_hash").agg(F.collect_set(run).alias("covered"))


def cut(text: str, covered: np.ndarray) -> tuple[str, int, int]:
    """(text without the covered sentences, characters removed, places they were removed from).

    covered: a number per run, its begin * 2^32 + its end.
    """
    covered = np.sort(np.asarray(covered, np.int64))
    begins, ends = covered >> 32, np.maximum.accumulate(covered & 0xFFFFFFFF)
    opens = np.r_[True, begins[1:] > ends[:-1]]
    begins, ends = begins[opens], ends[np.r_[opens[1:], True]]
    left = [text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)])]
    return "".join(left), int((ends - begins).sum()), len(begins)


def remove_repeats(docs: DataFrame, n: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated sentences cut from `text`, and a struct `dedup` (n_removed: characters,
    n_spans: places they were removed from).

    All other columns are kept, whatever their names. The first occurrence, by doc_id (null first),
    then place, stays; so do texts with fewer sentences or words than a run. Rows equal in doc_id and
    text are one document: both get the same text. Null texts stay null. An empty table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    names = docs.columns
    id_, text = (plain[names.index(c)] for c in ("doc_id", "text"))
    covered = covered_runs(docs.select("doc_id", "text"), n, min_words)

    @F.pandas_udf("text string, n_removed int, n_spans int")
    def cleaned(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = [(t, 0, 0) if r is None else cut(t, r) for t, r in zip(texts, runs)]
        return pd.DataFrame(rows, columns=["text", "n_removed", "n_spans"])

    both = docs.toDF(*plain).withColumn("_hash", F.hash(F.col(text).cast("string"))).join(
        covered, F.col(id_).cast("bigint").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")), "left")
    out = both.withColumn("_clean", cleaned(F.col(text).cast("string"), F.col("covered")))
    kept = [F.col("_clean.text") if c == text else F.col(c) for c in plain]
    return out.select(*kept, F.struct("_clean.n_removed", "_clean.n_spans")).toDF(*names, "dedup")
