"""Exact substring dedup: bytes of 200-byte strings that occur twice, by bucket-pointer refinement.

Every 200-byte string is owned by one place inside it, where the smallest of the hashes of its 64-byte
grams begins (the leftmost of equal ones). That place depends on the string alone, so equal strings
meet in the bucket of the gram at their place, and a bucket holds one row for all neighbouring strings
of one place. Rows whose strings are equal as a whole are one class; a class of several rows is
repeated. Where a bucket holds different classes, it is refined by the gram's neighbours: the bucket of
the bytes behind the place, and of those before it. Within the refined buckets the suffixes are sorted:
the first buckets are those of 50 bytes, and each round sorts by the bucket numbers of a suffix and of
a later offset, so that numbers of 50 bytes give those of 100 and these, used again, those of 200.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import cut_lineage, prepare, stored
from crawlspark.session import BROADCAST_BYTES

WINDOW = 200
GRAM = 64  # a power of two
FIRST = WINDOW // 4  # bytes of the first buckets, doubled twice
GRAMS = WINDOW - GRAM + 1  # grams of a string
# a string reaches at least so far behind its gram, or else before it
REACH = (WINDOW - GRAM) // 2
# a refined bucket with more rows is dealt out by strings
BUCKET_ROWS = 4096
# bytes looked at in one vector step
CHUNK = 1 << 18
GATHERED_BYTES = 2 << 20

_PLACES = 20  # bits of a place within a chunk
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 5) for b in range(256)], np.uint64)
_TIMES = [np.uint64(xxhash.xxh64_intdigest(bytes([k]), 6) | 1) for k in range(9)]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the `size` bytes at each place, by doubling; a last step overlaps."""
    h, have, k = _BYTE[data], 1, 0
    while have < size:
        step = min(have, size - have)
        if len(h) <= step:
            return np.empty(0, np.uint64)
        further = h[step:]
        h = h[:-step] * _TIMES[k]
        h ^= h >> np.uint64(29)
        h += further
        have, k = have + step, k + 1
    h ^= h >> np.uint64(32)
    h *= _TIMES[8]
    return h


def owners(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, strings, place, gram hash) of each run of strings with one place; texts end at `ends`."""
    none = np.empty(0, np.int64)
    h = gram_hashes(data, GRAM)
    if len(h) < GRAMS:
        return none, none, none, none.view(np.uint64)
    low = np.uint64((1 << _PLACES) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= GRAMS:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < GRAMS:
        least = np.minimum(least[:step - GRAMS], least[GRAMS - step:])
    place = (least & low).astype(np.int64)
    n = len(place)  # one per string
    text = np.searchsorted(ends, np.arange(n), "right") if len(ends) > 1 else np.zeros(n, np.int64)
    place[np.arange(n) + WINDOW > ends[text]] = -1  # not within one text
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, n])
    real = place[first] >= 0
    first, count = first[real], count[real]
    return first, count, place[first], h[place[first]]


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last + 1, first byte, end) of pieces: several short texts, or an overlapping part of a long one."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[a]), int(offsets[b])
        while hi - lo > 2 * CHUNK:
            yield a, b, lo, lo + CHUNK + WINDOW - 1
            lo += CHUNK
        yield a, b, lo, hi
        a = b


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_hash, text) → one row per run of strings with one place."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(2).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            continue
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        for a, b, lo, hi in _chunks(offsets):
            first, count, place, key = owners(data[lo:hi], offsets[a + 1:b + 1] - lo)
            if not len(first):
                continue
            raw = data[lo:hi].tobytes()
            whole = [digest(raw[x:y]) for x, y in zip(first.tolist(), (first + count + (WINDOW - 1)).tolist())]
            text = a + np.searchsorted(offsets[a + 1:b + 1] - lo, first, "right")
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.array(whole, np.uint64).view(np.int64)), batch.column(0).take(at),
                 batch.column(1).take(at), pa.array((first + lo - offsets[text]).astype(np.int32)),
                 pa.array(count.astype(np.int32)), pa.array((place - first).astype(np.int32))],
                names=["key", "whole", "doc_id", "text_hash", "first", "strings", "place"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the runs wanted of them → the bytes of each run's strings, by the refined bucket of each half."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows = []
        for doc_id, text_hash, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                lo, hi = w["first"], w["first"] + w["strings"] - 1
                s = lo + w["place"]
                # strings that reach far behind the gram, and the others
                middle = max(lo, s - REACH)
                if middle <= hi:
                    rows.append((digest(data[s:s + GRAM + REACH], 1), doc_id, text_hash, middle, w["single"], data[middle:hi + WINDOW]))
                last = min(hi, s - REACH - 1)
                if last >= lo:
                    rows.append((digest(data[s - REACH - 1:s + GRAM], 2), doc_id, text_hash, lo, w["single"], data[lo:last + WINDOW]))
        if rows:
            group, *rest = zip(*rows)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(group, np.uint64).view(np.int64)), *[pa.array(c, k) for c, k in zip(rest, kinds)]],
                names=["group", "doc_id", "text_hash", "first", "single", "bytes"])


def repeated_strings(parts: list[bytes], known: np.ndarray) -> list[np.ndarray]:
    """Per part, which of its strings occur again among all parts; those of `known` parts occur again anyway.

    The suffixes of all parts are sorted by bucket numbers: of FIRST bytes, then by pairs of numbers.
    """
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    _, bucket, rows = np.unique(gram_hashes(data, FIRST), return_inverse=True, return_counts=True)
    strings = sizes - WINDOW + 1
    of = np.repeat(np.arange(len(parts)), strings)
    at = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings) + begins[of]
    # a string with a piece that is alone in its bucket is alone
    alone = rows[bucket] == 1
    open_ = ~(alone[at] | alone[at + FIRST] | alone[at + 2 * FIRST] | alone[at + 3 * FIRST])
    again = np.zeros(len(of), bool)
    live = at[open_]
    if len(live):
        places = np.concatenate([live, live + 2 * FIRST])
        _, half = np.unique(bucket[places] << 32 | bucket[places + FIRST], return_inverse=True)
        n = len(live)
        _, number, rows = np.unique(half[:n] << 32 | half[n:], return_inverse=True, return_counts=True)
        sure = np.zeros(len(rows), bool)
        sure[number[known[of[open_]]]] = True
        again[open_] = (rows > 1)[number] | sure[number]
    return np.split(again, np.cumsum(strings)[:-1])


def _runs(again: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, again, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


_COVER = "doc_id bigint, text_hash int, first int, strings int"


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by refined bucket → runs of repeated strings; a bucket may span batches, so its rows are kept until it ends."""
    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group = rows.column("group").to_numpy()
        shared = np.r_[False, group[1:] == group[:-1]] | np.r_[group[1:] == group[:-1], False]
        rows = rows.filter(pa.array(shared))
        if not rows.num_rows:
            return
        known = ~rows.column("single").to_numpy(zero_copy_only=False)
        found = [(k, lo, hi) for k, again in enumerate(repeated_strings(rows.column("bytes").to_pylist(), known))
                 if not known[k] for lo, hi in _runs(again)]
        if found:
            k, lo, hi = (np.array(c) for c in zip(*found))
            some = rows.select(["doc_id", "text_hash", "first"]).take(pa.array(k)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [some.column(0).combine_chunks(), some.column(1).combine_chunks(),
                 pa.array((some.column(2).to_numpy() + lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                names=["doc_id", "text_hash", "first", "strings"])

    waiting, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        held += batch.column("bytes").nbytes
        if held < GATHERED_BYTES:
            continue
        rows = pa.Table.from_batches(waiting)
        groups = rows.column("group").to_numpy()
        ended = np.flatnonzero(groups != groups[-1])
        done = int(ended[-1]) + 1 if len(ended) else 0
        if done:
            yield from out(rows.slice(0, done))
        waiting = rows.slice(done).combine_chunks().to_batches()
        held = sum(b.column("bytes").nbytes for b in waiting) if done else 0
    if waiting:
        yield from out(pa.Table.from_batches(waiting))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large refined buckets → one row per string, by its 128-bit hash."""
    for batch in batches:
        for doc_id, text_hash, first, single, data in zip(*(c.to_pylist() for c in batch.columns[1:])):
            n = len(data) - WINDOW + 1
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i:i + WINDOW]) for i in range(n)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array([doc_id] * n, pa.int64()),
                 pa.array([text_hash] * n, pa.int32()), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array([single] * n)],
                names=["h1", "h2", "doc_id", "text_hash", "first", "single"])


def _identified(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash(text).alias("text_hash"), text.alias("text"))


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))


def _with_texts(texts: DataFrame, per_doc: DataFrame, name: str) -> DataFrame:
    """doc_id, text_hash, text and a column of stored rows about texts.

    Where their ids measure small they are broadcast, so that only texts they name are moved.
    """
    number = F.xxhash64("doc_id", "text_hash")
    if 16 * per_doc.count() <= BROADCAST_BYTES:
        ids = per_doc.select(number.alias("number"))
        texts = texts.withColumn("number", number).join(F.broadcast(ids), "number", "left_semi").drop("number")
    about = per_doc.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), name)
    return texts.join(about, _same()).select("doc_id", "text_hash", "text", name)


def covers(texts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text_hash, first, strings: runs of places at which a repeated string begins.

    texts: doc_id, text_hash, text. Equal rows stand for as many documents.
    """
    rows = stored(texts.filter(F.octet_length("text") >= WINDOW).mapInArrow(
        _seeds, "key bigint, whole bigint, doc_id bigint, text_hash int, first int, strings int, place int"), "seeds")
    # both sides of the join are dealt out for it alone, so that a frequent key's partition can be split
    met = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"))
    again = stored(rows.join(met, "key", "left_semi"), "met_seeds")
    run = F.struct("doc_id", "text_hash", "first", "strings", "place")
    classes = stored(again.groupBy("key", "whole").agg(F.count("*").alias("times"), F.min(run).alias("run")), "classes")
    copies = again.join(classes.filter("times > 1").select("key", "whole"), ["key", "whole"], "left_semi").select(
        "doc_id", "text_hash", "first", "strings")

    mixed = cut_lineage(
        classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("times").alias("least")).filter("classes > 1 AND least = 1")
        .select("key"))
    compared = classes.join(mixed, "key", "left_semi")
    wanted = F.struct("run.first", "run.strings", "run.place", (F.col("times") == 1).alias("single"))
    per_doc = stored(compared.groupBy("run.doc_id", "run.text_hash").agg(F.collect_list(wanted).alias("wanted")), "wanted")
    parts = stored(_with_texts(texts, per_doc, "wanted").mapInArrow(
        _refined, "group bigint, doc_id bigint, text_hash int, first int, single boolean, bytes binary"), "refined")
    large = stored(parts.groupBy("group").agg(F.count("*").alias("rows")).filter(F.col("rows") > bucket_rows).select("group"), "large")
    some = large.count()
    if 8 * some <= BROADCAST_BYTES:
        large = F.broadcast(large)
    small = parts.join(large, "group", "left_anti") if some else parts
    found = small.repartition("group").sortWithinPartitions("group").mapInArrow(_sorted_buckets, _COVER)
    if some:
        strings = stored(parts.join(large, "group", "left_semi").select(*parts.columns).mapInArrow(
            _strings, "h1 bigint, h2 bigint, doc_id bigint, text_hash int, first int, single boolean"), "strings")
        twice = strings.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min("single").alias("alone")).filter("times > 1 OR NOT alone")
        found = found.union(
            strings.filter("single").join(twice, ["h1", "h2"], "left_semi").select("doc_id", "text_hash", "first", F.lit(1).alias("strings")))
    return copies.union(found)


def merged(runs: list[int]) -> list[tuple[int, int]]:
    """Maximal removed (begin, end) from runs, each first * 2^32 + strings."""
    out: list[tuple[int, int]] = []
    for r in sorted(runs):
        lo, hi = r >> 32, (r >> 32) + (r & 0xFFFFFFFF) + WINDOW - 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def removed(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text_hash, spans (begin, end in bytes, to be removed), kept (the bytes left) of each text that loses bytes.

    docs: doc_id and text; other columns are not looked at. Rows equal in doc_id and text are documents
    of their own that lose the same bytes; they are one row here. Null texts, and texts under 200 bytes,
    lose nothing. Very long texts are read in overlapping parts.
    """
    prepare(docs.sparkSession)
    texts = _identified(docs)
    run = F.col("first").cast("bigint") * (1 << 32) + F.col("strings")
    per_doc = stored(covers(texts, bucket_rows).groupBy("doc_id", "text_hash").agg(F.collect_set(run).alias("runs")), "covers")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data, gone = text.encode("utf-8", "surrogatepass"), merged(runs)
                spans.append([{"begin": a, "end": b} for a, b in gone])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *[e for _, e in gone]], [*[b for b, _ in gone], len(data)])))
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "text_hash", "spans", "kept"])

    found = _with_texts(texts, per_doc, "runs").mapInArrow(
        cut, "doc_id bigint, text_hash int, spans array<struct<begin: int, end: int>>, kept binary")
    return found


def digests(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A text that loses nothing is hashed where it is read. The cases are those of `removed`; a null text
    counts as empty. An empty table gives an empty result.
    """
    cut = removed(docs, bucket_rows).select(
        F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    # equal rows give equal results
    once = stored(cut.distinct(), "cut")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = _identified(docs).select(
        "doc_id", "text_hash", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("whole_sha256"))
    zero = F.lit(0).cast("bigint")
    return whole.join(once, _same(), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
