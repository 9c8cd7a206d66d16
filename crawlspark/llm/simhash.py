"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint carries its Hamming distances to a fixed set of reference
fingerprints. By the triangle inequality two fingerprints at distance d differ by at most d in
every coordinate, so a pair whose largest coordinate difference exceeds the limit is discarded
without looking at it, and the survivors are verified.

Coordinates of random fingerprints crowd around 32, so they cannot partition the pairs on a
cluster. Pairs therefore meet only where they must: of six bit blocks, two fingerprints that
differ in at most four bits agree in at least two, and each of the fifteen block pairs is one
key. Within a key the tables decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import components, cut_lineage, forest, mapped, prepare, stored

WORDS = 4
MAX_BITS = 4
PIVOTS = 16
# a key with more distinct fingerprints than this is dealt out over several tasks
KEY_ROWS = 16_384
# below this size all pairs of many keys are looked at in one vector step
SMALL = 24

_BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
_KEYS = list(combinations(range(len(_BLOCKS)), len(_BLOCKS) - MAX_BITS))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash over word shingles, as a signed number; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = len(parts)
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, n) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: n - words + 1].tolist()
        stops = (ends[words - 1:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, stops)]
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BITS for k in range(8)])
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _references(n: int) -> np.ndarray:
    """Fixed pseudo-random reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(str(k).encode(), 7) for k in range(n)], np.uint64)


def with_fingerprint(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with column `fp` (bigint); null and empty texts have 0."""
    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn("fp", fp(F.col("text").cast("string")))


def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Fifteen rows per fingerprint: block-pair key, fingerprint, its pivot table in two numbers."""
    fp = batch.column(0).to_numpy(zero_copy_only=False)
    u = fp.view(np.uint64)
    table = np.bitwise_count(u[:, None] ^ _references(PIVOTS)[None, :]).astype(np.uint8)
    packed = table.view(np.int64)
    block = [(u >> np.uint64(at)) & np.uint64((1 << size) - 1) for at, size in _BLOCKS]
    keys = [(np.uint64(k) << np.uint64(32)) | (block[i] << np.uint64(11)) | block[j] for k, (i, j) in enumerate(_KEYS)]
    n = len(_KEYS)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, n)),
         *[pa.array(np.tile(packed[:, c], n)) for c in range(PIVOTS // 8)]],
        names=["key", "fp", *[f"p{c}" for c in range(PIVOTS // 8)]])


def _near(fp: np.ndarray, table: np.ndarray, at: np.ndarray, other: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs survive the coordinate test and are within the limit."""
    apart = np.abs(table[at] - table[other]).max(axis=1)
    ok = apart <= limit
    left = np.flatnonzero(ok)
    ok[left] = np.bitwise_count(fp[at[left]] ^ fp[other[left]]) <= limit
    return ok


def _group_links(fp: np.ndarray, table: np.ndarray, limit: int) -> tuple[list, list]:
    """A spanning forest of the links inside one large key, never all its pairs.

    Breadth first: a row is compared with the rows not reached yet only. In a key dealt out over
    several tasks, rows of the same side meet in another task; comparing them here too is harmless.
    """
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.abs(table[rest] - table[x]).max(axis=1) <= limit
            hit = np.flatnonzero(near)
            hit = hit[np.bitwise_count(fp[rest[hit]] ^ fp[x]) <= limit]
            if len(hit):
                found = rest[hit]
                a.extend([x] * len(found))
                b.extend(found.tolist())
                todo.extend(found.tolist())
                rest = np.delete(rest, hit)
    return a, b


def _batch_links(group: np.ndarray, fp: np.ndarray, table: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(group)])
    a, b = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max()))):
        at = np.flatnonzero((group[:-step] == group[step:]) & small[:-step])
        if not len(at):
            break
        at = at[_near(fp, table, at, at + step, limit)]
        a.append(at)
        b.append(at + step)
    for k in np.flatnonzero(sizes > SMALL):
        lo, hi = first[k], first[k] + sizes[k]
        x, y = _group_links(fp[lo:hi], table[lo:hi], limit)
        a.append(np.array(x, np.int64) + lo)
        b.append(np.array(y, np.int64) + lo)
    at = np.concatenate([np.empty(0, np.int64), *a])
    other = np.concatenate([np.empty(0, np.int64), *b])
    return forest(fp[at].view(np.int64), fp[other].view(np.int64))


def _links(limit: int):
    """Rows sorted by group → links; a group may span batches, so its rows are kept until it ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            table = np.ascontiguousarray(rows[:, 2:]).view(np.uint8).astype(np.int16)
            node, root = _batch_links(rows[:, 0], rows[:, 1].copy().view(np.uint64), table, limit)
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

        waiting, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
            if n < 2 * KEY_ROWS:
                continue
            rows = np.concatenate(waiting)
            ended = np.flatnonzero(rows[:, 0] != rows[-1, 0])
            done = int(ended[-1]) + 1 if len(ended) else 0
            if done:
                yield from out(rows[:done])
            waiting, n = [rows[done:]], 0
        if waiting:
            yield from out(np.concatenate(waiting))

    return run


def links(distinct_fps: DataFrame, limit: int = MAX_BITS, key_rows: int = KEY_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints at `limit` (at most 4) or fewer differing bits.

    Not all links: enough of them to join every pair that is linked, directly or through others.
    A key with more than `key_rows` rows is cut into parts and each pair of parts is one group.
    """
    if limit > MAX_BITS:
        raise ValueError(f"the block keys find pairs up to {MAX_BITS} bits")
    p = [f"p{c}" for c in range(PIVOTS // 8)]
    keyed = mapped(distinct_fps.select("fp"), _keyed, "key bigint, fp bigint, " + ", ".join(f"{c} bigint" for c in p))
    several = keyed.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
    met = keyed.join(several, "key").withColumn("parts", F.ceil(F.col("rows") / key_rows).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = met.withColumn("part", part).withColumn(
        "group", F.explode(F.when(F.col("parts") == 1, F.array(F.col("key"))).otherwise(F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda t: F.xxhash64("key", F.least("part", t), F.greatest("part", t))))))
    return (
        dealt.select("group", "fp", *p).repartition("group").sortWithinPartitions("group")
        .mapInArrow(_links(limit), "a bigint, b bigint"))


def _classes(fps: DataFrame, limit: int) -> DataFrame:
    """From stored rows with doc_id and fp: fp, root, component_id of every distinct fingerprint."""
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(distinct, limit))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    # dealt out by itself, so that the partition of a large component can be split in the join
    first = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return rooted.join(first, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, limit: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fp, root (smallest fingerprint of its component), component_id.

    docs: doc_id and text; other columns are not looked at. component_id is the smallest doc_id
    among documents reachable over links, itself included. Null, empty and blank texts share
    fingerprint 0. Rows with equal ids or equal texts are each returned; a null doc_id is the
    component's only if all its ids are null. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    fps = stored(with_fingerprint(docs.select(F.col("doc_id").cast("bigint"), "text"), words).select("doc_id", "fp"), "fps")
    return fps.join(_classes(fps, limit), "fp").select("doc_id", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, limit: int = MAX_BITS) -> DataFrame:
    """The documents with one row of each component left: one with its smallest doc_id.

    All columns are kept, whatever their names; the cases are those of near_duplicates.
    """
    prepare(docs.sparkSession)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (plain[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = stored(with_fingerprint(docs.toDF(*plain).withColumn("text", F.col(text)), words).drop("text"), "docs_fps")
    fps = rows.select(F.col(id_).cast("bigint").alias("doc_id"), "fp")
    kept = (
        fps.join(_classes(fps, limit), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("k"))
        .select(F.col("k.doc_id").alias("kept_id"), F.col("k.fp").alias("kept_fp")))
    found = rows.join(kept, (F.col("fp") == F.col("kept_fp")) & F.col(id_).cast("bigint").eqNullSafe(F.col("kept_id")))
    return found.dropDuplicates(["kept_fp", "kept_id"]).select(*plain).toDF(*docs.columns)
