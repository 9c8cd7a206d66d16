"""Merkle dataset manifest with incremental witnesses.

Every document is a leaf. Leaves are numbered along their order, cut into aligned blocks of 16^3 and
appended to an open tree one after the other. A leaf's witness starts empty; whenever a run of
siblings above it completes, the witness is extended by that run. A block ends with its root, and the
roots of all blocks are appended to trees of their own in the same way, round after round, until one
node of each source is left; these are appended to the last tree. What a node finds above itself is
handed down to its block as one row, so no witness is stored per document before the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import prepare, stored

FANOUT = 16
BLOCK_LEVELS = 3
HEX = 64  # characters of a digest

Witness = list[tuple[int, bytes]]  # per level: own place in the run, the digests of the run


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


class OpenTree:
    """A tree that grows at its right end. Witnesses of what was appended grow with it."""

    def __init__(self) -> None:
        self.open: list[list[tuple[bytes, list[Witness]]]] = [[]]  # per level: the run that is not full yet

    def append(self, node: bytes, witness: Witness, level: int = 0, below: list[Witness] | None = None) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        run.append((node, [witness] if below is None else below))
        if len(run) == FANOUT:
            self.complete(level)

    def complete(self, level: int) -> None:
        """The run at this level gets no more siblings: extend the witnesses below, append its digest above."""
        run, self.open[level] = self.open[level], []
        joined = b"".join(node for node, _ in run)
        for place, (_, below) in enumerate(run):
            for witness in below:
                witness.append((place, joined))
        self.append(digest(joined), [], level + 1, [w for _, below in run for w in below])

    def close(self, level: int | None = None) -> bytes:
        """Complete what is open and return the root: the node at `level`, or the one node that remains."""
        at = 0
        while not (at == level if level is not None else len(self.open[at]) == 1 and not any(self.open[at + 1:])):
            if self.open[at]:
                self.complete(at)
            at += 1
        return self.open[at][0][0]


def siblings(witness: Witness) -> bytes:
    return b"".join(run[:HEX * k] + run[HEX * (k + 1):] for k, run in witness)


def fold(node: bytes, witness: Witness) -> bytes:
    """The root above a node, from its witness."""
    for k, run in witness:
        node = digest(run[:HEX * k] + node + run[HEX * (k + 1):])
    return node


def pack(witness: Witness) -> bytes:
    return b"".join(bytes([k, len(run) // HEX]) + run for k, run in witness)


def unpack(data: bytes) -> Witness:
    out, at = [], 0
    while at < len(data):
        size = data[at + 1] * HEX
        out.append((data[at], data[at + 2:at + 2 + size]))
        at += 2 + size
    return out


def leaf(text: Column) -> Column:
    """Digest of a document with this text."""
    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with `pos`: the place within `skey`, along `order`.

    The rows are sorted by ranges over all order columns, so one key is spread over tasks like any
    other; a row counts from the start of its key in its partition, and only the first key of a
    partition goes on from earlier ones. One row per partition reaches the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for key in batch.column("skey").to_pylist():
                n = n + 1 if key == last else 0
                last = key
                at.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())],
                names=[*batch.schema.names, "part", "at"])

    ordered = rows.repartitionByRange("skey", *order).sortWithinPartitions("skey", *order)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes) + ", part int, at bigint"
    counted = stored(ordered.mapInArrow(run, schema), "numbered")
    ends = counted.groupBy("part").agg(
        F.min("skey").alias("first"), F.max(F.struct("skey", "at")).alias("last")).orderBy("part").collect()
    starts, key, n = [], None, 0
    for r in ends:
        start = n if r["first"] == key else 0
        starts.append((r.part, r["first"], start))
        n = r["last"]["at"] + 1 + (start if r["first"] == r["last"]["skey"] else 0)
        key = r["last"]["skey"]
    # one row per partition
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, first string, start bigint"))
    pos = F.col("at") + F.when(F.col("skey") == F.col("first"), F.col("start")).otherwise(0)
    return counted.join(before, "part").withColumn("pos", pos).select(*rows.columns, "pos")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("skey", "block").sortWithinPartitions("skey", "block", "pos")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[dict]]]:
    """Sorted rows → one block at a time, of at most 16^3 nodes and a row of what is above."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["skey"], row["block"]) != at:
                if rows:
                    yield at, rows
                at, rows = (row["skey"], row["block"]), []
            rows.append(row)
    if rows:
        yield at, rows


def _grown(at: tuple[str, int], rows: list[dict], levels: int) -> tuple[bytes, list[Witness]]:
    tree, witnesses = OpenTree(), [[] for _ in rows]
    for row, witness in zip(rows, witnesses):
        tree.append(row["digest"].encode(), witness)
    # only the first block of a key may be the whole tree; any other is a subtree of full height
    return tree.close(levels if at[1] else None), witnesses


def _roots(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _blocks(batches):
            root, _ = _grown(at, rows, levels)
            yield pa.RecordBatch.from_pylist([{"skey": at[0], "pos": at[1], "digest": root.decode()}])

    return run


def _extended(emit: Callable[[dict, Witness, Witness, dict], dict], schema: pa.Schema, levels: int):
    """Blocks headed by the row of what is above them → one row per node, its witness extended by that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _blocks(batches):
            head, nodes = rows[0], rows[1:]
            above = unpack(head["path"])
            _, witnesses = _grown(at, nodes, levels)
            yield pa.RecordBatch.from_pylist([emit(n, w, above, head) for n, w in zip(nodes, witnesses)], schema)

    return run


def _under(nodes: DataFrame, heads: DataFrame, levels: int) -> DataFrame:
    """Nodes in their blocks, each block headed by its row of `heads`."""
    body = nodes.select(
        "skey", F.expr(f"pos div {FANOUT ** levels}").alias("block"), "pos", "digest", "doc_id", "changed",
        F.lit(None).cast("binary").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    none = F.lit(None)
    top = heads.select(
        "skey", "block", F.lit(-1).cast("bigint"), none.cast("string"), none.cast("bigint"), none.cast("string"), "path", "subroot", "root")
    return _by_block(body.union(top))


def _heads(nodes: DataFrame, levels: int) -> DataFrame | None:
    """skey, block, path, subroot of every block of these nodes; None if there is none.

    path: the witness of the block's root in the tree of its key, subroot: the root of that tree.
    """
    blocks = stored(
        _by_block(nodes.withColumn("block", F.expr(f"pos div {FANOUT ** levels}")))
        .mapInArrow(_roots(levels), "skey string, pos bigint, digest string"), "block_roots")
    last = blocks.agg(F.max("pos").alias("pos")).first().pos
    if last is None:
        return None
    if last == 0:
        return blocks.select("skey", F.col("pos").alias("block"), F.lit(b"").alias("path"), F.col("digest").alias("subroot"))
    # the roots are further appends
    none = F.lit(None)
    above = _heads(blocks, levels)
    rows = _under(
        blocks.select("*", none.cast("bigint").alias("doc_id"), none.cast("string").alias("changed")),
        above.withColumn("root", none.cast("string")), levels)
    emit = lambda n, w, above, head: {
        "skey": n["skey"], "block": n["pos"], "path": pack(w + above), "subroot": head["subroot"]}
    schema = pa.schema([("skey", pa.string()), ("block", pa.int64()), ("path", pa.binary()), ("subroot", pa.string())])
    return stored(rows.mapInArrow(_extended(emit, schema, levels), "skey string, block bigint, path binary, subroot string"), "paths")


def _proved(n: dict, w: Witness, above: Witness, head: dict) -> dict:
    whole = w + above
    folded = fold((n["changed"] or n["digest"]).encode(), whole).decode()
    return {
        "doc_id": n["doc_id"], "leaf": n["digest"], "subroot": head["subroot"], "root": head["root"],
        "proof_sha256": sha256(siblings(whole)).hexdigest(), "folded_root": folded, "verified": folded == head["root"],
        "n_levels": len(whole)}


def manifest(docs: DataFrame, tampered: Column, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_levels.

    docs: doc_id, source, lang, n_chars, text; other columns are not looked at. tampered: whether a
    document's text is lower-cased (A-Z) before it is checked against its witness; null counts as no.
    Nulls are part of a leaf as `-`; a null source is a source of its own, a null doc_id comes first.
    Equal rows are leaves of their own next to each other. Long texts are hashed where they are read
    and never move. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    none = F.lit(None)
    leaves = docs.select(
        # null first, then bytewise
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("skey"),
        F.col("doc_id").cast("bigint").alias("doc_id"), leaf(F.col("text").cast("string")).alias("digest"),
        F.when(tampered & F.col("text").isNotNull(), leaf(low)).alias("changed"))
    nodes = numbered(leaves, "doc_id", "digest")
    heads = _heads(nodes, levels)
    final = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_levels int"
    if heads is None:
        return docs.sparkSession.createDataFrame([], final)
    # the sources' roots are the appends of the last tree, which has one key
    sources = heads.filter("block = 0").select(F.lit("").alias("skey"), F.col("skey").alias("of"), F.col("subroot").alias("digest"))
    tops = numbered(sources, "of")
    top_nodes = tops.select("skey", "pos", "digest", none.cast("bigint").alias("doc_id"), F.col("of").alias("changed"))
    rows = _under(top_nodes, _heads(top_nodes, levels).withColumn("root", none.cast("string")), levels)
    emit = lambda n, w, above, head: {"skey": n["changed"], "rest": pack(w + above), "root": head["subroot"]}
    schema = pa.schema([("skey", pa.string()), ("rest", pa.binary()), ("root", pa.string())])
    source_paths = stored(rows.mapInArrow(_extended(emit, schema, levels), "skey string, rest binary, root string"), "source_paths")
    whole = heads.join(source_paths, "skey").withColumn("path", F.concat("path", "rest")).drop("rest")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()),
        ("folded_root", pa.string()), ("verified", pa.bool_()), ("n_levels", pa.int32())])
    return _under(nodes, whole, levels).mapInArrow(_extended(_proved, schema, levels), final)
