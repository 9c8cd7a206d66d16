"""What several operators share: session preparation, Arrow helpers, connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspark.session import cut_lineage, scratch_path

# rows handed to Python at once: texts may be long, so a batch stays at some tens of MB
BATCH_ROWS = 256

_shipped: set[str] = set()
_made: list[str] = []  # folders of stored(), oldest first


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on and send this package's code to the executors (once)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="run-"), "crawlspark_code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; columns of other names never reach an operator."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    Used where rows are read several times: columns can be pruned, lost tasks read files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders_made() -> int:
    """How many folders stored() has made so far: a mark for remove_folders()."""
    return len(_made)


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders in the file system they lie in; the rows of what read them must be written."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folders_since(mark: int) -> list[str]:
    """The folders made since a mark; they are the caller's from then on."""
    found = _made[mark:]
    del _made[mark:]
    return found


def mapped(df: DataFrame, one_batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield one_batch(batch)

    return df.mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not the smallest of its component among these edges."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a):]
    parent = np.arange(len(nodes))
    while len(x):
        low = np.minimum(parent[x], parent[y])
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        open_ = parent[x] != parent[y]
        x, y = x[open_], y[open_]
    linked = parent != np.arange(len(nodes))
    return nodes[linked], nodes[parent[linked]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # a forest has at most as many edges as nodes, so what is held stays below a task's distinct nodes
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 500_000:
            a, b = forest(a, b)
    node, root = forest(a, b)
    if len(node):
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["hi", "lo"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root being the smallest node reachable.

    Alternating large and small stars: each step hangs nodes under the smallest neighbour with
    an aggregation and a join, so no adjacency list is ever gathered, and the depth shrinks by
    a power each round. Every task first contracts its own edges to a forest.

    edges: two bigint columns, any order, loops and repeats allowed; nulls are dropped.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a <> b")
    e = cut_lineage(e.mapInArrow(_contract, "hi bigint, lo bigint"))
    before = None
    while True:
        # large star: of every node's larger neighbours, each is hung under the node's smallest
        both = e.union(e.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node and its smaller neighbours are hung under the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(low, "hi")
        e = cut_lineage(
            linked.select("hi", F.col("m").alias("lo"))
            .union(linked.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).filter("hi <> lo").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                e.select("lo").distinct().select("lo", F.col("lo").alias("root")))
        before = now
