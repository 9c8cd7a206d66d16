"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its bytes were measured.
BROADCAST_BYTES = 16 << 20

# Runtime SQL settings the jobs rely on; all may be changed on a live session.
RUNTIME_SETTINGS = {
    # days are UTC days
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # one site may hold a third of all rows: let AQE split its partition in N:1 joins,
    # also where a later step has to shuffle again for it
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the URL caps go up to 5000 per seed: keep the map-side top-k filter for them
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # state of streams lies on disk, not in the memory of the executors
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the cluster names it.

    A temporary folder is used only on a local master, where driver and executors are the
    same machine. On a cluster without the setting the job refuses to start.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the loop jobs call it once per level."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder, for stream sinks and state."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in the file system it lies in, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a folder in the file system it lies in, unless it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def newest_version(spark: SparkSession, path: str) -> int | None:
    """Largest n of the folders v<n> below `path` that were written to their end, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    names = [s.getPath().getName() for s in files.listStatus(at)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and files.exists(done(f"{path}/{n}/_SUCCESS"))]
    return max(found, default=None)


def measured(df: DataFrame, key: str) -> tuple[int, int]:
    """(rows, bytes of the key column): one small job."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(key)), F.lit(0)).alias("b")).first()
    return row.n, row.b


def rows_for_keys(table: DataFrame, keys: DataFrame, key: str, key_bytes: int) -> DataFrame:
    """Rows of a large table whose `key` occurs in `keys`, whose keys were measured.

    Up to the limit the keys are broadcast and the table is filtered where it is read; beyond it
    this is an ordinary shuffled semi join.
    """
    wanted = keys.select(key).distinct()
    if key_bytes <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    return table.join(wanted, key, "left_semi")
