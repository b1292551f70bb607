"""Spark session helpers.

The library never owns the cluster configuration: it reads what the
session already says (shuffle partitions, checkpoint folder, AQE) and only
fills in defaults for local runs (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package relies on. AQE re-plans joins at run
# time: a shuffled side that turns out small becomes a broadcast (this is the
# size check behind every "small" join we do not hint), and skewed sort-merge
# partitions are split.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "storeline") -> SparkSession:
    """Session for tests and the bench: local mode, UI off, own checkpoint dir."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.ansi.enabled", "true")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local tests) do we create one under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            # a machine-local folder is not shared by executors: refuse rather than lose data
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
        conf_dir = tempfile.mkdtemp(prefix="storeline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def used_up(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that cut_lineage wrote inside, but for those written with ``keep``.

    For steps whose result is a kept table of its own: no plan reads the others any more."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        jvm = spark.sparkContext._jvm
        for path in made:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files at their end; else they lie until the driver's garbage is collected."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame, name: str = "t", keep: bool = False, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint folder and read it back.

    The folder is the one the session names (``spark.checkpoint.dir``), never a
    machine-local one, so the result survives executor loss: tasks re-read the
    table instead of recomputing a long lineage. Unlike an RDD checkpoint of an
    unpersisted plan, the plan runs once, and later scans are columnar with
    pushdown. The shuffle files of the plan are deleted with the end of the
    write, as nothing reads them any more.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    if not keep and _scope.get() is not None:
        _scope.get().append(path)
    with _shuffles_freed(spark):
        df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.parquet(path)
