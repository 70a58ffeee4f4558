"""Session helpers: build a session for tests/bench and resolve the shared
checkpoint folder used to cut lineage in iterative operators."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tabsense") -> SparkSession:
    """Session for local runs.  On a cluster the caller's session wins:
    ``getOrCreate`` returns it unchanged."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABSENSE_DRIVER_MEM", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator of the cluster (a shared,
    fault-tolerant file system) and is only read here.  Only when it is
    unset (local tests) a fresh scratch folder is created and registered.
    """
    current = spark.conf.get(_CKPT_KEY, None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (every executor writes there)")
        # local runs and tests only: a scratch folder on this machine
        current = tempfile.mkdtemp(prefix="tabsense-ckpt-", dir="/tmp")
        spark.conf.set(_CKPT_KEY, current)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def materialize(df, label: str = "stage", group_rows: int | None = None):
    """Cut the lineage of ``df`` by writing it once as Parquet under the
    shared checkpoint folder and reading it back.  Unlike an RDD checkpoint
    the plan runs only once, the files are columnar, and a lost executor
    re-reads files instead of recomputing the lineage.  ``group_rows``: rows
    in a row group at most, for rows that hold many bytes."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tabsense-mat/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    writer = df.write.mode("errorifexists")
    (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)
    return spark.read.parquet(path)


_SHIPPED = "_tabsense_shipped"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: functions that run
    there import it by name.  Only code goes through the driver's folder."""
    import zipfile
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tabsense-core-"), "tabsense_core.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("tabsense", os.path.relpath(full, root)))
    sc.addPyFile(target)
    setattr(sc, _SHIPPED, True)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete what :func:`materialize` writes inside the ``with`` block when the
    block ends.  Results are lazy: write or collect them before that.

    >>> with scratch_scope(spark):
    ...     clean_missing(df).write.parquet(out)
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
