"""Session helpers: building a session, shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "mailsieve") -> SparkSession:
    """Session for tests and the bench.  On a cluster use the cluster's session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # bound the Arrow batches handed to the MIME job: mails can be MBs each
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
        .config("spark.driver.memory", "16g")
        # a file-stream micro-batch indexes its new files by path; cap the
        # listing job's tasks instead of one task per file
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", "64")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    It is read from the session (`spark.checkpoint.dir` or the context's
    checkpoint dir).  Only when neither is set and the master is local - a
    test - a folder under the system temp dir is created and registered; on a
    cluster that is an error, as executors would not see the driver's folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="mailsieve-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/mailsieve-{name}-{uuid.uuid4().hex[:12]}"


OPEN_COST = 1 << 14  # bytes that opening a small file counts for when files are dealt to tasks


@contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """Settings under which actions on very many small files run: a task a core lists them, and tasks hold about a
    core's share of their bytes.  With Spark's own, listing the files of a micro-batch takes a task a file and a scan
    one for every 32, each of which sends its metrics to the driver.  The session's values are put back afterwards."""
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(spark.sparkContext.defaultParallelism),
              "spark.sql.files.openCostInBytes": str(OPEN_COST)}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared checkpoint folder and read it
    back: later actions reuse it and its lineage is cut (a lost executor
    costs a re-read, not a recomputation)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


SPREAD_FROM, SPREAD_TO = 1 << 19, 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scanned table with its rows dealt to all cores, where it is too small for its files to do that.

    A table of one file with one row group is read by one task, and all narrow
    work on it follows there.  From SPREAD_TO bytes a core on, the files' own
    splits are enough and nothing is moved; below SPREAD_FROM in all it is not
    worth a shuffle.  Filters and column choices still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if SPREAD_FROM <= size < cores * SPREAD_TO else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))
