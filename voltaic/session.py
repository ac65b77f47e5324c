"""Spark session and shared-storage helpers.

The library never picks a machine-local folder on a cluster: anything that cuts lineage or stages a
table goes under the shared folder named by ``spark.checkpoint.dir``. Only when that setting is unset
(local tests, a laptop) does :func:`checkpoint_dir` use a folder of the session's warehouse and register it.
"""

from __future__ import annotations

import os
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library wants; callers may override any of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "voltaic",
                extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint dir). If neither is
    set, a local-mode session (tests) gets a folder in its warehouse; on a cluster this is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for this "
                               "cluster; a machine-local folder would not survive executor loss")
        d = os.path.join(spark.conf.get("spark.sql.warehouse.dir", None) or "spark-warehouse", "_scratch")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_made: list[str] = []          # scratch paths handed out by this process
_own = threading.local()       # .paths: those of this thread's innermost dropping_scratch()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _made.append(path)
    if getattr(_own, "paths", None) is not None:
        _own.paths.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def dropping_scratch(spark: SparkSession):
    """Deletes at the end what this thread staged under :func:`scratch_path` inside. For work whose results are all stored
    elsewhere: no DataFrame made inside can be run afterwards."""
    before, _own.paths = getattr(_own, "paths", None), []
    try:
        yield
    finally:
        own, _own.paths = _own.paths, before
        for path in own:
            delete_path(spark, path)
            if path in _made:
                _made.remove(path)


def drop_scratch(spark: SparkSession) -> int:
    """Deletes what this process staged under :func:`scratch_path` and returns how many paths there were. For the end of a
    job: a DataFrame that reads a staged table can't be run again afterwards. Indexes that are published for later
    sessions stay."""
    gone = 0
    while _made:
        gone += bool(delete_path(spark, _made.pop()))
    return gone


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Every job that runs inside deletes its shuffle files when it is done; else they stay on the executors' disks until the
    driver happens to collect its garbage. For results that are stored or collected once: nothing reads those files again."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table under the shared checkpoint folder and
    reading it back. Like a reliable ``checkpoint()`` it survives executor loss (never a local
    checkpoint), and it is columnar, so the write and the later scans are cheap."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its input fits one file split, which a single task would read; else as it is. For costly
    work per row on small inputs; it never changes a result."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= split else df


def cluster_conf(total_cores: int, checkpoint_dir: str) -> dict[str, str]:
    """Settings for a large cluster run (pass to ``get_session(extra=...)`` or spark-submit).

    * shuffle partitions at ~3x the cores: AQE coalesces small ones and splits skewed ones, so the
      number only has to be large enough for the biggest shuffle (pre-aggregated postings, lines by
      order key) to fit ~128 MB per task;
    * 64 MB input splits: the text tables are CPU-heavy per byte (regex tokenising), so smaller
      splits keep tasks short and even;
    * skew join on, with a partition counted as skewed at 5x the median and 256 MB;
    * the shared checkpoint folder for lineage cuts, staged tables and streaming state;
    * dynamic partition overwrite, so a replayed batch rewrites only its own partition.
    """
    return {
        "spark.sql.shuffle.partitions": str(3 * total_cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.files.maxPartitionBytes": "64m",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.checkpoint.dir": checkpoint_dir,
        "spark.sql.session.timeZone": "UTC",
    }
