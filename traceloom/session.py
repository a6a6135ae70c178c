"""Session settings and the one way this package cuts lineage."""

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # queries that deal their rows by one of several keys set this to false for themselves
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    # a task's memory is what its rows need, some 30 times their compressed bytes when they are grouped: with a
    # fixed number of partitions it grows with the input. AQE joins small partitions to about 8 MB
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
    "spark.sql.files.maxPartitionBytes": "32MB",
    # a scan is judged by its Parquet files, which are up to 25 times smaller than their rows in memory; the
    # driver builds every broadcast, a dozen at once. AQE judges the same side again by the bytes of its rows
    "spark.sql.autoBroadcastJoinThreshold": "512KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keyed streaming state on disk; a batch writes its changes only and snapshots are made behind it
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name="traceloom", master=None, **conf):
    """A session with the settings the operators rely on.

    Joins carry no broadcast hints: Catalyst and AQE broadcast a side only when its measured size
    is under `spark.sql.autoBroadcastJoinThreshold`, and split skewed sort-merge partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark):
    """Apply the runtime-settable settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a table has fewer splits than the session has cores.

    For a plain table read ahead of heavy per-row work; a table with enough splits is returned as it
    is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_local_root = None


def shared_folder(spark):
    """The folder for intermediate tables: `spark.checkpoint.dir` of the session.

    On a cluster that setting names storage every executor reaches, so a lost executor never loses
    an intermediate result. Only a session with no executors of its own (`local[n]`, as in tests)
    falls back to a temporary folder.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None or not os.path.isdir(_local_root):
        scratch = tempfile.TemporaryDirectory(prefix="spark-traceloom-", ignore_cleanup_errors=True)
        atexit.register(scratch.cleanup)
        _local_root = scratch.name
    return _local_root


_marked = set()


def scratch_path(spark, name="t"):
    """A new path in the shared folder; the file system drops it when the application ends."""
    context = spark.sparkContext
    root = f"{shared_folder(spark).rstrip('/')}/traceloom/{context.applicationId}"
    if root not in _marked:
        folder = context._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _marked.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back.

    Used where a result is read several times or a driver loop would otherwise grow its lineage.
    The copy is columnar, so each reader still prunes columns, and its size is known to the
    optimizer.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame):
    """Delete the files of tables that `materialize` wrote, once nothing reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        kind, conf = context._jvm.org.apache.hadoop.fs.Path, context._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            kind(folder).getFileSystem(conf).delete(kind(folder), True)
