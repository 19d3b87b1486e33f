"""Session helpers: a local session for tests and benches, and lineage cuts that survive executor loss."""
from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "tidemark", **conf) -> SparkSession:
    """A session for one machine. On a cluster, pass the session the cluster gives you instead."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors can reach.

    A session on one machine may do without the setting and gets a folder of its own; any other session must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL


_LOCAL: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set to the shared folder where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder, under a new name, and read it back: a lineage cut that survives lost
    executors and that later passes read with pruned columns."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and times of all files below `folder`, by the file system that Spark reads it with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


_STORED: dict[tuple, str] = {}


def is_stored(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether `stored_table` has written this table over the present files in this session."""
    return (spark.sparkContext.applicationId, folder, fingerprint(spark, folder), name) in _STORED


def stored_table(spark: SparkSession, folder: str, name: str, build, partition_by: list[str] = ()) -> DataFrame:
    """Build a table over `folder` once per session and state of its files, write it as parquet to the shared folder, and read it
    from there afterwards, with column pruning, filter pushdown and partition pruning."""
    key = (spark.sparkContext.applicationId, folder, fingerprint(spark, folder), name)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/tidemark/tables/{hashlib.sha256(repr(key).encode()).hexdigest()[:32]}"
        w = build().write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as parquet to the shared folder and go on from there.

    Used where a frame feeds several later passes (ranking, model fits), so that they neither recompute it
    nor depend on executor-local blocks, and read only the columns they need."""
    return written(df, "stage")
