"""Session helpers: tuned builder, durable cut points, runtime-sized broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that suit both a laptop and a cluster; everything else is left to
# the cluster's own defaults file.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("larkfield")
    settings = {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder used to cut lineage: the cluster's ``spark.checkpoint.dir`` when named.

    A private folder is made only for local masters, where driver and
    executors share one disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="larkfield-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


#: Spark deletes the shuffle files of an action at its end instead of when the driver's memory is next collected.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage so that losing executors loses no work, keeps the rows
    columnar, and gives later joins the real size of the table. The shuffle files of the write are deleted after it,
    and so are the tables in ``spent`` (see :func:`drop`) and those named with :func:`last_read`.
    """
    spark = df.sparkSession
    folder = work_folder(spark, "table")
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)
    drop(*spent, *getattr(df, "_last_read", ()))
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def last_read(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df`` with the note that no other reads ``tables``: :func:`durable` deletes them once ``df`` itself is written."""
    df._last_read = [*getattr(df, "_last_read", ()), *tables]
    return df


def drop(*tables: DataFrame) -> None:
    """Delete what :func:`durable` wrote for ``tables``; nothing may read them, or frames made of them, any more."""
    for df in tables:
        folder = df.__dict__.pop("_folder", None)
        if folder:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder, for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4()}")
