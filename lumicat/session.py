"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Tasks of ``few_files``, unless the cluster runs half as many or more at once.
FEW_FILES = 16


def local_session(app: str = "lumicat", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint folder that was set.

    Only a session on one machine may do without: it uses a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if spark.sparkContext.master.startswith("local["):
        return os.path.join(tempfile.gettempdir(), "lumicat-checkpoints")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def without_folder(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to the checkpoint folder, so that the folder it was read from can go."""
    out = checkpointed(df)
    remove_folder(df.sparkSession, path)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder.

    Its files go with the session's references to it where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def few_files(df: DataFrame) -> DataFrame:
    """``df`` with few partitions, for rows that are few beside the input, before they are written.

    Each file costs the store, and where that is a local file system Spark starts two processes for it, each of which may
    be counted with the executor's whole memory until it runs. What a task holds stays that of one partition before.
    """
    return df.coalesce(max(FEW_FILES, 2 * df.sparkSession.sparkContext.defaultParallelism))
