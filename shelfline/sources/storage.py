"""Where jobs may put intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _configured(spark: SparkSession) -> str | None:
    """The folder of the ``spark.checkpoint.dir`` setting, else that of ``setCheckpointDir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    return context.get() if context.isDefined() else None


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names for checkpoints. Only
    a session whose executors are this very process may do without, and uses a folder
    of its warehouse; on a cluster a folder that was not named is an error."""
    configured = _configured(spark)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def _run_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/shelfline-{spark.sparkContext.applicationId}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.mkdirs(hadoop):
        store.deleteOnExit(hadoop)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage,
    and later jobs do not depend on the executors that computed it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
