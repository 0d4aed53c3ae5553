"""Session helpers: a local session for tests and benches, and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "celltide") -> SparkSession:
    """Session for tests and benches; on a cluster the submitter configures its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CELLTIDE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; elsewhere a missing setting
    is an error, since a machine-local folder dies with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="celltide-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, as a parquet table in the shared checkpoint folder.

    Later reads take only the columns and row groups they need, and the known size lets Spark choose
    joins well. Tables of one application share a folder, which can be removed after it ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/celltide-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(*stored: DataFrame) -> None:
    """Delete tables that ``checkpoint`` returned, once a later stored table has taken their place."""
    for table in stored:
        if path := getattr(table, "_stored_at", None):
            _delete(table.sparkSession, path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that ``checkpoint`` has stored for this application; nothing may read them any more."""
    _delete(spark, f"{checkpoint_folder(spark)}/celltide-{spark.sparkContext.applicationId}")
