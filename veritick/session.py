"""Session helpers shared by every job: where reliable checkpoints go, and how tables are read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "veritick", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings every job expects: UTC, AQE, Arrow."""
    return (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; in local mode (tests), where none is set, a temporary one."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir")
    if there is None:
        there = sc.getCheckpointDir()
    if there is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(there)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(there)
    return there


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote in the shared one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, so a lost executor costs only its own tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
