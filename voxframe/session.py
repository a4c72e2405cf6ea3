"""Session settings, lineage cuts and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "voxframe", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's checkpoint folder.

    A folder set in code wins over the configured one. Only a local session that
    names none gets a temporary one; a cluster must name a shared folder.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="voxframe-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Unlike a checkpoint, which runs the plan for its count and again for its
    files, the plan runs once; the table is columnar and survives executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that ``cut_lineage`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    own = os.path.join(shared_dir(spark), "voxframe", "stage-")
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for folder in folders:
        if own.split(":", 1)[-1].lstrip("/") not in folder:
            raise ValueError(f"{folder} is not a table of cut_lineage")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now.

    Spark removes them when the driver's JVM collects the plans that made them, which a
    chain of large steps with little work on the driver may not see for long.
    """
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for one written table."""
    return os.path.join(shared_dir(spark), "voxframe", f"{name}-{uuid.uuid4().hex}")
