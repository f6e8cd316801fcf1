"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts the lineage, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str, share: int) -> DataFrame:
    """``df`` written once, and read in as many parts of ``share`` rows as it needs: for tables that many small jobs read again, as fits do."""
    df = written(df, name)
    return df.coalesce(max(1, -(-df.count() // share)))


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
