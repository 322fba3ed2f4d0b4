"""Tables that are computed once and read again: Parquet in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this driver has written and not deleted yet.
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Without one, a folder of a single machine will do in local mode alone; a cluster must name one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = getattr(spark, "_glyphora_store", None)
        if not where:
            where = spark._glyphora_store = "file://" + tempfile.mkdtemp(prefix="glyphora-")
    return where.rstrip("/")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back.

    It outlives lost executors, and cuts the plan of what is built on it. `clean` deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes what `materialized` has written: results that build on it must have been saved."""
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
