"""Written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanveil-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/spanveil/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: what was costly to compute is computed once, and lineage ends."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def streamed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table folder/name as a stream of files, be it one file or a folder of them.

    A stream's path must be a folder or a pattern: this pattern matches the table alone, in either form. Partition
    values are read from the paths below basePath."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("basePath", folder).parquet(f"{folder}/{{{name}}}")


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if its files come in fewer than two splits a core: small tables are one row group, hence one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores)
