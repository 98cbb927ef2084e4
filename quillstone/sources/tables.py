"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The table name of folder, or columns of it.

    A table of fewer splits than the cluster has cores, which only small ones are, is dealt out to all of them, as every plan over
    it would run on few cores otherwise; larger ones are read as they are, without a shuffle.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    table = table.select(*columns) if columns else table
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose texts are about to be sent to Python: in batches of few megabytes and few rows, whatever their lengths, so that a worker
    holds little at a time. The settings are the session's and stay."""
    for key, value in (("maxBytesPerBatch", "2m"), ("maxRecordsPerBatch", "1000")):
        df.sparkSession.conf.set(f"spark.sql.execution.arrow.{key}", value)
    return df
