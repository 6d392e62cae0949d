from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, if it is so small that its files make fewer full splits than there are cores; else as it is.

    A small file may be one row group and so one task's work, however long that takes in Python. Results don't depend on it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df by hash of ``key`` in as many partitions as hold so many rows each on average, one a core at least.

    A task's work and memory stay the same however large the table, and joins and groups on the key don't shuffle again.
    Results don't depend on it.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, key)
