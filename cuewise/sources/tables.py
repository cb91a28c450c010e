"""Reading tables so that small ones use the whole cluster too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to as many tasks as there are cores if it has fewer; a table of many files is left alone.

    A file of one row group is one task, however many cores wait for its texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out by columns to all of the session's shuffle partitions, which adaptive execution then leaves as they are.

    It merges partitions of few bytes, but Python that reads them may need much time for each byte.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
