"""Tables of a folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes for each core under which an input is dealt out anew.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is small: a file of one row group is one task, however many splits it has. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL * cores else df
