"""Driver tables (parquet) with column pruning at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str, busy: bool = False) -> DataFrame:
    """Read one table; selecting ``columns`` here lets the parquet scan prune.
    ``busy``: much work follows for each row, so use every core (:func:`spread`)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if busy else df


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input to all cores.  A scan has at most as many tasks as the files
    have row groups, so a small table may be one task however long its rows take.  An
    input with more splits than there are cores is left as it is: shuffling it would
    cost more than it brings, and its tasks are many anyway."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
