"""Readers for the driver's Parquet tables (column-pruned at the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows of a task that parses and maps JSON.
ROWS_PER_TASK = 20_000


def spread(df: DataFrame) -> DataFrame:
    """A table's rows dealt out evenly, a task for every ``ROWS_PER_TASK`` of them.

    Parsing and mapping JSON is CPU-bound, and a Parquet row group is read by one task
    whatever its number of splits, so the splits of a scan say nothing about how many
    tasks have rows. The rows are counted from the files' footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_PER_TASK)))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
