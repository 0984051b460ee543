"""The tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Parts that a table is spread over, for each one that it is read in.
FINER = 16


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table (not a plan with shuffles) dealt out by ``keys`` into so many parts that sorts and windows of one task hold a
    small share of it: their number grows with the table, where shuffles otherwise end in as many parts as there are cores."""
    return df.repartition(df.rdd.getNumPartitions() * FINER, *keys)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. What is read from texts, and what is summed of it, is estimated at
    a small part of its size, so Spark would collect tables of any length on the driver."""
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """A table (not a plan with shuffles) dealt out evenly if it is read in fewer parts than there are cores, for work that
    is heavy per row, as reading texts is. Large tables have more parts than that and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
