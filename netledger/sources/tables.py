"""Parquet and CSV sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; a column list reaches the reader as its read schema."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (),
              max_records_per_file: int = 0) -> None:
    """Snappy parquet that replaces what was there; files can be sorted inside, e.g. by time."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    (
        out.write.mode("overwrite").option("compression", "snappy")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*partition_by).parquet(path)
    )


def write_user_partitioned(df: DataFrame, path: str, user: str, time: str, partitions: int,
                           max_records_per_file: int = 5_000_000) -> None:
    """Cluster rows by user and time: sorted ranges that keep a user together but split a hot user over many files."""
    clustered = df.repartitionByRange(partitions, user, time)
    overwrite(clustered, path, sort_by=[user, time], max_records_per_file=max_records_per_file)


def merge_user_partitioned(spark: SparkSession, path: str, time: str, partitions: int) -> DataFrame:
    """Read a user-clustered directory back as one table in time ranges."""
    return spark.read.parquet(path).repartitionByRange(partitions, time).sortWithinPartitions(time)


def release(tables: Mapping[str, DataFrame], root: str) -> None:
    """Write the finished tables under one root, one directory per name."""
    for name, df in tables.items():
        overwrite(df, f"{root}/{name}")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
