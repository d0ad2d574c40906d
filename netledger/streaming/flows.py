"""The same cleaning and daily sums on a stream of flow records."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from netledger.operators.canonical import typical_flows
from netledger.schemas import RAW_FLOW


def read_raw_flow_stream(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(RAW_FLOW).format(fmt).load(path)


def deduplicated_flows(raw: DataFrame, lateness: str) -> DataFrame:
    """Canonical typical flows without the copies that arrive within the lateness bound.

    lateness must span the overlap of the archives: the stream leaves out flows that come later still. late_flows finds
    those in a batch run.
    """
    flows = typical_flows(raw).withColumn("start_ts", F.col("start_ts").cast("timestamp"))
    columns = [c for c in flows.columns if c != "flow_id"]
    return flows.withWatermark("start_ts", lateness).dropDuplicatesWithinWatermark(columns)


def late_flows(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch: distinct canonical flows of the archives that the stream did not store, to be added to its result."""
    flows = typical_flows(raw).withColumn("start_ts", F.col("start_ts").cast("timestamp"))
    columns = [c for c in flows.columns if c != "flow_id"]
    distinct = flows.groupBy(*columns).agg(F.min("flow_id").alias("flow_id")).select(*flows.columns)
    same = reduce(and_, [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in columns])
    return distinct.alias("f").join(stored.alias("s"), same, "left_anti")


def daily_user_bytes(flows: DataFrame) -> DataFrame:
    """Bytes per user and day; a day is emitted once the watermark has passed its end."""
    return flows.groupBy(F.window("start_ts", "1 day"), "user_id").agg(
        F.sum("bytes_up").alias("bytes_up"), F.sum("bytes_down").alias("bytes_down")
    ).select(F.to_date("window.start").alias("day"), "user_id", "bytes_up", "bytes_down")
