"""Tracing of funds created by the self-transfer exploit.

Inside the exploit window a transfer to oneself creates dirty funds. A transfer or purchase of a user who holds dirty
funds spends them (never below zero) and is itself tainted; a tainted transfer passes its full amount to the receiver
as dirty funds.

Given which transfers are tainted, the dirty funds of every user over time are a running sum cut off at zero, which
scans on two levels (operators.scan.floored_balance) however long one user's history is. Whether a row is tainted
depends only on earlier rows, and more inflow never makes a row clean, so starting from the self-transfers and adding
newly tainted transfers until nothing changes gives exactly the sequential result. Only users whose inflow has changed
can have newly tainted rows, so a round traces these alone (semi-naive iteration): a user's spends are traced once per
round in which dirty funds reach them. The number of rounds is the length of the longest chain of hands.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from netledger.functions.timebins import in_range
from netledger.operators.ledger import is_transfer
from netledger.operators.scan import floored_balance, time_bucket
from netledger.session import materialise, scratch_path

_SPEND = ["user_id", "ts", "txn_id", "delta", "dest_user_id", "kind"]


def tainted_transactions(txns: DataFrame, start: datetime, end: datetime, bucket_unit: str = "hour") -> DataFrame:
    """Ids of the tainted transactions.

    A round traces the accounts of the frontier only: the users who received dirty funds in the round before. What it
    finds new is appended to one table, which is all that the next round reads besides the frontier's own spends.
    """
    window = txns.where(in_range("ts", start, end) & F.col("user_id").isNotNull())
    own = F.coalesce(F.col("user_id") == F.col("dest_user_id"), F.lit(False))
    entry = ["user_id", "ts", "txn_id"]
    source = materialise(window.where(own).select(*entry, F.col("amount_idr").alias("delta")), "source")
    spends = materialise(
        window.where(~own & (is_transfer() | (F.col("kind") == "purchase")))
        .select(*entry, (-F.col("amount_idr")).alias("delta"), "dest_user_id", "kind"), "spends"
    )
    path = scratch_path(txns.sparkSession, "tainted")
    schema = T.StructType([*(spends.schema[c] for c in _SPEND), T.StructField("round", T.IntegerType())])
    tainted = txns.sparkSession.createDataFrame([], schema)
    none = lambda c: F.lit(None).cast(spends.schema[c].dataType).alias(c)
    frontier, number = source.select("user_id").distinct(), 0
    while True:
        received = tainted.where(is_transfer() & F.col("dest_user_id").isNotNull()).select(
            F.col("dest_user_id").alias("user_id"), "ts", "txn_id", (-F.col("delta")).alias("delta"), "round"
        )
        if number:
            frontier = received.where(F.col("round") == number - 1).select("user_id").distinct()
        inflow = source.unionByName(received.drop("round"))
        account = spends.select(*_SPEND).unionByName(inflow.select(*entry, "delta", none("dest_user_id"), none("kind")))
        traced = floored_balance(
            account.join(frontier, "user_id", "left_semi"), ["user_id"], ["ts", "txn_id"],
            time_bucket("ts", bucket_unit), F.col("delta"),
        )
        found = traced.where(F.col("kind").isNotNull() & (F.col("balance_before") > 0)).select(*_SPEND)
        fresh = found.join(tainted.select("txn_id"), "txn_id", "left_anti").select(*_SPEND, F.lit(number).alias("round"))
        counted = Observation()
        fresh.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
        if not counted.get["rows"]:
            return source.select("txn_id").unionByName(tainted.select("txn_id"))
        tainted, number = txns.sparkSession.read.schema(schema).parquet(path), number + 1


def untainted_transactions(txns: DataFrame, start: datetime, end: datetime, bucket_unit: str = "hour") -> DataFrame:
    """All transactions outside the window, and the clean ones inside it."""
    return txns.join(tainted_transactions(txns, start, end, bucket_unit), "txn_id", "left_anti")
