"""Prepaid accounts: signed ledger, running balances, early balances, purchase sessions, transfers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from netledger.functions.timebins import day_of, micros_between, ntz, seconds_between
from netledger.operators.scan import linked_sessions, prefix_scan, running_minimum_of_sum, time_bucket

LEDGER_ORDER = ["ts", "txn_id", "leg"]


def is_transfer() -> Column:
    return F.col("kind").isin("user_transfer", "admin_transfer")


def user_ledger(txns: DataFrame) -> DataFrame:
    """Signed account entries in one scan: receivers and top-ups +, senders and purchases -.

    leg orders the two entries of one transfer (credit first), so (ts, txn_id, leg) is unique per user.
    """
    credit = F.struct(F.lit(0).alias("leg"), F.col("dest_user_id").alias("user"), F.col("amount_idr").alias("amount"))
    debit = F.struct(F.lit(1).alias("leg"), F.col("user_id").alias("user"), (-F.col("amount_idr")).alias("amount"))
    entries = (
        F.when(is_transfer(), F.array(credit, debit))
        .when(F.col("kind") == "admin_topup", F.array(credit))
        .when(F.col("kind") == "purchase", F.array(debit))
    )
    return txns.select("txn_id", "ts", F.explode(entries).alias("e")).select(
        "txn_id", "ts", "e.leg", F.col("e.user").alias("user_id"), F.col("e.amount").alias("amount_idr")
    )


def _offsets(ledger: DataFrame, unit: str) -> DataFrame:
    """Balance a user must have held before the log began: minus the lowest running balance, if negative."""
    lows = running_minimum_of_sum(
        ledger, ["user_id"], LEDGER_ORDER, time_bucket("ts", unit), F.col("amount_idr"), "low"
    )
    return lows.where(F.col("low") < 0).select("user_id", (-F.col("low")).alias("offset"))


def early_balances(txns: DataFrame, min_date: datetime, cutoff: datetime | None = None, bucket_unit: str = "hour"
                   ) -> DataFrame:
    """Balance of each user when the study begins; `inferred` marks users who would have gone negative."""
    ledger = user_ledger(txns).where(F.col("user_id").isNotNull())
    if cutoff is not None:
        ledger = ledger.where(F.col("ts") < ntz(cutoff))
    early = (
        ledger.where(F.col("ts") < ntz(min_date)).groupBy("user_id").agg(F.sum("amount_idr").alias("before"))
    )
    offsets = _offsets(ledger, bucket_unit)
    return early.join(offsets, "user_id", "full").select(
        "user_id",
        (F.coalesce("before", F.lit(0)) + F.coalesce("offset", F.lit(0))).cast("bigint").alias("balance_idr"),
        F.col("offset").isNotNull().alias("inferred"),
    )


def early_registered_users(txns: DataFrame, bucket_unit: str = "hour") -> DataFrame:
    """Users whose running balance goes negative: they had an account before the log began."""
    return _offsets(user_ledger(txns).where(F.col("user_id").isNotNull()), bucket_unit).select("user_id")


def running_balances(txns: DataFrame, start: datetime, end: datetime, outlier: tuple[object, datetime] | None = None,
                     bucket_unit: str = "hour", with_next: bool = False) -> DataFrame:
    """Balance after every account entry inside [start, end), lifted so that it never goes negative.

    outlier=(user, moment) drops that user's entries after the moment. with_next adds next_ts, the time of the user's next
    entry that is kept, out of the same scan.
    """
    everything = user_ledger(txns).where(F.col("user_id").isNotNull())
    # Later entries change no earlier balance, so they can go before the scan.
    ledger = everything.where(F.col("ts") < ntz(end))
    if outlier is not None:
        user, moment = outlier
        ledger = ledger.where(~((F.col("user_id") == F.lit(user)) & (F.col("ts") > ntz(moment))))
    scanned = prefix_scan(
        ledger, ["user_id"], LEDGER_ORDER, time_bucket("ts", bucket_unit), sums={"balance": F.col("amount_idr")},
        nexts={"next_ts": F.col("ts")} if with_next else None,
    )
    return (
        scanned.where(F.col("ts") >= ntz(start))
        .join(_offsets(everything, bucket_unit), "user_id", "left")
        .withColumns(
            {
                "balance": F.col("balance") + F.coalesce("offset", F.lit(0)),
                "corrected": F.col("offset").isNotNull(),
            }
        )
        .drop("offset")
    )


def time_at_zero(balances: DataFrame, active: DataFrame, eligible: DataFrame, bucket_unit: str = "hour") -> DataFrame:
    """Per eligible user: days with an empty account and share of the active time. The last entry lasts zero time.

    balances come from running_balances; where they have next_ts already, no further scan is needed.
    """
    nxt = balances if "next_ts" in balances.columns else prefix_scan(
        balances, ["user_id"], LEDGER_ORDER, time_bucket("ts", bucket_unit), nexts={"next_ts": F.col("ts")},
    )
    held = F.coalesce(micros_between("ts", "next_ts"), F.lit(0))
    empty = F.col("balance") <= 0
    per_user = (
        nxt.join(eligible.select("user_id"), "user_id", "left_semi")
        .groupBy("user_id")
        .agg(
            F.coalesce(F.sum(F.when(empty, held)), F.lit(0)).alias("zero_us"),
            F.sum(F.when(~empty, held)).alias("nonzero_us"),
            F.max("corrected").alias("corrected"),
        )
    )
    joined = per_user.join(active.select("user_id", "days_active", "days_since_first_active"), "user_id")
    days_at_zero = F.col("zero_us") / 1_000_000.0 / 86400.0
    share = F.try_divide(days_at_zero, F.col("days_active"))
    return joined.select(
        "user_id", days_at_zero.alias("days_at_zero"),
        (F.col("nonzero_us") / 1_000_000.0 / 86400.0).alias("days_nonzero"), "days_active",
        "days_since_first_active", "corrected", share.alias("fraction_at_zero"),
        (F.lit(1.0) - share).alias("fraction_nonzero"),
    )


def consolidate_purchases(txns: DataFrame, gap_seconds: int = 60, bucket_unit: str = "hour") -> DataFrame:
    """Join purchases that follow the previous one of the user within less than gap_seconds.

    Keeps the first time, sums the amounts, and gives the time since the first purchase of the previous group.

    One exchange for all rows: groups, and the group before each, come out of the same scan (scan.linked_sessions).
    """
    order = ["ts", "txn_id"]
    purchases = txns.where((F.col("kind") == "purchase") & F.col("user_id").isNotNull()).select(
        "user_id", "txn_id", "ts", "amount_bytes", "amount_idr"
    )
    linked = linked_sessions(
        purchases, ["user_id"], order, time_bucket("ts", bucket_unit),
        lambda last, row: micros_between(last["ts"], row["ts"]) >= gap_seconds * 1_000_000, "__first", "__before",
    )
    return linked.groupBy("user_id", "__first").agg(
        F.sum("amount_bytes").alias("amount_bytes"), F.sum("amount_idr").alias("amount_idr"),
        F.max("__before.ts").alias("__before"),
    ).select(
        "user_id", F.col("__first.txn_id").alias("txn_id"), F.col("__first.ts").alias("ts"), "amount_bytes", "amount_idr",
        seconds_between("__before", F.col("__first.ts")).alias("seconds_since_last"),
    )


def self_transfers(txns: DataFrame, after: datetime) -> DataFrame:
    """Transfers of users to themselves after a moment, per day."""
    own = txns.where(is_transfer() & (F.col("user_id") == F.col("dest_user_id")) & (F.col("ts") > ntz(after)))
    return own.groupBy(day_of("ts").alias("day")).agg(
        F.sum("amount_idr").alias("amount_idr"), F.count("*").alias("transfers"),
        F.countDistinct("user_id").alias("users"),
    )


def retailers(txns: DataFrame) -> DataFrame:
    """Accounts that the administrator tops up: resellers, left out of user-to-user analyses."""
    return (
        txns.where((F.col("kind") == "admin_topup") & F.col("dest_user_id").isNotNull())
        .select(F.col("dest_user_id").alias("user_id")).distinct()
    )
