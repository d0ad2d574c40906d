"""Finance answers: purchases, revenue, transfers between users, account balances."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from netledger.functions.timebins import day_of, in_range, ntz
from netledger.operators import stats
from netledger.operators.ledger import retailers
from netledger.params import GB, MB, StudyParams

# Running and one-off costs.
MONTHLY_MAINTENANCE_IDR = 1_300_000
MONTHLY_BACKHAUL_USD = 300.0
INITIAL_COST_USD = 9334.0
REPAIR_COST_USD = 1000.0


def purchases(txns: DataFrame) -> DataFrame:
    return txns.where(F.col("kind") == "purchase")


def _usd(p: StudyParams, idr: Column) -> Column:
    return idr * F.lit(p.idr_to_usd)


def purchase_totals(txns: DataFrame, eligible: DataFrame, p: StudyParams) -> DataFrame:
    """GB and USD bought per eligible user, and USD per active day."""
    sums = purchases(txns).where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.sum("amount_idr").alias("amount_idr"), F.sum("amount_bytes").alias("amount_bytes")
    )
    usd = _usd(p, F.col("amount_idr"))
    return sums.join(eligible.select("user_id", "days_active"), "user_id").select(
        "user_id", "amount_idr", (F.col("amount_bytes") / GB).alias("amount_gb"), usd.alias("amount_usd"),
        F.try_divide(usd, F.col("days_active")).alias("usd_per_day"), "days_active",
    )


def purchase_intervals(consolidated: DataFrame, p: StudyParams) -> DataFrame:
    """Per user: mean, 90 % and 99 % quantile of the seconds between consolidated purchases, from whole microseconds."""
    gaps = consolidated.where(F.col("seconds_since_last").isNotNull()).select(
        "user_id", F.round(F.col("seconds_since_last") * 1_000_000).cast("bigint").alias("us")
    )
    means = gaps.groupBy("user_id").agg((F.sum("us") / F.count("*") / 1_000_000.0).alias("mean"))
    tails = stats.exact_quantiles(gaps, "us", {"q90": 0.9, "q99": 0.99}, ["user_id"])
    seconds = [(F.col(q) / 1_000_000.0).alias(q) for q in ("q90", "q99")]
    return means.join(tails.select("user_id", *seconds), "user_id")


def purchase_interval_cdfs(consolidated: DataFrame, p: StudyParams) -> DataFrame:
    """Distribution over users of the mean and tail intervals, in days. Intervals that differ at all stay apart."""
    names = {"mean": "User's Mean", "q90": "User's 90% Quantile", "q99": "User's 99% Quantile"}
    wide = purchase_intervals(consolidated, p).select(
        "user_id", *[(F.col(c) / 86400.0).alias(label) for c, label in names.items()]
    )
    return stats.cdf(stats.melt(wide, ["user_id"], list(names.values()), "type", "value"), "value", ["type"])


def purchase_amounts(consolidated: DataFrame) -> DataFrame:
    return consolidated.groupBy("amount_bytes").agg(F.count("*").alias("count")).withColumn(
        "amount_mb", F.col("amount_bytes") / MB
    )


def package_stats(txns: DataFrame) -> DataFrame:
    """Sales per package size."""
    mb = F.col("amount_bytes") / MB
    return purchases(txns).where(F.col("amount_bytes").isNotNull()).groupBy("amount_bytes").agg(
        F.count("*").alias("count")
    ).select("amount_bytes", "count", mb.alias("amount_mb"), (mb * F.col("count") / 1000.0).alias("total_gb"))


def user_packages(txns: DataFrame) -> DataFrame:
    return purchases(txns).dropna(subset=["user_id", "amount_bytes"]).groupBy("user_id", "amount_bytes").agg(
        F.count("*").alias("count")
    ).withColumn("bytes_per_package", F.col("count") * F.col("amount_bytes"))


def purchase_counts(txns: DataFrame) -> DataFrame:
    return purchases(txns).where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("purchase_count")
    )


def _both_ways(txns: DataFrame, src: Column, dst: Column, names: tuple[str, str], value: str) -> DataFrame:
    """Sent and received per user from one scan; a side a user never took is NULL."""
    sides = F.array(
        F.struct(F.col("user_id").alias("user"), F.lit(True).alias("sent"), F.col("amount_idr").alias("idr")),
        F.struct(F.col("dest_user_id").alias("user"), F.lit(False).alias("sent"), F.col("amount_idr").alias("idr")),
    )
    long = txns.where(F.col("kind") == "user_transfer").select(F.explode(sides).alias("e")).select(
        F.col("e.user").alias("user_id"), "e.sent", "e.idr"
    ).where(F.col("user_id").isNotNull())
    wide = long.groupBy("user_id").agg(src.alias(names[0]), dst.alias(names[1]))
    return stats.melt(wide, ["user_id"], list(names), "direction", value)


def transfer_counts(txns: DataFrame) -> DataFrame:
    n = lambda test: F.sum(F.when(test, F.lit(1)))
    return _both_ways(txns, n(F.col("sent")), n(~F.col("sent")), ("transfer_src_count", "transfer_dst_count"), "count")


def transfer_sums(txns: DataFrame, p: StudyParams) -> DataFrame:
    s = lambda test: F.sum(F.when(test, F.col("idr")))
    long = _both_ways(txns, s(F.col("sent")), s(~F.col("sent")), ("transfer_src_sum", "transfer_dst_sum"), "idr")
    return long.withColumn("usd", _usd(p, F.col("idr")))


def transfer_sizes(txns: DataFrame, without_receiver: object | None = None) -> DataFrame:
    """Transfers per amount; one receiver (a reseller's partner) can be left out."""
    sent = txns.where(F.col("kind") == "user_transfer")
    if without_receiver is not None:
        sent = sent.where(~F.col("dest_user_id").eqNullSafe(F.lit(without_receiver)))
    return sent.where(F.col("amount_idr").isNotNull()).groupBy("amount_idr").agg(F.count("*").alias("count"))


def topups_cumulative(txns: DataFrame, p: StudyParams) -> DataFrame:
    """Running top-ups per day."""
    daily = txns.where(F.col("kind") == "admin_topup").groupBy(day_of("ts").alias("day")).agg(
        F.sum("amount_idr").alias("amount_idr")
    )
    # One row per day.
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("amount_idr").over(upto)
    return daily.select(
        "day", "amount_idr", running.alias("idr_cumulative"), _usd(p, running).alias("usd_cumulative")
    )


def purchases_by_weekday(txns: DataFrame) -> DataFrame:
    """Five-number summary of the MB bought per day, by day of the week."""
    daily = purchases(txns).groupBy(day_of("ts").alias("day")).agg((F.sum("amount_bytes") / MB).alias("mb"))
    q = lambda x: F.percentile("mb", F.lit(x))
    return daily.groupBy(F.date_format("day", "EEEE").alias("weekday")).agg(
        F.count("*").alias("days"), F.min("mb").alias("minimum"), q(0.25).alias("q25"), q(0.5).alias("median"),
        q(0.75).alias("q75"), F.max("mb").alias("maximum"), F.avg("mb").alias("mean"),
    )


def daily_purchase_variation(txns: DataFrame) -> DataFrame:
    """Coefficient of variation of each user's daily purchases (days with a purchase only)."""
    daily = purchases(txns).where(F.col("user_id").isNotNull()).groupBy(day_of("ts").alias("day"), "user_id").agg(
        (F.sum("amount_bytes") / MB).alias("mb")
    )
    return stats.variation_per_user(daily, "mb")


def costs(spark, p: StudyParams) -> DataFrame:
    """Cost entries in USD: month ends of the study carry the monthly costs, two dates the one-off costs."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(p.min_date.date()), F.lit(p.max_date.date()))).alias("day")
    )
    monthly = _usd(p, F.lit(MONTHLY_MAINTENANCE_IDR)) + F.lit(MONTHLY_BACKHAUL_USD)
    one_off = (
        F.when(F.col("day") == F.lit(p.min_date.date()), F.lit(INITIAL_COST_USD))
        .when(F.col("day") == F.lit(p.outage_end.date()), F.lit(REPAIR_COST_USD)).otherwise(F.lit(0.0))
    )
    recurring = F.when(F.col("day") == F.last_day("day"), monthly).otherwise(F.lit(0.0))
    return days.select("day", F.lit("Costs").alias("series"), (one_off + recurring).alias("usd")).where(
        F.col("usd") > 0
    )


def revenue_cumulative(txns: DataFrame, p: StudyParams, without_top: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    """Running revenue per day, in total and without the biggest spenders, next to running costs."""
    daily = purchases(txns).where(F.col("user_id").isNotNull()).groupBy(day_of("ts").alias("day"), "user_id").agg(
        F.sum("amount_idr").alias("idr")
    )
    users = daily.groupBy("user_id").agg(F.sum("idr").alias("user_idr"))
    ranked = daily.join(stats.rank_min(users, "user_idr", "rank", descending=True).select("user_id", "rank"), "user_id")
    # One pass gives every series as a column; a day without a series' users has no entry for it.
    series = {"Total Revenue": F.lit(True), **{f"Revenue Sans Top {n}": F.col("rank") > n for n in without_top}}
    wide = ranked.groupBy("day").agg(*[F.sum(F.when(t, F.col("idr"))).alias(s) for s, t in series.items()])
    long = stats.melt(wide, ["day"], list(series), "series", "idr").where(F.col("idr").isNotNull())
    entries = long.select("day", "series", _usd(p, F.col("idr").cast("double")).alias("usd")).unionByName(
        costs(txns.sparkSession, p)
    )
    upto = Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return entries.select("day", "series", "usd", F.sum("usd").over(upto).alias("usd_cumulative"))


# --- credit between users ----------------------------------------------------------------------------------------


def user_loans(txns: DataFrame, p: StudyParams, tainted_end: datetime | None = None) -> DataFrame:
    """Transfers between different users that are not resellers, outside the exploit, in the comparison period.

    The period is as long after the lockdown as before it, extended by the length of the exploit window.
    """
    tainted_end = tainted_end or p.exploit_end
    end = p.lockdown + (p.lockdown - p.before_start) + (tainted_end - p.exploit_start)
    outside = (F.col("ts") < ntz(p.exploit_start)) | (F.col("ts") > ntz(tainted_end))
    sent = txns.where(F.col("kind") == "user_transfer").dropna(subset=["user_id", "dest_user_id"])
    return (
        sent.where(F.col("user_id") != F.col("dest_user_id")).where(outside)
        .where(in_range("ts", p.before_start, end))
        .join(retailers(txns), "user_id", "left_anti")
        .withColumn("period", F.when(F.col("ts") < ntz(p.lockdown), "before").otherwise("after"))
    )


def _compared_days(p: StudyParams) -> float:
    return (p.lockdown - p.before_start).days


def loan_matrix(loans: DataFrame, p: StudyParams) -> DataFrame:
    """IDR per day from user to user and period: the cells of the user-by-user matrix that hold money.

    Only users who took part in both periods have cells. All other cells are zero; matrix_users is the number of rows
    and columns of the full matrix.
    """
    users = loans.select("user_id").union(loans.select("dest_user_id")).distinct()
    cells = loans_of_lasting_users(loans).groupBy("timeline", "user_id", "dest_user_id").agg(
        F.sum("amount_idr").alias("idr")
    )
    return cells.select(
        "timeline", "user_id", "dest_user_id", (F.col("idr") / F.lit(float(_compared_days(p)))).alias("idr_per_day")
    ).withColumn("matrix_users", users.agg(F.count("*")).scalar())


def loans_of_lasting_users(loans: DataFrame) -> DataFrame:
    """Transfers whose sender and receiver both took part before as well as after the lockdown."""
    def involved(period: str) -> DataFrame:
        part = loans.where(F.col("period") == period)
        return part.select("user_id").union(part.select("dest_user_id"))

    lasting = involved("before").intersect(involved("after"))
    receivers = lasting.select(F.col("user_id").alias("dest_user_id"))
    return loans.join(lasting, "user_id", "left_semi").join(receivers, "dest_user_id", "left_semi").select(
        "txn_id", "ts", "user_id", "dest_user_id", "amount_idr", F.col("period").alias("timeline")
    )


def loan_rates(loans: DataFrame, p: StudyParams) -> DataFrame:
    """Amount and number of transfers per week and day, by period."""
    days = float(_compared_days(p))
    return loans.groupBy("period").agg(
        F.sum("amount_idr").alias("total_idr"), F.count("*").alias("transfers")
    ).select(
        "period", "total_idr", "transfers", (F.col("total_idr") / (days / 7)).alias("idr_per_week"),
        (F.col("total_idr") / days).alias("idr_per_day"), (F.col("transfers") / (days / 7)).alias("transfers_per_week"),
        (F.col("transfers") / days).alias("transfers_per_day"),
    )


def zero_time_counts(zero_time: DataFrame) -> DataFrame:
    """How many users hardly ever had an empty account, overall and among those active for over 30 days."""
    full, long = F.col("fraction_nonzero") > 0.95, F.col("days_active") > 30
    return zero_time.agg(
        F.count("*").alias("users"), F.count_if(F.col("days_at_zero") == 0).alias("never_zero"),
        F.count_if(full).alias("nonzero_95"), F.count_if(long).alias("active_over_30_days"),
        F.count_if(full & long).alias("nonzero_95_and_over_30_days"),
    ).withColumns(
        {
            "nonzero_95_share": F.try_divide("nonzero_95", "users"),
            "nonzero_95_share_of_long": F.try_divide("nonzero_95_and_over_30_days", "active_over_30_days"),
        }
    )
