"""User answers: who is online, how often, and with what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netledger.functions.timebins import day_of, month_end, ntz, outside_outage, week_ending
from netledger.operators import stats
from netledger.operators.privacy import merge_small_orgs
from netledger.params import GB, MB, StudyParams
from netledger.plans.traffic import sum_bytes, total


def _log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def user_label_matrix(flows: DataFrame, eligible: DataFrame, label: str = "category") -> DataFrame:
    """Per (user, label) of eligible users: GB, its log, share of the user's bytes, log of MB per active day.

    Organisations with very few users are merged first. A zero has no logarithm (NULL).
    """
    totals = sum_bytes(flows, ["user_id", label]).select("user_id", label, total().alias("bytes_total"))
    if label == "org":
        totals = merge_small_orgs(totals).groupBy("user_id", "org").agg(F.sum("bytes_total").alias("bytes_total"))
    user_bytes = totals.groupBy("user_id").agg(F.sum("bytes_total").alias("user_bytes"))
    per_user = eligible.select("user_id", "days_active").join(user_bytes, "user_id")
    return totals.join(per_user, "user_id").select(
        "user_id", label, (F.col("bytes_total") / GB).alias("gb"),
        _log10(F.col("bytes_total") / GB).alias("log_gb"),
        F.try_divide(F.col("bytes_total"), F.col("user_bytes")).alias("share"),
        _log10(F.try_divide(F.col("bytes_total") / MB, F.col("days_active"))).alias("log_mb_per_day"),
    )


def user_category_split(flows: DataFrame, n: int = 20) -> DataFrame:
    """GB per (user, category) with the user's group: the n heaviest users and the rest."""
    totals = sum_bytes(flows, ["user_id", "category"]).withColumn("bytes_total", total())
    groups = stats.top_label(totals, "user_id", "bytes_total", n)
    return totals.join(groups, "user_id").select(
        "user_id", "category", (F.col("bytes_total") / GB).alias("gb"), "top_n"
    )


def users_per_hour(flows: DataFrame) -> DataFrame:
    """Distinct users per day and hour."""
    pairs = flows.where(F.col("user_id").isNotNull()).select(
        day_of("start_ts").alias("day"), F.hour("start_ts").alias("hour"), "user_id"
    ).distinct()
    return pairs.groupBy("day", "hour").agg(F.count("*").alias("users"))


def users_time_of_day(flows: DataFrame, p: StudyParams) -> DataFrame:
    normal = users_per_hour(flows).where(outside_outage("day", p.outage_start, p.outage_end))
    wide = stats.mean_q90_q99_max(normal, "users", ["hour"]).select(
        "hour", F.col("max").cast("double").alias("Max"), F.col("q99").alias("99th Percentile"),
        F.col("q90").alias("90th Percentile"), F.col("mean").alias("Mean"),
    )
    return stats.melt(wide, ["hour"], ["Max", "99th Percentile", "90th Percentile", "Mean"], "type", "users")


def user_days(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("user_id").isNotNull()).select(day_of("start_ts").alias("day"), "user_id").distinct()


def registrations(txns: DataFrame, early_users: DataFrame, p: StudyParams) -> DataFrame:
    """Cumulative registered users at the end of each day with a registration.

    A user registers with the first transaction they pay for; users from before the study count from its first moment.
    """
    seen = early_users.select("user_id", ntz(p.min_date).alias("ts")).unionByName(txns.select("user_id", "ts"))
    first = seen.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min("ts").alias("ts"))
    per_day = first.groupBy(day_of("ts").alias("day")).agg(F.count("*").alias("n"))
    # One row per day.
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select("day", F.sum("n").over(upto).alias("registered"))


def users_over_time(flows: DataFrame, txns: DataFrame, early_users: DataFrame, p: StudyParams) -> DataFrame:
    """Registered and daily / weekly / monthly unique users per day of the study, long form.

    Weekly and monthly values stand at the end of their bin and fill backward; registrations fill forward.
    """
    days = user_days(flows)
    unique = lambda bin_, name: days.select(bin_.alias("day"), "user_id").distinct().groupBy("day").agg(
        F.count("*").alias(name)
    )
    spine = flows.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(p.min_date.date()), F.lit(p.max_date.date()))).alias("day")
    )
    # Every month end of the study has a value, zero where nobody was online.
    month_ends = spine.where(F.col("day") == month_end("day"))
    monthly = unique(month_end("day"), "monthly").join(month_ends, "day", "full").fillna(0, ["monthly"])
    wide = (
        spine.join(registrations(txns, early_users, p), "day", "left")
        .join(unique(F.col("day"), "daily"), "day", "left")
        .join(unique(week_ending("day"), "weekly"), "day", "full")
        .join(monthly, "day", "full")
    ).fillna(0, ["daily"])
    filled = stats.fill_forward(wide, "day", "registered")
    for name in ("weekly", "monthly"):
        filled = stats.fill_backward(filled, "day", name)
    names = {
        "registered": "Registered", "monthly": "Unique Monthly Online", "weekly": "Unique Weekly Online",
        "daily": "Unique Daily Online",
    }
    in_study = filled.where(F.col("day") < F.lit(p.max_date.date())).select(
        "day", *[F.col(c).cast("bigint").alias(label) for c, label in names.items()]
    )
    long = stats.melt(in_study, ["day"], list(names.values()), "user_type", "num_users")
    return long.where(F.col("num_users").isNotNull())


def daily_users_7row_mean(flows: DataFrame) -> DataFrame:
    daily = user_days(flows).groupBy("day").agg(F.count("*").alias("users"))
    return stats.rolling_rows(daily, "day", "users", [], "users_7d")


def online_ratio(active: DataFrame) -> DataFrame:
    """Share of active days online: optimistic takes outage days out of the active days, observed does not."""
    online = F.least("days_online", "days_active")
    return active.select(
        "*", F.try_divide(online, F.col("days_active") - F.col("outage_impact_days")).alias("optimistic_online_ratio"),
        F.try_divide(online, F.col("days_active")).alias("observed_online_ratio"),
    )


def online_ratio_cdfs(eligible: DataFrame) -> DataFrame:
    long = stats.melt(
        online_ratio(eligible).select(
            "user_id", F.col("optimistic_online_ratio").alias("Optimistic (ignore outages)"),
            F.col("observed_online_ratio").alias("Observed"),
        ), ["user_id"], ["Optimistic (ignore outages)", "Observed"], "type", "value",
    )
    return stats.cdf(long, "value", ["type"])


def online_vs_usage(flows: DataFrame, eligible: DataFrame) -> DataFrame:
    """Per eligible user: MB per online day against the share of active (non-outage) days online."""
    ratio = F.try_divide(
        F.least("days_online", "days_active"), F.col("days_active") - F.col("outage_impact_days")
    )
    return sum_bytes(flows, ["user_id"]).join(
        eligible.select("user_id", "days_online", ratio.alias("online_ratio")), "user_id"
    ).select("user_id", "online_ratio", "days_online", (total() / MB / F.col("days_online")).alias("mb_per_online_day"))


def users_without_dns(flows: DataFrame, dns: DataFrame) -> DataFrame:
    users = flows.where(F.col("user_id").isNotNull()).select("user_id").distinct()
    return users.join(dns.select("user_id").distinct(), "user_id", "left_anti")


def top_hosts(dns: DataFrame, exclude: tuple[str, ...] = (), containing: str | None = None) -> DataFrame:
    """Answers per host, without some hosts or only those whose name holds a text."""
    hosts = dns.where(F.col("domain_name").isNotNull())
    if exclude:
        hosts = hosts.where(~F.col("domain_name").isin(list(exclude)))
    if containing:
        hosts = hosts.where(F.col("domain_name").contains(containing))
    return hosts.groupBy("domain_name").agg(F.count("*").alias("accesses"))
