"""Traffic answers: who uses how much of what, and when. Every function takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from netledger.functions.naming import health_primary_domain, is_health, protocol_name
from netledger.functions.timebins import day_of, in_range, outside_outage, week_ending
from netledger.operators import stats
from netledger.operators.activity import restrict_to
from netledger.operators.enrich import nouser_kind, p2p_kind
from netledger.params import GB, ICE, MB, PEER_TO_PEER, UNKNOWN_NO_DNS, UNKNOWN_NOT_MAPPED, StudyParams

_DIRECTIONS = {"Downlink": "bytes_down", "Uplink": "bytes_up"}


def with_day(flows: DataFrame) -> DataFrame:
    return flows if "day" in flows.columns else flows.withColumn("day", day_of("start_ts"))


def total() -> Column:
    return F.col("bytes_up") + F.col("bytes_down")


def sum_bytes(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bytes per key; rows with a NULL key take no part."""
    return flows.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.sum("bytes_up").alias("bytes_up"), F.sum("bytes_down").alias("bytes_down")
    )


def daily_aggregate(flows: DataFrame, key: str) -> DataFrame:
    """Shared intermediate: bytes per user, category / organisation / host name, and day."""
    return sum_bytes(with_day(flows), ["user_id", key, "day"])


def bytes_per_user(flows: DataFrame) -> DataFrame:
    return stats.melt(sum_bytes(flows, ["user_id"]), ["user_id"], ["bytes_up", "bytes_down"], "direction", "amount")


def category_org_day(flows: DataFrame) -> DataFrame:
    return sum_bytes(with_day(flows), ["day", "category", "org"])


def weekly_shares(flows: DataFrame, label: str, keep: int | None = None) -> DataFrame:
    """Weekly GB per label and direction, with the layer order of each direction; keep folds small labels."""
    weekly = sum_bytes(with_day(flows).withColumn("week", week_ending("day")), ["week", label])
    if keep is not None:
        folded = stats.top_or_other(weekly.withColumn("bytes_total", total()), label, "bytes_total", keep)
        weekly = sum_bytes(folded, ["week", label])
    order = stats.layer_order(weekly, label, _DIRECTIONS)
    wide = weekly.select("week", label, (F.col("bytes_down") / GB).alias("Downlink"),
                         (F.col("bytes_up") / GB).alias("Uplink"))
    return stats.melt(wide, ["week", label], list(_DIRECTIONS), "direction", "gb").join(order, [label, "direction"])


def weekly_others(flows: DataFrame, label: str, keep: int) -> DataFrame:
    """Weekly GB of the labels outside the top ones, with their order by total (smallest first)."""
    weekly = sum_bytes(with_day(flows).withColumn("week", week_ending("day")), ["week", label]).withColumn(
        "bytes_total", total()
    )
    others = stats.others_only(weekly, label, "bytes_total", keep)
    sums = others.groupBy(label).agg(F.sum("bytes_total").alias("__sum"))
    # rank by (total, label) over all other labels, without ties
    place = stats.rank_min(sums, "__sum", "__rank")
    within = Window.partitionBy("__rank").orderBy(label)
    order = place.select(label, (F.col("__rank") - 2 + F.row_number().over(within)).alias("order"))
    return others.join(order, label).select("week", label, (F.col("bytes_total") / GB).alias("gb"), "order")


def category_totals(flows: DataFrame) -> DataFrame:
    """GB per category and direction for a log scale: nothing at all counts as one byte."""
    long = stats.melt(sum_bytes(flows, ["category"]), ["category"], ["bytes_up", "bytes_down"], "direction", "bytes")
    bytes_ = F.when(F.col("bytes") == 0, F.lit(1)).otherwise(F.col("bytes"))
    return long.select("category", "direction", (bytes_ / GB).alias("gb"))


def mapped_stats(flows: DataFrame, dimension: str) -> DataFrame:
    """Total, unknown, mappable and mapped GB for organisations or categories."""
    part = lambda label: F.coalesce(F.sum(F.when(F.col(dimension) == label, total())), F.lit(0))
    sums = flows.where(F.col(dimension).isNotNull()).agg(
        F.sum(total()).alias("all"), part(UNKNOWN_NO_DNS).alias("no_dns"), part(UNKNOWN_NOT_MAPPED).alias("no_map")
    )
    mappable = F.col("all") - F.col("no_dns")
    mapped = mappable - F.col("no_map")
    return sums.select(
        F.lit(dimension).alias("dimension"), (F.col("all") / GB).alias("total_gb"),
        (F.col("no_dns") / GB).alias("unknown_no_dns_gb"), (F.col("no_map") / GB).alias("unknown_not_mapped_gb"),
        (mappable / GB).alias("mappable_gb"), (mapped / GB).alias("mapped_gb"),
        F.try_divide(mapped, F.col("all")).alias("mapped_fraction"),
        F.try_divide(mapped, mappable).alias("mapped_fraction_of_mappable"),
    )


def _user_label_totals(flows: DataFrame, label: str) -> DataFrame:
    return sum_bytes(flows, ["user_id", label]).select("user_id", label, total().alias("bytes_total"))


def _label_ranks(totals: DataFrame, label: str, name: str) -> DataFrame:
    sums = totals.groupBy(label).agg(F.sum("bytes_total").alias("__sum"))
    return stats.rank_min(sums, "__sum", name, descending=True).select(label, name)


def label_per_user(flows: DataFrame, eligible: DataFrame, label: str = "category") -> DataFrame:
    """Per eligible user and label: bytes per online day, share of the user's bytes, user rank and label rank."""
    totals = _user_label_totals(flows, label)
    users = totals.groupBy("user_id").agg(F.sum("bytes_total").alias("user_bytes")).join(
        eligible.select("user_id", "days_online"), "user_id"
    ).withColumn("user_bytes_per_online_day", F.col("user_bytes") / F.col("days_online"))
    ranked = stats.rank_min(users, "user_bytes_per_online_day", "user_rank")
    per_day = F.col("bytes_total") / F.col("days_online")
    return (
        totals.join(ranked, "user_id").join(_label_ranks(totals, label, "label_rank"), label)
        .select(
            "user_id", label, "bytes_total", "user_rank", "label_rank", per_day.alias("bytes_per_online_day"),
            F.try_divide(per_day, F.col("user_bytes_per_online_day")).alias("share"),
        )
    )


def label_per_quantile(flows: DataFrame, eligible: DataFrame, label: str = "category", bins: int = 10) -> DataFrame:
    """Means per tenth of the users (by rank of daily use) and label: bytes per online day and share per user."""
    totals = _user_label_totals(flows, label)
    users = totals.groupBy("user_id").agg(F.sum("bytes_total").alias("user_bytes")).join(
        eligible.select("user_id", "days_online"), "user_id"
    ).withColumn("daily", F.col("user_bytes") / F.col("days_online"))
    binned = stats.rank_bins(stats.rank_min(users, "daily", "rank_daily"), "rank_daily", "bin", bins)
    joined = totals.join(binned.select("user_id", "user_bytes", "days_online", "bin"), "user_id")
    means = joined.groupBy("bin", label).agg(
        F.avg("bytes_total").alias("bytes_total"),
        (F.avg(F.col("bytes_total") / F.col("days_online")) / MB).alias("mb_per_online_day"),
        F.avg(F.try_divide(F.col("bytes_total"), F.col("user_bytes"))).alias("share"),
    )
    return means.join(_label_ranks(totals, label, "label_rank"), label)


def day_of_week(flows: DataFrame, p: StudyParams) -> DataFrame:
    """Daily GB of all flows (result of all_flows) with the day's name and an outage mark."""
    daily = flows.groupBy(day_of("start_ts").alias("day")).agg(F.sum("bytes_total").alias("bytes_total"))
    normal = outside_outage("day", p.outage_start, p.outage_end)
    return daily.where(F.col("day").isNotNull()).select(
        "day", F.date_format("day", "EEEE").alias("weekday"), "bytes_total", (F.col("bytes_total") / GB).alias("gb"),
        F.when(normal, "Normal").otherwise("Outage").alias("condition"),
    )


def weekday_means(days: DataFrame) -> DataFrame:
    """Mean GB of normal days per weekday with a 95 % interval."""
    half = F.lit(1.96) * F.stddev_samp("gb") / F.sqrt(F.count("*"))
    return days.where(F.col("condition") == "Normal").groupBy("weekday").agg(
        F.count("*").alias("days"), F.avg("gb").alias("mean_gb"), (F.avg("gb") - half).alias("ci_low"),
        (F.avg("gb") + half).alias("ci_high"),
    )


def low_days(days: DataFrame, below_gb: float = 0.9) -> DataFrame:
    return days.where(F.col("gb") < below_gb)


def mb_per_day_cdfs(flows: DataFrame, active: DataFrame) -> DataFrame:
    """Distribution over users of MB per day online and per day active."""
    users = sum_bytes(flows, ["user_id"]).join(active.select("user_id", "days_online", "days_active"), "user_id")
    mb = total() / MB
    both = users.select(
        "user_id",
        F.explode(F.array(
            F.struct(F.lit("Online Ratio").alias("type"), (mb / F.col("days_online")).alias("mb")),
            F.struct(F.lit("Active Ratio").alias("type"), F.try_divide(mb, F.col("days_active")).alias("mb")),
        )).alias("e"),
    ).select("e.*")
    return stats.cdf(both, "mb", ["type"])


def protocol_weeks(flows: DataFrame) -> DataFrame:
    """Weekly GB per plain protocol name and direction with the layer order."""
    ports = sum_bytes(with_day(flows), ["day", "protocol", "dest_port"])
    return weekly_shares(ports.withColumn("name", protocol_name("protocol", "dest_port")), "name")


def other_udp_ports(flows: DataFrame, n: int = 50) -> DataFrame:
    """Ports behind "Other UDP" with most bytes."""
    sums = sum_bytes(flows.where(F.col("protocol") == 17), ["dest_port"]).withColumn("bytes_total", total())
    other = sums.where(protocol_name(F.lit(17), "dest_port") == "Other UDP")
    return other.select("dest_port", "bytes_total").orderBy(F.desc("bytes_total"), "dest_port").limit(n)


def hourly_category(flows: DataFrame, p2p: DataFrame) -> DataFrame:
    """Bytes per day, hour and category; flows between users form their own category."""
    both = flows.select("start_ts", "category", total().alias("bytes_total")).unionByName(
        p2p.select(
            "start_ts", F.lit(PEER_TO_PEER).alias("category"),
            (F.col("bytes_a_to_b") + F.col("bytes_b_to_a")).alias("bytes_total"),
        )
    )
    return both.where(F.col("category").isNotNull()).groupBy(
        day_of("start_ts").alias("day"), F.hour("start_ts").alias("hour"), "category"
    ).agg(F.sum("bytes_total").alias("bytes_total"))


def _normal(hourly: DataFrame, p: StudyParams) -> DataFrame:
    return hourly.where(outside_outage("day", p.outage_start, p.outage_end))


def time_of_day_totals(hourly: DataFrame, p: StudyParams) -> DataFrame:
    """Per hour of the day: mean, 90 % and 99 % quantile of the MB of normal days, long form."""
    per_day = _normal(hourly, p).groupBy("hour", "day").agg((F.sum("bytes_total") / MB).alias("mb"))
    wide = stats.mean_q90_q99_max(per_day, "mb", ["hour"]).select(
        "hour", F.col("q99").alias("99th Percentile"), F.col("q90").alias("90th Percentile"),
        F.col("mean").alias("Mean"), F.col("max").alias("Max"),
    )
    return stats.melt(wide, ["hour"], ["99th Percentile", "90th Percentile", "Mean", "Max"], "type", "mb")


def time_of_day_category(hourly: DataFrame, p: StudyParams) -> DataFrame:
    per_day = _normal(hourly, p).withColumn("mb", F.col("bytes_total") / MB)
    return stats.mean_q90_q99_max(per_day, "mb", ["hour", "category"]).drop("max")


def hour_density(hourly: DataFrame, p: StudyParams) -> DataFrame:
    """Share of each hour of the day in its category's bytes."""
    sums = _normal(hourly, p).groupBy("hour", "category").agg(F.sum("bytes_total").alias("bytes_total"))
    # 24 rows per category
    share = F.try_divide(F.col("bytes_total"), F.sum("bytes_total").over(Window.partitionBy("category")))
    return sums.select("hour", "category", share.alias("byte_density"))


def throughput_days(flows: DataFrame, p2p: DataFrame, p: StudyParams) -> DataFrame:
    """Daily GB up, down and local over the whole study with a 7-day trailing mean."""
    zero = F.lit(0).cast("bigint")
    both = flows.select(
        day_of("start_ts").alias("day"), F.col("bytes_up").alias("Up"), F.col("bytes_down").alias("Down"),
        zero.alias("Local"),
    ).unionByName(p2p.select(
        day_of("start_ts").alias("day"), zero.alias("Up"), zero.alias("Down"),
        (F.col("bytes_a_to_b") + F.col("bytes_b_to_a")).alias("Local"),
    ))
    daily = both.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("Up", "Down", "Local")])
    long = stats.melt(daily, ["day"], ["Up", "Down", "Local"], "throughput_type", "bytes")
    dense = stats.densify(long, "day", p.min_date, p.max_date, ["throughput_type"], ["bytes"])
    gb = dense.withColumn("gb", F.col("bytes") / GB)
    return stats.rolling_days(gb, "day", "gb", ["throughput_type"], "gb_7d")


def local_weeks(flows: DataFrame, p2p: DataFrame) -> DataFrame:
    """Weekly bytes (weeks end on Sunday): external up and down, local server up and down, between users."""
    local = F.coalesce(F.col("is_local"), F.lit(False))
    zero = F.lit(0).cast("bigint")
    only = lambda test, c: F.when(test, F.col(c)).otherwise(zero)
    names = ["bytes_up", "bytes_down", "local_up", "local_down", "bytes_p2p"]
    parts = flows.select(
        "start_ts", only(~local, "bytes_up").alias("bytes_up"), only(~local, "bytes_down").alias("bytes_down"),
        only(local, "bytes_up").alias("local_up"), only(local, "bytes_down").alias("local_down"),
        zero.alias("bytes_p2p"),
    ).unionByName(p2p.select(
        "start_ts", *[zero.alias(n) for n in names[:4]],
        (F.col("bytes_a_to_b") + F.col("bytes_b_to_a")).alias("bytes_p2p"),
    ))
    weekly = parts.groupBy(week_ending(day_of("start_ts"), "Sun").alias("week")).agg(
        *[F.sum(n).alias(n) for n in names]
    )
    return stats.melt(weekly, ["week"], names, "direction", "bytes")


def nouser_days(nouser: DataFrame, p: StudyParams) -> DataFrame:
    """Daily bytes of flows without a user by kind, with zero days."""
    daily = nouser.groupBy(day_of("start_ts").alias("day"), nouser_kind().alias("kind")).agg(
        F.sum(F.col("bytes_a_to_b") + F.col("bytes_b_to_a")).alias("bytes_total")
    )
    return stats.densify(daily, "day", p.min_date, p.max_date, ["kind"], ["bytes_total"])


def p2p_pair_days(p2p: DataFrame) -> DataFrame:
    """Bytes per day and unordered pair of users, two-way flows only."""
    return (
        p2p.where(p2p_kind() == "Two-Way").dropna(subset=["user_a", "user_b"])
        .groupBy(
            day_of("start_ts").alias("day"), F.least("user_a", "user_b").alias("user_x"),
            F.greatest("user_a", "user_b").alias("user_y"),
        )
        .agg(F.sum(F.col("bytes_a_to_b") + F.col("bytes_b_to_a")).alias("bytes_total"))
    )


def p2p_pair_totals(p2p: DataFrame) -> DataFrame:
    return p2p_pair_days(p2p).groupBy("user_x", "user_y").agg(
        F.sum("bytes_total").alias("bytes_total"), F.count("*").alias("days"),
        F.avg("bytes_total").alias("average_bytes"),
    )


def ice_by_destination(flows: DataFrame, ips: Sequence[str] | None = None) -> DataFrame:
    """Peer and set-up traffic per destination and name, with the number of users."""
    ice = flows.where(F.col("category").isin(PEER_TO_PEER, ICE))
    if ips is not None:
        ice = ice.where(F.col("dest_ip").isin(list(ips)))
    per_user = sum_bytes(ice, ["dest_ip", "fqdn", "user_id"])
    return per_user.groupBy("dest_ip", "fqdn").agg(
        F.sum("bytes_up").alias("bytes_up"), F.sum("bytes_down").alias("bytes_down"),
        F.sum(total()).alias("bytes_total"), F.count("*").alias("user_count"),
    )


def uplink_ratio(flows: DataFrame, active: DataFrame, eligible_strict: DataFrame) -> DataFrame:
    """Per eligible registered user: uplink share, use per online day, ranks, top category, share of days online."""
    per_category = sum_bytes(restrict_to(flows, active), ["user_id", "category"]).withColumn("bytes_total", total())
    users = active.select("user_id").join(
        per_category.groupBy("user_id").agg(
            F.sum("bytes_up").alias("bytes_up"), F.sum("bytes_down").alias("bytes_down")
        ), "user_id", "left",
    ).fillna(0, ["bytes_up", "bytes_down"]).withColumn("bytes_total", total())
    top = stats.argmax_label(per_category, ["user_id"], "category", "bytes_total", "top_category")
    kept = users.join(top, "user_id").join(
        eligible_strict.select("user_id", "days_online", "days_active"), "user_id"
    ).withColumns(
        {
            "bytes_per_online_day": F.col("bytes_total") / F.col("days_online"),
            "normalized_days_online": F.least("days_online", "days_active") / F.col("days_active"),
            "ul_ratio": F.try_divide("bytes_up", "bytes_total"),
            "dl_ratio": F.try_divide("bytes_down", "bytes_total"),
        }
    ).withColumn("mb_per_online_day", F.col("bytes_per_online_day") / MB)
    ranked = stats.rank_min(kept, "bytes_total", "rank_total")
    return stats.rank_min(ranked, "bytes_per_online_day", "rank_daily")


def _positive_log(name: str) -> Column:
    return F.when(F.col(name) > 0, F.ln(F.col(name)))


def two_fits(points: DataFrame, x: str, y: str) -> DataFrame:
    """Linear and log-log least squares of y on x."""
    linear = stats.least_squares(points, F.col(x), F.col(y), "linear")
    return linear.unionByName(stats.least_squares(points, _positive_log(x), _positive_log(y), "loglog"))


def fit_curve(points: DataFrame, x: str, y: str, n: int = 1000) -> DataFrame:
    linear = stats.least_squares(points, F.col(x), F.col(y), "linear")
    return stats.prediction_curve(linear, stats.least_squares(points, _positive_log(x), _positive_log(y), "loglog"), n)


# --- health sites ------------------------------------------------------------------------------------------------


def mark_health(daily_names: DataFrame) -> DataFrame:
    """Add is_health and primary_domain. The word lists run once per distinct name."""
    names = daily_names.select("fqdn").where(F.col("fqdn").isNotNull()).distinct().select(
        "fqdn", is_health("fqdn").alias("is_health"), health_primary_domain("fqdn").alias("primary_domain")
    )
    return daily_names.join(names, "fqdn")


def health_volume(marked: DataFrame) -> DataFrame:
    """Weekly GB of health and other sites by direction."""
    weekly = sum_bytes(marked.withColumn("week", week_ending("day")), ["week", "is_health"])
    long = stats.melt(weekly, ["week", "is_health"], ["bytes_up", "bytes_down"], "direction", "bytes")
    return long.select("week", "is_health", "direction", (F.col("bytes") / GB).alias("gb"))


def health_bytes(marked: DataFrame) -> DataFrame:
    weekly = marked.where("is_health").groupBy(week_ending("day").alias("week"))
    return weekly.agg(F.sum(total()).alias("bytes"))


def health_users(marked: DataFrame) -> DataFrame:
    weekly = marked.where("is_health").groupBy(week_ending("day").alias("week"))
    return weekly.agg(F.countDistinct("user_id").alias("users"))


def health_domain_weeks(marked: DataFrame) -> DataFrame:
    weekly = marked.where("is_health").groupBy(week_ending("day").alias("week"), "primary_domain")
    return weekly.agg((F.sum(total()) / GB).alias("gb"))


def health_domain_users(marked: DataFrame, p: StudyParams) -> DataFrame:
    """Weekly users per health domain with zero weeks; week_number counts from the lockdown, cut toward zero."""
    weekly = marked.where("is_health").groupBy(week_ending("day").alias("week"), "primary_domain").agg(
        F.countDistinct("user_id").alias("users")
    )
    first = p.min_date + timedelta(days=(7 - p.min_date.weekday()) % 7)
    dense = stats.densify(
        weekly, "week", first, p.max_date + timedelta(days=1), ["primary_domain"], ["users"], outer=True, step_days=7
    )
    offset = F.datediff("week", F.lit(p.lockdown.date()))
    return dense.withColumn("week_number", (offset / F.lit(7)).cast("int"))


def organisation_weeks(daily_orgs: DataFrame, retailers: DataFrame, p: StudyParams, period: str) -> DataFrame:
    """Weekly (ending Wednesday) mean of the daily bytes per organisation, before or after the lockdown.

    Resellers and the days of the exploit are left out.
    """
    ends = (p.before_start, p.lockdown) if period == "before" else (p.lockdown, p.lockdown + (p.lockdown - p.before_start))
    day = F.col("day")
    kept = (
        daily_orgs.where(in_range(day.cast("timestamp_ntz"), *ends))
        .where((day < F.lit(p.exploit_start.date())) | (day > F.lit(p.exploit_end.date())))
        .where(F.col("user_id").isNotNull())
        .join(retailers.select("user_id"), "user_id", "left_anti")
    )
    return kept.groupBy("org", week_ending("day", "Wed").alias("week")).agg(F.avg("bytes_down").alias("bytes_down"))


