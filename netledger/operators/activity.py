"""Network outage gaps, per-user activity ranges and the eligibility filter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from netledger.functions.timebins import day_of, micros_between, ntz, seconds_between
from netledger.operators.scan import prefix_scan, time_bucket


def all_flows(typical: DataFrame, p2p: DataFrame, nouser: DataFrame | None = None) -> DataFrame:
    """One frame of all flow kinds: start, end, protocol, total bytes and a unique (kind, flow_id)."""
    def part(df: DataFrame, kind: int, up: str, down: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"), "flow_id", "start_ts", "end_ts", "protocol",
            (F.col(up) + F.col(down)).alias("bytes_total"),
        )

    union = part(typical, 0, "bytes_up", "bytes_down").unionByName(part(p2p, 1, "bytes_a_to_b", "bytes_b_to_a"))
    if nouser is not None:
        union = union.unionByName(part(nouser, 2, "bytes_a_to_b", "bytes_b_to_a"))
    return union


def log_gaps(flows: DataFrame, mode: str = "previous", bucket_unit: str = "second") -> DataFrame:
    """Times without flows in progress, over all users.

    mode="previous" compares each start with the end of the flow that started just before it; mode="running_max"
    compares with the latest end so far, so that a long flow still in progress suppresses a gap. flows is the result of
    all_flows. The order is global, so it is scanned in very short time buckets whose summaries go through day
    buckets: no task sees more than a second of flows or a day of summaries.
    """
    expr = {"__prev_end": F.col("end_ts")}
    order = ["start_ts", "kind", "flow_id"]
    scans = {"lasts": expr} if mode == "previous" else {"maxes": expr}
    slim = flows.select(*order, "end_ts").where(F.col("start_ts").isNotNull())
    scanned = prefix_scan(slim, [], order, time_bucket("start_ts", bucket_unit), inclusive=False,
                          coarser=lambda b: F.date_trunc("day", b), **scans)
    return scanned.where(F.col("start_ts") > F.col("__prev_end")).select(
        F.col("__prev_end").alias("gap_start"), F.col("start_ts").alias("gap_end")
    )


def gap_seconds() -> Column:
    return seconds_between("gap_start", "gap_end")


def full_gap_days(gaps: DataFrame) -> DataFrame:
    """Days on which the network was down: 24 h steps through each gap longer than a day, without the first."""
    steps = F.sequence("gap_start", "gap_end", F.make_dt_interval(days=F.lit(1)))
    long_gaps = gaps.where(micros_between("gap_start", "gap_end") > 86_400_000_000)
    return long_gaps.select(F.explode(F.slice(steps, F.lit(2), F.size(steps))).alias("__at")).select(
        day_of("__at").alias("day")
    )


def flow_ranges(flows: DataFrame) -> DataFrame:
    """Per user: first start, end of the flow that started last, days with traffic."""
    known = flows.where(F.col("user_id").isNotNull())
    # Distinct days come from one row per (user, day), which also splits a hot user's rows over the cluster.
    daily = known.groupBy("user_id", day_of("start_ts").alias("day")).agg(
        F.min("start_ts").alias("first_start"),
        F.max(F.struct("start_ts", "flow_id", "end_ts")).alias("newest"),
    )
    return daily.groupBy("user_id").agg(
        F.min("first_start").alias("first_start"),
        F.max("newest")["end_ts"].alias("last_end"),
        F.count("*").alias("days_online"),
    )


def purchase_ranges(txns: DataFrame, early_users: DataFrame, min_date: datetime) -> DataFrame:
    """First and last purchase; users known from before the study count as seen at its first moment."""
    purchases = txns.where(F.col("kind") == "purchase").select("user_id", "ts")
    early = early_users.select("user_id", ntz(min_date).alias("ts"))
    return (
        purchases.unionByName(early).where(F.col("user_id").isNotNull())
        .groupBy("user_id").agg(F.min("ts").alias("first_purchase"), F.max("ts").alias("last_purchase"))
    )


def _days_until(gap_days: DataFrame, users: DataFrame) -> DataFrame:
    """Calendar day -> number of gap days up to and including it (as many rows as the calendar has days)."""
    gaps = gap_days.groupBy("day").agg(F.count("*").alias("n"))
    seen = (
        users.select(F.date_sub(day_of("earliest"), 1).alias("day"))
        .unionByName(users.select(day_of("latest").alias("day"))).unionByName(gaps.select("day"))
    )
    bounds = seen.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where(F.col("lo").isNotNull())
    calendar = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day"), F.lit(0).cast("bigint").alias("n"))
    per_day = calendar.unionByName(gaps).groupBy("day").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_day.select("day", F.sum("n").over(upto).alias("gap_days"))


def user_active_deltas(flows: DataFrame, txns: DataFrame, early_users: DataFrame, gaps: DataFrame,
                       min_date: datetime, max_date: datetime) -> DataFrame:
    """Activity range of each user with both traffic and purchases, in days, and the outage days inside it.

    Gap days inside [earliest, latest] are counted as the difference of two running totals over the calendar, so no
    range join is needed.
    """
    both = flow_ranges(flows).join(purchase_ranges(txns, early_users, min_date), "user_id")
    by_flow_first = F.col("first_start") < F.col("first_purchase")
    by_flow_last = F.col("last_end") > F.col("last_purchase")
    users = both.select(
        "user_id", "days_online",
        F.when(by_flow_first, F.col("first_start")).otherwise(F.col("first_purchase")).alias("earliest"),
        F.when(by_flow_first, "Flow").otherwise("Purchase").alias("earliest_kind"),
        F.when(by_flow_last, F.col("last_end")).otherwise(F.col("last_purchase")).alias("latest"),
        F.when(by_flow_last, "Flow").otherwise("Purchase").alias("latest_kind"),
    )
    upto = _days_until(full_gap_days(gaps), users)
    # A day counts from its midnight: days before `earliest` are those up to the last moment before it.
    last_before = day_of(F.col("earliest") - F.make_dt_interval(secs=F.lit(0.000001)))
    hi = upto.select(F.col("day").alias("__hi"), F.col("gap_days").alias("__n_hi"))
    lo = upto.select(F.col("day").alias("__lo"), F.col("gap_days").alias("__n_lo"))
    return (
        users.withColumns({"__hi": day_of("latest"), "__lo": last_before})
        .join(hi, "__hi", "left").join(lo, "__lo", "left")
        .withColumns(
            {
                "days_since_first_active": seconds_between("earliest", ntz(max_date)) / 86400.0,
                "days_active": seconds_between("earliest", "latest") / 86400.0,
                "outage_impact_days": F.coalesce(F.col("__n_hi") - F.col("__n_lo"), F.lit(0)),
            }
        )
        .withColumn("optimistic_days_online", F.col("days_online") + F.col("outage_impact_days"))
        .drop("__hi", "__lo", "__n_hi", "__n_lo")
    )


def eligible_users(active: DataFrame, strict: bool = False, min_days_known: float = 7, min_days_active: float = 1
                   ) -> DataFrame:
    """Users known for a week and active for a day; strict uses > instead of >=."""
    known, span = F.col("days_since_first_active"), F.col("days_active")
    if strict:
        return active.where((known > min_days_known) & (span > min_days_active))
    return active.where((known >= min_days_known) & (span >= min_days_active))


def restrict_to(facts: DataFrame, users: DataFrame, on: str = "user_id") -> DataFrame:
    return facts.join(users.select(on), on, "left_semi")
