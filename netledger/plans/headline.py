"""Headline figures: one-row answers from one conditional aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netledger.functions.timebins import micros_between
from netledger.operators import stats
from netledger.operators.activity import gap_seconds, restrict_to
from netledger.params import GB, ICE, PEER_TO_PEER, UNKNOWN_NO_DNS, UNKNOWN_NOT_MAPPED, StudyParams
from netledger.plans.traffic import total
from netledger.plans.users import online_ratio

_SOCIAL = ("Facebook", "Instagram", "WhatsApp")
_NO_NAME = (UNKNOWN_NO_DNS, UNKNOWN_NOT_MAPPED, "Google (No DNS)")


def _sum_if(test: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, value)), F.lit(0))


def internet() -> Column:
    return ~F.col("is_local")


def counts(flows: DataFrame, p2p: DataFrame, txns: DataFrame) -> DataFrame:
    """Flows and bytes to the Internet and inside the network, and transactions."""
    f = flows.agg(
        F.count_if(internet()).alias("internet_flows"), F.count("*").alias("typical_flows"),
        _sum_if(internet(), F.col("bytes_down")).alias("dl"), _sum_if(internet(), F.col("bytes_up")).alias("ul"),
        _sum_if(~internet(), total()).alias("local"),
    )
    q = p2p.agg(
        F.count("*").alias("p2p_flows"), F.sum(F.col("bytes_a_to_b") + F.col("bytes_b_to_a")).alias("p2p")
    )
    t = txns.agg(F.count_if(F.col("kind") == "purchase").alias("purchases"), F.count("*").alias("transactions"))
    one = f.withColumns({
        "q": q.select(F.struct("*")).scalar(), "t": t.select(F.struct("*")).scalar(),
    })
    intranet_flows = F.col("typical_flows") - F.col("internet_flows") + F.col("q.p2p_flows")
    all_flows = F.col("internet_flows") + intranet_flows
    inside = F.col("local") + F.coalesce("q.p2p", F.lit(0))
    outside = F.col("dl") + F.col("ul")
    return one.select(
        "internet_flows", intranet_flows.alias("intranet_flows"),
        F.try_divide("internet_flows", all_flows).alias("internet_flow_share"),
        (F.col("dl") / GB).alias("internet_dl_gb"), (F.col("ul") / GB).alias("internet_ul_gb"),
        (outside / GB).alias("internet_gb"), (inside / GB).alias("intranet_gb"),
        F.try_divide(outside, outside + inside).alias("internet_byte_share"),
        F.col("t.purchases").alias("purchases"), F.col("t.transactions").alias("transactions"),
    )


def _shares(flows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Flow and byte percentages of Internet traffic that passes each test, one row per test."""
    web = flows.where(internet())
    aggs = [F.count("*").alias("n"), F.sum(total()).alias("b")]
    for name, test in tests.items():
        aggs += [F.count_if(test).alias(f"n_{name}"), _sum_if(test, total()).alias(f"b_{name}")]
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.col(f"n_{name}").alias("flows"),
            F.try_divide(F.col(f"n_{name}") * 100.0, F.col("n")).alias("flow_pct"),
            (F.col(f"b_{name}") / GB).alias("gb"), F.try_divide(F.col(f"b_{name}") * 100.0, F.col("b")).alias("gb_pct"),
        ) for name in tests
    ])
    return web.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def dns_shares(flows: DataFrame) -> DataFrame:
    named = F.col("fqdn") != ""
    return _shares(flows, {
        "mapped": named, "unambiguous": named & (F.col("ambiguous_fqdn_count") == 1),
        "user_derived": F.col("fqdn_source") == "user_dns_log",
    })


def category_shares(flows: DataFrame) -> DataFrame:
    return _shares(flows, {
        "category_mapped": ~F.col("category").isin(*_NO_NAME),
        "org_mapped": ~F.col("org").isin(UNKNOWN_NO_DNS, UNKNOWN_NOT_MAPPED),
    })


def label_counts(flows: DataFrame) -> DataFrame:
    """Distinct categories and organisations of Internet traffic."""
    pairs = flows.where(internet()).select("category", "org").distinct()
    return pairs.agg(
        F.countDistinct("category").alias("unique_categories"), F.countDistinct("org").alias("unique_orgs")
    )


def study_dates(flows: DataFrame, p: StudyParams) -> DataFrame:
    """Study length, and what the flows cover of it."""
    return flows.agg(
        F.min("start_ts").cast("date").alias("first_day"), F.max("start_ts").cast("date").alias("last_day")
    ).withColumn("study_days", F.lit(p.study_seconds / 86400.0))


def dl_ul_ratio(flows: DataFrame) -> DataFrame:
    return flows.where(internet()).agg(
        F.try_divide(F.sum("bytes_down"), F.sum("bytes_up")).alias("dl_ul_ratio")
    )


def big_companies(flows: DataFrame, p2p: DataFrame) -> DataFrame:
    """GB of two company groups, and their share of all and of Internet bytes."""
    between = p2p.agg(F.coalesce(F.sum(F.col("bytes_a_to_b") + F.col("bytes_b_to_a")), F.lit(0))).scalar()
    sums = flows.agg(
        _sum_if(F.col("org").isin(*_SOCIAL), total()).alias("social"),
        _sum_if(F.col("org") == "Google", total()).alias("google"),
        _sum_if(internet(), total()).alias("web"), F.sum(total()).alias("typical"),
    ).withColumn("all", F.col("typical") + between)
    rows = F.array(*[
        F.struct(F.lit(n).alias("company"), v.alias("b")) for n, v in (
            ("Facebook", F.col("social")), ("Google", F.col("google")), ("Both", F.col("social") + F.col("google")))
    ])
    return sums.select("web", "all", F.explode(rows).alias("r")).select(
        "r.company", (F.col("r.b") / GB).alias("gb"), F.try_divide("r.b", "all").alias("share_of_all"),
        F.try_divide("r.b", "web").alias("share_of_internet"),
    )


def median_online(eligible: DataFrame) -> DataFrame:
    """Median online ratio and users online on at least 95 % of their days."""
    ratios = online_ratio(eligible)
    median = stats.exact_quantiles(ratios, "optimistic_online_ratio", {"median": 0.5}).select("median").scalar()
    steady = F.count_if(F.col("optimistic_online_ratio") >= 0.95)
    return ratios.agg(F.count("*").alias("users"), steady.alias("steady_users")).select(
        "users", "steady_users", F.try_divide("steady_users", "users").alias("steady_share"),
        median.alias("median_online_ratio"),
    )


def video(flows: DataFrame, txns: DataFrame, top: int = 10) -> DataFrame:
    """Video bytes overall and of the users who spend most (rank by spending, ties included)."""
    spent = txns.where((F.col("kind") == "purchase") & F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.sum("amount_idr").alias("idr")
    )
    ranked = stats.rank_min(spent, "idr", "rank", descending=True)
    spenders = ranked.where(F.col("rank") <= top).select("user_id", F.lit(True).alias("__top"))
    marked = flows.join(spenders, "user_id", "left")
    is_top = F.col("__top").isNotNull()
    aggs = []
    for group, member in (("all", F.lit(True)), ("top", is_top)):
        for kind, test in (
            ("adult", F.col("category") == "Adult Video"), ("video", F.col("category") == "Video"),
            ("bytes", F.lit(True)), ("web", internet()),
        ):
            aggs.append(_sum_if(member & test, total()).alias(f"{group}_{kind}"))
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("users"), *[F.col(f"{group}_{k}").alias(k) for k in ("adult", "video", "bytes", "web")]
        ) for group, name in (("all", "all users"), ("top", f"top {top} spenders"))
    ])
    r = lambda n: F.col(f"r.{n}")
    return marked.agg(*aggs).select(F.explode(rows).alias("r")).select(
        r("users"), (r("adult") / GB).alias("adult_gb"), (r("video") / GB).alias("video_gb"),
        F.try_divide(r("adult") + r("video"), r("bytes")).alias("video_share_of_all"),
        F.try_divide(r("adult") + r("video"), r("web")).alias("video_share_of_internet"),
    )


def inequality(purchase_totals: DataFrame) -> DataFrame:
    """Spread of the spending per active day over users."""
    median = stats.exact_quantiles(purchase_totals, "usd_per_day", {"m": 0.5}).select("m").scalar()
    rate = F.col("usd_per_day")
    return purchase_totals.agg(
        F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"), F.avg(rate).alias("mean_rate")
    ).withColumn("median_rate", median).withColumns(
        {
            "max_over_mean": F.try_divide("max_rate", "mean_rate"),
            "max_over_median": F.try_divide("max_rate", "median_rate"),
        }
    )


def filter_stats(flows: DataFrame, p2p: DataFrame, active: DataFrame) -> DataFrame:
    """Users removed by each eligibility rule, and the flows that remain."""
    known = F.col("days_since_first_active") >= 7
    kept = known & (F.col("days_active") >= 1)
    remaining = restrict_to(flows, active.where(kept)).agg(F.count("*")).scalar()
    between = p2p.agg(F.count("*")).scalar()
    return active.agg(
        F.count("*").alias("users"), F.count_if(~known).alias("joined_within_week"),
        F.count_if(known & ~kept).alias("active_under_a_day"), F.count_if(kept).alias("final_users"),
    ).withColumns({"typical_flows": remaining, "p2p_flows": between}).withColumns(
        {
            "kept_share": F.try_divide("final_users", "users"),
            "all_flows": F.col("typical_flows") + F.col("p2p_flows"),
        }
    )


def ice_traffic(flows: DataFrame) -> DataFrame:
    """Peer and set-up traffic, shares of Internet bytes, and users involved."""
    peer, ice = F.col("category") == PEER_TO_PEER, F.col("category") == ICE
    users = flows.where(peer | ice).where(F.col("user_id").isNotNull()).select("user_id").distinct()
    sums = flows.agg(
        _sum_if(peer, total()).alias("p"), _sum_if(ice, total()).alias("i"), _sum_if(internet(), total()).alias("web")
    )
    return sums.withColumn("unique_users", users.agg(F.count("*")).scalar()).select(
        (F.col("p") / GB).alias("p2p_gb"), (F.col("i") / GB).alias("ice_gb"),
        F.try_divide("p", "web").alias("p2p_share"), F.try_divide("i", "web").alias("ice_share"),
        F.try_divide(F.col("p") + F.col("i"), F.col("web")).alias("both_share"), "unique_users",
    )


def arpu(txns: DataFrame, p: StudyParams) -> DataFrame:
    """Revenue per paying user: over the study, a twelfth of it, and per day."""
    per_user = txns.where(F.col("kind") == "purchase").groupBy("user_id").agg(F.sum("amount_idr").alias("idr"))
    each = F.try_divide(F.sum("idr"), F.count("user_id"))
    days = p.study_seconds / 86400.0
    return per_user.agg(each.alias("a_arpu")).select(
        "a_arpu", (F.col("a_arpu") / 12.0).alias("m_arpu"), (F.col("a_arpu") / days).alias("d_arpu")
    )


def uptime(gaps: DataFrame, p: StudyParams) -> DataFrame:
    """Total time without flows and its share of the study."""
    down = F.coalesce(F.sum(micros_between("gap_start", "gap_end")), F.lit(0))
    return gaps.agg(down.alias("us")).select(
        (F.col("us") / 1_000_000.0).alias("downtime_seconds"), F.lit(p.study_seconds).alias("study_seconds"),
        (F.col("us") / 1_000_000.0 / p.study_seconds * 100.0).alias("downtime_pct"),
    )


def outage_cdf(gaps: DataFrame, shortest_seconds: float = 10.0) -> DataFrame:
    """Distribution of outage lengths in hours, without the short gaps of normal traffic."""
    hours = gaps.where(gap_seconds() >= shortest_seconds).select((gap_seconds() / 3600.0).alias("duration_hours"))
    return stats.cdf(hours, "duration_hours")
