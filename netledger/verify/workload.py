"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from netledger.functions import naming
from netledger.functions.timebins import day_of, outside_outage
from netledger.operators import activity, balance, canonical, enrich, ledger, privacy, stats, stun, taint
from netledger.plans import finance, headline, pipeline, traffic, users
from netledger.schemas import RAW_DNS, RAW_FLOW
from netledger.session import materialise, scratch_path
from netledger.sources import raw_logs, tables, txn_log
from netledger.verify.fixtures import PARAMS as P, Fixtures

# Parameters that suit the density of the test events.
STUN_SETUP, STUN_GRACE = 86_400, 21_600
PURCHASE_GAP = 21_600
MIN_FAILED = 1
STITCH_TOLERANCE = 3_600.0
ANONYMITY = 120
SELF_TRANSFERS_AFTER = datetime(2024, 1, 5)

_STAGES: dict[tuple[str, str, str], DataFrame] = {}


class Study(Fixtures):
    """Fixtures plus the shared intermediate tables, which are written once per session and then read."""

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STAGES:
            _STAGES[key] = materialise(build())
        return _STAGES[key]

    def network_gaps(self) -> DataFrame:
        """Gaps with the planned outage taken out of the flows, as in the study data."""
        up = lambda df: df.where(outside_outage(day_of("start_ts"), P.outage_start, P.outage_end))
        return activity.log_gaps(activity.all_flows(up(self.flows), up(self.p2p)))

    def build_active(self) -> DataFrame:
        return activity.user_active_deltas(
            self.flows, self.transactions, self.early, self.network_gaps(), P.min_date, P.max_date
        )

    @property
    def early(self) -> DataFrame:
        return self.stage("early", lambda: ledger.early_balances(self.transactions, P.min_date))

    @property
    def active(self) -> DataFrame:
        return self.stage("active", self.build_active)

    @property
    def eligible(self) -> DataFrame:
        return activity.eligible_users(self.active)

    @property
    def eligible_strict(self) -> DataFrame:
        return activity.eligible_users(self.active, strict=True)

    @property
    def consolidated(self) -> DataFrame:
        return self.stage("consolidated", lambda: ledger.consolidate_purchases(self.transactions, PURCHASE_GAP))

    @property
    def hourly(self) -> DataFrame:
        return traffic.hourly_category(self.flows, self.p2p)

    @property
    def names(self) -> DataFrame:
        """Daily bytes per user and host name, marked for health sites."""
        return traffic.mark_health(traffic.daily_aggregate(self.flows, "fqdn"))

    @property
    def loans(self) -> DataFrame:
        return finance.user_loans(self.view("fx_reseller_txns"), P)

    @property
    def balance_events(self) -> DataFrame:
        return balance.balance_events(self.view("fx_balance_flows"), self.consolidated, self.eligible)

    @property
    def balance_history(self) -> DataFrame:
        events = self.stage("balance_events", lambda: self.balance_events)
        return self.stage(
            "balance_history", lambda: balance.history_with_marks(events, balance.zero_ranges(events, MIN_FAILED))
        )

    @property
    def balances(self) -> DataFrame:
        return ledger.running_balances(
            self.transactions, P.min_date, P.max_date, outlier=(7, datetime(2024, 1, 25)), with_next=True)

    @property
    def zero_time(self) -> DataFrame:
        return ledger.time_at_zero(self.balances, self.active, self.eligible)

    @property
    def day_series(self) -> DataFrame:
        """Daily bytes per category."""
        return traffic.sum_bytes(traffic.with_day(self.flows), ["day", "category"])


def _round_trip(s: Study, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(s.spark, name)
    tables.overwrite(df, path)
    tables.overwrite(df, path)
    return tables.scan(s.spark, path)


def _user_partitioned(s: Study) -> DataFrame:
    path = scratch_path(s.spark, "user_partitioned")
    tables.write_user_partitioned(s.flows, path, "user_id", "start_ts", partitions=8)
    merged = tables.merge_user_partitioned(s.spark, path, "start_ts", partitions=8)
    return traffic.sum_bytes(merged, ["user_id"])


def _release(s: Study) -> DataFrame:
    root = scratch_path(s.spark, "release")
    frames = {"flows": s.flows, "p2p": s.p2p, "transactions": s.transactions}
    tables.release(frames, root)
    parts = [
        tables.scan(s.spark, f"{root}/{n}").agg(F.lit(n).alias("table_name"), F.count("*").alias("row_count"))
        for n in frames
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _org_weeks(s: Study) -> DataFrame:
    resellers = ledger.retailers(s.view("fx_reseller_txns"))
    daily = traffic.daily_aggregate(s.flows, "org")
    part = lambda period: traffic.organisation_weeks(daily, resellers, P, period).withColumn("period", F.lit(period))
    return part("before").unionByName(part("after"))


def _org_week_export(s: Study) -> DataFrame:
    path = scratch_path(s.spark, "org_week")
    tables.export_csv(_org_weeks(s), path)
    return s.spark.read.csv(path, header=True, schema="org string, week date, bytes_down double, period string")


def _uplink(s: Study) -> DataFrame:
    return traffic.uplink_ratio(s.view("fx_mixed_flows"), s.active, s.eligible_strict)


def _dns(s: Study) -> DataFrame:
    bare = s.flows.select("flow_id", "start_ts", "end_ts", "user_id", "dest_ip", "bytes_up", "bytes_down")
    return enrich.attribute_dns(bare, s.dns)


def _passthrough(s: Study) -> DataFrame:
    """Reverse names that spell the address, for flows that nothing else could label."""
    filled = materialise(enrich.fill_reverse_names(_dns(s), s.view("fx_reverse_names")))
    return enrich.label_passthrough_peers(enrich.classify_names(filled))


def _archives(s: Study) -> list[DataFrame]:
    """Two dumps of the flows that overlap in the outage days."""
    cut = s.flows.drop("flow_id")
    return [
        cut.where(F.col("start_ts") < F.lit(P.outage_end)), cut.where(F.col("start_ts") >= F.lit(P.outage_start)),
    ]


_P_COLS = ["flow_id", "category", "org"]

def _damaged_archive(s: Study, view: str, column: str, resent: bool = False) -> str:
    """The view written as JSON lines; of 97 records one is cut off and one has a text where a number belongs.

    With resent, the whole line of such a record follows its damaged one: the archive lacks no record.
    """
    path = scratch_path(s.spark, view)
    df, text = s.view(view), F.col("value")
    lines = df.select("rec_id", F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
    sent = (
        F.when(F.col("rec_id") % 97 == 0, F.substr(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")))
        .when(F.col("rec_id") % 97 == 1, F.regexp_replace(text, f'"{column}":', f'"{column}":"?",":'))
        .otherwise(text)
    )
    if resent:
        lines = lines.select(F.explode(F.when(sent != text, F.array(sent, text)).otherwise(F.array(text))).alias("value"))
    else:
        lines = lines.select(sent.alias("value"))
    lines.write.text(path)
    return path


def _flow_records(s: Study) -> DataFrame:
    return raw_logs.read_records(s.spark, _damaged_archive(s, "fx_raw_flow", "rec_id"), RAW_FLOW)


def _dns_records(s: Study, resent: bool = False) -> DataFrame:
    return raw_logs.read_records(s.spark, _damaged_archive(s, "fx_raw_dns", "rec_id", resent), RAW_DNS)


def _raw_flow_ingest(s: Study) -> DataFrame:
    """Routes and reject reasons of an archive as read from its files, unreadable records included."""
    records = _flow_records(s)
    corrupt = F.col(raw_logs.CORRUPT).isNotNull()
    known = canonical.annotate_raw_flows(records).select(
        F.when(corrupt, F.lit("unreadable")).otherwise(F.col("route")).alias("route"),
        F.when(corrupt, F.lit("unreadable")).otherwise(F.coalesce("reject_reason", F.lit("none"))).alias("reject_reason"),
        F.when(~corrupt, F.col("bytes_a_to_b")).alias("bytes_a_to_b"),
    )
    return known.groupBy("route", "reject_reason").agg(
        F.count("*").alias("records"), F.sum("bytes_a_to_b").alias("bytes_a_to_b"))


def _ingest_balance(s: Study) -> DataFrame:
    return raw_logs.ingest_report(_flow_records(s), "flows").unionByName(raw_logs.ingest_report(_dns_records(s), "dns"))


def _txn_log_ingest(s: Study) -> DataFrame:
    """The text log written in order and read back: lines per kind or reject reason, with their places in the log."""
    path = scratch_path(s.spark, "txn-log")
    s.view("fx_txn_log").orderBy("line_no").select("line").write.text(path)
    parsed = txn_log.parse(txn_log.strip_nul(txn_log.read_lines(s.spark, path)))
    return parsed.groupBy(F.coalesce("reject_reason", "kind").alias("outcome")).agg(
        F.count("*").alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.sum("line_no").alias("sum_of_places"), F.sum("amount_idr").alias("amount_idr"),
    )


def _cleaning_balance(s: Study) -> DataFrame:
    """Two overlapping archives, the second with its own record numbers, through the whole cleaning pipeline."""
    raw, dns = s.view("fx_raw_flow"), s.view("fx_raw_dns")
    again = raw.where("rec_id % 3 <> 0").withColumn("rec_id", F.col("rec_id") + 1_000_000_000)
    reverse = raw.where(F.col("address_b").isNotNull()).select(
        F.col("address_b").alias("ip"), F.concat(F.lit("h-"), F.replace("address_b", F.lit("."), F.lit("-"))).alias("name")
    ).distinct()
    out = pipeline.clean_flows([raw, again], [dns, dns], reverse, P)
    size = lambda df, name: df.agg(F.lit(name).alias("output"), F.count("*").alias("records"))
    up = {"flows_typical": "bytes_up", "flows_p2p": "bytes_a_to_b", "flows_nouser": "bytes_a_to_b", "rejected_flows": "bytes_a_to_b"}
    return reduce(DataFrame.unionByName, [
        size(df, name).withColumn("bytes", F.lit(None).cast("bigint")) if name not in up else
        df.agg(F.lit(name).alias("output"), F.count("*").alias("records"), F.sum(up[name]).alias("bytes"))
        for name, df in out.items()
    ])


def _anonymised(s: Study) -> DataFrame:
    return privacy.anonymise_flows(s.flows, ANONYMITY).groupBy("org", "dest_ip", "fqdn").agg(
        F.count("*").alias("flows"), F.sum("bytes_up").alias("bytes_up"))


QUERIES: dict[str, Callable[[Study], DataFrame]] = {
    # sources and sinks
    "scan_prune": lambda s: tables.scan(
        s.spark, f"{s.sf_dir}/lineitem.parquet", ["l_orderkey", "l_extendedprice", "l_discount"]
    ).groupBy("l_orderkey").agg(F.count("*").alias("lines")),
    "sink_overwrite": lambda s: _round_trip(s, s.transactions, "sink"),
    "txn_log_parse": lambda s: txn_log.accepted(txn_log.parse(s.view("fx_txn_log"))).drop("line"),
    "txn_log_reject": lambda s: txn_log.rejected(txn_log.parse(s.view("fx_txn_log"))).select(
        "line_no", "line", "reject_reason"
    ),
    "txn_log_nul_strip": lambda s: txn_log.nul_report(s.view("fx_nul_log")),
    "txn_log_nul_clean": lambda s: txn_log.strip_nul(s.view("fx_nul_log")),
    "txn_log_counts": lambda s: txn_log.log_counts(s.view("fx_txn_log")),
    "raw_flow_ingest": _raw_flow_ingest,
    "ingest_balance": _ingest_balance,
    "txn_log_ingest": _txn_log_ingest,
    "cleaning_balance": _cleaning_balance,
    "anonymised_flows": _anonymised,
    "raw_dns_ingest": lambda s: raw_logs.readable(_dns_records(s, resent=True)).select(
        "rec_id", "host", F.size("response_addresses").alias("addresses"), F.size("response_ttls").alias("ttls")
    ),
    "user_partitioned": _user_partitioned,
    "release_tables": _release,
    "org_week_export": _org_week_export,
    "traceroute_latency": lambda s: raw_logs.traceroute_latency(
        s.view("fx_traceroutes"), s.view("fx_prepared_traces")
    ),
    # cleaning
    "canon_flow_typical": lambda s: canonical.typical_flows(s.view("fx_raw_flow")),
    "canon_flow_p2p": lambda s: canonical.p2p_flows(s.view("fx_raw_flow")),
    "canon_flow_nouser": lambda s: canonical.nouser_flows(s.view("fx_raw_flow")),
    "canon_flow_reject": lambda s: canonical.rejected_flows(s.view("fx_raw_flow")).select(
        "rec_id", "route", "reject_reason"
    ),
    "canon_dns_explode": lambda s: canonical.dns_responses(s.view("fx_raw_dns")),
    "canon_dns_reject": lambda s: canonical.rejected_dns(s.view("fx_raw_dns")).select(
        "rec_id", "host", "reject_reason"
    ),
    "dedup_flows": lambda s: canonical.deduplicate(_archives(s)),
    "dedup_dns": lambda s: canonical.deduplication_report([canonical.slim_dns(s.dns), canonical.slim_dns(s.dns)]),
    "dns_slim": lambda s: canonical.slim_dns(s.dns),
    "shift_local": lambda s: canonical.shift_to_local(s.flows, "start_ts", "end_ts").select(
        "flow_id", "start_ts", "end_ts"
    ),
    "trim_range": lambda s: canonical.trim(s.flows, "start_ts", P.min_date, P.max_date).select("flow_id", "start_ts"),
    "trim_transactions": lambda s: canonical.trim_transactions(s.transactions, P.min_date, P.max_date),
    "qualify_domain": lambda s: s.flows.select("flow_id", naming.qualify_domain("fqdn").alias("fqdn")),
    "finalise_types": lambda s: canonical.finalise_transactions(s.transactions),
    "finalise_flows": lambda s: canonical.finalise_flows(s.flows),
    "kanon_org": lambda s: privacy.k_anonymise(s.daily, "org", k=32).groupBy("org").agg(F.count("*").alias("rows")),
    "kanon_ip": lambda s: privacy.k_anonymise(s.flows, "dest_ip", k=120).select("flow_id", "dest_ip"),
    "kanon_fqdn": lambda s: privacy.k_anonymise(
        s.flows, "fqdn", k=150, group=naming.primary_domain("fqdn")
    ).select("flow_id", "fqdn"),
    "primary_domain": lambda s: s.flows.select("fqdn").distinct().select(
        "fqdn", naming.primary_domain("fqdn").alias("primary_domain"),
        naming.health_primary_domain("fqdn").alias("health_primary_domain"),
    ),
    "small_org_merge": lambda s: privacy.merge_small_orgs(
        traffic.sum_bytes(s.flows, ["user_id", "org"]).withColumn("bytes_total", traffic.total()), k=40
    ).groupBy("org").agg(F.sum("bytes_total").alias("bytes_total"), F.countDistinct("user_id").alias("users")),
    "flow_stitch": lambda s: canonical.stitch_flows(s.view("fx_port_flows"), STITCH_TOLERANCE),
    "syslog_split": lambda s: s.view("fx_raw_flow").select(
        "rec_id", canonical.flow_destination("9.9.9.50").alias("destination")
    ),
    # enrichment
    "eligible_users": lambda s: activity.restrict_to(
        s.flows, activity.eligible_users(s.active, strict=True, min_days_known=30.5, min_days_active=29)
    ).groupBy("user_id").agg(
        F.count("*").alias("flows")
    ),
    "dns_asof": _dns,
    "rdns_fallback": lambda s: enrich.fill_reverse_names(_dns(s), s.view("fx_reverse_names")),
    "ip_is_local": lambda s: s.flows.select("dest_ip").distinct().select(
        "dest_ip", naming.ip_is_local("dest_ip").alias("is_local")
    ),
    "fqdn_org_category": lambda s: enrich.classify_names(s.flows).select(*_P_COLS),
    "port_override": lambda s: enrich.override_stun_port(s.flows).select("flow_id", "category"),
    "ip_org_category": lambda s: enrich.label_addresses(enrich.label_social_addresses(s.flows)).select(*_P_COLS),
    "passthrough_peer": lambda s: _passthrough(s).select(*_P_COLS),
    "densify": lambda s: stats.densify(
        traffic.sum_bytes(traffic.with_day(s.flows), ["day", "org"]), "day", P.min_date, P.max_date, ["org"],
        ["bytes_up", "bytes_down"],
    ),
    "stun_state": lambda s: stun.tag_related_flows(
        s.view("fx_port_flows"), setup_seconds=STUN_SETUP, grace_seconds=STUN_GRACE
    ).select(*_P_COLS),
    "proto_name": lambda s: s.flows.groupBy(
        naming.protocol_name("protocol", "dest_port").alias("name")
    ).agg(F.count("*").alias("flows"), F.sum("bytes_up").alias("bytes_up")),
    "health_flag": lambda s: traffic.mark_health(s.flows.select("flow_id", "fqdn")).drop("primary_domain"),
    "nouser_kind": lambda s: s.nouser.select("flow_id", enrich.nouser_kind().alias("kind")),
    "p2p_kind": lambda s: s.p2p.select("flow_id", enrich.p2p_kind().alias("kind")),
    "unmapped_heavy_hitters": lambda s: enrich.unmapped_heavy_hitters(s.flows),
    "unknown_destinations": lambda s: enrich.unknown_destinations(s.flows),
    # statistics
    "cdf": lambda s: stats.cdf(s.daily, "bytes_up"),
    "rank_min": lambda s: stats.rank_min(
        traffic.sum_bytes(s.daily, ["user_id"]), "bytes_up", "rank_down", descending=True
    ),
    "rank_pct": lambda s: stats.rank_min(s.flows.select("flow_id", "bytes_up"), "bytes_up", "rank", pct="rank_pct"),
    "rank_bins": lambda s: stats.rank_bins(
        stats.rank_min(traffic.sum_bytes(s.daily, ["user_id"]), "bytes_up"), "rank", "bin"
    ),
    "mean_q90_q99_max": lambda s: stats.mean_q90_q99_max(
        traffic.sum_bytes(s.daily, ["day", "category"]), "bytes_down", ["category"]
    ),
    "exact_quantiles": lambda s: stats.exact_quantiles(
        s.daily, "bytes_up", {"q10": 0.1, "median": 0.5, "q99": 0.99}, ["org"]
    ),
    "melt": lambda s: stats.melt(
        traffic.sum_bytes(s.daily, ["category"]), ["category"], ["bytes_up", "bytes_down"], "direction", "amount"
    ),
    "argmax_label": lambda s: stats.argmax_label(s.daily, ["user_id"], "category", "bytes_down", "top_category"),
    "topn_other": lambda s: traffic.sum_bytes(
        stats.top_or_other(traffic.sum_bytes(s.daily, ["day", "org"]), "org", "bytes_down"), ["day", "org"]
    ),
    "others_only": lambda s: traffic.weekly_others(s.flows, "org", 9),
    "topn_label": lambda s: stats.top_label(s.daily, "user_id", "bytes_down"),
    "sort_order": lambda s: stats.layer_order(s.daily, "category", {"Downlink": "bytes_down", "Uplink": "bytes_up"}),
    "rolling_time": lambda s: stats.rolling_days(s.day_series, "day", "bytes_up", ["category"], "mean_7d"),
    "rolling_rows": lambda s: stats.rolling_rows(s.day_series, "day", "bytes_up", ["category"], "mean_7r"),
    "daily_users_7row_mean": lambda s: users.daily_users_7row_mean(s.flows),
    "ffill": lambda s: stats.fill_forward(
        s.day_series.withColumn("known", F.when(F.col("bytes_up") % 3 == 0, F.col("bytes_up"))), "day", "known",
        ["category"],
    ),
    "bfill": lambda s: stats.fill_backward(
        s.day_series.withColumn("known", F.when(F.col("bytes_up") % 3 == 0, F.col("bytes_up"))), "day", "known",
        ["category"],
    ),
    "resample_hour": lambda s: stats.resample_hours(s.flows, "start_ts", "bytes_down", ["category"]),
    "ols_fit": lambda s: traffic.two_fits(_uplink(s), "mb_per_online_day", "ul_ratio"),
    "ols_curve": lambda s: traffic.fit_curve(_uplink(s), "mb_per_online_day", "ul_ratio"),
    "group_cv": lambda s: finance.daily_purchase_variation(s.transactions),
    # shared intermediates
    "log_gaps": lambda s: activity.log_gaps(activity.all_flows(s.flows, s.p2p)),
    "log_gaps_running_max": lambda s: activity.log_gaps(activity.all_flows(s.flows, s.p2p), mode="running_max"),
    "full_gap_days": lambda s: activity.full_gap_days(s.network_gaps()),
    "user_flow_range": lambda s: activity.flow_ranges(s.flows),
    "user_purchase_range": lambda s: activity.purchase_ranges(s.transactions, s.early, P.min_date),
    "user_active_deltas": lambda s: s.build_active(),
    "daily_category": lambda s: traffic.daily_aggregate(s.daily, "category"),
    "daily_org": lambda s: traffic.daily_aggregate(s.daily, "org"),
    "daily_domain": lambda s: traffic.daily_aggregate(s.flows, "fqdn"),
    "early_balances": lambda s: ledger.early_balances(s.transactions, P.min_date),
    "early_registered_users": lambda s: ledger.early_registered_users(s.transactions),
    "untainted_txn": lambda s: taint.untainted_transactions(s.transactions, P.exploit_start, P.exploit_end),
    "user_ledger": lambda s: ledger.user_ledger(s.transactions),
    "running_balance": lambda s: s.balances.drop("next_ts"),
    "all_flows": lambda s: activity.all_flows(s.flows, s.p2p, s.nouser),
    "consolidated_purchases": lambda s: ledger.consolidate_purchases(s.transactions, PURCHASE_GAP),
    # data balance
    "balance_events": lambda s: s.balance_events,
    "balance_selectivity": lambda s: balance.balance_selectivity(s.flows, s.eligible),
    "last_ext_rx": lambda s: balance.last_external_download(s.balance_events).select(
        "user_id", "type", "event_id", "last_ext_rx"
    ),
    "zero_ranges": lambda s: balance.zero_ranges(s.balance_events, MIN_FAILED),
    "balance_init": lambda s: s.balance_history.where(F.col("type") == "init").select("user_id", "ts", "net_bytes"),
    "tare_offsets": lambda s: balance.tare_offsets(s.balance_history),
    "balance_final": lambda s: balance.user_data_balance(
        s.view("fx_balance_flows"), s.consolidated, s.eligible, MIN_FAILED
    ).select("user_id", "position", "type", "ts", "net_bytes", "balance"),
    "user_ledger_hourly": lambda s: balance.hourly_ledger(s.flows, finance.purchases(s.transactions)),
    # traffic
    "bytes_per_user": lambda s: traffic.bytes_per_user(s.daily),
    "org_week_mean": _org_weeks,
    "bytes_cat_org_day": lambda s: traffic.category_org_day(s.daily),
    "bytes_cat_week": lambda s: traffic.weekly_shares(s.daily, "category"),
    "bytes_org_week": lambda s: traffic.weekly_shares(s.daily, "org", keep=9),
    "bytes_cat_total": lambda s: traffic.category_totals(s.daily),
    "mapped_stats": lambda s: traffic.mapped_stats(s.flows, "org").unionByName(
        traffic.mapped_stats(s.flows, "category")
    ),
    "cat_per_user": lambda s: traffic.label_per_user(s.flows, s.eligible_strict),
    "cat_per_quantile": lambda s: traffic.label_per_quantile(s.flows, s.eligible_strict),
    "org_per_quantile": lambda s: traffic.label_per_quantile(s.flows, s.eligible_strict, "org"),
    "day_of_week": lambda s: traffic.day_of_week(activity.all_flows(s.flows, s.p2p, s.nouser), P),
    "day_of_week_ci": lambda s: traffic.weekday_means(
        traffic.day_of_week(activity.all_flows(s.flows, s.p2p, s.nouser), P)
    ),
    "low_days": lambda s: traffic.low_days(
        traffic.day_of_week(activity.all_flows(s.flows, s.p2p, s.nouser), P), below_gb=0.017
    ),
    "mb_per_online_day_cdf": lambda s: traffic.mb_per_day_cdfs(s.flows, s.active),
    "proto_trend": lambda s: traffic.protocol_weeks(s.flows),
    "other_udp_ports": lambda s: traffic.other_udp_ports(s.flows),
    "time_of_day_total": lambda s: traffic.time_of_day_totals(s.hourly, P),
    "time_of_day_category": lambda s: traffic.time_of_day_category(s.hourly, P),
    "hour_density": lambda s: traffic.hour_density(s.hourly, P),
    "throughput_day": lambda s: traffic.throughput_days(s.flows, s.p2p, P),
    "local_week": lambda s: traffic.local_weeks(s.flows, s.p2p),
    "nouser_day": lambda s: traffic.nouser_days(s.nouser, P),
    "p2p_pair_day": lambda s: traffic.p2p_pair_days(s.p2p),
    "p2p_pair_total": lambda s: traffic.p2p_pair_totals(s.p2p),
    "ice_by_dest": lambda s: traffic.ice_by_destination(s.flows),
    "ul_dl_ratio": _uplink,
    "health_volume": lambda s: traffic.health_volume(s.names),
    "health_bytes": lambda s: traffic.health_bytes(s.names),
    "health_users": lambda s: traffic.health_users(s.names),
    "health_domain_week": lambda s: traffic.health_domain_weeks(s.names),
    "health_domain_users": lambda s: traffic.health_domain_users(s.names, P),
    # users
    "user_category_matrix": lambda s: users.user_label_matrix(s.flows, s.eligible),
    "user_category_split": lambda s: users.user_category_split(s.daily),
    "user_org_matrix": lambda s: users.user_label_matrix(s.flows, s.eligible, "org"),
    "users_time_of_day": lambda s: users.users_time_of_day(s.flows, P),
    "users_per_hour": lambda s: users.users_per_hour(s.flows),
    "user_days": lambda s: users.user_days(s.flows),
    "users_over_time": lambda s: users.users_over_time(s.flows, s.transactions, s.early, P),
    "online_ratio": lambda s: users.online_ratio_cdfs(s.eligible),
    "online_vs_usage": lambda s: users.online_vs_usage(s.flows, s.eligible),
    "online_vs_usage_fit": lambda s: traffic.two_fits(
        users.online_vs_usage(s.flows, s.eligible), "mb_per_online_day", "online_ratio"
    ),
    "users_without_dns": lambda s: users.users_without_dns(s.daily, s.dns),
    "top_hosts": lambda s: users.top_hosts(s.dns, exclude=("www.google.com",)),
    "top_hosts_containing": lambda s: users.top_hosts(s.dns, containing="cdn"),
    # finance
    "purchase_total": lambda s: finance.purchase_totals(s.transactions, s.eligible, P),
    "purchase_total_cdf": lambda s: stats.cdf(finance.purchase_totals(s.transactions, s.eligible, P), "amount_usd"),
    "purchase_rate": lambda s: stats.cdf(finance.purchase_totals(s.transactions, s.eligible, P), "usd_per_day"),
    "purchase_interval": lambda s: finance.purchase_intervals(s.consolidated, P),
    "purchase_interval_cdf": lambda s: finance.purchase_interval_cdfs(s.consolidated, P),
    "purchase_amount_hist": lambda s: finance.purchase_amounts(s.consolidated),
    "package_stats": lambda s: finance.package_stats(s.transactions),
    "user_packages": lambda s: finance.user_packages(s.transactions),
    "zero_time": lambda s: s.zero_time,
    "zero_time_cdf": lambda s: stats.cdf(s.zero_time, "fraction_nonzero"),
    "zero_time_counts": lambda s: finance.zero_time_counts(s.zero_time),
    "revenue_cumulative": lambda s: finance.revenue_cumulative(s.transactions, P),
    "self_transfers": lambda s: ledger.self_transfers(s.transactions, SELF_TRANSFERS_AFTER),
    "loan_matrix": lambda s: finance.loan_matrix(s.loans, P),
    "loan_same_users": lambda s: finance.loans_of_lasting_users(s.loans),
    "loan_rates": lambda s: finance.loan_rates(s.loans, P),
    "purchase_count_user": lambda s: finance.purchase_counts(s.transactions),
    "transfer_in_out_count": lambda s: finance.transfer_counts(s.transactions),
    "transfer_in_out_sum": lambda s: finance.transfer_sums(s.transactions, P),
    "topup_cumulative": lambda s: finance.topups_cumulative(s.transactions, P),
    "purchases_by_weekday": lambda s: finance.purchases_by_weekday(s.transactions),
    "transfer_size_hist": lambda s: finance.transfer_sizes(s.transactions, 7),
    # headline
    "paper_counts": lambda s: headline.counts(s.flows, s.p2p, s.transactions),
    "paper_dns": lambda s: headline.dns_shares(s.flows),
    "paper_category": lambda s: headline.category_shares(s.flows),
    "paper_labels": lambda s: headline.label_counts(s.flows),
    "paper_dates": lambda s: headline.study_dates(s.flows, P),
    "dl_ul": lambda s: headline.dl_ul_ratio(s.view("fx_mixed_flows")),
    "paper_bigco": lambda s: headline.big_companies(s.flows, s.p2p),
    "paper_online": lambda s: headline.median_online(s.eligible),
    "paper_video": lambda s: headline.video(s.flows, s.transactions),
    "paper_inequality": lambda s: headline.inequality(finance.purchase_totals(s.transactions, s.eligible, P)),
    "paper_filter_stats": lambda s: headline.filter_stats(s.flows, s.p2p, s.active),
    "paper_ice": lambda s: headline.ice_traffic(s.flows),
    "paper_arpu": lambda s: headline.arpu(s.transactions, P),
    "uptime": lambda s: headline.uptime(activity.log_gaps(activity.all_flows(s.flows, s.p2p)), P),
    "outage_cdf": lambda s: headline.outage_cdf(activity.log_gaps(activity.all_flows(s.flows, s.p2p))),
}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines; the shift keeps exact halves from rounding differently."""
    return df.select(*[
        F.round(F.col(f.name) + F.lit(2.37e-9), places).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema.fields
    ])


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(QUERIES[name](Study(spark, sf_dir)))
