"""Raw records to clean tables: routing, direction, de-duplication, time shift, trimming, finalisation, stitching."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from netledger.functions.naming import qualify_domain
from netledger.functions.timebins import in_range, micros_between
from netledger.operators.scan import linked_sessions, time_bucket
from netledger.params import LOCAL_UTC_OFFSET_HOURS, NO_USER


def flow_route() -> Column:
    """typical, p2p or nouser, by which sides are subscribers."""
    a, b = F.col("obfuscated_a").isNotNull(), F.col("obfuscated_b").isNotNull()
    return F.when(a & b, "p2p").when(a | b, "typical").otherwise("nouser")


def flow_reject_reason() -> Column:
    """Why a raw flow is malformed; NULL for a good one. Each side must have exactly one identity."""
    a, b = F.col("obfuscated_a").isNotNull(), F.col("obfuscated_b").isNotNull()
    ip_a, ip_b = F.col("address_a").isNotNull(), F.col("address_b").isNotNull()
    return (
        F.when(a & ip_a, "side a has user and address")
        .when(b & ip_b, "side b has user and address")
        .when(~a & ~ip_a, "side a has no identity")
        .when(~b & ~ip_b, "side b has no identity")
    )


def annotate_raw_flows(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"route": flow_route(), "reject_reason": flow_reject_reason()})


def typical_flows(raw: DataFrame) -> DataFrame:
    """Subscriber-to-network flows with the subscriber side first, whichever side it was logged on."""
    a = F.col("obfuscated_a").isNotNull()
    pick = lambda when_a, when_b: F.when(a, F.col(when_a)).otherwise(F.col(when_b))
    good = annotate_raw_flows(raw).where((F.col("route") == "typical") & F.col("reject_reason").isNull())
    return good.select(
        F.col("rec_id").alias("flow_id"), F.col("start_time").alias("start_ts"), F.col("end_time").alias("end_ts"),
        pick("obfuscated_a", "obfuscated_b").alias("user_id"), pick("address_b", "address_a").alias("dest_ip"),
        pick("port_a", "port_b").alias("user_port"), pick("port_b", "port_a").alias("dest_port"),
        pick("bytes_a_to_b", "bytes_b_to_a").alias("bytes_up"),
        pick("bytes_b_to_a", "bytes_a_to_b").alias("bytes_down"),
        F.col("transport_protocol").alias("protocol"),
    )


def _two_sided(raw: DataFrame, route: str, side_a: tuple[str, str], side_b: tuple[str, str]) -> DataFrame:
    good = annotate_raw_flows(raw).where((F.col("route") == route) & F.col("reject_reason").isNull())
    return good.select(
        F.col("rec_id").alias("flow_id"), F.col("start_time").alias("start_ts"), F.col("end_time").alias("end_ts"),
        F.col(side_a[0]).alias(side_a[1]), F.col(side_b[0]).alias(side_b[1]),
        F.col("port_a").alias("a_port"), F.col("port_b").alias("b_port"), "bytes_a_to_b", "bytes_b_to_a",
        F.col("transport_protocol").alias("protocol"),
    )


def p2p_flows(raw: DataFrame) -> DataFrame:
    return _two_sided(raw, "p2p", ("obfuscated_a", "user_a"), ("obfuscated_b", "user_b"))


def nouser_flows(raw: DataFrame) -> DataFrame:
    return _two_sided(raw, "nouser", ("address_a", "ip_a"), ("address_b", "ip_b"))


def rejected_flows(raw: DataFrame) -> DataFrame:
    return annotate_raw_flows(raw).where(F.col("reject_reason").isNotNull())


def flow_destination(local_server: str) -> Column:
    """Coarse split of raw flows: local server, peer (both sides subscribers), remote, or no user at all."""
    a, b = F.col("obfuscated_a").isNotNull(), F.col("obfuscated_b").isNotNull()
    public = F.when(a & ~b, F.col("address_b")).when(b & ~a, F.col("address_a"))
    return (
        F.when(~a & ~b, "system").when(public == local_server, "local").when(a & b, "peer").otherwise("remote")
    )


def _dns_state() -> Column:
    src, dst = F.col("obfuscated_src").isNotNull(), F.col("obfuscated_dst").isNotNull()
    return (
        F.when(src & ~dst & F.col("src_ip").isNotNull(), "malformed")
        .when(src & ~dst & F.col("dest_ip").isNotNull(), "query side")
        .when(dst & ~src & F.col("src_ip").isNotNull(), "answer side")
        .otherwise("bad")
    )


def dns_responses(raw: DataFrame) -> DataFrame:
    """One row per answered address, subscriber first; addresses and ttls are paired up to the shorter list."""
    src = F.col("__state") == "query side"
    pick = lambda when_src, when_dst: F.when(src, F.col(when_src)).otherwise(F.col(when_dst))
    n = F.least(F.size("response_addresses"), F.size("response_ttls"))
    pairs = F.arrays_zip(
        F.slice("response_addresses", F.lit(1), n).alias("ip"), F.slice("response_ttls", F.lit(1), n).alias("ttl")
    )
    optional = [c for c in ("protocol", "opcode", "resultcode") if c in raw.columns]
    ports = (
        [pick("src_port", "dst_port").alias("user_port"), pick("dst_port", "src_port").alias("server_port")]
        if "src_port" in raw.columns else []
    )
    good = raw.withColumn("__state", _dns_state()).where(F.col("__state").isin("query side", "answer side"))
    exploded = good.withColumn("__pair", F.explode(pairs))
    return exploded.select(
        F.col("rec_id").alias("dns_id"), "ts", pick("obfuscated_src", "obfuscated_dst").alias("user_id"),
        pick("dest_ip", "src_ip").alias("dns_server"), *ports, *optional, F.col("host").alias("domain_name"),
        F.col("__pair.ip").alias("ip_address"), F.col("__pair.ttl").cast("int").alias("ttl"),
    )


def rejected_dns(raw: DataFrame) -> DataFrame:
    state = _dns_state()
    return raw.withColumn("reject_reason", state).where(state.isin("malformed", "bad"))


def deduplicate(archives: list[DataFrame], number: str = "rec_id") -> DataFrame:
    """Union of overlapping archives without copies (the time columns count).

    The record number is not compared, as every archive may number its records anew: the smallest number of the copies
    stays. A record without any number gets one from its contents, the same in every run.
    """
    union = archives[0]
    for other in archives[1:]:
        union = union.unionByName(other)
    if number not in union.columns:
        return union.dropDuplicates()
    contents = [c for c in union.columns if c != number]
    distinct = union.groupBy(*contents).agg(F.min(number).alias(number))
    return distinct.withColumn(number, F.coalesce(number, F.xxhash64(*contents))).select(*union.columns)


def deduplication_report(archives: list[DataFrame]) -> DataFrame:
    """Row counts before and after, from one aggregation that sends each distinct row once per input partition."""
    union = archives[0]
    for other in archives[1:]:
        union = union.unionByName(other)
    copies = union.groupBy(*union.columns).agg(F.count("*").alias("__n"))
    return copies.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("rows_before"), F.count("*").alias("rows_after")
    ).withColumn("duplicates", F.col("rows_before") - F.col("rows_after"))


def slim_dns(dns: DataFrame) -> DataFrame:
    return dns.select("ts", "user_id", "domain_name", "ip_address")


def slim_dns_with_id(dns: DataFrame) -> DataFrame:
    return dns.select("dns_id", "ts", "user_id", "domain_name", "ip_address")


def shift_to_local(df: DataFrame, *columns: str, hours: int = LOCAL_UTC_OFFSET_HOURS) -> DataFrame:
    return df.withColumns({c: F.col(c) + F.make_dt_interval(hours=F.lit(hours)) for c in columns})


def trim(df: DataFrame, ts: str, start: datetime, end: datetime) -> DataFrame:
    """Half-open date filter on a bare column, so that it reaches the scan."""
    return df.where(in_range(ts, start, end))


def trim_transactions(txns: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return trim(txns, "ts", start, end).withColumns(
        {
            "amount_bytes": F.coalesce("amount_bytes", F.lit(0)).cast("bigint"),
            "amount_idr": F.col("amount_idr").cast("bigint"),
        }
    )


def finalise_flows(flows: DataFrame) -> DataFrame:
    """Integer types and fully qualified names."""
    ints = {c: F.col(c).cast("int") for c in ("user_port", "dest_port", "protocol", "ambiguous_fqdn_count")}
    longs = {c: F.col(c).cast("bigint") for c in ("bytes_up", "bytes_down")}
    return flows.withColumns({**ints, **longs, "fqdn": qualify_domain("fqdn")})


def finalise_transactions(txns: DataFrame) -> DataFrame:
    user = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NO_USER))
    return txns.withColumns(
        {
            "amount_bytes": F.coalesce("amount_bytes", F.lit(0)).cast("bigint"),
            "user_id": user("user_id"),
            "dest_user_id": user("dest_user_id"),
        }
    )


def stitch_flows(flows: DataFrame, tolerance_seconds: float = 1.0, bucket_unit: str = "hour") -> DataFrame:
    """Join a flow with its continuation: same subscriber, ports and protocol, start within a second of the last end.

    Works on canonical flows, where a direction swap between the parts is already undone.
    """
    keys = ["user_id", "user_port", "dest_port", "protocol"]
    order = ["start_ts", "flow_id"]
    bucket = time_bucket("start_ts", bucket_unit)
    known = flows.dropna(subset=[*keys, "start_ts"])
    numbered = linked_sessions(
        known.select(*keys, *order, "end_ts", "dest_ip", "bytes_up", "bytes_down"), keys, order, bucket,
        lambda last, row: last["end_ts"].isNull()
        | (F.abs(micros_between(last["end_ts"], row["start_ts"])) > int(tolerance_seconds * 1_000_000)), "__part",
    )
    first = F.struct(*order)
    stitched = numbered.groupBy(*keys, "__part").agg(
        F.min_by("flow_id", first).alias("flow_id"), F.min("start_ts").alias("start_ts"),
        F.max_by("end_ts", first).alias("end_ts"), F.min_by("dest_ip", first).alias("dest_ip"),
        F.sum("bytes_up").alias("bytes_up"), F.sum("bytes_down").alias("bytes_down"),
        F.count("*").alias("parts"),
    ).drop("__part")
    # A flow without user, ports or start has no continuation.
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*keys, "start_ts")])
    alone = flows.where(incomplete).withColumn("parts", F.lit(1).cast("bigint"))
    return stitched.unionByName(alone.select(*stitched.columns))
