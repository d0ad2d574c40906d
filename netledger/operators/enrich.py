"""Name resolution and traffic classification of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netledger.functions.naming import ip_is_local
from netledger.functions.traffic_class import (
    PASSTHROUGH_CATEGORY, PASSTHROUGH_ORG, address_category, address_org, domain_category, domain_org,
    name_spells_address,
)
from netledger.functions.rule_tables import ADDRESS_TOKENS, token_rules
from netledger.operators.scan import prefix_scan, time_bucket
from netledger.params import ICE, UNKNOWN_NO_DNS, UNKNOWN_NOT_MAPPED


def attribute_dns(flows: DataFrame, dns: DataFrame, bucket_unit: str = "hour") -> DataFrame:
    """As-of join: each flow gets the latest name its user was told for the destination address by its start.

    An answer at the very start counts. ambiguous_fqdn_count is the number of different names the user had been told
    for that address by then. Flows without an answer (also of users without any DNS log) keep NULL names.

    Three kinds of rows share one order per (user, address): every answer, the first answer of every distinct name
    (these alone count), and the flows that look back.
    """
    known = dns.dropna(subset=["user_id", "ip_address", "domain_name", "ts"])
    keyed = flows.dropna(subset=["user_id", "dest_ip", "start_ts"])
    none = lambda kind: F.lit(None).cast(kind)
    flow_cols = [c for c in flows.columns if c not in ("user_id", "dest_ip")]
    payload = F.struct(*flow_cols)
    payload_type = flows.select(payload.alias("p")).schema["p"].dataType

    answers = known.select(
        "user_id", F.col("ip_address").alias("__ip"), F.col("ts").alias("__ts"), F.lit(0).alias("__kind"),
        F.col("dns_id").alias("__id"), F.col("domain_name").alias("__name"), F.lit(0).alias("__new"),
        none(payload_type).alias("__flow"),
    )
    first_told = known.groupBy("user_id", "ip_address", "domain_name").agg(F.min("ts").alias("__ts")).select(
        "user_id", F.col("ip_address").alias("__ip"), "__ts", F.lit(0).alias("__kind"),
        F.lit(-1).cast("bigint").alias("__id"), none("string").alias("__name"), F.lit(1).alias("__new"),
        none(payload_type).alias("__flow"),
    )
    probes = keyed.select(
        "user_id", F.col("dest_ip").alias("__ip"), F.col("start_ts").alias("__ts"), F.lit(1).alias("__kind"),
        F.col("flow_id").alias("__id"), none("string").alias("__name"), F.lit(0).alias("__new"),
        payload.alias("__flow"),
    )
    timeline = answers.unionByName(first_told).unionByName(probes)
    scanned = prefix_scan(
        timeline, ["user_id", "__ip"], ["__ts", "__kind", "__id"], time_bucket("__ts", bucket_unit),
        sums={"__told": F.col("__new")}, lasts={"fqdn": F.col("__name")},
    )
    resolved = scanned.where(F.col("__kind") == 1).select(
        *[F.col("user_id") if c == "user_id" else F.col("__ip").alias(c) if c == "dest_ip" else F.col(f"__flow.{c}")
          for c in flows.columns],
        "fqdn",
        F.when(F.col("fqdn").isNotNull(), F.col("__told")).cast("int").alias("ambiguous_fqdn_count"),
        F.when(F.col("fqdn").isNotNull(), F.lit("user_dns_log")).alias("fqdn_source"),
    )
    incomplete = F.col("user_id").isNull() | F.col("dest_ip").isNull() | F.col("start_ts").isNull()
    unkeyed = flows.where(incomplete).select(
        "*", none("string").alias("fqdn"), none("int").alias("ambiguous_fqdn_count"),
        none("string").alias("fqdn_source"),
    )
    return resolved.unionByName(unkeyed)


def fill_reverse_names(flows: DataFrame, reverse_names: DataFrame) -> DataFrame:
    """Unresolved flows to global addresses take the name of a reverse look-up table (ip, name); others get ''."""
    # The table has one row per address, so the join cannot multiply flows.
    names = reverse_names.select(F.col("ip").alias("dest_ip"), F.col("name").alias("__name")).dropna()
    names = names.groupBy("dest_ip").agg(F.min("__name").alias("__name"))
    unresolved = F.col("fqdn").isNull()
    found = unresolved & F.col("__name").isNotNull() & ~ip_is_local("dest_ip")
    return flows.join(names, "dest_ip", "left").withColumns(
        {
            "fqdn": F.when(found, F.col("__name")).when(unresolved, F.lit("")).otherwise(F.col("fqdn")),
            "ambiguous_fqdn_count": F.when(found, F.lit(1)).when(unresolved, F.lit(0))
            .otherwise(F.col("ambiguous_fqdn_count")),
            "fqdn_source": F.when(found, F.lit("reverse_dns")).when(unresolved, F.lit("none"))
            .otherwise(F.col("fqdn_source")),
        }
    ).select(*flows.columns)


def classify_names(flows: DataFrame) -> DataFrame:
    """org and category from the host name. The long rule list runs once per distinct name, then joins back."""
    names = flows.select("fqdn").where(F.col("fqdn") != "").distinct()
    labels = names.select(
        "fqdn", domain_org("fqdn").alias("org"), domain_category("fqdn").alias("category")
    )
    base = flows.drop("org", "category")
    return base.join(labels, "fqdn", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(UNKNOWN_NO_DNS)) for c in ("org", "category")}
    ).select(*base.columns, "org", "category")


def override_stun_port(flows: DataFrame) -> DataFrame:
    """UDP 3478 is session set-up traffic whatever the name says."""
    stun = (F.col("protocol") == 17) & (F.col("dest_port") == 3478)
    return flows.withColumn("category", F.when(stun, F.lit(ICE)).otherwise(F.col("category")))


def flag_local(flows: DataFrame) -> DataFrame:
    return flows.withColumn("is_local", ip_is_local("dest_ip"))


def label_social_addresses(flows: DataFrame) -> DataFrame:
    """First address pass: unresolved flows to the first address rule get its labels, each field on its own."""
    prefixes, _, org, category = token_rules(ADDRESS_TOKENS)[0]
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.col("dest_ip").contains(prefix)
    fill = lambda c, v: F.when((F.col(c) == UNKNOWN_NO_DNS) & hit, F.lit(v)).otherwise(F.col(c))
    return flows.withColumns({"org": fill("org", org), "category": fill("category", category)})


def label_addresses(flows: DataFrame) -> DataFrame:
    """Second address pass: all address rules, for org and category separately."""
    fill = lambda c, v: F.when(F.col(c) == UNKNOWN_NO_DNS, v).otherwise(F.col(c))
    return flows.withColumns(
        {"org": fill("org", address_org("dest_ip")), "category": fill("category", address_category("dest_ip"))}
    )


def label_passthrough_peers(flows: DataFrame) -> DataFrame:
    """Reverse names that spell out the address belong to subscriber hosts: label them as peers."""
    peer = (
        (F.col("org") == UNKNOWN_NOT_MAPPED) & (F.col("category") == UNKNOWN_NOT_MAPPED)
        & (F.col("fqdn_source") == "reverse_dns") & name_spells_address("dest_ip", "fqdn")
    )
    # Both values are set from the state before this pass.
    return flows.withColumns(
        {
            "org": F.when(peer, F.lit(PASSTHROUGH_ORG)).otherwise(F.col("org")),
            "category": F.when(peer, F.lit(PASSTHROUGH_CATEGORY)).otherwise(F.col("category")),
        }
    )


def classify_flows(flows: DataFrame) -> DataFrame:
    """Names, set-up port, first address pass and locality, in the order in which they override each other."""
    return flag_local(label_social_addresses(override_stun_port(classify_names(flows))))


def nouser_kind() -> Column:
    silent = F.col("bytes_b_to_a") == 0
    return (
        F.when((F.col("b_port") == 1900) & silent, "SSDP Query (No Answer)")
        .when(silent, "Unanswered").otherwise("Unknown")
    )


def p2p_kind() -> Column:
    return F.when((F.col("bytes_a_to_b") == 0) | (F.col("bytes_b_to_a") == 0), "One-Way").otherwise("Two-Way")


def unmapped_heavy_hitters(flows: DataFrame, n: int = 50) -> DataFrame:
    """The n names with most unmapped traffic in each direction (ties by name)."""
    totals = (
        flows.where((F.col("org") == UNKNOWN_NOT_MAPPED) | (F.col("category") == UNKNOWN_NOT_MAPPED))
        .where(F.col("fqdn").isNotNull())
        .groupBy("fqdn").agg(F.sum("bytes_up").alias("bytes_up"), F.sum("bytes_down").alias("bytes_down"))
    )
    top = lambda c, label: totals.orderBy(F.desc(c), "fqdn").limit(n).select(
        F.lit(label).alias("direction"), "fqdn", "bytes_up", "bytes_down"
    )
    return top("bytes_down", "Downlink").unionByName(top("bytes_up", "Uplink"))


def unknown_destinations(flows: DataFrame, n: int = 40) -> DataFrame:
    unknown = flows.where((F.col("category") == UNKNOWN_NO_DNS) | (F.col("org") == UNKNOWN_NO_DNS))
    return (
        unknown.where(F.col("dest_ip").isNotNull()).groupBy("dest_ip")
        .agg(F.sum(F.col("bytes_up") + F.col("bytes_down")).alias("bytes_total"))
        .orderBy(F.desc("bytes_total"), "dest_ip").limit(n)
    )
