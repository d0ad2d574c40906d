"""k-anonymity: mask values that too few users share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netledger.functions.naming import primary_domain
from netledger.params import MIN_K_ANON


def mask_label(k: int) -> str:
    return f"[Other Anonymized U<{k}]"


def users_per_value(df: DataFrame, value: Column, user: str = "user_id", counted: Column | None = None) -> DataFrame:
    """Distinct users per value. Distinct (value, user) pairs are formed first, so a value that everybody shares is
    counted from one row per user, spread over the cluster, instead of in one task."""
    rows = df if counted is None else df.where(counted)
    pairs = rows.select(value.alias("__value"), F.col(user).alias("__user")).dropna().distinct()
    return pairs.groupBy("__value").agg(F.count("*").alias("__users"))


def k_anonymise(df: DataFrame, mask: str, k: int = MIN_K_ANON, group: Column | None = None, user: str = "user_id",
                counted: Column | None = None, label: str | None = None) -> DataFrame:
    """Replace `mask` where its group value (by default itself) is shared by fewer than k users or is NULL."""
    value = F.col(mask) if group is None else group
    counts = users_per_value(df, value, user, counted)
    joined = df.withColumn("__value", value).join(counts, "__value", "left")
    masked = F.when(F.col("__users") >= k, F.col(mask)).otherwise(F.lit(label or mask_label(k)))
    return joined.withColumn(mask, masked).select(*df.columns)


def anonymise_flows(flows: DataFrame, k: int = MIN_K_ANON) -> DataFrame:
    """Organisation, then address, then host name (counted on the primary domain)."""
    counted = F.col("bytes_up").isNotNull()
    flows = k_anonymise(flows, "org", k, counted=counted)
    flows = k_anonymise(flows, "dest_ip", k, counted=counted)
    return k_anonymise(flows, "fqdn", k, group=primary_domain("fqdn"), counted=counted)


def merge_small_orgs(totals: DataFrame, k: int = MIN_K_ANON) -> DataFrame:
    """Organisations with traffic from fewer than k users become one (users without any bytes do not count)."""
    return k_anonymise(totals, "org", k, counted=F.col("bytes_total") != 0, label=f"Aggregated (Users < {k})")
