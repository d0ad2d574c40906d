"""Tagging of peer-to-peer traffic that follows a STUN/TURN set-up.

A set-up flow (UDP 3478) lets later flows from the same user port count as related for a while; a related flow of an
unknown or generic kind is relabelled and in turn keeps its own 5-tuple related until shortly after it ends. That
second rule is recursive. It is solved without a per-user state machine:

* Whether a flow starts within reach of a set-up ("seeded") is an as-of look-up per (user, port).
* A flow that is not seeded is related only through an unbroken chain of flows of its 5-tuple that starts at a
  seeded one. Cut each 5-tuple into islands (runs in which every flow starts before the latest end so far plus the
  grace time). What precedes the first seeded flow of an island cannot be related, because nothing related reaches
  into it. Drop that part and cut again, since it may have held an island together; when every island starts with a
  seeded flow, all flows that are left are related.

Each round removes rows for good, so the loop ends; every step is a two-level scan that splits hot keys by time. A
5-tuple that lost nothing in a round is settled and leaves the loop, so a round's work is what the last one changed.
5-tuples without any seeded flow hold nothing related and stay out of all rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netledger.functions.timebins import micros_between, plus_seconds
from netledger.operators.scan import prefix_scan, sessions, time_bucket
from netledger.params import ICE, PEER_TO_PEER, UNKNOWN_NO_DNS, UNKNOWN_NOT_MAPPED
from netledger.session import materialise, scratch_path

PEER_ORG = "ICE Peer (Unknown Org)"
_TUPLE = ["user_id", "user_port", "dest_port", "protocol", "dest_ip"]


def is_setup() -> Column:
    return F.coalesce((F.col("protocol") == 17) & (F.col("dest_port") == 3478), F.lit(False))


def related_label() -> Column:
    """What a flow would become if it were related: 'peer', 'ice', or NULL where its own label stands."""
    unknown = F.col("category").isin(UNKNOWN_NO_DNS, UNKNOWN_NOT_MAPPED) & F.col("org").contains("Unknown")
    generic_host = F.col("fqdn").contains("emome-ip.hinet.net")
    ice = (
        F.col("fqdn").contains("turnservice") | F.col("fqdn").contains("facebook") | (F.col("org") == "Facebook")
        | (F.col("category") == UNKNOWN_NOT_MAPPED) | (F.col("category") == "API")
    )
    return F.when(~is_setup(), F.when(unknown | generic_host, "peer").when(ice, "ice"))


def _seeded(flows: DataFrame, setup_seconds: int, unit: str) -> DataFrame:
    """Candidate starts per 5-tuple with their latest end and whether a set-up of the same port is fresh."""
    candidates = (
        flows.where(F.col("__label").isNotNull()).groupBy(*_TUPLE, "start_ts").agg(F.max("end_ts").alias("end_ts"))
    )
    setups = flows.where(is_setup()).select("user_id", "user_port", "start_ts").distinct()
    none = lambda c: F.lit(None).cast(flows.schema[c].dataType).alias(c)
    timeline = candidates.select(
        *_TUPLE, "start_ts", "end_ts", F.lit(1).alias("__kind")
    ).unionByName(
        setups.select("user_id", "user_port", none("dest_port"), none("protocol"), none("dest_ip"), "start_ts",
                      none("end_ts"), F.lit(0).alias("__kind"))
    )
    scanned = prefix_scan(
        timeline, ["user_id", "user_port"], ["start_ts", "__kind", "dest_ip", "dest_port", "protocol"],
        time_bucket("start_ts", unit), lasts={"__setup": F.when(F.col("__kind") == 0, F.col("start_ts"))},
    )
    fresh = micros_between("__setup", "start_ts") < setup_seconds * 1_000_000
    return scanned.where(F.col("__kind") == 1).select(
        *_TUPLE, "start_ts", "end_ts", F.coalesce(fresh, F.lit(False)).alias("__seed")
    )


def _mark_reached(candidates: DataFrame, grace_seconds: int, unit: str) -> DataFrame:
    """One round: cut into islands and mark with __kept what each holds from its first seeded flow on."""
    bucket = time_bucket("start_ts", unit)
    reach = materialise(prefix_scan(
        candidates, _TUPLE, ["start_ts"], bucket, maxes={"__reach": F.col("end_ts")}, inclusive=False
    ), "reach")
    cut = F.col("__reach").isNull() | (plus_seconds("__reach", grace_seconds) <= F.col("start_ts"))
    islands = materialise(sessions(reach, _TUPLE, ["start_ts"], bucket, cut, "__island"), "islands")
    first_seed = islands.groupBy(*_TUPLE, "__island").agg(
        F.min(F.when(F.col("__seed"), F.col("start_ts"))).alias("__from")
    )
    kept = F.coalesce(F.col("start_ts") >= F.col("__from"), F.lit(False))
    return islands.join(first_seed, [*_TUPLE, "__island"]).select(*candidates.columns, kept.alias("__kept"))


def _reached(candidates: DataFrame, grace_seconds: int, unit: str) -> DataFrame:
    """All rounds: the candidates that an unbroken chain connects to a seeded flow.

    No chain leads out of a 5-tuple, so those without any seeded flow take part in no round.
    """
    settled = scratch_path(candidates.sparkSession, "settled")
    schema = candidates.schema
    with_seed = candidates.where("__seed").select(*_TUPLE).distinct()
    candidates = materialise(candidates.join(with_seed, _TUPLE, "left_semi").select(*schema.names), "open")
    while True:
        marked = materialise(_mark_reached(candidates, grace_seconds, unit), "marked")
        changed = marked.where(~F.col("__kept")).select(*_TUPLE).distinct()
        kept = marked.where("__kept").select(*candidates.columns)
        kept.join(changed, _TUPLE, "left_anti").select(*schema.names).write.mode("append").parquet(settled)
        candidates = materialise(kept.join(changed, _TUPLE, "left_semi").select(*schema.names), "open")
        if candidates.isEmpty():
            return candidates.sparkSession.read.schema(schema).parquet(settled)


def tag_related_flows(flows: DataFrame, setup_seconds: int = 60, grace_seconds: int = 5,
                      bucket_unit: str = "hour") -> DataFrame:
    """Relabel flows related to a STUN/TURN set-up; all other rows and columns stay as they are."""
    labelled = flows.withColumn("__label", related_label())
    keyed = labelled.dropna(subset=_TUPLE)
    left = _reached(materialise(_seeded(keyed, setup_seconds, bucket_unit), "seeded"), grace_seconds, bucket_unit)
    related = left.select(*_TUPLE, "start_ts").withColumn("__related", F.lit(True))
    hit = F.col("__related") & F.col("__label").isNotNull()
    return labelled.join(related, [*_TUPLE, "start_ts"], "left").withColumns(
        {
            "category": F.when(hit & (F.col("__label") == "peer"), F.lit(PEER_TO_PEER))
            .when(hit & (F.col("__label") == "ice"), F.lit(ICE)).otherwise(F.col("category")),
            "org": F.when(hit & (F.col("__label") == "peer"), F.lit(PEER_ORG)).otherwise(F.col("org")),
        }
    ).select(*flows.columns)
