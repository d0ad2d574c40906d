"""The whole way from raw records to the shared tables, on the generated raw views."""

import os

import pytest
from pyspark.sql import functions as F

from netledger.operators.canonical import nouser_flows, p2p_flows, rejected_dns, typical_flows
from netledger.plans import pipeline
from netledger.verify.fixtures import PARAMS, Fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_raw_archives_to_shared_tables(spark):
    fx = Fixtures(spark, SF)
    raw, dns = fx.view("fx_raw_flow"), fx.view("fx_raw_dns")
    reverse = raw.where(F.col("address_b").isNotNull()).select(
        F.col("address_b").alias("ip"), F.concat(F.lit("h-"), F.replace("address_b", F.lit("."), F.lit("-"))).alias("name")
    ).distinct()
    # The second archive numbers its records anew.
    again = raw.withColumn("rec_id", F.col("rec_id") + 1_000_000)
    tables = pipeline.clean_flows([raw, again], [dns], reverse, PARAMS.with_(k_anonymity=2))
    routed = sum(canonical(raw).count() for canonical in (typical_flows, p2p_flows, nouser_flows))
    assert routed + tables["rejected_flows"].count() == raw.count()
    assert tables["flows_typical"].count() <= typical_flows(raw).count()
    assert tables["rejected_dns"].count() == rejected_dns(dns).count() > 0
    flows = tables["flows_typical"]
    kept = flows.agg(F.count("*").alias("n"), F.countDistinct("flow_id").alias("ids")).first()
    assert kept.n == kept.ids > 0
    assert {r.category for r in flows.select("category").distinct().collect()} <= {
        "Peer to Peer", "Unknown (Not Mapped)", "Unknown (No DNS)", "ICE (STUN/TURN)"}
    txns = pipeline.clean_transactions(fx.view("fx_txn_log").select("line", "line_no"), PARAMS)
    assert txns["transactions"].count() > 0 and txns["rejected_lines"].count() > 0
    shared = pipeline.shared_intermediates(
        flows, tables["flows_p2p"], txns["transactions"], txns["initial_user_balances"], PARAMS)
    assert shared["user_active_deltas"].count() > 0 and shared["running_balances"].count() > 0
    for name in ("running_balances", "untainted_transactions", "consolidated_purchases", "user_data_balance"):
        assert shared[name].where("user_id = '[None]'").count() == 0, name
