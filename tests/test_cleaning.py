"""Sources, canonical records, privacy and labelling on hand-written rows."""

import io
import re
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netledger.functions import naming, rule_tables as rt, traffic_class
from netledger.operators import canonical, enrich, privacy
from netledger.schemas import RAW_FLOW
from netledger.sources import raw_logs, tables, txn_log
from netledger.streaming import flows

T0 = datetime(2024, 1, 1)


def _values(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_transaction_log(spark):
    lines = [
        "2024-01-01 10:00:00 PURCHASE u1 10000000 500",
        "2024-01-01 10:00:01 USERTRANSFER u1 u2 ",
        "2024-01-01 10:00:02 USERTRANSFER u1 u2 2.5",
        "2024-01-01 10:00:03 USERTRANSFER u1 u2 3.5",
        "2024-01-01 10:00:04 TOPUP |u 3| 70",
        "2024-01-01 10:00:05 ADMINTRANSFER u1 u2 9",
        "2024-01-01 10:00:06 REFUND u1 9",
        "2024-01-01 10:00:07 TOPUP u1 nine",
        "yesterday noon TOPUP u1 9",
    ]
    parsed = txn_log.parse(spark.createDataFrame([(x,) for x in lines], "line string"))
    good = {r.line: r for r in txn_log.accepted(parsed).collect()}
    assert [good[x].amount_idr for x in lines[:6]] == [500, 0, 2, 4, 70, 9]
    assert good[lines[0]].amount_bytes == 10_000_000 and good[lines[0]].dest_user_id is None
    assert good[lines[4]].user_id is None and good[lines[4]].dest_user_id == "u 3"
    reasons = {r.line: r.reject_reason for r in txn_log.rejected(parsed).collect()}
    assert reasons == {lines[6]: "unknown kind", lines[7]: "bad amount", lines[8]: "bad timestamp"}


def test_nul_bytes(spark):
    df = spark.createDataFrame([("a\x00b\x00c",), ("plain",)], "line string")
    assert {(r.line, r.nul_count) for r in txn_log.strip_nul(df).collect()} == {("abc", 2), ("plain", 0)}
    assert txn_log.nul_report(df).first().asDict() == {"damaged_lines": 1, "nul_bytes": 2}


def test_raw_flows_from_json(spark, tmp_path):
    (tmp_path / "flows.json").write_text("\n".join([
        '{"rec_id": 1, "start_time": "2024-01-01T00:00:00", "end_time": "2024-01-01T00:00:09", "obfuscated_b": "u", '
        '"address_a": "1.1.1.1", "port_a": 443, "port_b": 5000, "bytes_a_to_b": 90, "bytes_b_to_a": 7, '
        '"transport_protocol": 6}',
        '{"rec_id": 2, "obfuscated_a": "u", "address_a": "1.1.1.1", "address_b": "2.2.2.2"}',
        '{"rec_id": 3, "address_a": "1.1.1.1"}',
        '{"rec_id": 4, "obfuscated_a": "u", "obfuscated_b": "v"}',
        '{"rec_id": 5, "address_a": "1.1.1.1", "address_b": "2.2.2.2"}',
    ]))
    raw = raw_logs.read_raw_flows(spark, str(tmp_path))
    row = canonical.typical_flows(raw).first()
    assert (row.user_id, row.dest_ip, row.user_port, row.dest_port, row.bytes_up, row.bytes_down) == (
        "u", "1.1.1.1", 5000, 443, 7, 90)
    assert {r.rec_id for r in canonical.rejected_flows(raw).collect()} == {2, 3}
    assert canonical.p2p_flows(raw).count() == 1 and canonical.nouser_flows(raw).count() == 1


def test_stitching_joins_near_parts_only(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        (1, at(0), at(10), "u", 5, 443, 6, "a", 1, 10), (2, at(11), at(20), "u", 5, 443, 6, "a", 2, 20),
        (3, at(22), at(30), "u", 5, 443, 6, "a", 4, 40), (4, at(11), at(20), "v", 5, 443, 6, "a", 8, 80),
    ]
    df = spark.createDataFrame(
        rows, "flow_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, user_id string, user_port int, "
        "dest_port int, protocol int, dest_ip string, bytes_up long, bytes_down long")
    got = {(r.flow_id, r.end_ts, r.bytes_up, r.bytes_down, r.parts) for r in canonical.stitch_flows(df).collect()}
    assert got == {(1, at(20), 3, 30, 2), (3, at(30), 4, 40, 1), (4, at(20), 8, 80, 1)}


def test_deduplication_is_idempotent_and_keeps_different_times(spark):
    df = spark.createDataFrame([(T0, "a"), (T0, "a"), (T0 + timedelta(1), "a")], "ts timestamp_ntz, x string")
    once = canonical.deduplicate([df, df])
    assert once.count() == 2 == canonical.deduplicate([once]).count()


def test_archives_with_own_numbers_overlap(spark):
    schema = "rec_id long, ts timestamp_ntz, x string"
    first = spark.createDataFrame([(1, T0, "a"), (2, T0, "b"), (None, T0, "c")], schema)
    second = spark.createDataFrame([(9, T0, "b"), (8, T0, None), (None, T0, "c"), (7, T0, None)], schema)
    got = {r.x: r.rec_id for r in canonical.deduplicate([first, second]).collect()}
    assert (got["a"], got["b"], got[None]) == (1, 2, 7) and got["c"] is not None and len(got) == 4
    assert got == {r.x: r.rec_id for r in canonical.deduplicate([second, first]).collect()}


def test_log_lines_are_numbered_in_log_order(spark, tmp_path):
    for name, first, n in (("a.txt", 0, 10), ("b.txt", 10, 5000), ("c.txt", 5010, 40)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(first, first + n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = txn_log.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line, r.line_no) for r in got] == [(f"line {i}", i) for i in range(5050)]


def test_late_flows_are_those_not_stored(spark):
    raw = spark.createDataFrame(
        [(i, T0, T0, "u", None, None, "1.1.1.1", 1, 2, n, 7, 6) for i, n in ((1, 5), (2, 5), (3, 6), (4, None))], RAW_FLOW)
    stored = canonical.typical_flows(raw.where("bytes_a_to_b = 6")).withColumn("start_ts", F.col("start_ts").cast("timestamp"))
    assert {(r.flow_id, r.bytes_up) for r in flows.late_flows(raw, stored).collect()} == {(1, 5), (4, None)}


def test_traceroute(spark, tmp_path):
    (tmp_path / "t.txt").write_text(
        "traceroute to x.org (1.2.3.4), 30 hops max\n 1 gw (10.0.0.1) 3.0 ms 6.0 ms 3.0 ms\n"
        " 2 * * *\n 3 y (1.2.3.4) 8.0 ms 9.0 ms 4.0 ms\n")
    rows = raw_logs.parse_traceroutes(raw_logs.read_traceroutes(spark, str(tmp_path))).orderBy("hop").collect()
    assert [(r.domain, r.hop, r.ip, r.latency, r.last_hop) for r in rows] == [
        ("x.org", 1, "10.0.0.1", 6.0, 0), ("x.org", 3, "1.2.3.4", 10.5, 1)]


def test_user_partitions_round_trip(spark, tmp_path):
    df = spark.range(1000).select(
        F.col("id"), (F.col("id") % 3).cast("string").alias("user_id"), F.lit(T0).alias("ts"))
    tables.write_user_partitioned(df, str(tmp_path / "x"), "user_id", "ts", 4, max_records_per_file=100)
    assert tables.merge_user_partitioned(spark, str(tmp_path / "x"), "ts", 4).count() == 1000


def test_masked_values_have_k_users(spark):
    rows = [(u, "big") for u in range(9)] + [(0, "big")] * 50 + [(u, "small") for u in range(4)] + [(1, None)]
    df = spark.createDataFrame(rows, "user_id int, org string")
    out = privacy.k_anonymise(df, "org", 5)
    assert out.count() == len(rows)
    assert {r.org: r["count"] for r in out.groupBy("org").count().collect()} == {
        "big": 59, "[Other Anonymized U<5]": 5}


def test_domain_rules_by_hand(spark):
    cases = {
        "yt3.googleusercontent.com": ("Google", "Non-video Content"),
        "ytimg.googleusercontent.com": ("Google", "Video"),
        "www.gstatic.com.edge": ("Google", "Non-video Content"),
        "connectivitycheck.gstatic.com": ("Google", "API"),
        "yt3.ggpht.com": ("Google", "Video"),
        "lh3.ggpht.com": ("Google", "Non-video Content"),
        "r1.gvt1.com": ("Google", "Mixed CDN"),
        "beacons.gvt2.com": ("Google", "API"),
        "accounts.google.com": ("Google", "API"),
        "android.clients.google.com": ("Google", "Software or Updates"),
        "clients4.google.com": ("Google", "API"),
        "strange.googleapis.com": ("Google", "API"),
        "x.1e100.net": ("Google", "Unknown (Not Mapped)"),
        "scontent.xx.fbcdn.net": ("Facebook", "Social Media"),
        "video.xx.fbcdn.net": ("Facebook", "Video"),
        "edge-chat.facebook.com": ("Facebook", "Messaging"),
        "connect.facebook.net": ("Facebook", "API"),
        "portal.fb.com": ("Facebook", "API"),
        "video.twimg.com": ("Twitter", "Video"),
        "abs.twimg.com": ("Twitter", "Social Media"),
        "s3.amazonaws.com": ("Amazon Web Services", "IAAS"),
        "www.amazon.com": ("Amazon", "Non-video Content"),
        "avatar.x1.com": ("Avatar Tracker", "Ad Network"),
        "avatar.x1.net": ("Unknown (Not Mapped)", "Unknown (Not Mapped)"),
        "ev.rdtcdn.com": ("RdtCDN", "Mixed CDN"),
        "": ("Unknown (No DNS)", "Unknown (No DNS)"),
        None: ("Unknown (No DNS)", "Unknown (No DNS)"),
    }
    names = list(cases)
    orgs = _values(spark, names, traffic_class.domain_org("v"))
    categories = _values(spark, names, traffic_class.domain_category("v"))
    assert dict(zip(names, zip(orgs, categories))) == cases


def test_every_domain_token_leads_to_a_label(spark):
    rules = rt.token_rules(rt.DOMAIN_TOKENS)
    for tokens, also, org, category in rules:
        for token in tokens:
            name = token + (also or "")
            first = next(r for r in rules if any(t in name for t in r[0]) and (r[1] is None or r[1] in name))
            assert first[2], (name, org, category)
    for table in (rt.GOOGLE_PATTERNS, rt.FACEBOOK_PATTERNS):
        listed = [p for p, _ in rt.patterns(table)]
        assert len(listed) == len(set(listed))
        assert all(re.compile(p) for p in listed)


@pytest.mark.parametrize("ip,local", [
    ("10.1.2.3", True), ("192.168.0.1", True), ("100.64.0.1", True), ("172.31.0.1", True), ("172.32.0.1", False),
    ("8.8.8.8", False), ("224.0.0.1", False), ("255.255.255.255", True), ("198.19.0.1", True), ("nonsense", False),
    ("fe80:0000:0000:0000:0000:0000:0000:0001", True), ("2607:f8b0:4005:0805:0000:0000:0000:200e", False),
    ("::1", True), ("::", True), ("::ffff:10.0.0.1", True), ("2001:DB8::1", True), ("2607:f8b0:4005:805::200e", False),
    ("fe80::1::2", False), ("::fe80:zz", False), (None, False), ("", False),
])
def test_local_addresses(spark, ip, local):
    assert _values(spark, [ip], naming.ip_is_local("v")) == [local]


def test_an_address_is_read_once_per_row(spark):
    """Every block is compared with one number: the address text is not taken apart again for each of them."""
    df = spark.createDataFrame([("10.1.2.3",)], "v string").select(naming.ip_is_local("v").alias("local"))
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("simple")
    assert 1 <= text.getvalue().count(r"^\d{1,3}(") <= 2  # the address, and an IPv4 tail of an IPv6 one


def test_names(spark):
    names = ["a.b.example.com.", "x.y.co.uk", "localhost", "", "dokter-sehat-com.cdn.ampproject.org.",
             "alodokter.page.link."]
    assert _values(spark, names, naming.primary_domain("v")) == [
        "example.com.", "y.co.uk.", "localhost.", ".", "ampproject.org.", "page.link."]
    assert _values(spark, names, naming.health_primary_domain("v"))[4:] == ["sehat.com.", "alodokter.com."]
    assert _values(spark, [" a.b ", "a.b."], naming.qualify_domain("v")) == ["a.b.", "a.b."]
    sites = ["www.halodoc-DOKTER.com", "wholesale.com", "samsunghealth.com", "covid19.go.id", "example.com"]
    assert _values(spark, sites, naming.is_health("v")) == [True, False, False, True, False]


def test_address_rules_keep_their_order(spark):
    ips = ["157.240.25.1", "169.136.65.204", "74.125.1.1", "1.74.125.1", "8.37.232.4", "9.9.9.9"]
    assert _values(spark, ips, traffic_class.address_org("v")) == [
        "Facebook", "Likee", "Google", "Unknown (No DNS)", "Level3", "Unknown (No DNS)"]


def test_asof_names(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    flows = spark.createDataFrame(
        [(1, at(5), "u", "ip"), (2, at(10), "u", "ip"), (3, at(0), "u", "ip"), (4, at(10), "v", "ip"),
         (5, at(4000), "u", "ip"), (6, at(1), None, "ip")],
        "flow_id long, start_ts timestamp_ntz, user_id string, dest_ip string")
    dns = spark.createDataFrame(
        [(1, at(5), "u", "ip", "a"), (2, at(7), "u", "ip", "b"), (3, at(8), "u", "ip", "a"), (4, at(9), "u", "x", "c")],
        "dns_id long, ts timestamp_ntz, user_id string, ip_address string, domain_name string")
    got = {r.flow_id: (r.fqdn, r.ambiguous_fqdn_count) for r in enrich.attribute_dns(flows, dns).collect()}
    # An answer at the very start counts; the name told last wins however long ago it was told.
    assert got == {1: ("a", 1), 2: ("a", 2), 3: (None, None), 4: (None, None), 5: ("a", 2), 6: (None, None)}
