"""Study-shaped views over the generated test tables, as SQL that Spark and DuckDB both run unchanged."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from netledger.params import StudyParams

# The study calendar that fits the generated events.
PARAMS = StudyParams(
    min_date=datetime(2024, 1, 2), max_date=datetime(2024, 2, 1),
    outage_start=datetime(2024, 1, 10), outage_end=datetime(2024, 1, 13),
    exploit_start=datetime(2024, 1, 20), exploit_end=datetime(2024, 1, 24),
    lockdown=datetime(2024, 1, 16),
)

VIEWS: dict[str, str] = {
    "fx_flows": """
SELECT event_id AS flow_id, ts AS start_ts,
       ts + INTERVAL '1' SECOND * CAST(floor(value * 20) AS INT) AS end_ts,
       user_id,
       concat(CASE event_id % 8 WHEN 0 THEN '157.240.25.' WHEN 1 THEN '74.125.0.' WHEN 2 THEN '8.8.8.'
                                WHEN 3 THEN '224.0.0.' WHEN 4 THEN '100.64.0.' WHEN 5 THEN '10.0.0.'
                                WHEN 6 THEN '202.80.222.' ELSE '192.168.1.' END,
              CAST(event_id % 40 AS STRING)) AS dest_ip,
       CAST(40000 + event_id % 500 AS INT) AS user_port,
       CAST(CASE event_id % 6 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 3478
                              WHEN 4 THEN 123 ELSE 9999 END AS INT) AS dest_port,
       CAST(CASE WHEN event_id % 4 < 2 THEN 6 ELSE 17 END AS INT) AS protocol,
       CAST(round(value * 100) AS BIGINT) AS bytes_up,
       CAST(round(value * 900) AS BIGINT) AS bytes_down,
       CASE event_id % 13 WHEN 0 THEN 'www.google.com' WHEN 1 THEN 'r1.googlevideo.com'
            WHEN 2 THEN 'scontent.xx.fbcdn.net' WHEN 3 THEN 'graph.facebook.com'
            WHEN 4 THEN 'mmg.whatsapp.net' WHEN 5 THEN 'video.twimg.com' WHEN 6 THEN 'cdn.tiktokcdn.com'
            WHEN 7 THEN 'health.example.co.id' WHEN 8 THEN 'id.example.org' WHEN 9 THEN 'd1.cloudfront.net'
            WHEN 10 THEN '' WHEN 11 THEN '1-2.emome-ip.hinet.net' ELSE 'unmapped.example.net' END AS fqdn,
       CASE event_id % 3 WHEN 0 THEN 'user_dns_log' WHEN 1 THEN 'reverse_dns' ELSE 'none' END AS fqdn_source,
       CAST(event_id % 3 AS INT) AS ambiguous_fqdn_count,
       CASE event_id % 12 WHEN 0 THEN 'Video' WHEN 1 THEN 'Adult Video' WHEN 2 THEN 'Social Media' WHEN 3 THEN 'API'
            WHEN 4 THEN 'Messaging' WHEN 5 THEN 'Unknown (No DNS)' WHEN 6 THEN 'Unknown (Not Mapped)'
            WHEN 7 THEN 'Peer to Peer' WHEN 8 THEN 'ICE (STUN/TURN)' WHEN 9 THEN 'Games'
            WHEN 10 THEN 'IAAS' ELSE 'Ad Network' END AS category,
       CASE WHEN event_id % 12 IN (5, 6) THEN 'Unknown (No DNS)'
            ELSE CASE event_id % 5 WHEN 0 THEN 'Google' WHEN 1 THEN 'Facebook' WHEN 2 THEN 'WhatsApp'
                 WHEN 3 THEN 'Instagram' ELSE concat('org', CAST(event_id % 47 AS STRING)) END END AS org,
       event_id % 10 = 0 AS is_local
FROM events
""",
    "fx_daily": """
SELECT o.o_custkey AS user_id, CAST(l.l_shipdate AS DATE) AS day, p.p_type AS category, p.p_brand AS org,
       CAST(round(l.l_extendedprice * l.l_discount * 100) AS BIGINT) AS bytes_up,
       CAST(round(l.l_extendedprice * 100) AS BIGINT) AS bytes_down,
       l.l_suppkey % 10 = 0 AS is_local
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
""",
    "fx_p2p": """
SELECT event_id AS flow_id, ts AS start_ts, ts + INTERVAL '1' SECOND * CAST(floor(value) AS INT) AS end_ts,
       user_id AS user_a, (user_id * 5 + event_id) % 150 AS user_b,
       CAST(50000 + event_id % 100 AS INT) AS a_port, CAST(event_id % 3 + 5000 AS INT) AS b_port,
       CAST(round(value * 10) AS BIGINT) AS bytes_a_to_b,
       CASE WHEN event_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(round(value * 20) AS BIGINT) END AS bytes_b_to_a,
       CAST(17 AS INT) AS protocol
FROM events
""",
    "fx_nouser": """
SELECT event_id AS flow_id, ts AS start_ts, ts + INTERVAL '1' SECOND * CAST(floor(value) AS INT) AS end_ts,
       concat('10.1.0.', CAST(event_id % 20 AS STRING)) AS ip_a, concat('239.255.255.', CAST(event_id % 9 AS STRING)) AS ip_b,
       CAST(50000 + event_id % 100 AS INT) AS a_port,
       CAST(CASE WHEN event_id % 3 = 0 THEN 1900 ELSE 137 END AS INT) AS b_port,
       CAST(round(value * 10) AS BIGINT) AS bytes_a_to_b,
       CASE WHEN event_id % 4 < 3 THEN CAST(0 AS BIGINT) ELSE CAST(round(value * 5) AS BIGINT) END AS bytes_b_to_a,
       CAST(17 AS INT) AS protocol
FROM events
""",
    "fx_dns": """
SELECT event_id AS dns_id, ts + INTERVAL '1' SECOND * CAST(event_id % 7 * 1000 - 1000 AS INT) AS ts, user_id,
       concat(CASE event_id % 8 WHEN 0 THEN '157.240.25.' WHEN 1 THEN '74.125.0.' WHEN 2 THEN '8.8.8.'
                                WHEN 3 THEN '224.0.0.' WHEN 4 THEN '100.64.0.' WHEN 5 THEN '10.0.0.'
                                WHEN 6 THEN '202.80.222.' ELSE '192.168.1.' END,
              CAST(event_id % 40 AS STRING)) AS ip_address,
       CASE event_id % 11 WHEN 0 THEN 'www.google.com' WHEN 1 THEN 'r1.googlevideo.com'
            WHEN 2 THEN 'scontent.xx.fbcdn.net' WHEN 3 THEN 'graph.facebook.com' WHEN 4 THEN 'mmg.whatsapp.net'
            WHEN 5 THEN 'video.twimg.com' WHEN 6 THEN 'cdn.tiktokcdn.com' WHEN 7 THEN 'health.example.co.id'
            WHEN 8 THEN 'id.example.org' WHEN 9 THEN 'd1.cloudfront.net' ELSE 'unmapped.example.net' END AS domain_name
FROM events
""",
    "fx_transactions": """
SELECT event_id AS txn_id, ts,
       CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'signup' THEN 'admin_topup'
                       WHEN 'view' THEN 'admin_transfer' ELSE 'user_transfer' END AS kind,
       CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS user_id,
       CASE event_type WHEN 'purchase' THEN NULL WHEN 'signup' THEN user_id
            WHEN 'error' THEN CASE WHEN event_id % 7 = 0 THEN user_id ELSE (user_id * 7 + event_id) % 150 END
            ELSE (user_id * 3 + event_id) % 150 END AS dest_user_id,
       CASE WHEN event_type = 'purchase' THEN CAST(CASE event_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 400 ELSE 1000 END AS BIGINT) * 1000000
            ELSE CAST(0 AS BIGINT) END AS amount_bytes,
       CAST(round(value * 100) AS BIGINT) AS amount_idr
FROM events
""",
    "fx_raw_flow": """
SELECT event_id AS rec_id, ts AS start_time, ts + INTERVAL '1' SECOND * CAST(floor(value) AS INT) AS end_time,
       CASE WHEN event_id % 10 IN (0, 1, 2, 3, 4, 8) THEN concat('u', CAST(user_id AS STRING)) END AS obfuscated_a,
       CASE WHEN event_id % 10 IN (5, 6, 7, 8) THEN concat('u', CAST((user_id + 1) % 150 AS STRING)) END AS obfuscated_b,
       CASE WHEN event_id % 10 IN (5, 6, 7, 9) OR event_id % 101 = 0 THEN concat('8.8.4.', CAST(event_id % 200 AS STRING)) END AS address_a,
       CASE WHEN event_id % 10 IN (0, 1, 2, 3, 4, 9) THEN concat('9.9.9.', CAST(event_id % 200 AS STRING)) END AS address_b,
       CAST(40000 + event_id % 500 AS INT) AS port_a, CAST(443 + event_id % 3 AS INT) AS port_b,
       CAST(round(value * 100) AS BIGINT) AS bytes_a_to_b, CAST(round(value * 300) AS BIGINT) AS bytes_b_to_a,
       CAST(6 AS INT) AS transport_protocol
FROM events
""",
    "fx_raw_dns": """
SELECT event_id AS rec_id, ts,
       CASE WHEN event_id % 5 < 3 THEN concat('u', CAST(user_id AS STRING)) END AS obfuscated_src,
       CASE WHEN event_id % 5 IN (3, 0) THEN concat('u', CAST(user_id AS STRING)) END AS obfuscated_dst,
       CASE WHEN event_id % 5 IN (3, 4) THEN '1.1.1.1' END AS src_ip,
       CASE WHEN event_id % 5 IN (1, 2, 4) AND event_id % 17 <> 0 THEN '9.9.9.9' END AS dest_ip,
       concat('h', CAST(event_id % 30 AS STRING), '.example.com') AS host,
       split(CASE event_id % 3 WHEN 0 THEN '5.5.5.1' WHEN 1 THEN '5.5.5.1,5.5.5.2' ELSE '5.5.5.1,5.5.5.2,5.5.5.3' END, ',') AS response_addresses,
       split(CASE event_id % 2 WHEN 0 THEN '60' ELSE '60,120' END, ',') AS response_ttls
FROM events
""",
    "fx_txn_log": """
SELECT event_id AS line_no,
       concat(CAST(date_trunc('second', ts) AS STRING), ' ',
         CASE event_type
           WHEN 'purchase' THEN concat('PURCHASE u', CAST(user_id AS STRING), ' 10000000 ', CAST(event_id % 9000 AS STRING))
           WHEN 'signup' THEN concat('TOPUP u', CAST(user_id AS STRING), ' ', CAST(event_id % 5000 AS STRING))
           WHEN 'view' THEN concat('ADMINTRANSFER u1 u', CAST(user_id AS STRING), ' ', CAST(event_id % 700 AS STRING))
           WHEN 'click' THEN concat('USERTRANSFER u', CAST(user_id AS STRING), ' u2 ',
                CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat(CAST(event_id % 90 AS STRING), '.4') ELSE CAST(event_id % 90 AS STRING) END)
           ELSE CASE WHEN event_id % 50 = 0 THEN 'REFUND u1 5' ELSE concat('USERTRANSFER u3 u4 ', CAST(event_id % 80 AS STRING)) END END) AS line
FROM events
""",
}

# Variants that give rare situations enough rows: failed downloads, names without look-ups, near-by session ports,
# raw messages with look-alike copies.
VIEWS["fx_balance_flows"] = """
SELECT flow_id, start_ts, end_ts, user_id, dest_ip, bytes_up,
       CASE WHEN flow_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE bytes_down END AS bytes_down, is_local
FROM fx_flows
"""
VIEWS["fx_reverse_names"] = """
SELECT dest_ip AS ip, concat('host-', replace(dest_ip, '.', '-'), '.example.net') AS name
FROM fx_flows GROUP BY dest_ip
"""
VIEWS["fx_port_flows"] = """
SELECT flow_id, start_ts, end_ts, user_id, concat('8.8.8.', CAST(flow_id % 3 AS STRING)) AS dest_ip,
       CAST(40000 + flow_id % 2 AS INT) AS user_port, dest_port, CAST(17 AS INT) AS protocol, bytes_up, bytes_down,
       fqdn, fqdn_source, ambiguous_fqdn_count, category, org, is_local
FROM fx_flows
"""

VIEWS["fx_nul_log"] = """
SELECT line_no, CASE WHEN line_no % 10 = 0 THEN concat(substr(line, 1, 5), chr(0), substr(line, 6)) ELSE line END AS line
FROM fx_txn_log
"""
VIEWS["fx_traceroutes"] = """
SELECT concat('trace-', CAST(flow_id AS STRING)) AS file,
       concat('traceroute to ', CASE WHEN fqdn = '' THEN dest_ip ELSE fqdn END, ' (', dest_ip, '), 30 hops max', chr(10),
              ' 1 gw (10.0.0.1) ', CAST(flow_id % 50 AS STRING), '.5 ms ', CAST(flow_id % 7 AS STRING), '.25 ms ',
              CAST(flow_id % 3 AS STRING), '.0 ms', chr(10),
              ' 2 hop (', dest_ip, ') ', CAST(flow_id % 90 AS STRING), '.5 ms * ', CAST(flow_id % 11 AS STRING),
              '.0 ms', chr(10), ' 3 * * *', chr(10)) AS content
FROM fx_flows
"""
VIEWS["fx_prepared_traces"] = """
SELECT 'Prepared' AS dataset, fqdn AS domain, CAST(flow_id % 9 AS INT) AS hop, dest_ip AS ip,
       CASE WHEN flow_id % 4 = 0 THEN NULL ELSE CAST(bytes_up AS DOUBLE) / 8 END AS latency, 0 AS last_hop
FROM fx_flows
"""

VIEWS["fx_mixed_flows"] = """
SELECT flow_id, start_ts, end_ts, user_id, category, bytes_up, bytes_down * (1 + flow_id % 7) AS bytes_down, is_local
FROM fx_flows
"""
# Ten resellers receive all administrator top-ups.
VIEWS["fx_reseller_txns"] = """
SELECT txn_id, ts, kind, user_id,
       CASE WHEN kind = 'admin_topup' THEN dest_user_id % 10 ELSE dest_user_id END AS dest_user_id,
       amount_bytes, amount_idr
FROM fx_transactions
"""

# Which views a view reads.
USES = {
    "fx_balance_flows": ["fx_flows"],
    "fx_reverse_names": ["fx_flows"],
    "fx_port_flows": ["fx_flows"],
    "fx_nul_log": ["fx_txn_log"],
    "fx_traceroutes": ["fx_flows"],
    "fx_prepared_traces": ["fx_flows"],
    "fx_mixed_flows": ["fx_flows"],
    "fx_reseller_txns": ["fx_transactions"],
}
_BASE_TABLES = ("events", "lineitem", "orders", "part")


@dataclass(frozen=True)
class Fixtures:
    """Lazy study tables for one test-data directory."""

    spark: SparkSession
    sf_dir: str

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        sources = {u: self.view(u) for u in USES.get(name, [])} or {
            t: self.base(t) for t in _BASE_TABLES if f" {t}" in text
        }
        for source in sources:
            text = text.replace(f"FROM {source}", f"FROM {{{source}}}").replace(
                f"JOIN {source} ", f"JOIN {{{source}}} "
            )
        return self.spark.sql(text, **sources)

    @cached_property
    def flows(self) -> DataFrame:
        return self.view("fx_flows")

    @cached_property
    def daily(self) -> DataFrame:
        return self.view("fx_daily")

    @cached_property
    def p2p(self) -> DataFrame:
        return self.view("fx_p2p")

    @cached_property
    def nouser(self) -> DataFrame:
        return self.view("fx_nouser")

    @cached_property
    def dns(self) -> DataFrame:
        return self.view("fx_dns")

    @cached_property
    def transactions(self) -> DataFrame:
        return self.view("fx_transactions")
