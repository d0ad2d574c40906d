"""The same answers as independent DuckDB SQL: plain windows, range joins and recursive queries over the same views."""

from __future__ import annotations

from netledger.functions import rule_tables as rt
from netledger.verify.fixtures import PARAMS as P, USES, VIEWS

# --- small SQL builders --------------------------------------------------------------------------------------------


def _week(day: str, iso: int = 1) -> str:
    """Closing day of the week that ends on ISO weekday `iso`."""
    return f"({day} + CAST(({7 + iso} - isodow({day})) % 7 AS INT))"


def _rd(expr: str) -> str:
    """Six places; the small shift keeps exact halves from rounding differently in the two engines."""
    return f"round({expr} + 2.37e-9, 6)"


def _r(expr: str, name: str) -> str:
    return f"{_rd(expr)} AS {name}"


def _day(ts: str = "start_ts") -> str:
    return f"CAST({ts} AS DATE)"


def _us(a: str, b: str) -> str:
    return f"date_diff('microsecond', {a}, {b})"


_NORMAL = "(day < DATE '2024-01-10' OR day >= DATE '2024-01-13')"
_STUDY_DAYS = "generate_series(DATE '2024-01-02', DATE '2024-02-01', INTERVAL 1 DAY)"
_TOTAL = "bytes_up + bytes_down"


def _primary(name: str) -> str:
    parts = f"string_split(trim(trim({name}), '.'), '.')"
    return (
        f"(CASE WHEN length(list_last({parts})) = 2 THEN array_to_string(list_slice({parts}, -3, -1), '.') "
        f"ELSE array_to_string(list_slice({parts}, -2, -1), '.') END || '.')"
    )


def _ip_number(ip: str) -> str:
    return "(" + " + ".join(
        f"CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)
    ) + ")"


def _ip_local(ip: str) -> str:
    tests = []
    for block in rt.lines(rt.NOT_GLOBAL_IPV4):
        base, bits = block.split("/")
        lo = sum(int(o) * 256 ** (3 - i) for i, o in enumerate(base.split(".")))
        tests.append(f"{_ip_number(ip)} BETWEEN {lo} AND {lo + 2 ** (32 - int(bits)) - 1}")
    return "(" + " OR ".join(tests) + ")"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pattern(name: str, pattern: str) -> str:
    """RE2 has no look-ahead: "no X before Y" becomes a test of the text in front of Y."""
    if "(?!" not in pattern:
        return f"regexp_matches({name}, {_text(pattern)})"
    banned, _, rest = pattern.removeprefix("^(?:(?!").partition(").)*")
    return (
        f"(regexp_matches({name}, {_text(rest)}) AND NOT "
        f"contains(regexp_replace({name}, {_text(rest + '.*')}, ''), {_text(banned)}))"
    )


def _token_case(text: str, table: str, field: int, default: str) -> str:
    out = ["CASE"]
    for tokens, also, org, category in rt.token_rules(table):
        test = " OR ".join(
            f"starts_with({text}, {_text(t[1:])})" if t.startswith("^") else f"contains({text}, {_text(t)})"
            for t in tokens
        )
        if also:
            test = f"({test}) AND contains({text}, {_text(also)})"
        out.append(f"WHEN {test} THEN {_text((org, category)[field])}")
    return " ".join(out) + f" ELSE {_text(default)} END"


def _pattern_case(name: str, table: str, folds: dict, default: str) -> str:
    rules = rt.patterns(table)[::-1]
    whens = [f"WHEN {_pattern(name, p)} THEN {_text(folds.get(c, c))}" for p, c in rules]
    return "CASE " + " ".join(whens) + f" ELSE {default} END"


def _gate(name: str, gate: str) -> str:
    return "(" + " OR ".join(f"contains({name}, {_text(t)})" for t in gate.split(", ")) + ")"


def _org_of(name: str) -> str:
    return (
        f"CASE WHEN coalesce({name}, '') = '' THEN 'Unknown (No DNS)' WHEN {_gate(name, rt.GOOGLE_GATE)} THEN 'Google' "
        f"WHEN {_gate(name, rt.FACEBOOK_GATE)} THEN 'Facebook' "
        f"ELSE {_token_case(name, rt.DOMAIN_TOKENS, 0, 'Unknown (Not Mapped)')} END"
    )


def _category_of(name: str) -> str:
    fallback = f"CASE WHEN contains({name}, 'googleapis.com') THEN 'API' ELSE 'Unknown (Not Mapped)' END"
    return (
        f"CASE WHEN coalesce({name}, '') = '' THEN 'Unknown (No DNS)' "
        f"WHEN {_gate(name, rt.GOOGLE_GATE)} THEN {_pattern_case(name, rt.GOOGLE_PATTERNS, rt.GOOGLE_FOLDS, fallback)} "
        f"WHEN {_gate(name, rt.FACEBOOK_GATE)} THEN "
        f"{_pattern_case(name, rt.FACEBOOK_PATTERNS, rt.FACEBOOK_FOLDS, _text('Unknown (Not Mapped)'))} "
        f"ELSE {_token_case(name, rt.DOMAIN_TOKENS, 1, 'Unknown (Not Mapped)')} END"
    )


def _health(name: str) -> str:
    yes = " OR ".join(f"contains(lower({name}), {_text(t)})" for t in rt.HEALTH_TOKENS.split())
    no = " OR ".join(f"contains(lower({name}), {_text(t)})" for t in rt.lines(rt.HEALTH_EXCLUSIONS))
    return f"(({yes}) AND NOT ({no}))"


def _protocol() -> str:
    whens = []
    for line in rt.lines(rt.PORT_NAMES):
        key, name = line.split(" | ")
        proto, port = key.split()
        whens.append(f"WHEN protocol = {proto} AND dest_port = {port} THEN {_text(name)}")
    return "CASE " + " ".join(whens) + (
        " WHEN protocol = 6 THEN 'Other TCP' WHEN protocol = 17 THEN 'Other UDP' ELSE 'Other' END"
    )


def _cdf(source: str, value: str, keys: str = "") -> str:
    """Distribution of a column of a CTE, from cume_dist."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return (
        f"SELECT {k}{value}, count(*) AS base_count, {_rd('count(*) * 1.0::DOUBLE / any_value(n)')} AS pdf, "
        f"{_rd('any_value(c)')} AS cdf FROM (SELECT *, count(*) OVER ({part}) AS n, "
        f"cume_dist() OVER ({part}ORDER BY {value}) AS c FROM {source} WHERE {value} IS NOT NULL) GROUP BY {k}{value}"
    )


def _rounded_value(sql: str, value: str) -> str:
    return f"SELECT * REPLACE ({_r(value, value)}) FROM ({sql})"


# --- shared tables -------------------------------------------------------------------------------------------------

CTES: dict[str, tuple[list[str], str]] = {name: (USES.get(name, []), text) for name, text in VIEWS.items()}


def _cte(name: str, uses: list[str], sql: str) -> None:
    CTES[name] = (uses, sql)


_LEDGER_ORDER = "ORDER BY ts, txn_id, leg"
_cte("ledger", ["fx_transactions"], """
SELECT txn_id, ts, 0 AS leg, dest_user_id AS user_id, amount_idr FROM fx_transactions
WHERE kind IN ('user_transfer', 'admin_transfer', 'admin_topup')
UNION ALL
SELECT txn_id, ts, 1, user_id, -amount_idr FROM fx_transactions
WHERE kind IN ('user_transfer', 'admin_transfer', 'purchase')""")
_cte("running", ["ledger"], f"""
SELECT *, sum(amount_idr) OVER (PARTITION BY user_id {_LEDGER_ORDER} ROWS UNBOUNDED PRECEDING) AS running
FROM ledger WHERE user_id IS NOT NULL""")
_cte("offsets", ["running"], """
SELECT user_id, -min(running) AS lift FROM running GROUP BY user_id HAVING min(running) < 0""")
_cte("early", ["running", "offsets"], """
SELECT coalesce(e.user_id, o.user_id) AS user_id,
       CAST(coalesce(before, 0) + coalesce(lift, 0) AS BIGINT) AS balance_idr, lift IS NOT NULL AS inferred
FROM (SELECT user_id, sum(amount_idr) AS before FROM running WHERE ts < TIMESTAMP '2024-01-02' GROUP BY user_id) e
FULL JOIN offsets o ON e.user_id = o.user_id""")
_cte("typical_p2p", ["fx_flows", "fx_p2p"], """
SELECT 0 AS kind, flow_id, start_ts, end_ts, protocol, bytes_up + bytes_down AS bytes_total FROM fx_flows
UNION ALL
SELECT 1, flow_id, start_ts, end_ts, protocol, bytes_a_to_b + bytes_b_to_a FROM fx_p2p""")
_cte("all3", ["typical_p2p", "fx_nouser"], """
SELECT * FROM typical_p2p UNION ALL
SELECT 2, flow_id, start_ts, end_ts, protocol, bytes_a_to_b + bytes_b_to_a FROM fx_nouser""")


def _gap_sql(source: str, mode: str) -> str:
    prev = "lag(end_ts) OVER (ORDER BY start_ts, kind, flow_id)" if mode == "previous" else (
        "max(end_ts) OVER (ORDER BY start_ts, kind, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    return (
        f"SELECT prev_end AS gap_start, start_ts AS gap_end FROM (SELECT start_ts, {prev} AS prev_end FROM {source}) "
        "WHERE start_ts > prev_end"
    )


_cte("gaps", ["typical_p2p"], _gap_sql("typical_p2p", "previous"))
_cte("up_flows", ["typical_p2p"], """
SELECT * FROM typical_p2p WHERE start_ts < TIMESTAMP '2024-01-10' OR start_ts >= TIMESTAMP '2024-01-13'""")
_cte("network_gaps", ["up_flows"], _gap_sql("up_flows", "previous"))
_cte("gap_days", ["network_gaps"], """
SELECT CAST(gap_at AS DATE) AS day FROM (
  SELECT gap_start, unnest(generate_series(gap_start, gap_end, INTERVAL 1 DAY)) AS gap_at FROM network_gaps
  WHERE gap_end - gap_start > INTERVAL 1 DAY) WHERE gap_at > gap_start""")
_cte("flow_range", ["fx_flows"], """
SELECT user_id, min(start_ts) AS first_start, arg_max(end_ts, start_ts) AS last_end,
       count(DISTINCT CAST(start_ts AS DATE)) AS days_online FROM fx_flows GROUP BY user_id""")
_cte("purchase_range", ["fx_transactions", "early"], """
SELECT user_id, min(ts) AS first_purchase, max(ts) AS last_purchase FROM (
  SELECT user_id, ts FROM fx_transactions WHERE kind = 'purchase'
  UNION ALL SELECT user_id, TIMESTAMP '2024-01-02' FROM early) WHERE user_id IS NOT NULL GROUP BY user_id""")
_cte("active", ["flow_range", "purchase_range", "gap_days"], f"""
SELECT u.*, {_us('earliest', "TIMESTAMP '2024-02-01'")} / 1e6 / 86400.0::DOUBLE AS days_since_first_active,
       {_us('earliest', 'latest')} / 1e6 / 86400.0::DOUBLE AS days_active,
       (SELECT count(*) FROM gap_days g WHERE g.day >= u.earliest AND g.day <= u.latest) AS outage_impact_days
FROM (SELECT user_id, days_online,
             CASE WHEN first_start < first_purchase THEN first_start ELSE first_purchase END AS earliest,
             CASE WHEN first_start < first_purchase THEN 'Flow' ELSE 'Purchase' END AS earliest_kind,
             CASE WHEN last_end > last_purchase THEN last_end ELSE last_purchase END AS latest,
             CASE WHEN last_end > last_purchase THEN 'Flow' ELSE 'Purchase' END AS latest_kind
      FROM flow_range JOIN purchase_range USING (user_id)) u""")
_cte("eligible", ["active"], "SELECT * FROM active WHERE days_since_first_active >= 7 AND days_active >= 1")
_cte("strict", ["active"], "SELECT * FROM active WHERE days_since_first_active > 7 AND days_active > 1")
_cte("buys", ["fx_transactions"], "SELECT * FROM fx_transactions WHERE kind = 'purchase'")
_cte("groups", ["buys"], """
SELECT user_id, min(txn_id) AS txn_id, min(ts) AS ts, CAST(sum(amount_bytes) AS BIGINT) AS amount_bytes,
       CAST(sum(amount_idr) AS BIGINT) AS amount_idr
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, txn_id) AS grp
      FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, txn_id) < INTERVAL 21600 SECOND
                           THEN 0 ELSE 1 END AS fresh FROM buys))
GROUP BY user_id, grp""")
_cte("consolidated", ["groups"], f"""
SELECT *, {_us('lag(ts) OVER (PARTITION BY user_id ORDER BY ts)', 'ts')} / 1e6 AS seconds_since_last FROM groups""")
_cte("hourly", ["fx_flows", "fx_p2p"], """
SELECT day, hour, category, sum(b) AS bytes_total FROM (
  SELECT CAST(start_ts AS DATE) AS day, CAST(hour(start_ts) AS INT) AS hour, category, bytes_up + bytes_down AS b
  FROM fx_flows UNION ALL SELECT CAST(start_ts AS DATE), CAST(hour(start_ts) AS INT), 'Peer to Peer', bytes_a_to_b + bytes_b_to_a FROM fx_p2p)
GROUP BY ALL""")
_cte("names", ["fx_flows"], f"""
SELECT *, {_health('fqdn')} AS is_health, {_primary('fqdn')} AS primary_domain FROM (
  SELECT user_id, fqdn, {_day()} AS day, sum(bytes_up) AS bytes_up, sum(bytes_down) AS bytes_down
  FROM fx_flows GROUP BY ALL)""")
_cte("balances", ["running", "offsets"], """
SELECT r.user_id, txn_id, ts, leg, amount_idr, CAST(running + coalesce(lift, 0) AS BIGINT) AS balance,
       lift IS NOT NULL AS corrected
FROM running r LEFT JOIN offsets o ON r.user_id = o.user_id
WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-02-01'
  AND NOT (r.user_id = 7 AND ts > TIMESTAMP '2024-01-25')""")
_cte("zero_time", ["balances", "active", "eligible"], f"""
SELECT user_id, z / 1e6 / 86400 AS days_at_zero, nz / 1e6 / 86400 AS days_nonzero, days_active,
       days_since_first_active, corrected, z / 1e6 / 86400 / days_active AS fraction_at_zero,
       1.0::DOUBLE - z / 1e6 / 86400 / days_active AS fraction_nonzero
FROM (SELECT user_id, coalesce(sum(held) FILTER (balance <= 0), 0) AS z, sum(held) FILTER (balance > 0) AS nz,
             bool_or(corrected) AS corrected
      FROM (SELECT *, coalesce({_us('ts', 'lead(ts) OVER (PARTITION BY user_id ' + _LEDGER_ORDER + ')')}, 0) AS held
            FROM balances) WHERE user_id IN (SELECT user_id FROM eligible) GROUP BY user_id) JOIN active USING (user_id)
""")
_cte("bal_events", ["fx_balance_flows", "consolidated", "eligible"], """
SELECT user_id, start_ts AS ts, end_ts, 'ext' AS type, 2 AS rank, flow_id AS event_id, bytes_up, bytes_down,
       CAST(0 AS BIGINT) AS bytes_purchased FROM fx_balance_flows
WHERE NOT is_local AND user_id IN (SELECT user_id FROM eligible)
UNION ALL
SELECT user_id, ts, ts, 'purchase', 3, txn_id, 0, 0, amount_bytes FROM consolidated
WHERE user_id IN (SELECT user_id FROM eligible)""")
_cte("last_rx", ["bal_events"], """
SELECT *, last_value(CASE WHEN type = 'ext' AND bytes_down > 0 THEN end_ts END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY end_ts, rank, event_id ROWS UNBOUNDED PRECEDING) AS last_ext_rx FROM bal_events""")
_cte("zero_ranges", ["last_rx", "bal_events"], """
SELECT user_id, event_id, range_start, range_end, failed_flows FROM (
  SELECT p.user_id, p.event_id, p.last_ext_rx AS range_start, p.ts AS range_end,
         (SELECT count(*) FROM bal_events f WHERE f.user_id = p.user_id AND f.type = 'ext' AND f.bytes_down <= 0
            AND ((f.ts BETWEEN p.last_ext_rx AND p.ts) OR (f.end_ts BETWEEN p.last_ext_rx AND p.ts)
                 OR (f.ts <= p.last_ext_rx AND f.end_ts >= p.ts))) AS failed_flows
  FROM last_rx p WHERE p.type = 'purchase' AND p.last_ext_rx < p.ts) WHERE failed_flows >= 1""")
_cte("bal_marked", ["bal_events", "zero_ranges"], """
SELECT user_id, ts, end_ts, type, rank, event_id, bytes_down, bytes_purchased - bytes_up - bytes_down AS net_bytes
FROM bal_events UNION ALL
SELECT user_id, range_start, range_end, 'tare', 1, event_id, 0, 0 FROM zero_ranges""")
_cte("bal_init", ["bal_marked", "bal_events"], """
SELECT user_id, min(ts) - INTERVAL 1 SECOND AS ts, CAST(greatest(-min(run), 0) AS BIGINT) AS net_bytes
FROM (SELECT user_id, ts, sum(net_bytes) OVER (PARTITION BY user_id ORDER BY ts, rank, event_id
             ROWS UNBOUNDED PRECEDING) AS run FROM bal_marked) GROUP BY user_id""")
_cte("bal_history", ["bal_marked", "bal_init"], """
SELECT * FROM bal_marked UNION ALL SELECT user_id, ts, NULL, 'init', 0, 0, 0, net_bytes FROM bal_init""")
_cte("bal_running", ["bal_history"], """
SELECT *, sum(net_bytes) OVER (PARTITION BY user_id ORDER BY ts, rank, event_id ROWS UNBOUNDED PRECEDING) AS balance
FROM bal_history""")
_cte("tares", ["bal_running"], """
SELECT user_id, ts, event_id, CAST(low_ahead AS BIGINT) AS low_ahead,
       CAST(coalesce(lag(low_ahead) OVER (PARTITION BY user_id ORDER BY ts, rank, event_id), 0) - low_ahead AS BIGINT)
       AS tare_bytes
FROM (SELECT *, min(balance) OVER (PARTITION BY user_id ORDER BY ts, rank, event_id
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low_ahead
      FROM bal_running WHERE type = 'tare' OR (type = 'ext' AND bytes_down > 0)) WHERE type = 'tare'""")
_cte("uplink", ["fx_mixed_flows", "active", "strict"], """
SELECT *, rank() OVER (ORDER BY bytes_total) AS rank_total, rank() OVER (ORDER BY bytes_per_online_day) AS rank_daily
FROM (SELECT user_id, bytes_up, bytes_down, bytes_up + bytes_down AS bytes_total, top_category, days_online,
             days_active, (bytes_up + bytes_down) / days_online AS bytes_per_online_day,
             least(days_online, days_active) / days_active AS normalized_days_online,
             bytes_up / (bytes_up + bytes_down) AS ul_ratio, bytes_down / (bytes_up + bytes_down) AS dl_ratio,
             (bytes_up + bytes_down) / days_online / 1e6 AS mb_per_online_day
      FROM (SELECT user_id, CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down,
                   arg_max(category, t) FILTER (place = 1) AS top_category
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, category) AS place
                  FROM (SELECT user_id, category, sum(bytes_up) AS bytes_up, sum(bytes_down) AS bytes_down,
                               sum(bytes_up + bytes_down) AS t FROM fx_mixed_flows GROUP BY ALL))
            GROUP BY user_id) JOIN strict USING (user_id))""")
_cte("spent", ["buys", "eligible"], """
SELECT user_id, amount_idr, amount_bytes / 1e9 AS amount_gb, amount_idr * (1.0::DOUBLE / 14150) AS amount_usd,
       amount_idr * (1.0::DOUBLE / 14150) / days_active AS usd_per_day, days_active
FROM (SELECT user_id, CAST(sum(amount_idr) AS BIGINT) AS amount_idr, CAST(sum(amount_bytes) AS BIGINT) AS amount_bytes
      FROM buys GROUP BY user_id) JOIN eligible USING (user_id)""")
_PLACE = "max(us) FILTER (k = {f}((n - 1) * {q}::DOUBLE))::DOUBLE"
_TAIL = "({lo} + ({hi} - {lo}) * ((any_value(n) - 1) * {q}::DOUBLE - floor((any_value(n) - 1) * {q}::DOUBLE))) / 1e6"
_tail = lambda q: _TAIL.format(q=q, lo=_PLACE.format(f="floor", q=q), hi=_PLACE.format(f="ceil", q=q))
_cte("intervals", ["consolidated"], f"""
SELECT user_id, sum(us)::DOUBLE / count(*) / 1e6 AS mean, {_tail(0.9)} AS q90, {_tail(0.99)} AS q99
FROM (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n
      FROM (SELECT user_id, CAST(round(seconds_since_last * 1000000) AS BIGINT) AS us FROM consolidated
            WHERE seconds_since_last IS NOT NULL)) GROUP BY user_id""")
_cte("loans", ["fx_reseller_txns"], """
SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS period FROM fx_reseller_txns
WHERE kind = 'user_transfer' AND user_id <> dest_user_id AND dest_user_id IS NOT NULL
  AND (ts < TIMESTAMP '2024-01-20' OR ts > TIMESTAMP '2024-01-24')
  AND ts >= TIMESTAMP '2023-12-31' AND ts < TIMESTAMP '2024-02-05'
  AND user_id NOT IN (SELECT dest_user_id FROM fx_reseller_txns WHERE kind = 'admin_topup')""")
_cte("lasting", ["loans"], """
(SELECT user_id FROM loans WHERE period = 'before' UNION SELECT dest_user_id FROM loans WHERE period = 'before')
INTERSECT
(SELECT user_id FROM loans WHERE period = 'after' UNION SELECT dest_user_id FROM loans WHERE period = 'after')""")
_cte("lasting_loans", ["loans", "lasting"], """
SELECT txn_id, ts, user_id, dest_user_id, amount_idr, period AS timeline FROM loans
WHERE user_id IN (SELECT user_id FROM lasting) AND dest_user_id IN (SELECT user_id FROM lasting)""")
_cte("day_total", ["all3"], f"""
SELECT day, dayname(day) AS weekday, bytes_total, bytes_total / 1e9 AS gb,
       CASE WHEN {_NORMAL} THEN 'Normal' ELSE 'Outage' END AS condition
FROM (SELECT CAST(start_ts AS DATE) AS day, CAST(sum(bytes_total) AS BIGINT) AS bytes_total FROM all3 GROUP BY 1)""")
_cte("day_series", ["fx_flows"], f"""
SELECT {_day()} AS day, category, CAST(sum(bytes_up) AS BIGINT) AS bytes_up,
       CAST(sum(bytes_down) AS BIGINT) AS bytes_down FROM fx_flows GROUP BY ALL""")
_cte("told", ["fx_flows", "fx_dns"], """
SELECT f.flow_id, f.start_ts, f.end_ts, f.user_id, f.dest_ip, f.bytes_up, f.bytes_down, d.domain_name AS fqdn,
       CASE WHEN d.domain_name IS NOT NULL THEN (
         SELECT count(DISTINCT x.domain_name) FROM fx_dns x
         WHERE x.user_id = f.user_id AND x.ip_address = f.dest_ip AND x.ts <= f.start_ts) END AS ambiguous_fqdn_count,
       CASE WHEN d.domain_name IS NOT NULL THEN 'user_dns_log' END AS fqdn_source
FROM fx_flows f ASOF LEFT JOIN fx_dns d
  ON f.user_id = d.user_id AND f.dest_ip = d.ip_address AND f.start_ts >= d.ts""")
_cte("reverse", ["told", "fx_reverse_names"], f"""
SELECT flow_id, start_ts, end_ts, user_id, dest_ip, bytes_up, bytes_down,
       CASE WHEN fqdn IS NOT NULL THEN fqdn WHEN found THEN name ELSE '' END AS fqdn,
       CASE WHEN fqdn IS NOT NULL THEN ambiguous_fqdn_count WHEN found THEN 1 ELSE 0 END AS ambiguous_fqdn_count,
       CASE WHEN fqdn IS NOT NULL THEN fqdn_source WHEN found THEN 'reverse_dns' ELSE 'none' END AS fqdn_source
FROM (SELECT a.*, r.name, r.name IS NOT NULL AND NOT {_ip_local('a.dest_ip')} AS found
      FROM told a LEFT JOIN fx_reverse_names r ON a.dest_ip = r.ip)""")
_cte("online", ["eligible"], """
SELECT *, least(days_online, days_active) / (days_active - outage_impact_days) AS optimistic_online_ratio,
       least(days_online, days_active) / days_active AS observed_online_ratio FROM eligible""")
_cte("usage", ["fx_flows", "eligible"], """
SELECT user_id, least(days_online, days_active) / (days_active - outage_impact_days) AS online_ratio, days_online,
       b / 1e6 / days_online AS mb_per_online_day
FROM (SELECT user_id, CAST(sum(bytes_up + bytes_down) AS BIGINT) AS b FROM fx_flows GROUP BY 1)
JOIN eligible USING (user_id)""")
_cte("daily_org", ["fx_flows"], f"""
SELECT user_id, org, {_day()} AS day, sum(bytes_down) AS bytes_down FROM fx_flows GROUP BY ALL""")

ORACLES: dict[str, str] = {}


def _with(uses: list[str]) -> tuple[str, bool]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for u in CTES[name][0]:
            visit(u)
        if name not in ordered:
            ordered.append(name)

    for u in uses:
        visit(u)
    return ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)


def oracle(key: str, uses: list[str], sql: str, recursive: str = "") -> None:
    head = "WITH RECURSIVE " if recursive else "WITH "
    ctes = _with(uses) + (f",\n{recursive}" if recursive else "")
    ORACLES[key] = f"{head}{ctes}\n{sql}" if ctes else sql


def _sum(keys: str, source: str, day: bool = False) -> str:
    return (
        f"SELECT {keys}, CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down "
        f"FROM {source} GROUP BY ALL"
    )


# --- sources and sinks ---------------------------------------------------------------------------------------------

oracle("scan_prune", [], "SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1")
oracle("sink_overwrite", ["fx_transactions"], "SELECT * FROM fx_transactions")
_LOG = """
SELECT line_no, CAST(f[1] || ' ' || f[2] AS TIMESTAMP) AS ts,
       CASE f[3] WHEN 'PURCHASE' THEN 'purchase' WHEN 'USERTRANSFER' THEN 'user_transfer' WHEN 'TOPUP' THEN 'admin_topup'
            WHEN 'ADMINTRANSFER' THEN 'admin_transfer' END AS kind,
       CASE WHEN f[3] <> 'TOPUP' THEN f[4] END AS user_id,
       CASE WHEN f[3] IN ('USERTRANSFER', 'ADMINTRANSFER') THEN f[5] WHEN f[3] = 'TOPUP' THEN f[4] END AS dest_user_id,
       CASE WHEN f[3] = 'PURCHASE' THEN CAST(f[5] AS BIGINT) END AS amount_bytes,
       CAST(CASE f[3] WHEN 'USERTRANSFER' THEN CASE WHEN f[6] = '' THEN 0 ELSE round(CAST(f[6] AS DOUBLE)) END
            WHEN 'TOPUP' THEN CAST(f[5] AS DOUBLE) ELSE CAST(f[6] AS DOUBLE) END AS BIGINT) AS amount_idr
FROM (SELECT line_no, string_split(line, ' ') AS f FROM fx_txn_log)"""
oracle("txn_log_parse", ["fx_txn_log"], f"SELECT * FROM ({_LOG}) WHERE kind IS NOT NULL")
oracle("txn_log_reject", ["fx_txn_log"],
       "SELECT line_no, line, 'unknown kind' AS reject_reason FROM fx_txn_log WHERE line LIKE '% REFUND %'")
oracle("txn_log_nul_strip", ["fx_txn_log"],
       "SELECT count(*) AS damaged_lines, count(*) AS nul_bytes FROM fx_txn_log WHERE line_no % 10 = 0")
oracle("txn_log_nul_clean", ["fx_txn_log"],
       "SELECT line_no, line, CAST(line_no % 10 = 0 AS INT) AS nul_count FROM fx_txn_log")
oracle("txn_log_counts", ["fx_txn_log"], """
SELECT 'user' AS dimension, split_part(line, ' ', 4) AS key, count(*) AS transactions FROM fx_txn_log GROUP BY 1, 2
UNION ALL SELECT 'price', split_part(line, ' ', 6), count(*) FROM fx_txn_log
WHERE split_part(line, ' ', 3) = 'PURCHASE' GROUP BY 1, 2""")
_ROUTE = """
SELECT *, CASE WHEN obfuscated_a IS NOT NULL AND obfuscated_b IS NOT NULL THEN 'p2p'
               WHEN obfuscated_a IS NULL AND obfuscated_b IS NULL THEN 'nouser' ELSE 'typical' END AS route,
       CASE WHEN obfuscated_a IS NOT NULL AND address_a IS NOT NULL THEN 'side a has user and address'
            WHEN obfuscated_b IS NOT NULL AND address_b IS NOT NULL THEN 'side b has user and address'
            WHEN coalesce(obfuscated_a, address_a) IS NULL THEN 'side a has no identity'
            WHEN coalesce(obfuscated_b, address_b) IS NULL THEN 'side b has no identity' END AS reject_reason
FROM fx_raw_flow"""
oracle("raw_flow_ingest", ["fx_raw_flow"], f"""
SELECT CASE WHEN rec_id % 97 < 2 THEN 'unreadable' ELSE route END AS route,
       CASE WHEN rec_id % 97 < 2 THEN 'unreadable' ELSE coalesce(reject_reason, 'none') END AS reject_reason, count(*) AS records,
       CAST(sum(bytes_a_to_b) FILTER (rec_id % 97 >= 2) AS BIGINT) AS bytes_a_to_b FROM ({_ROUTE}) GROUP BY 1, 2""")
oracle("raw_dns_ingest", ["fx_raw_dns"], """
SELECT rec_id, host, CAST(len(response_addresses) AS INT) AS addresses, CAST(len(response_ttls) AS INT) AS ttls
FROM fx_raw_dns""")
oracle("ingest_balance", ["fx_raw_flow", "fx_raw_dns"], """
SELECT archive, count(*) AS records, count(*) FILTER (rec_id % 97 >= 2) AS readable,
       CAST(0 AS BIGINT) AS without_number, count(*) FILTER (rec_id % 97 < 2) AS unreadable
FROM (SELECT 'flows' AS archive, rec_id FROM fx_raw_flow UNION ALL SELECT 'dns', rec_id FROM fx_raw_dns) GROUP BY 1""")
oracle("txn_log_ingest", ["fx_txn_log"], f"""
SELECT coalesce(kind, 'unknown kind') AS outcome, count(*) AS lines, min(place) AS first_line, max(place) AS last_line,
       CAST(sum(place) AS BIGINT) AS sum_of_places, CAST(sum(amount_idr) AS BIGINT) AS amount_idr
FROM ({_LOG}) JOIN (SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS place FROM fx_txn_log) USING (line_no) GROUP BY 1""")
oracle("user_partitioned", ["fx_flows"], _sum("user_id", "fx_flows"))
oracle("release_tables", ["fx_flows", "fx_p2p", "fx_transactions"], """
SELECT 'flows' AS table_name, count(*) AS row_count FROM fx_flows
UNION ALL SELECT 'p2p', count(*) FROM fx_p2p UNION ALL SELECT 'transactions', count(*) FROM fx_transactions""")
_ORG_WEEK = f"""
SELECT org, {_week('day', 3)} AS week, {_r('avg(bytes_down)', 'bytes_down')},
       CASE WHEN day < DATE '2024-01-16' THEN 'before' ELSE 'after' END AS period
FROM daily_org WHERE (day < DATE '2024-01-20' OR day > DATE '2024-01-24')
  AND day >= DATE '2023-12-31' AND day < DATE '2024-02-01'
  AND user_id NOT IN (SELECT dest_user_id FROM fx_reseller_txns WHERE kind = 'admin_topup') GROUP BY ALL"""
oracle("org_week_export", ["daily_org", "fx_reseller_txns"], _ORG_WEEK)
oracle("org_week_mean", ["daily_org", "fx_reseller_txns"], _ORG_WEEK)
oracle("traceroute_latency", ["fx_flows", "fx_prepared_traces"], """
SELECT *, dataset || ', ' || domain AS unique_name FROM (
  SELECT 'Community Network' AS dataset, CASE WHEN fqdn = '' THEN dest_ip ELSE fqdn END AS domain, CAST(1 AS INT) AS hop, '10.0.0.1' AS ip,
         (flow_id % 50 + 0.5 + flow_id % 7 + 0.25 + flow_id % 3)::DOUBLE / 2 AS latency, CAST(0 AS INT) AS last_hop
  FROM fx_flows
  UNION ALL SELECT 'Community Network', CASE WHEN fqdn = '' THEN dest_ip ELSE fqdn END, 2, dest_ip, (flow_id % 90 + 0.5 + flow_id % 11)::DOUBLE, 0
  FROM fx_flows
  UNION ALL SELECT dataset, domain, hop, ip, latency, last_hop FROM fx_prepared_traces WHERE latency IS NOT NULL)""")

# --- cleaning ------------------------------------------------------------------------------------------------------

oracle("canon_flow_typical", ["fx_raw_flow"], f"""
SELECT rec_id AS flow_id, start_time AS start_ts, end_time AS end_ts, coalesce(obfuscated_a, obfuscated_b) AS user_id,
       coalesce(address_b, address_a) AS dest_ip,
       CASE WHEN obfuscated_a IS NULL THEN port_b ELSE port_a END AS user_port,
       CASE WHEN obfuscated_a IS NULL THEN port_a ELSE port_b END AS dest_port,
       CASE WHEN obfuscated_a IS NULL THEN bytes_b_to_a ELSE bytes_a_to_b END AS bytes_up,
       CASE WHEN obfuscated_a IS NULL THEN bytes_a_to_b ELSE bytes_b_to_a END AS bytes_down,
       transport_protocol AS protocol FROM ({_ROUTE}) WHERE route = 'typical' AND reject_reason IS NULL""")
for _key, _route_name, _a, _b in (
    ("canon_flow_p2p", "p2p", "obfuscated_a AS user_a", "obfuscated_b AS user_b"),
    ("canon_flow_nouser", "nouser", "address_a AS ip_a", "address_b AS ip_b"),
):
    oracle(_key, ["fx_raw_flow"], f"""
SELECT rec_id AS flow_id, start_time AS start_ts, end_time AS end_ts, {_a}, {_b}, port_a AS a_port, port_b AS b_port,
       bytes_a_to_b, bytes_b_to_a, transport_protocol AS protocol
FROM ({_ROUTE}) WHERE route = '{_route_name}' AND reject_reason IS NULL""")
oracle("canon_flow_reject", ["fx_raw_flow"],
       f"SELECT rec_id, route, reject_reason FROM ({_ROUTE}) WHERE reject_reason IS NOT NULL")
_GOOD_DNS = """((obfuscated_src IS NOT NULL AND obfuscated_dst IS NULL AND src_ip IS NULL AND dest_ip IS NOT NULL)
  OR (obfuscated_src IS NULL AND obfuscated_dst IS NOT NULL AND src_ip IS NOT NULL))"""
oracle("canon_dns_explode", ["fx_raw_dns"], f"""
SELECT rec_id AS dns_id, ts, coalesce(obfuscated_src, obfuscated_dst) AS user_id,
       CASE WHEN obfuscated_src IS NOT NULL THEN dest_ip ELSE src_ip END AS dns_server, host AS domain_name,
       response_addresses[i] AS ip_address, CAST(response_ttls[i] AS INT) AS ttl
FROM (SELECT *, unnest(generate_series(1, least(len(response_addresses), len(response_ttls)))) AS i
      FROM fx_raw_dns WHERE {_GOOD_DNS})""")
oracle("canon_dns_reject", ["fx_raw_dns"], f"""
SELECT rec_id, host, CASE WHEN obfuscated_src IS NOT NULL AND obfuscated_dst IS NULL AND src_ip IS NOT NULL
                          THEN 'malformed' ELSE 'bad' END AS reject_reason FROM fx_raw_dns WHERE NOT {_GOOD_DNS}""")
oracle("dedup_flows", ["fx_flows"], "SELECT DISTINCT * EXCLUDE (flow_id) FROM fx_flows")
oracle("dedup_dns", ["fx_dns"], """
SELECT CAST(2 * count(*) AS BIGINT) AS rows_before, (SELECT count(*) FROM (
         SELECT DISTINCT ts, user_id, domain_name, ip_address FROM fx_dns)) AS rows_after,
       2 * count(*) - (SELECT count(*) FROM (SELECT DISTINCT ts, user_id, domain_name, ip_address FROM fx_dns))
       AS duplicates FROM fx_dns""")
oracle("dns_slim", ["fx_dns"], "SELECT ts, user_id, domain_name, ip_address FROM fx_dns")
oracle("shift_local", ["fx_flows"], """
SELECT flow_id, start_ts + INTERVAL 9 HOUR AS start_ts, end_ts + INTERVAL 9 HOUR AS end_ts FROM fx_flows""")
oracle("trim_range", ["fx_flows"], """
SELECT flow_id, start_ts FROM fx_flows
WHERE start_ts >= TIMESTAMP '2024-01-02' AND start_ts < TIMESTAMP '2024-02-01'""")
oracle("trim_transactions", ["fx_transactions"], """
SELECT * REPLACE (coalesce(amount_bytes, 0) AS amount_bytes) FROM fx_transactions
WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-02-01'""")
oracle("qualify_domain", ["fx_flows"], "SELECT flow_id, rtrim(trim(fqdn), '.') || '.' AS fqdn FROM fx_flows")
oracle("finalise_types", ["fx_transactions"], """
SELECT * REPLACE (coalesce(CAST(user_id AS VARCHAR), '[None]') AS user_id,
                  coalesce(CAST(dest_user_id AS VARCHAR), '[None]') AS dest_user_id) FROM fx_transactions""")
oracle("finalise_flows", ["fx_flows"], "SELECT * REPLACE (rtrim(trim(fqdn), '.') || '.' AS fqdn) FROM fx_flows")
_IN_STUDY = "start_time + INTERVAL 9 HOUR >= TIMESTAMP '{0}' AND start_time + INTERVAL 9 HOUR < TIMESTAMP '{1}'".format(
    P.min_date, P.max_date)
oracle("cleaning_balance", ["fx_raw_flow", "fx_raw_dns"], f"""
SELECT * FROM (WITH routed AS ({_ROUTE}), good AS (SELECT * FROM routed WHERE reject_reason IS NULL AND {_IN_STUDY})
SELECT 'flows_' || route AS output, count(*) AS records,
       CAST(sum(CASE WHEN route = 'typical' AND obfuscated_a IS NULL THEN bytes_b_to_a ELSE bytes_a_to_b END) AS BIGINT) AS bytes
FROM good GROUP BY route
UNION ALL SELECT 'rejected_flows', count(*), CAST(sum(bytes_a_to_b) AS BIGINT) FROM routed WHERE reject_reason IS NOT NULL
UNION ALL SELECT 'rejected_dns', count(*), NULL FROM fx_raw_dns WHERE NOT {_GOOD_DNS}
UNION ALL SELECT 'dns', CAST(sum(least(len(response_addresses), len(response_ttls))) AS BIGINT), NULL FROM fx_raw_dns WHERE {_GOOD_DNS})""")
_LABEL = "'[Other Anonymized U<120]'"
oracle("anonymised_flows", ["fx_flows"], f"""
SELECT * FROM (WITH one AS (
    SELECT * REPLACE (CASE WHEN org IN (SELECT org FROM fx_flows GROUP BY 1 HAVING count(DISTINCT user_id) >= 120)
                      THEN org ELSE {_LABEL} END AS org) FROM fx_flows),
two AS (
    SELECT * REPLACE (CASE WHEN dest_ip IN (SELECT dest_ip FROM one GROUP BY 1 HAVING count(DISTINCT user_id) >= 120)
                      THEN dest_ip ELSE {_LABEL} END AS dest_ip) FROM one),
three AS (
    SELECT * REPLACE (CASE WHEN {_primary('fqdn')} IN (SELECT {_primary('fqdn')} FROM two GROUP BY 1 HAVING count(DISTINCT user_id) >= 120)
                      THEN fqdn ELSE {_LABEL} END AS fqdn) FROM two)
SELECT org, dest_ip, fqdn, count(*) AS flows, CAST(sum(bytes_up) AS BIGINT) AS bytes_up FROM three GROUP BY ALL)""")
oracle("kanon_org", ["fx_daily"], """
SELECT CASE WHEN users >= 32 THEN org ELSE '[Other Anonymized U<32]' END AS org, CAST(sum(n) AS BIGINT) AS rows
FROM (SELECT org, count(DISTINCT user_id) AS users, count(*) AS n FROM fx_daily GROUP BY org) GROUP BY 1""")
oracle("kanon_ip", ["fx_flows"], """
SELECT flow_id, CASE WHEN users >= 120 THEN dest_ip ELSE '[Other Anonymized U<120]' END AS dest_ip
FROM fx_flows JOIN (SELECT dest_ip, count(DISTINCT user_id) AS users FROM fx_flows GROUP BY 1) USING (dest_ip)""")
oracle("kanon_fqdn", ["fx_flows"], f"""
SELECT flow_id, CASE WHEN users >= 150 THEN fqdn ELSE '[Other Anonymized U<150]' END AS fqdn
FROM (SELECT *, {_primary('fqdn')} AS pd FROM fx_flows)
JOIN (SELECT {_primary('fqdn')} AS pd, count(DISTINCT user_id) AS users FROM fx_flows GROUP BY 1) USING (pd)""")
oracle("primary_domain", ["fx_flows"], f"""
SELECT DISTINCT fqdn, {_primary('fqdn')} AS primary_domain, {_primary('fqdn')} AS health_primary_domain
FROM fx_flows""")
oracle("small_org_merge", ["fx_flows"], """
SELECT CASE WHEN n >= 40 THEN org ELSE 'Aggregated (Users < 40)' END AS org,
       CAST(sum(b) AS BIGINT) AS bytes_total, count(DISTINCT user_id) AS users
FROM (SELECT user_id, org, sum(bytes_up + bytes_down) AS b FROM fx_flows GROUP BY ALL)
JOIN (SELECT org, count(*) FILTER (b <> 0) AS n FROM (
        SELECT user_id, org, sum(bytes_up + bytes_down) AS b FROM fx_flows GROUP BY ALL) GROUP BY org) USING (org)
GROUP BY 1""")
oracle("flow_stitch", ["fx_port_flows"], f"""
SELECT user_id, user_port, dest_port, protocol, arg_min(flow_id, k) AS flow_id, min(start_ts) AS start_ts,
       arg_max(end_ts, k) AS end_ts, arg_min(dest_ip, k) AS dest_ip, CAST(sum(bytes_up) AS BIGINT) AS bytes_up,
       CAST(sum(bytes_down) AS BIGINT) AS bytes_down, count(*) AS parts
FROM (SELECT *, row_number() OVER w AS k, sum(fresh) OVER w AS part
      FROM (SELECT *, CASE WHEN abs({_us('lag(end_ts) OVER w', 'start_ts')}) <= 3600000000 THEN 0 ELSE 1 END AS fresh
            FROM fx_port_flows
            WINDOW w AS (PARTITION BY user_id, user_port, dest_port, protocol ORDER BY start_ts, flow_id))
      WINDOW w AS (PARTITION BY user_id, user_port, dest_port, protocol ORDER BY start_ts, flow_id))
GROUP BY user_id, user_port, dest_port, protocol, part""")
oracle("syslog_split", ["fx_raw_flow"], """
SELECT rec_id, CASE WHEN obfuscated_a IS NULL AND obfuscated_b IS NULL THEN 'system'
                    WHEN obfuscated_a IS NOT NULL AND obfuscated_b IS NOT NULL THEN 'peer'
                    WHEN (CASE WHEN obfuscated_a IS NOT NULL THEN address_b ELSE address_a END) = '9.9.9.50' THEN 'local'
                    ELSE 'remote' END AS destination FROM fx_raw_flow""")

# --- enrichment ----------------------------------------------------------------------------------------------------

oracle("eligible_users", ["active", "fx_flows"], """
SELECT user_id, count(*) AS flows FROM fx_flows
WHERE user_id IN (SELECT user_id FROM active WHERE days_since_first_active > 30.5 AND days_active > 29) GROUP BY 1""")
oracle("dns_asof", ["told"], "SELECT * REPLACE (CAST(ambiguous_fqdn_count AS INT) AS ambiguous_fqdn_count) FROM told")
oracle("rdns_fallback", ["reverse"],
       "SELECT * REPLACE (CAST(ambiguous_fqdn_count AS INT) AS ambiguous_fqdn_count) FROM reverse")
oracle("ip_is_local", ["fx_flows"], f"SELECT DISTINCT dest_ip, {_ip_local('dest_ip')} AS is_local FROM fx_flows")
oracle("fqdn_org_category", ["fx_flows"],
       f"SELECT flow_id, {_category_of('fqdn')} AS category, {_org_of('fqdn')} AS org FROM fx_flows")
oracle("port_override", ["fx_flows"], """
SELECT flow_id, CASE WHEN protocol = 17 AND dest_port = 3478 THEN 'ICE (STUN/TURN)' ELSE category END AS category
FROM fx_flows""")
_UNKNOWN = "'Unknown (No DNS)'"
oracle("ip_org_category", ["fx_flows"], f"""
SELECT flow_id,
  CASE WHEN category = {_UNKNOWN} THEN {_token_case('dest_ip', rt.ADDRESS_TOKENS, 1, 'Unknown (No DNS)')}
       ELSE category END AS category,
  CASE WHEN org = {_UNKNOWN} THEN {_token_case('dest_ip', rt.ADDRESS_TOKENS, 0, 'Unknown (No DNS)')} ELSE org END AS org
FROM fx_flows""")
oracle("passthrough_peer", ["reverse"], f"""
SELECT flow_id, CASE WHEN peer THEN 'Peer to Peer' ELSE category END AS category,
       CASE WHEN peer THEN 'Peer (Unknown Org)' ELSE org END AS org
FROM (SELECT *, org = 'Unknown (Not Mapped)' AND category = 'Unknown (Not Mapped)' AND fqdn_source = 'reverse_dns'
             AND contains(fqdn, split_part(dest_ip, '.', 1)) AND contains(fqdn, split_part(dest_ip, '.', 2))
             AND contains(fqdn, split_part(dest_ip, '.', 3)) AND contains(fqdn, split_part(dest_ip, '.', 4)) AS peer
      FROM (SELECT *, {_org_of('fqdn')} AS org, {_category_of('fqdn')} AS category FROM reverse))""")
oracle("densify", ["fx_flows"], f"""
SELECT k.org, k.day, CAST(coalesce(d.bytes_up, 0) AS BIGINT) AS bytes_up,
       CAST(coalesce(d.bytes_down, 0) AS BIGINT) AS bytes_down
FROM (SELECT org, CAST(unnest({_STUDY_DAYS}) AS DATE) AS day FROM (SELECT DISTINCT org FROM fx_flows)) k
LEFT JOIN ({_sum(_day() + ' AS day, org', 'fx_flows')}) d ON k.org = d.org AND k.day = d.day""")
oracle("stun_state", ["fx_port_flows"], """
SELECT flow_id, CASE WHEN r.id IS NULL THEN category WHEN label = 'peer' THEN 'Peer to Peer'
                     ELSE 'ICE (STUN/TURN)' END AS category,
       CASE WHEN r.id IS NOT NULL AND label = 'peer' THEN 'ICE Peer (Unknown Org)' ELSE org END AS org
FROM labelled LEFT JOIN related r ON flow_id = r.id""", recursive="""
labelled AS (
  SELECT *, CASE WHEN dest_port = 3478 AND protocol = 17 THEN NULL
                 WHEN (category IN ('Unknown (No DNS)', 'Unknown (Not Mapped)') AND contains(org, 'Unknown'))
                   OR contains(fqdn, 'emome-ip.hinet.net') THEN 'peer'
                 WHEN contains(fqdn, 'turnservice') OR contains(fqdn, 'facebook') OR org = 'Facebook'
                   OR category IN ('Unknown (Not Mapped)', 'API') THEN 'ice' END AS label
  FROM fx_port_flows),
cand AS (SELECT * FROM labelled WHERE label IS NOT NULL),
related(id) AS (
  SELECT c.flow_id FROM cand c WHERE EXISTS (
    SELECT 1 FROM fx_port_flows g WHERE g.user_id = c.user_id AND g.user_port = c.user_port AND g.dest_port = 3478
      AND g.protocol = 17 AND g.start_ts <= c.start_ts AND g.start_ts + INTERVAL 86400 SECOND > c.start_ts)
  UNION
  SELECT c.flow_id FROM related r JOIN cand p ON r.id = p.flow_id
  JOIN cand c ON c.user_id = p.user_id AND c.user_port = p.user_port AND c.dest_port = p.dest_port
    AND c.protocol = p.protocol AND c.dest_ip = p.dest_ip AND p.start_ts < c.start_ts
    AND p.end_ts + INTERVAL 21600 SECOND > c.start_ts)""")
oracle("proto_name", ["fx_flows"], f"""
SELECT {_protocol()} AS name, count(*) AS flows, CAST(sum(bytes_up) AS BIGINT) AS bytes_up FROM fx_flows GROUP BY 1""")
oracle("health_flag", ["fx_flows"], f"SELECT flow_id, fqdn, {_health('fqdn')} AS is_health FROM fx_flows")
oracle("nouser_kind", ["fx_nouser"], """
SELECT flow_id, CASE WHEN b_port = 1900 AND bytes_b_to_a = 0 THEN 'SSDP Query (No Answer)'
                     WHEN bytes_b_to_a = 0 THEN 'Unanswered' ELSE 'Unknown' END AS kind FROM fx_nouser""")
oracle("p2p_kind", ["fx_p2p"], """
SELECT flow_id, CASE WHEN bytes_a_to_b = 0 OR bytes_b_to_a = 0 THEN 'One-Way' ELSE 'Two-Way' END AS kind FROM fx_p2p""")
_HEAVY = """SELECT fqdn, CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down
  FROM fx_flows WHERE org = 'Unknown (Not Mapped)' OR category = 'Unknown (Not Mapped)' GROUP BY 1"""
oracle("unmapped_heavy_hitters", ["fx_flows"], f"""
SELECT * FROM (SELECT 'Downlink' AS direction, * FROM ({_HEAVY}) ORDER BY bytes_down DESC, fqdn LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'Uplink', * FROM ({_HEAVY}) ORDER BY bytes_up DESC, fqdn LIMIT 50)""")
oracle("unknown_destinations", ["fx_flows"], f"""
SELECT dest_ip, CAST(sum({_TOTAL}) AS BIGINT) AS bytes_total FROM fx_flows
WHERE org = {_UNKNOWN} OR category = {_UNKNOWN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""")

# --- statistics ----------------------------------------------------------------------------------------------------

oracle("cdf", ["fx_daily"], _cdf("fx_daily", "bytes_up"))
oracle("rank_min", ["fx_daily"],
       f"SELECT *, rank() OVER (ORDER BY bytes_up DESC) AS rank_down FROM ({_sum('user_id', 'fx_daily')})")
oracle("rank_pct", ["fx_flows"], f"""
SELECT flow_id, bytes_up, rank() OVER (ORDER BY bytes_up) AS rank,
       {_r('rank() OVER (ORDER BY bytes_up) * 1.0::DOUBLE / count(*) OVER ()', 'rank_pct')} FROM fx_flows""")
oracle("rank_bins", ["fx_daily"], f"""
SELECT user_id, bytes_up, bytes_down, rank, bin, {_r('lo + bin * w', 'bin_lo')}, {_r('lo + (bin + 1) * w', 'bin_hi')}
FROM (SELECT *, CAST(least(floor((rank - lo) / w), 9) AS INT) AS bin
      FROM (SELECT *, min(rank) OVER () AS lo, (max(rank) OVER () - min(rank) OVER ()) / 10.0::DOUBLE AS w
            FROM (SELECT *, rank() OVER (ORDER BY bytes_up) AS rank FROM ({_sum('user_id', 'fx_daily')}))))""")
oracle("mean_q90_q99_max", ["fx_daily"], f"""
SELECT category, {_r('avg(bytes_down)', 'mean')}, {_r('quantile_cont(bytes_down::DOUBLE, 0.9)', 'q90')},
       {_r('quantile_cont(bytes_down::DOUBLE, 0.99)', 'q99')}, max(bytes_down) AS max
FROM ({_sum('day, category', 'fx_daily')}) GROUP BY 1""")
oracle("exact_quantiles", ["fx_daily"], f"""
SELECT org, {_r('quantile_cont(bytes_up::DOUBLE, 0.1)', 'q10')}, {_r('quantile_cont(bytes_up::DOUBLE, 0.5)', 'median')},
       {_r('quantile_cont(bytes_up::DOUBLE, 0.99)', 'q99')} FROM fx_daily GROUP BY 1""")
oracle("melt", ["fx_daily"], """
SELECT category, 'bytes_up' AS direction, CAST(sum(bytes_up) AS BIGINT) AS amount FROM fx_daily GROUP BY 1
UNION ALL SELECT category, 'bytes_down', CAST(sum(bytes_down) AS BIGINT) FROM fx_daily GROUP BY 1""")
oracle("argmax_label", ["fx_daily"], """
SELECT user_id, category AS top_category FROM (
  SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY sum(bytes_down) DESC, category) AS n
  FROM fx_daily GROUP BY 1, 2) WHERE n = 1""")
_TOP9 = "(SELECT org FROM {src} GROUP BY org ORDER BY sum({amount}) DESC, org LIMIT 9)"
oracle("topn_other", ["fx_daily"], f"""
SELECT day, CASE WHEN org IN {_TOP9.format(src='fx_daily', amount='bytes_down')} THEN org
                 ELSE 'Other N=' || ((SELECT count(DISTINCT org) FROM fx_daily) - 9) END AS org,
       CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down
FROM fx_daily GROUP BY 1, 2""")
oracle("others_only", ["fx_flows"], f"""
SELECT week, org, {_r('b / 1e9', 'gb')}, dense_rank() OVER (ORDER BY t, org) - 1 AS order
FROM (SELECT *, sum(b) OVER (PARTITION BY org) AS t FROM (
        SELECT {_week(_day())} AS week, org, sum({_TOTAL}) AS b FROM fx_flows
        WHERE org NOT IN {_TOP9.format(src='fx_flows', amount=_TOTAL)} GROUP BY 1, 2))""".replace("AS order", 'AS "order"'))
oracle("topn_label", ["fx_daily"], """
SELECT user_id, CASE WHEN row_number() OVER (ORDER BY b DESC, user_id) <= 20 THEN 'Top 20'
                     ELSE 'Bottom ' || (count(*) OVER () - 20) END AS top_n
FROM (SELECT user_id, sum(bytes_down) AS b FROM fx_daily GROUP BY 1)""")


def _layers(source: str, label: str) -> str:
    part = lambda d, c: (
        f"SELECT {label}, '{d}' AS direction, CAST(row_number() OVER (ORDER BY sum({c}), {label}) - 1 AS INT) AS \"order\" "
        f"FROM {source} GROUP BY {label}"
    )
    return f"{part('Downlink', 'bytes_down')} UNION ALL {part('Uplink', 'bytes_up')}"


oracle("sort_order", ["fx_daily"], _layers("fx_daily", "category"))
oracle("rolling_time", ["day_series"], f"""
SELECT *, round(avg(bytes_up) OVER (PARTITION BY category ORDER BY day
       RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) + 2.37e-9, 6) AS mean_7d FROM day_series""")
oracle("rolling_rows", ["day_series"], """
SELECT *, CASE WHEN count(*) OVER w = 7 THEN round(avg(bytes_up) OVER w + 2.37e-9, 6) END AS mean_7r FROM day_series
WINDOW w AS (PARTITION BY category ORDER BY day ROWS 6 PRECEDING)""")
oracle("daily_users_7row_mean", ["fx_flows"], f"""
SELECT day, users, CASE WHEN count(*) OVER w = 7 THEN round(avg(users) OVER w + 2.37e-9, 6) END AS users_7d
FROM (SELECT {_day()} AS day, count(DISTINCT user_id) AS users FROM fx_flows GROUP BY 1)
WINDOW w AS (ORDER BY day ROWS 6 PRECEDING)""")
for _key, _fill in (
    ("ffill", "last_value(k IGNORE NULLS) OVER (PARTITION BY category ORDER BY day ROWS UNBOUNDED PRECEDING)"),
    ("bfill", "first_value(k IGNORE NULLS) OVER (PARTITION BY category ORDER BY day ROWS BETWEEN CURRENT ROW AND "
              "UNBOUNDED FOLLOWING)"),
):
    oracle(_key, ["day_series"], f"""
SELECT day, category, bytes_up, bytes_down, {_fill} AS known
FROM (SELECT *, CASE WHEN bytes_up % 3 = 0 THEN bytes_up END AS k FROM day_series)""")
oracle("resample_hour", ["fx_flows"], """
SELECT s.category, s.hour, CAST(coalesce(b, 0) AS BIGINT) AS bytes_down
FROM (SELECT category, unnest(generate_series(min(date_trunc('hour', start_ts)), max(date_trunc('hour', start_ts)),
                                              INTERVAL 1 HOUR)) AS hour FROM fx_flows GROUP BY 1) s
LEFT JOIN (SELECT category, date_trunc('hour', start_ts) AS hour, sum(bytes_down) AS b FROM fx_flows GROUP BY 1, 2) d
  ON s.category = d.category AND s.hour = d.hour""")


# Two-sided P value: one minus twice the integral of Student's density from 0 to |t| (Simpson's rule).
_P_VALUE = """1 - 2 * abs(t) / 60000 * list_sum(list_transform(range(20001), lambda i:
    CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - ln(v * pi()) / 2 - (v + 1) / 2 * ln(1 + (i * t / 20000) ** 2 / v))))"""


def _fit(source: str, x: str, y: str, label: str) -> str:
    return f"""
SELECT '{label}' AS fit, n, {_r('slope', 'slope')}, {_r('intercept', 'intercept')}, {_r('r2', 'r2')},
       {_r('t', 't_statistic')}, {_r(_P_VALUE, 'p_value')}, {_r('x_min', 'x_min')}, {_r('x_max', 'x_max')}
FROM (SELECT *, slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) AS t, (n - 2)::DOUBLE AS v
      FROM (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
             regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, min(x) AS x_min, max(x) AS x_max
      FROM (SELECT {x} AS x, {y} AS y FROM {source}) WHERE x IS NOT NULL AND y IS NOT NULL))"""


def _fits(source: str, x: str, y: str) -> str:
    log = lambda c: f"CASE WHEN {c} > 0 THEN ln({c}) END"
    return f"{_fit(source, x, y, 'linear')} UNION ALL {_fit(source, log(x), log(y), 'loglog')}"


oracle("ols_fit", ["uplink"], _fits("uplink", "mb_per_online_day", "ul_ratio"))
oracle("ols_curve", ["uplink"], f"""
SELECT i, {_r('x', 'x')}, fit, {_r("CASE fit WHEN 'linear' THEN a + b * x ELSE exp(la + lb * ln(x)) END", 'prediction')}
FROM (SELECT *, lo + (hi - lo) * i / 999.0::DOUBLE AS x
      FROM (SELECT regr_intercept(ul_ratio, mb_per_online_day) AS a, regr_slope(ul_ratio, mb_per_online_day) AS b,
                   regr_intercept(ln(ul_ratio), ln(mb_per_online_day)) AS la,
                   regr_slope(ln(ul_ratio), ln(mb_per_online_day)) AS lb,
                   min(mb_per_online_day) AS lo, max(mb_per_online_day) AS hi FROM uplink),
           (SELECT CAST(unnest(range(1000)) AS INT) AS i), (SELECT unnest(['linear', 'loglog']) AS fit))""")
oracle("group_cv", ["buys"], f"""
SELECT user_id, {_r('avg(mb)', 'mean')}, {_r('stddev_samp(mb)', 'std')}, count(*) AS count,
       {_r('stddev_samp(mb) / avg(mb)', 'c_of_v')}
FROM (SELECT user_id, sum(amount_bytes)::DOUBLE / 1e6 AS mb FROM buys GROUP BY user_id, CAST(ts AS DATE))
GROUP BY 1 HAVING count(*) > 1""")

# --- shared intermediates ------------------------------------------------------------------------------------------

oracle("log_gaps", ["gaps"], "SELECT * FROM gaps")
oracle("log_gaps_running_max", ["typical_p2p"], _gap_sql("typical_p2p", "running_max"))
oracle("full_gap_days", ["gap_days"], "SELECT * FROM gap_days")
oracle("user_flow_range", ["flow_range"], "SELECT * FROM flow_range")
oracle("user_purchase_range", ["purchase_range"], "SELECT * FROM purchase_range")
oracle("user_active_deltas", ["active"], f"""
SELECT * REPLACE ({_r('days_since_first_active', 'days_since_first_active')}, {_r('days_active', 'days_active')}),
       days_online + outage_impact_days AS optimistic_days_online FROM active""")
oracle("daily_category", ["fx_daily"], _sum("user_id, category, day", "fx_daily"))
oracle("daily_org", ["fx_daily"], _sum("user_id, org, day", "fx_daily"))
oracle("daily_domain", ["fx_flows"], _sum(f"user_id, fqdn, {_day()} AS day", "fx_flows"))
oracle("early_balances", ["early"], "SELECT * FROM early")
oracle("early_registered_users", ["offsets"], "SELECT user_id FROM offsets")
oracle("untainted_txn", ["fx_transactions"], """
SELECT * FROM fx_transactions WHERE txn_id NOT IN (SELECT txn_id FROM trace WHERE tainted)""", recursive="""
steps AS (SELECT *, row_number() OVER (ORDER BY ts, txn_id) AS n FROM fx_transactions
          WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-24'),
trace(n, txn_id, tainted, dirty) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false,
         (SELECT list(CAST(0 AS BIGINT)) FROM range((SELECT max(greatest(coalesce(user_id, 0), coalesce(dest_user_id, 0)))
                                                     + 1 FROM fx_transactions)))
  UNION ALL
  SELECT n, txn_id, own OR spends,
         CASE WHEN own THEN list_transform(dirty, lambda v, i: CASE WHEN i = user_id + 1 THEN v + amount_idr ELSE v END)
              WHEN spends AND kind = 'purchase' THEN list_transform(dirty, lambda v, i:
                CASE WHEN i = user_id + 1 THEN greatest(v - amount_idr, 0) ELSE v END)
              WHEN spends THEN list_transform(dirty, lambda v, i:
                CASE WHEN i = user_id + 1 THEN greatest(v - amount_idr, 0)
                     WHEN i = dest_user_id + 1 THEN v + amount_idr ELSE v END)
              ELSE dirty END
  FROM (SELECT s.*, t.dirty, coalesce(s.user_id = s.dest_user_id, false) AS own,
               coalesce(s.user_id <> s.dest_user_id OR s.dest_user_id IS NULL, false)
                 AND s.kind IN ('user_transfer', 'admin_transfer', 'purchase')
                 AND coalesce(t.dirty[s.user_id + 1], 0) > 0 AS spends
        FROM trace t JOIN steps s ON s.n = t.n + 1))""")
oracle("user_ledger", ["ledger"], "SELECT * FROM ledger")
oracle("running_balance", ["balances"], "SELECT * FROM balances")
oracle("all_flows", ["all3"], "SELECT * FROM all3")
_CONSOLIDATED = "SELECT * REPLACE (round(seconds_since_last + 2.37e-9, 6) AS seconds_since_last) FROM consolidated"
oracle("consolidated_purchases", ["consolidated"], _CONSOLIDATED)

# --- data balance --------------------------------------------------------------------------------------------------

oracle("balance_events", ["bal_events"], "SELECT * FROM bal_events")
oracle("balance_selectivity", ["fx_flows", "eligible"], """
SELECT count(*) AS flows, count(*) FILTER (k) AS user_flows, count(*) FILTER (k AND NOT is_local) AS external_user_flows
FROM (SELECT *, user_id IN (SELECT user_id FROM eligible) AS k FROM fx_flows)""")
oracle("last_ext_rx", ["last_rx"], "SELECT user_id, type, event_id, last_ext_rx FROM last_rx")
oracle("zero_ranges", ["zero_ranges"], "SELECT * FROM zero_ranges")
oracle("balance_init", ["bal_init"], "SELECT * FROM bal_init")
oracle("tare_offsets", ["tares"], "SELECT * FROM tares")
oracle("balance_final", ["bal_history", "tares"], """
SELECT user_id, row_number() OVER w AS position, type, ts, CAST(net_bytes AS BIGINT) AS net_bytes,
       CAST(greatest(sum(net_bytes) OVER w, 0) AS BIGINT) AS balance
FROM (SELECT h.user_id, h.ts, h.rank, h.event_id, h.type, coalesce(t.tare_bytes, h.net_bytes) AS net_bytes
      FROM bal_history h LEFT JOIN tares t
        ON h.type = 'tare' AND h.user_id = t.user_id AND h.event_id = t.event_id)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, rank, event_id ROWS UNBOUNDED PRECEDING)""")
oracle("user_ledger_hourly", ["fx_flows", "buys"], f"""
SELECT *, CAST(sum(bytes) OVER (PARTITION BY user_id ORDER BY ts, rank, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
          AS balance
FROM (SELECT s.user_id, s.ts, CAST(0 AS INT) AS rank, CAST(0 AS BIGINT) AS event_id, 'spend' AS type,
             CAST(coalesce(-b, 0) AS BIGINT) AS bytes
      FROM (SELECT user_id, unnest(generate_series(min(date_trunc('hour', start_ts)),
                                                   max(date_trunc('hour', start_ts)), INTERVAL 1 HOUR)) AS ts
            FROM fx_flows GROUP BY 1) s
      LEFT JOIN (SELECT user_id, date_trunc('hour', start_ts) AS ts, sum({_TOTAL}) AS b FROM fx_flows GROUP BY 1, 2) d
        ON s.user_id = d.user_id AND s.ts = d.ts
      UNION ALL SELECT user_id, ts, 1, txn_id, 'topup', amount_bytes FROM buys)""")

# --- traffic -------------------------------------------------------------------------------------------------------


def _weekly(source: str, label: str, day: str) -> str:
    weekly = (
        f"SELECT {_week(day)} AS week, {label}, sum(bytes_up) AS bytes_up, sum(bytes_down) AS bytes_down "
        f"FROM {source} GROUP BY 1, 2"
    )
    return f"""
SELECT w.{label}, w.direction, week, round(b / 1e9 + 2.37e-9, 6) AS gb, o."order" FROM (
  SELECT week, {label}, 'Downlink' AS direction, bytes_down AS b FROM ({weekly})
  UNION ALL SELECT week, {label}, 'Uplink', bytes_up FROM ({weekly})) w
JOIN ({_layers(source, label)}) o ON w.{label} = o.{label} AND w.direction = o.direction"""


def _label_user(label: str) -> str:
    return f"""
(SELECT u.user_id, {label}, b, user_b, days_online, user_b / days_online AS daily FROM (
   SELECT user_id, {label}, CAST(sum({_TOTAL}) AS BIGINT) AS b, CAST(sum(sum({_TOTAL})) OVER (PARTITION BY user_id)
          AS BIGINT) AS user_b FROM fx_flows GROUP BY 1, 2) u JOIN strict USING (user_id))"""


def _label_rank(label: str) -> str:
    return (
        f"(SELECT {label}, rank() OVER (ORDER BY sum({_TOTAL}) DESC) AS label_rank FROM fx_flows GROUP BY 1)"
    )


oracle("bytes_per_user", ["fx_daily"], """
SELECT user_id, 'bytes_up' AS direction, CAST(sum(bytes_up) AS BIGINT) AS amount FROM fx_daily GROUP BY 1
UNION ALL SELECT user_id, 'bytes_down', CAST(sum(bytes_down) AS BIGINT) FROM fx_daily GROUP BY 1""")
oracle("bytes_cat_org_day", ["fx_daily"], _sum("day, category, org", "fx_daily"))
oracle("bytes_cat_week", ["fx_daily"], _weekly("fx_daily", "category", "day"))
CTES["folded"] = (["fx_daily"], f"""
SELECT day, CASE WHEN org IN {_TOP9.format(src='fx_daily', amount=_TOTAL)} THEN org
                 ELSE 'Other N=' || ((SELECT count(DISTINCT org) FROM fx_daily) - 9) END AS org, bytes_up, bytes_down
FROM fx_daily""")
oracle("bytes_org_week", ["folded"], _weekly("folded", "org", "day"))
oracle("bytes_cat_total", ["fx_daily"], f"""
SELECT category, direction, {_r('CASE WHEN b = 0 THEN 1 ELSE b END / 1e9', 'gb')} FROM (
  SELECT category, 'bytes_up' AS direction, sum(bytes_up) AS b FROM fx_daily GROUP BY 1
  UNION ALL SELECT category, 'bytes_down', sum(bytes_down) FROM fx_daily GROUP BY 1)""")
_MAPPED = lambda dim: f"""
SELECT '{dim}' AS dimension, {_r('a / 1e9', 'total_gb')}, {_r('d / 1e9', 'unknown_no_dns_gb')},
       {_r('m / 1e9', 'unknown_not_mapped_gb')}, {_r('(a - d) / 1e9', 'mappable_gb')},
       {_r('(a - d - m) / 1e9', 'mapped_gb')}, {_r('(a - d - m) / a', 'mapped_fraction')},
       {_r('(a - d - m) / (a - d)', 'mapped_fraction_of_mappable')}
FROM (SELECT sum({_TOTAL})::DOUBLE AS a, coalesce(sum({_TOTAL}) FILTER ({dim} = {_UNKNOWN}), 0)::DOUBLE AS d,
             coalesce(sum({_TOTAL}) FILTER ({dim} = 'Unknown (Not Mapped)'), 0)::DOUBLE AS m FROM fx_flows)"""
oracle("mapped_stats", ["fx_flows"], f"{_MAPPED('org')} UNION ALL {_MAPPED('category')}")
oracle("cat_per_user", ["fx_flows", "strict"], f"""
SELECT t.user_id, t.category, b AS bytes_total, user_rank, label_rank,
       {_r('b / t.days_online', 'bytes_per_online_day')}, {_r('b / t.days_online / daily', 'share')}
FROM {_label_user('category')} t
JOIN (SELECT user_id, rank() OVER (ORDER BY daily) AS user_rank FROM (
        SELECT DISTINCT user_id, daily FROM {_label_user('category')})) USING (user_id)
JOIN {_label_rank('category')} l ON t.category = l.category""")
for _key, _label in (("cat_per_quantile", "category"), ("org_per_quantile", "org")):
    oracle(_key, ["fx_flows", "strict"], f"""
SELECT t.{_label}, CAST(least(floor((rk - lo) / ((hi - lo) / 10.0::DOUBLE)), 9) AS INT) AS bin,
       {_r('avg(b)', 'bytes_total')}, {_r('avg(b / t.days_online) / 1e6', 'mb_per_online_day')},
       {_r('avg(b / user_b)', 'share')}, any_value(label_rank) AS label_rank
FROM {_label_user(_label)} t
JOIN (SELECT *, min(rk) OVER () AS lo, max(rk) OVER () AS hi FROM (
        SELECT user_id, rank() OVER (ORDER BY daily) AS rk FROM (
          SELECT DISTINCT user_id, daily FROM {_label_user(_label)}))) USING (user_id)
JOIN {_label_rank(_label)} l ON t.{_label} = l.{_label} GROUP BY 1, 2""")
oracle("day_of_week", ["day_total"], f"SELECT * REPLACE ({_r('gb', 'gb')}) FROM day_total")
oracle("day_of_week_ci", ["day_total"], f"""
SELECT weekday, count(*) AS days, {_r('avg(gb)', 'mean_gb')},
       {_r('avg(gb) - 1.96 * stddev_samp(gb) / sqrt(count(*))', 'ci_low')},
       {_r('avg(gb) + 1.96 * stddev_samp(gb) / sqrt(count(*))', 'ci_high')}
FROM day_total WHERE condition = 'Normal' GROUP BY 1""")
oracle("low_days", ["day_total"], f"SELECT * REPLACE ({_r('gb', 'gb')}) FROM day_total WHERE gb < 0.017::DOUBLE")
CTES["mb_day"] = (["fx_flows", "active"], """
SELECT type, CASE type WHEN 'Online Ratio' THEN b / 1e6 / days_online ELSE b / 1e6 / days_active END AS mb
FROM (SELECT user_id, CAST(sum(bytes_up + bytes_down) AS BIGINT) AS b FROM fx_flows GROUP BY 1)
JOIN active USING (user_id), (SELECT unnest(['Online Ratio', 'Active Ratio']) AS type)""")
oracle("mb_per_online_day_cdf", ["mb_day"], _rounded_value(_cdf("mb_day", "mb", "type"), "mb"))
CTES["named_ports"] = (["fx_flows"], f"""
SELECT {_day()} AS day, {_protocol()} AS name, bytes_up, bytes_down FROM fx_flows""")
oracle("proto_trend", ["named_ports"], _weekly("named_ports", "name", "day"))
oracle("other_udp_ports", ["fx_flows"], f"""
SELECT dest_port, CAST(sum({_TOTAL}) AS BIGINT) AS bytes_total FROM fx_flows
WHERE protocol = 17 AND {_protocol()} = 'Other UDP' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
oracle("time_of_day_total", ["hourly"], f"""
SELECT hour, type, {_r("CASE type WHEN 'Mean' THEN m WHEN 'Max' THEN x WHEN '90th Percentile' THEN q90 ELSE q99 END", 'mb')}
FROM (SELECT hour, avg(mb) AS m, max(mb) AS x, quantile_cont(mb, 0.9) AS q90, quantile_cont(mb, 0.99) AS q99
      FROM (SELECT hour, day, sum(bytes_total) / 1e6 AS mb FROM hourly WHERE {_NORMAL} GROUP BY 1, 2) GROUP BY 1),
     (SELECT unnest(['Mean', 'Max', '90th Percentile', '99th Percentile']) AS type)""")
oracle("time_of_day_category", ["hourly"], f"""
SELECT hour, category, {_r('avg(mb)', 'mean')}, {_r('quantile_cont(mb, 0.9)', 'q90')},
       {_r('quantile_cont(mb, 0.99)', 'q99')}
FROM (SELECT *, bytes_total / 1e6 AS mb FROM hourly WHERE {_NORMAL}) GROUP BY 1, 2""")
oracle("hour_density", ["hourly"], f"""
SELECT hour, category, {_r('sum(bytes_total)::DOUBLE / sum(sum(bytes_total)) OVER (PARTITION BY category)', 'byte_density')}
FROM hourly WHERE {_NORMAL} GROUP BY 1, 2""")
oracle("throughput_day", ["fx_flows", "fx_p2p"], f"""
SELECT day, throughput_type, bytes, {_r('bytes / 1e9', 'gb')},
       {_r("avg(bytes / 1e9) OVER (PARTITION BY throughput_type ORDER BY day ROWS 6 PRECEDING)", 'gb_7d')}
FROM (SELECT k.day, k.throughput_type, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes
      FROM (SELECT CAST(unnest({_STUDY_DAYS}) AS DATE) AS day, throughput_type
            FROM (SELECT unnest(['Up', 'Down', 'Local']) AS throughput_type)) k
      LEFT JOIN (SELECT {_day()} AS day, 'Up' AS throughput_type, bytes_up AS b FROM fx_flows
                 UNION ALL SELECT {_day()}, 'Down', bytes_down FROM fx_flows
                 UNION ALL SELECT {_day()}, 'Local', bytes_a_to_b + bytes_b_to_a FROM fx_p2p) d
        ON k.day = d.day AND k.throughput_type = d.throughput_type GROUP BY 1, 2)""")
oracle("local_week", ["fx_flows", "fx_p2p"], f"""
SELECT week, direction, CAST(CASE direction WHEN 'bytes_up' THEN sum(b) FILTER (d = 'up' AND NOT l)
         WHEN 'bytes_down' THEN sum(b) FILTER (d = 'down' AND NOT l) WHEN 'local_up' THEN sum(b) FILTER (d = 'up' AND l)
         WHEN 'local_down' THEN sum(b) FILTER (d = 'down' AND l) ELSE sum(b) FILTER (d = 'p2p') END AS BIGINT) AS bytes
FROM (SELECT {_week(_day(), 7)} AS week, 'up' AS d, bytes_up AS b, is_local AS l FROM fx_flows
      UNION ALL SELECT {_week(_day(), 7)}, 'down', bytes_down, is_local FROM fx_flows
      UNION ALL SELECT {_week(_day(), 7)}, 'p2p', bytes_a_to_b + bytes_b_to_a, NULL FROM fx_p2p),
     (SELECT unnest(['bytes_up', 'bytes_down', 'local_up', 'local_down', 'bytes_p2p']) AS direction) GROUP BY 1, 2""")
oracle("nouser_day", ["fx_nouser"], f"""
SELECT k.day, k.kind, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes_total
FROM (SELECT CAST(unnest({_STUDY_DAYS}) AS DATE) AS day, kind FROM (
        SELECT unnest(['SSDP Query (No Answer)', 'Unanswered', 'Unknown']) AS kind)) k
LEFT JOIN (SELECT {_day()} AS day, bytes_a_to_b + bytes_b_to_a AS b,
                  CASE WHEN b_port = 1900 AND bytes_b_to_a = 0 THEN 'SSDP Query (No Answer)'
                       WHEN bytes_b_to_a = 0 THEN 'Unanswered' ELSE 'Unknown' END AS kind FROM fx_nouser) d
  ON k.day = d.day AND k.kind = d.kind GROUP BY 1, 2""")
CTES["pairs"] = (["fx_p2p"], f"""
SELECT {_day()} AS day, least(user_a, user_b) AS user_x, greatest(user_a, user_b) AS user_y,
       CAST(sum(bytes_a_to_b + bytes_b_to_a) AS BIGINT) AS bytes_total
FROM fx_p2p WHERE bytes_a_to_b <> 0 AND bytes_b_to_a <> 0 GROUP BY ALL""")
oracle("p2p_pair_day", ["pairs"], "SELECT * FROM pairs")
oracle("p2p_pair_total", ["pairs"], f"""
SELECT user_x, user_y, CAST(sum(bytes_total) AS BIGINT) AS bytes_total, count(*) AS days,
       {_r('avg(bytes_total)', 'average_bytes')} FROM pairs GROUP BY 1, 2""")
oracle("ice_by_dest", ["fx_flows"], f"""
SELECT dest_ip, fqdn, CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down,
       CAST(sum({_TOTAL}) AS BIGINT) AS bytes_total, count(DISTINCT user_id) AS user_count
FROM fx_flows WHERE category IN ('Peer to Peer', 'ICE (STUN/TURN)') GROUP BY 1, 2""")
oracle("ul_dl_ratio", ["uplink"], "SELECT * REPLACE (" + ", ".join(_r(c, c) for c in (
    "bytes_per_online_day", "normalized_days_online", "ul_ratio", "dl_ratio", "mb_per_online_day", "days_active"
)) + ") FROM uplink")
_HEALTH_WEEK = f"{_week('day')} AS week"
oracle("health_volume", ["names"], f"""
SELECT week, is_health, direction, {_r("CASE direction WHEN 'bytes_up' THEN u ELSE d END / 1e9", 'gb')}
FROM (SELECT {_HEALTH_WEEK}, is_health, sum(bytes_up) AS u, sum(bytes_down) AS d FROM names GROUP BY 1, 2),
     (SELECT unnest(['bytes_up', 'bytes_down']) AS direction)""")
oracle("health_bytes", ["names"], f"""
SELECT {_HEALTH_WEEK}, CAST(sum({_TOTAL}) AS BIGINT) AS bytes FROM names WHERE is_health GROUP BY 1""")
oracle("health_users", ["names"], f"""
SELECT {_HEALTH_WEEK}, count(DISTINCT user_id) AS users FROM names WHERE is_health GROUP BY 1""")
oracle("health_domain_week", ["names"], f"""
SELECT {_HEALTH_WEEK}, primary_domain, {_r(f'sum({_TOTAL}) / 1e9', 'gb')} FROM names WHERE is_health GROUP BY 1, 2""")
oracle("health_domain_users", ["names"], f"""
SELECT primary_domain, week, coalesce(users, 0) AS users,
       CAST(trunc((week - DATE '2024-01-16') / 7.0) AS INT) AS week_number
FROM (SELECT primary_domain, CAST(unnest(generate_series(DATE '2024-01-08', DATE '2024-02-02', INTERVAL 7 DAY)) AS DATE)
             AS week FROM (SELECT DISTINCT primary_domain FROM names WHERE is_health))
FULL JOIN (SELECT {_HEALTH_WEEK}, primary_domain, count(DISTINCT user_id) AS users FROM names WHERE is_health
           GROUP BY 1, 2) USING (primary_domain, week)""")

# --- users ---------------------------------------------------------------------------------------------------------


def _matrix(label: str, totals: str) -> str:
    return f"""
SELECT user_id, {label}, {_r('b / 1e9', 'gb')},
       CASE WHEN b > 0 THEN round(log10(b / 1e9) + 2.37e-9, 6) END AS log_gb, {_r('b / u', 'share')},
       CASE WHEN b > 0 THEN round(log10(b / 1e6 / days_active) + 2.37e-9, 6) END AS log_mb_per_day
FROM (SELECT user_id, {label}, CAST(sum(b) AS BIGINT) AS b,
             CAST(sum(sum(b)) OVER (PARTITION BY user_id) AS BIGINT) AS u FROM ({totals}) GROUP BY 1, 2)
JOIN eligible USING (user_id)"""


oracle("user_category_matrix", ["fx_flows", "eligible"],
       _matrix("category", f"SELECT user_id, category, {_TOTAL} AS b FROM fx_flows"))
_PER_ORG = f"SELECT user_id, org, sum({_TOTAL}) AS b FROM fx_flows GROUP BY 1, 2"
oracle("user_org_matrix", ["fx_flows", "eligible"], _matrix("org", f"""
SELECT user_id, CASE WHEN n >= 5 THEN org ELSE 'Aggregated (Users < 5)' END AS org, b FROM ({_PER_ORG})
JOIN (SELECT org, count(*) FILTER (b <> 0) AS n FROM ({_PER_ORG}) GROUP BY 1) USING (org)"""))
oracle("user_category_split", ["fx_daily"], f"""
SELECT user_id, category, {_r('b / 1e9', 'gb')}, top_n FROM (
  SELECT user_id, category, sum({_TOTAL}) AS b FROM fx_daily GROUP BY 1, 2)
JOIN (SELECT user_id, CASE WHEN row_number() OVER (ORDER BY sum({_TOTAL}) DESC, user_id) <= 20 THEN 'Top 20'
             ELSE 'Bottom ' || (count(*) OVER () - 20) END AS top_n FROM fx_daily GROUP BY 1) USING (user_id)""")
CTES["user_hours"] = (["fx_flows"], f"""
SELECT {_day()} AS day, CAST(hour(start_ts) AS INT) AS hour, count(DISTINCT user_id) AS users FROM fx_flows
GROUP BY 1, 2""")
oracle("users_per_hour", ["user_hours"], "SELECT * FROM user_hours")
oracle("users_time_of_day", ["user_hours"], f"""
SELECT hour, type,
  {_r("CASE type WHEN 'Mean' THEN m WHEN 'Max' THEN x WHEN '90th Percentile' THEN q90 ELSE q99 END", 'users')}
FROM (SELECT hour, avg(users) AS m, max(users)::DOUBLE AS x, quantile_cont(users::DOUBLE, 0.9) AS q90,
             quantile_cont(users::DOUBLE, 0.99) AS q99 FROM user_hours WHERE {_NORMAL} GROUP BY 1),
     (SELECT unnest(['Mean', 'Max', '90th Percentile', '99th Percentile']) AS type)""")
oracle("user_days", ["fx_flows"], f"SELECT DISTINCT {_day()} AS day, user_id FROM fx_flows")
oracle("users_over_time", ["fx_flows", "fx_transactions", "early"], f"""
SELECT day, user_type, CAST(n AS BIGINT) AS num_users FROM (
  SELECT day, user_type, CASE user_type WHEN 'Registered' THEN r WHEN 'Unique Daily Online' THEN coalesce(dn, 0)
         WHEN 'Unique Weekly Online' THEN first_value(wn IGNORE NULLS) OVER ahead
         ELSE first_value(mn IGNORE NULLS) OVER ahead END AS n
  FROM (SELECT day, dn, wn, mn, last_value(rn IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS r
        FROM (SELECT day FROM spine UNION SELECT day FROM w UNION SELECT day FROM m)
        LEFT JOIN (SELECT * FROM (SELECT day, sum(count(*)) OVER (ORDER BY day) AS rn FROM (
            SELECT CAST(min(ts) AS DATE) AS day FROM (
              SELECT user_id, TIMESTAMP '2024-01-02' AS ts FROM early
              UNION ALL SELECT user_id, ts FROM fx_transactions WHERE user_id IS NOT NULL) GROUP BY user_id)
          GROUP BY day) SEMI JOIN spine USING (day)) USING (day)
        LEFT JOIN (SELECT {_day()} AS day, count(DISTINCT user_id) AS dn FROM fx_flows
                   WHERE start_ts >= TIMESTAMP '2024-01-02' GROUP BY 1) USING (day)
        LEFT JOIN w USING (day)
        LEFT JOIN (SELECT day, coalesce(mn, 0) AS mn FROM m FULL JOIN (
                     SELECT day FROM spine WHERE day = last_day(day)) USING (day)) USING (day)),
       (SELECT unnest(['Registered', 'Unique Daily Online', 'Unique Weekly Online', 'Unique Monthly Online'])
        AS user_type)
  WINDOW ahead AS (PARTITION BY user_type ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
WHERE n IS NOT NULL AND day < DATE '2024-02-01'""", recursive=f"""
spine AS (SELECT CAST(unnest({_STUDY_DAYS}) AS DATE) AS day),
w AS (SELECT {_week(_day())} AS day, count(DISTINCT user_id) AS wn FROM fx_flows GROUP BY 1),
m AS (SELECT last_day({_day()}) AS day, count(DISTINCT user_id) AS mn FROM fx_flows GROUP BY 1)""")
CTES["online_long"] = (["online"], """
SELECT 'Optimistic (ignore outages)' AS type, optimistic_online_ratio AS value FROM online
UNION ALL SELECT 'Observed', observed_online_ratio FROM online""")
oracle("online_ratio", ["online_long"], _rounded_value(_cdf("online_long", "value", "type"), "value"))
oracle("online_vs_usage", ["usage"], f"""
SELECT user_id, days_online, {_r('online_ratio', 'online_ratio')}, {_r('mb_per_online_day', 'mb_per_online_day')}
FROM usage""")
oracle("online_vs_usage_fit", ["usage"], _fits("usage", "mb_per_online_day", "online_ratio"))
oracle("users_without_dns", ["fx_daily", "fx_dns"], """
SELECT DISTINCT user_id FROM fx_daily WHERE user_id NOT IN (SELECT user_id FROM fx_dns)""")
oracle("top_hosts", ["fx_dns"], """
SELECT domain_name, count(*) AS accesses FROM fx_dns WHERE domain_name <> 'www.google.com' GROUP BY 1""")
oracle("top_hosts_containing", ["fx_dns"], """
SELECT domain_name, count(*) AS accesses FROM fx_dns WHERE domain_name LIKE '%cdn%' GROUP BY 1""")

# --- finance -------------------------------------------------------------------------------------------------------

oracle("purchase_total", ["spent"], "SELECT * REPLACE (" + ", ".join(
    _r(c, c) for c in ("amount_gb", "amount_usd", "usd_per_day", "days_active")) + ") FROM spent")
oracle("purchase_total_cdf", ["spent"], _rounded_value(_cdf("spent", "amount_usd"), "amount_usd"))
oracle("purchase_rate", ["spent"], _rounded_value(_cdf("spent", "usd_per_day"), "usd_per_day"))
oracle("purchase_interval", ["intervals"],
       f"SELECT user_id, {_r('mean', 'mean')}, {_r('q90', 'q90')}, {_r('q99', 'q99')} FROM intervals")
CTES["interval_long"] = (["intervals"], """
SELECT 'User''s Mean' AS type, mean / 86400 AS value FROM intervals
UNION ALL SELECT 'User''s 90% Quantile', q90 / 86400 FROM intervals
UNION ALL SELECT 'User''s 99% Quantile', q99 / 86400 FROM intervals""")
oracle("purchase_interval_cdf", ["interval_long"], _rounded_value(_cdf("interval_long", "value", "type"), "value"))
oracle("purchase_amount_hist", ["consolidated"], f"""
SELECT amount_bytes, count(*) AS count, {_r('amount_bytes / 1e6', 'amount_mb')} FROM consolidated GROUP BY 1""")
oracle("package_stats", ["buys"], f"""
SELECT amount_bytes, count(*) AS count, {_r('amount_bytes / 1e6', 'amount_mb')},
       {_r('amount_bytes / 1e6 * count(*) / 1000', 'total_gb')} FROM buys GROUP BY 1""")
oracle("user_packages", ["buys"], """
SELECT user_id, amount_bytes, count(*) AS count, count(*) * amount_bytes AS bytes_per_package FROM buys GROUP BY 1, 2""")
oracle("zero_time", ["zero_time"], "SELECT * REPLACE (" + ", ".join(_r(c, c) for c in (
    "days_at_zero", "days_nonzero", "days_active", "days_since_first_active", "fraction_at_zero", "fraction_nonzero"
)) + ") FROM zero_time")
oracle("zero_time_cdf", ["zero_time"], _rounded_value(_cdf("zero_time", "fraction_nonzero"), "fraction_nonzero"))
oracle("zero_time_counts", ["zero_time"], f"""
SELECT *, {_r('nonzero_95 / users', 'nonzero_95_share')},
       {_r('CASE WHEN active_over_30_days > 0 THEN nonzero_95_and_over_30_days / active_over_30_days END', 'nonzero_95_share_of_long')}
FROM (SELECT count(*) AS users, count(*) FILTER (days_at_zero = 0) AS never_zero,
             count(*) FILTER (fraction_nonzero > 0.95::DOUBLE) AS nonzero_95,
             count(*) FILTER (days_active > 30) AS active_over_30_days,
             count(*) FILTER (fraction_nonzero > 0.95::DOUBLE AND days_active > 30) AS nonzero_95_and_over_30_days
      FROM zero_time)""")
oracle("revenue_cumulative", ["buys"], f"""
SELECT day, series, {_r('usd', 'usd')}, {_r('sum(usd) OVER (PARTITION BY series ORDER BY day)', 'usd_cumulative')}
FROM (SELECT CAST(ts AS DATE) AS day, series, sum(amount_idr)::DOUBLE * (1.0::DOUBLE / 14150) AS usd
      FROM buys JOIN (SELECT user_id, rank() OVER (ORDER BY sum(amount_idr) DESC) AS rk FROM buys GROUP BY 1)
        USING (user_id),
           (SELECT unnest([0, 5, 10, 15, 20]) AS cut,
                   unnest(['Total Revenue', 'Revenue Sans Top 5', 'Revenue Sans Top 10', 'Revenue Sans Top 15',
                           'Revenue Sans Top 20']) AS series)
      WHERE rk > cut GROUP BY 1, 2
      UNION ALL
      SELECT day, 'Costs', sum(usd) FROM (
        SELECT DATE '2024-01-02' AS day, 9334.0::DOUBLE AS usd UNION ALL SELECT DATE '2024-01-13', 1000.0
        UNION ALL SELECT DATE '2024-01-31', 300.0 UNION ALL SELECT DATE '2024-01-31', 1300000 * (1.0::DOUBLE / 14150))
      GROUP BY 1)""")
oracle("self_transfers", ["fx_transactions"], """
SELECT CAST(ts AS DATE) AS day, CAST(sum(amount_idr) AS BIGINT) AS amount_idr, count(*) AS transfers,
       count(DISTINCT user_id) AS users
FROM fx_transactions WHERE kind IN ('user_transfer', 'admin_transfer') AND user_id = dest_user_id
  AND ts > TIMESTAMP '2024-01-05' GROUP BY 1""")
oracle("loan_matrix", ["loans", "lasting_loans"], f"""
SELECT timeline, user_id, dest_user_id, {_r('sum(amount_idr) / 16.0::DOUBLE', 'idr_per_day')},
       (SELECT count(*) FROM (SELECT user_id FROM loans UNION SELECT dest_user_id FROM loans)) AS matrix_users
FROM lasting_loans GROUP BY 1, 2, 3""")
oracle("loan_same_users", ["lasting_loans"], "SELECT * FROM lasting_loans")
oracle("loan_rates", ["loans"], f"""
SELECT period, CAST(sum(amount_idr) AS BIGINT) AS total_idr, count(*) AS transfers,
       {_r('sum(amount_idr) / (16.0::DOUBLE / 7)', 'idr_per_week')}, {_r('sum(amount_idr) / 16.0::DOUBLE', 'idr_per_day')},
       {_r('count(*) / (16.0::DOUBLE / 7)', 'transfers_per_week')}, {_r('count(*) / 16.0::DOUBLE', 'transfers_per_day')}
FROM loans GROUP BY 1""")
oracle("purchase_count_user", ["buys"], "SELECT user_id, count(*) AS purchase_count FROM buys GROUP BY 1")
_SENT = "(SELECT user_id, {a} AS s FROM fx_transactions WHERE kind = 'user_transfer' GROUP BY 1)"
_GOT = "(SELECT dest_user_id AS user_id, {a} AS g FROM fx_transactions WHERE kind = 'user_transfer' GROUP BY 1)"
oracle("transfer_in_out_count", ["fx_transactions"], f"""
SELECT user_id, direction, CASE direction WHEN 'transfer_src_count' THEN s ELSE g END AS count
FROM {_SENT.format(a='count(*)')} FULL JOIN {_GOT.format(a='count(*)')} USING (user_id),
     (SELECT unnest(['transfer_src_count', 'transfer_dst_count']) AS direction)""")
oracle("transfer_in_out_sum", ["fx_transactions"], f"""
SELECT *, {_r('idr * (1.0::DOUBLE / 14150)', 'usd')} FROM (
  SELECT user_id, direction, CAST(CASE direction WHEN 'transfer_src_sum' THEN s ELSE g END AS BIGINT) AS idr
  FROM {_SENT.format(a='sum(amount_idr)')} FULL JOIN {_GOT.format(a='sum(amount_idr)')} USING (user_id),
       (SELECT unnest(['transfer_src_sum', 'transfer_dst_sum']) AS direction))""")
oracle("topup_cumulative", ["fx_transactions"], f"""
SELECT *, {_r('idr_cumulative * (1.0::DOUBLE / 14150)', 'usd_cumulative')} FROM (
  SELECT CAST(ts AS DATE) AS day, CAST(sum(amount_idr) AS BIGINT) AS amount_idr,
         CAST(sum(sum(amount_idr)) OVER (ORDER BY CAST(ts AS DATE)) AS BIGINT) AS idr_cumulative
  FROM fx_transactions WHERE kind = 'admin_topup' GROUP BY 1)""")
oracle("purchases_by_weekday", ["buys"], f"""
SELECT dayname(day) AS weekday, count(*) AS days, {_r('min(mb)', 'minimum')}, {_r('quantile_cont(mb, 0.25)', 'q25')},
       {_r('quantile_cont(mb, 0.5)', 'median')}, {_r('quantile_cont(mb, 0.75)', 'q75')}, {_r('max(mb)', 'maximum')},
       {_r('avg(mb)', 'mean')}
FROM (SELECT CAST(ts AS DATE) AS day, sum(amount_bytes) / 1e6 AS mb FROM buys GROUP BY 1) GROUP BY 1""")
oracle("transfer_size_hist", ["fx_transactions"], """
SELECT amount_idr, count(*) AS count FROM fx_transactions WHERE kind = 'user_transfer' AND dest_user_id <> 7 GROUP BY 1""")

# --- headline ------------------------------------------------------------------------------------------------------

oracle("paper_counts", ["fx_flows", "fx_p2p", "fx_transactions"], f"""
SELECT CAST(nf AS BIGINT) AS internet_flows, CAST(n - nf + np AS BIGINT) AS intranet_flows,
       {_r('nf / (n + np)', 'internet_flow_share')}, {_r('dl / 1e9', 'internet_dl_gb')}, {_r('ul / 1e9', 'internet_ul_gb')},
       {_r('(dl + ul) / 1e9', 'internet_gb')}, {_r('(loc + bp) / 1e9', 'intranet_gb')},
       {_r('(dl + ul) / (dl + ul + loc + bp)', 'internet_byte_share')}, purchases, transactions
FROM (SELECT count(*) AS n, count(*) FILTER (NOT is_local) AS nf, sum(bytes_down) FILTER (NOT is_local)::DOUBLE AS dl,
             sum(bytes_up) FILTER (NOT is_local)::DOUBLE AS ul, sum({_TOTAL}) FILTER (is_local)::DOUBLE AS loc FROM fx_flows),
     (SELECT count(*) AS np, sum(bytes_a_to_b + bytes_b_to_a)::DOUBLE AS bp FROM fx_p2p),
     (SELECT count(*) FILTER (kind = 'purchase') AS purchases, count(*) AS transactions FROM fx_transactions)""")


def _share_rows(tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"""
SELECT '{name}' AS name, count(*) FILTER ({test}) AS flows, {_r(f'count(*) FILTER ({test}) * 100.0::DOUBLE / count(*)', 'flow_pct')},
       {_r(f'coalesce(sum({_TOTAL}) FILTER ({test}), 0) / 1e9', 'gb')},
       {_r(f'coalesce(sum({_TOTAL}) FILTER ({test}), 0) * 100.0::DOUBLE / sum({_TOTAL})', 'gb_pct')}
FROM fx_flows WHERE NOT is_local""" for name, test in tests.items())


oracle("paper_dns", ["fx_flows"], _share_rows({
    "mapped": "fqdn <> ''", "unambiguous": "fqdn <> '' AND ambiguous_fqdn_count = 1",
    "user_derived": "fqdn_source = 'user_dns_log'"}))
oracle("paper_category", ["fx_flows"], _share_rows({
    "category_mapped": "category NOT IN ('Unknown (No DNS)', 'Unknown (Not Mapped)', 'Google (No DNS)')",
    "org_mapped": "org NOT IN ('Unknown (No DNS)', 'Unknown (Not Mapped)')"}))
oracle("paper_labels", ["fx_flows"], """
SELECT count(DISTINCT category) AS unique_categories, count(DISTINCT org) AS unique_orgs FROM fx_flows
WHERE NOT is_local""")
oracle("paper_dates", ["fx_flows"], """
SELECT CAST(min(start_ts) AS DATE) AS first_day, CAST(max(start_ts) AS DATE) AS last_day, 30.0::DOUBLE AS study_days
FROM fx_flows""")
oracle("dl_ul", ["fx_mixed_flows"], f"""
SELECT {_r('sum(bytes_down)::DOUBLE / sum(bytes_up)', 'dl_ul_ratio')} FROM fx_mixed_flows WHERE NOT is_local""")
oracle("paper_bigco", ["fx_flows", "fx_p2p"], f"""
SELECT company, {_r('b / 1e9', 'gb')}, {_r('b / (a + bp)', 'share_of_all')}, {_r('b / web', 'share_of_internet')}
FROM (SELECT company, CASE company WHEN 'Facebook' THEN f WHEN 'Google' THEN g ELSE f + g END AS b, web, a, bp
      FROM (SELECT sum({_TOTAL}) FILTER (org IN ('Facebook', 'Instagram', 'WhatsApp'))::DOUBLE AS f,
                   sum({_TOTAL}) FILTER (org = 'Google')::DOUBLE AS g,
                   sum({_TOTAL}) FILTER (NOT is_local)::DOUBLE AS web, sum({_TOTAL})::DOUBLE AS a FROM fx_flows),
           (SELECT sum(bytes_a_to_b + bytes_b_to_a)::DOUBLE AS bp FROM fx_p2p),
           (SELECT unnest(['Facebook', 'Google', 'Both']) AS company))""")
oracle("paper_online", ["online"], f"""
SELECT users, steady_users, {_r('steady_users / users', 'steady_share')}, {_r('med', 'median_online_ratio')}
FROM (SELECT count(*) AS users, count(*) FILTER (optimistic_online_ratio >= 0.95::DOUBLE) AS steady_users,
             quantile_cont(optimistic_online_ratio, 0.5) AS med FROM online)""")
_VIDEO = lambda name, source: f"""
SELECT '{name}' AS users, {_r('a / 1e9', 'adult_gb')}, {_r('v / 1e9', 'video_gb')},
       {_r('(a + v) / b', 'video_share_of_all')}, {_r('(a + v) / w', 'video_share_of_internet')}
FROM (SELECT coalesce(sum({_TOTAL}) FILTER (category = 'Adult Video'), 0)::DOUBLE AS a,
             coalesce(sum({_TOTAL}) FILTER (category = 'Video'), 0)::DOUBLE AS v, sum({_TOTAL})::DOUBLE AS b,
             sum({_TOTAL}) FILTER (NOT is_local)::DOUBLE AS w FROM {source})"""
oracle("paper_video", ["fx_flows", "buys"], _VIDEO("all users", "fx_flows") + " UNION ALL " + _VIDEO(
    "top 10 spenders", """(SELECT * FROM fx_flows WHERE user_id IN (SELECT user_id FROM (
      SELECT user_id, rank() OVER (ORDER BY sum(amount_idr) DESC) AS rk FROM buys GROUP BY 1) WHERE rk <= 10))"""))
oracle("paper_inequality", ["spent"], f"""
SELECT {_r('lo', 'min_rate')}, {_r('hi', 'max_rate')}, {_r('mean', 'mean_rate')}, {_r('med', 'median_rate')},
       {_r('hi / mean', 'max_over_mean')}, {_r('hi / med', 'max_over_median')}
FROM (SELECT min(usd_per_day) AS lo, max(usd_per_day) AS hi, avg(usd_per_day) AS mean,
             quantile_cont(usd_per_day, 0.5) AS med FROM spent)""")
oracle("paper_filter_stats", ["active", "eligible", "fx_flows", "fx_p2p"], f"""
SELECT *, {_r('final_users / users', 'kept_share')}, typical_flows + p2p_flows AS all_flows
FROM (SELECT count(*) AS users, count(*) FILTER (days_since_first_active < 7) AS joined_within_week,
             count(*) FILTER (days_since_first_active >= 7 AND days_active < 1) AS active_under_a_day,
             count(*) FILTER (days_since_first_active >= 7 AND days_active >= 1) AS final_users,
             (SELECT count(*) FROM fx_flows WHERE user_id IN (SELECT user_id FROM eligible)) AS typical_flows,
             (SELECT count(*) FROM fx_p2p) AS p2p_flows FROM active)""")
oracle("paper_ice", ["fx_flows"], f"""
SELECT {_r('p / 1e9', 'p2p_gb')}, {_r('i / 1e9', 'ice_gb')}, {_r('p / w', 'p2p_share')}, {_r('i / w', 'ice_share')},
       {_r('(p + i) / w', 'both_share')}, unique_users
FROM (SELECT sum({_TOTAL}) FILTER (category = 'Peer to Peer')::DOUBLE AS p,
             sum({_TOTAL}) FILTER (category = 'ICE (STUN/TURN)')::DOUBLE AS i,
             sum({_TOTAL}) FILTER (NOT is_local)::DOUBLE AS w,
             count(DISTINCT user_id) FILTER (category IN ('Peer to Peer', 'ICE (STUN/TURN)')) AS unique_users
      FROM fx_flows)""")
oracle("paper_arpu", ["buys"], f"""
SELECT {_r('a', 'a_arpu')}, {_r('a / 12', 'm_arpu')}, {_r('a / 30', 'd_arpu')}
FROM (SELECT sum(amount_idr)::DOUBLE / count(DISTINCT user_id) AS a FROM buys)""")
oracle("uptime", ["gaps"], f"""
SELECT {_r('s', 'downtime_seconds')}, 2592000.0::DOUBLE AS study_seconds, {_r('s / 2592000.0::DOUBLE * 100', 'downtime_pct')}
FROM (SELECT sum({_us('gap_start', 'gap_end')}) / 1e6 AS s FROM gaps)""")
CTES["outages"] = (["gaps"], f"""
SELECT {_us('gap_start', 'gap_end')} / 1e6 / 3600.0::DOUBLE AS duration_hours FROM gaps
WHERE gap_end - gap_start >= INTERVAL 10 SECOND""")
oracle("outage_cdf", ["outages"], _rounded_value(_cdf("outages", "duration_hours"), "duration_hours"))
