"""Related-flow tagging against the sequential state machine it replaces."""

import random
from datetime import datetime, timedelta

import pytest

from netledger.operators import stun
from netledger.operators.stun import tag_related_flows
from netledger.params import ICE, PEER_TO_PEER, UNKNOWN_NO_DNS, UNKNOWN_NOT_MAPPED

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "flow_id long, user_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, user_port int, dest_ip string, "
    "dest_port int, protocol int, fqdn string, category string, org string"
)


def _kind(f):
    unknown = f["category"] in (UNKNOWN_NO_DNS, UNKNOWN_NOT_MAPPED) and "Unknown" in f["org"]
    if unknown or "emome-ip.hinet.net" in f["fqdn"]:
        return "peer"
    generic = f["category"] in (UNKNOWN_NOT_MAPPED, "API")
    return "ice" if "turnservice" in f["fqdn"] or "facebook" in f["fqdn"] or f["org"] == "Facebook" or generic else None


def _sequential(flows):
    """One user at a time, one start time at a time, remembering what is still in reach."""
    labels = {}
    for user in {f["user_id"] for f in flows}:
        state = []
        mine = [f for f in flows if f["user_id"] == user]
        for now in sorted({f["start_ts"] for f in mine}):
            state = [(exp, g, setup) for exp, g, setup in state if exp > now]
            cohort = [f for f in mine if f["start_ts"] == now]
            setups = [f for f in cohort if f["protocol"] == 17 and f["dest_port"] == 3478]
            state += [(now + timedelta(seconds=60), f, True) for f in setups]
            later = []
            for f in cohort:
                if f in setups:
                    continue
                same = lambda g: all(f[c] == g[c] for c in ("user_port", "dest_port", "protocol", "dest_ip"))
                hit = any(f["user_port"] == g["user_port"] if setup else same(g) for _, g, setup in state)
                if hit and _kind(f):
                    labels[f["flow_id"]] = _kind(f)
                    later.append((f["end_ts"] + timedelta(seconds=5), f, False))
            state += later
    return labels


def _run(spark, flows):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(f[c] for c in columns) for f in flows], SCHEMA)
    return {r.flow_id: (r.category, r.org) for r in tag_related_flows(df).collect()}


def _flow(i, user, at, length, port, ip, dest_port, protocol=17, fqdn="", category=UNKNOWN_NO_DNS,
          org=UNKNOWN_NO_DNS):
    start = T0 + timedelta(seconds=at)
    return dict(flow_id=i, user_id=user, start_ts=start, end_ts=start + timedelta(seconds=length), user_port=port,
                dest_ip=ip, dest_port=dest_port, protocol=protocol, fqdn=fqdn, category=category, org=org)


def test_chain_by_hand(spark):
    flows = [
        _flow(0, "u", 0, 1, 7, "s", 3478),
        _flow(1, "u", 30, 100, 7, "a", 9),       # within a minute of the set-up
        _flow(2, "u", 134, 10, 7, "a", 9),       # continues flow 1 (ends 130, in reach until 135)
        _flow(3, "u", 149, 10, 7, "a", 9),       # flow 2 reaches until 149, which is too late
        _flow(4, "u", 61, 10, 7, "b", 9),        # other destination, set-up expired
        _flow(5, "u", 59, 10, 7, "c", 9, category="Video", org="Vidio"),
        _flow(6, "u", 0, 1, 7, "d", 9, category="API", org="X"),   # same instant as the set-up counts
        _flow(7, "v", 10, 1, 7, "a", 9),         # another user
    ]
    got = _run(spark, flows)
    related = {i for i, (category, _) in got.items() if category in (PEER_TO_PEER, ICE)}
    assert related == {1, 2, 6}
    assert got[1] == (PEER_TO_PEER, "ICE Peer (Unknown Org)")
    assert got[6] == (ICE, "X")
    assert got[5] == ("Video", "Vidio")


def test_rounds_leave_out_tuples_without_a_seeded_flow(spark, monkeypatch):
    rounds = []

    def watched(candidates, *rest, mark=stun._mark_reached):
        rounds.append({r.dest_ip for r in candidates.collect()})
        return mark(candidates, *rest)

    monkeypatch.setattr(stun, "_mark_reached", watched)
    flows = [
        _flow(0, "u", 0, 1, 7, "s", 3478),
        _flow(1, "u", 30, 100, 7, "a", 9),
        _flow(2, "u", 134, 10, 7, "a", 9),
        *[_flow(10 + i, "u", 100 * i + 70, 10, 7, "b", 9) for i in range(5)],  # never within a minute of the set-up
        _flow(20, "u", 10, 10, 8, "c", 9),                                      # another port
    ]
    got = _run(spark, flows)
    assert {i for i, (category, _) in got.items() if category == PEER_TO_PEER} == {1, 2} and len(got) == len(flows)
    assert rounds[0] == {"a"} and all(r <= {"a"} for r in rounds)


@pytest.mark.parametrize("seed", range(2))
def test_random_flows_match_the_state_machine(spark, seed):
    rng = random.Random(seed)
    kinds = [(UNKNOWN_NO_DNS, UNKNOWN_NO_DNS), (UNKNOWN_NOT_MAPPED, "Google"), ("API", "X"), ("Video", "X")]
    flows = []
    for i in range(900):
        category, org = rng.choice(kinds)
        user = "hot" if rng.random() < 0.34 else f"u{rng.randrange(6)}"
        flows.append(_flow(
            i, user, rng.randrange(0, 2500), rng.choice([0, 2, 20, 300]), rng.randrange(2), f"10.0.0.{rng.randrange(2)}",
            3478 if rng.random() < 0.06 else 9, rng.choice([17, 17, 6]), rng.choice(["", "x.facebook.com"]), category, org,
        ))
    expected = _sequential(flows)
    got = _run(spark, flows)
    assert len(got) == len(flows) and len(expected) > 50
    for f in flows:
        label = expected.get(f["flow_id"])
        category = {"peer": PEER_TO_PEER, "ice": ICE, None: f["category"]}[label]
        assert got[f["flow_id"]] == (category, "ICE Peer (Unknown Org)" if label == "peer" else f["org"])
