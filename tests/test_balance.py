"""Data-balance reconstruction against a one-user-at-a-time walk."""

import random
from datetime import datetime, timedelta

from netledger.operators.balance import user_data_balance

T0 = datetime(2024, 1, 1)


def _one_user(flows, buys, min_failed):
    rows = [dict(ts=f[1], end=f[2], type="ext", rank=2, id=f[0], up=f[3], down=f[4], bought=0) for f in flows]
    rows += [dict(ts=b[1], end=b[1], type="purchase", rank=3, id=b[0], up=0, down=0, bought=b[2]) for b in buys]
    last, tares = None, []
    for r in sorted(rows, key=lambda r: (r["end"], r["rank"], r["id"])):
        if r["type"] == "ext" and r["down"] > 0:
            last = r["end"]
        if r["type"] == "purchase" and last is not None and last < r["ts"]:
            a, b = last, r["ts"]
            failed = sum(
                1 for f in rows if f["type"] == "ext" and f["down"] <= 0
                and (a <= f["ts"] <= b or a <= f["end"] <= b or (f["ts"] <= a and f["end"] >= b))
            )
            if failed >= min_failed:
                tares.append(dict(ts=a, end=b, type="tare", rank=1, id=r["id"], up=0, down=0, bought=0))
    for r in rows + tares:
        r["net"] = r["bought"] - r["up"] - r["down"]
    rows += tares
    rows.sort(key=lambda r: (r["ts"], r["rank"], r["id"]))
    running = low = 0
    for r in rows:
        running += r["net"]
        low = min(low, running)
    rows.insert(0, dict(ts=None, type="init", rank=0, id=0, net=-low, down=0))
    running = 0
    for r in rows:
        running += r["net"]
        r["bal"] = running
    ahead = None
    for r in reversed(rows):
        if r["type"] == "tare" or (r["type"] == "ext" and r["down"] > 0):
            ahead = r["bal"] if ahead is None else min(ahead, r["bal"])
            r["ahead"] = ahead
    before = 0
    for r in rows:
        if r["type"] == "tare":
            r["net"], before = before - r["ahead"], r["ahead"]
    running, out = 0, []
    for r in rows:
        running += r["net"]
        out.append((r["type"], r["id"], r["net"], max(running, 0)))
    return out


def test_matches_a_walk_per_user(spark):
    rng = random.Random(5)
    flows, buys = [], []
    for i in range(700):
        user = "hot" if rng.random() < 0.34 else f"u{rng.randrange(5)}"
        at = T0 + timedelta(seconds=rng.randrange(0, 6 * 86400))
        if rng.random() < 0.08:
            buys.append((i, at, rng.randrange(100, 900), user))
        else:
            down = 0 if rng.random() < 0.6 else rng.randrange(1, 200)
            flows.append((i, at, at + timedelta(seconds=rng.randrange(0, 9000)), rng.randrange(0, 20), down, user))
    users = sorted({f[-1] for f in flows} | {b[-1] for b in buys})
    result = user_data_balance(
        spark.createDataFrame(
            [(f[0], f[1], f[2], f[5], f[3], f[4], False) for f in flows],
            "flow_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, user_id string, bytes_up long, "
            "bytes_down long, is_local boolean",
        ),
        spark.createDataFrame(
            [(b[0], b[1], b[3], b[2]) for b in buys],
            "txn_id long, ts timestamp_ntz, user_id string, amount_bytes long",
        ),
        spark.createDataFrame([(u,) for u in users], "user_id string"), min_failed=3,
    )
    got = {}
    for r in sorted(result.collect(), key=lambda r: r.position):
        assert r.balance >= 0
        got.setdefault(r.user_id, []).append((r.type, r.event_id, r.net_bytes, r.balance))
    marks = 0
    for user in users:
        expected = _one_user([f[:5] for f in flows if f[-1] == user], [b[:3] for b in buys if b[-1] == user], 3)
        marks += sum(1 for row in expected if row[0] == "tare")
        assert got[user] == expected
    assert marks > 3
