"""Two-level scans against plain per-key loops, with one key that holds a third of the rows."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netledger.operators.scan import floored_balance, linked_sessions, prefix_scan, running_minimum_of_sum, time_bucket

T0 = datetime(2024, 1, 1)


def _rows(seed, n=600):
    rng = random.Random(seed)
    return [
        (1 if rng.random() < 0.34 else rng.randrange(2, 12), T0 + timedelta(minutes=rng.randrange(0, 4000)), i,
         rng.randrange(-50, 60), rng.choice([None, "a", "b", "c"]))
        for i in range(n)
    ]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long, x long, s string")


def _expected(rows, inclusive, reverse):
    out = {}
    for key in {r[0] for r in rows}:
        total, high, low, last = 0, None, None, None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]), reverse=reverse):
            before = (total, high, low, last)
            total += r[3]
            high = r[3] if high is None else max(high, r[3])
            low = r[3] if low is None else min(low, r[3])
            last = r[4] if r[4] is not None else last
            out[r[2]] = (total, high, low, last) if inclusive else before
    return out


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
@pytest.mark.parametrize("coarser", [None, lambda b: F.date_trunc("day", b)])
def test_prefix_scan(spark, inclusive, reverse, coarser):
    rows = _rows(3)
    scanned = prefix_scan(
        _frame(spark, rows), ["k"], ["ts", "id"], time_bucket("ts", "hour"), sums={"total": F.col("x")},
        maxes={"high": F.col("x")}, mins={"low": F.col("x")}, lasts={"last": F.col("s")}, inclusive=inclusive,
        reverse=reverse, coarser=coarser,
    )
    got = {r.id: (r.total, r.high, r.low, r.last) for r in scanned.collect()}
    assert got == _expected(rows, inclusive, reverse)


def test_scan_without_key_has_no_single_task_over_rows(spark):
    rows = _rows(4)
    scanned = prefix_scan(
        _frame(spark, rows), [], ["ts", "id"], time_bucket("ts", "minute"), sums={"total": F.col("x")},
        coarser=lambda b: F.date_trunc("day", b),
    )
    running, expected = 0, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        running += r[3]
        expected[r[2]] = running
    assert {r.id: r.total for r in scanned.collect()} == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_running_minimum_and_floored_balance(spark, seed):
    rows = _rows(seed)
    df = _frame(spark, rows)
    args = (["k"], ["ts", "id"], time_bucket("ts", "hour"), F.col("x"))
    lows = {r.k: r.minimum for r in running_minimum_of_sum(df, *args).collect()}
    before = {r.id: r.balance_before for r in floored_balance(df, *args).collect()}
    for key in {r[0] for r in rows}:
        running, low, account = 0, None, 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            assert before[r[2]] == account
            account = max(0, account + r[3])
            running += r[3]
            low = running if low is None else min(low, running)
        assert lows[key] == low


@pytest.mark.parametrize("seed", range(3))
def test_linked_sessions_match_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), rng.randrange(400), rng.choice([None, rng.randrange(30)])) for i in range(300)]
    df = spark.createDataFrame([r for r in rows], "id long, key string, at long, reach long").repartition(5)
    fresh = lambda last, row: last["reach"].isNull() | (row["at"] - last["at"] > last["reach"])
    got = {
        r.id: (r.session, r.before)
        for r in linked_sessions(df, ["key"], ["at", "id"], F.floor(F.col("at") / 40), fresh, "session", "before").collect()
    }
    want = {}
    for key in "ab":
        last = opened = None
        for i, _, at, reach in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            opens = last is None or last[1] is None or at - last[0] > last[1]
            before = opened if opens else None
            opened = (at, i) if opens else opened
            want[i] = opened, before
            last = (at, reach)
    assert got == want


def test_next_values_cross_buckets_and_may_be_null(spark):
    rows = [("a", 1, 10), ("a", 2, None), ("a", 50, 30), ("a", 200, 40), ("b", 7, 1)]
    df = spark.createDataFrame(rows, "key string, at long, v long")
    for reverse, want in ((False, [None, 30, 40, None, None]), (True, [None, 10, None, 30, None])):
        out = prefix_scan(df, ["key"], ["at"], F.floor(F.col("at") / 10), nexts={"n": F.col("v")}, sums={"s": F.lit(1)}, reverse=reverse)
        assert [r.n for r in out.orderBy("key", "at").collect()] == want


@pytest.mark.parametrize("name, sources, shuffles", [("consolidated_purchases", 1, 3), ("flow_stitch", 2, 4), ("tare_offsets", 1, 3)])
def test_dependent_states_share_one_exchange(spark, name, sources, shuffles):
    from netledger.verify.workload import QUERIES, Study

    df = QUERIES[name](Study(spark, "/root/testdata/sf0.001"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == sources and "ReusedExchange" in plan
    # (a broadcast of the summaries stands in for one more where they are small)
    assert len(re.findall(r"^[^A-Za-z]*Exchange ", plan, re.M)) <= shuffles + 1
