"""Fund tracing against the sequential ledger walk it replaces."""

import random
from datetime import datetime, timedelta

import pytest

from netledger.operators.taint import untainted_transactions

START, END = datetime(2024, 1, 2), datetime(2024, 1, 5)
SCHEMA = "txn_id long, ts timestamp_ntz, kind string, user_id string, dest_user_id string, amount_idr long"


def _walk(rows):
    dirty, clean = {}, []
    for txn, ts, kind, user, dest, amount in sorted(rows, key=lambda r: (r[1], r[0])):
        if not START <= ts < END:
            clean.append(txn)
        elif user is not None and user == dest:
            dirty[user] = dirty.get(user, 0) + amount
        elif kind in ("user_transfer", "admin_transfer", "purchase") and dirty.get(user, 0) > 0:
            dirty[user] = max(dirty[user] - amount, 0)
            if kind != "purchase":
                dirty[dest] = dirty.get(dest, 0) + amount
        else:
            clean.append(txn)
    return set(clean)


def _run(spark, rows):
    return {r.txn_id for r in untainted_transactions(spark.createDataFrame(rows, SCHEMA), START, END).collect()}


def test_full_amount_passes_on(spark):
    at = lambda h: START + timedelta(hours=h)
    rows = [
        (1, at(1), "user_transfer", "a", "a", 10),
        (2, at(2), "user_transfer", "a", "b", 100),   # only 10 were dirty, yet b gets 100 dirty
        (3, at(3), "user_transfer", "a", "c", 5),     # a is clean again
        (4, at(4), "purchase", "b", None, 60),
        (5, at(5), "purchase", "b", None, 60),
        (6, at(6), "purchase", "b", None, 60),        # spent
        (7, at(-2), "user_transfer", "a", "a", 10),   # before the window
        (8, at(7), "admin_topup", None, "a", 10),
    ]
    assert _run(spark, rows) == {3, 6, 7, 8} == _walk(rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_ledger(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        kind = rng.choice(["user_transfer", "user_transfer", "admin_transfer", "purchase", "admin_topup"])
        person = lambda: "hot" if rng.random() < 0.34 else f"u{rng.randrange(25)}"
        user = None if kind == "admin_topup" else person()
        dest = None if kind == "purchase" else person()
        # A person's transfers to themselves stay rare.
        if user == dest and rng.random() < 0.7:
            dest = "u99"
        rows.append((i, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(0, 5 * 86400)), kind, user, dest,
                     rng.randrange(0, 100)))
    expected = _walk(rows)
    assert 0 < len(rows) - len(expected) < len(rows)
    assert _run(spark, rows) == expected
