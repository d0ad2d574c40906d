"""Activity, accounts and statistics on hand-written rows."""

import random
from datetime import datetime, timedelta

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from netledger.operators import activity, ledger, stats
from netledger.params import STUDY_2019
from netledger.plans import finance, traffic, users
from netledger.streaming import flows as streaming

T0 = datetime(2024, 1, 1)
_FLOWS = "kind int, flow_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, protocol int, bytes_total long"


def _at(hours):
    return T0 + timedelta(hours=hours)


def test_gap_modes(spark):
    rows = [(0, 1, _at(0), _at(10), 6, 1), (0, 2, _at(1), _at(2), 6, 1), (1, 3, _at(5), _at(6), 6, 1),
            (0, 4, _at(12), _at(13), 6, 1), (0, 5, _at(100), _at(101), 6, 1)]
    df = spark.createDataFrame(rows, _FLOWS)
    gaps = lambda mode: {(r.gap_start, r.gap_end) for r in activity.log_gaps(df, mode).collect()}
    assert gaps("previous") == {(_at(2), _at(5)), (_at(6), _at(12)), (_at(13), _at(100))}
    assert gaps("running_max") == {(_at(10), _at(12)), (_at(13), _at(100))}
    days = activity.full_gap_days(activity.log_gaps(df)).collect()
    assert sorted(r.day for r in days) == [datetime(2024, 1, d).date() for d in (2, 3, 4)]
    assert activity.full_gap_days(activity.log_gaps(df.limit(4))).count() == 0


def test_active_deltas_and_eligibility(spark):
    flows = spark.createDataFrame(
        [(1, _at(24), _at(25), "u"), (2, _at(240), _at(241), "u"), (3, _at(0), _at(1), "x")],
        "flow_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, user_id string")
    txns = spark.createDataFrame(
        [("purchase", "u", _at(24)), ("purchase", "u", _at(250)), ("purchase", "y", _at(0))],
        "kind string, user_id string, ts timestamp_ntz")
    early = spark.createDataFrame([], "user_id string")
    gaps = spark.createDataFrame([(_at(13), _at(100)), (_at(226), _at(300))], "gap_start timestamp_ntz, gap_end timestamp_ntz")
    out = activity.user_active_deltas(flows, txns, early, gaps, T0, _at(24 * 8)).collect()
    assert len(out) == 1
    row = out[0]
    # Full gap days are Jan 2, 3, 4 and Jan 11, 12, 13; the user is seen from Jan 2 00:00 to Jan 11 10:00.
    assert (row.earliest, row.earliest_kind, row.latest, row.latest_kind) == (_at(24), "Purchase", _at(250), "Purchase")
    assert (row.days_online, row.outage_impact_days, row.optimistic_days_online) == (2, 4, 6)
    assert row.days_since_first_active == 7.0
    active = spark.createDataFrame([out[0]])
    assert activity.eligible_users(active).count() == 1
    assert activity.eligible_users(active, strict=True).count() == 0


def test_purchases_sixty_seconds_apart_stay_apart(spark):
    second = lambda s: T0 + timedelta(seconds=s)
    rows = [(i, second(s), "purchase", "u", 10, 1) for i, s in enumerate((0, 59, 118, 178, 179))]
    df = spark.createDataFrame(
        rows, "txn_id long, ts timestamp_ntz, kind string, user_id string, amount_bytes long, amount_idr long")
    got = [(r.ts, r.amount_bytes, r.amount_idr, r.seconds_since_last)
           for r in ledger.consolidate_purchases(df).orderBy("ts").collect()]
    assert got == [(second(0), 30, 3, None), (second(178), 20, 2, 178.0)]


def test_balances_never_go_below_zero(spark):
    rng = random.Random(1)
    rows = [(i, _at(rng.randrange(500)), rng.choice(["purchase", "user_transfer", "admin_topup"]), f"u{rng.randrange(4)}",
             f"u{rng.randrange(4)}", rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(
        [(i, ts, k, None if k == "admin_topup" else u, None if k == "purchase" else d, a) for i, ts, k, u, d, a in rows],
        "txn_id long, ts timestamp_ntz, kind string, user_id string, dest_user_id string, amount_idr long")
    out = ledger.running_balances(df, T0, _at(1000))
    assert out.agg(F.min("balance")).first()[0] == 0
    early = {r.user_id: r for r in ledger.early_balances(df, _at(100)).collect()}
    lifted = {r.user_id for r in out.where("corrected").select("user_id").distinct().collect()}
    assert {u for u, r in early.items() if r.inferred} == lifted


def test_cdf_is_monotone_and_ends_at_one(spark):
    values = [0.0, -1.5, 2.25, 2.25, 1e9, 3.0, -1e9] + [7.0] * 50 + [None]
    out = stats.cdf(spark.createDataFrame([(v,) for v in values], "v double"), "v").orderBy("v").toPandas()
    assert out.cdf.is_monotonic_increasing and out.cdf.iloc[-1] == 1.0
    assert out.base_count.sum() == len(values) - 1


def test_ranks_bins_and_quantiles_match_pandas(spark):
    rng = random.Random(2)
    pdf = pd.DataFrame({"id": range(500), "v": [rng.choice([5.0, 5.0, rng.random() * 100]) for _ in range(500)]})
    df = spark.createDataFrame(pdf)
    ranked = stats.rank_bins(stats.rank_min(df, "v", pct="p"), "rank").orderBy("id").toPandas()
    expected = pdf.v.rank(method="min")
    assert (ranked["rank"] == expected).all() and np.allclose(ranked.p, pdf.v.rank(method="min", pct=True))
    inner = (expected - expected.min()) / ((expected.max() - expected.min()) / 10)
    assert (ranked.bin == np.minimum(np.floor(inner), 9)).all()
    q = stats.exact_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert np.allclose([q.a, q.b, q.c], pdf.v.quantile([0.1, 0.5, 0.99]))


def test_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.random(200)
    y = 3 * x + 1 + rng.normal(0, 0.1, 200)
    fit = stats.least_squares(
        spark.createDataFrame(pd.DataFrame({"a": x, "b": y})), F.col("a"), F.col("b"), "linear").first()
    slope, intercept = np.polyfit(x, y, 1)
    residual = y - slope * x - intercept
    error = np.sqrt((residual ** 2).sum() / 198 / ((x - x.mean()) ** 2).sum())
    assert np.allclose([fit.slope, fit.intercept, fit.t_statistic], [slope, intercept, slope / error])


def test_top_or_other_folds_the_small_labels(spark):
    df = spark.createDataFrame([(f"o{i:02d}", i) for i in range(12)], "org string, b long")
    got = {r.org: r.b for r in stats.top_or_other(df, "org", "b", keep=9).groupBy("org").agg(F.sum("b").alias("b")).collect()}
    assert got == {**{f"o{i:02d}": i for i in range(3, 12)}, "Other N=3": 3}


def test_costs_of_the_study_calendar(spark):
    rows = finance.costs(spark, STUDY_2019).orderBy("day").collect()
    assert rows[0].usd == 9334.0 and str(rows[0].day) == "2019-03-10"
    assert len(rows) == 2 + 23
    monthly = 300 + 1300000 / 14150
    assert abs(rows[1].usd - monthly) < 1e-9


def test_comparison_period_is_symmetric(spark):
    assert (STUDY_2019.lockdown - STUDY_2019.before_start).days == 238


def test_rolling_rows_needs_seven(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "day int, v double")
    got = [r.m for r in stats.rolling_rows(df, "day", "v", [], "m").orderBy("day").collect()]
    assert got == [None] * 6 + [3.0, 4.0, 5.0]


def test_stream_matches_batch(spark, tmp_path):
    line = ('{{"rec_id": {0}, "start_time": "2024-01-0{1}T01:00:00", "end_time": "2024-01-0{1}T01:00:09", '
            '"obfuscated_a": "u", "address_b": "1.1.1.1", "port_a": 1, "port_b": 2, "bytes_a_to_b": {2}, '
            '"bytes_b_to_a": 7, "transport_protocol": 6}}')
    records = [line.format(1, 1, 5), line.format(2, 1, 5), line.format(3, 1, 6), line.format(4, 2, 9), line.format(5, 5, 1)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(records))
    raw = streaming.read_raw_flow_stream(spark, str(tmp_path / "in"))
    query = (
        streaming.daily_user_bytes(streaming.deduplicated_flows(raw, "4 hours")).writeStream.format("memory")
        .queryName("daily_bytes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {str(r.day): r.bytes_up for r in spark.table("daily_bytes").collect()}
    assert got["2024-01-01"] == 11 and got["2024-01-02"] == 9


def test_answers_skip_null_keys(spark):
    df = spark.createDataFrame([("u", 1, 2), (None, 5, 5)], "user_id string, bytes_up long, bytes_down long")
    assert traffic.bytes_per_user(df).count() == 2
    dns = spark.createDataFrame([("a",), ("b",), (None,)], "domain_name string")
    assert users.top_hosts(dns, exclude=("a",)).count() == 1


def test_p_values_match_numerical_integration(spark):
    def tail(t, v):
        x, w = np.polynomial.legendre.leggauss(300)
        density = lambda u: np.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)
                                   - (v + 1) / 2 * np.log1p(u * u / v))
        edges = np.linspace(0, abs(t), max(2, int(abs(t))))
        return 1 - 2 * sum((b - a) / 2 * (w * density((b - a) / 2 * x + (a + b) / 2)).sum() for a, b in zip(edges, edges[1:]))

    cases = [(0.0, 5), (0.1, 1), (1.0, 1), (12.706204736432095, 1), (2.2281388519649385, 10), (-2.0, 98), (0.01, 500), (5.0, 200),
             (2.5, 2), (1.96, 20_000)]
    df = spark.createDataFrame(cases, "t double, v long")
    for r in df.select("t", "v", stats.two_sided_p(F.col("t"), F.col("v")).alias("p")).collect():
        assert abs(r.p - tail(r.t, r.v)) < 1e-9
    # Entries of the usual table: 5 % and 1 %.
    table = spark.createDataFrame([(4.302652729696142, 2), (2.5758293035489004, 10**9), (63.65674116287399, 1)], "t double, v long")
    got = [r.p for r in table.select(stats.two_sided_p(F.col("t"), F.col("v")).alias("p")).collect()]
    assert np.allclose(got, [0.05, 0.01, 0.01], rtol=1e-7, atol=0)
    edge = spark.createDataFrame([(None, 3), (1.0, 0), (1.0, -1)], "t double, v long")
    assert {r.p for r in edge.select(stats.two_sided_p(F.col("t"), F.col("v")).alias("p")).collect()} == {None}


def test_a_narrow_band_of_values_spreads_over_the_ranges(spark):
    df = spark.range(40_000).select((F.lit(1.0) + F.col("id") / 4e7).alias("v"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        sizes = [r["count"] for r in stats.in_ranges(df, "v").groupBy("range").count().collect()]
        out = stats.cdf(df, "v").orderBy("v").toPandas()
    finally:
        spark.conf.set(coalesce, "true")
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    assert np.allclose(out.cdf, np.arange(1, 40_001) / 40_000)


def test_ranks_across_ranges_and_keys(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aab"), rng.choice([None, *range(-20, 21)])) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, v long")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = stats.rank_min(df, "v", keys=["k"], descending=True, pct="p").toPandas()
    finally:
        spark.conf.set(coalesce, "true")
    known = got.dropna(subset=["v"])
    assert (known["rank"] == known.groupby("k").v.rank(method="min", ascending=False)).all()
    assert got[got.v.isna()]["rank"].isna().all() and len(got) == len(rows)
