"""Reconstruction of each user's prepaid data balance from traffic and purchases.

Purchases add data, external traffic uses it, and nothing records the balance itself. Stretches in which a user's
traffic failed right up to a purchase show when the balance was zero; the running balance is pulled to zero there.
Every step is a two-level scan per user, so a user with a very long history is split by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from netledger.functions.timebins import plus_seconds
from netledger.operators.activity import restrict_to
from netledger.operators.scan import prefix_scan, running_minimum_of_sum, time_bucket
from netledger.session import materialise

# Order of rows at the same time: the opening balance, zero marks, traffic, purchases.
_RANK = {"init": 0, "tare": 1, "ext": 2, "local": 2, "purchase": 3}
_ORDER = ["ts", "rank", "event_id"]
_HISTORY = [
    "user_id", "ts", "end_ts", "type", "rank", "event_id", "bytes_up", "bytes_down", "bytes_purchased", "net_bytes",
]


def _bucket(column: str, unit: str):
    return time_bucket(column, unit)


def balance_events(flows: DataFrame, purchases: DataFrame, eligible: DataFrame) -> DataFrame:
    """External traffic and purchases of the eligible users in one typed frame."""
    zero = F.lit(0).cast("bigint")
    traffic = flows.where(~F.col("is_local")).select(
        "user_id", F.col("start_ts").alias("ts"), "end_ts", F.lit("ext").alias("type"),
        F.lit(_RANK["ext"]).alias("rank"), F.col("flow_id").alias("event_id"),
        F.coalesce("bytes_up", zero).alias("bytes_up"), F.coalesce("bytes_down", zero).alias("bytes_down"),
        zero.alias("bytes_purchased"),
    )
    bought = purchases.select(
        "user_id", "ts", F.col("ts").alias("end_ts"), F.lit("purchase").alias("type"),
        F.lit(_RANK["purchase"]).alias("rank"), F.col("txn_id").alias("event_id"),
        zero.alias("bytes_up"), zero.alias("bytes_down"),
        F.coalesce("amount_bytes", zero).alias("bytes_purchased"),
    )
    return restrict_to(traffic.unionByName(bought), eligible)


def balance_selectivity(flows: DataFrame, eligible: DataFrame) -> DataFrame:
    """How many flows the user filter and the external filter keep, in one pass over the flows."""
    marked = flows.join(eligible.select("user_id", F.lit(True).alias("__in")), "user_id", "left")
    kept = F.col("__in").isNotNull()
    return marked.agg(
        F.count("*").alias("flows"), F.count_if(kept).alias("user_flows"),
        F.count_if(kept & ~F.col("is_local")).alias("external_user_flows"),
    )


def last_external_download(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Add last_ext_rx: end of the latest external flow with downlink, looking back in order of END time.

    A flow that began before a purchase may carry data because of it, hence the end time.
    """
    carries = (F.col("type") == "ext") & (F.col("bytes_down") > 0)
    return prefix_scan(
        events, ["user_id"], ["end_ts", "rank", "event_id"], _bucket("end_ts", unit),
        lasts={"last_ext_rx": F.when(carries, F.col("end_ts"))},
    )


def zero_ranges(events: DataFrame, min_failed: int = 50, unit: str = "hour") -> DataFrame:
    """Times between the last download and a purchase in which at least min_failed external flows got no downlink.

    An overlap join is not needed: flows that overlap [a, b] are those that start by b minus those that end before a,
    so two running counts, looked up at a and b, give the number.
    """
    candidates = last_external_download(events, unit).where(
        (F.col("type") == "purchase") & (F.col("last_ext_rx") < F.col("ts"))
    ).select("user_id", "event_id", F.col("last_ext_rx").alias("range_start"), F.col("ts").alias("range_end"))
    candidates = materialise(candidates)
    failed = events.where((F.col("type") == "ext") & (F.col("bytes_down") <= 0))
    none = F.lit(None).cast("bigint").alias("event_id")
    mark = lambda at, order, starts, ends: (
        F.col(at).alias("at"), F.lit(order).alias("order"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends")
    )
    timeline = (
        candidates.select("user_id", "event_id", *mark("range_start", 0, 0, 0))
        .unionByName(failed.select("user_id", none, *mark("ts", 1, 1, 0)))
        .unionByName(failed.select("user_id", none, *mark("end_ts", 1, 0, 1)))
        .unionByName(candidates.select("user_id", "event_id", *mark("range_end", 2, 0, 0)))
    )
    counted = prefix_scan(
        timeline, ["user_id"], ["at", "order", "event_id"], _bucket("at", unit),
        sums={"started": F.col("starts"), "ended": F.col("ends")},
    ).where(F.col("event_id").isNotNull())
    counts = counted.groupBy("user_id", "event_id").agg(
        (F.max(F.when(F.col("order") == 2, F.col("started"))) - F.max(F.when(F.col("order") == 0, F.col("ended"))))
        .alias("failed_flows")
    )
    return candidates.join(counts, ["user_id", "event_id"]).where(F.col("failed_flows") >= min_failed)


def history_with_marks(events: DataFrame, ranges: DataFrame, unit: str = "hour") -> DataFrame:
    """Events with net bytes, a zero mark per range, and an opening row that keeps the balance from going negative."""
    zero = F.lit(0).cast("bigint")
    history = events.withColumn(
        "net_bytes", F.col("bytes_purchased") - F.col("bytes_up") - F.col("bytes_down")
    ).select(*_HISTORY)
    tares = ranges.select(
        "user_id", F.col("range_start").alias("ts"), F.col("range_end").alias("end_ts"), F.lit("tare").alias("type"),
        F.lit(_RANK["tare"]).alias("rank"), "event_id", zero.alias("bytes_up"), zero.alias("bytes_down"),
        zero.alias("bytes_purchased"), zero.alias("net_bytes"),
    )
    lows = running_minimum_of_sum(history, ["user_id"], _ORDER, _bucket("ts", unit), F.col("net_bytes"), "low")
    opening = events.groupBy("user_id").agg(F.min("ts").alias("first_ts")).join(lows, "user_id").select(
        "user_id", plus_seconds("first_ts", -1).alias("ts"), F.lit(None).cast("timestamp_ntz").alias("end_ts"),
        F.lit("init").alias("type"), F.lit(_RANK["init"]).alias("rank"), zero.alias("event_id"),
        zero.alias("bytes_up"), zero.alias("bytes_down"), zero.alias("bytes_purchased"),
        F.greatest(-F.col("low"), zero).alias("net_bytes"),
    )
    return history.unionByName(tares).unionByName(opening)


def tare_offsets(history: DataFrame, unit: str = "hour") -> DataFrame:
    """Correction at each zero mark: the drop of the lowest later balance since the previous mark of the user.

    Three states that build on each other (running balance, lowest low point from here on, that of the mark before) in
    one two-level scan: inside a bucket each is a window over the balance as counted from the bucket's start, which the
    balance brought in only shifts; what crosses buckets is decided among one summary row per user and bucket.
    """
    bucket = "__bucket"
    rows = history.select("user_id", *_ORDER, "type", "net_bytes", _bucket("ts", unit).alias(bucket), (
        (F.col("type") == "tare") | ((F.col("type") == "ext") & (F.col("bytes_down") > 0))).alias("low"))
    # One exchange for both readers: rows with their windows, and the summaries made of them.
    rows = rows.where(F.col("user_id").isNotNull() & F.col(bucket).isNotNull()).repartition("user_id", bucket)
    spec = Window.partitionBy("user_id", bucket).orderBy(*_ORDER)
    upto_now, earlier, onward = (
        spec.rowsBetween(*ends) for ends in (
            (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1),
            (Window.currentRow, Window.unboundedFollowing)))
    mark = F.col("type") == "tare"
    local = rows.withColumn("run", F.sum("net_bytes").over(upto_now)).withColumn(
        "ahead", F.min(F.when(F.col("low"), F.col("run"))).over(onward)
    ).withColumn("prev", F.last(F.when(mark, F.col("ahead")), ignorenulls=True).over(earlier))
    position = F.when(mark, F.struct(*_ORDER))
    across = Window.partitionBy("user_id").orderBy(bucket)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        local.groupBy("user_id", bucket).agg(
            F.sum("net_bytes").alias("total"), F.min(F.when(F.col("low"), F.col("run"))).alias("lowest"),
            F.max_by("ahead", position).alias("last_mark"))
        .withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0)))
        .withColumn("later", F.min(F.col("start") + F.col("lowest")).over(across.rowsBetween(1, Window.unboundedFollowing)))
        .withColumn("mark_low", F.when(
            F.col("last_mark").isNotNull(), F.least(F.col("start") + F.col("last_mark"), F.col("later"))))
        .withColumn("mark_before", F.last("mark_low", ignorenulls=True).over(before))
        .select("user_id", bucket, "start", "later", "mark_before")
    )
    marks = local.where(mark).join(carry, ["user_id", bucket])
    low_ahead = F.least(F.col("start") + F.col("ahead"), F.col("later"))
    previous = F.when(F.col("prev").isNotNull(), F.least(F.col("start") + F.col("prev"), F.col("later"))).otherwise(F.col("mark_before"))
    return marks.select(
        "user_id", "ts", "event_id", low_ahead.alias("low_ahead"),
        (F.coalesce(previous, F.lit(0)) - low_ahead).cast("bigint").alias("tare_bytes"),
    )


def corrected_history(history: DataFrame, tares: DataFrame, unit: str = "hour") -> DataFrame:
    """Balance after each row with the zero marks applied, floored at zero; position orders a user's rows."""
    marks = tares.select("user_id", "ts", "event_id", F.lit("tare").alias("type"), "tare_bytes")
    joined = history.join(marks, ["user_id", "ts", "event_id", "type"], "left").withColumn(
        "net_bytes", F.coalesce("tare_bytes", "net_bytes")
    ).select(*_HISTORY)
    scanned = prefix_scan(
        joined, ["user_id"], _ORDER, _bucket("ts", unit),
        sums={"balance": F.col("net_bytes"), "position": F.lit(1)},
    )
    return scanned.withColumn("balance", F.greatest("balance", F.lit(0)))


def user_data_balance(flows: DataFrame, purchases: DataFrame, eligible: DataFrame, min_failed: int = 50,
                      unit: str = "hour") -> DataFrame:
    """The whole reconstruction. Stages that several later scans read are written once."""
    events = materialise(balance_events(flows, purchases, eligible))
    history = materialise(history_with_marks(events, zero_ranges(events, min_failed, unit), unit))
    return corrected_history(history, tare_offsets(history, unit), unit)


def hourly_ledger(flows: DataFrame, purchases: DataFrame, unit: str = "hour") -> DataFrame:
    """Per user: hourly use (empty hours included) and purchases with the running balance of both."""
    hour = F.date_trunc("hour", "start_ts").cast("timestamp_ntz")
    used = (
        flows.where(F.col("user_id").isNotNull()).groupBy("user_id", hour.alias("ts"))
        .agg((-F.sum(F.col("bytes_up") + F.col("bytes_down"))).alias("bytes"))
    )
    span = used.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spine = span.select("user_id", F.explode(F.sequence("lo", "hi", F.make_dt_interval(hours=F.lit(1)))).alias("ts"))
    spends = spine.join(used, ["user_id", "ts"], "left").select(
        "user_id", "ts", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("event_id"),
        F.lit("spend").alias("type"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"),
    )
    topups = purchases.where(F.col("user_id").isNotNull()).select(
        "user_id", "ts", F.lit(1).alias("rank"), F.col("txn_id").alias("event_id"), F.lit("topup").alias("type"),
        F.col("amount_bytes").alias("bytes"),
    )
    return prefix_scan(
        spends.unionByName(topups), ["user_id"], _ORDER, _bucket("ts", unit), sums={"balance": F.col("bytes")}
    )
