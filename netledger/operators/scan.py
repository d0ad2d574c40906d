"""Ordered scans that never put one key's whole history into one task.

A plain window over (key) sorts every row of a key in one task, so one hot key (or a global order without a key) decides
the run time. Here every ordered scan runs on two levels. The order column is cut into buckets (an hour, a minute, a
value range); a window over (key, bucket) scans inside the bucket, and one summary row per (key, bucket) carries the
state across buckets. The summaries are aggregated map-side, their number is bounded by the calendar rather than by
the data, and only they pass through a window over the bare key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from netledger.functions.timebins import as_col

_BUCKET = "__bucket"


def time_bucket(ts: Column | str, unit: str = "hour") -> Column:
    return F.date_trunc(unit, as_col(ts))


def _ordered(order: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    inclusive: bool = True,
    reverse: bool = False,
    coarser: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add running sums, maxima, minima and last-non-null values per key in the given total order, and values of the next row.

    keys and order[0] must be non-null (handle such rows first); bucket must be a non-decreasing function of order[0]. With
    inclusive=False a row sees only the rows before it. With reverse=True the scan runs from the end. For very fine
    buckets, coarser maps a bucket to a wider one: the summaries are then scanned on two levels as well.
    """
    sums, maxes, mins, lasts, nexts = (dict(x or {}) for x in (sums, maxes, mins, lasts, nexts))
    # Inputs get names once so that the per-row and the per-bucket branch read the same columns.
    inputs = {f"__in_{name}": expr for group in (sums, maxes, mins, lasts, nexts) for name, expr in group.items()}
    rows = df.withColumns({_BUCKET: bucket, **inputs})
    frame_end = Window.currentRow if inclusive else -1
    local = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*_ordered(order, reverse))
        .rowsBetween(Window.unboundedPreceding, frame_end)
    )
    position = F.struct(*[F.col(c) for c in order])
    local_cols, bucket_aggs, combined = {}, [], {}

    def add(name: str, running: Column, agg: Column, merge) -> None:
        local_cols[f"__loc_{name}"] = running
        bucket_aggs.append(agg.alias(f"__agg_{name}"))
        combined[name] = merge(F.col(f"__car_{name}"), F.col(f"__loc_{name}"))

    for name in sums:
        x = F.col(f"__in_{name}")
        add(name, F.sum(x).over(local), F.sum(x),
            lambda carry, loc: F.coalesce(carry, F.lit(0)) + F.coalesce(loc, F.lit(0)))
    for name in maxes:
        x = F.col(f"__in_{name}")
        add(name, F.max(x).over(local), F.max(x), F.greatest)
    for name in mins:
        x = F.col(f"__in_{name}")
        add(name, F.min(x).over(local), F.min(x), F.least)
    for name in lasts:
        x = F.col(f"__in_{name}")
        ranked = F.when(x.isNotNull(), position)
        newest = F.min_by(x, ranked) if reverse else F.max_by(x, ranked)
        add(name, F.last(x, ignorenulls=True).over(local), newest, lambda carry, loc: F.coalesce(loc, carry))

    for name in nexts:
        x, ahead = F.col(f"__in_{name}"), Window.partitionBy(*keys, _BUCKET).orderBy(*_ordered(order, reverse))
        # Wrapped, so that the last row of a bucket is told from a row whose next value is null.
        local_cols[f"__loc_{name}"] = F.lead(F.struct(x.alias("v"))).over(ahead)
        bucket_aggs.append((F.max_by if reverse else F.min_by)(F.struct(x.alias("v")), position).alias(f"__agg_{name}"))
        combined[name] = F.coalesce(F.col(f"__loc_{name}"), F.col(f"__car_{name}"))["v"]

    summary = rows.groupBy(*keys, _BUCKET).agg(*bucket_aggs)
    carry = _carry(summary, keys, reverse, coarser, sums, maxes, mins, lasts, nexts)
    scanned = rows.withColumns(local_cols).join(carry, [*keys, _BUCKET], "inner")
    return scanned.select(*df.columns, *[expr.alias(name) for name, expr in combined.items()])


def _carry(summary: DataFrame, keys: Sequence[str], reverse: bool, coarser, sums, maxes, mins, lasts, nexts) -> DataFrame:
    """State that each bucket starts with: the combination of all earlier buckets of the key."""
    source = lambda names: {f"__car_{n}": F.col(f"__agg_{n}") for n in names}
    if coarser is not None:
        outer = summary.withColumnRenamed(_BUCKET, "__fine")
        scanned = prefix_scan(
            outer, keys, ["__fine"], coarser(F.col("__fine")), sums=source(sums), maxes=source(maxes),
            mins=source(mins), lasts=source(lasts), nexts=source(nexts), inclusive=False, reverse=reverse,
        ).withColumnRenamed("__fine", _BUCKET)
    else:
        across = (
            Window.partitionBy(*keys).orderBy(*_ordered([_BUCKET], reverse))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        scanned = summary.withColumns({
            **{n: F.sum(c).over(across) for n, c in source(sums).items()},
            **{n: F.max(c).over(across) for n, c in source(maxes).items()},
            **{n: F.min(c).over(across) for n, c in source(mins).items()},
            **{n: F.last(c, ignorenulls=True).over(across) for n, c in source(lasts).items()},
            **{n: F.lead(c).over(Window.partitionBy(*keys).orderBy(*_ordered([_BUCKET], reverse))) for n, c in source(nexts).items()},
        })
    return scanned.select(*keys, _BUCKET, *[f"__car_{n}" for n in (*sums, *maxes, *mins, *lasts, *nexts)])


def running_minimum_of_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, delta: Column, name: str = "minimum"
) -> DataFrame:
    """Lowest value that each key's running sum reaches (one row per key), in a single pass without a join back."""
    rows = df.withColumns({_BUCKET: bucket, "__delta": delta})
    local = (
        Window.partitionBy(*keys, _BUCKET).orderBy(*_ordered(order, False))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = (
        Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    per_bucket = (
        rows.withColumn("__run", F.sum("__delta").over(local))
        .groupBy(*keys, _BUCKET)
        .agg(F.sum("__delta").alias("__total"), F.min("__run").alias("__low"))
        .withColumn("__carry", F.coalesce(F.sum("__total").over(across), F.lit(0)))
    )
    return per_bucket.groupBy(*keys).agg(F.min(F.col("__carry") + F.col("__low")).alias(name))


def floored_balance(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, delta: Column,
    before: str = "balance_before",
) -> DataFrame:
    """Balance just before each row for an account that starts at zero and is cut off at zero after every row.

    The cut-off needs no sequential state: with S the plain running sum, the floored balance is S minus the lowest
    value S has reached so far (if negative). Both S and its running minimum combine across buckets.
    """
    rows = df.withColumns({_BUCKET: bucket, "__delta": delta})
    spec = Window.partitionBy(*keys, _BUCKET).orderBy(*_ordered(order, False))
    upto_now = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = spec.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__run", F.sum("__delta").over(upto_now)).withColumn("__low", F.min("__run").over(earlier))
    carry = (
        local.groupBy(*keys, _BUCKET)
        .agg(F.sum("__delta").alias("__total"), F.min("__run").alias("__bucket_low"))
        .withColumn("__carry", F.coalesce(F.sum("__total").over(across), F.lit(0)))
        .withColumn("__carry_low", F.min(F.col("__carry") + F.col("__bucket_low")).over(across))
        .select(*keys, _BUCKET, "__carry", "__carry_low")
    )
    run_before = F.col("__carry") + F.col("__run") - F.col("__delta")
    low_before = F.least(F.lit(0), F.col("__carry_low"), F.col("__carry") + F.col("__low"))
    return local.join(carry, [*keys, _BUCKET], "inner").select(*df.columns, (run_before - low_before).alias(before))


def sessions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, starts_new: Column, session: str
) -> DataFrame:
    """Number the sessions of each key: a row where starts_new holds opens the next session."""
    return prefix_scan(
        df, keys, order, bucket, sums={session: F.when(starts_new, F.lit(1)).otherwise(F.lit(0))}
    )


def linked_sessions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, fresh: Callable[[Column, Column], Column],
    session: str, before: str | None = None,
) -> DataFrame:
    """Add session: the order columns of the first row of each row's session. A row opens a session where it has no row
    before it in its key or fresh(previous row, row) holds. before: first row of the previous session, at opening rows.

    Every row goes through one exchange, by (key, bucket). Which row opens a session depends on the row before it, and
    the session on the last opening row: inside a bucket both are windows over the same order. A bucket hands its last
    row and its last opening to the next one; whether its first row opens a session is decided among these summaries.
    The summaries come out of the same exchange (they need the whole last row, so both readers ask for the same columns).
    """
    at = F.struct(*[F.col(c) for c in order])
    rows = df.select(
        *keys, bucket.alias(_BUCKET), at.alias("__at"), F.struct(*[F.col(c) for c in df.columns]).alias("__row")
    )
    for name in (*keys, _BUCKET):  # said here once, or the join would say it for one of the two readers only
        rows = rows.where(F.col(name).isNotNull())
    rows = rows.repartition(*[F.col(k) for k in keys], F.col(_BUCKET))
    spec = Window.partitionBy(*keys, _BUCKET).orderBy("__at")
    upto_now, earlier = (spec.rowsBetween(Window.unboundedPreceding, e) for e in (Window.currentRow, -1))
    opens = F.when(F.col("__last").isNotNull() & fresh(F.col("__last"), F.col("__row")), F.col("__at"))
    local = rows.withColumn("__last", F.lag("__row").over(spec)).withColumn("__opens", opens).withColumns({
        "__open": F.last("__opens", ignorenulls=True).over(upto_now),
        "__open_before": F.last("__opens", ignorenulls=True).over(earlier),
    })
    across = Window.partitionBy(*keys).orderBy(_BUCKET)
    carry = (
        local.groupBy(*keys, _BUCKET).agg(
            F.min("__at").alias("__first_at"), F.min_by("__row", "__at").alias("__first_row"),
            F.max_by("__row", "__at").alias("__last_row"), F.max("__opens").alias("__last_open"),
        )
        .withColumn("__handed", F.lag("__last_row").over(across))
        .withColumn("__first_open", F.when(
            F.col("__handed").isNull() | fresh(F.col("__handed"), F.col("__first_row")), F.col("__first_at")))
        .withColumn("__carried", F.last(F.coalesce("__last_open", "__first_open"), ignorenulls=True).over(
            across.rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, _BUCKET, "__first_open", "__carried")
    )
    joined = local.join(carry, [*keys, _BUCKET])
    out = [F.col(f"__row.{c}").alias(c) for c in df.columns]
    out.append(F.coalesce("__open", "__first_open", "__carried").alias(session))
    if before is not None:
        first = F.col("__last").isNull()
        previous = F.when(first & F.col("__first_open").isNotNull(), F.col("__carried")).when(
            F.col("__opens").isNotNull(), F.coalesce("__open_before", "__first_open", "__carried"))
        out.append(previous.alias(before))
    return joined.select(*out)
