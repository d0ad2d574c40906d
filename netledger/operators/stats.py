"""Shared statistics: distributions, ranks, bins, quantiles, reshaping, rolling means, fills, least squares."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from netledger.operators.scan import prefix_scan
from netledger.session import materialise


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value (and key; no NULL, no NaN): pre-aggregated before the shuffle, whatever the skew."""
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.where(known).groupBy(*keys, value).agg(F.count("*").alias("base_count"))


def in_ranges(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "range") -> DataFrame:
    """Rows dealt to ranges of (keys, value) whose bounds Spark samples, with the number of the range.

    Ranges hold about as many rows each wherever the values lie, so a narrow band of values spreads like a wide one. Written
    once: the number belongs to the partition a row was written from.
    """
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], F.col(value))
    return materialise(dealt.withColumn(name, F.spark_partition_id()), "ranges")


def cumulative_counts(df: DataFrame, value: str, keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """value_counts with `upto`, the rows up to and including the value, and `total`, the rows of the key.

    The counts are written once, in ranges of values; the scan adds what the ranges before hold to the running count inside
    a range. The scan and the totals read that table, and df is evaluated a single time.
    """
    counts = in_ranges(value_counts(df, value, keys), value, keys, "__range")
    running = prefix_scan(
        counts, keys, [value], F.col("__range"), sums={"upto": F.col("base_count")}, reverse=descending
    ).drop("__range")
    if not keys:
        return running.withColumn("total", counts.agg(F.sum("base_count")).scalar())
    return running.join(counts.groupBy(*keys).agg(F.sum("base_count").alias("total")), list(keys))


def cdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their count, share of all rows, and running share."""
    c = cumulative_counts(df, value, keys)
    return c.select(
        *keys, value, "base_count", (F.col("base_count") / F.col("total")).alias("pdf"),
        (F.col("upto") / F.col("total")).alias("cdf"),
    )


def rank_min(df: DataFrame, value: str, name: str = "rank", keys: Sequence[str] = (), descending: bool = False,
             pct: str | None = None) -> DataFrame:
    """Rank by value, ties share the lowest rank (1 = first); pct adds rank / n. NULL values get NULL."""
    c = cumulative_counts(df, value, keys, descending)
    rank = F.col("upto") - F.col("base_count") + 1
    cols = [rank.alias(name)]
    if pct:
        cols.append((rank / F.col("total")).alias(pct))
    return df.join(c.select(*keys, value, *cols), [*keys, value], "left")


def rank_bins(df: DataFrame, rank: str, name: str = "bin", bins: int = 10) -> DataFrame:
    """Equal-width bins over the range of the ranks, right-open, the last one closed; adds the bin's bounds.

    df is written once, as both the range and the rows come from it.
    """
    df = materialise(df, "ranked")
    bounds = df.agg(F.struct(F.min(rank).alias("lo"), F.max(rank).alias("hi"))).scalar()
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    index = F.least(F.floor(F.try_divide(F.col(rank) - F.col("__lo"), width)), F.lit(bins - 1))
    number = F.coalesce(index, F.lit(0)).cast("int")
    ranged = df.withColumn("__b", bounds).withColumns({"__lo": F.col("__b.lo"), "__hi": F.col("__b.hi")})
    return ranged.select(
        *df.columns, number.alias(name), (F.col("__lo") + number * width).alias(f"{name}_lo"),
        (F.col("__lo") + (number + 1) * width).alias(f"{name}_hi"),
    )


def mean_q90_q99_max(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """For groups of bounded size (one value per calendar day): mean, linear 90 % and 99 % quantiles, maximum."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.9)).alias("q90"),
        F.percentile(value, F.lit(0.99)).alias("q99"), F.max(value).alias("max"),
    )


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear quantiles of groups of any size: positions are looked up in running counts of distinct values."""
    c = cumulative_counts(df, value, keys)
    first = F.col("upto") - F.col("base_count")
    v = F.col(value).cast("double")
    aggs = []
    for name, q in quantiles.items():
        place = (F.col("total") - 1) * F.lit(q)
        holds = lambda i: (first <= i) & (i < F.col("upto"))
        lower = F.max(F.when(holds(F.floor(place)), v))
        upper = F.max(F.when(holds(F.ceil(place)), v))
        part = F.max(place - F.floor(place))
        aggs.append((lower + (upper - lower) * part).alias(name))
    return c.groupBy(*keys).agg(*aggs)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def argmax_label(df: DataFrame, keys: Sequence[str], label: str, amount: str, name: str) -> DataFrame:
    """Label with the largest amount per key; ties go to the first label in name order."""
    totals = df.groupBy(*keys, label).agg(F.sum(amount).alias("__amount"))
    best = totals.groupBy(*keys).agg(F.max("__amount").alias("__amount"))
    return totals.join(best, [*keys, "__amount"]).groupBy(*keys).agg(F.min(label).alias(name))


def top_or_other(df: DataFrame, label: str, amount: str, keep: int = 9) -> DataFrame:
    """Keep the labels with the largest totals; the k others become "Other N=k"."""
    totals = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.sum(amount).alias("__total"))
    main = totals.orderBy(F.desc("__total"), label).limit(keep).select(label, F.lit(True).alias("__main"))
    others = totals.agg(F.greatest(F.count("*") - keep, F.lit(0)).cast("string")).scalar()
    # At most `keep` rows, so the broadcast is bounded by a parameter.
    marked = df.join(F.broadcast(main), label, "left").withColumn("__others", others)
    named = F.when(F.col("__main"), F.col(label)).otherwise(F.concat(F.lit("Other N="), F.col("__others")))
    return marked.withColumn(label, named).select(*df.columns)


def others_only(df: DataFrame, label: str, amount: str, keep: int = 9) -> DataFrame:
    totals = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.sum(amount).alias("__total"))
    main = totals.orderBy(F.desc("__total"), label).limit(keep).select(label)
    return df.join(F.broadcast(main), label, "left_anti")


def top_label(df: DataFrame, user: str, amount: str, n: int = 20, name: str = "top_n") -> DataFrame:
    """Per user: "Top n" for the n largest totals (ties by user), "Bottom k" for the other k."""
    totals = df.groupBy(user).agg(F.sum(amount).alias("__total"))
    top = totals.orderBy(F.desc("__total"), user).limit(n).select(user, F.lit(True).alias("__top"))
    rest = totals.agg((F.count("*") - n).cast("string")).scalar()
    bottom = F.concat(F.lit("Bottom "), F.col("__rest"))
    return (
        totals.join(F.broadcast(top), user, "left").withColumn("__rest", rest)
        .select(user, F.when(F.col("__top"), F.lit(f"Top {n}")).otherwise(bottom).alias(name))
    )


def layer_order(df: DataFrame, label: str, directions: dict[str, str]) -> DataFrame:
    """Position of each label by total, smallest first, per direction name -> bytes column.

    One row per label: categories, port names, or at most ten organisations.
    """
    totals = df.groupBy(label).agg(*[F.sum(c).alias(c) for c in directions.values()])
    long = totals.select(
        label,
        F.explode(F.array(*[
            F.struct(F.lit(d).alias("direction"), F.col(c).alias("__bytes")) for d, c in directions.items()
        ])).alias("__e"),
    ).select(label, "__e.*")
    place = Window.partitionBy("direction").orderBy("__bytes", label)
    return long.select(label, "direction", (F.row_number().over(place) - 1).alias("order"))


def densify(df: DataFrame, day: str, first: datetime, last: datetime, keys: Sequence[str], values: Sequence[str],
            outer: bool = False, step_days: int = 1) -> DataFrame:
    """A row for every (day of the range, key) with zeros where df has none; outer keeps df's other days as well.

    The grid is the distinct keys, each with a calendar array exploded: linear in the number of keys.
    """
    dates = F.sequence(F.lit(first.date()), F.lit(last.date()), F.make_dt_interval(days=F.lit(step_days)))
    spine = df.select(*keys).distinct().select(*keys, F.explode(dates).alias(day))
    joined = spine.join(df, [*keys, day], "full" if outer else "left")
    return joined.withColumns({v: F.coalesce(v, F.lit(0)) for v in values})


def rolling_days(df: DataFrame, day: str, value: str, keys: Sequence[str], name: str, days: int = 7) -> DataFrame:
    """Mean over the last `days` calendar days including today; short at the start. One row per day and key."""
    number = F.unix_date(F.col(day))
    spec = Window.partitionBy(*keys).orderBy(number).rangeBetween(-(days - 1), 0)
    return df.withColumn(name, F.avg(value).over(spec))


def rolling_rows(df: DataFrame, order: str, value: str, keys: Sequence[str], name: str, rows: int = 7) -> DataFrame:
    """Mean over the last `rows` rows, NULL until there are that many. One row per day and key."""
    spec = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(spec) == rows, F.avg(value).over(spec)))


def fill_forward(df: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Last known value in day order (calendar-sized frames)."""
    spec = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(spec))


def fill_backward(df: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    spec = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(value, F.first(value, ignorenulls=True).over(spec))


def resample_hours(df: DataFrame, ts: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Sums per hour, with zero rows for empty hours between a key's first and last."""
    hourly = df.groupBy(*keys, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(
        F.sum(value).alias(value)
    )
    span = hourly.groupBy(*keys).agg(F.min("hour").alias("__lo"), F.max("hour").alias("__hi"))
    hours = F.sequence("__lo", "__hi", F.make_dt_interval(hours=F.lit(1)))
    spine = span.select(*keys, F.explode(hours).alias("hour"))
    return spine.join(hourly, [*keys, "hour"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def _beta_fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz), as a fold over the number of its terms."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    first = F.lit(1.0) / safe(F.lit(1.0) - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def turn(state: Column, factor: Column) -> Column:
        d = F.lit(1.0) / safe(F.lit(1.0) + factor * state["d"])
        c = safe(F.lit(1.0) + factor / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    # Even and odd terms are separate steps, so that a step names its state a few times only.
    def step(state: Column, k: Column) -> Column:
        m = F.floor(k / F.lit(2)).cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return turn(state, F.when(k % 2 == 0, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(2), 2 * steps + 1), start, step, lambda state: state["h"])


def two_sided_p(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) for Student's t with the given degrees of freedom, as a column expression; NULL without freedom.

    It is I(df / (df + t^2); df / 2, 1 / 2), the regularised incomplete beta function. Gamma(a + 1/2) / Gamma(a) comes from its
    asymptotic series, reached from small a by recurrence, so that no difference of large logarithms is taken.
    """
    df, square = freedom.cast("double"), t * t
    a, shift = df / 2.0, 24
    high = a + float(shift)
    series = 0.5 * F.ln(high) - 1.0 / (8.0 * high) + 1.0 / (192.0 * F.pow(high, 3)) - 1.0 / (640.0 * F.pow(high, 5))
    down = F.aggregate(
        F.sequence(F.lit(0), F.lit(shift - 1)), F.lit(0.0), lambda acc, j: acc + F.log1p(F.lit(0.5) / (a + j))
    )
    ratio = series - down  # ln(Gamma(a + 1/2) / Gamma(a)): each step down divides by (a + j + 1/2) / (a + j)
    log_x, log_y = -F.log1p(square / df), F.ln(square / (df + square))
    front = F.exp(ratio - 0.5 * F.log(F.lit(3.141592653589793)) + a * log_x + 0.5 * log_y)
    x, y = df / (df + square), square / (df + square)
    steps = (F.lit(200) + F.ceil(6.0 * F.sqrt(df))).cast("int")
    half = F.lit(0.5)
    small = front * _beta_fraction(a, half, x, steps) / a
    large = F.lit(1.0) - front * _beta_fraction(half, a, y, steps) / half
    value = F.when(square == 0, F.lit(1.0)).when(x < (a + 1.0) / (a + 2.5), small).otherwise(large)
    return F.when((df > 0) & t.isNotNull(), value)


def least_squares(df: DataFrame, x: Column, y: Column, label: str) -> DataFrame:
    """One row: n, slope, intercept, R², the t statistic of the slope for y = a + b x and its two-sided P value."""
    points = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).dropna()
    fit = points.agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"),
        F.regr_sxx("y", "x").alias("__sxx"), F.regr_syy("y", "x").alias("__syy"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"),
    )
    residual = F.col("__syy") - F.col("slope") * F.col("slope") * F.col("__sxx")
    error = F.sqrt(F.try_divide(F.try_divide(F.greatest(residual, F.lit(0.0)), F.col("n") - 2), F.col("__sxx")))
    tested = fit.withColumn("t_statistic", F.try_divide(F.col("slope"), error))
    return tested.select(
        F.lit(label).alias("fit"), "n", "slope", "intercept", "r2", "t_statistic",
        two_sided_p(F.col("t_statistic"), F.col("n") - 2).alias("p_value"), "x_min", "x_max",
    )


def prediction_curve(linear: DataFrame, loglog: DataFrame, points: int = 1000) -> DataFrame:
    """Evenly spaced x over the linear fit's range with both fits' predictions, long form."""
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    x = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("i") / F.lit(float(points - 1))
    grid = linear.select("slope", "intercept", "x_min", "x_max", F.explode(steps).alias("i"))
    log_fit = loglog.select(F.struct(F.col("slope").alias("b"), F.col("intercept").alias("a"))).scalar()
    base = grid.withColumn("x", x).withColumn("__log", log_fit)
    both = F.array(
        F.struct(F.lit("linear").alias("fit"), (F.col("intercept") + F.col("slope") * F.col("x")).alias("prediction")),
        F.struct(
            F.lit("loglog").alias("fit"),
            F.exp(F.col("__log.a") + F.col("__log.b") * F.ln(F.col("x"))).alias("prediction"),
        ),
    )
    return base.select("i", "x", F.explode(both).alias("__e")).select("i", "x", "__e.*")


def variation_per_user(df: DataFrame, value: str, user: str = "user_id") -> DataFrame:
    """Mean, sample deviation, count and coefficient of variation; users with one value are dropped."""
    agg = df.groupBy(user).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")
    )
    return agg.where(F.col("count") > 1).withColumn("c_of_v", F.try_divide("std", "mean"))
