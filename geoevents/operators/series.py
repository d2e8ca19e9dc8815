"""Monthly series: windows of periods, gap filling, trend test, seasonality, year-on-year.

Rows are reduced to (group, month, n) by one partial aggregation; everything after works on
at most ``max_periods`` rows per group.
"""

from __future__ import annotations

import math
from statistics import NormalDist
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from geoevents.functions import fixed_values as V
from geoevents.functions import temporal as D
from geoevents.operators.ranking import top_k_per_group

Z_95 = 1.959963984540054


def monthly_counts(df: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """Existing months only; rows without a date dropped."""
    month = D.month_key(F.col(day)).alias("month")
    return df.filter(F.col(day).isNotNull()).groupBy(*by, month).agg(F.count(F.lit(1)).alias("n"))


def last_k_periods(monthly: DataFrame, by: list[str], k: int = 24) -> DataFrame:
    """The last k existing months of every group."""
    return top_k_per_group(monthly, by, [F.desc("month")], k)


def gap_filled_series(monthly: DataFrame, by: list[str], max_periods: int = 60) -> DataFrame:
    """Every month up to the group's last month with data (at most ``max_periods``), gaps as 0."""
    span = monthly.groupBy(*by).agg(F.min("month").alias("first"), F.max("month").alias("last"))
    start = F.greatest(F.col("first"), F.add_months("last", -(max_periods - 1)))
    calendar = span.select(
        *by, F.explode(F.sequence(start, F.col("last"), F.expr("interval 1 month"))).alias("month")
    )
    filled = calendar.join(monthly, [*by, "month"], "left")
    return filled.withColumn("n", F.coalesce("n", F.lit(0)))


def _series_array(filled: DataFrame, by: list[str]) -> DataFrame:
    """One row per group with its ordered values (a bounded number of months)."""
    return filled.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("month", "n"))), lambda s: s["n"]).alias("v")
    )


def mann_kendall(filled: DataFrame, by: list[str], *, with_p: bool = True) -> DataFrame:
    """Trend test per group: S, tie-corrected variance, z, tau, direction, significance.

    Fewer than four values or a constant series are not available. ``significant`` is
    |z| > 1.96 (the same as p < 0.05); the p-value itself comes from a vectorised UDF.
    """
    base = _series_array(filled, by).withColumn("n", F.size("v"))
    zero = F.lit(0).cast("bigint")
    s = F.aggregate(
        F.sequence(F.lit(1), F.col("n")), zero,
        lambda acc, i: acc + F.aggregate(
            F.slice("v", 1, i), zero,
            lambda a, x: a + F.signum((F.element_at("v", i) - x).cast("double")).cast("bigint"),
        ),
    )
    ties = F.aggregate(
        F.array_distinct("v"), zero,
        lambda acc, x: acc + _tie_term(F.size(F.filter("v", lambda y: y == x)).cast("bigint")),
    )
    n = F.col("n").cast("bigint")
    stats = base.withColumns({"s": s, "var_s": (n * (n - 1) * (2 * n + 5) - ties) / 18.0})
    reason = F.when(F.col("n") < 4, "serie_curta").when(F.col("var_s") <= 0, "serie_constante")
    sign = F.signum(F.col("s").cast("double"))
    z = F.when(reason.isNull(), F.try_divide(F.col("s") - sign, F.sqrt(F.greatest("var_s", F.lit(0.0)))))
    direction = (
        F.when(reason.isNotNull() | (F.col("s") == 0), "estavel")
        .when(F.col("s") > 0, "crescente").otherwise("decrescente")
    )
    tau = F.when(reason == "serie_constante", F.lit(0.0)).when(
        reason.isNull(), F.col("s") / (0.5 * n * (n - 1))
    )
    out = stats.select(
        *by, F.col("n").alias("n_months"), reason.isNull().alias("available"), reason.alias("reason"),
        "s", z.alias("z"), tau.alias("tau"), direction.alias("direction"),
        F.coalesce(F.abs(z) > F.lit(Z_95), F.lit(False)).alias("significant"),
    )
    if with_p:
        p = F.when(F.col("reason") == "serie_constante", F.lit(1.0)).otherwise(normal_two_sided(F.col("z")))
        out = out.withColumn("p_value", p)
    return out


def _tie_term(c: Column) -> Column:
    return c * (c - 1) * (2 * c + 5)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2.0)))


# From this shape on the quantile comes from its expansion, whose error is below 1e-9 of it.
_EXPANSION_FROM = 1000.0


def _gamma_quantile(p: float, shape: np.ndarray) -> np.ndarray:
    """Quantile of the gamma distribution (scale 1): bisection for small shapes, expansion for large ones."""
    large = shape >= _EXPANSION_FROM
    out = np.empty_like(shape)
    out[large] = _large_gamma_quantile(p, shape[large])
    out[~large] = _small_gamma_quantile(p, shape[~large])
    return out


def _large_gamma_quantile(p: float, k: np.ndarray) -> np.ndarray:
    """Cornish-Fisher expansion of the gamma quantile in powers of 1/sqrt(shape)."""
    z = NormalDist().inv_cdf(p)
    return (k + z * np.sqrt(k) + (z**2 - 1) / 3 + (z**3 - 7 * z) / (36 * np.sqrt(k))
            - (3 * z**4 + 7 * z**2 - 16) / (810 * k) + (9 * z**5 + 256 * z**3 - 433 * z) / (38880 * k**1.5))


def _small_gamma_quantile(p: float, shape: np.ndarray) -> np.ndarray:
    """Bisection on the regularised series."""
    lo = np.zeros_like(shape)
    hi = shape + 12.0 * np.sqrt(shape) + 40.0
    for _ in range(80):
        mid = (lo + hi) / 2
        below = _gamma_cdf(shape, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def _gamma_cdf(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma by its power series (all terms positive); terms fall
    once their number passes x - shape, so the loop ends by itself."""
    x = np.maximum(x, 1e-300)
    term = np.exp(shape * np.log(x) - x - np.array([math.lgamma(s + 1.0) for s in shape]))
    total, k = term.copy(), 1
    while np.any(term > total * 1e-16):
        term = term * x / (shape + k)
        total += term
        k += 1
    return total


def _poisson_bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        k = pdf["n"].to_numpy(dtype=float)
        lo = np.where(k == 0, 0.0, _gamma_quantile(0.025, np.maximum(k, 1.0))) if len(k) else k
        hi = _gamma_quantile(0.975, k + 1.0) if len(k) else k
        yield pd.DataFrame({"n": pdf["n"], "ci_lo": lo, "ci_hi": hi})


def poisson_ci(monthly: DataFrame, digits: int = 1) -> DataFrame:
    """Exact 95 % interval of every count: computed once per distinct count, then joined."""
    counts = monthly.select(F.col("n").cast("bigint").alias("n")).distinct()
    bounds = counts.mapInPandas(_poisson_bounds, "n bigint, ci_lo double, ci_hi double")
    rounded = bounds.select("n", F.round("ci_lo", digits).alias("ci_lo"), F.round("ci_hi", digits).alias("ci_hi"))
    return monthly.join(rounded, "n")


def join_series_ci(display: DataFrame, ci: DataFrame, by: list[str]) -> DataFrame:
    """The interval band attached to the display rows by month."""
    return display.join(ci.select(*by, "month", "ci_lo", "ci_hi"), [*by, "month"], "left")


def seasonal_decompose_additive(filled: DataFrame, by: list[str], period: int = 12) -> DataFrame:
    """``(by, month, n, trend, seasonal)`` for groups of at least two periods.

    Trend: centred moving average with half weights at both ends (even period); the ends are
    continued on the least-squares line through the nearest ``period`` trend points. Seasonal:
    mean of the detrended values per phase, centred.
    """
    half = period // 2
    order = Window.partitionBy(*by).orderBy("month")
    group = Window.partitionBy(*by)
    t = filled.withColumns({
        "i": F.row_number().over(order) - 1, "len": F.count(F.lit(1)).over(group),
    }).filter(F.col("len") >= 2 * period)
    if period % 2 == 0:
        inner = F.sum("n").over(order.rowsBetween(-half + 1, half - 1))
        ends = F.lag("n", half).over(order) + F.lead("n", half).over(order)
        average = (inner + ends / 2.0) / float(period)
    else:
        average = F.avg("n").over(order.rowsBetween(-half, half))
    inside = (F.col("i") >= half) & (F.col("i") < F.col("len") - half)
    t = t.withColumn("core", F.when(inside, average.cast("double")))
    first = (F.col("i") >= half) & (F.col("i") < half + period)
    last = (F.col("i") >= F.col("len") - half - period) & (F.col("i") < F.col("len") - half)
    fit = lambda fn, cond: fn(F.when(cond, F.col("core")), F.when(cond, F.col("i").cast("double"))).over(group)
    t = t.withColumns({
        "k1": fit(F.regr_slope, first), "c1": fit(F.regr_intercept, first),
        "k2": fit(F.regr_slope, last), "c2": fit(F.regr_intercept, last),
    })
    trend = (
        F.when(F.col("core").isNotNull(), F.col("core"))
        .when(F.col("i") < half, F.col("k1") * F.col("i") + F.col("c1"))
        .otherwise(F.col("k2") * F.col("i") + F.col("c2"))
    )
    t = t.withColumn("trend", trend).withColumn("phase", F.col("i") % period)
    by_phase = Window.partitionBy(*by, "phase")
    t = t.withColumn("phase_mean", F.avg(F.col("n") - F.col("trend")).over(by_phase))
    # centre over phases, each phase counted once
    first_of_phase = F.when(F.col("i") < period, F.col("phase_mean"))
    centred = F.col("phase_mean") - F.avg(first_of_phase).over(group)
    return t.select(*by, "month", "n", "i", "trend", centred.alias("seasonal"))


def seasonal_summary(decomposed: DataFrame, by: list[str]) -> DataFrame:
    """Trend change in percent from first to last month, and the calendar month of the peak."""
    ends = decomposed.groupBy(*by).agg(
        F.min_by("trend", "i").alias("t0"), F.max_by("trend", "i").alias("t1"), F.count(F.lit(1)).alias("n_months")
    )
    by_month = decomposed.groupBy(*by, F.month("month").alias("m")).agg(F.avg("seasonal").alias("s"))
    peak = by_month.groupBy(*by).agg(F.max_by("m", F.struct("s", -F.col("m"))).alias("peak_month"))
    delta = F.when(F.col("t0") != 0, (F.col("t1") - F.col("t0")) / F.abs("t0") * 100)
    return ends.join(peak, by).select(*by, "n_months", delta.alias("trend_delta_pct"), "peak_month")


def trend_report(df: DataFrame, by: list[str], day: str = "day", *, with_p: bool = True) -> DataFrame:
    """Trend test and seasonal summary per group, with the display badge."""
    return trend_of(monthly_counts(df, by, day), by, with_p=with_p)


def trend_of(monthly: DataFrame, by: list[str], *, with_p: bool = True) -> DataFrame:
    """As ``trend_report``, from counts ``(by, month, n)``."""
    filled = gap_filled_series(monthly, by)
    mk = mann_kendall(filled, by, with_p=with_p)
    seasonal = seasonal_summary(seasonal_decompose_additive(filled, by), by).drop("n_months")
    out = mk.join(seasonal, by, "left").withColumn("seasonal_available", F.col("peak_month").isNotNull())
    badge = (
        F.when(F.col("n_months") < 4, F.lit(None).cast("string"))
        .when(F.col("significant") & (F.col("direction") == "decrescente"), "queda real")
        .when(F.col("significant"), "alta real")
        .otherwise("ruído / sem tendência")
    )
    return out.withColumn("badge", badge)


def cumulative_timeline(df: DataFrame, by: list[str], hour: str = "hour") -> DataFrame:
    """For every hour 0..23: new points, points so far, all points, and the end flag."""
    hist = df.filter(F.col(hour).isNotNull()).groupBy(*by, hour).agg(F.count(F.lit(1)).alias("n"))
    spine = hist.select(*by).distinct().withColumn(hour, F.explode(F.sequence(F.lit(0), F.lit(23))))
    full = spine.join(hist, [*by, hour], "left").withColumn("is_new", F.coalesce("n", F.lit(0)))
    group = Window.partitionBy(*by)
    running = group.orderBy(hour).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(
        *by, hour, "is_new", F.sum("is_new").over(running).alias("shown"),
        F.sum("is_new").over(group).alias("total"), (F.col(hour) >= 23).alias("done"),
    )


def year_counts(df: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    dated = df.filter(F.col(day).isNotNull())
    return dated.groupBy(*by, F.year(day).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def yoy_displacement(area_years: DataFrame, ring_years: DataFrame, by: list[str]) -> DataFrame:
    """Did a drop inside the area go to its ring?  Inputs are ``(by, year, n)``.

    Compares the area's last two years; the ring counts 0 where it has none.
    """
    both = area_years.select(*by, "year", F.col("n").alias("a")).join(
        ring_years.select(*by, "year", F.col("n").alias("r")), [*by, "year"], "left"
    )
    latest = Window.partitionBy(*by).orderBy(F.desc("year"))
    two = both.withColumn("k", F.row_number().over(latest)).filter(F.col("k") <= 2)
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.coalesce(F.col(c), F.lit(0))))
    w = two.groupBy(*by).agg(
        F.max(F.when(F.col("k") == 2, F.col("year"))).alias("year_prev"),
        F.max(F.when(F.col("k") == 1, F.col("year"))).alias("year_curr"),
        pick("a", 2).alias("a0"), pick("a", 1).alias("a1"), pick("r", 2).alias("r0"), pick("r", 1).alias("r1"),
    )
    pct = lambda p, c: F.when(F.col(p) > 0, F.round((F.col(c) - F.col(p)) / F.col(p) * 100, 1))
    w = w.withColumns({"area_yoy_pct": pct("a0", "a1"), "ring_yoy_pct": pct("r0", "r1")})
    a, r, dead = F.col("area_yoy_pct"), F.col("ring_yoy_pct"), V.YOY_DEAD_BAND
    known = a.isNotNull() & r.isNotNull()
    label = (
        F.when(~known, "inconclusivo")
        .when((a <= -dead) & (r >= dead), "deslocamento_provavel")
        .when((a <= -dead) & (r <= -dead), "reducao_genuina")
        .when((a >= dead) & (r >= dead), "intensificacao")
        .otherwise("inconclusivo")
    )
    base = F.least("a0", "r0")
    confidence = (
        F.when(~known | (base < 10), "baixa")
        .when((F.abs(a - r) >= 50) & (base >= 30), "alta")
        .otherwise("media")
    )
    return w.withColumns({"label": label, "confidence": confidence}).drop("a0", "a1", "r0", "r1")


def recent_years(area_years: DataFrame, ring_years: DataFrame, by: list[str], years: int = 5) -> DataFrame:
    """Year counts of both sides (union of their years), cut to the last ``years``."""
    both = area_years.select(*by, "year", F.col("n").alias("area_n")).join(
        ring_years.select(*by, "year", F.col("n").alias("ring_n")), [*by, "year"], "full"
    )
    last = F.max("year").over(Window.partitionBy(*by))
    return both.withColumn("_last", last).filter(F.col("year") >= F.col("_last") - (years - 1)).drop("_last")


def union_keys(area_years: DataFrame, ring_years: DataFrame, by: list[str]) -> DataFrame:
    """Years present on either side."""
    return area_years.select(*by, "year").union(ring_years.select(*by, "year")).distinct()
