"""Sorts, limits, top-k and sampling (§ sorts/limits of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoevents.session import cut


def clamp_limit(n, maximum: int = 50) -> int:
    """Limit argument: missing, non-finite or non-positive means the maximum."""
    if not isinstance(n, (int, float)) or isinstance(n, bool) or n != n or n in (float("inf"), float("-inf")):
        return maximum
    return maximum if n <= 0 else min(int(n), maximum)


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Row number over the whole frame without a one-task window.

    The sorted frame is checkpointed (partitions in order); a row's number is its place in
    its partition plus the sizes of the partitions before it (one small row each).
    """
    placed = cut(df.orderBy(*order)).withColumns({
        "_part": F.spark_partition_id(),
        "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    })
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        name, (F.col("_off") + F.col("_pos") + 1).cast("bigint")
    ).drop("_part", "_pos", "_off")


def sort_desc_by_score(df: DataFrame, score: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(score), tie)


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows of every group. The rank filter lets Spark cut each task's rows to k per
    group before the shuffle, so a hot group never travels whole."""
    out = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    out = out.filter(F.col("_rn") <= k)
    return out.drop("_rn") if rank is None else out.withColumnRenamed("_rn", rank)


def head_points(df: DataFrame, n: int, order: list[Column], by: list[str] | None = None,
                lat: str = "lat", lon: str = "lon") -> DataFrame:
    """First n mappable points (per group when given), in an explicit order."""
    valid = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return top_k_per_group(valid, by, order, n) if by else valid.orderBy(*order).limit(n)


def narratives_first(df: DataFrame, text: str, order: list[Column], n: int = 400,
                     by: list[str] | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with a narrative before those without, capped at n; rows without coordinates are
    dropped only after the cap."""
    first = [F.col(text).isNull().cast("int"), *order]
    capped = top_k_per_group(df, by, first, n) if by else df.orderBy(*first).limit(n)
    return capped.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def stratified_sample(df: DataFrame, stratum: list[str], id_col: str, max_points: int = 600,
                      seed: int = 42) -> DataFrame:
    """At most ``max_points // 3`` rows per stratum, chosen by a seeded hash of the id, so
    the choice is the same on every run."""
    pick = [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]
    return top_k_per_group(df, stratum, pick, max_points // 3)


def sample_cap(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """All rows when there are at most n, else a seeded hash-ordered choice of n."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def type_ranking(df: DataFrame, kind: str, digits: int = 1) -> DataFrame:
    """Count, share of all rows and rank per kind (ties by name)."""
    counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    return counts.withColumns({
        "pct": F.round(F.col("n") * 100.0 / F.sum("n").over(whole), digits),
        "rank": F.row_number().over(Window.orderBy(F.desc("n"), kind)),
    })


def minmax_scale(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(v - min) / (max - min); 1 when all are equal."""
    w = Window.partitionBy(*(by or []))
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(
        "scaled", F.when(hi == lo, F.lit(1.0)).otherwise((F.col(value) - lo) / (hi - lo))
    )


def share_of_total(df: DataFrame, value: str, by: list[str] | None = None, out: str = "share_pct") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*(by or [])))
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(value) * 100.0, total), F.lit(0.0)))
