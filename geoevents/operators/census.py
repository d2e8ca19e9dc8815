"""Census metrics of neighbourhoods, regions and the city."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoevents.functions import geo as G
from geoevents.functions import text as X
from geoevents.sources.polygons import zone_bounds


def geometry_stats(edges: DataFrame) -> DataFrame:
    """Area in km² (equirectangular around the middle latitude, holes subtracted) and the
    centre of the bounding box, from degree edges."""
    box = zone_bounds(edges)
    ring = edges.groupBy("zone_id", "part", "ring").agg(
        F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))).alias("twice"))
    role = F.when(F.col("ring") == 0, F.col("twice")).otherwise(-F.col("twice"))
    flat = ring.groupBy("zone_id").agg((F.sum(role) / 2).alias("deg2"))
    rad = math.pi / 180.0
    mid_lat = (F.col("miny") + F.col("maxy")) / 2
    # both axes scale linearly, so the projected area is the degree area times the scales
    km2 = F.col("deg2") * F.lit((G.SPHERE_M * rad) ** 2 / 1e6) * F.cos(mid_lat * F.lit(rad))
    return flat.join(box, "zone_id").select(
        "zone_id", km2.alias("area_km2"), ((F.col("minx") + F.col("maxx")) / 2).alias("lon"), mid_lat.alias("lat"))


def _pct_change(now: Column, before: Column) -> Column:
    return F.when(before > 0, G.round_half_up((now - before) / before * 100, 1)).otherwise(F.lit(0.0))


def census_metrics(census: DataFrame, edges: DataFrame) -> DataFrame:
    """Change, people per dwelling, area, density and centroid per neighbourhood.
    ``census(zone_id, name, region, pop_2022, pop_2010, dwellings)``."""
    df = census.join(geometry_stats(edges), "zone_id")
    now, before, homes = (F.coalesce(c, F.lit(0)) for c in ("pop_2022", "pop_2010", "dwellings"))
    return df.withColumns({"pop_2022": now, "pop_2010": before, "dwellings": homes}).withColumns({
        "change_abs": F.col("pop_2022") - F.col("pop_2010"),
        "change_pct": _pct_change(F.col("pop_2022"), F.col("pop_2010")),
        "people_per_dwelling": F.when(F.col("dwellings") > 0, G.round_half_up(F.col("pop_2022") / F.col("dwellings"), 2)).otherwise(F.lit(0.0)),
        "density": F.when(F.col("area_km2") > 0, G.round_half_up(F.col("pop_2022") / F.col("area_km2"))).otherwise(F.lit(0.0)),
        "area_km2": G.round_half_up(F.col("area_km2"), 2),
    })


def census_by_name(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Records of the given neighbourhoods, accent- and case-insensitive."""
    wanted = metrics.sparkSession.createDataFrame([(n,) for n in names], "wanted string")
    keys = wanted.select(X.norm_street(F.col("wanted")).alias("_k")).distinct()
    keyed = metrics.withColumn("_k", X.norm_street(F.col("name")))
    return keyed.join(F.broadcast(keys), "_k", "left_semi").drop("_k")


def region_members(metrics: DataFrame) -> DataFrame:
    """Members of every region, one row each, placed by population."""
    order = Window.partitionBy("region_key").orderBy(F.desc("pop_2022"), "name")
    keyed = metrics.select(X.norm_street(F.col("region")).alias("region_key"), "name", "pop_2022", "density", "change_pct")
    return keyed.withColumn("place", F.row_number().over(order))


def region_aggregate(metrics: DataFrame) -> DataFrame:
    """Members, population, growth, mean positive density and members by population; one row each in ``region_members``."""
    members = F.sort_array(F.collect_list(F.struct((-F.col("pop_2022")).alias("o"), "name", "pop_2022", "density", "change_pct")))
    per = metrics.groupBy(X.norm_street(F.col("region")).alias("region_key")).agg(
        F.min("region").alias("region"), F.count(F.lit(1)).alias("n_members"),
        F.sum("pop_2022").alias("pop_2022"), F.sum("pop_2010").alias("pop_2010"),
        F.coalesce(G.round_half_up(F.avg(F.when(F.col("density") > 0, F.col("density")))), F.lit(0.0)).alias("mean_density"),
        F.transform(members, lambda m: F.struct(*[m[c].alias(c) for c in ("name", "pop_2022", "density", "change_pct")])).alias("members"))
    return per.withColumn("change_pct", _pct_change(F.col("pop_2022"), F.col("pop_2010")))


#: Bins of one step of a selection, and how many values are sorted at its end.
_BINS, _FEW = 1024, 10_000


def value_at(values: DataFrame, column: str, place: int) -> float | None:
    """The value at a place (from 1) of the sorted column, NULLs and NaN left out; None beyond the last.

    Selection by histograms: counts per bin between the least and the largest value tell the bin that holds the place, and the next
    step looks into that bin only, until it holds few values or one. Rows are counted where they lie and never sorted as a whole.
    """
    rows = values.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    while True:
        ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        if not 1 <= place <= ends.n:
            return None
        if ends.lo == ends.hi:
            return ends.lo
        if ends.n <= _FEW:
            return rows.orderBy("v").limit(place).agg(F.max("v")).first()[0]
        bin_of = F.least(F.lit(_BINS - 1), F.floor((F.col("v") / 2 - ends.lo / 2) / (ends.hi / 2 - ends.lo / 2) * _BINS))
        for k, n in sorted((r.b, r.n) for r in rows.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if place <= n:
                break
            place -= n
        rows = rows.filter(bin_of == k)


def city_baseline(metrics: DataFrame) -> DataFrame:
    """City totals, growth and the upper-middle density (one value per neighbourhood)."""
    dense = metrics.filter(F.col("density") > 0)
    middle = value_at(dense, "density", dense.count() // 2 + 1)
    return metrics.agg(
        F.count(F.lit(1)).alias("n_members"), F.sum("pop_2022").alias("pop_2022"), F.sum("pop_2010").alias("pop_2010")
    ).withColumns({"change_pct": _pct_change(F.col("pop_2022"), F.col("pop_2010")), "median_density": F.lit(0.0 if middle is None else middle)})


def surroundings_summary(pairs: DataFrame, metrics: DataFrame, by: str = "a_zone_id", member: str = "b_zone_id") -> DataFrame:
    """Population, growth and mean density of each area's neighbourhoods."""
    joined = pairs.join(metrics.withColumnRenamed("zone_id", member), member)
    per = joined.groupBy(by).agg(
        F.sum("pop_2022").alias("pop_2022"), F.sum("pop_2010").alias("pop_2010"),
        G.round_half_up(F.avg("density")).alias("mean_density"))
    growth = F.when(F.col("pop_2010") > 0, (F.col("pop_2022") - F.col("pop_2010")) / F.col("pop_2010") * 100)
    return per.withColumn("change_pct", F.coalesce(growth, F.lit(0.0)))
