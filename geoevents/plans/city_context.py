"""City context: rings around the zones and what moved into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoevents.functions import fixed_values as V
from geoevents.functions import geo as G
from geoevents.operators import metrics as M
from geoevents.operators import series as T
from geoevents.operators import spatial as S
from geoevents.session import cut
from geoevents.sources.bindings import metric_edges
from geoevents.sources.sinks import export_zone_metrics_geojson


def ring_and_area(incidents: DataFrame, edges: DataFrame, index: DataFrame, *, buffer_m: float = V.RING_BUFFER_M,
                  cell_size: float = S.CELL_DEG) -> tuple[DataFrame, DataFrame]:
    """(incidents inside a zone, incidents in a ring), both with ``zone_id``."""
    zoned = S.join_points_to_zones(incidents, index, how="left", cell_size=cell_size)
    rings = S.ring_join(G.with_metric(zoned), metric_edges(edges), "id", buffer_m)
    return zoned.filter(F.col("zone_id").isNotNull()), rings.join(incidents, "id")


def displacement(incidents: DataFrame, edges: DataFrame, index: DataFrame, *, day: str = "day", **kw) -> DataFrame:
    """Displacement label per zone, with the incidents in its ring."""
    inside, ring = ring_and_area(incidents, edges, index, **kw)
    labels = T.yoy_displacement(T.year_counts(inside, ["zone_id"], day), T.year_counts(ring, ["zone_id"], day), ["zone_id"])
    counts = ring.groupBy("zone_id").agg(F.count(F.lit(1)).alias("crimes_in_ring"))
    return labels.join(counts, "zone_id", "left").withColumn("crimes_in_ring", F.coalesce("crimes_in_ring", F.lit(0)))


def city_points(incidents: DataFrame, max_points: int | None = None) -> DataFrame:
    """All located incidents, rounded, for the city map; a cap is the caller's choice."""
    from geoevents.operators.ranking import sample_cap

    df = incidents if max_points is None else sample_cap(incidents, "id", max_points)
    return df.select("id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "offence", "hour")


def zone_contexts(incidents: DataFrame, tips: DataFrame, edges: DataFrame, index: DataFrame, *, day: str = "day", years: int = 5, **how) -> DataFrame:
    """One row per zone: what lies in its ring, both year series and whether a drop inside went to the ring.

    ``area_years`` and ``ring_years`` hold (year, n) in order, cut to the last ``years`` of the two together; incidents without a
    day count in the ring and in no year. A zone without two years is inconclusive. Points are counted once, per (zone, side, year);
    everything else comes from those few rows."""
    inside, ring = ring_and_area(incidents, edges, index, **how)
    tip_ring = ring_and_area(tips, edges, index, **how)[1]

    def counted(points: DataFrame, side: str, year) -> DataFrame:
        keyed = points.select("zone_id", F.lit(side).alias("side"), year.cast("int").alias("year"))
        return keyed.groupBy("zone_id", "side", "year").agg(F.count(F.lit(1)).alias("n"))

    counts = cut(counted(inside, "area", F.year(day)).union(counted(ring, "ring", F.year(day))).union(counted(tip_ring, "tips", F.lit(None))))
    of = lambda side: counts.filter((F.col("side") == side) & F.col("year").isNotNull()).select("zone_id", "year", "n")
    labels = T.yoy_displacement(of("area"), of("ring"), ["zone_id"])
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("year", F.col(c).alias("n")))))
    series = T.recent_years(of("area"), of("ring"), ["zone_id"], years).groupBy("zone_id").agg(
        listed("area_n").alias("area_years"), listed("ring_n").alias("ring_years"))
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    totals = counts.groupBy("zone_id").agg(total("ring").alias("crimes_in_ring"), total("tips").alias("tips_in_ring"))
    out = edges.select("zone_id").distinct()
    for part in (totals, series, labels):
        out = out.join(part, "zone_id", "left")
    none = F.array().cast("array<struct<year:int,n:bigint>>")
    return out.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in ("crimes_in_ring", "tips_in_ring")},
        **{c: F.coalesce(c, none) for c in ("area_years", "ring_years")},
        "label": F.coalesce("label", F.lit("inconclusivo")), "confidence": F.coalesce("confidence", F.lit("baixa"))})


def city_context(
    incidents: DataFrame, tips: DataFrame, edges: DataFrame, index: DataFrame, district_series: DataFrame,
    territories: tuple[DataFrame, DataFrame] | None = None, *, buffer_m: float = V.RING_BUFFER_M, max_points: int | None = None, **how,
) -> dict[str, DataFrame]:
    """The city's context by part; every part is a table of its own, since points and territories are as many as the input has.

    ``territories`` is (territories with ``zone_id, faction, name``, their edges). Parts: ``rings``, ``incident_points``,
    ``tip_points``, ``territories`` (GeoJSON features), ``districts`` (violence of the last three years), and ``meta``, one row of totals."""
    points = city_points(incidents, max_points)
    parts = {
        "rings": zone_contexts(incidents, tips, edges, index, buffer_m=buffer_m, **how),
        "incident_points": points,
        "tip_points": tips.select("id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), *[c for c in ("kind",) if c in tips.columns]),
        "districts": M.district_violence(district_series),
    }
    if territories is not None:
        named = territories[0].withColumns({"faction": F.coalesce("faction", F.lit("—")), "name": F.coalesce("name", F.lit(""))})
        parts["territories"] = export_zone_metrics_geojson(named, territories[1], ["faction", "name"])
    rows = {"incident_points": points, "incidents": incidents, **{k: parts[k] for k in ("tip_points", "districts", "territories") if k in parts}}
    counted = None
    for name, part in rows.items():
        one = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        counted = one if counted is None else counted.union(one)
    total = [F.coalesce(F.max(F.when(F.col("part") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}")
             for k in ("incident_points", "incidents", "tip_points", "districts", "territories")]
    parts["meta"] = counted.agg(*total).withColumn("buffer_m", F.lit(float(buffer_m)))
    return parts
