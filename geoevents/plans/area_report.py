"""The area report: every source joined to the zones, measured, scored and assembled.

One grouped pass per source over all zones at once; only per-zone tables meet in the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoevents.functions import geo as G
from geoevents.operators import graph as N
from geoevents.operators import metrics as M
from geoevents.operators import overlap as O
from geoevents.operators import scoring as C
from geoevents.operators import spatial as S
from geoevents.operators.edge_tree import borders_within
from geoevents.session import cut


@dataclass
class Layers:
    """Input tables. Points carry ``id, lat, lon``; see the bindings for the other columns."""

    zones: DataFrame
    edges: DataFrame
    incidents: DataFrame
    tips: DataFrame
    factors: DataFrame
    cameras: DataFrame
    reports: DataFrame
    street_people: DataFrame | None = None
    calls: DataFrame | None = None
    neighbourhoods: DataFrame | None = None   # edges in degrees, with ``census`` rows under the same ids
    census: DataFrame | None = None           # zone_id, name, region, pop_2022
    report_texts: DataFrame | None = None     # zone_id, sections


class AreaReport:
    """Zoned layers and the tables derived from them (all lazy)."""

    def __init__(self, layers: Layers, cell_size: float = S.CELL_DEG, index: DataFrame | None = None):
        """``index`` may give the layers' zone index if it is already written (with the same cell size)."""
        self.layers, self.cell_size = layers, cell_size
        self.index = index if index is not None else S.zone_index(layers.edges, layers.zones, cell_size)
        inside = lambda df: S.join_points_to_zones(df, self.index, how="inner", cell_size=cell_size)
        self.incidents = inside(layers.incidents)
        self.tips = inside(layers.tips)
        self.factors = inside(layers.factors)
        self.street_people = inside(layers.street_people) if layers.street_people is not None else None
        self.calls = inside(layers.calls) if layers.calls is not None else None
        self.camera_points = inside(layers.cameras)
        self.cameras = M.count_by(self.camera_points, ["zone_id"], "cameras")

    def measures(self) -> DataFrame:
        """One row per zone: counts, hour profile, modal districts, report flag."""
        zone = ["zone_id"]
        incidents = M.hour_profile(self.incidents, zone)
        reports = self.layers.reports.select("zone_id", F.lit(True).alias("has_report")).distinct()
        out = self.layers.zones.select("zone_id", "name", "zone_order").join(incidents, zone, "left")
        for part in (
            M.count_by(self.tips, zone, "tips"), M.count_by(self.factors, zone, "factors"), self.cameras, reports,
        ):
            out = out.join(part, zone, "left")
        if self.street_people is not None:
            out = out.join(M.count_by(self.street_people, zone, "street_people"), zone, "left")
        counts = [c for c in ("crimes", "tips", "factors", "cameras", "street_people") if c in out.columns]
        zero = {c: F.coalesce(c, F.lit(0)) for c in counts}
        return out.withColumns({
            **zero, "has_report": F.coalesce("has_report", F.lit(False)),
            "peak_ratio": F.coalesce("peak_ratio", F.lit(0.0)), "night_pct": F.coalesce("night_pct", F.lit(0.0)),
        })

    def scores(self, digits: int = 1) -> DataFrame:
        return C.area_score(self.measures(), digits)

    def streets(self, n: int = 10) -> DataFrame:
        return M.top_streets(self.incidents, ["zone_id"], n)

    def street_layers(self, n: int = 10) -> DataFrame:
        """Top streets with their coincidence layers, zone by zone."""
        key = F.concat_ws("|", "zone_id", F.col("street"))
        unit = lambda df: G.with_metric(df).withColumn("unit", key)
        streets = unit(self.streets(n))
        own, fac, tip = unit(self.incidents), unit(self.factors), unit(self.tips)
        out = streets
        for rows, name in ((fac, "has_factor"), (tip, "has_tip")):
            near = zone_near(streets, own, rows)
            out = out.join(near.withColumnRenamed("is_near", name), "unit", "left")
        flags = {"has_crime": F.col("total") > 0}
        flags.update({c: F.coalesce(c, F.lit(False)) for c in ("has_factor", "has_tip")})
        out = out.withColumns(flags)
        return out.withColumn("layers", sum((F.col(c).cast("int") for c in flags), F.lit(0))).drop("unit", "x", "y")

    def gaps(self, **how) -> DataFrame:
        """Camera gaps zone by zone: a zone's incidents meet its own cameras only, and a zone without cameras has no gaps."""
        by = ["zone_id"]
        return N.top_gaps(N.scored_gaps(G.with_metric(self.incidents), G.with_metric(self.camera_points), by=by, **how), by=by)

    def population(self) -> DataFrame:
        return area_population(self.layers)

    def documents(self) -> DataFrame:
        """One nested document per zone (see ``area_document``)."""
        from geoevents.plans.area_document import documents

        return documents(self.layers, self.index, self.cell_size)


def zone_near(streets: DataFrame, incidents: DataFrame, rows: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """``(unit, is_near)``: rows of the same zone within the radius of the street's incidents,
    or (rows without coordinates) with exactly its name."""
    own = incidents.join(streets.select("unit"), "unit", "left_semi").select("unit", "zone_id", "x", "y").distinct()
    hits = S.within_radius(own, rows, radius_m, on=["zone_id"]).select("unit").distinct()
    return streets.select("unit").join(hits.withColumn("is_near", F.lit(True)), "unit", "left").withColumn(
        "is_near", F.coalesce("is_near", F.lit(False)))


def area_population(layers: Layers) -> DataFrame:
    """Neighbourhoods an area touches, their residents, and the residents inside the area."""
    scaled = lambda e: e.withColumns({c: F.col(c) * 100000.0 for c in ("x1", "y1", "x2", "y2")})
    areas, around = scaled(layers.edges), scaled(layers.neighbourhoods)
    # zones that meet share border points or, one inside the other, some area
    shares = cut(O.zone_overlap_area(areas, around))
    pairs = borders_within(areas, around).union(shares.select("a_zone_id", "b_zone_id")).distinct()
    named = layers.census.select("zone_id", "name", "region", F.col("pop_2022").alias("population"))
    context = O.zone_context(pairs, named).select(
        F.col("a_zone_id").alias("zone_id"), F.col("members").alias("neighbourhoods"),
        F.col("population").alias("population_around"), F.col("region").alias("subprefecture"))
    inside = O.population_of(shares, around, named.select("zone_id", "population"))
    return context.join(inside.withColumnRenamed("population", "population_inside"), "zone_id", "left")
