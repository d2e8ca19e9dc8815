"""Polygon–polygon operators on edge tables: intersects, overlap area, weighted population."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoevents.operators import spatial as S
from geoevents.operators.edge_tree import borders_within, overlap_areas


def zones_intersect_zones(
    left: DataFrame, right: DataFrame, cell_size: float = S.CELL_DEG, *, left_index: DataFrame | None = None,
    right_index: DataFrame | None = None,
) -> DataFrame:
    """``(a_zone_id, b_zone_id)`` of zones sharing a point.

    Either two edges meet, or one zone lies inside the other (then any one vertex of it does).
    """
    crossing = borders_within(left, right)

    def vertex_of(edges: DataFrame, name: str) -> DataFrame:
        one = edges.groupBy("zone_id", "part").agg(F.min(F.struct("ring", "seq", "x1", "y1")).alias("v"))
        return one.select(F.col("zone_id").alias(name), F.col("v.x1").alias("lon"), F.col("v.y1").alias("lat"))

    def inside(inner: DataFrame, name: str, index: DataFrame, other: str) -> DataFrame:
        hit = S.join_points_to_zones(vertex_of(inner, name), index, how="inner", cell_size=cell_size)
        return hit.withColumnRenamed("zone_id", other).select("a_zone_id", "b_zone_id")

    right_index = right_index if right_index is not None else S.zone_index(right, cell_size=cell_size)
    left_index = left_index if left_index is not None else S.zone_index(left, cell_size=cell_size)
    return crossing.union(inside(left, "a_zone_id", right_index, "b_zone_id")).union(
        inside(right, "b_zone_id", left_index, "a_zone_id")).distinct()


def zone_areas(edges: DataFrame) -> DataFrame:
    """Planar area per zone, holes subtracted."""
    ring = edges.groupBy("zone_id", "part", "ring").agg(
        (F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("a"))
    role = F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))
    return ring.groupBy("zone_id").agg(F.sum(role).alias("area"))


def zone_overlap_area(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(a_zone_id, b_zone_id, area)`` for zones that overlap, in the square of the edge unit."""
    return overlap_areas(left, right)


def weighted_population(areas: DataFrame, neighbourhoods: DataFrame, population: DataFrame) -> DataFrame:
    """Residents inside each area: population times the share of the neighbourhood inside.
    ``population(zone_id, population)``; unknown (NULL) population and zero area are skipped."""
    return population_of(zone_overlap_area(areas, neighbourhoods), neighbourhoods, population)


def population_of(shares: DataFrame, neighbourhoods: DataFrame, population: DataFrame) -> DataFrame:
    """As ``weighted_population``, from overlap areas ``(a_zone_id, b_zone_id, area)``."""
    sized = zone_areas(neighbourhoods).filter(F.col("area") > 0).select(
        F.col("zone_id").alias("b_zone_id"), F.col("area").alias("whole"))
    known = population.filter(F.col("population").isNotNull()).select(
        F.col("zone_id").alias("b_zone_id"), "population")
    part = shares.join(sized, "b_zone_id").join(known, "b_zone_id")
    return part.groupBy(F.col("a_zone_id").alias("zone_id")).agg(
        F.sum(F.col("population") * F.col("area") / F.col("whole")).alias("population"))


def zone_context(pairs: DataFrame, census: DataFrame, by: str = "a_zone_id", member: str = "b_zone_id") -> DataFrame:
    """Per area: sorted neighbourhood names, their whole population, modal admin region.
    ``census(zone_id, name, population, region)``."""
    joined = pairs.select(by, member).distinct().join(census.withColumnRenamed("zone_id", member), member)
    return joined.groupBy(by).agg(
        F.sort_array(F.collect_set("name")).alias("members"), F.sum(F.coalesce("population", F.lit(0))).alias("population"),
        F.coalesce(F.mode("region", True), F.lit("—")).alias("region"))


def surroundings_enriched(
    pairs: DataFrame, census: DataFrame, tips: DataFrame, calls: DataFrame, member: str = "b_zone_id",
) -> DataFrame:
    """Every surrounding neighbourhood with population, tips and calls, missing as 0."""
    rename = lambda df: df.withColumnRenamed("zone_id", member)
    out = pairs.join(rename(census), member, "left").join(rename(tips), member, "left").join(rename(calls), member, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("population", "tips", "calls")})


def territory_relation(
    areas: DataFrame, territories: DataFrame, factions: DataFrame, *, near_m: float = 500.0, cell_size: float = 500.0,
) -> DataFrame:
    """``(zone_id, territory_id, faction, relation)``: intersecting, or only with borders within ``near_m``.
    Edges are in metres."""
    hit = zones_intersect_zones(areas, territories, cell_size)
    near = borders_within(areas, territories, near_m)
    near = near.join(hit, ["a_zone_id", "b_zone_id"], "left_anti")
    both = hit.withColumn("relation", F.lit("intersecting")).unionByName(near.withColumn("relation", F.lit("nearby")))
    return both.select(F.col("a_zone_id").alias("zone_id"), F.col("b_zone_id").alias("territory_id"), "relation").join(
        factions, "territory_id", "left")


def territory_summary(relation: DataFrame) -> DataFrame:
    """One text per area: who rules it and how many territories lie near."""
    per = relation.groupBy("zone_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("relation") == "intersecting", F.col("faction")))), ", ").alias("ruling"),
        F.count_if(F.col("relation") == "nearby").alias("n_nearby"),
        F.sort_array(F.collect_set("faction")).alias("factions"))
    near = F.concat(F.col("n_nearby").cast("string"), F.lit(" território(s) sob influência nas proximidades"))
    text = F.concat_ws(
        "; ", F.when(F.col("ruling") != "", F.concat(F.lit("sob domínio direto de "), F.col("ruling"))),
        F.when(F.col("n_nearby") > 0, near))
    return per.withColumn("summary", text)
