"""Writers of the result documents. Every sink is a plain distributed write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sink_json(df: DataFrame, path: str, *, run_id: str | None = None) -> None:
    """JSON documents, one line each; NULL fields are written so NULL stays apart from []."""
    out = df if run_id is None else df.withColumn("run_id", F.lit(run_id))
    writer = out.write.mode("overwrite").option("ignoreNullFields", "false")
    if run_id is not None:
        writer = writer.partitionBy("run_id").option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def sink_area_documents(documents: DataFrame, path: str, *, run_id: str | None = None) -> None:
    sink_json(documents, path, run_id=run_id)


def sink_city_context(rings: DataFrame, path: str) -> None:
    sink_json(rings, path)


def sink_context_parts(parts: dict[str, DataFrame], path: str) -> None:
    """Every part of the city context in a folder of its own name."""
    for name, part in parts.items():
        sink_json(part, f"{path}/{name}")


def displacement_summary(rings: DataFrame) -> DataFrame:
    """The compact projection without geometry or points."""
    keep = ["zone_id", "label", "confidence", "area_yoy_pct", "ring_yoy_pct", "year_prev", "year_curr"]
    return rings.select(*[c for c in keep if c in rings.columns])


def sink_displacement_summary(rings: DataFrame, path: str) -> None:
    sink_json(displacement_summary(rings), path)


def sink_score_report(scores: DataFrame, path: str) -> None:
    sink_json(scores, path)


def sink_fleet_plan(plan: DataFrame, path: str) -> None:
    sink_json(plan, path)


def ring_coordinates(edges: DataFrame) -> DataFrame:
    """Nested polygon coordinates per zone from the edge table (rings closed)."""
    ring = edges.groupBy("zone_id", "part", "ring").agg(
        F.sort_array(F.collect_list(F.struct("seq", "x1", "y1"))).alias("pts")
    )
    xy = F.transform("pts", lambda p: F.array(p["x1"], p["y1"]))
    ring = ring.select("zone_id", "part", "ring", F.concat(xy, F.slice(xy, 1, 1)).alias("xy"))
    part = ring.groupBy("zone_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("ring", "xy"))).alias("rings")
    )
    part = part.select("zone_id", "part", F.transform("rings", lambda r: r["xy"]).alias("rings"))
    return part.groupBy("zone_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("part", "rings"))), lambda p: p["rings"])
        .alias("coordinates")
    )


def export_zone_metrics_geojson(metrics: DataFrame, edges: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature text per zone, with the given metrics as properties."""
    geometry: Column = F.struct(
        F.lit("MultiPolygon").alias("type"), F.col("coordinates")
    )
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
        geometry.alias("geometry"),
    )
    return metrics.join(ring_coordinates(edges), "zone_id").select(
        "zone_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature")
    )
