"""Polygon and line sources: GeoJSON or WKT to edge tables.

A polygon layer is two tables: ``zones(zone_id, zone_order, attributes…)`` and
``edges(zone_id, part, ring, seq, x1, y1, x2, y2)``, one row per directed ring edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

EDGE_SCHEMA = (
    "zone_id string, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"
)


def edges_from_vertices(vertices: DataFrame) -> DataFrame:
    """Edges from ``(zone_id, part, ring, seq, x, y)``; rings are closed when left open."""
    w = Window.partitionBy("zone_id", "part", "ring").orderBy("seq")
    whole = Window.partitionBy("zone_id", "part", "ring").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    nxt = vertices.select(
        "*",
        F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x2"),
        F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y2"),
    )
    return nxt.filter((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2"))).select(
        "zone_id", "part", "ring", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2"
    )


def edges_from_ring_array(df: DataFrame, zone_id: str, ring: str) -> DataFrame:
    """Edges of one-ring zones whose closed ring is an ``array<struct<x,y>>`` column: narrow."""
    pts = F.col(ring)
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(pts) - 1),
        lambda i: F.struct(
            i.cast("int").alias("seq"),
            F.element_at(pts, i)["x"].alias("x1"), F.element_at(pts, i)["y"].alias("y1"),
            F.element_at(pts, i + 1)["x"].alias("x2"), F.element_at(pts, i + 1)["y"].alias("y2"),
        ),
    )
    return df.select(F.col(zone_id).alias("zone_id"), F.explode(pairs).alias("e")).select(
        "zone_id", F.lit(0).alias("part"), F.lit(0).alias("ring"), "e.seq", "e.x1", "e.y1", "e.x2", "e.y2"
    )


def _geojson(spark: SparkSession, path: str, props: T.StructType) -> DataFrame:
    """One row per feature; coordinates stay text, since their depth differs by geometry type."""
    schema = T.StructType([
        T.StructField("features", T.ArrayType(T.StructType([
            T.StructField("properties", props),
            T.StructField("geometry", T.StructType([
                T.StructField("type", T.StringType()),
                T.StructField("coordinates", T.StringType()),
            ])),
        ]))),
    ])
    return (
        spark.read.schema(schema).option("multiLine", "true").json(path)
        .select(F.posexplode("features").alias("zone_order", "f"))
        .select("zone_order", "f.properties.*", F.col("f.geometry.type").alias("geom_type"),
                F.col("f.geometry.coordinates").alias("coords"))
    )


def _polygons(geom_type: Column, coords: Column) -> Column:
    """Coordinates text as parts -> rings -> vertices; other geometry types give NULL."""
    ring = "array<array<double>>"
    single = F.array(F.from_json(coords, f"array<{ring}>"))
    multi = F.from_json(coords, f"array<array<{ring}>>")
    return F.when(geom_type == "Polygon", single).when(geom_type == "MultiPolygon", multi)


def _explode_parts(df: DataFrame, polygons: Column) -> DataFrame:
    """Edge rows straight from nested coordinates, without a shuffle."""
    rings = (
        df.select("zone_id", F.posexplode(polygons).alias("part", "rings"))
        .select("zone_id", "part", F.posexplode("rings").alias("ring", "pts"))
    )
    pts = F.col("pts")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(pts)),
        lambda i: F.struct(
            (i - 1).cast("int").alias("seq"), F.element_at(pts, i).alias("a"),
            F.element_at(pts, F.when(i == F.size(pts), F.lit(1)).otherwise(i + 1)).alias("b"),
        ),
    )
    edges = rings.filter(F.size(pts) >= 3).select("zone_id", "part", "ring", F.explode(steps).alias("e"))
    return edges.select(
        "zone_id", "part", "ring", "e.seq",
        F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"),
        F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"),
    ).filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def scan_zones(
    spark: SparkSession, path: str, id_column: str, props: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(zones, edges) of a polygon GeoJSON; features without a usable polygon are skipped."""
    fields = T.StructType.fromDDL(props or f"{id_column} string")
    raw = _geojson(spark, path, fields).withColumn("zone_id", F.col(id_column).cast("string"))
    raw = raw.withColumn("polygons", _polygons(F.col("geom_type"), F.col("coords")))
    raw = raw.filter(F.col("polygons").isNotNull() & (F.size("polygons") > 0))
    zones = raw.drop("geom_type", "coords", "polygons")
    return zones, _explode_parts(raw, F.col("polygons"))


def scan_zones_or_empty(
    spark: SparkSession, path: str, id_column: str, props: str
) -> tuple[DataFrame, DataFrame]:
    """As ``scan_zones``; a missing file gives empty, typed tables (optional layers)."""
    try:
        return scan_zones(spark, path, id_column, props)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    zone_schema = T.StructType.fromDDL("zone_order int, " + props + ", zone_id string")
    return spark.createDataFrame([], zone_schema), spark.createDataFrame([], EDGE_SCHEMA)


def wkt_edges(df: DataFrame, zone_id: str, wkt: str) -> DataFrame:
    """Edges from POLYGON / MULTIPOLYGON text; unparsable text gives no rows."""
    text = F.upper(F.trim(F.col(wkt)))
    as_json = F.regexp_replace(F.regexp_extract(text, r"\(.*\)", 0), r"(-?[\d.]+(?:E-?\d+)?)\s+(-?[\d.]+(?:E-?\d+)?)", "[$1,$2]")
    as_json = F.translate(as_json, "()", "[]")
    ring = "array<array<double>>"
    parts = (
        F.when(text.startswith("POLYGON"), F.array(F.from_json(as_json, f"array<{ring}>")))
        .when(text.startswith("MULTIPOLYGON"), F.from_json(as_json, f"array<array<{ring}>>"))
    )
    keyed = df.select(F.col(zone_id).cast("string").alias("zone_id"), parts.alias("polygons"))
    return _explode_parts(keyed.filter(F.col("polygons").isNotNull()), F.col("polygons"))


def zone_bounds(edges: DataFrame, by: str = "zone_id") -> DataFrame:
    """Bounding box per zone (every vertex is the start of some edge)."""
    return edges.groupBy(by).agg(
        F.min("x1").alias("minx"), F.min("y1").alias("miny"),
        F.max("x1").alias("maxx"), F.max("y1").alias("maxy"),
    )


def scan_territories(
    spark: SparkSession, path: str, id_column: str, props: str,
    x_range: tuple[float, float] = (-44.0, -43.0), y_range: tuple[float, float] = (-23.2, -22.7),
) -> tuple[DataFrame, DataFrame]:
    """Zones whose lower-left corner lies in the given ranges."""
    zones, edges = scan_zones(spark, path, id_column, props)
    keep = zone_bounds(edges).filter(
        F.col("minx").between(*x_range) & F.col("miny").between(*y_range)
    ).select("zone_id")
    return zones.join(keep, "zone_id", "left_semi"), edges.join(keep, "zone_id", "left_semi")


def scan_streets(spark: SparkSession, path: str, name_column: str, props: str) -> DataFrame:
    """Gazetteer segments ``(street_norm, properties…, line_id, part, seq, x1, y1, x2, y2)``."""
    from geoevents.functions.text import norm_street

    raw = _geojson(spark, path, T.StructType.fromDDL(props))
    pts = "array<array<double>>"
    lines = F.when(F.col("geom_type") == "LineString", F.array(F.from_json("coords", pts))).when(
        F.col("geom_type") == "MultiLineString", F.from_json("coords", f"array<{pts}>")
    )
    keep = [f.name for f in T.StructType.fromDDL(props).fields]
    return line_segments(
        raw.withColumn("street_norm", norm_street(F.col(name_column)))
        .select(F.col("zone_order").alias("line_id"), "street_norm", *keep,
                F.posexplode(lines).alias("part", "pts")),
        "pts",
    )


def line_segments(df: DataFrame, points: str) -> DataFrame:
    """Consecutive vertex pairs of a line column ``array<array<double>>``."""
    pts = F.col(points)
    steps = F.transform(
        F.sequence(F.lit(1), F.size(pts) - 1),
        lambda i: F.struct(
            (i - 1).cast("int").alias("seq"), F.element_at(pts, i).alias("a"),
            F.element_at(pts, i + 1).alias("b"),
        ),
    )
    out = df.filter(F.size(pts) >= 2).withColumn("_e", F.explode(steps))
    return out.select(
        *[c for c in df.columns if c != points], "_e.seq",
        F.col("_e.a")[0].alias("x1"), F.col("_e.a")[1].alias("y1"),
        F.col("_e.b")[0].alias("x2"), F.col("_e.b")[1].alias("y2"),
    )
