"""Point–zone and distance joins, all keyed by grid cells so that they plan as hash joins.

Zone index: one row per stretch of ``RUN`` grid cells of a row that meets a zone. It lists, zone by zone, runs of cells that lie
wholly inside, and single cells on the border with only those edges that pass through them and whether the cell's upper right corner is
inside. A point goes right to the cell's side, then up to that corner; each edge met on the way changes sides. So an index entry knows
nothing of what lies beyond its cell, entries grow with the length of the borders, and a point meets one index row: no row multiplication,
no regrouping of points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoevents.functions import geo as G
from geoevents.operators.ranking import global_row_number
from geoevents.session import cut, hashed_join

CELL_DEG = 0.005
#: Cells of a row that share an index row.
RUN = 64


# ------------------------------------------------------------------ zone index
def zone_index(edges: DataFrame, zones: DataFrame | None = None, cell_size: float = CELL_DEG, *,
               materialise: bool = True) -> DataFrame:
    """``(seg, iy, cands)`` with ``cands: array<struct<ord, zone_id, lo, hi, corner, edges>>``: cells lo..hi of row iy.

    ``edges`` is NULL for cells wholly inside. ``zones`` may give ``zone_order``; without it the order is the zone id. The index is
    small and used by many joins, so it is written out once unless ``materialise`` is off.
    """
    c = float(cell_size)
    rim = c * 1e-6  # an edge this near to a cell counts as passing through it: rounding must lose none
    row, zone = ["zone_id", "iy"], F.col("zone_id")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.sequence(G.cell(low - F.lit(rim), c), G.cell(high + F.lit(rim), c))
    # one shuffle, by zone and row of cells; all that follows keeps to it
    banded = edges.select("zone_id", "x1", "y1", "x2", "y2", F.explode(rows).alias("iy")).repartition(*row)
    x_at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(_x_at(y, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    bottom, top = F.col("iy") * F.lit(c), (F.col("iy") + 1) * F.lit(c)
    level = F.col("y1") == F.col("y2")
    xa = F.when(level, F.col("x1")).otherwise(x_at(F.greatest(low, bottom - F.lit(rim))))
    xb = F.when(level, F.col("x2")).otherwise(x_at(F.least(high, top + F.lit(rim))))
    reached = F.sequence(G.cell(F.least(xa, xb) - F.lit(rim), c), G.cell(F.greatest(xa, xb) + F.lit(rim), c))
    touched = banded.withColumn("ix", F.explode(reached)).groupBy(*row, "ix").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    # The corner of a cell is inside if an odd number of edges crosses the line through the corners to its right.
    crossings = banded.filter((F.col("y1") > top) != (F.col("y2") > top)).select(*row, x_at(top).alias("at"), F.lit(1).alias("hit"))
    no_edges = F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    lined = touched.select(*row, _corner(F.col("ix"), F.col("iy"), c)[0].alias("at"), F.lit(0).alias("hit"), "ix", "edges").unionByName(
        crossings.select("*", F.lit(None).cast("bigint").alias("ix"), no_edges.alias("edges")))
    right = Window.partitionBy(*row).orderBy(F.col("at").desc(), "hit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_x, at_y = _corner(F.col("ix"), F.col("iy"), c)
    # for the cell's own edges, whose crossing may be the corner itself, the line decides as it will for points
    told_apart = F.filter("edges", lambda s: _straddles(s["y1"], s["y2"], at_y) & (
        (at_x < _x_at(at_y, s["x1"], s["y1"], s["x2"], s["y2"])) != _left_of(s, at_x, at_y)))
    cornered = lined.withColumn("hits", F.sum("hit").over(right)).filter("hit = 0").withColumns({
        "corner": (F.col("hits") + F.size(told_apart)) % 2 == 1, "next": F.lead("ix").over(Window.partitionBy(*row).orderBy("ix"))})
    border = F.struct(F.col("ix").alias("lo"), F.col("ix").alias("hi"), "corner", "edges")
    inner = F.struct((F.col("ix") + 1).alias("lo"), (F.col("next") - 1).alias("hi"), F.lit(True).alias("corner"), no_edges.alias("edges"))
    runs = F.when(F.col("corner") & (F.col("next") > F.col("ix") + 1), F.array(border, inner)).otherwise(F.array(border))
    parts = cornered.select(*row, F.explode(runs).alias("r"))
    segments = F.sequence(F.floor(F.col("r.lo") / RUN), F.floor(F.col("r.hi") / RUN))
    cut_up = parts.withColumn("seg", F.explode(segments)).select(
        "seg", "iy", "zone_id", F.greatest("r.lo", F.col("seg") * RUN).alias("lo"), F.least("r.hi", F.col("seg") * RUN + (RUN - 1)).alias("hi"),
        F.col("r.corner").alias("corner"), F.col("r.edges").alias("edges"))
    if zones is not None and "zone_order" in zones.columns:
        cut_up = cut_up.join(zones.select("zone_id", F.col("zone_order").cast("bigint").alias("ord")), "zone_id")
    else:
        cut_up = cut_up.withColumn("ord", F.lit(0).cast("bigint"))
    index = cut_up.groupBy("seg", "iy").agg(
        F.sort_array(F.collect_list(F.struct("ord", zone, "lo", "hi", "corner", "edges"))).alias("cands"))
    return cut(index) if materialise else index


def _x_at(y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where an edge that is not level is at height ``y``."""
    return x1 + (y - y1) * (x2 - x1) / (y2 - y1)


def _straddles(a: Column, b: Column, at: Column) -> Column:
    return (a > at) != (b > at)


def _left_of_line(s: Column, x: Column, y: Column) -> Column:
    turn = (s["x2"] - s["x1"]) * (y - s["y1"]) - (x - s["x1"]) * (s["y2"] - s["y1"])
    return F.when(s["y2"] > s["y1"], turn > 0).otherwise(turn < 0)


def _left_of(s: Column, x: Column, y: Column) -> Column:
    """Does an edge that straddles ``y`` pass right of (x, y)?  Only an edge that straddles ``x`` too needs its line."""
    return F.when(_straddles(s["x1"], s["x2"], x), _left_of_line(s, x, y)).otherwise(s["x1"] > x)


def _below(s: Column, x: Column, y: Column) -> Column:
    """Does an edge that straddles ``x`` pass above (x, y)?  Told by the same line as ``_left_of``, so the two never contradict
    each other, whatever rounding makes of a point that lies on the edge."""
    rising = (s["x2"] > s["x1"]) == (s["y2"] > s["y1"])
    return F.when(_straddles(s["y1"], s["y2"], y), _left_of_line(s, x, y) != rising).otherwise(s["y1"] > y)


def _corner(ix: Column, iy: Column, cell_size: float) -> tuple[Column, Column]:
    return (ix + 1) * F.lit(float(cell_size)), (iy + 1) * F.lit(float(cell_size))


def holds(cand: Column, px: Column, py: Column, ix: Column, iy: Column, cell_size: float) -> Column:
    """Does an index entry of the point's own row hold the point in cell (ix, iy)?"""
    right, top = _corner(ix, iy, cell_size)

    def changes_side(s: Column) -> Column:
        """The edge crosses one of the two legs of the way, but not both. Half-open, as rays are: low sides in, high sides out."""
        along = _straddles(s["y1"], s["y2"], py) & ((px < _x_at(py, s["x1"], s["y1"], s["x2"], s["y2"])) != _left_of(s, right, py))
        upward = _straddles(s["x1"], s["x2"], right) & (_below(s, right, py) != _below(s, right, top))
        return along != upward

    odd = F.size(F.filter(cand["edges"], changes_side)) % 2 == 1
    return (cand["lo"] <= ix) & (ix <= cand["hi"]) & (cand["edges"].isNull() | (cand["corner"] != odd))


def join_points_to_zones(
    points: DataFrame,
    index: DataFrame,
    *,
    how: str = "left",
    multi: str = "all",
    lat: str = "lat",
    lon: str = "lon",
    cell_size: float = CELL_DEG,
) -> DataFrame:
    """Points plus ``zone_id``.

    ``multi='all'`` gives one row per containing zone, ``'first'`` only the lowest zone order.
    ``how='left'`` keeps points in no zone (or without coordinates) with a NULL zone.
    Boundary points follow the half-open crossing rule: low sides in, high sides out.
    """
    px, py = F.col(lon), F.col(lat)
    keyed = points.withColumns({"ix": G.cell(px, cell_size), "iy": G.cell(py, cell_size)}).withColumn("seg", F.floor(F.col("ix") / RUN))
    joined = hashed_join(keyed, index, ["seg", "iy"], "left" if how == "left" else "inner")
    hits = F.filter("cands", lambda z: holds(z, px, py, F.col("ix"), F.col("iy"), cell_size))
    out = joined.withColumn("_zones", F.transform(hits, lambda z: z["zone_id"]))
    out = out.drop("seg", "ix", "iy", "cands")
    if multi == "first":
        out = out.withColumn("zone_id", F.try_element_at("_zones", F.lit(1)))
        out = out if how == "left" else out.filter(F.col("zone_id").isNotNull())
    else:
        explode = F.explode_outer if how == "left" else F.explode
        out = out.withColumn("zone_id", explode("_zones"))
    return out.drop("_zones")


def reindex_zone(
    events: DataFrame, index: DataFrame, *, force: bool = False, zone_col: str = "zone",
    lat: str = "lat", lon: str = "lon", cell_size: float = CELL_DEG,
) -> DataFrame:
    """Fill (or with ``force`` overwrite) the stored zone; ``zone_status`` says what happened.
    Running it again on its own result changes nothing."""
    found = join_points_to_zones(events, index, multi="first", lat=lat, lon=lon, cell_size=cell_size)
    has_coords = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    stored = F.col(zone_col).isNotNull()
    replace = has_coords & F.col("zone_id").isNotNull() & (F.lit(force) | ~stored)
    status = (
        F.when(stored & F.lit(not force), "already")
        .when(~has_coords, "no_coords")
        .when(F.col("zone_id").isNull(), "outside")
        .when(F.col(zone_col).eqNullSafe(F.col("zone_id")), "already")
        .otherwise("updated")
    )
    return found.withColumn("zone_status", status).withColumn(
        zone_col, F.when(replace, F.col("zone_id")).otherwise(F.col(zone_col))
    ).drop("zone_id")


def reindex_counts(reindexed: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("zone_status") == s).alias(s)
    return reindexed.agg(*[count(s) for s in ("updated", "already", "no_coords", "outside")])


# ------------------------------------------------------------------ distance joins
def spread_cells(df: DataFrame, radius: float, size: float, x: str, y: str) -> DataFrame:
    """Copy each row to every cell its circle of ``radius`` can reach."""
    ix = F.sequence(G.cell(F.col(x) - F.lit(radius), size), G.cell(F.col(x) + F.lit(radius), size))
    iy = F.sequence(G.cell(F.col(y) - F.lit(radius), size), G.cell(F.col(y) + F.lit(radius), size))
    return df.withColumn("ix", F.explode(ix)).withColumn("iy", F.explode(iy))


def in_cells(df: DataFrame, size: float) -> DataFrame:
    """Rows with the cell of their place."""
    return df.withColumns({"ix": G.cell(F.col("x"), float(size)), "iy": G.cell(F.col("y"), float(size))})


def within_radius(
    points: DataFrame, anchors: DataFrame, radius_m: float, *, how: str = "left_semi",
    on: list[str] | None = None,
) -> DataFrame:
    """Semi (or anti) join: points with an anchor within ``radius_m``; both sides need x, y.

    ``on`` names columns that must also be equal (for example the street of the anchor).
    Anchors are reduced to distinct places and copied to the cells they reach; a point looks
    into its own cell only and stops at the first hit.
    """
    return _in_reach(in_cells(points, radius_m), anchors, radius_m, how, on or []).select(*points.columns)


def _in_reach(keyed: DataFrame, anchors: DataFrame, radius_m: float, how: str, keys: list[str]) -> DataFrame:
    """``within_radius`` for points that carry the cells of that size."""
    radius = float(radius_m)
    # missing places are dropped on an aggregate: a plain filter would be pushed below the
    # projection that made x and y and repeat its whole expression there
    located = F.max(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("_ok")
    places = anchors.groupBy(*keys, F.col("x").alias("_ax"), F.col("y").alias("_ay")).agg(located).filter("_ok").drop("_ok")
    reach = spread_cells(places, radius, radius, "_ax", "_ay")
    close = G.within(F.col("x"), F.col("y"), F.col("_ax"), F.col("_ay"), radius)
    return hashed_join(keyed, reach, ["ix", "iy", *keys], how, close)


def covered_by_camera(incidents: DataFrame, cameras: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """Incidents within the radius of any camera, straight line."""
    return within_radius(incidents, cameras, radius_m)


def near_any(
    units: DataFrame, incidents: DataFrame, others: DataFrame, radius_m: float = 100.0,
    key: str = "street",
) -> DataFrame:
    """Per unit: is any of ``others`` within the radius of the unit's own incidents, or of
    the unit's centroid when it has none or no name. Returns ``(key, is_near)``."""
    own = incidents.filter(F.col(key) != "").select(key, "x", "y").join(units.select(key), key, "left_semi")
    with_own = own.groupBy(key).agg(F.max(F.col("x").isNotNull()).alias("_ok")).filter("_ok").select(key)
    centres = units.join(with_own, key, "left_anti").select(key, "x", "y").filter(F.col("x").isNotNull())
    places = own.distinct().unionByName(centres)
    # Written out as dealt by cell into as many tasks as the session shuffles into. Left to the planner, the join meets every
    # incident before equal places are put together, and in as few tasks as its compressed bytes suggest, which then sort too much.
    dealt = in_cells(places, radius_m).repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ix", "iy")
    hits = _in_reach(cut(dealt), others, radius_m, "left_semi", []).select(key).distinct()
    flag = hits.withColumn("is_near", F.lit(True))
    return units.select(key).distinct().join(flag, key, "left").withColumn(
        "is_near", F.coalesce("is_near", F.lit(False))
    )


def exact_name_fallback(units: DataFrame, rows: DataFrame, key: str = "street_norm",
                        name: str = "street_norm", x: str = "x", y: str = "y") -> DataFrame:
    """Units whose normal name equals that of a row without coordinates: ``(key, named)``."""
    names = rows.groupBy(F.col(name).alias(key)).agg(F.max(F.col(x).isNull() | F.col(y).isNull()).alias("named"))
    names = names.filter(F.col("named") & (F.col(key) != ""))
    return units.select(key).distinct().join(names, key, "left").withColumn(
        "named", F.coalesce("named", F.lit(False))
    )


def edge_cells(edges: DataFrame, buffer_m: float, size: float) -> DataFrame:
    """Edges copied to the cells their buffered box covers."""
    b = F.lit(float(buffer_m))
    lo_x, hi_x = F.least("x1", "x2") - b, F.greatest("x1", "x2") + b
    lo_y, hi_y = F.least("y1", "y2") - b, F.greatest("y1", "y2") + b
    out = edges.withColumn("ix", F.explode(F.sequence(G.cell(lo_x, size), G.cell(hi_x, size))))
    return out.withColumn("iy", F.explode(F.sequence(G.cell(lo_y, size), G.cell(hi_y, size))))


def ring_join(
    points: DataFrame, metric_edges: DataFrame, point_id: str, buffer_m: float = 500.0,
) -> DataFrame:
    """``(point_id, zone_id)`` for points in no zone but within ``buffer_m`` of its border.

    ``points`` must carry ``zone_id`` from a left point–zone join (NULL outside) and metric
    ``x, y``. Segment distance replaces a buffer polygon.
    """
    size = float(buffer_m)
    outside = points.filter(F.col("zone_id").isNull()).drop("zone_id")
    outside = outside.withColumns({"ix": G.cell(F.col("x"), size), "iy": G.cell(F.col("y"), size)})
    per_cell = edge_cells(metric_edges, size, size).groupBy("ix", "iy", "zone_id").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges")
    ).groupBy("ix", "iy").agg(F.collect_list(F.struct("zone_id", "edges")).alias("cands"))
    joined = hashed_join(outside, per_cell, ["ix", "iy"], "inner")
    px, py = F.col("x"), F.col("y")
    close = F.filter(
        "cands",
        lambda z: F.exists(
            z["edges"],
            lambda s: G.segment_distance(px, py, s["x1"], s["y1"], s["x2"], s["y2"]) <= F.lit(size),
        ),
    )
    return joined.select(point_id, F.explode(F.transform(close, lambda z: z["zone_id"])).alias("zone_id"))


def subtract_zones(points: DataFrame, zone_col: str = "zone_id") -> DataFrame:
    """Points in none of the zones (after a left point–zone join)."""
    return points.filter(F.col(zone_col).isNull())


# ------------------------------------------------------------------ nearest
_FAN = 4
#: Levels counted in one pass, and the deepest one: beyond it doubles no longer tell places apart.
_LEVELS_AT_ONCE, _DEEPEST = 8, 25


#: Places a cell of the first look should hold around a place, and the most it may hold to be looked through.
_AIM, _CROWD = 2.0, 32


def _depth(places: DataFrame, grid, extent: float, leaf_targets: int) -> tuple[int, float]:
    """The first level whose fullest box holds at most ``leaf_targets`` places, and the size of cells that hold about ``_AIM`` places
    where most places are. Several levels are counted in one pass; a further pass takes the places of full boxes only."""
    level, rows, size, most = 0, places.select("*"), extent, None
    while True:
        levels = list(range(level, min(level + _LEVELS_AT_ONCE, _DEEPEST + 1)))
        keyed = rows.select("*", F.explode(F.array(*[
            F.struct(F.lit(k).alias("level"), *[c.alias(n) for n, c in zip(("cx", "cy"), grid(k))]) for k in levels])).alias("b"))
        keys = [c for c in rows.columns if c not in ("x", "y", "_t")]
        # the middle one of the places: how many share its box
        told = (keyed.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n")).groupBy("b.level").agg(
            F.max("n").alias("n"), F.sum("n").alias("all"), F.percentile("n", F.lit(0.5), F.col("n")).alias("middle")).collect())
        fullest = {r.level: r.n for r in told}
        most = most or told[0]["all"]
        for r in sorted(told, key=lambda r: r.level):
            if r.level == 0 or (r.middle >= 6 * _AIM and 2 * r["all"] >= most):
                size = extent / _FAN ** r.level * min(1.0, math.sqrt(_AIM / r.middle))
        fit = [k for k in levels if fullest[k] <= leaf_targets]
        if fit or levels[-1] == _DEEPEST:
            return fit[0] if fit else _DEEPEST, size
        last = [c.alias(n) for n, c in zip(("_bx", "_by"), grid(levels[-1]))]
        boxed = rows.select("*", *last)
        full = boxed.groupBy(*keys, "_bx", "_by").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > leaf_targets).drop("_n")
        rows = cut(hashed_join(boxed, full, [*keys, "_bx", "_by"], "left_semi").drop("_bx", "_by"))
        level = levels[-1] + 1


def _around(places: DataFrame, keys: list[str], x0: float, y0: float, size: float) -> DataFrame:
    """Per cell the places in it and in the eight around it, where none of the nine is crowded."""
    boxed = places.withColumns({"_bx": G.cell(F.col("x") - F.lit(x0), size), "_by": G.cell(F.col("y") - F.lit(y0), size)})
    boxed = boxed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_bx", "_by")))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    crowd = boxed.filter(F.col("_n") > _CROWD).select(*keys, "_bx", "_by").distinct().select(
        *keys, "_bx", "_by", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"),
        F.lit(None).cast(boxed.schema["_t"].dataType).alias("_t"), F.lit(True).alias("_full"))
    few = boxed.filter(F.col("_n") <= _CROWD).select(*keys, "_bx", "_by", "x", "y", "_t", F.lit(False).alias("_full"))
    spread = few.unionByName(crowd).withColumn("s", steps)
    return spread.groupBy(*keys, (F.col("_bx") + F.col("s.dx")).alias("cx"), (F.col("_by") + F.col("s.dy")).alias("cy")).agg(
        F.collect_list(F.when(~F.col("_full"), F.struct("x", "y", "_t"))).alias("kids"), F.max("_full").alias("_full")).filter(~F.col("_full")).drop("_full")


def nearest(
    points: DataFrame, targets: DataFrame, *, point_id: str, target_id: str, leaf_targets: int = 16, on: list[str] | None = None,
) -> DataFrame:
    """``(point_id, target_id, dist_m)``: the closest target of every point, ties to the lowest id.

    ``on`` names columns that must be equal: a point then sees the targets of its own group only.

    A point first looks through its own cell of a grid and the eight around it. What it finds nearer than their border is the answer; most
    points end here. The others, in sparse places and crowds, go on: a pyramid of target boxes is walked twice. The first walk goes straight down, always into the box whose farthest corner is
    nearest, and ends at a place whose distance bounds the answer. The second goes into every box that is not farther than that, which is
    hardly more than one a level, so far clusters are dropped as whole boxes, however many targets they hold. A point meets a box's children
    as one array in its own row. The pyramid is as deep as it takes for a leaf to hold at most ``leaf_targets`` places.
    """
    keys = on or []
    located = targets.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    places = cut(located.groupBy(*keys, "x", "y").agg(F.min(target_id).alias("_t")))
    span = places.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    ).first()
    if span["x0"] is None:
        return points.limit(0).select(
            point_id, F.lit(None).cast(targets.schema[target_id].dataType).alias(target_id),
            F.lit(None).cast("double").alias("dist_m"),
        )
    x0, y0 = span["x0"], span["y0"]
    extent = max(span["x1"] - x0, span["y1"] - y0, 1e-9) * (1.0 + 1e-9)

    def grid(level: int) -> tuple[Column, Column]:
        size = extent / _FAN ** level
        return G.cell(F.col("x") - F.lit(x0), size), G.cell(F.col("y") - F.lit(y0), size)

    depth, size = _depth(places, grid, extent, leaf_targets)
    px, py = F.col("px"), F.col("py")
    located_points = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        point_id, *keys, F.col("x").alias("px"), F.col("y").alias("py"))
    ox, oy = px - F.lit(x0), py - F.lit(y0)
    looking = located_points.withColumns({"cx": G.cell(ox, size), "cy": G.cell(oy, size)})
    # how far the nine cells reach around the point, a little to the safe side
    sides = [ox - (F.col("cx") - 1) * F.lit(size), (F.col("cx") + 2) * F.lit(size) - ox, oy - (F.col("cy") - 1) * F.lit(size), (F.col("cy") + 2) * F.lit(size) - oy]
    margin = F.least(*sides) - F.lit(size * 1e-6)
    here = F.array_min(F.transform("kids", lambda p: F.struct(G.distance(px, py, p["x"], p["y"]).alias("d"), p["_t"].alias("t"))))
    looked = hashed_join(looking, cut(_around(places, keys, x0, y0, size)), [*keys, "cx", "cy"], "left").select(
        point_id, *keys, "px", "py", margin.alias("margin"), here.alias("b"))
    looked = cut(looked.select(point_id, *keys, "px", "py", F.when((F.col("b.d") <= F.col("margin")) & ~F.isnan("b.d"), F.col("b")).alias("b")))
    seen = looked.filter(F.col("b").isNotNull()).select(point_id, "b")
    open_ = looked.filter(F.col("b").isNull())
    if open_.isEmpty():
        best = seen.groupBy(point_id).agg(F.min("b").alias("b"))
        return best.select(point_id, F.col("b.t").alias(target_id), F.col("b.d").alias("dist_m"))

    def judged(b: Column) -> Column:
        """Far and near distance to a box, both a little to the safe side, and where the box is."""
        dx, dy = F.abs(px - b["mx"]), F.abs(py - b["my"])
        return F.struct(F.hypot(dx + b["hx"], dy + b["hy"]).alias("far"),
                        F.hypot(F.greatest(dx - b["hx"], F.lit(0.0)), F.greatest(dy - b["hy"], F.lit(0.0))).alias("near"), b["bx"].alias("bx"), b["by"].alias("by"))

    def children(level: int) -> DataFrame:
        """Boxes of one level as an array per parent box; at the last level the places of each leaf."""
        cx, cy = grid(level)
        px_, py_ = (F.floor(F.col(c) / _FAN).cast("bigint") for c in ("bx", "by"))
        box = places.groupBy(*keys, cx.alias("bx"), cy.alias("by")).agg(
            *[((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in "xy"], *[((F.max(c) - F.min(c)) / 2).alias(f"h{c}") for c in "xy"])
        return box.groupBy(*keys, px_.alias("cx"), py_.alias("cy")).agg(F.collect_list(F.struct("bx", "by", "mx", "my", "hx", "hy")).alias("kids"))

    cx, cy = grid(depth)
    leaves = places.groupBy(*keys, cx.alias("cx"), cy.alias("cy")).agg(F.collect_list(F.struct("x", "y", "_t")).alias("kids"))
    levels = [children(k) for k in range(1, depth + 1)]
    zero = F.lit(0).cast("bigint")
    walk = open_.select(point_id, *keys, "px", "py", zero.alias("cx"), zero.alias("cy"))
    # by number and key: the walks cost more than their rows' bytes tell, and the last aggregation keeps to this partitioning
    walk = walk.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), point_id)
    for kids in levels:  # straight down, always into the box whose farthest corner is nearest
        into = hashed_join(walk, kids, [*keys, "cx", "cy"], "inner").withColumn("k", F.array_min(F.transform("kids", judged)))
        walk = into.select(point_id, *keys, "px", "py", F.col("k.bx").alias("cx"), F.col("k.by").alias("cy"))
    # a point on a target is bounded by zero, and the rounded middle of a box may lie a little off
    rounding = (abs(x0) + abs(y0) + extent) * 1e-14
    reached = F.array_min(F.transform("kids", lambda p: G.distance(px, py, p["x"], p["y"])))
    bounded = hashed_join(walk, leaves, [*keys, "cx", "cy"], "inner").select(
        point_id, *keys, "px", "py", zero.alias("cx"), zero.alias("cy"), (reached * F.lit(1.0 + 1e-9) + F.lit(rounding)).alias("bound"))
    frontier = bounded
    for kids in levels:  # once more, into every box that is not beyond what was reached
        bound = F.col("bound")
        near = F.filter(F.transform("kids", judged), lambda k: k["near"] <= bound)
        frontier = hashed_join(frontier, kids, [*keys, "cx", "cy"], "inner").select(point_id, *keys, "px", "py", "bound", F.explode(near).alias("k")).select(
            point_id, *keys, "px", "py", F.col("k.bx").alias("cx"), F.col("k.by").alias("cy"), "bound")
    met = hashed_join(frontier, leaves, [*keys, "cx", "cy"], "inner").select(point_id, "px", "py", F.explode("kids").alias("k"))
    met = met.select(point_id, F.struct(G.distance(px, py, F.col("k.x"), F.col("k.y")).alias("d"), F.col("k._t").alias("t")).alias("b"))
    best = met.unionByName(seen).groupBy(point_id).agg(F.min("b").alias("b"))
    return best.select(point_id, F.col("b.t").alias(target_id), F.col("b.d").alias("dist_m"))


def within_radius_km(
    zones: DataFrame, origin: str, radius_km: float, *, name: str = "name",
    lat: str = "lat", lon: str = "lon",
) -> DataFrame:
    """Zones whose centroid lies within ``radius_km`` of the origin's, nearest first.

    The origin's place is read first (one row), so the zones are filtered without a join; a latitude box prunes before the distance.
    Without the origin no zone is near it.
    """
    here = zones.filter(F.col(name) == origin).select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).first()
    if here is None or here.lat is None or here.lon is None:
        return zones.limit(0).withColumn("distance_km", F.lit(None).cast("double"))
    dist = G.haversine(F.lit(here.lat), F.lit(here.lon), F.col(lat), F.col(lon), G.EARTH_KM)
    near = zones.filter((F.col(name) != origin) & (F.abs(F.col(lat) - F.lit(here.lat)) <= F.lit(radius_km / 110.0)))
    out = near.withColumn("distance_km", G.round_half_up(dist, 2))
    return out.filter(F.col("distance_km") <= radius_km).orderBy("distance_km", name)


# ------------------------------------------------------------------ coincidence grid
def grid_coincidence(
    incidents: DataFrame, factors: DataFrame, tips: DataFrame, cell_m: float = 130.0,
) -> DataFrame:
    """Counts of the three layers per square metric cell and how many layers meet there."""
    def counted(df: DataFrame, name: str, *extra) -> DataFrame:
        keyed = df.groupBy(G.cell(F.col("x"), cell_m).alias("ix"), G.cell(F.col("y"), cell_m).alias("iy"))
        return keyed.agg(F.count(F.lit(1)).alias(name), *extra).filter(F.col("ix") != G.NO_CELL)

    street = F.mode("street", True).alias("street") if "street" in incidents.columns else F.lit(None).alias("street")
    layers = counted(incidents, "n_incidents", street).join(
        counted(factors, "n_factors"), ["ix", "iy"], "full"
    ).join(counted(tips, "n_tips"), ["ix", "iy"], "full")
    counts = ["n_incidents", "n_factors", "n_tips"]
    filled = layers.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    present = sum(((F.col(c) > 0).cast("int") for c in counts), F.lit(0))
    return filled.withColumn("n_layers", present)


def grid_streets(grid: DataFrame) -> DataFrame:
    """Cells merged to streets: cells, incidents, most layers, rank."""
    merged = grid.filter(F.col("street").isNotNull()).groupBy("street").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n_incidents").alias("crime_total"),
        F.max("n_layers").alias("max_layers"),
    )
    return global_row_number(merged, [F.desc("max_layers"), F.desc("crime_total"), F.col("street")], "rank")


def grid_street_causes(grid: DataFrame, factors: DataFrame, cell_m: float = 130.0) -> DataFrame:
    """``grid_streets`` with the agencies in charge and the factor types found in the street's cells, sorted; empty where none are.

    ``factors`` carries ``x, y, agency, kind`` and ``cell_m`` is the grid's. Both lists hold names of a catalogue, not rows."""
    found = factors.select(G.cell(F.col("x"), cell_m).alias("ix"), G.cell(F.col("y"), cell_m).alias("iy"), "agency", "kind").filter(
        F.col("ix") != G.NO_CELL).distinct()
    causes = grid.filter(F.col("street").isNotNull()).select("ix", "iy", "street").join(found, ["ix", "iy"]).groupBy("street").agg(
        F.sort_array(F.collect_set("agency")).alias("agencies"), F.sort_array(F.collect_set("kind")).alias("factors"))
    none = F.array().cast("array<string>")
    return grid_streets(grid).join(causes, "street", "left").withColumns({c: F.coalesce(c, none) for c in ("agencies", "factors")})
