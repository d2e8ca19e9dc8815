"""Clusters, connected components, density clusters, camera gaps and street networks.

Points are first reduced to grid cells whose diagonal is the search radius: points of one
cell are always linked, so a dense place is one node, never a clique of pairs. Only
neighbouring cells are compared, by their boxes, and split further where boxes cannot decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoevents.functions import fixed_values as V
from geoevents.functions import geo as G
from geoevents.functions import text as X
from geoevents.operators import spatial as S
from geoevents.operators.ranking import top_k_per_group
from geoevents.session import cut, hashed_join

# Margin that keeps "same cell" strictly inside the radius despite floating point.
_SHRINK = 1.0 - 1e-9
_NEIGHBOURS = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]


# ------------------------------------------------------------------ components
def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, component)``, the component being its smallest node id.

    ``links(a, b)``. Each round gives nodes a fresh random order (a hash); every node moves to
    the lowest of its neighbours and itself, and once more from there, and the graph is
    contracted to the places moved to. Random orders have no long descending paths, so live
    links shrink geometrically even on chains and stars. Rounds are checkpointed.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    edges = cut(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(moves)
        ordered = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))
        step = edges.groupBy("u").agg(F.min(ordered("v")).alias("m"))
        step = step.select("u", F.least(ordered("u"), "m")["id"].alias("p"))
        onward = step.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = cut(step.join(onward, "p", "left").select("u", F.coalesce("pp", "p").alias("p")))
        left = hashed_join(edges, jump.select("u", F.col("p").alias("pu")), ["u"], "inner")
        right = hashed_join(left, jump.select(F.col("u").alias("v"), F.col("p").alias("pv")), ["v"], "inner")
        edges = cut(right.select(F.col("pu").alias("u"), F.col("pv").alias("v")).filter("u <> v").distinct())
        moves.append(jump)
    # tables of moves shrink with the graph: put together from the last, the small ones meet first
    where = None
    for jump in reversed(moves):
        if where is None:
            where = jump
        else:
            onward = where.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            where = jump.join(onward, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
    assigned = nodes.select("node").distinct()
    if where is None:
        return assigned.select("node", F.col("node").alias("component"))
    assigned = cut(hashed_join(assigned, where.withColumnsRenamed({"u": "node", "p": "_to"}), ["node"], "left")
                   .select("node", F.coalesce("_to", "node").alias("comp")))
    smallest = assigned.groupBy("comp").agg(F.min("node").alias("component"))
    return hashed_join(assigned, smallest, ["comp"], "inner").select("node", "component")


# ------------------------------------------------------------------ linking by distance
# Boxes with at most this many distinct places carry them as a list; fuller ones are split.
_LISTED = 8


def _boxes(places: DataFrame, size: float, ix: str, iy: str, by: list[str]) -> DataFrame:
    """Boxes of distinct places: extent, and the places themselves where they are few."""
    keyed = places.select(*by, "x", "y", G.cell(F.col("x"), size).alias(ix), G.cell(F.col("y"), size).alias(iy))
    counted = keyed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, ix, iy)))
    few = F.when(F.col("_n") <= _LISTED, F.struct("x", "y"))
    return counted.groupBy(*by, ix, iy).agg(
        F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"),
        F.collect_list(few).alias("pts"))


def _box_gap(a: str, b: str) -> tuple[Column, Column]:
    """Smallest and largest squared distance between two boxes."""
    c = lambda side, f: F.col(f"{side}{f}")

    def axis(lo: str, hi: str) -> tuple[Column, Column]:
        gap = F.greatest(c(b, lo) - c(a, hi), c(a, lo) - c(b, hi), F.lit(0.0))
        far = F.greatest(c(b, hi) - c(a, lo), c(a, hi) - c(b, lo))
        return gap, far

    gx, fx = axis("minx", "maxx")
    gy, fy = axis("miny", "maxy")
    return gx * gx + gy * gy, fx * fx + fy * fy


def linked_cells(points: DataFrame, eps_m: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of neighbouring cells that hold two points within ``eps_m`` of each other.

    ``points(x, y)``. Cells are compared by the boxes of their points: boxes wholly within the
    radius are linked, boxes farther apart are not. Of undecided pairs, those of two boxes with
    few places are settled place by place inside their row; the others are split four ways per
    axis and compared again, until nothing is open. Distinct places always separate, so this
    ends, and no dense box is ever compared place by place. A pair stops at its first hit.
    Points of different groups ``by`` are never linked.
    """
    size = eps_m / math.sqrt(2.0) * _SHRINK
    by = by or []
    places = cut(points.select(*by, "x", "y").distinct())
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _NEIGHBOURS]))
    eps2 = F.lit(float(eps_m) ** 2)
    near, far = _box_gap("a_", "b_")
    listed = (F.size("a_pts") > 0) & (F.size("b_pts") > 0)
    hit = F.exists("a_pts", lambda p: F.exists("b_pts", lambda q: G.dist2(p["x"], p["y"], q["x"], q["y"]) <= eps2))
    key = [*by, "a_ix", "a_iy", "b_ix", "b_iy"]

    def side(boxes: DataFrame, prefix: str) -> DataFrame:
        return boxes.select(*by, *[F.col(c).alias(f"{prefix}{c}") for c in boxes.columns if c not in by])

    def judged(pairs: DataFrame, *keep: str) -> DataFrame:
        """Pairs that are linked (``yes``) or still open."""
        told = pairs.filter(near <= eps2).withColumns({"yes": (far <= eps2) | (listed & hit), "open": ~listed & (far > eps2)})
        return cut(told.filter("yes or open").select(*key, "yes", *keep))

    cells = _boxes(places, size, "ix", "iy", by)
    a = side(cells, "a_").withColumn("s", steps).withColumns({
        "b_ix": F.col("a_ix") + F.col("s.dx"), "b_iy": F.col("a_iy") + F.col("s.dy")}).drop("s")
    first = judged(a.join(side(cells, "b_"), [*by, "b_ix", "b_iy"]))
    links = first.filter("yes").select(*key)
    open_pairs = first.filter(~F.col("yes")).select(
        *key, *[F.col(f"{s}{k}").alias(f"{s}s{k}") for s in ("a_", "b_") for k in ("ix", "iy")])
    scale = 1
    while not open_pairs.isEmpty():
        scale *= 4
        kids = _boxes(places, size / scale, "cx", "cy", by).withColumns({
            "six": F.floor(F.col("cx") / 4).cast("bigint"), "siy": F.floor(F.col("cy") / 4).cast("bigint")})
        opened = open_pairs.join(side(kids, "a_"), [*by, "a_six", "a_siy"]).join(side(kids, "b_"), [*by, "b_six", "b_siy"])
        told = judged(opened, "a_cx", "a_cy", "b_cx", "b_cy")
        found = told.filter("yes").select(*key).distinct()
        links = links.unionByName(found)
        open_pairs = told.filter(~F.col("yes")).join(found, key, "left_anti").select(
            *key, F.col("a_cx").alias("a_six"), F.col("a_cy").alias("a_siy"), F.col("b_cx").alias("b_six"), F.col("b_cy").alias("b_siy"))
    return links


def cell_node(ix: str, iy: str, by: list[str] | None = None) -> Column:
    """A cell of a group as one node of a graph; nodes compare field by field."""
    return F.struct(*[F.col(c).alias(c) for c in by or []], F.col(ix).alias("ix"), F.col(iy).alias("iy"))


def eps_links(points: DataFrame, eps_m: float, by: list[str] | None = None) -> DataFrame:
    """Links between cells with the connectivity of all point pairs within ``eps_m``."""
    cells = linked_cells(points, eps_m, by)
    return cells.select(cell_node("a_ix", "a_iy", by).alias("a"), cell_node("b_ix", "b_iy", by).alias("b"))


def _in_cells(points: DataFrame, size: float, by: list[str] | None = None) -> DataFrame:
    """Points with the ``node`` of their cell."""
    keyed = points.withColumns({"_ix": G.cell(F.col("x"), size), "_iy": G.cell(F.col("y"), size)})
    return keyed.withColumn("node", cell_node("_ix", "_iy", by)).drop("_ix", "_iy")


def cluster_eps(points: DataFrame, eps_m: float = V.GAP_EPS_M, *, id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """Single-link clusters: points plus ``cluster_id`` (the smallest id in the cluster), each group ``by`` for itself."""
    keyed = _in_cells(points, eps_m / math.sqrt(2.0) * _SHRINK, by)
    comp = connected_components(keyed.select("node").distinct(), eps_links(points, eps_m, by))
    smallest = keyed.groupBy("node").agg(F.min(id_col).alias("_first")).join(comp, "node")
    names = smallest.groupBy("component").agg(F.min("_first").alias("cluster_id"))
    per_cell = comp.join(names, "component").select("node", "cluster_id")
    return hashed_join(keyed, per_cell, ["node"], "inner").drop("node")


def cluster_summary(clustered: DataFrame, severity: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Size, severity sum and centroid per cluster (of each group ``by``)."""
    sev = F.sum(severity) if severity else F.count(F.lit(1)).cast("double")
    return clustered.groupBy(*(by or []), "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), sev.alias("severity"), F.avg("x").alias("x"), F.avg("y").alias("y"))


# ------------------------------------------------------------------ density clusters
def neighbour_counts(points: DataFrame, eps_m: float, min_pts: int, *, id_col: str = "id") -> DataFrame:
    """``(id, node, x, y, is_core)``: does a point have ``min_pts`` points (itself included)
    within ``eps_m``?

    A cell with that many points makes all of them core without a look around; only points of
    sparser cells are compared with the neighbouring cells, a bounded number per neighbour.
    """
    size = eps_m / math.sqrt(2.0) * _SHRINK
    keyed = points.select(id_col, "x", "y").withColumns({
        "ix": G.cell(F.col("x"), size), "iy": G.cell(F.col("y"), size)})
    sizes = keyed.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("cell_n"))
    sized = hashed_join(keyed, sizes, ["ix", "iy"], "inner")
    dense = F.col("cell_n") >= min_pts
    sparse = sized.filter(~dense)
    around = F.explode(F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-2, 3) for dy in range(-2, 3)]))
    looking = sparse.select(F.col(id_col).alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), "ix", "iy", around.alias("s"))
    looking = looking.select("_id", "_x", "_y", (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"))
    places = keyed.groupBy("ix", "iy", "x", "y").agg(F.count(F.lit(1)).alias("k"))
    met = hashed_join(places, looking, ["ix", "iy"], "inner").filter(
        G.dist2(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")) <= F.lit(float(eps_m) ** 2))
    counted = met.groupBy(F.col("_id").alias(id_col)).agg(F.sum("k").alias("k"))
    node = cell_node("ix", "iy").alias("node")
    return sized.join(counted, id_col, "left").select(
        id_col, node, "x", "y", (dense | (F.coalesce("k", F.lit(0)) >= min_pts)).alias("is_core"))


def dbscan(points: DataFrame, eps_m: float = 150.0, min_pts: int = 5, *, id_col: str = "id") -> DataFrame:
    """``(id, cluster_id)`` of density clusters, noise left out. The cluster id is its smallest
    core point; a border point joins the reachable cluster with the smallest id."""
    size = eps_m / math.sqrt(2.0) * _SHRINK
    judged = cut(neighbour_counts(points, eps_m, min_pts, id_col=id_col))
    core = judged.filter("is_core")
    comp = connected_components(core.select("node").distinct(), eps_links(core, eps_m))
    first = core.groupBy("node").agg(F.min(id_col).alias("_first")).join(comp, "node")
    names = first.groupBy("component").agg(F.min("_first").alias("cluster_id"))
    per_cell = comp.join(names, "component").select("node", "cluster_id")
    in_core = hashed_join(core, per_cell, ["node"], "inner").select(id_col, "cluster_id")
    # border: distinct core places per cell and cluster around each non-core point
    places = hashed_join(core.select("node", "x", "y").distinct(), per_cell, ["node"], "inner").drop("node")
    border = judged.filter(~F.col("is_core")).select(F.col(id_col).alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    reach = S.spread_cells(border, float(eps_m), size, "_x", "_y")
    placed = places.withColumns({"ix": G.cell(F.col("x"), size), "iy": G.cell(F.col("y"), size)})
    near = hashed_join(placed, reach, ["ix", "iy"], "inner").filter(
        G.dist2(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")) <= F.lit(float(eps_m) ** 2))
    at_border = near.groupBy(F.col("_id").alias(id_col)).agg(F.min("cluster_id").alias("cluster_id"))
    return in_core.unionByName(at_border)


# ------------------------------------------------------------------ camera gaps
def scored_gaps(
    incidents: DataFrame, cameras: DataFrame, *, radius_m: float = V.CAMERA_RADIUS_M,
    eps_m: float = V.GAP_EPS_M, id_col: str = "id", offence: str = "offence",
    camera_id: str = "camera_id", network_covered: DataFrame | None = None,
    network_distance: Callable[[DataFrame], DataFrame] | None = None, by: list[str] | None = None,
) -> DataFrame:
    """All clusters of incidents no camera covers, with severity, distance and priority.

    Straight-line coverage unless ``network_covered(id, covered)`` is given (see
    ``network_coverage``); ``network_distance`` gives ``(cluster_id, net_m)`` for the clusters,
    which then replaces the straight distance where known. Without any camera there are no gaps.
    With ``by`` a group's incidents meet the cameras of their own group only, and an incident may be in several groups.
    """
    placed = incidents.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if network_covered is None:
        open_ = S.within_radius(placed, cameras, radius_m, how="left_anti", on=by)
    else:
        seen = network_covered.filter("covered").select(id_col)
        open_ = placed.join(seen, id_col, "left_anti")
    sev = F.coalesce(X.lookup(F.col(offence), V.GAP_SEVERITY), F.lit(V.GAP_SEVERITY_DEFAULT))
    clusters = cluster_summary(cluster_eps(open_.withColumn("_sev", sev), eps_m, id_col=id_col, by=by), "_sev", by)
    clusters = cut(clusters.withColumn("_c", F.struct(*(by or []), "cluster_id")))
    straight = S.nearest(clusters, cameras, point_id="_c", target_id=camera_id, on=by)
    out = clusters.join(straight.select("_c", F.col("dist_m").alias("nearest_camera_m")), "_c").drop("_c")
    if network_distance is None:
        out = out.withColumn("network_camera_m", F.lit(None).cast("double"))
    else:
        known = network_distance(clusters).select("cluster_id", F.col("net_m").alias("network_camera_m"))
        out = out.join(known, "cluster_id", "left")
    d = F.coalesce("network_camera_m", "nearest_camera_m")
    out = out.withColumns({
        "priority": F.round(F.col("severity") * (F.lit(1.0) + F.least(d / (4 * radius_m), F.lit(1.0))), 2),
        "recommendation": F.when(d <= 2 * radius_m, "remanejar").otherwise("instalar"),
    })
    kind = F.when(F.col("network_camera_m").isNotNull(), "rede viária").otherwise("linha reta")
    return out.withColumn("justification", F.concat(
        F.col("n").cast("string"), F.lit(" ocorrências sem cobertura; câmera mais próxima a "),
        F.format_string("%.0f", d), F.lit(" m ("), kind, F.lit(")")))


def camera_gaps(
    incidents: DataFrame, cameras: DataFrame, *, max_gaps: int = 15, by: list[str] | None = None, **how,
) -> DataFrame:
    """The gaps of highest priority (see ``scored_gaps``), with their place in degrees."""
    return top_gaps(scored_gaps(incidents, cameras, **how), max_gaps, by)


def top_gaps(gaps: DataFrame, max_gaps: int = 15, by: list[str] | None = None) -> DataFrame:
    order = [F.desc("priority"), F.col("cluster_id")]
    out = gaps.orderBy(*order).limit(max_gaps) if by is None else top_k_per_group(gaps, by, order, max_gaps)
    lat, lon = G.unproject_utm(F.col("x"), F.col("y"))
    return out.withColumns({"lat": F.round(lat, 6), "lon": F.round(lon, 6)})


def camera_gaps_on_network(
    incidents: DataFrame, cameras: DataFrame, nodes: DataFrame, edges: DataFrame, *,
    radius_m: float = V.CAMERA_RADIUS_M, snap_tol_m: float = V.SNAP_TOLERANCE_M, max_gaps: int = 15,
    by: list[str] | None = None, id_col: str = "id", camera_id: str = "camera_id", **how,
) -> DataFrame:
    """As ``camera_gaps``, with coverage and distances along the streets.

    A cluster's centroid is put on the nearest node; its distance is that node's to the nearest
    camera along the edges, and the straight line where the centroid lies beyond the tolerance or
    no camera is reachable. When no camera can be put on the graph, all is by straight line.
    """
    how |= {"radius_m": radius_m, "id_col": id_col, "camera_id": camera_id}
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    on_graph = nodes.join(ends, "node", "left_semi")
    sources = cut(S.nearest(cameras, on_graph, point_id=camera_id, target_id="node").select("node").distinct())
    if sources.isEmpty():
        return camera_gaps(incidents, cameras, max_gaps=max_gaps, by=by, **how)

    def along(clusters: DataFrame) -> DataFrame:
        at = S.nearest(clusters, on_graph, point_id="cluster_id", target_id="node").filter(F.col("dist_m") <= snap_tol_m)
        at = cut(at.select("cluster_id", "node"))
        reached = multi_source_distance(edges, sources, None, wanted=at.select("node").distinct())
        return at.join(reached, "node").select("cluster_id", F.col("dist").alias("net_m"))

    covered = network_coverage(incidents, cameras, on_graph, edges, radius_m=radius_m, snap_tol_m=snap_tol_m,
                               id_col=id_col, camera_id=camera_id)
    gaps = scored_gaps(incidents, cameras, network_covered=covered, network_distance=along, **how)
    return top_gaps(gaps, max_gaps, by)


# ------------------------------------------------------------------ street network
def build_street_edges(segments: DataFrame, digits: int = 1) -> DataFrame:
    """Undirected edges between vertices rounded to 0.1 m, the shortest kept per pair.

    ``segments(x1, y1, x2, y2)`` in metres; nodes are 'x:y' texts, each edge listed once.
    """
    r = lambda c: F.round(c, digits)
    s = segments.select(r("x1").alias("x1"), r("y1").alias("y1"), r("x2").alias("x2"), r("y2").alias("y2"))
    s = s.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    name = lambda x, y: F.concat_ws(":", F.col(x).cast("string"), F.col(y).cast("string"))
    w = G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    ends = s.select(name("x1", "y1").alias("p"), name("x2", "y2").alias("q"), w.alias("w"))
    return ends.groupBy(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).agg(F.min("w").alias("w"))


def _joined_parts(both: DataFrame, sources: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges ``both(u, v, w)`` of those components that hold a source and a wanted node, and the wanted nodes that a source reaches."""
    links = both.filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    comp = cut(connected_components(both.select(F.col("u").alias("node")).distinct(), links))
    parts_of = lambda nodes: nodes.join(comp, "node").select("component").distinct()
    live = parts_of(sources).join(parts_of(wanted), "component", "left_semi")
    nodes = cut(comp.join(live, "component", "left_semi").select("node"))
    reached = nodes.unionByName(sources.select("node"))
    return hashed_join(both, nodes.withColumnRenamed("node", "u"), ["u"], "left_semi"), wanted.join(reached, "node", "left_semi")


def multi_source_distance(
    edges: DataFrame, sources: DataFrame, cutoff: float | None, *, wanted: DataFrame | None = None, delta: float | None = None,
) -> DataFrame:
    """``(node, dist)`` of the nodes within ``cutoff`` (None: any distance) of any source along the edges, lengths above zero.

    Buckets of distance, ``delta`` wide (eight mean lengths by default): the nodes of the nearest bucket pass their distance on until
    none of them improves, then they are settled and written away for good. A round groups only nodes that are met and not settled. Of
    the settled ones, an edge can lead back to those within one longest edge of the bucket alone, so only these are kept at hand. Ends when
    nothing is open, or when all ``wanted`` nodes are settled. Wanted nodes that no source reaches would keep the search going to the far end
    of the network, so they are told first, by components; of these only those with a source and a wanted node are searched.
    """
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w").unionByName(
        edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "w"))
    bound = F.lit(float("inf")) if cutoff is None else F.lit(float(cutoff))
    both = cut(both.filter(F.col("w") <= bound))
    if wanted is not None:
        sources, wanted = cut(sources.select("node").distinct()), cut(wanted.select("node").distinct())
        both, wanted = (cut(x) for x in _joined_parts(both, sources, wanted))
    length = both.agg(F.max("w").alias("longest"), F.avg("w").alias("mean")).first()
    longest = float(length.longest or 0.0)
    delta = delta or 8.0 * float(length.mean or 1.0)
    asked = wanted
    missing = asked.count() if asked is not None else None
    state = cut(sources.select("node", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh")).distinct())
    settled, recent, high = [], None, delta
    while True:
        facts = state.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fresh") & (F.col("dist") < high)).alias("moving"), F.min("dist").alias("near")).first()
        if facts.moving:
            moving = F.col("fresh") & (F.col("dist") < high)
            frontier = state.filter(moving).select(F.col("node").alias("u"), F.col("dist").alias("so_far"))
            offers = hashed_join(both, frontier, ["u"], "inner").select(F.col("v").alias("node"), (F.col("so_far") + F.col("w")).alias("dist"))
            offers = offers.filter(F.col("dist") <= bound).groupBy("node").agg(F.min("dist").alias("dist"))
            if recent is not None:
                offers = hashed_join(offers, recent.select("node"), ["node"], "left_anti")
            known = state.select("node", "dist", F.col("dist").alias("old"), (F.col("fresh") & ~moving).alias("waits"))
            met = known.unionByName(offers.select("node", "dist", F.lit(None).cast("double").alias("old"), F.lit(False).alias("waits")))
            met = met.groupBy("node").agg(F.min("dist").alias("dist"), F.min("old").alias("old"), F.max("waits").alias("waits"))
            state = cut(met.select("node", "dist", (F.col("waits") | F.col("old").isNull() | (F.col("dist") < F.col("old"))).alias("fresh")))
            continue
        if not facts.n or missing == 0:
            break
        if facts.near < high:
            done = cut(state.filter(F.col("dist") < high).select("node", "dist"))
            settled.append(done)
            state = cut(state.filter(F.col("dist") >= high))
            kept = done if recent is None else recent.unionByName(done)
            recent = cut(kept.filter(F.col("dist") >= high - longest))
            if asked is not None:
                missing -= done.join(asked, "node", "left_semi").count()
                if not missing:
                    break
        else:
            high = facts.near + delta
    out = settled[0] if settled else state.select("node", "dist")
    for done in settled[1:]:
        out = out.unionByName(done)
    return out


def network_coverage(
    incidents: DataFrame, cameras: DataFrame, nodes: DataFrame, edges: DataFrame, *,
    radius_m: float = V.CAMERA_RADIUS_M, snap_tol_m: float = V.SNAP_TOLERANCE_M, id_col: str = "id",
    camera_id: str = "camera_id",
) -> DataFrame:
    """``(id, covered)``: a camera within the radius along the streets.

    An incident farther than the snap tolerance from any node is judged by straight line; one
    on a node no camera reaches is uncovered. ``nodes(node, x, y)``.
    """
    at = lambda df, key: S.nearest(df, nodes, point_id=key, target_id="node")
    sources = at(cameras, camera_id).select("node").distinct()
    reached = multi_source_distance(edges, sources, radius_m).select("node", F.lit(True).alias("on_net"))
    snapped = at(incidents, id_col).select(id_col, "node", (F.col("dist_m") <= snap_tol_m).alias("reliable"))
    straight = S.within_radius(incidents, cameras, radius_m).select(id_col, F.lit(True).alias("straight"))
    judged = hashed_join(snapped, reached, ["node"], "left").join(straight, id_col, "left")
    covered = F.when(F.col("reliable"), F.coalesce("on_net", F.lit(False))).otherwise(F.coalesce("straight", F.lit(False)))
    return judged.select(id_col, covered.alias("covered"))


def snap_endpoints(ends: DataFrame, tol_m: float = V.ENDPOINT_SNAP_M, *, id_col: str = "end_id") -> DataFrame:
    """Line ends within the tolerance share their cluster's centroid: ``(end_id, cluster_id, x, y)``."""
    clustered = cluster_eps(ends, tol_m, id_col=id_col)
    centre = clustered.groupBy("cluster_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return clustered.join(centre, "cluster_id").select(
        id_col, "cluster_id", F.col("cx").alias("x"), F.col("cy").alias("y"))


def street_components(edges: DataFrame, min_edges: int = V.MIN_COMPONENT_EDGES) -> DataFrame:
    """Edges with their component, its size in edges, size rank and whether it is kept
    (large enough, or the largest)."""
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    comp = connected_components(nodes, links)
    keyed = hashed_join(edges, comp.select(F.col("node").alias("src"), "component"), ["src"], "inner")
    sizes = keyed.groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    largest = sizes.orderBy(F.desc("n_edges"), "component").limit(1).select(
        F.col("component"), F.lit(True).alias("largest"))
    sizes = sizes.join(F.broadcast(largest), "component", "left").withColumn(
        "kept", (F.col("n_edges") >= min_edges) | F.coalesce("largest", F.lit(False))).drop("largest")
    return hashed_join(keyed, sizes, ["component"], "inner")


def component_diagnostics(components: DataFrame) -> DataFrame:
    """Totals over components: number, largest, kept components and edges."""
    per = components.groupBy("component").agg(F.first("n_edges").alias("n_edges"), F.first("kept").alias("kept"))
    return per.agg(
        F.count(F.lit(1)).alias("n_components"), F.max("n_edges").alias("largest"),
        F.count_if("kept").alias("kept_components"), F.sum(F.when(F.col("kept"), F.col("n_edges"))).alias("kept_edges"),
        F.sum("n_edges").alias("n_edges"))


def hull_zone(points: DataFrame, by: str) -> DataFrame:
    """Convex hull vertices ``(zone_id, part, ring, seq, x, y)`` per area.

    Hulls are taken in three steps: a running hull per area over all batches of a task, then the
    hulls of groups of tasks, then those few corners per area. A hull of n points on a metre grid
    has far fewer corners than n, so no group grows with an area's points.
    """
    import pandas as pd

    def turn(o, a, b) -> float:
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(points_sorted) -> list:
        chain: list = []
        for p in points_sorted:
            while len(chain) >= 2 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    def corners(pdf: pd.DataFrame) -> list:
        pts = sorted(set(zip(pdf.x, pdf.y)))
        return pts if len(pts) < 3 else half(pts) + half(pts[::-1])

    def local(batches):
        held = {}
        for pdf in batches:
            for k, g in pdf.groupby(by):
                before = held.get(k)
                held[k] = corners(g if before is None else pd.concat([g, pd.DataFrame(before, columns=["x", "y"])]))
        rows = [(k, *p) for k, ring in held.items() for p in ring]
        yield pd.DataFrame(rows, columns=[by, "x", "y"])

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = corners(pdf)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(ring), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = corners(pdf)
        return pd.DataFrame({
            "zone_id": [str(pdf[by].iloc[0])] * len(ring), "part": 0, "ring": 0,
            "seq": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    slim = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    tasks = slim.mapInPandas(local, slim.schema).withColumn("_part", F.spark_partition_id() % 64)
    merged = tasks.groupBy(by, "_part").applyInPandas(middle, slim.schema)
    return merged.groupBy(by).applyInPandas(
        final, "zone_id string, part int, ring int, seq int, x double, y double")
