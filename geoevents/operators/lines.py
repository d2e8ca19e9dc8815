"""Street lines: cutting segments at zone borders, joining segments to lines, simplifying lines.

Lines are tables of segments or vertices and never one value: a line of any length is spread over tasks. Joining is list ranking by
pointer doubling, simplifying goes level by level over all lines at once; both write their state out between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoevents.functions import geo as G
from geoevents.functions import text as X
from geoevents.operators import spatial as S
from geoevents.session import cut, hashed_join


# ------------------------------------------------------------------ cutting at borders
def _cells_passed(segments: DataFrame, size: float) -> DataFrame:
    """Segments copied to the cells they pass through, row by row."""
    rim = F.lit(size * 1e-6)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    out = segments.withColumn("iy", F.explode(F.sequence(G.cell(low - rim, size), G.cell(high + rim, size))))
    at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    level = F.col("y1") == F.col("y2")
    xa = F.when(level, F.col("x1")).otherwise(at(F.greatest(low, F.col("iy") * F.lit(size) - rim)))
    xb = F.when(level, F.col("x2")).otherwise(at(F.least(high, (F.col("iy") + 1) * F.lit(size) + rim)))
    return out.withColumn("ix", F.explode(F.sequence(G.cell(F.least(xa, xb) - rim, size), G.cell(F.greatest(xa, xb) + rim, size))))


def clip_segments(segments: DataFrame, edges: DataFrame, index: DataFrame, *, key: str = "segment_id",
                  cell_size: float = S.CELL_DEG) -> DataFrame:
    """The parts of segments that lie inside zones, each with its ``zone_id`` and ``piece`` (its place along the segment).

    ``segments(key, x1, y1, x2, y2, …)`` in the unit of ``edges``; ``index`` is the edges' zone index. A segment is cut where it
    crosses a border of any zone, so a piece crosses none, and its middle tells the zones it lies in. A segment in several zones
    gives pieces to each. Segments along a border belong to the side that its middle belongs to.
    """
    own = segments.select(key, "x1", "y1", "x2", "y2")
    passed = _cells_passed(own, cell_size)
    borders = _cells_passed(edges.select("x1", "y1", "x2", "y2").distinct(), cell_size).select(
        "ix", "iy", *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    met = hashed_join(passed, borders, ["ix", "iy"], "inner")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    side = lambda n: dx * (F.col(f"_y{n}") - F.col("y1")) - dy * (F.col(f"_x{n}") - F.col("x1"))
    ex, ey = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    t = ((F.col("_x1") - F.col("x1")) * ey - (F.col("_y1") - F.col("y1")) * ex) / (dx * ey - dy * ex)
    crossed = met.filter((side(1) > 0) != (side(2) > 0)).select(key, t.alias("t")).filter((F.col("t") > 0) & (F.col("t") < 1))
    cuts = crossed.groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("cuts"))
    stops = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    spans = F.transform(F.sequence(F.lit(1), F.size("stops") - 1),
                        lambda i: F.struct(F.element_at("stops", i).alias("a"), F.element_at("stops", i + 1).alias("b")))
    whole = segments.join(cuts, key, "left").withColumn("stops", stops).select("*", F.posexplode(spans).alias("piece", "s"))
    at = lambda c, share: F.when(share == 0.0, F.col(f"{c}1")).when(share == 1.0, F.col(f"{c}2")).otherwise(
        F.col(f"{c}1") + share * (F.col(f"{c}2") - F.col(f"{c}1")))
    ends = {f"_{c}{n}": at(c, F.col(f"s.{e}")) for c in "xy" for n, e in ((1, "a"), (2, "b"))}
    pieces = whole.withColumns(ends).drop("x1", "y1", "x2", "y2", "stops", "cuts", "s").withColumnsRenamed(
        {f"_{c}{n}": f"{c}{n}" for c in "xy" for n in (1, 2)})
    middle = pieces.withColumns({"lon": (F.col("x1") + F.col("x2")) / 2, "lat": (F.col("y1") + F.col("y2")) / 2})
    return S.join_points_to_zones(middle, index, how="inner", cell_size=cell_size).drop("lon", "lat")


# ------------------------------------------------------------------ joining segments
def _ranked(arcs: DataFrame) -> DataFrame:
    """List ranking: ``arcs(arc, next)`` to ``(arc, last, hops)``, the end of the chain that an arc leads to and how far it is.

    In each round an arc points to where the arc it pointed to points, so a chain of n arcs takes log n rounds. Rings have no end:
    every arc learns the least arc ahead, and when neither an end comes nearer nor a lower arc appears, only rings are left. A
    ring is opened before its least arc, its reverse behind the reverse of that arc, and ranked again.
    """
    done = None
    state = cut(arcs.select("arc", F.coalesce("next", "arc").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
                            F.col("next").isNull().alias("ended"), F.least("arc", F.coalesce("next", "arc")).alias("low")))
    while True:
        before = state.filter("not ended").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).first()
        if not before.n:
            return state.select("arc", F.col("to").alias("last"), "hops") if done is None else done.unionByName(state.select("arc", F.col("to").alias("last"), "hops"))
        ahead = state.select(F.col("arc").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("ended").alias("_ended"), F.col("low").alias("_low"))
        state = cut(hashed_join(state, ahead, ["to"], "inner").select(
            "arc", F.col("_to").alias("to"), F.when(F.col("ended"), F.col("hops")).otherwise(F.col("hops") + F.col("_hops")).alias("hops"),
            (F.col("ended") | F.col("_ended")).alias("ended"), F.when(F.col("ended"), F.col("low")).otherwise(F.least("low", "_low")).alias("low")))
        after = state.filter("not ended").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).first()
        if after.n == before.n and after.low == before.low:
            ends = state.filter("ended").select("arc", F.col("to").alias("last"), "hops")
            done = ends if done is None else done.unionByName(ends)
            # a ring and its reverse share the least segment; the even arc of it opens one, the odd arc the other
            rings = hashed_join(state.filter("not ended").select("arc", "low"), arcs, ["arc"], "inner")
            first = F.col("low") - F.col("low") % 2
            opened = (F.col("next") == first) | (F.col("arc") == first + 1)
            fresh = rings.withColumn("next", F.when(~opened, F.col("next"))).select("arc", "next")
            arcs = cut(fresh)
            state = cut(arcs.select("arc", F.coalesce("next", "arc").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
                                    F.col("next").isNull().alias("ended"), F.least("arc", F.coalesce("next", "arc")).alias("low")))


def merge_segments(segments: DataFrame, by: list[str]) -> DataFrame:
    """Segments to lines: ``(by, line, seq, x, y)``, vertices in order, lines numbered from 1 within their group.

    Segments that meet alone in a place (two ends and no third, of one group) follow each other in a line; other places end lines.
    A line starts at the smaller of its ends (x, then y), lines are numbered by start and end; a ring starts anywhere on it, its
    last vertex is its first. Segments without length are left out, repeated ones count as often as they stand.
    """
    rows = cut(segments.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))).select(
        *by, "x1", "y1", "x2", "y2", F.monotonically_increasing_id().alias("_s")))
    # a segment gives two arcs, there (even) and back (odd); ``arc`` leaves the place it stands at
    end = lambda n, arc: rows.select(*by, F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y"), arc.alias("arc"))
    there = F.col("_s") * 2
    places = end(1, there).unionByName(end(2, there + 1)).groupBy(*by, "x", "y").agg(
        F.count(F.lit(1)).alias("n"), F.min("arc").alias("a"), F.max("arc").alias("b")).filter("n = 2")
    back = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("bigint"))
    follows = F.explode(F.array(F.struct(back("a").alias("arc"), F.col("b").alias("next")), F.struct(back("b").alias("arc"), F.col("a").alias("next"))))
    links = places.select(follows.alias("f")).select("f.arc", "f.next").filter("arc <> next")
    arcs = rows.select(F.explode(F.array(there, there + 1)).alias("arc"))
    ranked = cut(_ranked(cut(arcs.join(links, "arc", "left"))))
    heads = rows.select(*by, F.explode(F.array(
        F.struct(there.alias("arc"), F.col("x1").alias("tx"), F.col("y1").alias("ty"), F.col("x2").alias("hx"), F.col("y2").alias("hy")),
        F.struct((there + 1).alias("arc"), F.col("x2").alias("tx"), F.col("y2").alias("ty"), F.col("x1").alias("hx"), F.col("y1").alias("hy")))).alias("h")
    ).select(*by, "h.*")
    ends = heads.select(F.col("arc").alias("last"), F.struct("hx", "hy").alias("end"))
    told = ranked.join(ends, "last")
    other = told.select(back("arc").alias("arc"), F.col("end").alias("start"), F.col("last").alias("first_back"), F.col("hops").alias("before"))
    ways = told.join(other, "arc")
    # every line is told twice, from either end: keep the one that starts at the smaller end
    ways = ways.filter((F.col("start") < F.col("end")) | ((F.col("start") == F.col("end")) & (
        (F.col("last") < F.col("first_back")) | ((F.floor(F.col("last") / 2) == F.floor(F.col("first_back") / 2)) & (F.col("last") % 2 == 0)))))
    full = ways.join(heads, "arc").select(*by, "start", "end", "last", F.col("before").alias("pos"), "tx", "ty", "hx", "hy")
    names = full.select(*by, "start", "end", "last").distinct().withColumn(
        "line", F.row_number().over(Window.partitionBy(*by).orderBy("start", "end", "last")))
    full = hashed_join(full, names.select("last", "line"), ["last"], "inner")
    vertex = lambda seq, x, y: F.struct(seq.cast("bigint").alias("seq"), F.col(x).alias("x"), F.col(y).alias("y"))
    both = F.when(F.col("pos") == 0, F.array(vertex(F.lit(0), "tx", "ty"), vertex(F.lit(1), "hx", "hy"))).otherwise(
        F.array(vertex(F.col("pos") + 1, "hx", "hy")))
    return full.select(*by, "line", F.explode(both).alias("v")).select(*by, "line", "v.*")


# ------------------------------------------------------------------ simplifying
def simplify_lines(vertices: DataFrame, tolerance: float, *, line_id: str | list[str] = "line_id", digits: int | None = None) -> DataFrame:
    """Douglas–Peucker over all lines at once: ``(line_id, seq, x, y)`` of the vertices that stay.

    Every vertex between two kept ones carries that span's ends. A round takes the farthest vertex of each open span; beyond the
    tolerance it stays and parts the span, else the span is closed and its vertices go. Rounds are as many as the recursive form
    is deep. A line is never gathered: the farthest vertex is a partial aggregate, and spans are joined back by their key.
    ``seq`` orders a line (equal ones by x, then y); rows without coordinates are left out; ties keep the first vertex.
    """
    by = [line_id] if isinstance(line_id, str) else line_id
    at = F.struct("seq", "x", "y")
    rows = cut(vertices.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *by, "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("at", at))
    ends = rows.groupBy(*by).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    kept = ends.select(*by, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("at"))
    open_ = cut(hashed_join(rows.select(*by, "at"), ends, by, "inner").filter((F.col("at") > F.col("lo")) & (F.col("at") < F.col("hi"))))
    cx, cy = F.col("hi.x") - F.col("lo.x"), F.col("hi.y") - F.col("lo.y")
    rx, ry = F.col("at.x") - F.col("lo.x"), F.col("at.y") - F.col("lo.y")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(rx * cx + ry * cy, cx * cx + cy * cy), F.lit(0.0))))
    off = F.sqrt((rx - t * cx) * (rx - t * cx) + (ry - t * cy) * (ry - t * cy))
    while not open_.isEmpty():
        spans = open_.withColumn("off", off).groupBy(*by, "lo").agg(F.max("off").alias("off"), F.min_by("at", F.struct(-F.col("off"), "at")).alias("mid"))
        parted = cut(spans.filter(F.col("off") > tolerance).select(*by, "lo", "mid"))
        kept = kept.unionByName(parted.select(*by, F.col("mid").alias("at")))
        inside = hashed_join(open_, parted, [*by, "lo"], "inner").filter(F.col("at") != F.col("mid"))
        left = F.col("at") < F.col("mid")
        open_ = cut(inside.select(*by, "at", F.when(left, F.col("lo")).otherwise(F.col("mid")).alias("lo"),
                                  F.when(left, F.col("mid")).otherwise(F.col("hi")).alias("hi")))
    shown = lambda c: F.round(f"at.{c}", digits) if digits is not None else F.col(f"at.{c}")
    return kept.select(*by, "at.seq", shown("x").alias("x"), shown("y").alias("y"))


# ------------------------------------------------------------------ streets
def street_lines(
    streets: DataFrame, segments: DataFrame, edges: DataFrame, index: DataFrame, *, street: str = "street", key: str = "segment_id",
    neighbourhoods: DataFrame | None = None, tolerance: float | None = None, cell_size: float = S.CELL_DEG,
) -> DataFrame:
    """Lines of the given streets inside their zones: ``(zone_id, street_norm, line, seq, x, y)``.

    ``streets(zone_id, street)`` are matched by name as in ``match_streets_to_lines``; ``segments(key, street_norm, x1 … y2)`` are cut at
    the zones' borders, joined to lines and, with a ``tolerance``, simplified. ``neighbourhoods(zone_id, neighbourhood)`` limits a
    zone to segments of these neighbourhoods, whatever their case.
    """
    wanted = streets.select("zone_id", X.norm_street(F.col(street)).alias("_k1")).withColumn("_k2", X.dedupe_leading_prefix(F.col("_k1")))
    known = segments.select("street_norm").distinct()
    hit = lambda k: known.select(F.col("street_norm").alias(k), F.lit(True).alias(f"{k}_hit"))
    named = F.when(F.col("_k1_hit"), F.col("_k1")).when(F.col("_k2_hit"), F.col("_k2"))
    names = wanted.join(hit("_k1"), "_k1", "left").join(hit("_k2"), "_k2", "left").select("zone_id", named.alias("street_norm"))
    names = names.filter("street_norm is not null").distinct()
    asked = hashed_join(segments, names.select("street_norm").distinct(), ["street_norm"], "left_semi")
    inside = hashed_join(clip_segments(asked, edges, index, key=key, cell_size=cell_size), names, ["zone_id", "street_norm"], "left_semi")
    if neighbourhoods is not None:
        near = neighbourhoods.select("zone_id", F.lower("neighbourhood").alias("_nb")).distinct()
        inside = inside.withColumn("_nb", F.lower("neighbourhood")).join(near, ["zone_id", "_nb"], "left_semi").drop("_nb")
    lines = merge_segments(inside, ["zone_id", "street_norm"])
    return lines if tolerance is None else simplify_lines(lines, tolerance, line_id=["zone_id", "street_norm", "line"])
