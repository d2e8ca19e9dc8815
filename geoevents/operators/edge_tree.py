"""Borders as trees of edge boxes, two of them descended together.

The edges of a ring come in drawing order, so eight consecutive ones make a chain with a small box, eight chains the next, up to the
whole ring. Two layers start with the ring pairs whose boxes come near each other; each round replaces both chains of an open pair by
their children and settles what the boxes decide. A round is a join on the chain, so no zone, ring or strip is one task's, and the work
grows with the places where borders come close instead of with all edge pairs. The number of rounds is the height of the tallest tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoevents.functions import geo as G
from geoevents.session import cut

#: A chain has two to this power children.
BITS = 3
RING = ("zone_id", "part", "ring")
#: Of a chain: its box, where it starts and ends, the weight of its ring, and the signed area under it above ``y0``.
BOX = ("minx", "miny", "maxx", "maxy")
CHAIN = (*BOX, "xs", "ys", "xe", "ye", "w", "area0", "y0")


def _cross() -> Column:
    return F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")


class Trees:
    """The trees of two layers of zones, sides ``a`` and ``b``, and the ring pairs to start with."""

    def __init__(self, left: DataFrame, right: DataFrame, near: float = 0.0):
        edges = left.select(F.lit("a").alias("side"), *RING, "seq", "x1", "y1", "x2", "y2").unionByName(
            right.select(F.lit("b").alias("side"), *RING, "seq", "x1", "y1", "x2", "y2"))
        role = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
        rings = edges.groupBy("side", *RING).agg(
            (F.signum(F.sum(_cross())) * F.first(role)).alias("w"), F.min("seq").alias("first"), F.max("seq").alias("last"),
            F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"),
            F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"))
        # the height of a ring's own tree: how often its last place can be halved, in steps of BITS
        bits = F.length(F.bin((F.col("last") - F.col("first")).cast("bigint")))
        self.rings = cut(rings.withColumn("top", F.greatest(F.lit(1), F.ceil(bits / F.lit(float(BITS)))).cast("int")))
        head = self.rings.agg(F.max("top").alias("top"), F.avg(F.col("maxx") - F.col("minx")).alias("width")).first()
        self.top, self.near = head.top or 0, near
        #: As wide as the mean ring: strips hold at most twice as many entries as there are rings.
        self.strip = max(head.width or 0.0, near) or 1.0
        self.nodes = cut(self._chains(edges)) if self.top else None

    def _chains(self, edges: DataFrame) -> DataFrame:
        known = self.rings.select("side", *RING, "w", "first", F.col("miny").alias("y0"))
        step = -(F.col("x2") - F.col("x1")) * F.col("w")
        edge = edges.join(known, ["side", *RING]).select(
            "side", *RING, (F.col("seq") - F.col("first")).cast("bigint").alias("chunk"), F.least("x1", "x2").alias("minx"),
            F.least("y1", "y2").alias("miny"), F.greatest("x1", "x2").alias("maxx"), F.greatest("y1", "y2").alias("maxy"),
            F.col("x1").alias("xs"), F.col("y1").alias("ys"), F.col("x2").alias("xe"), F.col("y2").alias("ye"), "w",
            (step * ((F.col("y1") + F.col("y2")) / 2 - F.col("y0"))).alias("area0"), "y0")
        if self.top == 1:
            return edge.withColumn("level", F.lit(0))
        upper = edge.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(1, self.top)])))
        upper = upper.groupBy("side", *RING, "level", F.expr(f"shiftright(chunk, level * {BITS})").alias("place")).agg(
            F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
            F.min_by(F.struct("xs", "ys"), "chunk").alias("s"), F.max_by(F.struct("xe", "ye"), "chunk").alias("e"),
            F.first("w").alias("w"), F.sum("area0").alias("area0"), F.first("y0").alias("y0"))
        upper = upper.select("side", *RING, F.col("place").alias("chunk"), *BOX, "s.xs", "s.ys", "e.xe", "e.ye", "w", "area0", "y0", "level")
        return edge.withColumn("level", F.lit(0)).unionByName(upper)

    def children(self, side: str, level: int) -> DataFrame:
        """The chains of one level with the place of their parent as ``up``."""
        return self.nodes.filter((F.col("side") == side) & (F.col("level") == level)).select(
            *RING, "chunk", F.shiftright("chunk", BITS).alias("up"), *CHAIN)

    def boxes_near(self) -> Column:
        """The boxes of ``a`` and ``b`` come within ``near`` of each other along both axes."""
        c, near = F.col, F.lit(float(self.near))
        return ((c("a_minx") - c("b_maxx") <= near) & (c("b_minx") - c("a_maxx") <= near)
                & (c("a_miny") - c("b_maxy") <= near) & (c("b_miny") - c("a_maxy") <= near))

    def ring_pairs(self) -> DataFrame:
        """Pairs of rings with boxes near each other, each met once, in the strip where the later one begins."""
        near = F.lit(float(self.near))

        def side(s: str, margin: Column) -> DataFrame:
            r = self.rings.filter(F.col("side") == s).select(*[F.col(c).alias(f"{s}_{c}") for c in (*RING, *BOX, "top")])
            strips = F.sequence(G.cell(F.col(f"{s}_minx") - margin, self.strip), G.cell(F.col(f"{s}_maxx") + margin, self.strip))
            return r.withColumns({f"{s}_chunk": F.lit(0).cast("bigint"), "strip": F.explode(strips)})

        met = side("a", near).join(side("b", F.lit(0.0)), "strip").filter(self.boxes_near())
        begins = G.cell(F.greatest(F.col("a_minx") - near, F.col("b_minx")), self.strip)
        return met.filter(F.col("strip") == begins).withColumn("start", F.greatest("a_top", "b_top")).drop("strip", "a_top", "b_top")

    def descend(self, pairs: DataFrame, level: int, keep: Column) -> DataFrame:
        """Pairs of chains of ``level`` below the given pairs, as far as ``keep`` holds; it is asked after each of the two joins."""
        for side in "ab":
            below = self.children(side, level)
            below = below.select(*[F.col(c).alias(f"{side}_{c}") for c in (*RING, "chunk", *CHAIN)], F.col("up").alias(f"{side}_up"))
            rest = [c for c in pairs.columns if c not in {f"{side}_{x}" for x in (*RING, "chunk", *CHAIN)}]
            pairs = pairs.select(*rest, *[F.col(f"{side}_{c}") for c in RING], F.col(f"{side}_chunk").alias(f"{side}_up")).join(
                below, [f"{side}_zone_id", f"{side}_part", f"{side}_ring", f"{side}_up"]).drop(f"{side}_up").filter(keep)
        return pairs


def _orientation(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def _ends(s: str) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    return (F.col(f"{s}_xs"), F.col(f"{s}_ys")), (F.col(f"{s}_xe"), F.col(f"{s}_ye"))


def _segments_meet() -> Column:
    """The two edges of a leaf pair, whose boxes meet, share a point (touching included)."""
    (a1, a2), (b1, b2) = _ends("a"), _ends("b")
    o1, o2 = _orientation(*a1, *a2, *b1), _orientation(*a1, *a2, *b2)
    o3, o4 = _orientation(*b1, *b2, *a1), _orientation(*b1, *b2, *a2)
    return (o1 * o2 <= 0) & (o3 * o4 <= 0)


def _segments_within(near: float) -> Column:
    (a1, a2), (b1, b2) = _ends("a"), _ends("b")
    d = [G.segment_distance(*p, *s1, *s2) for p, s1, s2 in ((a1, b1, b2), (a2, b1, b2), (b1, a1, a2), (b2, a1, a2))]
    return (F.least(*d) <= near) | _segments_meet()


def _spans(a: str, b: str, along: str, across: str) -> Column:
    """Chain ``a`` runs from one side of chain ``b``'s box to the other along one axis, and ``b`` does so with ``a``'s along the other."""
    def runs(s: str, t: str, axis: str) -> Column:
        lo, hi = F.least(f"{s}_{axis}s", f"{s}_{axis}e"), F.greatest(f"{s}_{axis}s", f"{s}_{axis}e")
        return (lo <= F.col(f"{t}_min{axis}")) & (hi >= F.col(f"{t}_max{axis}"))

    return runs(a, b, along) & runs(b, a, across)


def _surely(near: float) -> Column:
    """The chains meet, or are within ``near``, by their boxes and ends alone: they cross like the lines of a grid, or no two of
    their points can be further apart."""
    out = _spans("a", "b", "x", "y") | _spans("a", "b", "y", "x")
    if near > 0:
        far = lambda x: F.greatest(F.col(f"a_max{x}") - F.col(f"b_min{x}"), F.col(f"b_max{x}") - F.col(f"a_min{x}"))
        out = out | (F.hypot(far("x"), far("y")) <= near)
    return out


def borders_within(left: DataFrame, right: DataFrame, near: float = 0.0) -> DataFrame:
    """``(a_zone_id, b_zone_id)`` of zones whose borders share a point, or come within ``near``.

    A zone pair is settled as soon as one pair of chains proves it; its other pairs go no further down."""
    t = Trees(left, right, near)
    if not t.top:
        return t.rings.select(F.col("zone_id").alias("a_zone_id"), F.col("zone_id").alias("b_zone_id"))  # no rows
    starts, pairs, found = t.ring_pairs(), None, []
    if t.top > 1:
        starts = cut(starts)
    for level in range(t.top - 1, -1, -1):
        new = starts.filter(F.col("start") == level + 1).drop("start")
        pairs = new if pairs is None else pairs.unionByName(new, allowMissingColumns=True)
        if found:
            pairs = pairs.join(reduce(DataFrame.unionByName, found), ["a_zone_id", "b_zone_id"], "left_anti")
        pairs = t.descend(pairs, level, t.boxes_near())
        if level:
            pairs = cut(pairs.withColumn("sure", _surely(near)))
            found.append(pairs.filter("sure").select("a_zone_id", "b_zone_id").distinct())
            pairs = pairs.filter(~F.col("sure")).drop("sure")
        else:
            test = _segments_within(near) if near > 0 else _segments_meet()
            found.append(pairs.filter(test).select("a_zone_id", "b_zone_id"))
    return reduce(DataFrame.unionByName, found).distinct()


# ------------------------------------------------------------------ overlap area
def _sign(s: str) -> Column:
    """Weight of the region under a chain, between its ends, in the signed sum that makes its polygon."""
    return -F.signum(F.col(f"{s}xe") - F.col(f"{s}xs")) * F.col(f"{s}w")


def _height(s: str, x: Column) -> Column:
    c = lambda name: F.col(f"{s}{name}")
    return c("ys") + (x - c("xs")) * (c("ye") - c("ys")) / (c("xe") - c("xs")) - F.col("base")


def _leaf_areas(pairs: DataFrame) -> DataFrame:
    """Per pair of edges, the signed integral of the lower one over the stretch that both cover."""
    lo, hi = F.col("lo"), F.col("hi")
    p = pairs.withColumns({"lo": F.greatest("a_minx", "b_minx"), "hi": F.least("a_maxx", "b_maxx")})
    p = p.select("a_zone_id", "b_zone_id", (hi - lo).alias("width"), (_sign("a_") * _sign("b_")).alias("sign"), _height("a_", lo).alias("al"),
                 _height("a_", hi).alias("ar"), _height("b_", lo).alias("bl"), _height("b_", hi).alias("br"))
    dl, dr, width, t = F.col("al") - F.col("bl"), F.col("ar") - F.col("br"), F.col("width"), F.col("t")
    # where the lines cross, as a share of the width; at the end where they do not
    p = p.withColumns({"t": F.when(dl * dr < 0, dl / (dl - dr)).otherwise(1.0), "ml": F.least("al", "bl"), "mr": F.least("ar", "br")})
    p = p.withColumn("mid", F.when(t < 1, F.col("al") + t * (F.col("ar") - F.col("al"))).otherwise(F.col("mr")))
    area = ((F.col("ml") + F.col("mid")) * t + (F.col("mid") + F.col("mr")) * (F.lit(1.0) - t)) / 2 * width
    return p.select("a_zone_id", "b_zone_id", (F.col("sign") * area).alias("area"))


def _stretches(pairs: DataFrame, low: str, high: str) -> DataFrame:
    """Chain ``low`` lies wholly below chain ``high``: what remains is the area under ``low`` between the ends of ``high``."""
    return pairs.select(
        "a_zone_id", "b_zone_id", "base", F.lit(low).alias("side"), *[F.col(f"{low}_{c}").alias(c) for c in (*RING, "chunk", *CHAIN)],
        F.least(f"{high}_xs", f"{high}_xe").alias("lo"), F.greatest(f"{high}_xs", f"{high}_xe").alias("hi"),
        _sign(f"{high}_").alias("weight"))


def overlap_areas(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(a_zone_id, b_zone_id, area)`` of zones that overlap, in the square of the edge unit.

    A polygon is the signed sum of the regions under its edges, so the overlap is the signed sum over edge pairs of the region under
    both. Of two chains one wholly above the other, the lower alone counts, and the upper only by where it starts and ends: the area
    under whole chains is known, and only the chains at the two ends are descended. Holes and several parts are signs."""
    t = Trees(left, right)
    if not t.top:
        return t.rings.select(F.col("zone_id").alias("a_zone_id"), F.col("zone_id").alias("b_zone_id"), F.lit(0.0).alias("area"))  # no rows
    shared = F.least("a_maxx", "b_maxx") > F.greatest("a_minx", "b_minx")
    starts = t.ring_pairs().withColumn("base", F.greatest("a_miny", "b_miny"))
    if t.top > 1:
        starts = cut(starts)
    pairs, open_stretches, sums = None, None, []
    for level in range(t.top - 1, -1, -1):
        new = starts.filter(F.col("start") == level + 1).drop("start")
        pairs = new if pairs is None else pairs.unionByName(new, allowMissingColumns=True)
        pairs = t.descend(pairs, level, shared)
        stretches = None
        if open_stretches is not None:
            nodes = t.children("a", level).withColumn("side", F.lit("a")).unionByName(t.children("b", level).withColumn("side", F.lit("b")))
            stretches = open_stretches.select(
                "a_zone_id", "b_zone_id", "base", "side", *RING, F.col("chunk").alias("up"), "lo", "hi", "weight").join(
                nodes, ["side", *RING, "up"]).drop("up").filter(_reached())
        if level == 0:
            sums.append(_leaf_areas(pairs))
            if stretches is not None:
                sums.append(stretches.select("a_zone_id", "b_zone_id", _cut_edge_area().alias("area")))
            break
        pairs = cut(pairs)
        under, over = F.col("a_maxy") <= F.col("b_miny"), F.col("b_maxy") <= F.col("a_miny")
        fresh = _stretches(pairs.filter(under), "a", "b").unionByName(_stretches(pairs.filter(~under & over), "b", "a")).filter(_reached())
        stretches = cut(fresh if stretches is None else stretches.unionByName(fresh))
        whole = (F.col("lo") <= F.col("minx")) & (F.col("maxx") <= F.col("hi"))
        net = -(F.col("xe") - F.col("xs")) * F.col("w")
        sums.append(stretches.filter(whole).select(
            "a_zone_id", "b_zone_id", (F.col("weight") * (F.col("area0") + (F.col("y0") - F.col("base")) * net)).alias("area")))
        open_stretches, pairs = stretches.filter(~whole), pairs.filter(~under & ~over)
    out = reduce(DataFrame.unionByName, sums).groupBy("a_zone_id", "b_zone_id").agg(
        F.sum("area").alias("area"), F.sum(F.abs("area")).alias("moved"))
    # what is left of terms that cancel is no overlap
    return out.filter((F.col("area") > 1e-9) & (F.col("area") > F.col("moved") * 1e-13)).drop("moved")


def _reached() -> Column:
    return (F.col("lo") < F.col("maxx")) & (F.col("hi") > F.col("minx"))


def _cut_edge_area() -> Column:
    """Signed area under one edge between ``lo`` and ``hi``."""
    l, r = F.greatest("lo", "minx"), F.least("hi", "maxx")
    return F.col("weight") * _sign("") * (_height("", l) + _height("", r)) / 2 * (r - l)
