"""Edge trees against all edge pairs, on random zones with holes and parts, and on borders of many edges."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoevents.operators import edge_tree, overlap
from geoevents.sources.polygons import EDGE_SCHEMA


def star(rng, zone, x, y, size, n, part=0, ring=0, turn=1):
    """A ring of n corners around a middle, drawn either way."""
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))[::turn]
    r = size * rng.uniform(0.5, 1.0, n)
    px, py = x + r * np.cos(angle), y + r * np.sin(angle)
    return [(zone, part, ring, i, float(px[i]), float(py[i]), float(px[(i + 1) % n]), float(py[(i + 1) % n])) for i in range(n)]


def layer(rng, name, zones):
    """Zones with one or two parts, some of them with a hole, of 3 to some 200 corners."""
    out = []
    for k in range(zones):
        x, y = rng.uniform(0, 100, 2)
        out += star(rng, f"{name}{k}", x, y, 14, int(rng.integers(3, 200)), turn=1 if k % 2 else -1)
        if k % 3 == 0:
            out += star(rng, f"{name}{k}", x, y, 3.0, int(rng.integers(3, 90)), ring=1, turn=-1 if k % 4 else 1)
        if k % 4 == 0:
            out += star(rng, f"{name}{k}", x + 40, y, 6, int(rng.integers(3, 30)), part=1)
    return out


def by_zone(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def plain_area(a, b):
    """Sum over all edge pairs of the signed region under both, by plain arithmetic."""
    def signed(rows):
        turn = {}
        for _, part, ring, _, x1, y1, x2, y2 in rows:
            turn[part, ring] = turn.get((part, ring), 0.0) + x1 * y2 - x2 * y1
        return [(*(((x1, y1), (x2, y2)) if x1 < x2 else ((x2, y2), (x1, y1))),
                 -math.copysign(1, x2 - x1) * math.copysign(1, turn[part, ring]) * (-1 if ring else 1))
                for _, part, ring, _, x1, y1, x2, y2 in rows if x1 != x2]

    total = 0.0
    for p, q, s in signed(a):
        for u, v, t in signed(b):
            lo, hi = max(p[0], u[0]), min(q[0], v[0])
            if lo >= hi:
                continue
            at = lambda m, n, x: m[1] + (x - m[0]) * (n[1] - m[1]) / (n[0] - m[0])
            cuts = [lo, hi]
            d1, d2 = at(p, q, lo) - at(u, v, lo), at(p, q, hi) - at(u, v, hi)
            if d1 * d2 < 0:
                cuts.insert(1, lo + (hi - lo) * d1 / (d1 - d2))
            low = [min(at(p, q, x), at(u, v, x)) for x in cuts]
            total += s * t * sum((low[i] + low[i + 1]) / 2 * (cuts[i + 1] - cuts[i]) for i in range(len(cuts) - 1))
    return total


def plain_gap(a, b):
    """Least distance of two borders, 0 where they meet."""
    def turn(p, q, r):
        return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    def to_segment(p, u, v):
        d = (v[0] - u[0]) ** 2 + (v[1] - u[1]) ** 2
        t = max(0, min(1, ((p[0] - u[0]) * (v[0] - u[0]) + (p[1] - u[1]) * (v[1] - u[1])) / d))
        return math.hypot(p[0] - u[0] - t * (v[0] - u[0]), p[1] - u[1] - t * (v[1] - u[1]))

    best = math.inf
    for *_, x1, y1, x2, y2 in a:
        p, q = (x1, y1), (x2, y2)
        for *_, x3, y3, x4, y4 in b:
            u, v = (x3, y3), (x4, y4)
            if turn(p, q, u) * turn(p, q, v) < 0 and turn(u, v, p) * turn(u, v, q) < 0:
                return 0.0
            best = min(best, to_segment(p, u, v), to_segment(q, u, v), to_segment(u, p, q), to_segment(v, p, q))
    return best


@pytest.fixture(scope="module")
def layers():
    rng = np.random.default_rng(5)
    return layer(rng, "a", 9), layer(rng, "b", 9)


def test_areas_and_distances_equal_all_pairs(spark, layers):
    left, right = (spark.createDataFrame(rows, EDGE_SCHEMA) for rows in layers)
    a, b = map(by_zone, layers)
    got = {(r.a_zone_id, r.b_zone_id): r.area for r in overlap.zone_overlap_area(left, right).collect()}
    want = {(i, j): plain_area(a[i], b[j]) for i in a for j in b}
    want = {k: v for k, v in want.items() if v > 1e-6}
    assert len(want) > 5 and set(got) == set(want)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    gap = {(i, j): plain_gap(a[i], b[j]) for i in a for j in b}
    for near in (0.0, 4.0):
        met = {(r.a_zone_id, r.b_zone_id) for r in edge_tree.borders_within(left, right, near).collect()}
        assert met == {k for k, d in gap.items() if d <= near}


def comb(spark, zone, teeth, low, high, floor):
    """A zone under a saw of 2 * teeth edges between x = 0 and x = teeth, closed along ``floor``; all in one ring."""
    k = F.col("id")
    corner = lambda i: (i / 2, F.when(i % 2 == 0, F.lit(float(low))).otherwise(F.lit(float(high))))
    (x1, y1), (x2, y2) = corner(k), corner(k + 1)
    saw = spark.range(2 * teeth).select(
        F.lit(zone).alias("zone_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), k.cast("int").alias("seq"),
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    n, right = 2 * teeth, float(teeth)
    close = [(zone, 0, 0, n, right, float(low), right, float(floor)), (zone, 0, 0, n + 1, right, float(floor), 0.0, float(floor)),
             (zone, 0, 0, n + 2, 0.0, float(floor), 0.0, float(low))]
    return saw.unionByName(spark.createDataFrame(close, EDGE_SCHEMA))


@pytest.mark.parametrize("lift, meets", [(0.5, True), (2.0, False)])
def test_two_borders_of_many_edges(spark, lift, meets):
    """100,000 edges each, one beside the other all along: area in closed form, border pairs decided early."""
    teeth = 50_000
    a = comb(spark, "a", teeth, 10.0, 11.0, 0.0)
    b = comb(spark, "b", teeth, 10.0 + lift, 11.0 + lift, 5.0)
    began = time.time()
    got = overlap.zone_overlap_area(a, b).first().area
    assert math.isclose(got, teeth * 5.5, rel_tol=1e-9)       # a's saw is the lower one everywhere
    # b's floor lies in the teeth of a, or just above them
    over = comb(spark, "b", teeth, 20.0, 21.0, 10.0 + lift)
    assert edge_tree.borders_within(a, over).count() == meets
    assert edge_tree.borders_within(a, over, 1.5).count() == 1
    assert time.time() - began < 240


def test_empty_and_single(spark):
    none = spark.createDataFrame([], EDGE_SCHEMA)
    one = spark.createDataFrame([("a", 0, 0, i, *e) for i, e in enumerate([(0., 0., 1., 0.), (1., 0., 1., 1.), (1., 1., 0., 0.)])], EDGE_SCHEMA)
    for left, right in ((none, none), (one, none), (none, one)):
        assert overlap.zone_overlap_area(left, right).count() == 0 and edge_tree.borders_within(left, right).count() == 0
    assert math.isclose(overlap.zone_overlap_area(one, one).first().area, 0.5)
