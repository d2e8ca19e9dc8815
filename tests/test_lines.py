"""Cutting, joining and simplifying lines against plain forms on small cases; one long line."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from geoevents.operators import lines as L
from geoevents.operators import spatial as S

SEGMENTS = "segment_id long, street_norm string, neighbourhood string, x1 double, y1 double, x2 double, y2 double"


def recursive(points, tolerance):
    """Places of the vertices that the recursive form keeps."""
    keep, spans = {0, len(points) - 1}, [(0, len(points) - 1)]
    while spans:
        i, j = spans.pop()
        (ax, ay), (bx, by) = points[i], points[j]
        best, off = None, tolerance
        for k in range(i + 1, j):
            rx, ry, length = points[k][0] - ax, points[k][1] - ay, (bx - ax) ** 2 + (by - ay) ** 2
            t = min(1.0, max(0.0, (rx * (bx - ax) + ry * (by - ay)) / length)) if length else 0.0
            d = math.hypot(rx - t * (bx - ax), ry - t * (by - ay))
            if d > off:
                best, off = k, d
        if best is not None:
            keep.add(best)
            spans += [(i, best), (best, j)]
    return keep


def test_simplify_as_the_recursive_form(spark):
    rng = np.random.default_rng(5)
    lines = {k: rng.normal(0, 1, (n, 2)).cumsum(axis=0) for k, n in enumerate((1, 2, 3, 40, 200))}
    lines[9] = np.array([(math.cos(a), math.sin(a)) for a in np.linspace(0, 2 * math.pi, 60)][:-1] + [(1.0, 0.0)])  # a ring: no length between its ends
    rows = [(k, i, float(x), float(y)) for k, xy in lines.items() for i, (x, y) in enumerate(xy)] + [(3, 10_000, None, 1.0)]
    frame = spark.createDataFrame(rows, "line_id int, seq int, x double, y double")
    for tolerance in (0.0, 0.3, 3.0):
        got = {(r.line_id, r.seq) for r in L.simplify_lines(frame, tolerance).collect()}
        assert got == {(k, i) for k, xy in lines.items() for i in recursive(xy.tolist(), tolerance)}
    assert L.simplify_lines(frame.limit(0), 1.0).count() == 0


def test_a_line_of_a_million_vertices(spark):
    """Stairs of 1000 vertices each stay at their corners only; the line is never one task's."""
    x = F.col("id").cast("double")
    stairs = spark.range(1_000_000).select(F.lit(1).alias("line_id"), F.col("id").alias("seq"), x.alias("x"), (F.floor(x / 200_000) * 1e6).alias("y"))
    got = [r.seq for r in L.simplify_lines(stairs, 10.0).orderBy("seq").collect()]
    assert got == sorted({0, 999_999, *[k * 200_000 - 1 for k in range(1, 5)], *[k * 200_000 for k in range(1, 5)]})


def chains(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.g, r.line, r.seq)):
        out.setdefault((r.g, r.line), []).append((r.x, r.y))
        assert r.seq == len(out[r.g, r.line]) - 1
    return sorted(tuple(v) for v in out.values())


def test_joining_segments(spark):
    """A long chain in any order and direction, a fork, a ring, a segment alone, a loop of two, and the same places in another group."""
    rng = random.Random(2)
    chain = [(float(k), float(k * 7 % 5)) for k in range(300)]
    ring = [(1000.0, 0.0), (1001.0, 0.0), (1001.0, 1.0), (1000.0, 1.0), (999.0, 0.5)]
    fork = [((2000.0, 0.0), (2001.0, 0.0)), ((2001.0, 0.0), (2002.0, 1.0)), ((2002.0, 1.0), (2003.0, 1.0)), ((2001.0, 0.0), (2002.0, -1.0))]
    segments = [("a", *s) for s in [*zip(chain, chain[1:]), *zip(ring, ring[1:] + ring[:1]), *fork, ((3000.0, 0.0), (3001.0, 0.0)),
                                    ((4000.0, 0.0), (4001.0, 0.0)), ((4001.0, 0.0), (4000.0, 0.0)), ((5000.0, 0.0), (5000.0, 0.0))]]
    segments += [("b", *s) for s in zip(chain[:3], chain[1:4])]
    rows = [(g, *p, *q) if rng.random() < 0.5 else (g, *q, *p) for g, p, q in segments]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, x1 double, y1 double, x2 double, y2 double")
    got = chains(L.merge_segments(frame.repartition(5), ["g"]).collect())
    rings = [c for c in got if c[0] == c[-1]]
    assert sorted(c for c in got if c[0] != c[-1]) == sorted([
        tuple(chain), tuple(chain[:4]), ((2000.0, 0.0), (2001.0, 0.0)), ((2001.0, 0.0), (2002.0, 1.0), (2003.0, 1.0)), ((2001.0, 0.0), (2002.0, -1.0)),
        ((3000.0, 0.0), (3001.0, 0.0))])
    assert sorted(len(c) for c in rings) == [3, 6] and {p for c in rings for p in c} == {*ring, (4000.0, 0.0), (4001.0, 0.0)}
    at = {p: k for k, p in enumerate(ring)}
    around = next(c for c in rings if len(c) == 6)
    assert len({(at[q] - at[p]) % 5 for p, q in zip(around, around[1:])}) == 1


def test_lines_never_leave_their_zone(spark):
    edges = spark.createDataFrame([("L", *e) for e in [(0., 0., 8., 0.), (8., 0., 8., 4.), (8., 4., 4., 4.), (4., 4., 4., 9.), (4., 9., 0., 9.), (0., 9., 0., 0.)]],
                                  "zone_id string, x1 double, y1 double, x2 double, y2 double")
    index = S.zone_index(edges, cell_size=1.0)
    drawn = [(1, "rua a", "Centro", -2., 6., 9., 6.), (2, "rua a", "Centro", 9., 6., 9., 2.), (3, "rua a", "Centro", 9., 2., -3., 2.),
             (4, "rua b", "Norte", 1., 1., 2., 3.), (5, "rua c", "centro", 20., 20., 30., 30.), (6, "rua b", "Sul", 2., 3., 3., 1.)]
    segments = spark.createDataFrame(drawn, SEGMENTS)
    streets = spark.createDataFrame([("L", "Rua A"), ("L", "rua b"), ("L", "rua c")], "zone_id string, street string")
    got = {}
    for r in L.street_lines(streets, segments, edges, index, cell_size=1.0).orderBy("street_norm", "line", "seq").collect():
        got.setdefault((r.street_norm, r.line), []).append((r.x, r.y))
    assert got == {("rua a", 1): [(0.0, 2.0), (8.0, 2.0)], ("rua a", 2): [(0.0, 6.0), (4.0, 6.0)], ("rua b", 1): [(1.0, 1.0), (2.0, 3.0), (3.0, 1.0)]}
    near = spark.createDataFrame([("L", "CENTRO"), ("L", "norte")], "zone_id string, neighbourhood string")
    limited = L.street_lines(streets, segments, edges, index, cell_size=1.0, neighbourhoods=near, tolerance=0.01).filter("street_norm = 'rua b'")
    assert [(r.x, r.y) for r in limited.orderBy("seq").collect()] == [(1.0, 1.0), (2.0, 3.0)]
