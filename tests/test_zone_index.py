"""The zone index against casting a ray over all edges; its size; a zone with a million edges."""

import math
import random

from pyspark.sql import functions as F

from geoevents.operators import spatial as S

EDGES = "zone_id string, x1 double, y1 double, x2 double, y2 double"


def ring(points):
    return list(zip(points, points[1:] + points[:1]))


def edges_of(spark, zones):
    return spark.createDataFrame([(z, *map(float, (*a, *b))) for z, rings in zones.items() for r in rings for a, b in ring(r)], EDGES)


def plain(point, rings):
    x, y = point
    return sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for r in rings for (x1, y1), (x2, y2) in ring(r)) % 2 == 1


def joined(spark, zones, points, size):
    index = S.zone_index(edges_of(spark, zones), cell_size=size)
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, lon double, lat double")
    return {(r.id, r.zone_id) for r in S.join_points_to_zones(rows, index, how="inner", cell_size=size).collect()}


def star(rng, n, x, y, r):
    return [(x + r * rng.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def test_random_polygons_with_holes(spark):
    rng = random.Random(3)
    zones = {f"s{k}": [star(rng, rng.choice([3, 5, 40]), rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(0.05, 2.5))] for k in range(12)}
    zones["ring"] = [[(-2.5, -2.5), (2.5, -2.5), (2.5, 2.5), (-2.5, 2.5)], [(-1.3, -1.1), (1.2, -1.4), (1.1, 1.3), (-1.2, 1.2)]]
    zones["two parts"] = [[(-3, -3), (-2, -3), (-2, -2)], [(2, 2), (3, 2), (3, 3)]]
    points = [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(1500)] + [v for rings in zones.values() for r in rings for v in r]
    want = {(i, z) for i, p in enumerate(points) for z, rings in zones.items() if plain(p, rings)}
    for size in (0.1, 0.7, 50.0):
        assert joined(spark, zones, points, size) == want


def test_borders_on_cell_borders(spark):
    """Corners, sides and points all on whole numbers, which are cell borders too: low sides in, high sides out."""
    zones = {"L": [[(0, 0), (8, 0), (8, 4), (4, 4), (4, 9), (0, 9)]], "hole": [[(2, 2), (40, 2), (40, 7), (2, 7)], [(3, 3), (3, 5), (5, 5), (5, 3)]],
             "slope": [[(0, 0), (6, 6), (0, 6)]]}
    points = [(float(x), float(y)) for x in range(-1, 43) for y in range(-1, 11)] + [(x + 0.5, float(y)) for x in range(9) for y in range(10)]
    want = {(i, z) for i, p in enumerate(points) for z, rings in zones.items() if plain(p, rings)}
    for size in (1.0, 2.0, 0.5):
        assert joined(spark, zones, points, size) == want


def test_entries_grow_with_the_border(spark):
    """Cells inside share entries, up to 64 of a row; a square of side n has about 4 n border cells and n * n inside."""
    for side in (100, 200):
        square = {"a": [[(0.5, 0.5), (side + 0.5, 0.5), (side + 0.5, side + 0.5), (0.5, side + 0.5)]]}
        entries = S.zone_index(edges_of(spark, square), cell_size=1.0).agg(F.sum(F.size("cands"))).first()[0]
        assert entries <= 3 * 4 * side


def test_a_zone_of_a_million_edges(spark):
    n, turn = 1_000_000, 2 * math.pi / 1_000_000
    at = lambda k: (F.cos(k * turn), F.sin(k * turn))
    (x1, y1), (x2, y2) = at(F.col("id")), at((F.col("id") + 1) % n)
    circle = spark.range(n).select(F.lit("c").alias("zone_id"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    index = S.zone_index(circle, cell_size=0.01)
    points = spark.range(20_000).select(((F.col("id") * 7919 % 20_011) / 8000.0 - 1.25).alias("lon"), ((F.col("id") * 104_729 % 20_021) / 8000.0 - 1.25).alias("lat"))
    r = F.sqrt(F.col("lon") * F.col("lon") + F.col("lat") * F.col("lat"))
    got = S.join_points_to_zones(points.filter(F.abs(r - 1) > 1e-9), index, how="left", cell_size=0.01)
    assert got.filter(F.col("zone_id").isNotNull() != (r < 1)).count() == 0 and got.filter("zone_id is not null").count() > 5000
