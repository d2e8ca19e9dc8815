"""Cases of the third round's findings: whole results, and steps that stay small on large inputs."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from geoevents.operators import census, graph, spatial


def test_regions_list_all_their_members(spark):
    rows = [("a", "Norte", 5, 4, 2.0, 1.0), ("b", "norte", 9, 4, 3.0, 2.0), ("c", "NORTE", 5, 1, 0.0, 3.0), ("d", "Sul", 1, 1, 1.0, 4.0)]
    metrics = spark.createDataFrame(rows, "name string, region string, pop_2022 long, pop_2010 long, density double, change_pct double")
    got = {r.region_key: [m.name for m in r.members] for r in census.region_aggregate(metrics).collect()}
    assert got == {"norte": ["b", "a", "c"], "sul": ["d"]}
    listed = entry.queries()["region_aggregate"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_members for r in listed) == 25 and all(len(r.members.split("|")) == r.n_members for r in listed)


def test_nearest_finds_points_on_targets_and_beyond_the_first_look(spark):
    """Points on a target, beside it, in a crowd and far from all; brute force says the same."""
    rng = random.Random(8)
    targets = [(k, 600_000 + rng.random() * 9000, 7_400_000 + rng.random() * 9000) for k in range(400)]
    targets += [(1000 + k, 640_000 + rng.random(), 7_400_000 + rng.random()) for k in range(300)] + [(5000, *targets[7][1:])]
    points = [(k, *t[1:]) for k, t in enumerate(targets)]
    points += [(10_000 + k, 590_000 + rng.random() * 60_000, 7_390_000 + rng.random() * 30_000) for k in range(300)]
    got = {r.id: r for r in spatial.nearest(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(targets, "tid long, x double, y double"),
                                            point_id="id", target_id="tid").collect()}
    assert len(got) == len(points)
    for k, x, y in points:
        d, t = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, t) for t, a, b in targets)
        assert abs(got[k].dist_m - d) < 1e-9 and got[k].tid == t


def test_near_any_meets_equal_places_once(spark):
    """A million incidents in ten places: what is written out to be joined is the places."""
    inc = spark.range(1_000_000).select(F.concat(F.lit("s"), F.col("id") % 5).alias("street"), (F.col("id") % 10 * 1000.0).alias("x"), F.lit(0.0).alias("y"))
    units = inc.groupBy("street").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).unionByName(
        spark.createDataFrame([("", 50.0, 0.0), ("lone", 6060.0, 0.0), ("none", None, None)], "street string, x double, y double"))
    others = spark.createDataFrame([(6050.0, 0.0), (None, None)], "x double, y double")
    met = []
    kept, spatial.cut = spatial.cut, lambda df: met.append(kept(df)) or met[-1]
    try:
        got = {r.street: r.is_near for r in spatial.near_any(units, inc, others, 100.0).collect()}
    finally:
        spatial.cut = kept
    assert got == {"s0": False, "s1": True, "s2": False, "s3": False, "s4": False, "": False, "lone": True, "none": False}
    assert [f.count() for f in met] == [12]


def test_search_ends_where_wanted_nodes_cannot_be_reached(spark, monkeypatch):
    """A street of 30,000 nodes with a source, and a wanted node on another: the search stays near what can be reached."""
    edges = spark.range(30_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(10.0).alias("w")).unionByName(
        spark.createDataFrame([(90_000, 90_001, 10.0)], "src long, dst long, w double"))
    sources = spark.createDataFrame([(5,)], "node long")
    wanted = spark.createDataFrame([(5,), (9,), (90_001,), (90_009,)], "node long")
    got = {r.node: r.dist for r in graph.multi_source_distance(edges, sources, None, wanted=wanted).collect()}
    assert got[5] == 0 and got[9] == 40 and 90_001 not in got and len(got) < 100
    alone = graph.multi_source_distance(edges, sources, None, wanted=spark.createDataFrame([(90_001,)], "node long"))
    assert alone.count() <= 1
