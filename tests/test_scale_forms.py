"""Forms for large inputs: distances in buckets, selection, hot ids, crowded places."""

import heapq
import json
import random

from pyspark.sql import functions as F

from geoevents.operators import census, graph, spatial
from geoevents.session import cut, written_bytes
from geoevents.sources import scans


def dijkstra(edges, sources, cutoff):
    near, out, heap = {}, {}, [(0.0, s) for s in sources]
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u in out or d > cutoff:
            continue
        out[u] = d
        for v, w in near.get(u, []):
            heapq.heappush(heap, (d + w, v))
    return out


def test_distances_in_buckets(spark):
    """Random graphs with short and very long edges, loops, parallel edges and parts no source reaches, at several bucket widths."""
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120), float(rng.choice([1, 2, 3, 5, 40, 400]))) for _ in range(220)] + [(900, 901, 1.0)]
    frame = spark.createDataFrame(edges, "src int, dst int, w double")
    sources = spark.createDataFrame([(1,), (50,)], "node int")
    for cutoff, delta in ((None, None), (None, 1.0), (60.0, 7.0), (None, 5000.0)):
        got = {r.node: r.dist for r in graph.multi_source_distance(frame, sources, cutoff, delta=delta).collect()}
        assert got == dijkstra(edges, [1, 50], float("inf") if cutoff is None else cutoff)
    want = dijkstra(edges, [1, 50], float("inf"))
    asked = spark.createDataFrame([(n,) for n in list(want)[:3]], "node int")
    some = {r.node: r.dist for r in graph.multi_source_distance(frame, sources, None, wanted=asked, delta=3.0).collect()}
    assert {n: some[n] for n in list(want)[:3]} == {n: want[n] for n in list(want)[:3]} and all(want[n] == d for n, d in some.items())


def test_distances_on_a_grid(spark):
    """90,000 crossings: the distance to the nearest of the sources is that of the streets, x and y apart."""
    n = 300
    at = spark.range(n * n)
    x, y = F.col("id") % n, F.floor(F.col("id") / n)
    edges = at.filter(x < n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w")).unionByName(
        at.filter(y < n - 1).select(F.col("id").alias("src"), (F.col("id") + n).alias("dst"), F.lit(1.0).alias("w")))
    sources = at.filter((x % 20 == 10) & (y % 20 == 10)).select(F.col("id").alias("node"))
    got = graph.multi_source_distance(edges, sources, None)
    want = F.abs(F.col("node") % n % 20 - 10) + F.abs(F.floor(F.col("node") / n) % 20 - 10)
    assert got.count() == n * n and got.filter(F.col("dist") > want).count() == 0


def test_selection(spark, monkeypatch):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), 5.0, 1e300, -1e300, 0.1]) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    monkeypatch.setattr(census, "_FEW", 5)
    for place in (1, 2, 700, 1500, 2999, 3000):
        assert census.value_at(frame, "v", place) == sorted(values)[place - 1]
    assert census.value_at(frame, "v", 0) is None and census.value_at(frame, "v", 3001) is None


def test_lines_of_a_hot_id(spark):
    """A million lines of one id: the long form gathers nothing, and blocks gather no more than a block."""
    lines = spark.range(1_000_000).select(F.when(F.col("id") == 3, "a").alias("id"), F.col("id").alias("line"), F.lit("x").alias("note"))
    long = scans.continued_rows(lines, "id", "line", block_lines=100_000)
    assert long.filter("id = 'a'").count() == 999_997 and long.filter("is_head").count() == 1
    blocks = scans.collapse_continuation_rows(lines, "id", "line", ["note"], block_lines=100_000, per_block=True).orderBy("block").collect()
    assert [len(json.loads(r.note)) for r in blocks] == [99_997] + [100_000] * 9


def test_nearest_in_a_crowd(spark):
    """100,000 targets within a metre, some far away: every point finds its own, exactly."""
    crowd = spark.range(100_000).select(F.col("id").alias("tid"), (F.col("id") % 317 / 317.0).alias("x"), (F.floor(F.col("id") / 317) / 317.0).alias("y"))
    far = spark.range(50).select((F.col("id") + 1_000_000).alias("tid"), (F.col("id") * 1000.0 - 20_000).alias("x"), F.lit(50_000.0).alias("y"))
    points = spark.range(300).select("id", (F.col("id") % 17 / 16.0).alias("x"), (F.col("id") % 19 / 18.0 * 1.2).alias("y")).unionByName(
        spark.createDataFrame([(1000, 4000.0, 49_000.0), (1001, None, 1.0)], "id long, x double, y double"))
    got = {r.id: r for r in spatial.nearest(points, crowd.unionByName(far), point_id="id", target_id="tid").collect()}
    assert len(got) == 301 and got[1000].tid == 1_000_024 and got[1000].dist_m == 1000.0
    for i in (0, 5, 77, 299):
        x, y = i % 17 / 16.0, i % 19 / 18.0 * 1.2
        best = min(((k % 317 / 317.0 - x) ** 2 + (k // 317 / 317.0 - y) ** 2, k) for k in range(100_000))
        assert abs(got[i].dist_m - best[0] ** 0.5) < 1e-12
    grouped = spatial.nearest(spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "b", 0.0, 0.0), (3, "c", 0.0, 0.0)], "id int, g string, x double, y double"),
                              spark.createDataFrame([(7, "a", 9.0, 0.0), (8, "b", 1.0, 0.0)], "tid int, g string, x double, y double"),
                              point_id="id", target_id="tid", on=["g"]).collect()
    assert sorted((r.id, r.tid, r.dist_m) for r in grouped) == [(1, 7, 9.0), (2, 8, 1.0)]


def test_loops_of_joins_do_not_multiply_their_size(spark):
    """The planner takes a cut frame for what was written; guesses for joins would be multiplied in each round of a loop."""
    df = spark.range(64).selectExpr("id AS u", "(id * 7 + 3) % 64 AS v")
    for _ in range(8):
        df = cut(df.join(df.selectExpr("u AS v", "v AS w"), "v").selectExpr("u", "w AS v"))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert 0 <= size - written_bytes(df) < 16 and df.count() == 64
