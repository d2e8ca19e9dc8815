"""Hand-made cases with known answers, and brute-force checks of the spatial operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoevents.functions import text as X
from geoevents.operators import allocation, articles, graph, metrics, overlap, ranking, scoring, series, severity, spatial
from geoevents.sources.polygons import edges_from_vertices


def square(zone, x, y, size, part=0, ring=0):
    pts = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return [(zone, part, ring, i, float(px), float(py)) for i, (px, py) in enumerate(pts)]


def edges(spark, *rings):
    rows = [r for ring in rings for r in ring]
    return edges_from_vertices(spark.createDataFrame(rows, "zone_id string, part int, ring int, seq int, x double, y double"))


# ------------------------------------------------------------------ population by overlap
@pytest.mark.parametrize("hoods, pops, want", [
    ([square("b", 0, 0, 100)], {"b": 1000}, 1000.0),
    ([square("b", 0, 0, 200)], {"b": 1000}, 250.0),
    ([square("b", 100, 100, 50)], {"b": 1000}, None),
    ([square("b", 0, 0, 100), square("c", 50, 0, 100)], {"b": 1000, "c": 1000}, 1500.0),
    ([square("b", 0, 0, 100)], {"b": None}, None),
])
def test_weighted_population(spark, hoods, pops, want):
    area = edges(spark, square("a", 0, 0, 100))
    pop = spark.createDataFrame(list(pops.items()), "zone_id string, population bigint")
    got = overlap.weighted_population(area, edges(spark, *hoods), pop).collect()
    assert (round(got[0].population, 6) if got else None) == want


def test_overlap_with_hole_and_parts(spark):
    holed = edges(spark, square("a", 0, 0, 100), square("a", 25, 25, 50, ring=1), square("a", 200, 0, 10, part=1))
    whole = edges(spark, square("b", -5, -5, 300))
    got = overlap.zone_overlap_area(holed, whole).first().area
    assert math.isclose(got, 100 * 100 - 50 * 50 + 100)
    back = overlap.zone_overlap_area(whole, holed).first().area
    assert math.isclose(got, back)


def test_touching_zones_intersect(spark):
    a, b = edges(spark, square("a", 0, 0, 10)), edges(spark, square("b", 10, 0, 10), square("c", 2, 2, 3), square("d", 40, 40, 5))
    got = {r.b_zone_id for r in overlap.zones_intersect_zones(a, b, cell_size=4.0).collect()}
    assert got == {"b", "c"}


# ------------------------------------------------------------------ clusters, nearest, networks
def test_metric_points_two_clusters(spark):
    pts = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate([0, 5, 10, 1000, 1005])], "id int, x double, y double")
    got = {r.id: r.cluster_id for r in graph.cluster_eps(pts, 60.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def brute_clusters(xy, eps):
    label = list(range(len(xy)))
    changed = True
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1) <= eps * eps
    while changed:
        new = [min(label[j] for j in np.flatnonzero(d2[i])) for i in range(len(xy))]
        changed = new != label
        label = new
    return label


def crowded_points(seed=1):
    """Two thirds of the points in two crowds a gap of about the radius apart."""
    rng = np.random.default_rng(seed)
    left = rng.uniform([0, 0], [40, 40], (120, 2))
    right = rng.uniform([95, 0], [135, 40], (120, 2))
    rest = rng.uniform([-500, -500], [500, 500], (120, 2))
    return np.vstack([left, right, rest])


@pytest.mark.parametrize("eps", [30.0, 54.0, 57.0])
def test_cluster_eps_brute_force(spark, eps):
    xy = crowded_points()
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    got = [r.cluster_id for r in graph.cluster_eps(pts, eps).orderBy("id").collect()]
    assert got == brute_clusters(xy, eps)


def test_dbscan_brute_force(spark):
    xy, eps, k = crowded_points(2), 45.0, 5
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    near = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1) <= eps * eps
    core = np.flatnonzero(near.sum(1) >= k)
    names = {c: core[l] for c, l in zip(core, brute_clusters(xy[core], eps))}
    want = dict(names)
    for i in set(range(len(xy))) - set(core):
        touching = [names[c] for c in core if near[i, c]]
        if touching:
            want[i] = min(touching)
    got = {r.id: r.cluster_id for r in graph.dbscan(pts, eps, k).collect()}
    assert got == {int(a): int(b) for a, b in want.items()}


def test_nearest_brute_force_with_crowd(spark):
    rng = np.random.default_rng(3)
    targets = np.vstack([rng.uniform(0, 1, (300, 2)), rng.uniform(-2000, 2000, (20, 2))])
    points = rng.uniform(-3000, 3000, (60, 2))
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(targets)], "tid int, x double, y double")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, x double, y double")
    got = {r.id: r.dist_m for r in spatial.nearest(p, t, point_id="id", target_id="tid", leaf_targets=4).collect()}
    want = np.sqrt(((points[:, None, :] - targets[None, :, :]) ** 2).sum(-1)).min(1)
    assert len(got) == 60 and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in range(60))


def test_hashed_join_is_a_plain_join(spark):
    """The same rows with a hot key, whether the side is written out (broadcast by its bytes), too large for that, or lazy."""
    from geoevents.session import cut, hashed_join

    big = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    small = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    written = cut(small)
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = big.join(small, ["k"], how)
        rows = lambda df: sorted(map(tuple, df.select(want.columns).collect()), key=repr)
        assert rows(hashed_join(big, small, ["k"], how)) == rows(hashed_join(big, written, ["k"], how)) == rows(want)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
        try:
            assert rows(hashed_join(big, written, ["k"], how)) == rows(want)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dense_places_are_never_compared_one_by_one(spark):
    """100,000 distinct places inside one metre, and a pair of dense groups just outside and just inside the radius."""
    dense = spark.range(100_000).selectExpr("id", "(id % 400) / 400.0 as x", "floor(id / 400) / 250.0 as y")
    edge = spark.range(200).selectExpr("100000 + id as id", "13.0 + (id % 20) / 40.0 as x", "floor(id / 20) / 10.0 as y")
    links = graph.cluster_eps(dense.unionByName(edge), 12.5)
    assert {r.n for r in links.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()} == {100_200}
    apart = graph.cluster_eps(dense.unionByName(edge), 11.9)
    assert {r.n for r in apart.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()} == {100_000, 200}


def test_network_distance_beats_straight_line(spark):
    rows = [("a", "b", 180.0), ("b", "c", 40.0), ("c", "d", 180.0)]
    e = spark.createDataFrame(rows, "src string, dst string, w double")
    src = spark.createDataFrame([("a",)], "node string")
    got = {r.node: r.dist for r in graph.multi_source_distance(e, src, 500.0).collect()}
    assert got == {"a": 0.0, "b": 180.0, "c": 220.0, "d": 400.0}
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 180.0), ("c", 40.0, 180.0), ("d", 40.0, 0.0)], "node string, x double, y double")
    cam = spark.createDataFrame([(1, 0.0, 0.0)], "camera_id int, x double, y double")
    inc = spark.createDataFrame([(7, 40.0, 0.0), (8, 0.0, 1.0)], "id int, x double, y double")
    cov = {r.id: r.covered for r in graph.network_coverage(inc, cam, nodes, e).collect()}
    assert cov == {7: False, 8: True}
    far = graph.multi_source_distance(e, src, None, wanted=spark.createDataFrame([("c",)], "node string"))
    assert {r.node: r.dist for r in far.collect()}["c"] == 220.0
    inc = inc.withColumn("offence", F.lit("?"))
    gap = graph.camera_gaps_on_network(inc, cam, nodes, e).collect()
    assert [(g.n, g.nearest_camera_m, g.network_camera_m, g.recommendation) for g in gap] == [(1, 40.0, 400.0, "instalar")]
    none = graph.camera_gaps_on_network(inc, cam, nodes, e.filter("w < 0"))
    assert none.count() == 0                       # no graph: straight lines, and both incidents are within 50 m


def test_camera_gaps_far_and_near(spark):
    cam = spark.createDataFrame([(1, 0.0, 0.0)], "camera_id int, x double, y double")
    inc = spark.createDataFrame([(1, 5500.0, 0.0, "Roubo em coletivo"), (2, 44.0, 0.0, "Furto")], "id int, x double, y double, offence string")
    gap, = graph.camera_gaps(inc, cam).collect()
    assert (gap.cluster_id, gap.n, gap.recommendation, gap.priority) == (1, 1, "instalar", 2.6)


# ------------------------------------------------------------------ metrics
def test_hours(spark):
    df = spark.createDataFrame([("a", h) for h in (22, 3, 14, 9, 1)] + [("a", None)], "zone_id string, hour int")
    assert metrics.night_share(df, ["zone_id"]).first().night_pct == 60.0
    hist = spark.createDataFrame([("a", 14, 5), ("a", 2, 3), ("a", 20, 1)], "zone_id string, hour int, n bigint")
    assert metrics.peak_hour(hist, ["zone_id"]).first().peak_label == "14h"


def test_area_score(spark):
    rows = [("A", 100, .5, 50, 20, False), ("B", 50, .3, 25, 10, True), ("C", 10, .1, 5, 2, False)]
    df = spark.createDataFrame(rows, "zone_id string, crimes int, peak_ratio double, factors int, tips int, has_report boolean")
    got = {r.zone_id: r for r in scoring.area_score(df).collect()}
    assert got["A"].part_crime == 40.0 and got["B"].part_report == 5.0
    for r in got.values():
        parts = r.part_crime + r.part_peak + r.part_factors + r.part_tips + r.part_report
        assert abs(parts - r.score) <= 0.2


def test_modus(spark):
    texts = ["a pé na rua", "uma moto", None, "", "armado com faca em grupo"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.extract_modus(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [["a_pe"], ["motocicleta"], [], [], ["armado", "arma_branca", "em_grupo"]]


def test_bingo_layers(spark):
    schema = "street string, x double, y double"
    inc = spark.createDataFrame([("rua da paz", 0.0, 0.0), ("rua b", 1000.0, 0.0)], schema)
    streets = spark.createDataFrame([("rua da paz", 1, 0.0, 0.0), ("rua b", 1, 1000.0, 0.0)], "street string, total int, x double, y double")
    factors = spark.createDataFrame([("x", 50.0, 0.0), ("praca da paz", 5000.0, 0.0)], schema)
    tips = spark.createDataFrame([("rua b", None, None), ("da paz", None, None)], schema)
    got = {r.street: (r.has_factor, r.has_tip, r.layers) for r in scoring.bingo_layers(streets, inc, factors, tips).collect()}
    assert got == {"rua da paz": (True, False, 2), "rua b": (False, True, 2)}


def test_narratives_cap_then_coordinates(spark):
    rows = [(1, None, 1.0), (2, "x", None), (3, "y", 1.0)]
    df = spark.createDataFrame(rows, "id int, text string, lat double").withColumn("lon", F.col("lat"))
    assert [r.id for r in ranking.narratives_first(df, "text", [F.col("id")], 2).collect()] == [3]


def test_clamp_limit():
    assert [ranking.clamp_limit(n) for n in (None, 0, -3, 7.9, 999, float("nan"))] == [50, 50, 50, 7, 50, 50]


# ------------------------------------------------------------------ series
def test_gap_fill(spark):
    m = spark.createDataFrame([("a", dt.date(2024, 1, 1), 2), ("a", dt.date(2024, 3, 1), 1)], "k string, month date, n bigint")
    assert [r.n for r in series.gap_filled_series(m, ["k"]).orderBy("month").collect()] == [2, 0, 1]


def months(values, start=2020):
    return [("a", dt.date(start + i // 12, i % 12 + 1, 1), v) for i, v in enumerate(values)]


def test_trend(spark):
    schema = "k string, month date, n bigint"
    fall = series.mann_kendall(spark.createDataFrame(months(range(76, 40, -1)), schema), ["k"]).first()
    assert fall.direction == "decrescente" and fall.significant and fall.p_value < 0.05 and fall.tau == -1.0
    flat = series.mann_kendall(spark.createDataFrame(months([5] * 10), schema), ["k"]).first()
    assert not flat.available and flat.reason == "serie_constante" and flat.p_value == 1.0
    short = series.mann_kendall(spark.createDataFrame(months([5, 6, 7]), schema), ["k"]).first()
    assert short.reason == "serie_curta" and short.p_value is None


def test_seasonal_recovers_pattern(spark):
    wave = [10 if i % 12 == 4 else 0 for i in range(36)]
    rows = months([100 + 2 * i + w for i, w in enumerate(wave)])
    out = series.seasonal_decompose_additive(spark.createDataFrame(rows, "k string, month date, n bigint"), ["k"])
    assert series.seasonal_summary(out, ["k"]).first().peak_month == 5
    assert abs(out.filter("month = '2021-05-01'").first().seasonal - 10 * 11 / 12) < 1e-6


def test_poisson_interval(spark):
    m = spark.createDataFrame([("a", dt.date(2024, 1, 1), k) for k in (0, 1, 10, 400)], "k string, month date, n bigint")
    got = {r.n: (r.ci_lo, r.ci_hi) for r in series.poisson_ci(m).collect()}
    assert got[0] == (0.0, 3.7) and got[1] == (0.0, 5.6) and got[10] == (4.8, 18.4)
    assert got[400][0] < 400 < got[400][1]


@pytest.mark.parametrize("area, ring, label, confidence", [
    ((100, 80), (100, 130), "deslocamento_provavel", "alta"),
    ((100, 80), (100, 80), "reducao_genuina", "media"),
    ((100, 130), (100, 140), "intensificacao", "media"),
    ((100, 95), (100, 130), "inconclusivo", "media"),
    ((5, 2), (5, 9), "deslocamento_provavel", "baixa"),
    ((0, 2), (5, 9), "inconclusivo", "baixa"),
])
def test_displacement(spark, area, ring, label, confidence):
    def rows(c):
        return spark.createDataFrame([("z", 2022 + i, n) for i, n in enumerate(c)], "zone_id string, year int, n bigint")

    got = series.yoy_displacement(rows(area), rows(ring), ["zone_id"]).first()
    assert (got.label, got.confidence) == (label, confidence)


# ------------------------------------------------------------------ scores and allocation
def test_fleet_golden(spark):
    scores = [85, 85, 85, 82.22, 78.82, 69.58, 62.33, 61.27, 41.89]
    df = spark.createDataFrame([(f"A{i}", float(s)) for i, s in enumerate(scores)], "area string, final_score double")
    got = [r.agents for r in allocation.allocate_fleet(df).orderBy("area").collect()]
    assert got == [74, 74, 74, 72, 71, 65, 61, 60, 49] and sum(got) == 600


def test_unknown_event_scores_nine(spark):
    from geoevents.operators.extraction import make_events

    ev = make_events(spark.range(1), {"event_id": F.lit("e")})
    row = severity.event_severity(ev).first()
    assert row.s_event == 9.0 and [r.code for r in row.reasons] == ["crime_type.desconhecido", "outcome.desconhecido"]
    assert row.victims == [] and row.environment.urban_factors == []


def test_feedback(spark):
    rows = [(100.0, 60.0, True), (100.0, 95.0, True), (100.0, 80.0, True), (100.0, None, True), (100.0, 60.0, False)]
    df = spark.createDataFrame(rows, "a double, b double, c boolean")
    got = [r[0] for r in df.select(severity.feedback_delta(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [-15.0, 8.0, 0.0, 0.0, 0.0]


def test_chunks_keep_everything(spark):
    text = "## T\n" + "\n".join("p" * 900 for _ in range(5)) + "\n## U\n" + "q" * 5000
    rows = articles.chunk_text(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("chunk_index").collect()
    assert "\n".join(r.chunk for r in rows) == text
    assert all(len(r.chunk) <= 3500 or "\n" not in r.chunk for r in rows)
    assert [r.chunk_id for r in rows][:2] == ["1:0", "1:1"]


def test_poisson_interval_of_large_counts():
    """Bisection and expansion agree around the bound; far above it the cube-root normal form of the gamma quantile does too."""

    shape = np.array([1000.0, 1500.0, 4000.0])
    for p in (0.025, 0.975):
        small, large = series._small_gamma_quantile(p, shape), series._large_gamma_quantile(p, shape)
        assert np.allclose(small, large, rtol=1e-9)
    huge = np.array([1e4, 1e8, 1e11])
    lo, hi = series._gamma_quantile(0.025, huge), series._gamma_quantile(0.975, huge + 1)
    z = 1.959963984540054
    cube = lambda k, q: k * (1 - 1 / (9 * k) + q / (3 * np.sqrt(k))) ** 3
    assert np.allclose(lo, cube(huge, -z), rtol=1e-6) and np.allclose(hi, cube(huge + 1, z), rtol=1e-6)


def test_joins_take_map_columns_and_any_size(spark):
    from geoevents.session import cut, hashed_join

    big = spark.range(100).selectExpr("id", "id % 5 as k", "map('a', id) as m")
    side = spark.range(3).selectExpr("id as k", "id * 10 as v")
    want = sorted((r.id, r.v) for r in big.join(side, "k", "left").collect())
    for s in (side, cut(side)):
        assert sorted((r.id, r.v) for r in hashed_join(big, s, ["k"], "left").collect()) == want
    near = hashed_join(big, side, ["k"], "left_anti", big["id"] > 50)
    assert near.count() == 100 - sum(1 for i in range(51, 100) if i % 5 < 3)


def test_white_space_of_any_kind_is_trimmed(spark):
    from geoevents.functions import text as X

    row = spark.sql("select concat('\\n', chr(9), 'Rua  \u00c1', chr(160), '\\r') as s").select(X.norm_street(F.col("s")).alias("n")).first()
    assert row.n == "rua  a"


def test_projection_against_another_series(spark):
    """The transverse Mercator projection by the power series in longitude, an independent formula with its own constants."""
    def snyder(lat, lon):
        a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
        e2 = f * (2 - f)
        ep2 = e2 / (1 - e2)
        p, dl = math.radians(lat), math.radians(lon + 45.0)
        n = a / math.sqrt(1 - e2 * math.sin(p) ** 2)
        t, c, big_a = math.tan(p) ** 2, ep2 * math.cos(p) ** 2, dl * math.cos(p)
        m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p)
                 + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))
        x = k0 * n * (big_a + (1 - t + c) * big_a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * big_a**5 / 120) + 500000
        y = k0 * (m + n * math.tan(p) * (big_a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * big_a**4 / 24
                                         + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * big_a**6 / 720)) + 10000000
        return x, y

    from geoevents.functions import geo

    places = [(-22.9519, -43.2105), (-23.2, -43.9), (-22.7, -43.0), (-22.97, -43.18), (-1.0, -44.0)]
    df = spark.createDataFrame(places, "lat double, lon double")
    for r in df.select("lat", "lon", *[c.alias(n) for c, n in zip(geo.project_utm(F.col("lat"), F.col("lon")), "xy")]).collect():
        x, y = snyder(r.lat, r.lon)
        assert abs(r.x - x) < 0.005 and abs(r.y - y) < 0.005


def test_streets_without_a_name_use_their_centre(spark):
    units = spark.createDataFrame([("", 0.0, 0.0), ("a", 500.0, 0.0)], "street string, x double, y double")
    own = spark.createDataFrame([("", 1000.0, 0.0), ("", -1000.0, 0.0), ("a", 500.0, 0.0)], "street string, x double, y double")
    far, near = (spark.createDataFrame([(x, 0.0)], "x double, y double") for x in (1000.0, 20.0))
    flags = lambda rows: {r.street: r.is_near for r in spatial.near_any(units, own, rows).collect()}
    assert flags(far) == {"": False, "a": False} and flags(near) == {"": True, "a": False}
