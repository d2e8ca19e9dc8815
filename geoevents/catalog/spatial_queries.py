"""Queries of the spatial and name joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoevents.catalog import ctes
from geoevents.catalog.common import index_of, joined_text, metric, r6, rounded, zoned
from geoevents.catalog.registry import query
from geoevents.functions import geo as G
from geoevents.functions import text as X
from geoevents.operators import graph as N
from geoevents.operators import metrics as M
from geoevents.operators import overlap as O
from geoevents.operators import queries as Q
from geoevents.operators import spatial as S
from geoevents.plans import city_context as CC
from geoevents.sources import bindings as B


@query("filter_bbox", "SELECT id, round(lat,6) AS lat, round(lon,6) AS lon FROM inc WHERE lat BETWEEN -23.1e0 AND -22.7e0 AND lon BETWEEN -43.8e0 AND -43.0e0", "inc")
def _(spark, d):
    df = Q.filter_bbox(B.incidents(spark, d), (-23.1, -22.7, -43.8, -43.0))
    return rounded(df.select("id", "lat", "lon"), "lat", "lon")


@query("project_utm", "SELECT id, round(x,3) AS x, round(y,3) AS y FROM inc_m", "inc_m")
def _(spark, d):
    return rounded(metric(B.incidents(spark, d)).select("id", "x", "y"), "x", "y", digits=3)


@query("project_utm_inverse", "SELECT id, round(lat,7) AS lat, round(lon,7) AS lon FROM inc", "inc")
def _(spark, d):
    df = metric(B.incidents(spark, d))
    lat, lon = G.unproject_utm(F.col("x"), F.col("y"))
    return df.select("id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query("join_points_to_zones", "SELECT inc.id, z.zone_id FROM inc LEFT JOIN inc_z z USING (id)", "inc inc_z")
def _(spark, d):
    return zoned(spark, d, B.incidents(spark, d), "left").select("id", "zone_id")


@query("join_points_to_zones_first", """SELECT inc.id, z.zone_id FROM inc LEFT JOIN (SELECT id, arg_min(zone_id, zone_order) AS zone_id
 FROM inc_z JOIN zones USING (zone_id) GROUP BY id) z USING (id)""", "inc inc_z zones")
def _(spark, d):
    return zoned(spark, d, B.incidents(spark, d), "left", "first").select("id", "zone_id")


_REINDEX = """SELECT {c} FROM (SELECT inc.id, CASE WHEN inc.id % 4 = 0 THEN 'Z0' END AS stored, z.zone_id FROM inc LEFT JOIN
 (SELECT id, arg_min(zone_id, zone_order) AS zone_id FROM inc_z JOIN zones USING (zone_id) GROUP BY id) z USING (id))"""


def _stored(spark, d):
    return B.incidents(spark, d).withColumn("zone", F.when(F.col("id") % 4 == 0, F.lit("Z0")))


@query("reindex_zone", _REINDEX.format(c="id, coalesce(stored, zone_id) AS zone"), "inc inc_z zones")
def _(spark, d):
    return S.reindex_zone(_stored(spark, d), index_of(spark, d)).select("id", "zone")


@query("reindex_zone_force_counts", _REINDEX.format(c="""COUNT(*) FILTER (zone_id IS NOT NULL AND stored IS DISTINCT FROM zone_id) AS updated,
 COUNT(*) FILTER (zone_id IS NOT NULL AND stored = zone_id) AS already, 0::BIGINT AS no_coords, COUNT(*) FILTER (zone_id IS NULL) AS outside"""), "inc inc_z zones")
def _(spark, d):
    return S.reindex_counts(S.reindex_zone(_stored(spark, d), index_of(spark, d), force=True))


# ------------------------------------------------------------------ distances
_NEAR_CAM = "SELECT DISTINCT i.id FROM inc_m i JOIN cam_m c ON pow(i.x-c.x,2)+pow(i.y-c.y,2) <= {r2}"


@query("covered_by_camera", _NEAR_CAM.format(r2="250000e0"), "inc_m cam_m")
def _(spark, d):
    return S.covered_by_camera(metric(B.incidents(spark, d)), metric(B.cameras(spark, d)), 500.0).select("id")


@query("uncovered_by_camera", f"SELECT id FROM inc_m EXCEPT ({_NEAR_CAM.format(r2='1000000e0')})", "inc_m cam_m")
def _(spark, d):
    inc, cam = metric(B.incidents(spark, d)), metric(B.cameras(spark, d))
    return S.within_radius(inc, cam, 1000.0, how="left_anti").select("id")


@query("near_any", """SELECT s.street, CASE WHEN s.street <> '' AND s.located > 0
   THEN EXISTS (SELECT 1 FROM inc_m i JOIN fac_m f ON pow(i.x-f.x,2)+pow(i.y-f.y,2) <= 10000e0 WHERE i.street = s.street)
   ELSE EXISTS (SELECT 1 FROM fac_m f WHERE pow(s.x-f.x,2)+pow(s.y-f.y,2) <= 10000e0) END AS is_near
 FROM (SELECT street, avg(x) AS x, avg(y) AS y, COUNT(x) AS located FROM inc_m GROUP BY 1) s""", "inc inc_m fac_m")
def _(spark, d):
    inc = metric(B.incidents(spark, d))
    units = inc.groupBy("street").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return S.near_any(units, inc, metric(B.factors(spark, d)), 100.0)


@query("exact_name_fallback", """SELECT s.street, EXISTS (SELECT 1 FROM fac f WHERE f.lat IS NULL AND f.street = s.street AND f.street <> '') AS named
 FROM (SELECT DISTINCT street FROM inc) s""", "inc fac")
def _(spark, d):
    units = B.incidents(spark, d).select("street").distinct()
    return S.exact_name_fallback(units, B.factors(spark, d), key="street", name="street", x="lat", y="lon")


@query("nearest_camera", """SELECT i.id, first(c.id ORDER BY pow(i.x-c.x,2)+pow(i.y-c.y,2), c.id) AS camera_id,
 round(sqrt(min(pow(i.x-c.x,2)+pow(i.y-c.y,2))),3) AS dist_m FROM inc_m i CROSS JOIN cam_m c GROUP BY i.id""", "inc_m cam_m")
def _(spark, d):
    near = S.nearest(metric(B.incidents(spark, d)), metric(B.cameras(spark, d)), point_id="id", target_id="camera_id")
    return rounded(near, "dist_m", digits=3)


_RING = f"""SELECT DISTINCT i.id, e.zone_id FROM inc_m i JOIN edges_m e ON i.x BETWEEN least(e.x1,e.x2)-500 AND greatest(e.x1,e.x2)+500
 AND i.y BETWEEN least(e.y1,e.y2)-500 AND greatest(e.y1,e.y2)+500 AND {ctes.seg_dist2('i.x', 'i.y')} <= 250000e0
 WHERE i.id NOT IN (SELECT id FROM inc_z)"""
ctes.TABLES["edges_m"] = ("edges", f"""SELECT a.zone_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
 FROM {ctes.utm("(SELECT zone_id, seq, x1 AS lon, y1 AS lat FROM edges)")} a JOIN {ctes.utm("(SELECT zone_id, seq, x2 AS lon, y2 AS lat FROM edges)")} b USING (zone_id, seq)""")
ctes.TABLES["ring"] = ("inc_m inc_z edges_m", _RING)


@query("ring_join", "SELECT id, zone_id FROM ring", "ring")
def _(spark, d):
    pts = metric(zoned(spark, d, B.incidents(spark, d), "left"))
    return S.ring_join(pts, B.metric_edges(B.zone_edges(spark, d)), "id", 500.0)


@query("subtract_zones", "SELECT id FROM inc WHERE id NOT IN (SELECT id FROM inc_z)", "inc inc_z")
def _(spark, d):
    return S.subtract_zones(zoned(spark, d, B.incidents(spark, d), "left")).select("id")


@query("within_radius_km", """SELECT name, round(floor(dk*100+0.5)/100, 6) AS distance_km FROM (SELECT b.name,
 2*6371e0*asin(least(1e0, sqrt(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))) AS dk
 FROM cgeo a, cgeo b WHERE a.name = 'NATION_7' AND b.name <> 'NATION_7') WHERE floor(dk*100+0.5)/100 <= 25""", "cgeo")
def _(spark, d):
    from geoevents.operators import census as Z

    m = Z.census_metrics(B.census(spark, d), B.neighbourhood_edges(spark, d))
    return rounded(S.within_radius_km(m, "NATION_7", 25.0).select("name", "distance_km"), "distance_km")


ctes.TABLES["cgeo"] = ("census nedges", """SELECT c.zone_id, c.name, (min(x1)+max(x1))/2 AS lon, (min(y1)+max(y1))/2 AS lat
 FROM census c JOIN nedges e USING (zone_id) GROUP BY 1,2""")


@query("haversine", """SELECT id, round(2*6371000e0*asin(least(1e0, sqrt(pow(sin(radians(-22.9e0-lat)/2),2)
 +cos(radians(lat))*cos(radians(-22.9e0))*pow(sin(radians(-43.2e0-lon)/2),2)))),3) AS dist_m FROM inc""", "inc")
def _(spark, d):
    dist = G.haversine(F.col("lat"), F.col("lon"), F.lit(-22.9), F.lit(-43.2))
    return B.incidents(spark, d).select("id", F.round(dist, 3).alias("dist_m"))


@query("radius_circle", """SELECT id, i AS step, round(lon + 500e0/(111320e0*cos(lat*pi()/180e0))*cos(i/64e0*2*pi()),7) AS x,
 round(lat + 500e0/111320e0*sin(i/64e0*2*pi()),7) AS y FROM cam, range(0,65) t(i)""", "cam")
def _(spark, d):
    ring = G.radius_circle(F.col("lat"), F.col("lon"), 500.0)
    df = B.cameras(spark, d).select(F.col("camera_id").alias("id"), F.posexplode(ring).alias("step", "p"))
    return df.select("id", F.col("step").cast("bigint").alias("step"), F.round("p.lon", 7).alias("x"), F.round("p.lat", 7).alias("y"))


# ------------------------------------------------------------------ polygons against polygons
_RECTS = """SELECT 'Z'||a.k AS a_zone_id, 'N'||b.k AS b_zone_id,
 greatest(0, least(a.x+20000, b.x+23000) - greatest(a.x, b.x+5000)) * greatest(0, least(a.y+4000, b.y+12000) - greatest(a.y, b.y+3000))
 + greatest(0, least(a.x+10000, b.x+23000) - greatest(a.x, b.x+5000)) * greatest(0, least(a.y+9000, b.y+12000) - greatest(a.y+4000, b.y+3000)) AS area
 FROM (SELECT k, CAST((k%5)*18000 AS DOUBLE) x, CAST((k//5)*10000 AS DOUBLE) y FROM orig) a,
      (SELECT k, CAST((k%5)*18000 AS DOUBLE) x, CAST((k//5)*10000 AS DOUBLE) y FROM orig) b"""
ctes.TABLES["overlap"] = ("orig", f"SELECT * FROM ({_RECTS}) WHERE area > 0")


def _overlap_pairs(spark, d):
    return O.zone_overlap_area(B.scaled(B.zone_edges(spark, d)), B.scaled(B.neighbourhood_edges(spark, d)))


@query("zone_overlap_area", "SELECT a_zone_id, b_zone_id, round(area, 2) AS area FROM overlap", "overlap")
def _(spark, d):
    return rounded(_overlap_pairs(spark, d), "area", digits=2)


@query("zones_intersect_zones", "SELECT a_zone_id, b_zone_id FROM overlap", "overlap")
def _(spark, d):
    return O.zones_intersect_zones(B.scaled(B.zone_edges(spark, d)), B.scaled(B.neighbourhood_edges(spark, d)), cell_size=2500.0)


@query("weighted_population", """SELECT a_zone_id AS zone_id, round(SUM(c.pop_2022*o.area/(18000e0*9000e0)),4) AS population
 FROM overlap o JOIN census c ON c.zone_id = o.b_zone_id WHERE c.pop_2022 IS NOT NULL GROUP BY 1""", "overlap census")
def _(spark, d):
    pop = B.census(spark, d).select("zone_id", F.col("pop_2022").alias("population"))
    out = O.weighted_population(B.scaled(B.zone_edges(spark, d)), B.scaled(B.neighbourhood_edges(spark, d)), pop)
    return rounded(out, "population", digits=4)


@query("zone_context", """SELECT a_zone_id AS zone_id, string_agg(DISTINCT name, '|' ORDER BY name) AS members, CAST(SUM(coalesce(pop_2022,0)) AS BIGINT) AS population,
 (SELECT region FROM overlap p JOIN census q ON q.zone_id = p.b_zone_id WHERE p.a_zone_id = o.a_zone_id GROUP BY region ORDER BY COUNT(*) DESC, region LIMIT 1) AS region
 FROM overlap o JOIN census c ON c.zone_id = o.b_zone_id GROUP BY 1""", "overlap census")
def _(spark, d):
    pairs = _overlap_pairs(spark, d)
    census = B.census(spark, d).select("zone_id", "name", "region", F.col("pop_2022").alias("population"))
    out = O.zone_context(pairs, census)
    return out.select(F.col("a_zone_id").alias("zone_id"), joined_text("members").alias("members"), "population", "region")


ctes.TABLES["tip_n"] = ("tip nedges", ctes.pip("tip", "nedges"))


_AROUND = """SELECT a_zone_id AS zone_id, name, coalesce(pop_2022,0) AS population, coalesce(t.n,0) AS tips, coalesce(k.n,0) AS calls
 FROM overlap o JOIN census c ON c.zone_id = o.b_zone_id LEFT JOIN (SELECT zone_id, COUNT(*) n FROM tip_n GROUP BY 1) t ON t.zone_id = o.b_zone_id
 LEFT JOIN (SELECT neighbourhood, COUNT(*) n FROM cal GROUP BY 1) k USING (neighbourhood)"""


def _surroundings(spark, d):
    edges = B.neighbourhood_edges(spark, d)
    tips = M.count_by(S.join_points_to_zones(B.tips(spark, d), S.zone_index(edges), how="inner"), ["zone_id"], "tips")
    census = B.census(spark, d)
    calls = M.calls_by_neighbourhood(census.select("zone_id", "neighbourhood"), B.calls(spark, d), "neighbourhood").select("zone_id", "calls")
    info = census.select("zone_id", "name", F.col("pop_2022").alias("population"))
    out = O.surroundings_enriched(_overlap_pairs(spark, d), info, tips, calls)
    return out.select(F.col("a_zone_id").alias("zone_id"), "name", "population", "tips", "calls")


@query("surroundings_enriched", _AROUND, "overlap census tip_n cal")
def _(spark, d):
    return _surroundings(spark, d)


@query("query_surroundings", f"SELECT * FROM ({_AROUND}) WHERE zone_id = 'Z7'", "overlap census tip_n cal")
def _(spark, d):
    return Q.query_surroundings(_surroundings(spark, d), "Z7")


@query("tips_by_neighbourhood", """SELECT zone_id, COUNT(*) AS total, (SELECT string_agg(kind || ':' || n, '|' ORDER BY n DESC, kind) FROM
 (SELECT kind, COUNT(*) n FROM tn b WHERE b.zone_id = a.zone_id GROUP BY 1 ORDER BY n DESC, kind LIMIT 5)) AS tipos FROM tn a GROUP BY 1""", "tn")
def _(spark, d):
    zoned_tips = S.join_points_to_zones(B.tips(spark, d), S.zone_index(B.neighbourhood_edges(spark, d)), how="inner")
    out = M.tips_by_neighbourhood(zoned_tips)
    text = F.transform("tipos", lambda t: F.concat(t["tipo"], F.lit(":"), t["count"].cast("string")))
    return out.select("zone_id", "total", joined_text(text).alias("tipos"))


ctes.TABLES["tn"] = ("tip tip_n", "SELECT tip.*, tip_n.zone_id FROM tip JOIN tip_n USING (id)")


@query("territory_relation", """SELECT 'Z'||a.k AS zone_id, 'N'||b.k AS territory_id, CASE WHEN o.area > 0 THEN 'intersecting' ELSE 'nearby' END AS relation, 'F'||(b.k%3) AS faction
 FROM orig a CROSS JOIN orig b LEFT JOIN overlap o ON o.a_zone_id = 'Z'||a.k AND o.b_zone_id = 'N'||b.k
 WHERE o.area > 0 OR EXISTS (SELECT 1 FROM es e JOIN nes p ON p.zone_id = 'N'||b.k WHERE e.zone_id = 'Z'||a.k AND """ + ctes.seg_dist2("p.x1", "p.y1") + """ <= 3000e0*3000e0)
 OR EXISTS (SELECT 1 FROM nes e JOIN es p ON p.zone_id = 'Z'||a.k WHERE e.zone_id = 'N'||b.k AND """ + ctes.seg_dist2("p.x1", "p.y1") + """ <= 3000e0*3000e0)""", "orig overlap es nes")
def _(spark, d):
    z, n = B.scaled(B.zone_edges(spark, d)), B.scaled(B.neighbourhood_edges(spark, d))
    k = F.regexp_extract("zone_id", r"(\d+)", 1).cast("int")
    factions = B.census(spark, d).select(F.col("zone_id").alias("territory_id"), F.concat(F.lit("F"), (k % 3).cast("string")).alias("faction"))
    return O.territory_relation(z, n, factions, near_m=3000.0, cell_size=2500.0)


_SC = "SELECT zone_id, round(x1*1e5) AS x1, round(y1*1e5) AS y1, round(x2*1e5) AS x2, round(y2*1e5) AS y2 FROM {}"
ctes.TABLES["es"] = ("edges", _SC.format("edges"))
ctes.TABLES["nes"] = ("nedges", _SC.format("nedges"))


@query("dominant_territory", """SELECT a_zone_id, first(faction ORDER BY n DESC, faction) AS faction FROM (SELECT a_zone_id, 'F'||(CAST(substr(b_zone_id,2) AS INT)%3) AS faction,
 COUNT(*) n FROM overlap GROUP BY 1,2) GROUP BY 1""", "overlap")
def _(spark, d):
    k = F.regexp_extract("b_zone_id", r"(\d+)", 1).cast("int")
    pairs = _overlap_pairs(spark, d).withColumn("faction", F.concat(F.lit("F"), (k % 3).cast("string")))
    return M.dominant_territory(pairs, ["a_zone_id"], "faction")


@query("territory_summary", """SELECT a_zone_id AS zone_id, 'sob domínio direto de ' || string_agg(DISTINCT 'F'||(CAST(substr(b_zone_id,2) AS INT)%3), ', '
 ORDER BY 'F'||(CAST(substr(b_zone_id,2) AS INT)%3)) AS summary FROM overlap GROUP BY 1""", "overlap")
def _(spark, d):
    k = F.regexp_extract("b_zone_id", r"(\d+)", 1).cast("int")
    rel = _overlap_pairs(spark, d).select(
        F.col("a_zone_id").alias("zone_id"), F.lit("intersecting").alias("relation"),
        F.concat(F.lit("F"), (k % 3).cast("string")).alias("faction"))
    return O.territory_summary(rel).select("zone_id", "summary")


@query("bounds", "SELECT zone_id, round(min(x1),6) AS minx, round(min(y1),6) AS miny, round(max(x1),6) AS maxx, round(max(y1),6) AS maxy FROM edges GROUP BY 1", "edges")
def _(spark, d):
    from geoevents.sources.polygons import zone_bounds

    return rounded(zone_bounds(B.zone_edges(spark, d)), "minx", "miny", "maxx", "maxy")


@query("hull_zone", None)
def _(spark, d):
    pts = metric(B.incidents(spark, d)).select(F.col("aisp").alias("area"), "x", "y")
    return rounded(N.hull_zone(pts, "area"), "x", "y", digits=3)


# ------------------------------------------------------------------ coincidence grid
def _cnt(t: str) -> str:
    return f"SELECT CAST(floor(x/1000e0) AS BIGINT) ix, CAST(floor(y/1000e0) AS BIGINT) iy, COUNT(*) n FROM {t} WHERE x IS NOT NULL GROUP BY 1,2"


ctes.TABLES["grid"] = ("inc_m fac_m tip_m", f"""SELECT ix, iy, coalesce(i.n,0) AS n_incidents, coalesce(f.n,0) AS n_factors, coalesce(t.n,0) AS n_tips,
 CAST((coalesce(i.n,0)>0)::INT + (coalesce(f.n,0)>0)::INT + (coalesce(t.n,0)>0)::INT AS INT) AS n_layers, street
 FROM ({_cnt('inc_m')}) i FULL JOIN ({_cnt('fac_m')}) f USING (ix,iy) FULL JOIN ({_cnt('tip_m')}) t USING (ix,iy)
 LEFT JOIN (SELECT ix, iy, first(street ORDER BY n DESC, street) AS street FROM (SELECT CAST(floor(x/1000e0) AS BIGINT) ix, CAST(floor(y/1000e0) AS BIGINT) iy, street, COUNT(*) n
   FROM inc_m GROUP BY 1,2,3) GROUP BY 1,2) s USING (ix,iy)""")


def _grid(spark, d):
    return S.grid_coincidence(metric(B.incidents(spark, d)), metric(B.factors(spark, d)), metric(B.tips(spark, d)), 1000.0)


@query("grid_coincidence", "SELECT ix, iy, n_incidents, n_factors, n_tips, n_layers FROM grid", "grid")
def _(spark, d):
    return _grid(spark, d).drop("street")


@query("grid_streets", """SELECT *, row_number() OVER (ORDER BY max_layers DESC, crime_total DESC, street) AS rank FROM (SELECT street, COUNT(*) AS n_cells,
 CAST(SUM(n_incidents) AS BIGINT) AS crime_total, max(n_layers) AS max_layers FROM grid WHERE street IS NOT NULL GROUP BY 1)""", "grid")
def _(spark, d):
    return S.grid_streets(_grid(spark, d))


@query("grid_street_causes", """SELECT g.*, coalesce(agencies, '') AS agencies, coalesce(factors, '') AS factors FROM
 (SELECT *, row_number() OVER (ORDER BY max_layers DESC, crime_total DESC, street) AS rank FROM (SELECT street, COUNT(*) AS n_cells,
  CAST(SUM(n_incidents) AS BIGINT) AS crime_total, max(n_layers) AS max_layers FROM grid WHERE street IS NOT NULL GROUP BY 1)) g
 LEFT JOIN (SELECT g.street, string_agg(DISTINCT agency, '|' ORDER BY agency) AS agencies, string_agg(DISTINCT kind, '|' ORDER BY kind) AS factors FROM grid g
  JOIN fac_m f ON g.ix = CAST(floor(f.x/1000e0) AS BIGINT) AND g.iy = CAST(floor(f.y/1000e0) AS BIGINT) WHERE g.street IS NOT NULL GROUP BY 1) c USING (street)""", "grid fac_m")
def _(spark, d):
    out = S.grid_street_causes(_grid(spark, d), metric(B.factors(spark, d)), 1000.0)
    return out.withColumns({c: F.array_join(c, "|") for c in ("agencies", "factors")})


# ------------------------------------------------------------------ name joins
@query("registry_join", """SELECT c.c_custkey, 'A' || n_nationkey AS area_id FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND c.c_custkey % 3 < 2""")
def _(spark, d):
    reg = B.table(spark, d, "nation").select(
        F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("area_id"),
        F.array(F.col("n_name"), F.concat(F.lit("nação "), F.col("n_nationkey").cast("string"))).alias("spellings"))
    k, n = F.col("c_custkey") % 3, F.col("c_nationkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("nation_"), n)).when(k == 1, F.concat(F.lit("NACAO "), n)).otherwise(F.lit("?"))
    return Q.registry_join(B.table(spark, d, "customer").select("c_custkey", name.alias("name")), reg, "name").select("c_custkey", "area_id")


@query("prefix_join", """SELECT c.c_custkey, m.name AS match_name FROM customer c LEFT JOIN (SELECT left(lower(c_name),17) k, min(c_name) AS name FROM customer GROUP BY 1) m
 ON left(lower(c.c_name),17) = m.k""")
def _(spark, d):
    left = B.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    right = left.select("name")
    return Q.prefix_join(left, right, "name", "name", 17).select("c_custkey", "match_name")


@query("lookup_map", "SELECT c.id, z.fac_kind FROM cal c LEFT JOIN (SELECT col0 AS kind, col1 AS fac_kind FROM (VALUES ('1-URGENT','urgente'),('5-LOW','baixo'))) z USING (kind)", "cal")
def _(spark, d):
    dim = spark.createDataFrame([("1-URGENT", "urgente"), ("5-LOW", "baixo")], "kind string, fac_kind string")
    return M.lookup_join(B.calls(spark, d), dim, "kind").select("id", "fac_kind")


@query("pip_by_name", "SELECT cam.id AS camera_id, z.zone_id FROM cam LEFT JOIN zones z ON z.name = cam.area_name", "cam zones")
def _(spark, d):
    return Q.pip_by_name(B.cameras(spark, d), B.zones(spark, d), "area_name").select("camera_id", "zone_id")


@query("match_streets_to_lines", """SELECT s.street, coalesce(a.n, b.n, 0) AS n_lines FROM (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN street ELSE 'praia praia ' || street END AS street FROM cal) s
 LEFT JOIN (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'praia ' ELSE '' END || 'avenida sao ' || (p_partkey % 60) AS name, COUNT(DISTINCT p_partkey) n FROM part GROUP BY 1) a ON a.name = s.street
 LEFT JOIN (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'praia ' ELSE '' END || 'avenida sao ' || (p_partkey % 60) AS name, COUNT(DISTINCT p_partkey) n FROM part GROUP BY 1) b ON b.name = replace(s.street, 'praia praia ', 'praia ')""", "cal")
def _(spark, d):
    c = B.calls(spark, d)
    streets = c.select(F.when(c.id % 2 == 0, c.street).otherwise(F.concat(F.lit("praia praia "), c.street)).alias("street")).distinct()
    p = B.table(spark, d, "part")
    name = F.concat(F.when(p.p_partkey % 3 == 0, "praia ").otherwise(""), F.lit("avenida sao "), (p.p_partkey % 60).cast("string"))
    seg = p.select(X.norm_street(name).alias("street_norm"), F.col("p_partkey").alias("line_id"))
    return Q.match_streets_to_lines(streets, seg).select("street", "n_lines")


@query("flag_in_critical_street", """SELECT id, street IN (SELECT street FROM (SELECT street, COUNT(*) n FROM inc GROUP BY 1 HAVING COUNT(*) > 240)) AS in_critical_street FROM tip""", "tip inc")
def _(spark, d):
    crit = M.count_by(B.incidents(spark, d), ["street"]).filter("n > 240")
    return Q.flag_in_critical_street(B.tips(spark, d), crit).select("id", "in_critical_street")


@query("anti_known", "SELECT id FROM inc WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)", "inc")
def _(spark, d):
    known = B.calls(spark, d).filter(F.col("id") % 2 == 0)
    return Q.anti_known(B.incidents(spark, d), known, "id").select("id")


@query("distinct_set", "SELECT DISTINCT agency, kind FROM fac", "fac")
def _(spark, d):
    return Q.distinct_set(B.factors(spark, d), "agency", "kind")


@query("union_layers", "SELECT layer, COUNT(*) AS n FROM (SELECT 'inc' AS layer FROM inc UNION ALL SELECT 'tip' FROM tip UNION ALL SELECT 'fac' FROM fac) GROUP BY 1", "inc tip fac")
def _(spark, d):
    layer = lambda df, n: df.select("id", "lat", "lon", F.lit(n).alias("layer"))
    return M.count_by(Q.union_layers(layer(B.incidents(spark, d), "inc"), layer(B.tips(spark, d), "tip"), layer(B.factors(spark, d), "fac")), ["layer"])


# ------------------------------------------------------------------ city context
ctes.TABLES["cal_m"] = ("cal", f"SELECT * FROM {ctes.utm('(SELECT * FROM cal WHERE lat IS NOT NULL)')}")
ctes.TABLES["cring"] = ("cal_m cal_z edges_m", _RING.replace("inc_m", "cal_m").replace("inc_z", "cal_z"))


_DISPLACEMENT = """WITH ay AS (SELECT zone_id, year(day) AS y, COUNT(*) n FROM czone GROUP BY 1,2), ry AS (SELECT zone_id, year(day) AS y, COUNT(*) n FROM cring JOIN cal USING (id) GROUP BY 1,2),
 two AS (SELECT ay.*, row_number() OVER (PARTITION BY zone_id ORDER BY y DESC) k FROM ay),
 w AS (SELECT zone_id, max(CASE WHEN k=2 THEN y END) y0, max(CASE WHEN k=1 THEN y END) y1, max(CASE WHEN k=2 THEN two.n END) a0, max(CASE WHEN k=1 THEN two.n END) a1,
   coalesce(max(CASE WHEN k=2 THEN ry.n END),0) r0, coalesce(max(CASE WHEN k=1 THEN ry.n END),0) r1 FROM two LEFT JOIN ry USING (zone_id, y) WHERE k <= 2 GROUP BY 1),
 p AS (SELECT *, CASE WHEN a0 > 0 THEN round((a1-a0)*1e0/a0*100,1) END ap, CASE WHEN r0 > 0 THEN round((r1-r0)*1e0/r0*100,1) END rp FROM w)
 SELECT zone_id, CAST(y0 AS INT) AS year_prev, CAST(y1 AS INT) AS year_curr, ap AS area_yoy_pct, rp AS ring_yoy_pct,
 CASE WHEN ap IS NULL OR rp IS NULL THEN 'inconclusivo' WHEN ap <= -10 AND rp >= 10 THEN 'deslocamento_provavel' WHEN ap <= -10 AND rp <= -10 THEN 'reducao_genuina'
  WHEN ap >= 10 AND rp >= 10 THEN 'intensificacao' ELSE 'inconclusivo' END AS label,
 CASE WHEN ap IS NULL OR rp IS NULL OR least(a0,r0) < 10 THEN 'baixa' WHEN abs(ap-rp) >= 50 AND least(a0,r0) >= 30 THEN 'alta' ELSE 'media' END AS confidence,
 coalesce((SELECT COUNT(*) FROM cring c WHERE c.zone_id = p.zone_id),0) AS crimes_in_ring FROM p"""
ctes.TABLES["disp"] = ("czone cring cal", _DISPLACEMENT)
ctes.TABLES["tring"] = ("tip_m tip_z edges_m", _RING.replace("inc_m", "tip_m").replace("inc_z", "tip_z"))


@query("displacement", _DISPLACEMENT, "czone cring cal")
def _(spark, d):
    calls = B.calls(spark, d).filter(F.col("lat").isNotNull())
    return CC.displacement(calls, B.zone_edges(spark, d), index_of(spark, d))


@query("city_context", """WITH yrs AS (SELECT *, max(y) OVER (PARTITION BY zone_id) AS m FROM
 (SELECT zone_id, 'a' AS side, year(day) AS y, COUNT(*) AS n FROM czone GROUP BY ALL UNION ALL SELECT zone_id, 'r', year(day), COUNT(*) FROM cring JOIN cal USING (id) GROUP BY ALL) WHERE y IS NOT NULL),
 txt AS (SELECT zone_id, string_agg(y || ':' || n, '|' ORDER BY y) FILTER (side = 'a') AS area_years, string_agg(y || ':' || n, '|' ORDER BY y) FILTER (side = 'r') AS ring_years
  FROM yrs WHERE y >= m - 4 GROUP BY 1)
 SELECT z.zone_id, coalesce(r.n, 0) AS crimes_in_ring, coalesce(t.n, 0) AS tips_in_ring, coalesce(area_years, '') AS area_years, coalesce(ring_years, '') AS ring_years,
 year_prev, year_curr, area_yoy_pct, ring_yoy_pct, coalesce(label, 'inconclusivo') AS label, coalesce(confidence, 'baixa') AS confidence
 FROM (SELECT DISTINCT zone_id FROM edges) z LEFT JOIN disp USING (zone_id) LEFT JOIN txt USING (zone_id)
 LEFT JOIN (SELECT zone_id, COUNT(*) AS n FROM cring GROUP BY 1) r USING (zone_id) LEFT JOIN (SELECT zone_id, COUNT(*) AS n FROM tring GROUP BY 1) t USING (zone_id)""", "edges disp czone cring cal tring")
def _(spark, d):
    calls = B.calls(spark, d).filter(F.col("lat").isNotNull())
    out = CC.zone_contexts(calls, B.tips(spark, d), B.zone_edges(spark, d), index_of(spark, d))
    text = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws(":", r["year"].cast("string"), r["n"].cast("string"))), "|").alias(c)
    return out.select("zone_id", "crimes_in_ring", "tips_in_ring", text("area_years"), text("ring_years"), "year_prev", "year_curr",
                      "area_yoy_pct", "ring_yoy_pct", "label", "confidence")


@query("city_points", "SELECT id, round(lat,5) AS lat, round(lon,5) AS lon, offence, hour FROM inc", "inc")
def _(spark, d):
    return CC.city_points(B.incidents(spark, d))


@query("recent_years", """SELECT zone_id, year, area_n, ring_n FROM (SELECT *, max(year) OVER (PARTITION BY zone_id) AS m FROM
 (SELECT zone_id, CAST(year(day) AS INT) AS year, COUNT(*) AS area_n FROM czone GROUP BY 1,2) FULL JOIN (SELECT zone_id, CAST(year(day) AS INT) AS year, COUNT(*) AS ring_n FROM cring JOIN cal USING (id) GROUP BY 1,2)
 USING (zone_id, year)) WHERE year >= m - 4""", "czone cring cal")
def _(spark, d):
    from geoevents.operators import series as T

    calls = B.calls(spark, d).filter(F.col("lat").isNotNull())
    inside, ring = CC.ring_and_area(calls, B.zone_edges(spark, d), index_of(spark, d))
    return T.recent_years(T.year_counts(inside, ["zone_id"]), T.year_counts(ring, ["zone_id"]), ["zone_id"])


@query("census_geometry", """SELECT zone_id, round(abs(SUM(x1*y2-x2*y1))/2*pow(6378137e0*pi()/180,2)/1e6*cos(radians((min(y1)+max(y1))/2)),4) AS area_km2,
 round((min(x1)+max(x1))/2,6) AS lon, round((min(y1)+max(y1))/2,6) AS lat FROM nedges GROUP BY 1""", "nedges")
def _(spark, d):
    from geoevents.operators import census as Z

    out = rounded(Z.geometry_stats(B.neighbourhood_edges(spark, d)), "lon", "lat")
    return out.withColumn("area_km2", r6("area_km2", 4))
