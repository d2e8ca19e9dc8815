"""Queries of clusters, networks and the incremental store."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoevents.catalog import ctes
from geoevents.catalog.common import index_of, metric, rounded, zoned
from geoevents.catalog.registry import query
from geoevents.functions import fixed_values as V
from geoevents.operators import graph as N
from geoevents.operators import lines as LN
from geoevents.operators import severity as E
from geoevents.sources import bindings as B
from geoevents.streaming import store as ST

# ------------------------------------------------------------------ clusters
EPS = 500.0
ctes.TABLES["near2"] = ("inc_m", f"SELECT a.id AS a, b.id AS b FROM inc_m a JOIN inc_m b ON b.x BETWEEN a.x-{EPS} AND a.x+{EPS} AND pow(a.x-b.x,2)+pow(a.y-b.y,2) <= {EPS * EPS!r} AND a.id <> b.id")


def _labels(edges: str, nodes: str) -> str:
    """Smallest reachable id by recursive reachability."""
    return f"""WITH RECURSIVE reach(id, r) AS (SELECT id, id FROM {nodes} UNION SELECT reach.id, e.b FROM reach JOIN {edges} e ON e.a = reach.r)"""


def _points(spark, d):
    return metric(B.incidents(spark, d)).select("id", "x", "y", "offence")


@query("cluster_eps", _labels("near2", "inc") + " SELECT id, min(r) AS cluster_id FROM reach GROUP BY 1", "inc near2")
def _(spark, d):
    return N.cluster_eps(_points(spark, d), EPS).select("id", "cluster_id")


@query("cluster_summary", _labels("near2", "inc") + """ SELECT cluster_id, COUNT(*) AS n, round(AVG(x),3) AS x, round(AVG(y),3) AS y FROM (SELECT id, min(r) AS cluster_id FROM reach GROUP BY 1) JOIN inc_m USING (id) GROUP BY 1""", "inc near2 inc_m")
def _(spark, d):
    return rounded(N.cluster_summary(N.cluster_eps(_points(spark, d), EPS)).drop("severity"), "x", "y", digits=3)


DENSE_EPS = 900.0
ctes.TABLES["near3"] = ("inc_m", ctes.TABLES["near2"][1].replace(f"{EPS}", f"{DENSE_EPS}").replace(f"{EPS * EPS!r}", f"{DENSE_EPS * DENSE_EPS!r}"))
ctes.TABLES["core"] = ("inc near3", "SELECT id FROM inc JOIN (SELECT a AS id, COUNT(*) k FROM near3 GROUP BY 1) USING (id) WHERE k + 1 >= 4")
ctes.TABLES["cedge"] = ("near3 core", "SELECT a, b FROM near3 WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)")


@query("dbscan", _labels("cedge", "core") + """, cl AS (SELECT id, min(r) AS cluster_id FROM reach GROUP BY 1) SELECT id, cluster_id FROM cl UNION ALL
 SELECT n.a AS id, min(cl.cluster_id) FROM near3 n JOIN cl ON cl.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY 1""", "core cedge near3")
def _(spark, d):
    return N.dbscan(_points(spark, d), DENSE_EPS, 4)


# ------------------------------------------------------------------ street network
# parts are nodes of a grid 40 wide; streets run to the next part and to the one a row below
_NET = """SELECT a.p_partkey AS src, b.p_partkey AS dst, 10 + (a.p_size * 7 + b.p_size) % 60 AS w FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_partkey % 40 <> 39 AND a.p_size % 4 <> 0
 UNION ALL SELECT a.p_partkey, b.p_partkey, 10 + (a.p_size * 3 + b.p_size) % 70 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 40 AND a.p_size % 3 = 0"""
ctes.TABLES["net"] = ("", _NET)
ctes.TABLES["net2"] = ("net", "SELECT src AS a, dst AS b, w FROM net UNION ALL SELECT dst, src, w FROM net")


def _net(spark, d):
    p = B.table(spark, d, "part").select("p_partkey", "p_size")
    a = p.select(F.col("p_partkey").alias("src"), F.col("p_size").alias("sa"))
    b = p.select(F.col("p_partkey").alias("dst"), F.col("p_size").alias("sb"))
    right = a.filter((F.col("src") % 40 != 39) & (F.col("sa") % 4 != 0)).withColumns({"dst": F.col("src") + 1, "m": F.lit(7), "q": F.lit(60)})
    down = a.filter(F.col("sa") % 3 == 0).withColumns({"dst": F.col("src") + 40, "m": F.lit(3), "q": F.lit(70)})
    e = right.unionByName(down).join(b, "dst")
    return e.select("src", "dst", (F.lit(10) + (F.col("sa") * F.col("m") + F.col("sb")) % F.col("q")).cast("double").alias("w"))


@query("street_components", """WITH RECURSIVE reach(id, r) AS (SELECT DISTINCT a, a FROM net2 UNION SELECT reach.id, e.b FROM reach JOIN net2 e ON e.a = reach.r), comp AS (SELECT id, min(r) AS component FROM reach GROUP BY 1)
 SELECT src, dst, component, COUNT(*) OVER (PARTITION BY component) AS n_edges FROM net JOIN comp ON comp.id = net.src""", "net net2")
def _(spark, d):
    return N.street_components(_net(spark, d)).select("src", "dst", "component", "n_edges")


@query("component_diagnostics", """WITH RECURSIVE reach(id, r) AS (SELECT DISTINCT a, a FROM net2 UNION SELECT reach.id, e.b FROM reach JOIN net2 e ON e.a = reach.r), comp AS (SELECT id, min(r) AS component FROM reach GROUP BY 1),
 sz AS (SELECT component, COUNT(*) n FROM net JOIN comp ON comp.id = net.src GROUP BY 1) SELECT COUNT(*) AS n_components, max(n) AS largest, CAST(SUM(n) AS BIGINT) AS n_edges,
 greatest(COUNT(*) FILTER (n >= 10), 1) AS kept_components, CAST(coalesce(SUM(n) FILTER (n >= 10), max(n)) AS BIGINT) AS kept_edges FROM sz""", "net net2")
def _(spark, d):
    return N.component_diagnostics(N.street_components(_net(spark, d), min_edges=10))


@query("multi_source_distance", """WITH RECURSIVE go(node, dist) AS (SELECT s_suppkey * 13 % 2000, 0 FROM supplier UNION SELECT e.b, go.dist + e.w FROM go JOIN net2 e ON e.a = go.node WHERE go.dist + e.w <= 120)
 SELECT node, CAST(min(dist) AS DOUBLE) AS dist FROM go GROUP BY 1""", "net2")
def _(spark, d):
    src = B.table(spark, d, "supplier").select((F.col("s_suppkey") * 13 % 2000).alias("node"))
    return N.multi_source_distance(_net(spark, d), src, 120.0)


# nodes stand 60 m apart on the same grid, 10 m off the metric origin of the city
_NODES = "SELECT p_partkey AS node, 615000e0 + (p_partkey % 40)*60e0 AS x, 7440000e0 + (p_partkey // 40)*60e0 AS y FROM part"
ctes.TABLES["nodes"] = ("", _NODES)
ctes.TABLES["gcam"] = ("", "SELECT s_suppkey AS id, 615000e0 + (s_suppkey*37 % 2400) AS x, 7440000e0 + (s_suppkey*91 % 3000) AS y FROM supplier")
ctes.TABLES["ginc"] = ("", "SELECT o_orderkey AS id, 615000e0 + (o_orderkey*53 % 2600) AS x, 7440000e0 + (o_orderkey*17 % 3300) AS y, CASE o_orderstatus WHEN 'O' THEN 1.3e0 ELSE 1e0 END AS sev FROM orders")


def _grid_tables(spark, d):
    p = F.col("p_partkey")
    nodes = B.table(spark, d, "part").select(p.alias("node"), (F.lit(615000.0) + p % 40 * 60.0).alias("x"), (F.lit(7440000.0) + F.floor(p / 40) * 60.0).alias("y"))
    s, o = F.col("s_suppkey"), F.col("o_orderkey")
    cams = B.table(spark, d, "supplier").select(s.alias("camera_id"), (F.lit(615000.0) + s * 37 % 2400).alias("x"), (F.lit(7440000.0) + s * 91 % 3000).alias("y"))
    inc = B.table(spark, d, "orders").select(o.alias("id"), (F.lit(615000.0) + o * 53 % 2600).alias("x"), (F.lit(7440000.0) + o * 17 % 3300).alias("y"), F.when(F.col("o_orderstatus") == "O", V.ROBBERY_BUS).otherwise(F.col("o_orderstatus")).alias("offence"))
    return nodes, cams, inc


_SNAP = "SELECT t.id, first(n.node ORDER BY pow(t.x-n.x,2)+pow(t.y-n.y,2), n.node) AS node, sqrt(min(pow(t.x-n.x,2)+pow(t.y-n.y,2))) AS d FROM {t} t CROSS JOIN nodes n GROUP BY 1"


@query("network_coverage", f"""WITH RECURSIVE cs AS ({_SNAP.format(t='gcam')}), go(node, dist) AS (SELECT node, 0 FROM cs UNION SELECT e.b, go.dist + e.w FROM go JOIN net2 e ON e.a = go.node WHERE go.dist + e.w <= 50),
 sn AS ({_SNAP.format(t='ginc')}) SELECT sn.id, CASE WHEN sn.d <= 120 THEN sn.node IN (SELECT node FROM go) ELSE EXISTS (SELECT 1 FROM gcam c JOIN ginc g ON g.id = sn.id WHERE pow(g.x-c.x,2)+pow(g.y-c.y,2) <= 2500) END AS covered FROM sn""", "net2 nodes gcam ginc")
def _(spark, d):
    nodes, cams, inc = _grid_tables(spark, d)
    return N.network_coverage(inc, cams, nodes, _net(spark, d))


ctes.TABLES["open_"] = ("ginc gcam", "SELECT * FROM ginc g WHERE NOT EXISTS (SELECT 1 FROM gcam c WHERE pow(g.x-c.x,2)+pow(g.y-c.y,2) <= 2500)")
ctes.TABLES["open2"] = ("open_", "SELECT a.id AS a, b.id AS b FROM open_ a JOIN open_ b ON a.id <> b.id AND pow(a.x-b.x,2)+pow(a.y-b.y,2) <= 400")


@query("camera_gaps", _labels("open2", "open_") + """, cl AS (SELECT id, min(r) AS cluster_id FROM reach GROUP BY 1), s AS (SELECT cluster_id, COUNT(*) AS n, SUM(sev) AS sv, AVG(x) AS x, AVG(y) AS y FROM cl JOIN open_ USING (id) GROUP BY 1),
 d AS (SELECT s.*, (SELECT sqrt(min(pow(s.x-c.x,2)+pow(s.y-c.y,2))) FROM gcam c) AS m FROM s), p AS (SELECT *, sv*(1e0+least(m/200e0,1e0)) AS pr FROM d)
 SELECT cluster_id, n, round(m,3) AS nearest_camera_m, round(pr,2) AS priority, CASE WHEN m <= 100 THEN 'remanejar' ELSE 'instalar' END AS recommendation FROM p ORDER BY round(pr,2) DESC, cluster_id LIMIT 15""", "open_ open2 gcam")
def _(spark, d):
    _nodes, cams, inc = _grid_tables(spark, d)
    gaps = N.camera_gaps(inc, cams, eps_m=20.0)
    return rounded(gaps, "nearest_camera_m", digits=3).select("cluster_id", "n", "nearest_camera_m", "priority", "recommendation")


ctes.TABLES["gnodes"] = ("nodes net2", "SELECT * FROM nodes WHERE node IN (SELECT a FROM net2)")
_GSNAP = _SNAP.replace("JOIN nodes n", "JOIN gnodes n")
ctes.TABLES["gopen"] = ("ginc gcam gnodes net2", f"""WITH RECURSIVE cs AS ({_GSNAP.format(t='gcam')}), go(node, dist) AS (SELECT DISTINCT node, 0 FROM cs UNION SELECT e.b, go.dist + e.w FROM go JOIN net2 e ON e.a = go.node WHERE go.dist + e.w <= 50),
 sn AS ({_GSNAP.format(t='ginc')}) SELECT g.* FROM ginc g JOIN sn USING (id) WHERE NOT CASE WHEN sn.d <= 120 THEN sn.node IN (SELECT node FROM go) ELSE EXISTS (SELECT 1 FROM gcam c WHERE pow(g.x-c.x,2)+pow(g.y-c.y,2) <= 2500) END""")
ctes.TABLES["gopen2"] = ("gopen", "SELECT a.id AS a, b.id AS b FROM gopen a JOIN gopen b ON a.id <> b.id AND pow(a.x-b.x,2)+pow(a.y-b.y,2) <= 64")


@query("camera_gaps_network", f"""WITH RECURSIVE reach(id, r) AS (SELECT id, id FROM gopen UNION SELECT reach.id, e.b FROM reach JOIN gopen2 e ON e.a = reach.r), cl AS (SELECT id, min(r) AS cluster_id FROM reach GROUP BY 1),
 s AS (SELECT cluster_id AS id, COUNT(*) AS n, SUM(sev) AS sv, AVG(x) AS x, AVG(y) AS y FROM cl JOIN gopen USING (id) GROUP BY 1), cs AS ({_GSNAP.format(t='gcam')}),
 far(node, dist) USING KEY (node) AS (SELECT DISTINCT node, CAST(0 AS BIGINT) FROM cs UNION SELECT e.b, min(far.dist + e.w) FROM far JOIN net2 e ON e.a = far.node LEFT JOIN recurring.far r ON r.node = e.b WHERE r.dist IS NULL OR far.dist + e.w < r.dist GROUP BY e.b),
 sn AS ({_GSNAP.format(t='s')}), d AS (SELECT s.*, CASE WHEN sn.d <= 120 THEN far.dist END AS net, (SELECT sqrt(min(pow(s.x-c.x,2)+pow(s.y-c.y,2))) FROM gcam c) AS m FROM s JOIN sn USING (id) LEFT JOIN far ON far.node = sn.node),
 p AS (SELECT *, round(sv*(1e0+least(coalesce(net,m)/200e0,1e0)),2) AS pr FROM d)
 SELECT id AS cluster_id, n, round(m,3) AS nearest_camera_m, CAST(net AS DOUBLE) AS network_camera_m, pr AS priority, CASE WHEN coalesce(net,m) <= 100 THEN 'remanejar' ELSE 'instalar' END AS recommendation FROM p ORDER BY pr DESC, id LIMIT 15""", "gopen gopen2 gcam gnodes net2")
def _(spark, d):
    nodes, cams, inc = _grid_tables(spark, d)
    gaps = N.camera_gaps_on_network(inc, cams, nodes, _net(spark, d), eps_m=8.0)
    return rounded(gaps, "nearest_camera_m", digits=3).select("cluster_id", "n", "nearest_camera_m", "network_camera_m", "priority", "recommendation")


@query("query_gaps", _labels("open2", "open_") + """, cl AS (SELECT id, min(r) AS cluster_id FROM reach GROUP BY 1), s AS (SELECT cluster_id, COUNT(*) AS n, SUM(sev) AS sv, AVG(x) AS x, AVG(y) AS y FROM cl JOIN open_ USING (id) GROUP BY 1),
 d AS (SELECT s.*, (SELECT sqrt(min(pow(s.x-c.x,2)+pow(s.y-c.y,2))) FROM gcam c) AS m FROM s) SELECT cluster_id, round(sv*(1e0+least(m/200e0,1e0)),2) AS priority FROM d ORDER BY 2 DESC, 1 LIMIT 5""", "open_ open2 gcam")
def _(spark, d):
    from geoevents.operators import queries as Q

    _nodes, cams, inc = _grid_tables(spark, d)
    gaps = N.camera_gaps(inc, cams, eps_m=20.0).withColumn("zone_id", F.lit("all"))
    return Q.query_gaps(gaps, "all", top=5).select("cluster_id", "priority")


@query("snap_endpoints", """WITH RECURSIVE e AS (SELECT o_orderkey AS id, 615000e0 + (o_orderkey*53 % 2600) AS x, 7440000e0 + (o_orderkey*17 % 3300) AS y FROM orders), near_ AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id AND pow(a.x-b.x,2)+pow(a.y-b.y,2) <= 144),
 reach(id, r) AS (SELECT id, id FROM e UNION SELECT reach.id, n.b FROM reach JOIN near_ n ON n.a = reach.r), cl AS (SELECT id, min(r) AS cluster_id FROM reach GROUP BY 1)
 SELECT id AS end_id, cluster_id, round(AVG(x) OVER (PARTITION BY cluster_id),3) AS x, round(AVG(y) OVER (PARTITION BY cluster_id),3) AS y FROM cl JOIN e USING (id)""")
def _(spark, d):
    inc = _grid_tables(spark, d)[2].select(F.col("id").alias("end_id"), "x", "y")
    return rounded(N.snap_endpoints(inc), "x", "y", digits=3)


@query("build_street_edges", """SELECT least(p,q) AS src, greatest(p,q) AS dst, round(min(w),4) AS w FROM (SELECT CAST(x1 AS VARCHAR) || ':' || CAST(y1 AS VARCHAR) AS p, CAST(x2 AS VARCHAR) || ':' || CAST(y2 AS VARCHAR) AS q, sqrt(pow(x1-x2,2)+pow(y1-y2,2)) AS w
 FROM (SELECT l_orderkey % 30 + 0.5e0 AS x1, l_partkey % 20 + 0.5e0 AS y1, l_suppkey % 30 + 0.5e0 AS x2, l_linenumber + 0.5e0 AS y2 FROM lineitem) WHERE x1 <> x2 OR y1 <> y2) GROUP BY 1,2""")
def _(spark, d):
    li = B.table(spark, d, "lineitem")
    h = F.lit(0.5)
    seg = li.select((F.col("l_orderkey") % 30 + h).alias("x1"), (F.col("l_partkey") % 20 + h).alias("y1"), (F.col("l_suppkey") % 30 + h).alias("x2"), (F.col("l_linenumber") + h).alias("y2"))
    return rounded(N.build_street_edges(seg), "w", digits=4)


# Recursion over spans: the farthest inner vertex beyond the tolerance parts a span.
_SIMPLIFY = """SELECT line_id, seq, x, y FROM pts WHERE (line_id, i) IN (
 WITH RECURSIVE spans(line_id, lo, hi) AS (SELECT line_id, 1::BIGINT, max(i) FROM pts GROUP BY 1
  UNION ALL SELECT line_id, unnest([lo, m]), unnest([m, hi]) FROM (
   SELECT line_id, lo, hi, first(i ORDER BY off DESC, i) AS m, max(off) AS most FROM (
    SELECT s.line_id, s.lo, s.hi, p.i, sqrt(pow(p.x-a.x-t*(b.x-a.x),2)+pow(p.y-a.y-t*(b.y-a.y),2)) AS off FROM spans s
     JOIN pts a ON a.line_id = s.line_id AND a.i = s.lo JOIN pts b ON b.line_id = s.line_id AND b.i = s.hi
     JOIN pts p ON p.line_id = s.line_id AND p.i > s.lo AND p.i < s.hi,
     LATERAL (SELECT least(1e0, greatest(0e0, ((p.x-a.x)*(b.x-a.x)+(p.y-a.y)*(b.y-a.y))/(pow(b.x-a.x,2)+pow(b.y-a.y,2)))) AS t))
   GROUP BY 1,2,3) WHERE most > 0.3)
 SELECT line_id, lo FROM spans UNION SELECT line_id, hi FROM spans)"""
ctes.TABLES["pts"] = ("", "SELECT o_custkey AS line_id, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey::DOUBLE AS x, sin(o_orderkey/50e0) AS y FROM orders")


@query("simplify_lines", _SIMPLIFY, "pts")
def _(spark, d):
    o = B.table(spark, d, "orders")
    line = o.select((F.col("o_custkey")).alias("line_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("double").alias("x"), F.sin(F.col("o_orderkey") / 50.0).alias("y"))
    return LN.simplify_lines(line, 0.3)


# Streets drawn through their parts in order: cut at every zone border, pieces tested by their middle, islands of pieces in a row.
ctes.TABLES["drawn"] = ("", f"""SELECT a.id AS segment_id, 'avenida sao ' || (a.id % 60) AS street_norm, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2
 FROM (SELECT p_partkey AS id, {ctes.place('p_partkey', 6271, 15485863)} FROM part) a JOIN (SELECT p_partkey AS id, {ctes.place('p_partkey', 6271, 15485863)} FROM part) b ON b.id = a.id + 60""")
ctes.TABLES["cuts"] = ("drawn edges", """SELECT segment_id, 0e0 AS t FROM drawn UNION SELECT segment_id, 1e0 FROM drawn UNION SELECT segment_id, t FROM (
 SELECT s.segment_id, ((e.x1-s.x1)*(e.y2-e.y1)-(e.y1-s.y1)*(e.x2-e.x1))/((s.x2-s.x1)*(e.y2-e.y1)-(s.y2-s.y1)*(e.x2-e.x1)) AS t FROM drawn s JOIN edges e
 ON (((s.x2-s.x1)*(e.y1-s.y1)-(s.y2-s.y1)*(e.x1-s.x1)) > 0) <> (((s.x2-s.x1)*(e.y2-s.y1)-(s.y2-s.y1)*(e.x2-s.x1)) > 0)) WHERE t > 0 AND t < 1""")
ctes.TABLES["pieces"] = ("drawn cuts", """SELECT row_number() OVER () AS id, * FROM (SELECT s.segment_id, street_norm, t AS a, b, CASE WHEN t = 0 THEN x1 ELSE x1+t*(x2-x1) END AS x1, CASE WHEN t = 0 THEN y1 ELSE y1+t*(y2-y1) END AS y1,
 CASE WHEN b = 1 THEN x2 ELSE x1+b*(x2-x1) END AS x2, CASE WHEN b = 1 THEN y2 ELSE y1+b*(y2-y1) END AS y2, ((CASE WHEN t = 0 THEN x1 ELSE x1+t*(x2-x1) END)+(CASE WHEN b = 1 THEN x2 ELSE x1+b*(x2-x1) END))/2 AS lon,
 ((CASE WHEN t = 0 THEN y1 ELSE y1+t*(y2-y1) END)+(CASE WHEN b = 1 THEN y2 ELSE y1+b*(y2-y1) END))/2 AS lat
 FROM (SELECT *, lead(t) OVER (PARTITION BY segment_id ORDER BY t) AS b FROM cuts) JOIN drawn s USING (segment_id) WHERE b IS NOT NULL)""")
ctes.TABLES["piece_z"] = ("pieces edges", ctes.pip("pieces"))
ctes.TABLES["islands"] = ("pieces piece_z czone", """SELECT *, sum(new) OVER (PARTITION BY zone_id, street_norm ORDER BY segment_id, a) AS island FROM (
 SELECT *, CASE WHEN lag(x2) OVER w = x1 AND lag(y2) OVER w = y1 THEN 0 ELSE 1 END AS new FROM pieces JOIN piece_z USING (id) SEMI JOIN czone ON czone.zone_id = piece_z.zone_id AND czone.street = pieces.street_norm WINDOW w AS (PARTITION BY zone_id, street_norm ORDER BY segment_id, a))""")
_LINES = """SELECT zone_id, street_norm, CAST(dense_rank() OVER (PARTITION BY zone_id, street_norm ORDER BY least(s, e), greatest(s, e)) AS INT) AS line,
 CAST(CASE WHEN s < e THEN k ELSE n - k END AS BIGINT) AS seq, x, y FROM (
 SELECT *, max(k) OVER i AS n, first({'x': x, 'y': y}) OVER (PARTITION BY zone_id, street_norm, island ORDER BY k) AS s, last({'x': x, 'y': y}) OVER i AS e FROM (
  SELECT zone_id, street_norm, island, 0 AS k, first(x1 ORDER BY segment_id, a) AS x, first(y1 ORDER BY segment_id, a) AS y FROM islands GROUP BY 1,2,3
  UNION ALL SELECT zone_id, street_norm, island, row_number() OVER (PARTITION BY zone_id, street_norm, island ORDER BY segment_id, a), x2, y2 FROM islands)
 WINDOW i AS (PARTITION BY zone_id, street_norm, island ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("street_lines", _LINES, "islands")
def _(spark, d):
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[c.alias(n) for n, c in B.place("p_partkey", 6271, 15485863).items()])
    ends = p.select((F.col("id") - 60).alias("id"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    name = F.concat(F.lit("avenida sao "), (F.col("id") % 60).cast("string"))
    drawn = p.join(ends, "id").select(F.col("id").alias("segment_id"), name.alias("street_norm"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), "x2", "y2")
    edges = B.zone_edges(spark, d)
    streets = zoned(spark, d, B.calls(spark, d)).select("zone_id", "street").distinct()
    return LN.street_lines(streets, drawn, edges, index_of(spark, d))


# ------------------------------------------------------------------ incremental store (batch forms)
@query("append_dedupe", "SELECT user_id AS id, coalesce(min(event_id) FILTER (event_type = 'purchase'), min(event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    e = B.table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    stored = ST.latest_first(e.filter("event_type = 'purchase'"), "id", "event_id")
    return ST.append_dedupe_batch(stored, e, "id", "event_id").select("id", "event_id")


@query("upsert_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(spark, d):
    e = B.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return ST.latest(e, "user_id", ["event_id"])


@query("checkpoint_state", "SELECT account, arg_max(id, (day, id)) AS newest_id, COUNT(*) AS n, CAST(max(day) AS VARCHAR) AS updated_at FROM posts GROUP BY 1", "posts")
def _(spark, d):
    out = ST.checkpoint_state(B.posts(spark, d), "account", "id", "day")
    return out.withColumn("updated_at", F.col("updated_at").cast("string"))


@query("rolling_score", """SELECT strftime(w.day, '%Y-%m-%d') AS window_end, area, round(SUM(s_event),4) AS s_sum, COUNT(*) AS n FROM sev JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-03-30', INTERVAL 1 DAY)) AS DATE) AS day) w
 ON sev.day < w.day AND sev.day >= w.day - 30 GROUP BY 1,2""", "sev")
def _(spark, d):
    scored = E.event_severity(E.keyed_events(B.nested_events(spark, d))).withColumn("ts", F.col("day").cast("timestamp"))
    out = ST.rolling_score(scored, ["area"], days=30)
    return rounded(out.select(F.date_format("window_end", "yyyy-MM-dd").alias("window_end"), "area", "s_sum", "n"), "s_sum", digits=4)


@query("stream_zone_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS window_start, zone_id, COUNT(*) AS n FROM izone GROUP BY 1,2", "izone")
def _(spark, d):
    out = ST.stream_zone_counts(B.incidents(spark, d), index_of(spark, d))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))
