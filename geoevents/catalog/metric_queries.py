"""Queries of filters, grouped measures, ranks, samples and census."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoevents.catalog import ctes
from geoevents.catalog.common import index_of, joined_text, r6, report_of, rounded, zoned
from geoevents.catalog.registry import query
from geoevents.functions import temporal as D
from geoevents.functions import text as X
from geoevents.operators import census as Z
from geoevents.operators import metrics as M
from geoevents.operators import queries as Q
from geoevents.operators import ranking as R
from geoevents.sources import bindings as B
from geoevents.sources import scans as SC

ZONE = ["zone_id"]


def incidents_in_zones(spark, d):
    return zoned(spark, d, B.incidents(spark, d))


# ------------------------------------------------------------------ scans and quality
@query("scan_incidents", """SELECT id, CASE WHEN hour IS NULL THEN NULL ELSE hour END AS hour, CASE WHEN street = '' THEN '' ELSE 'avenida são ' || split_part(street,' ',3) END AS street,
 strftime(day, '%d/%m/%Y') AS data FROM inc""", "inc")
def _(spark, d):
    e = B.table(spark, d, "events").filter(SC.in_bbox(*B.place("event_id", 7919, 104729).values()))
    text = F.when(F.col("event_id") % 17 != 0, F.date_format("ts", "HH:mm")).otherwise("sem hora")
    u = F.col("user_id")
    locf = F.when(u % 31 != 0, F.concat(F.lit("Avenida Avenida São "), (u % 40).cast("string")))
    return e.select(F.col("event_id").alias("id"), D.parse_hour(text).alias("hour"), X.dedupe_prefix(locf).alias("street"),
                    F.date_format("ts", "dd/MM/yyyy").alias("data"))


@query("scan_tips_split", """SELECT CASE WHEN lat IS NOT NULL THEN 'geo' ELSE 'nogeo' END AS part, kind, COUNT(*) AS n FROM tip WHERE regexp_matches(kind, '(?i)roubo|furto') GROUP BY 1,2""", "tip")
def _(spark, d):
    t = B.tips(spark, d).filter(X.type_regex(F.col("kind"), "ROUBO|FURTO"))
    ok = SC.in_bbox(F.col("lat"), F.col("lon"))
    return M.count_by(t.withColumn("part", F.when(ok, "geo").otherwise("nogeo")), ["part", "kind"])


@query("scan_tips_by_type", "SELECT id FROM tip WHERE kind = 'CONSUMO DE DROGAS' AND lat IS NOT NULL", "tip")
def _(spark, d):
    t = B.tips(spark, d)
    return t.filter(X.type_regex(F.col("kind"), "consumo de drogas") & SC.in_bbox(t.lat, t.lon)).select("id")


@query("scan_cameras_wkt", "SELECT id AS camera_id, round(lat,6) AS lat, round(lon,6) AS lon FROM cam", "cam")
def _(spark, d):
    c = B.cameras(spark, d)
    wkt = F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    lat, lon = SC.wkt_point(F.col("wkt"))
    return rounded(c.select("camera_id", wkt.alias("wkt")).select("camera_id", lat.alias("lat"), lon.alias("lon")), "lat", "lon")


@query("flag_quality", """SELECT o_orderkey AS line, o_custkey AS id, COUNT(*) OVER (PARTITION BY o_custkey) > 1 AS _is_duplicate, lat IS NOT NULL AS _has_coords,
 coalesce(lat IS NOT NULL AND NOT (lat BETWEEN -23.1e0 AND -22.8e0 AND lon BETWEEN -43.8e0 AND -43.1e0), FALSE) AS _outside_city
 FROM orders JOIN cal ON cal.id = o_orderkey""", "cal")
def _(spark, d):
    df = B.calls(spark, d).select(F.col("id").alias("line"), F.col("person").alias("id"), "lat", "lon")
    return SC.flag_quality(df, "id", bbox=(-23.1, -22.8, -43.8, -43.1)).drop("lat", "lon")


@query("collapse_continuation_rows", """SELECT conv_id AS id, COUNT(*) AS n_lines, first(role ORDER BY turn) AS role, CAST(SUM(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1""")
def _(spark, d):
    c = B.table(spark, d, "conversations")
    first = F.col("turn") == 0
    lines = c.select(F.when(first, F.col("conv_id")).alias("id"), (F.col("conv_id") * 100000 + F.col("turn")).alias("line"), "role", "text")
    out = SC.collapse_continuation_rows(lines, "id", "line", ["text"], block_lines=5_000_000)
    texts = F.from_json("text", "array<string>")
    chars = F.aggregate(texts, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t))
    return out.select("id", F.size(texts).cast("bigint").alias("n_lines"), "role", chars.alias("n_chars"))


@query("scan_posts", "SELECT id FROM posts WHERE NOT is_retweet AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)) <> '' AND regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(roub|assalt|furt|levaram|arrast[aã]o|abord(a|aram|ou)|abandonad[ao])')", "posts")
def _(spark, d):
    return SC.usable_posts(B.posts(spark, d)).select("id")


@query("scan_posts_all", "SELECT id, account FROM posts WHERE NOT is_retweet AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)) <> ''", "posts")
def _(spark, d):
    return SC.usable_posts(B.posts(spark, d), keyword_only=False).select("id", "account")


@query("scan_classified_posts", """SELECT p.id FROM posts p JOIN labels l ON l.doc_id = p.conv_id WHERE NOT is_retweet AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)) <> '' AND l.quality = 1 AND (l.doc_id % 100)/1e2 >= 0.5e0""", "posts")
def _(spark, d):
    lab = B.table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), F.struct(
        (F.col("quality") == 1).alias("is_relevant"), ((F.col("doc_id") % 100) / 100.0).alias("confidence")).alias("relevance"))
    posts = SC.usable_posts(B.posts(spark, d).join(lab, "conv_id"), keyword_only=False)
    return posts.filter(F.col("relevance.is_relevant") & (F.col("relevance.confidence") >= 0.5)).select("id")


@query("scan_reports", """SELECT 'RI_0' || (10 + doc_id % 12) AS code, doc_id, CASE WHEN text = '' THEN 0 ELSE (len(string_split(text, chr(10))) + 1)//2 END AS n_sections,
 string_split(text, chr(10))[1] AS first_title FROM documents WHERE doc_id % 12 < 8""")
def _(spark, d):
    doc = B.table(spark, d, "documents")
    code = F.concat(F.lit("RI_0"), (F.col("doc_id") % 12 + 10).cast("string"))
    df = doc.select("doc_id", code.alias("code"), F.concat(F.lit("doc "), F.lower(code), F.lit(".docx")).alias("filename"),
                    F.lit("").alias("full_text"), F.split("text", "\n").alias("sections"))
    rep = SC.report_fields(df.withColumn("filename", F.concat("filename", F.lit("#"), F.col("doc_id").cast("string"))))
    # the report keeps its area; the code is recovered from it to compare
    from geoevents.functions import fixed_values as V

    back = {v: k for k, v in V.REPORT_AREAS.items()}
    keyed = SC.pair_sections(F.split("text", "\n"))
    per = doc.select("doc_id", X.lookup(code, V.REPORT_AREAS).alias("area"), keyed.alias("s")).filter("area is not null")
    per = per.join(rep.select("area").distinct(), "area", "left_semi")
    return per.select(X.lookup(F.col("area"), back).alias("code"), "doc_id", F.size("s").cast("bigint").alias("n_sections"),
                      F.col("s")[0]["titulo"].alias("first_title"))


# ------------------------------------------------------------------ filters
@query("filter_type_regex", "SELECT kind, COUNT(*) AS n FROM tip WHERE regexp_matches(kind,'(?i)roubo') GROUP BY 1", "tip")
def _(spark, d):
    return M.count_by(Q.filter_type_regex(B.tips(spark, d), "kind", "roubo"), ["kind"])


@query("filter_hour_range", "SELECT id, hour FROM inc WHERE hour >= 20 AND hour < 24", "inc")
def _(spark, d):
    return Q.filter_hour_range(B.incidents(spark, d), 20, 30).select("id", "hour")


@query("filter_points", "SELECT id FROM inc WHERE (lower(offence) LIKE '%celular%' OR lower(offence) LIKE '%aparelho%') AND hour >= 6 AND hour < 18", "inc")
def _(spark, d):
    return Q.filter_points(B.incidents(spark, d), "celular", 6, 18).select("id")


@query("match_kind", """SELECT offence, contains(lower(offence),'transeunte') AS transeunte, contains(lower(offence),'celular') OR contains(lower(offence),'aparelho') AS celular,
 contains(lower(offence),'coletivo') AS coletivo FROM (SELECT DISTINCT offence FROM inc)""", "inc")
def _(spark, d):
    o = B.incidents(spark, d).select("offence").distinct()
    return o.select("offence", *[X.match_kind(F.col("offence"), k).alias(k) for k in ("transeunte", "celular", "coletivo")])


@query("recent_incidents", "SELECT offence, COUNT(*) AS n FROM inc WHERE day >= (SELECT max(day) FROM inc) - 7 GROUP BY 1", "inc")
def _(spark, d):
    return M.recent_incidents(B.incidents(spark, d), 7)


@query("window_filter", "SELECT id FROM cal WHERE day BETWEEN (SELECT max(day) FROM cal) - 30 AND (SELECT max(day) FROM cal)", "cal")
def _(spark, d):
    return M.window_filter(B.calls(spark, d), 30).select("id")


@query("keyword_prefilter", "SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 4 = 0 THEN ' arrastão' WHEN doc_id % 4 = 1 THEN ' desassaltado' ELSE '' END, '(?i)(^|[^\\p{L}\\p{N}_])(roub|assalt|furt|levaram|arrast[aã]o|abord(a|aram|ou)|abandonad[ao])') AS hit FROM documents")
def _(spark, d):
    k = F.col("doc_id") % 4
    text = F.concat("text", F.when(k == 0, " arrastão").when(k == 1, " desassaltado").otherwise(""))
    return B.table(spark, d, "documents").select("doc_id", X.keyword_prefilter(text).alias("hit"))


@query("since_filter", """SELECT CASE WHEN day < DATE '2024-01-20' THEN 'too_old' WHEN conv_id % 5 = 0 THEN 'known' ELSE 'new' END AS status, COUNT(*) AS n FROM posts GROUP BY 1""", "posts")
def _(spark, d):
    p = B.posts(spark, d)
    return Q.since_filter(p, "2024-01-20", p.filter(F.col("conv_id") % 5 == 0))[1]


# ------------------------------------------------------------------ histograms and shares
@query("count_by", "SELECT zone_id, offence, COUNT(*) AS n FROM izone GROUP BY 1,2", "izone")
def _(spark, d):
    return M.count_by(incidents_in_zones(spark, d), ["zone_id", "offence"])


@query("hour_histogram", "SELECT zone_id, hour, COUNT(*) AS n FROM izone WHERE hour IS NOT NULL GROUP BY 1,2", "izone")
def _(spark, d):
    return M.hour_histogram(incidents_in_zones(spark, d), ZONE)


@query("weekday_histogram", "SELECT zone_id, weekday, COUNT(*) AS n FROM izone GROUP BY 1,2", "izone")
def _(spark, d):
    return M.weekday_histogram(incidents_in_zones(spark, d), ZONE)


_MATRIX = """SELECT o.offence, CAST(w AS INT) AS weekday, CAST(h AS INT) AS hour, coalesce(c.n,0) AS n FROM (SELECT DISTINCT offence FROM inc) o, range(0,7) a(w), range(0,24) b(h)
 LEFT JOIN (SELECT offence, weekday, hour, COUNT(*) n FROM inc WHERE hour IS NOT NULL GROUP BY 1,2,3) c ON c.offence = o.offence AND c.weekday = w AND c.hour = h"""
ctes.TABLES["matrix"] = ("inc", _MATRIX)


def _matrix(spark, d):
    return M.hour_weekday_matrix(B.incidents(spark, d), ["offence"])


@query("hour_weekday_matrix", "SELECT * FROM matrix", "matrix")
def _(spark, d):
    return _matrix(spark, d)


@query("hour_weekday_rollup", """SELECT offence, hour, NULL::INT AS weekday, CAST(SUM(n) AS BIGINT) AS n, 'hour' AS axis FROM matrix GROUP BY 1,2
 UNION ALL SELECT offence, NULL, weekday, CAST(SUM(n) AS BIGINT), 'weekday' FROM matrix GROUP BY 1,3""", "matrix")
def _(spark, d):
    return M.hour_weekday_rollup(_matrix(spark, d), ["offence"])


@query("matrix_summary", """SELECT offence, CAST(SUM(n) AS BIGINT) AS total_with_time, max(n) AS peak_cell_n, first(weekday ORDER BY n DESC, weekday, hour) AS peak_cell_weekday,
 first(hour ORDER BY n DESC, weekday, hour) AS peak_cell_hour, (SELECT hour FROM matrix b WHERE b.offence = a.offence GROUP BY hour ORDER BY SUM(n) DESC, hour LIMIT 1) AS peak_hour,
 (SELECT hour || 'h' FROM matrix b WHERE b.offence = a.offence GROUP BY hour ORDER BY SUM(n) DESC, hour LIMIT 1) AS peak_label,
 (SELECT weekday FROM matrix b WHERE b.offence = a.offence GROUP BY weekday ORDER BY SUM(n) DESC, weekday LIMIT 1) AS peak_weekday FROM matrix a GROUP BY 1""", "matrix")
def _(spark, d):
    return M.matrix_summary(_matrix(spark, d), ["offence"])


@query("peak_hour", "SELECT zone_id, first(hour ORDER BY n DESC, hour) AS peak_hour, first(hour ORDER BY n DESC, hour) || 'h' AS peak_label FROM (SELECT zone_id, hour, COUNT(*) n FROM izone WHERE hour IS NOT NULL GROUP BY 1,2) GROUP BY 1", "izone")
def _(spark, d):
    return M.peak_hour(M.hour_histogram(incidents_in_zones(spark, d), ZONE), ZONE)


@query("peak_ratio", "SELECT zone_id, round(SUM(n) FILTER (rn <= 3)*1e0/SUM(n),6) AS peak_ratio FROM (SELECT zone_id, hour, COUNT(*) n, row_number() OVER (PARTITION BY zone_id ORDER BY COUNT(*) DESC) rn FROM izone WHERE hour IS NOT NULL GROUP BY 1,2) GROUP BY 1", "izone")
def _(spark, d):
    return rounded(M.peak_ratio(M.hour_histogram(incidents_in_zones(spark, d), ZONE), ZONE), "peak_ratio")


@query("night_share", "SELECT zone_id, round(COUNT(*) FILTER (hour >= 18 OR hour <= 5)*100e0/COUNT(hour),6) AS night_pct FROM izone GROUP BY 1", "izone")
def _(spark, d):
    return M.night_share(incidents_in_zones(spark, d), ZONE, digits=6)


@query("night_share_all_rows", "SELECT street, round(COUNT(*) FILTER (hour >= 18 OR hour <= 5)*100e0/COUNT(*),6) AS night_pct FROM inc GROUP BY 1", "inc")
def _(spark, d):
    return M.night_share(B.incidents(spark, d), ["street"], digits=6, base="all")


@query("share_of_total", "SELECT offence, n, round(n*100e0/SUM(n) OVER (),6) AS share_pct FROM (SELECT offence, COUNT(*) n FROM inc GROUP BY 1)", "inc")
def _(spark, d):
    return rounded(R.share_of_total(M.count_by(B.incidents(spark, d), ["offence"]), "n"), "share_pct")


@query("type_ranking", "SELECT offence, n, round(n*100e0/SUM(n) OVER (),6) AS pct, CAST(row_number() OVER (ORDER BY n DESC, offence) AS INT) AS rank FROM (SELECT offence, COUNT(*) n FROM inc GROUP BY 1)", "inc")
def _(spark, d):
    return R.type_ranking(B.incidents(spark, d), "offence", digits=6)


@query("modal_district", "SELECT zone_id, (SELECT aisp FROM izone b WHERE b.zone_id = a.zone_id GROUP BY 1 ORDER BY COUNT(*) DESC, aisp LIMIT 1) AS aisp, (SELECT risp FROM izone b WHERE b.zone_id = a.zone_id GROUP BY 1 ORDER BY COUNT(*) DESC, risp LIMIT 1) AS risp FROM zones a WHERE zone_id IN (SELECT zone_id FROM izone)", "izone zones")
def _(spark, d):
    return M.modal_district(incidents_in_zones(spark, d), ZONE, ["aisp", "risp"])


# ------------------------------------------------------------------ streets
@query("top_streets", "SELECT zone_id, street, total, round(lat,6) AS lat, round(lon,6) AS lon, n_transeunte, n_celular, n_coletivo, peak_hour, CAST(street_rank AS INT) AS street_rank FROM top_st", "top_st")
def _(spark, d):
    return rounded(M.top_streets(incidents_in_zones(spark, d), ZONE), "lat", "lon")


@query("streets_profile", """SELECT street, COUNT(*) AS total, round(AVG(hour),6) AS mean_hour, round(COUNT(*) FILTER (hour >= 18 OR hour <= 5)*100e0/COUNT(*),6) AS night_pct,
 (SELECT hour FROM inc b WHERE b.street = a.street AND hour IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, hour LIMIT 1) AS peak_hour FROM inc a WHERE street <> '' GROUP BY 1""", "inc")
def _(spark, d):
    out = M.streets_profile_all(B.incidents(spark, d), [], name="locf")
    return rounded(out.drop("name"), "mean_hour", "night_pct")


@query("factors_by_street", """SELECT street, string_agg(DISTINCT kind, '|' ORDER BY kind) AS factor_types, string_agg(DISTINCT agency, '|' ORDER BY agency) AS agencies, COUNT(*) AS n_factors FROM fac GROUP BY 1""", "fac")
def _(spark, d):
    out = M.factors_by_street(B.factors(spark, d), [])
    return out.withColumns({c: joined_text(c) for c in ("factor_types", "agencies")})


@query("tips_by_street", """SELECT street, COUNT(*) AS n_tips, string_agg(DISTINCT kind, '|' ORDER BY kind) AS tip_types FROM tip GROUP BY 1""", "tip")
def _(spark, d):
    out = M.tips_by_street(B.tips(spark, d), [])
    return out.select("street", "n_tips", joined_text("tip_types").alias("tip_types"))


@query("tip_narratives", "SELECT street, id AS \"order\", md5(text) AS text FROM tip WHERE street <> '' AND text IS NOT NULL", "tip")
def _(spark, d):
    return M.tip_narratives(B.tips(spark, d), []).withColumn("text", F.md5("text"))


@query("join_left_street", """SELECT s.street, s.n, f.nf, t.nt FROM (SELECT street, COUNT(*) n FROM inc GROUP BY 1) s LEFT JOIN (SELECT street, COUNT(*) nf FROM fac GROUP BY 1) f USING (street) LEFT JOIN (SELECT street, COUNT(*) nt FROM tip GROUP BY 1) t USING (street)""", "inc fac tip")
def _(spark, d):
    n = lambda df, c: M.count_by(df, ["street"], c)
    return M.join_left_street(n(B.incidents(spark, d), "n"), ["street"], n(B.factors(spark, d), "nf"), n(B.tips(spark, d), "nt"))


# ------------------------------------------------------------------ agencies and calls
@query("factors_by_agency", """SELECT zone_id, agency, COUNT(*) AS total, (SELECT string_agg(kind || ':' || n, '|' ORDER BY n DESC, kind) FROM (SELECT kind, COUNT(*) n FROM fzone b WHERE b.zone_id = a.zone_id AND b.agency = a.agency GROUP BY 1 ORDER BY n DESC, kind LIMIT 5)) AS tipos FROM fzone a GROUP BY 1,2""", "fzone")
def _(spark, d):
    out = M.factors_by_agency(zoned(spark, d, B.factors(spark, d)), ZONE)
    return out.withColumn("tipos", joined_text(F.transform("tipos", lambda t: F.concat(t["tipo"], F.lit(":"), t["count"].cast("string")))))


@query("calls_summary", """SELECT kind, COUNT(*) AS total, COUNT(lat) AS with_coords, round(AVG((status = 'Atendido')::INT)*100,6) AS pct_served, round(AVG((due = 'Vencido')::INT)*100,6) AS pct_overdue FROM cal GROUP BY 1""", "cal")
def _(spark, d):
    return rounded(M.calls_summary(B.calls(spark, d), ["kind"]), "pct_served", "pct_overdue")


@query("served_measures", "SELECT status, status = 'Atendido' AS equal, contains(lower(status),'atendido') AS has, starts_with(status,'Atendido') AS prefix FROM (SELECT DISTINCT status FROM cal)", "cal")
def _(spark, d):
    s = B.calls(spark, d).select("status").distinct()
    c = F.col("status")
    return s.select(c, M.served_equal(c).alias("equal"), M.served_contains(c).alias("has"), M.served_prefix(c).alias("prefix"))


@query("calls_by_type", """SELECT * FROM (SELECT zone_id, kind, agency, COUNT(*) AS total, COUNT(*) FILTER (contains(lower(status),'atendido')) AS served, COUNT(*) FILTER (due='Vencido') AS overdue FROM czone GROUP BY 1,2,3)
 QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY total DESC, kind, agency) <= 20""", "czone")
def _(spark, d):
    return M.calls_by_type(zoned(spark, d, B.calls(spark, d)), ZONE)


@query("calls_monthly_by_type", "SELECT neighbourhood, strftime(date_trunc('month', day),'%Y-%m') AS month, kind, COUNT(*) AS calls, COUNT(*) FILTER (status = 'Atendido') AS served, COUNT(lat) AS with_coords FROM cal GROUP BY 1,2,3", "cal")
def _(spark, d):
    out = M.calls_monthly_by_type(B.calls(spark, d), ["neighbourhood"])
    return out.withColumn("month", F.date_format("month", "yyyy-MM"))


@query("calls_hotspots", "SELECT neighbourhood, street, kind, COUNT(*) AS total, round(AVG(lat),6) AS lat, round(AVG(lon),6) AS lon, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM cal GROUP BY 1,2,3 HAVING COUNT(*) >= 3", "cal")
def _(spark, d):
    out = M.calls_hotspots(B.calls(spark, d), ["neighbourhood", "street", "kind"])
    return rounded(out, "lat", "lon").withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("calls_by_neighbourhood", "SELECT c.name, coalesce(k.n,0) AS calls FROM census c LEFT JOIN (SELECT neighbourhood, COUNT(*) n FROM cal GROUP BY 1) k USING (neighbourhood)", "census cal")
def _(spark, d):
    return M.calls_by_neighbourhood(B.census(spark, d).select("name", "neighbourhood"), B.calls(spark, d), "neighbourhood").select("name", "calls")


_NORM = """CASE WHEN {a} IN ('RIOLUZ','Rio Luz') THEN 'RioLuz' WHEN contains(upper({a}),'COMLURB') THEN 'COMLURB' WHEN contains(upper({a}),'CET') THEN 'CET-Rio'
 WHEN contains(upper({a}),'SMAS') OR contains(upper({a}),'CAS') THEN 'SMAS' WHEN contains(upper({a}),'01A') THEN 'SECONSERVA' WHEN contains(upper({a}),'SEOP') THEN 'SEOP' ELSE {a} END"""


@query("norm_agency", f"SELECT agency, {_NORM.format(a='agency')} AS agency_norm FROM (SELECT DISTINCT agency FROM cal)", "cal")
def _(spark, d):
    return B.calls(spark, d).select("agency").distinct().withColumn("agency_norm", X.norm_agency(F.col("agency")))


_CROSS = f"""SELECT f.zone_id, f.agency, f.n AS field_factors, f.g AS agency_norm, coalesce(c.n,0) AS calls, coalesce(c.s,0) AS served, coalesce(c.l,0) AS overdue, coalesce(c.n,0) > 0 AS validated
 FROM (SELECT zone_id, agency, {_NORM.format(a='agency')} AS g, COUNT(*) n FROM fzone GROUP BY 1,2) f LEFT JOIN
 (SELECT zone_id, {_NORM.format(a='agency')} AS g, COUNT(*) n, COUNT(*) FILTER (starts_with(status,'Atendido')) s, COUNT(*) FILTER (due='Vencido') l FROM czone GROUP BY 1,2) c ON c.zone_id = f.zone_id AND c.g = f.g"""

ctes.TABLES["cross_rows"] = ("fzone czone", _CROSS)


@query("cross_validate_sources", _CROSS, "fzone czone")
def _(spark, d):
    return M.cross_validate_sources(zoned(spark, d, B.factors(spark, d)), zoned(spark, d, B.calls(spark, d)), ZONE)


@query("cross_validate_deduped", f"SELECT zone_id, agency_norm, CAST(SUM(field_factors) AS BIGINT) AS field_factors, max(calls) AS calls, max(served) AS served, max(overdue) AS overdue, bool_or(validated) AS validated FROM ({_CROSS}) GROUP BY 1,2", "fzone czone")
def _(spark, d):
    return M.cross_validate_sources(zoned(spark, d, B.factors(spark, d)), zoned(spark, d, B.calls(spark, d)), ZONE, dedupe=True)


@query("district_violence", """SELECT o_custkey % 41 AS aisp, CAST(SUM(CASE WHEN o_orderstatus='O' THEN 1 ELSE 0 END) AS BIGINT) AS hom_doloso, CAST(SUM(floor(o_totalprice)) AS BIGINT) AS total_roubos
 FROM orders WHERE year(o_orderdate) > (SELECT max(year(o_orderdate)) FROM orders) - 3 GROUP BY 1""")
def _(spark, d):
    o = B.table(spark, d, "orders")
    s = o.select((F.col("o_custkey") % 41).alias("aisp"), F.year("o_orderdate").alias("ano"),
                 F.when(F.col("o_orderstatus") == "O", "1").otherwise("x").alias("hom_doloso"), F.floor("o_totalprice").cast("string").alias("total_roubos"))
    return M.district_violence(s)


@query("modus_counts", f"""SELECT source, modus, COUNT(*) AS n FROM (SELECT source, unnest(list_filter({ctes.MODUS_TAGS}, lambda x: x IS NOT NULL)) AS modus
 FROM (SELECT source, text || ' ' || ['caminhando na rua','de moto preta','sem nada','armado com pistola','dois indivíduos e um carro','menor','ciclista','faca'][CAST(doc_id % 8 AS INT)+1] AS text FROM documents)) GROUP BY 1,2""")
def _(spark, d):
    doc = B.table(spark, d, "documents")
    extra = ["caminhando na rua", "de moto preta", "sem nada", "armado com pistola", "dois indivíduos e um carro", "menor", "ciclista", "faca"]
    tail = F.element_at(F.array(*[F.lit(e) for e in extra]), (F.col("doc_id") % 8 + 1).cast("int"))
    return M.modus_counts(doc.select("source", F.concat("text", F.lit(" "), tail).alias("text")), ["source"])


# ------------------------------------------------------------------ areas
@query("per_capita", "SELECT zone_id, round(CASE WHEN street_people > 0 THEN crimes*1e0/street_people*1000 END,4) AS crimes_per_1000 FROM measures", "measures")
def _(spark, d):
    m = report_of(spark, d).measures()
    return M.per_capita(m, "crimes", "street_people", 4).select("zone_id", "crimes_per_1000")


@query("incidents_per_camera", "SELECT zone_id, round(CASE WHEN cameras > 0 THEN crimes*1e0/cameras END,4) AS crimes_per_camera FROM measures", "measures")
def _(spark, d):
    return M.incidents_per_camera(report_of(spark, d).measures(), digits=4).select("zone_id", "crimes_per_camera")


@query("multi_area_totals", "SELECT CAST(SUM(crimes) AS BIGINT) AS total_crimes, CAST(SUM(tips) AS BIGINT) AS total_tips, CAST(SUM(factors) AS BIGINT) AS total_factors, CAST(SUM(cameras) AS BIGINT) AS total_cameras FROM measures", "measures")
def _(spark, d):
    return M.multi_area_totals(report_of(spark, d).measures(), ["crimes", "tips", "factors", "cameras"])


@query("count_by_urgency", "SELECT o_orderpriority AS urgency, COUNT(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return M.count_by_urgency(B.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "urgency"))


@query("run_meta", "SELECT (SELECT COUNT(*) FROM inc) AS total_incidents, (SELECT COUNT(*) FROM tip) AS total_tips, (SELECT COUNT(*) FROM fac) AS total_factors, (SELECT COUNT(DISTINCT id) FROM inc_z) AS total_in_areas", "inc tip fac inc_z")
def _(spark, d):
    inside = zoned(spark, d, B.incidents(spark, d), multi="first")
    return M.run_meta({"incidents": B.incidents(spark, d), "tips": B.tips(spark, d), "factors": B.factors(spark, d), "in_areas": inside})


@query("search_areas", "SELECT 'N' || n_nationkey AS zone_id FROM nation WHERE contains(lower(n_name),'1') OR contains(CAST(n_nationkey*7 % 40 AS VARCHAR),'1') OR n_regionkey = 1")
def _(spark, d):
    r = B.table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    n = B.table(spark, d, "nation").join(r, "n_regionkey")
    areas = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("zone_id"), F.col("n_name").alias("name"),
                     (F.col("n_nationkey") * 7 % 40).alias("district"), F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("members"))
    return M.search_areas(areas, "1").select("zone_id")


@query("store_stats", """SELECT dimension, value, n FROM (SELECT 'event_type' AS dimension, event_type AS value, COUNT(*) AS n FROM events GROUP BY 2 UNION ALL
 SELECT 'hour', CAST(hour(ts) AS VARCHAR), COUNT(*) FROM events GROUP BY 2 UNION ALL SELECT 'total', NULL, COUNT(*) FROM events)""")
def _(spark, d):
    e = B.table(spark, d, "events").withColumn("hour", F.hour("ts"))
    return M.store_stats(e, ["event_type", "hour"])


@query("classify_summary", """SELECT p.account, COUNT(*) AS classified, COUNT(*) FILTER (quality = 1) AS relevant, COUNT(*) FILTER (quality <> 1) AS discarded FROM posts p JOIN labels l ON l.doc_id = p.conv_id GROUP BY 1""", "posts")
def _(spark, d):
    lab = B.table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), (F.col("quality") == 1).alias("is_relevant"))
    return M.classify_summary(B.posts(spark, d).join(lab, "conv_id"))


@query("gini_hours", """SELECT zone_id, round(CASE WHEN total < 3 THEN 0e0 ELSE greatest(0e0, least(1e0, 2e0*w/(24e0*total) - 25e0/24e0)) END,6) AS gini FROM (SELECT zone_id, SUM(n) total, SUM(n*(24-k+rn)) w FROM
 (SELECT zone_id, n, row_number() OVER (PARTITION BY zone_id ORDER BY n) rn, COUNT(*) OVER (PARTITION BY zone_id) k FROM (SELECT zone_id, hour, COUNT(*) n FROM izone WHERE hour IS NOT NULL GROUP BY 1,2)) GROUP BY 1)""", "izone")
def _(spark, d):
    return rounded(M.gini_hours(incidents_in_zones(spark, d), ZONE), "gini")


@query("distinct_sources", "SELECT event_type, COUNT(DISTINCT user_id % 3) AS n_sources FROM events GROUP BY 1")
def _(spark, d):
    e = B.table(spark, d, "events").withColumn("source_kind", F.col("user_id") % 3)
    return M.distinct_sources(e, ["event_type"])


# ------------------------------------------------------------------ samples
@query("head_points", "SELECT id FROM (SELECT zone_id, id, row_number() OVER (PARTITION BY zone_id ORDER BY id) rn FROM fzone) WHERE rn <= 30", "fzone")
def _(spark, d):
    return R.head_points(zoned(spark, d, B.factors(spark, d)), 30, [F.col("id")], ZONE).select("id")


@query("narratives_first", """SELECT id, length(text) AS n FROM (SELECT id, lat, text FROM (SELECT id, lat, CASE WHEN id % 6 <> 0 THEN text END AS text FROM tip) ORDER BY text IS NULL, id LIMIT 400) WHERE lat IS NOT NULL""", "tip")
def _(spark, d):
    t = B.tips(spark, d).withColumn("text", F.when(F.col("id") % 6 != 0, F.col("text")))
    return R.narratives_first(t, "text", [F.col("id")], 400).select("id", F.length("text").cast("bigint").alias("n"))


@query("stratified_sample", "SELECT zone_id, offence, least(COUNT(*), 20) AS n FROM izone GROUP BY 1,2", "izone")
def _(spark, d):
    sample = R.stratified_sample(incidents_in_zones(spark, d), ["zone_id", "offence"], "id", max_points=60)
    return M.count_by(sample, ["zone_id", "offence"])


@query("sample_cap", "SELECT least(COUNT(*), 700) AS n, TRUE AS all_known FROM inc", "inc")
def _(spark, d):
    inc = B.incidents(spark, d)
    s = R.sample_cap(inc, "id", 700).join(inc.select("id").withColumn("k", F.lit(True)), "id", "left")
    return s.agg(F.count_distinct("id").alias("n"), F.bool_and("k").alias("all_known"))


@query("top_k_per_group", "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 5")
def _(spark, d):
    li = B.table(spark, d, "lineitem")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return R.top_k_per_group(li, ["l_returnflag"], order, 5).select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("sort_desc_by_score", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def _(spark, d):
    return R.sort_desc_by_score(B.table(spark, d, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "c_acctbal")


@query("global_rank", "SELECT id, row_number() OVER (ORDER BY value DESC, id) AS rank FROM inc", "inc")
def _(spark, d):
    return R.global_row_number(B.incidents(spark, d).select("id", "value"), [F.desc("value"), F.col("id")]).select("id", "rank")


@query("minmax_scale", "SELECT offence, n, round(CASE WHEN max(n) OVER () = min(n) OVER () THEN 1e0 ELSE (n - min(n) OVER ())*1e0/(max(n) OVER () - min(n) OVER ()) END,6) AS scaled FROM (SELECT offence, COUNT(*) n FROM inc GROUP BY 1)", "inc")
def _(spark, d):
    return rounded(R.minmax_scale(M.count_by(B.incidents(spark, d), ["offence"]), "n"), "scaled")


# ------------------------------------------------------------------ census
ctes.TABLES["cm"] = ("census nedges", """SELECT c.zone_id, c.name, c.region, coalesce(pop_2022,0) AS pop_2022, coalesce(pop_2010,0) AS pop_2010, coalesce(dwellings,0) AS dwellings,
 coalesce(pop_2022,0) - coalesce(pop_2010,0) AS change_abs, CASE WHEN coalesce(pop_2010,0) > 0 THEN floor((pop_2022-pop_2010)*1e0/pop_2010*100*10e0+0.5e0)/10e0 ELSE 0e0 END AS change_pct,
 CASE WHEN coalesce(dwellings,0) > 0 THEN floor(pop_2022*1e0/dwellings*100e0+0.5e0)/100e0 ELSE 0e0 END AS people_per_dwelling,
 floor(coalesce(pop_2022,0)/km2+0.5e0) AS density, floor(km2*100e0+0.5e0)/100e0 AS area_km2 FROM census c JOIN
 (SELECT zone_id, abs(SUM(x1*y2-x2*y1))/2*pow(6378137e0*pi()/180,2)/1e6*cos(radians((min(y1)+max(y1))/2)) AS km2 FROM nedges GROUP BY 1) g USING (zone_id)""")


def _census(spark, d):
    return Z.census_metrics(B.census(spark, d), B.neighbourhood_edges(spark, d))


@query("census_metrics", "SELECT zone_id, name, pop_2022, pop_2010, change_abs, round(change_pct,4) AS change_pct, round(people_per_dwelling,4) AS people_per_dwelling, round(density,4) AS density, round(area_km2,4) AS area_km2 FROM cm", "cm")
def _(spark, d):
    cols = ["change_pct", "people_per_dwelling", "density", "area_km2"]
    return rounded(_census(spark, d), *cols, digits=4).select("zone_id", "name", "pop_2022", "pop_2010", "change_abs", *cols)


@query("census_by_name", "SELECT zone_id, pop_2022 FROM cm WHERE name IN ('NATION_3','NATION_5')", "cm")
def _(spark, d):
    return Z.census_by_name(_census(spark, d), ["nation_3", "Nátion_5", "none"]).select("zone_id", "pop_2022")


@query("region_aggregate", """SELECT min(region) AS region, COUNT(*) AS n_members, CAST(SUM(pop_2022) AS BIGINT) AS pop_2022, CAST(SUM(pop_2010) AS BIGINT) AS pop_2010,
 round(CASE WHEN SUM(pop_2010) > 0 THEN floor((SUM(pop_2022)-SUM(pop_2010))*1e0/SUM(pop_2010)*100*10e0+0.5e0)/10e0 ELSE 0e0 END,4) AS change_pct,
 floor(AVG(density) FILTER (density > 0)+0.5e0) AS mean_density, string_agg(name, '|' ORDER BY pop_2022 DESC, name) AS members FROM cm GROUP BY lower(region)""", "cm")
def _(spark, d):
    out = Z.region_aggregate(_census(spark, d))
    return rounded(out.withColumn("members", joined_text(F.transform("members", lambda m: m["name"]))), "change_pct", digits=4).drop("region_key")


@query("region_members", "SELECT lower(region) AS region_key, name, pop_2022, density, round(change_pct,4) AS change_pct, row_number() OVER (PARTITION BY lower(region) ORDER BY pop_2022 DESC, name) AS place FROM cm", "cm")
def _(spark, d):
    return rounded(Z.region_members(_census(spark, d)), "change_pct", digits=4)


@query("city_baseline", """SELECT COUNT(*) AS n_members, CAST(SUM(pop_2022) AS BIGINT) AS pop_2022, CAST(SUM(pop_2010) AS BIGINT) AS pop_2010,
 round(floor((SUM(pop_2022)-SUM(pop_2010))*1e0/SUM(pop_2010)*100*10e0+0.5e0)/10e0,4) AS change_pct, list_sort(list(density) FILTER (density > 0))[len(list(density) FILTER (density > 0))//2 + 1] AS median_density FROM cm""", "cm")
def _(spark, d):
    return rounded(Z.city_baseline(_census(spark, d)), "change_pct", digits=4)


@query("surroundings_summary", """SELECT a_zone_id AS zone_id, CAST(SUM(pop_2022) AS BIGINT) AS pop_2022, CAST(SUM(pop_2010) AS BIGINT) AS pop_2010, floor(AVG(density)+0.5e0) AS mean_density,
 round((SUM(pop_2022)-SUM(pop_2010))*1e0/SUM(pop_2010)*100,4) AS change_pct FROM overlap o JOIN cm ON cm.zone_id = o.b_zone_id GROUP BY 1""", "overlap cm")
def _(spark, d):
    from geoevents.operators import overlap as O

    pairs = O.zones_intersect_zones(B.scaled(B.zone_edges(spark, d)), B.scaled(B.neighbourhood_edges(spark, d)), cell_size=2500.0)
    out = Z.surroundings_summary(pairs, _census(spark, d))
    return rounded(out.withColumnRenamed("a_zone_id", "zone_id"), "change_pct", digits=4)


# ------------------------------------------------------------------ query layer
@query("query_streets", "SELECT zone_id, street, total, peak_hour FROM top_st WHERE n_celular > 0 ORDER BY total DESC, street, zone_id LIMIT 25", "top_st")
def _(spark, d):
    streets = M.top_streets(incidents_in_zones(spark, d), ZONE).withColumn("layers", F.lit(1))
    return Q.query_streets(streets, kind="celular", limit=25).select("zone_id", "street", "total", "peak_hour")


@query("query_narratives", "SELECT id FROM tip WHERE contains(lower(trim(kind, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))),'furto') AND contains(lower(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))),'the') AND contains(street,'sao 1') ORDER BY id LIMIT 20", "tip")
def _(spark, d):
    return Q.query_narratives(B.tips(spark, d), kind=" FURTO", contains="THE", street="sao 1").select("id")


@query("query_service_calls", "SELECT kind, agency, total, overdue FROM (SELECT kind, agency, COUNT(*) total, COUNT(*) FILTER (due='Vencido') overdue FROM cal GROUP BY 1,2) WHERE overdue > 0 AND contains(lower(agency),'rio') ORDER BY total DESC, kind, agency LIMIT 30", "cal")
def _(spark, d):
    rows = M.calls_by_pair(B.calls(spark, d).withColumn("zone_id", F.lit("all")), ZONE)
    return Q.query_service_calls(rows, "all", agency="Rio", overdue_only=True).select("kind", "agency", "total", "overdue")


@query("query_factors", "SELECT zone_id, agency, COUNT(*) AS total FROM fzone WHERE zone_id = 'Z6' AND contains(lower(agency),'rio') GROUP BY 1,2", "fzone")
def _(spark, d):
    rows = M.factors_by_agency(zoned(spark, d, B.factors(spark, d)), ZONE)
    return Q.query_factors(rows, "Z6", agency="rio").select("zone_id", "agency", "total")


@query("query_cross_validation", f"SELECT agency, agency_norm, calls FROM ({_CROSS}) WHERE zone_id = 'Z6' AND contains(lower(agency_norm),'rio')", "fzone czone")
def _(spark, d):
    rows = M.cross_validate_sources(zoned(spark, d, B.factors(spark, d)), zoned(spark, d, B.calls(spark, d)), ZONE)
    return Q.query_cross_validation(rows, "Z6", agency="rio").select("agency", "agency_norm", "calls")


@query("query_report_section", """SELECT doc_id AS area, len(list_filter(string_split(text, chr(10)), lambda x, i: i % 2 = 1 AND contains(lower(trim(x)), 'the'))) > 0 AS found,
 list_filter(string_split(text, chr(10)), lambda x, i: i % 2 = 1 AND contains(lower(trim(x)), 'the'))[1] AS titulo FROM documents WHERE text <> ''""")
def _(spark, d):
    doc = B.table(spark, d, "documents")
    rep = doc.select(F.col("doc_id").alias("area"), F.col("text").alias("full_text"), SC.pair_sections(F.split("text", "\n")).alias("sections"))
    return Q.query_report_section(rep, "the").select("area", "found", "titulo")


@query("query_hours", "SELECT zone_id, hour, COUNT(*) AS n FROM izone WHERE zone_id = 'Z6' AND hour IS NOT NULL GROUP BY 1,2", "izone")
def _(spark, d):
    return Q.query_hours(M.hour_histogram(incidents_in_zones(spark, d), ZONE), "Z6")


@query("night_flag", "SELECT hour, hour >= 18 OR hour <= 5 AS night FROM (SELECT DISTINCT hour FROM inc)", "inc")
def _(spark, d):
    return B.incidents(spark, d).select("hour").distinct().withColumn("night", D.is_night(F.col("hour")))


_ = (index_of, r6)
