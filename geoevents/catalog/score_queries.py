"""Queries of scores, coincidence, severity, allocation and rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoevents.catalog import ctes
from geoevents.catalog.common import joined_text, metric, r6, report_of, rounded, zoned
from geoevents.catalog.registry import query
from geoevents.operators import allocation as L
from geoevents.operators import metrics as M
from geoevents.operators import scoring as C
from geoevents.operators import severity as E
from geoevents.sources import bindings as B

# ------------------------------------------------------------------ area score
ctes.TABLES["scored"] = ("parts", """SELECT *, round(p1+p2+p3+p4+p5,6) AS score, round(p1,6) AS part_crime, round(p2,6) AS part_peak, round(p3,6) AS part_factors, round(p4,6) AS part_tips, p5 AS part_report FROM parts""")


def _scored(spark, d):
    return report_of(spark, d).scores(digits=6)


@query("area_score", "SELECT zone_id, crimes, tips, factors, cameras, street_people, score, part_crime, part_peak, part_factors, part_tips, part_report FROM scored", "scored")
def _(spark, d):
    cols = "zone_id crimes tips factors cameras street_people score part_crime part_peak part_factors part_tips part_report"
    return _scored(spark, d).select(*cols.split())


ctes.TABLES["weighted"] = ("scored", """SELECT *, floor((part_crime/40e0*(40e0/95e0*100) + part_peak/15e0*(15e0/95e0*100) + part_factors/25e0*(25e0/95e0*100) + part_tips/15e0*(15e0/95e0*100) + part_report/5e0*5)*10e0+0.5e0)/10e0 AS weighted FROM scored""")


@query("reweight_score", "SELECT zone_id, round(weighted,4) AS weighted FROM weighted", "weighted")
def _(spark, d):
    return rounded(C.reweight_score(_scored(spark, d)), "weighted", digits=4).select("zone_id", "weighted")


@query("risk_level", "SELECT zone_id, CASE WHEN score >= 65 THEN 'critico' WHEN score >= 45 THEN 'alto' WHEN score >= 30 THEN 'medio' ELSE 'baixo' END AS level, CASE WHEN score >= 60 THEN 'red' WHEN score >= 40 THEN 'accent' WHEN score >= 25 THEN 'amber' ELSE 'muted' END AS band FROM scored", "scored")
def _(spark, d):
    return C.area_percentages(_scored(spark, d)).select("zone_id", "level", "band")


@query("group_by_risk", "SELECT CASE WHEN score >= 65 THEN 'critico' WHEN score >= 45 THEN 'alto' WHEN score >= 30 THEN 'medio' ELSE 'baixo' END AS level, COUNT(*) AS n_areas, COUNT(*) FILTER (score >= 40) AS n_40_plus FROM scored GROUP BY 1", "scored")
def _(spark, d):
    return M.group_by_risk(_scored(spark, d))


@query("rank_areas", "SELECT CAST(row_number() OVER (ORDER BY crimes DESC, zone_id) AS INT) AS rank, COUNT(*) OVER () AS of, zone_id, crimes AS value, round(crimes*100e0/SUM(crimes) OVER (),6) AS share_pct FROM measures", "measures")
def _(spark, d):
    return rounded(C.rank_areas(report_of(spark, d).measures(), "crimes"), "share_pct")


@query("radar_normalise", "SELECT zone_id, axis, round(v/greatest(max(v) OVER (PARTITION BY axis),1),6) AS value FROM (SELECT zone_id, unnest(['crimes','factors','cameras','tips']) AS axis, unnest([crimes*1e0,factors*1e0,cameras*1e0,tips*1e0]) AS v FROM measures)", "measures")
def _(spark, d):
    return rounded(C.radar_normalise(report_of(spark, d).measures(), ["crimes", "factors", "cameras", "tips"]), "value")


@query("risk_percentile_flags", """SELECT zone_id, array_to_string(list_filter([CASE WHEN crimes > median(crimes) OVER () THEN 'ALTO VOLUME CRIMINAL' END, CASE WHEN cameras = 0 THEN 'SEM CÂMERAS' END,
 CASE WHEN night_pct > 60 THEN 'ALTO ÍNDICE NOTURNO' END, CASE WHEN zone_order % 9 > 5 THEN 'PROXIMIDADE ORCRIM' END, CASE WHEN NOT has_report THEN 'SEM RELINT' END,
 CASE WHEN row_number() OVER (ORDER BY factors DESC, zone_id) <= 3 THEN 'ALTA DENSIDADE DE FATORES' END, CASE WHEN zone_order % 5 > 3 THEN 'TRIPLE BINGO ELEVADO' END,
 CASE WHEN zone_order % 7 > 3 THEN 'PONTOS CEGOS DE CÂMERA' END], lambda x: x IS NOT NULL), '|') AS flags FROM measures""", "measures")
def _(spark, d):
    k = F.col("zone_order")
    m = report_of(spark, d).measures().withColumns({"territories": k % 9, "n_triple": k % 5, "n_gaps": k % 7})
    return C.risk_percentile_flags(m).withColumn("flags", joined_text("flags"))


# ------------------------------------------------------------------ street coincidence
_NEAR = ("CASE WHEN s.street = '' THEN EXISTS (SELECT 1 FROM {t} f WHERE pow(s.cx-f.x,2)+pow(s.cy-f.y,2) <= 10000e0) "
         "ELSE EXISTS (SELECT 1 FROM inc_m i JOIN {t} f ON pow(i.x-f.x,2)+pow(i.y-f.y,2) <= 10000e0 WHERE i.street = s.street) END")
_NAMED = "EXISTS (SELECT 1 FROM {t} f WHERE f.lat IS NULL AND f.street = s.street AND f.street <> '')"
ctes.TABLES["bingo"] = ("inc inc_m fac_m tip_m", f"""SELECT street, total, TRUE AS has_crime, {_NEAR.format(t='fac_m')} OR {_NAMED.format(t='fac_m')} AS has_factor,
 {_NEAR.format(t='tip_m')} OR {_NAMED.format(t='tip_m')} AS has_tip FROM (SELECT street, COUNT(*) AS total, AVG(x) AS cx, AVG(y) AS cy FROM inc_m GROUP BY 1) s""")


def _layers(spark, d):
    inc = metric(B.incidents(spark, d))
    streets = inc.groupBy("street").agg(F.count(F.lit(1)).alias("total"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return C.bingo_layers(streets, inc, metric(B.factors(spark, d)), metric(B.tips(spark, d)))


@query("bingo_layers", "SELECT street, total, has_crime, has_factor, has_tip, CAST(1 + has_factor::INT + has_tip::INT AS INT) AS layers FROM bingo", "bingo")
def _(spark, d):
    return _layers(spark, d).drop("x", "y")


@query("bingo_counts", "SELECT left(street, 12) AS grp, COUNT(*) FILTER (1 + has_factor::INT + has_tip::INT >= 2) AS n_bingo, COUNT(*) FILTER (has_factor AND has_tip) AS n_triple FROM bingo GROUP BY 1", "bingo")
def _(spark, d):
    return C.bingo_counts(_layers(spark, d).withColumn("grp", F.left("street", F.lit(12))), ["grp"])


@query("pearson_layers", """SELECT grp, n_streets, n_with, round(CASE WHEN r0 IS NULL OR isnan(r0) THEN 0e0 ELSE r0 END,6) AS r, round(mean_with,6) AS mean_with, round(mean_without,6) AS mean_without,
 CASE WHEN abs(coalesce(r0,0)) > 0.6 THEN 'forte' WHEN abs(coalesce(r0,0)) > 0.3 THEN 'moderada' ELSE 'fraca' END AS strength, round(CASE WHEN mean_without > 0 THEN mean_with/mean_without END,6) AS ratio
 FROM (SELECT user_id % 6 AS grp, COUNT(*) AS n_streets, COUNT(*) FILTER (user_id % 4 < 2) AS n_with, corr(user_id % 4, n) AS r0, coalesce(AVG(n) FILTER (user_id % 4 < 2),0) AS mean_with, coalesce(AVG(n) FILTER (user_id % 4 >= 2),0) AS mean_without
 FROM (SELECT user_id, COUNT(*) n FROM events GROUP BY 1) GROUP BY 1)""")
def _(spark, d):
    u = F.col("user_id")
    s = M.count_by(B.table(spark, d, "events"), ["user_id"], "total")
    s = s.select((u % 6).alias("grp"), (u % 4).alias("layers"), "total", (u % 4 < 2).alias("has_factor"))
    return rounded(M.pearson_layers(s, ["grp"]), "r", "mean_with", "mean_without", "ratio")


_STEP = "CASE WHEN total >= 30 THEN 4 WHEN total >= 16 THEN 3 WHEN total >= 6 THEN 2 WHEN total >= 1 THEN 1 ELSE 0 END"
ctes.TABLES["bpoints"] = ("inc fac tip", f"""SELECT *, p_crime + p_factors + p_tips + p_camera AS points FROM (SELECT street, total, CAST({_STEP} AS INT) AS p_crime,
 CAST(CASE WHEN nf >= 5 THEN 3 WHEN nf >= 3 THEN 2 WHEN nf >= 1 THEN 1 ELSE 0 END AS INT) AS p_factors, CAST(CASE WHEN nt >= 4 THEN 2 WHEN nt >= 1 THEN 1 ELSE 0 END AS INT) AS p_tips,
 CAST(CASE WHEN total >= 5 AND NOT cam THEN 1 ELSE 0 END AS INT) AS p_camera FROM (SELECT user_id, 'avenida sao ' || user_id AS street, COUNT(*) AS total, user_id % 2 = 0 AS cam FROM events GROUP BY 1) s
 LEFT JOIN (SELECT street, COUNT(DISTINCT kind) nf FROM fac GROUP BY 1) f USING (street) LEFT JOIN (SELECT street, COUNT(*) nt FROM tip GROUP BY 1) t USING (street))""")
_PRIO = "CASE WHEN points >= 8 THEN 'CRITICA' WHEN points >= 6 THEN 'ALTA' WHEN points >= 3 THEN 'MEDIA' ELSE 'BAIXA' END"


def _bingo(spark, d, form=C.bingo_streets):
    e = B.table(spark, d, "events")
    s = M.count_by(e, ["user_id"], "total").select(
        F.concat(F.lit("avenida sao "), F.col("user_id").cast("string")).alias("street"), "total", (F.col("user_id") % 2 == 0).alias("has_camera"))
    fac = M.factors_by_street(B.factors(spark, d), [])
    tip = M.tips_by_street(B.tips(spark, d), [])
    return form(s, fac, tip, ["street"])


@query("bingo_points", f"SELECT street, total, p_crime, p_factors, p_tips, p_camera, CAST(points AS INT) AS points, {_PRIO} AS priority FROM bpoints", "bpoints")
def _(spark, d):
    return _bingo(spark, d).select("street", "total", "p_crime", "p_factors", "p_tips", "p_camera", "points", "priority")


@query("bingo_area", f"SELECT street, CAST(points AS INT) AS points FROM bpoints ORDER BY points DESC, total DESC, street LIMIT 20", "bpoints")
def _(spark, d):
    return _bingo(spark, d, C.bingo_area).select("street", "points")


@query("bingo_summary", f"SELECT left(street,13) AS grp, COUNT(*) AS n_streets, COUNT(*) FILTER ({_PRIO} = 'CRITICA') AS n_critica, COUNT(*) FILTER ({_PRIO} = 'ALTA') AS n_alta, COUNT(*) FILTER ({_PRIO} = 'MEDIA') AS n_media, COUNT(*) FILTER ({_PRIO} = 'BAIXA') AS n_baixa FROM bpoints GROUP BY 1", "bpoints")
def _(spark, d):
    return C.bingo_summary(_bingo(spark, d).withColumn("grp", F.left("street", F.lit(13))), ["grp"])


@query("bingo_combos", "SELECT street, list_has_all(list(DISTINCT kind), ['ECONOMY','PROMO']) AS c1, list_has_all(list(DISTINCT kind), ['LARGE','SMALL','STANDARD']) AS c2 FROM fac GROUP BY 1", "fac")
def _(spark, d):
    f = M.factors_by_street(B.factors(spark, d), [])
    found = C.bingo_combos(F.col("factor_types"), [["ECONOMY", "PROMO"], ["LARGE", "SMALL", "STANDARD"]])
    has = lambda part: F.exists("c", lambda t: t.contains(part))
    return f.select("street", found.alias("c")).select("street", has("ECONOMY").alias("c1"), has("LARGE").alias("c2"))


@query("subset_of", "SELECT street, list_has_all(list(DISTINCT kind), ['ECONOMY','LARGE']) AS hit FROM fac GROUP BY 1", "fac")
def _(spark, d):
    f = M.factors_by_street(B.factors(spark, d), [])
    return f.select("street", C.subset_of(["ECONOMY", "LARGE"], F.col("factor_types")).alias("hit"))


ctes.TABLES["st_layers"] = ("top_st izm fzm tzm", """SELECT s.zone_id, s.street, s.total, s.street_rank,
 EXISTS (SELECT 1 FROM izm i JOIN fzm f ON f.zone_id = i.zone_id AND pow(i.x-f.x,2)+pow(i.y-f.y,2) <= 10000e0 WHERE i.zone_id = s.zone_id AND i.street = s.street) AS near_f,
 EXISTS (SELECT 1 FROM izm i JOIN tzm f ON f.zone_id = i.zone_id AND pow(i.x-f.x,2)+pow(i.y-f.y,2) <= 10000e0 WHERE i.zone_id = s.zone_id AND i.street = s.street) AS near_t FROM top_st s""")


@query("area_street_layers", "SELECT zone_id, street, total, CAST(1 + near_f::INT + near_t::INT AS INT) AS layers FROM st_layers", "st_layers")
def _(spark, d):
    return report_of(spark, d).street_layers().select("zone_id", "street", "total", "layers")


for _name, _rows, _m in (("izm", "inc_z", "inc_m"), ("fzm", "fac_z", "fac_m"), ("tzm", "tip_z", "tip_m")):
    ctes.TABLES[_name] = (f"{_rows} {_m}", f"SELECT {_m}.*, {_rows}.zone_id FROM {_m} JOIN {_rows} USING (id)")


@query("risk_forecast", """SELECT zone_id, street, 18 AS hour, round(least(100e0, total*1e0/greatest(max(total) OVER (PARTITION BY zone_id),1)*45 + CASE WHEN abs(18-peak_hour) <= 1 THEN 25e0 ELSE greatest(0e0, 25-abs(18-peak_hour)*3e0) END
 + coalesce(n,0)*1e0/hm*20 + 2/3e0*10),6) AS risk_score FROM top_st JOIN (SELECT zone_id, max(n) hm, max(CASE WHEN hour = 18 THEN n END) n FROM (SELECT zone_id, hour, COUNT(*) n FROM izone WHERE hour IS NOT NULL GROUP BY 1,2) GROUP BY 1) USING (zone_id)""", "top_st izone")
def _(spark, d):
    inc = zoned(spark, d, B.incidents(spark, d))
    streets = M.top_streets(inc, ["zone_id"]).withColumn("layers", F.lit(2))
    out = C.risk_forecast(streets, M.hour_histogram(inc, ["zone_id"]), ["zone_id"], 18, round_digits=6)
    return rounded(out.drop("drivers"), "risk_score")


# ------------------------------------------------------------------ severity
def _list(names, index):
    return ctes.pick(names, f"({index}) % {len(names)}")


ctes.TABLES["ev"] = ("", f"""SELECT lpad(CAST(event_id AS VARCHAR),12,'0') AS event_id, event_id AS k, CAST(ts AS DATE) AS day, CASE WHEN event_id % 17 <> 0 THEN hour(ts) END AS hour,
 CASE WHEN user_id % 12 <> 0 THEN 'Area ' || (user_id % 12) ELSE 'DESCONHECIDA' END AS area, CASE WHEN user_id % 5 <> 0 THEN 'Rua ' || (user_id % 15) END AS street, user_id,
 {_list(['12','6','16','4','20','8','4'], 'event_id')}::DOUBLE AS p_type,
 CASE WHEN event_id % 3 = 2 THEN 0e0 ELSE CASE WHEN event_id % 5 = 0 THEN {_list(['20','12','6','4'], 'event_id')} WHEN event_id % 3 <> 0 THEN {_list(['14','8','6','0'], 'event_id')} ELSE '0' END::DOUBLE END AS p_weapon,
 CASE WHEN event_id % 7 = 0 THEN 0e0 ELSE least(15e0, {_list(['2','12','3'], 'event_id')}::DOUBLE + {_list(['1','8'], 'event_id')}::DOUBLE) END AS p_tactics,
 CASE WHEN event_id % 2 <> 0 THEN 0e0 ELSE least(10e0, greatest({_list(['5','0','2','5'], 'event_id')}::DOUBLE + CASE WHEN event_id % 4 <> 3 AND event_id % 2 = 0 THEN 2e0 ELSE 0e0 END + CASE WHEN event_id % 9 = 0 THEN 5e0 ELSE 0e0 END,
   CASE WHEN event_id % 101 = 0 THEN 10e0 ELSE 0e0 END)) END AS p_victim,
 {_list(['10','4','5'], 'event_id')}::DOUBLE AS p_outcome,
 least(10e0, CASE WHEN event_id % 4 >= 2 THEN 4e0 ELSE 0e0 END + {_list(['3','0','2'], 'event_id')}::DOUBLE + {_list(['2','0'], 'event_id')}::DOUBLE) AS p_organised,
 CASE WHEN event_id % 4 = 1 THEN 0e0 ELSE least(10e0, {_list(['1','5','3','0'], 'event_id')}::DOUBLE * greatest(event_id % 3, 1)) END AS p_items FROM events""")
ctes.TABLES["sev"] = ("ev", "SELECT *, least(100e0, greatest(5e0, p_type+p_weapon+p_tactics+p_victim+p_outcome+p_organised+p_items)) AS s_event FROM ev")


@query("event_severity", "SELECT event_id, p_type, p_weapon, p_tactics, p_victim, p_outcome, p_organised, p_items, s_event FROM sev", "sev")
def _(spark, d):
    cols = "event_id p_type p_weapon p_tactics p_victim p_outcome p_organised p_items s_event"
    return E.event_severity(B.nested_events(spark, d)).select(*cols.split())


_TAGS = ["iluminacao_deficiente", "vegetacao_cobrindo_iluminacao", "comercio_irregular", "ponto_retencao_trafego"]


def _unit_sql(by: str, rows: str) -> str:
    """Unit score over ``rows`` grouped by ``by``."""
    has = lambda t: f"bool_or(k % 6 <> 0 AND ({_list(_TAGS, 'k')} = '{t}' OR {_list(_TAGS, 'k + 1')} = '{t}'))"
    return f"""SELECT {by}, n, s_sum, round(top3,6) AS top3_mean, round(gini,6) AS gini, round(s_loc,6) AS s_loc, round(m,6) AS m_env, w AS w_src, n_sources, round(least(100e0, greatest(0e0, s_loc*m*w)),6) AS final_score,
 CASE WHEN s_loc*m*w >= 80 THEN 'CRITICA' WHEN s_loc*m*w >= 60 THEN 'ALTA' WHEN s_loc*m*w >= 35 THEN 'MEDIA' ELSE 'BAIXA' END AS priority FROM (SELECT *,
 greatest(0.8e0, least(1.5e0, CASE WHEN c1 THEN 1.15e0 ELSE 1e0 END * CASE WHEN c2 THEN 1.1e0 ELSE 1e0 END * CASE WHEN yes+no > 0 AND yes = 0 AND s_loc >= 30 THEN 1.2e0 ELSE 1e0 END
  * CASE WHEN left_*1e0/n >= 0.3 THEN 1.25e0 ELSE 1e0 END * CASE WHEN yes+no > 0 AND no = 0 AND lit*1e0/n >= 0.5 THEN 0.85e0 ELSE 1e0 END)) AS m,
 CASE n_sources WHEN 1 THEN 0.85e0 WHEN 2 THEN 1e0 WHEN 3 THEN 1.1e0 ELSE 1.2e0 END AS w FROM (SELECT *, least(100e0, 3.5e0*log10(1+s_sum)*10 + top3/100*30 + 10*gini) AS s_loc FROM
 (SELECT {by}, COUNT(*) AS n, SUM(s_event) AS s_sum, COUNT(DISTINCT user_id % 3) AS n_sources, {has(_TAGS[0])} AND {has(_TAGS[1])} AS c1, {has(_TAGS[2])} AND {has(_TAGS[3])} AS c2,
  COUNT(*) FILTER (k % 3 = 0 AND user_id % 12 < 6) AS yes, COUNT(*) FILTER (k % 3 = 0 AND user_id % 12 >= 6) AS no, COUNT(*) FILTER (user_id % 12 < 4) AS left_, COUNT(*) FILTER (k % 2 = 0) AS lit FROM {rows} GROUP BY {by})
 JOIN (SELECT {by}, AVG(s_event) AS top3 FROM (SELECT {by}, s_event, row_number() OVER (PARTITION BY {by} ORDER BY s_event DESC) rn FROM {rows}) WHERE rn <= 3 GROUP BY {by}) USING ({by})
 JOIN (SELECT {by}, CASE WHEN total < 3 THEN 0e0 ELSE greatest(0e0, least(1e0, 2e0*wt/(24e0*total) - 25e0/24e0)) END AS gini FROM (SELECT {by}, SUM(c) total, SUM(c*(24-kk+rn)) wt FROM
  (SELECT {by}, c, row_number() OVER (PARTITION BY {by} ORDER BY c) rn, COUNT(*) OVER (PARTITION BY {by}) kk FROM (SELECT {by}, hour, COUNT(*) c FROM {rows} WHERE hour IS NOT NULL GROUP BY {by}, hour)) GROUP BY {by})) USING ({by})))"""


ctes.TABLES["sev30"] = ("sev", "SELECT * FROM sev WHERE day >= (SELECT max(day) FROM sev) - 30")
ctes.TABLES["sev30s"] = ("sev30", "SELECT * FROM sev30 WHERE street IS NOT NULL")
ctes.TABLES["uarea"] = ("sev30", _unit_sql("area", "sev30"))
_UNIT_COLS = "n s_sum top3_mean gini s_loc m_env w_src n_sources final_score priority".split()


def _unit(df, by):
    exact = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("pre_score") + F.col("delta_fb")))
    out = df.withColumn("final_score", exact).select(*by, *_UNIT_COLS)
    return rounded(out, "top3_mean", "gini", "s_loc", "m_env", "final_score")


@query("unit_score", "SELECT * FROM uarea", "uarea")
def _(spark, d):
    areas, _streets = E.score_report(B.nested_events(spark, d), with_reasons=False)
    return _unit(areas, ["area"])


@query("score_report_streets", _unit_sql("area, street", "sev30s"), "sev30s")
def _(spark, d):
    _areas, streets = E.score_report(B.nested_events(spark, d), with_reasons=False)
    return _unit(streets, ["area", "street"])


@query("score_report_reasons", """SELECT area, 'crime_type' AS code, round(SUM(p_type),4) AS delta, COUNT(*) AS k FROM sev30 GROUP BY 1 UNION ALL SELECT area, 'weapon.total', round(SUM(p_weapon),4), COUNT(*) FROM sev30 WHERE p_weapon > 0 GROUP BY 1
 UNION ALL SELECT area, 'items.total', round(SUM(p_items),4), COUNT(*) FROM sev30 WHERE p_items > 0 GROUP BY 1""", "sev30")
def _(spark, d):
    areas, _streets = E.score_report(B.nested_events(spark, d))
    r = areas.select("area", F.explode("reasons").alias("r"))
    code = F.when(F.col("r.code").startswith("crime_type."), "crime_type").otherwise(F.col("r.code"))
    r = r.filter(code.isin("crime_type", "weapon.total", "items.total"))
    k = F.split_part("r.evidence", F.lit(" "), F.lit(1)).cast("bigint")
    return r.groupBy("area", code.alias("code")).agg(r6(F.sum("r.delta"), 4).alias("delta"), F.sum(k).alias("k"))


@query("top_events", "SELECT area, event_id, s_event, CAST(rn AS INT) AS event_rank FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY s_event DESC, event_id) rn FROM sev) WHERE rn <= 5", "sev")
def _(spark, d):
    scored = E.event_severity(E.keyed_events(B.nested_events(spark, d)))
    return E.top_events(scored, ["area"]).select("area", "event_id", "s_event", "event_rank")


@query("set_facts", f"""SELECT area, COUNT(*) FILTER (k % 3 = 0 AND user_id % 12 < 6) AS cam_yes, COUNT(*) FILTER (k % 3 = 0 AND user_id % 12 >= 6) AS cam_no, COUNT(*) FILTER (user_id % 12 < 4) AS patrol_left, COUNT(*) FILTER (k % 2 = 0) AS lit,
 (SELECT array_to_string(list_sort(list(DISTINCT t)), '|') FROM (SELECT {_list(_TAGS, 'k')} AS t FROM sev b WHERE b.area = a.area AND k % 6 <> 0 UNION ALL SELECT {_list(_TAGS, 'k + 1')} FROM sev b WHERE b.area = a.area AND k % 6 <> 0)) AS tags FROM sev a GROUP BY 1""", "sev")
def _(spark, d):
    scored = E.event_severity(E.keyed_events(B.nested_events(spark, d)))
    out = E.unit_facts(scored, ["area"])
    return out.select("area", "cam_yes", "cam_no", "patrol_left", "lit", joined_text(F.array_sort("tags")).alias("tags"))


@query("feedback_delta", """SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 OR c_acctbal <= 0 THEN 0e0 WHEN (c_acctbal - (c_custkey % 100)*90)/c_acctbal >= 0.3 THEN -15e0
 WHEN (c_acctbal - (c_custkey % 100)*90)/c_acctbal < 0.1 THEN 8e0 ELSE 0e0 END AS delta FROM customer""")
def _(spark, d):
    c = B.table(spark, d, "customer")
    delta = E.feedback_delta(F.col("c_acctbal"), (F.col("c_custkey") % 100 * 90).cast("double"), F.col("c_nationkey") % 2 == 1)
    return c.select(F.col("c_custkey").alias("id"), delta.alias("delta"))


@query("join_actions", """SELECT u.area, u.street, coalesce(n_actions,0) AS n_actions, coalesce(action_types,'') AS action_types FROM (SELECT DISTINCT area, street FROM sev WHERE street IS NOT NULL) u LEFT JOIN
 (SELECT 'Area ' || (l_suppkey % 12) AS area, 'RUA ' || (l_partkey % 15) AS su, COUNT(*) AS n_actions, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS action_types FROM lineitem GROUP BY 1,2) a ON a.area = u.area AND a.su = upper(u.street)""", "sev")
def _(spark, d):
    li = B.table(spark, d, "lineitem")
    actions = li.select(F.concat(F.lit("Area "), (F.col("l_suppkey") % 12).cast("string")).alias("area_fm"),
                        F.concat(F.lit("rua "), (F.col("l_partkey") % 15).cast("string")).alias("logradouro"), F.col("l_returnflag").alias("action_type"))
    units = E.keyed_events(B.nested_events(spark, d)).filter("street is not null").select("area", "street").distinct()
    out = E.join_actions(units, actions, ["area", "street"])
    return out.select("area", "street", F.coalesce("n_actions", F.lit(0)).alias("n_actions"), F.coalesce("action_types", F.lit("")).alias("action_types"))


# ------------------------------------------------------------------ allocation
def _fleet_sql(rows: str, size: int = 600, floor: int = 25, share: float = 0.35) -> str:
    cap = float(int(size * share))
    return f"""SELECT *, CAST(f + floor(m/r) + CASE WHEN p < m % r THEN 1 ELSE 0 END AS BIGINT) AS agents FROM (SELECT *, floor(c2) AS f, row_number() OVER (ORDER BY c2 - floor(c2) DESC, sc DESC, area) - 1 AS p,
 greatest({size} - SUM(floor(c2)) OVER (), 0) AS m, COUNT(*) OVER () AS r FROM (SELECT *, CASE WHEN c1 < {cap!r} AND SUM(CASE WHEN c1 < {cap!r} THEN c1 END) OVER () > 0 THEN c1 + SUM(raw - c1) OVER ()*(c1/SUM(CASE WHEN c1 < {cap!r} THEN c1 END) OVER ()) ELSE c1 END AS c2
 FROM (SELECT *, least(raw, {cap!r}) AS c1 FROM (SELECT *, base + greatest(sc,0.1e0)/SUM(greatest(sc,0.1e0)) OVER ()*({size} - base*nn) AS raw FROM
 (SELECT *, CASE WHEN nn*{floor} >= {size} THEN greatest(1, {size}//(nn*2)) ELSE {floor} END AS base FROM (SELECT *, COUNT(*) OVER () AS nn FROM {rows}))))))"""


ctes.TABLES["fleet"] = ("uarea", _fleet_sql("(SELECT area, gini, round(final_score,2) AS sc, priority FROM uarea)"))


def _fleet(spark, d):
    areas, _streets = E.score_report(B.nested_events(spark, d), with_reasons=False)
    return L.allocate_fleet(areas)


@query("allocate_fleet", "SELECT area, agents, round(agents/600e0,4) AS share_of_fleet FROM fleet", "fleet")
def _(spark, d):
    return _fleet(spark, d).select("area", "agents", "share_of_fleet")


@query("allocate_fleet_capped", "SELECT area, agents FROM (" + _fleet_sql("(SELECT c_mktsegment AS area, CASE WHEN c_mktsegment = 'BUILDING' THEN 900e0 ELSE COUNT(*)*1e0/10 END AS sc FROM customer GROUP BY 1)", 600, 25, 0.35) + ")")
def _(spark, d):
    c = B.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("area")).agg(F.count(F.lit(1)).alias("n"))
    return L.allocate_fleet(c.withColumn("final_score", F.when(F.col("area") == "BUILDING", 900.0).otherwise(F.col("n") * 1.0 / 10))).select("area", "agents")


@query("largest_remainder", """SELECT c_nationkey, CAST(floor(v) + CASE WHEN row_number() OVER (ORDER BY v - floor(v) DESC, c_nationkey) <= 1000 - SUM(floor(v)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats
 FROM (SELECT c_nationkey, COUNT(*)*1000e0/SUM(COUNT(*)) OVER () AS v FROM customer GROUP BY 1)""")
def _(spark, d):
    from pyspark.sql import Window

    n = M.count_by(B.table(spark, d, "customer"), ["c_nationkey"])
    v = n.withColumn("v", F.col("n") * 1000.0 / F.sum("n").over(Window.partitionBy()))
    return L.largest_remainder(v, [], "v", F.lit(1000), [F.col("c_nationkey")], "seats").select("c_nationkey", "seats")


_DP = "CASE WHEN hour < 5 THEN 'madrugada' WHEN hour < 7 THEN 'amanhecer' WHEN hour < 12 THEN 'manha' WHEN hour < 17 THEN 'tarde' WHEN hour < 19 THEN 'entardecer' ELSE 'noite' END"
ctes.TABLES["shift"] = ("fleet sev30", f"""SELECT area, agents AS total, part AS daypart, o, w, floor(agents*w) AS f, row_number() OVER (PARTITION BY area ORDER BY w DESC, o) AS rn FROM (SELECT *, b/SUM(b) OVER (PARTITION BY area) AS w FROM
 (SELECT fl.area, fl.agents, dp.part, dp.o, CASE WHEN SUM(c) OVER (PARTITION BY fl.area) IS NULL THEN dp.d ELSE (1e0-fl.gini)*dp.d + fl.gini*coalesce(c,0)/SUM(c) OVER (PARTITION BY fl.area) END AS b
 FROM fleet fl CROSS JOIN (SELECT col0 AS part, col1::DOUBLE AS d, col2 AS o FROM (VALUES ('madrugada',0.10e0,0),('amanhecer',0.08e0,1),('manha',0.18e0,2),('tarde',0.22e0,3),('entardecer',0.20e0,4),('noite',0.22e0,5))) dp
 LEFT JOIN (SELECT area, {_DP} AS part, COUNT(*) AS c FROM (SELECT area, hour, row_number() OVER (PARTITION BY area ORDER BY s_event DESC, event_id) rn FROM sev30) WHERE rn <= 5 AND hour IS NOT NULL GROUP BY 1,2) e ON e.area = fl.area AND e.part = dp.part))""")


@query("shift_split", "SELECT area, daypart, CAST(a AS BIGINT) AS agents, round(w,6) AS weight FROM (SELECT *, f + CASE WHEN rn = 1 THEN total - SUM(f) OVER (PARTITION BY area) ELSE 0 END AS a FROM shift) WHERE a > 0", "shift")
def _(spark, d):
    events = B.nested_events(spark, d)
    from geoevents.operators.metrics import window_filter

    scored = E.event_severity(window_filter(E.keyed_events(events), 30))
    top = E.top_events(scored, ["area"]).select("area", F.col("temporal.hour_24").alias("hour"))
    # the score is kept to six digits, so both engines floor the same products
    fleet = _fleet(spark, d).withColumn("gini", r6("gini"))
    return rounded(L.shift_split(fleet, top).drop("rationale"), "weight")


@query("reason_text_and_actions", None)
def _(spark, d):
    areas, _streets = E.score_report(B.nested_events(spark, d))
    return areas.select("area", joined_text(L.reason_text(F.col("reasons"))).alias("reasons"), joined_text(L.suggest_actions(F.col("reasons"))).alias("actions"))


ctes.TABLES["roster"] = ("weighted", """SELECT *, CAST(12 + floor((600-12*COUNT(*) OVER ())*(weighted/SUM(weighted) OVER ())+0.5e0) AS BIGINT) AS agents FROM weighted""")


def _roster(spark, d):
    rep = report_of(spark, d)
    return rep, L.roster_plan(rep.scores(digits=6), M.hour_histogram(rep.incidents, ["zone_id"]), M.weekday_histogram(rep.incidents, ["zone_id"]))


@query("roster_plan", """SELECT zone_id, agents, CAST(floor(agents/4e0+0.5e0) AS BIGINT) AS agents_per_shift, CAST(floor(agents/600e0*100+0.5e0) AS BIGINT) AS pct_of_force, street_people > 200 AS street_people_alert,
 CASE WHEN weighted >= 65 THEN 'critico' WHEN weighted >= 45 THEN 'alto' WHEN weighted >= 30 THEN 'medio' ELSE 'baixo' END AS risk, h1 || 'h–' || least(h1+3,23) || 'h' AS priority_shift, greatest(h1-1,0) || 'h–' || least(h2+2,23) || 'h' AS hour_window,
 (SELECT string_agg(weekday, ',' ORDER BY n DESC, weekday) FROM (SELECT weekday, COUNT(*) n FROM izone b WHERE b.zone_id = r.zone_id GROUP BY 1 ORDER BY n DESC, weekday LIMIT 3)) AS critical_days
 FROM roster r JOIN (SELECT zone_id, max(CASE WHEN rn=1 THEN hour END) h1, max(CASE WHEN rn=2 THEN hour END) h2 FROM (SELECT zone_id, hour, row_number() OVER (PARTITION BY zone_id ORDER BY COUNT(*) DESC, hour) rn FROM izone WHERE hour IS NOT NULL GROUP BY 1,2) GROUP BY 1) USING (zone_id)""", "roster izone")
def _(spark, d):
    cols = "zone_id agents agents_per_shift pct_of_force street_people_alert risk priority_shift hour_window critical_days"
    return _roster(spark, d)[1].select(*cols.split())


def _modes(spark, d):
    rep, roster = _roster(spark, d)
    k = F.col("zone_order")
    modus = roster.select("zone_id", F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in ("motocicleta", "a_pe", "armado", "em_grupo")]), F.array(k % 4, k % 6, k % 3, k % 5))).alias("modus", "n"))
    return rep, roster, L.mode_mix(roster.withColumn("street_people", k * 40).withColumn("name", F.when(k % 2 == 0, "Botafogo").otherwise(F.col("name"))), modus)


@query("mode_mix_totals", "SELECT zone_id, CAST(floor(agents/4e0+0.5e0) AS BIGINT) AS total FROM roster", "roster")
def _(spark, d):
    return _modes(spark, d)[2].groupBy("zone_id").agg(F.sum("mode_agents").alias("total"))


ctes.TABLES["modes"] = ("roster", """SELECT zone_id, mode_order, mode, a AS mode_agents, CAST(floor(a*100e0/total+0.5e0) AS BIGINT) AS pct, ppl, s_pe, s_armed, night_pct FROM (
 SELECT *, unnest([{'mode_order': 0, 'mode': 'pe', 'a': total - a_moto - a_viatura - a_bike - a_social}, {'mode_order': 1, 'mode': 'moto', 'a': a_moto}, {'mode_order': 2, 'mode': 'viatura', 'a': a_viatura},
  {'mode_order': 3, 'mode': 'bicicleta', 'a': a_bike}, {'mode_order': 4, 'mode': 'social', 'a': a_social}], recursive := true) FROM (
 SELECT *, CAST(floor(q_moto*1e0/q*total+0.5e0) AS BIGINT) AS a_moto, CAST(floor(q_viatura*1e0/q*total+0.5e0) AS BIGINT) AS a_viatura, CAST(floor(q_bike*1e0/q*total+0.5e0) AS BIGINT) AS a_bike, CAST(floor(q_social*1e0/q*total+0.5e0) AS BIGINT) AS a_social FROM (
 SELECT *, q_moto + q_viatura + q_bike + q_social + q_pe AS q FROM (
 SELECT *, 25 + moto*10 + grp*5 + nt*8 AS q_moto, 15 - foot*10 + armed*8 AS q_viatura, CASE WHEN bike THEN 10 - moto*5 ELSE 0 END AS q_bike, soc AS q_social,
  50 - moto*5 + foot*10 - armed*8 - grp*5 - nt*8 + CASE WHEN bike THEN 0 ELSE 10 - moto*5 END - soc AS q_pe FROM (
 SELECT *, (s_moto > 10)::INT AS moto, (s_pe > 40)::INT AS foot, (s_armed > 20)::INT AS armed, (s_group > 25)::INT AS grp, (night_pct > 65)::INT AS nt,
  CASE WHEN ppl > 500 THEN 12 WHEN ppl > 200 THEN 7 ELSE 0 END AS soc, regexp_matches(nm, 'jardim de alah|botafogo|rio sul|copacabana') AS bike FROM (
 SELECT zone_id, night_pct, zone_order*40 AS ppl, CASE WHEN zone_order % 2 = 0 THEN 'botafogo' ELSE lower(name) END AS nm, CAST(floor(agents/4e0+0.5e0) AS BIGINT) AS total,
  CASE WHEN s > 0 THEN (zone_order % 4)*100e0/s ELSE 0e0 END AS s_moto, CASE WHEN s > 0 THEN (zone_order % 6)*100e0/s ELSE 0e0 END AS s_pe, CASE WHEN s > 0 THEN (zone_order % 3)*100e0/s ELSE 0e0 END AS s_armed,
  CASE WHEN s > 0 THEN (zone_order % 5)*100e0/s ELSE 0e0 END AS s_group FROM (SELECT *, zone_order % 4 + zone_order % 6 + zone_order % 3 + zone_order % 5 AS s FROM roster))))))) WHERE a > 0""")
_NIGHT = "CASE WHEN round(night_pct,1) = floor(round(night_pct,1)) THEN CAST(CAST(round(night_pct,1) AS BIGINT) AS VARCHAR) ELSE CAST(round(night_pct,1) AS VARCHAR) END"


@query("mode_mix", f"""SELECT zone_id, mode_order, mode, mode_agents, pct, CASE mode
 WHEN 'pe' THEN CASE WHEN s_pe > 40 THEN CAST(floor(s_pe+0.5e0) AS BIGINT) || '% do modus operandi é a pé — presença densa nos trechos' ELSE 'Presença visível nas vias de maior movimento' END
 WHEN 'moto' THEN CASE WHEN night_pct > 65 THEN {_NIGHT} || '% dos crimes são noturnos — agilidade de resposta essencial' ELSE 'Cobertura dinâmica do eixo viário principal' END
 WHEN 'viatura' THEN CASE WHEN s_armed > 15 THEN CAST(floor(s_armed+0.5e0) AS BIGINT) || '% dos crimes registrados com arma de fogo' ELSE 'Base de apoio e resposta a ocorrências graves' END
 WHEN 'bicicleta' THEN 'Orla/parque — patrulha silenciosa com maior alcance' ELSE ppl || ' pessoas em situação de rua mapeadas' END AS rationale FROM modes""", "modes")
def _(spark, d):
    return _modes(spark, d)[2]


@query("street_positions", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY total DESC, street) AS k FROM top_st QUALIFY k <= 6),
 m AS (SELECT zone_id, SUM(mode_agents) AS agents, list(mode ORDER BY mode_order) AS modes FROM modes WHERE mode <> 'social' GROUP BY 1),
 p AS (SELECT t.zone_id, CAST(k AS INT) AS position, street, CAST(greatest(2, floor(total*1e0/SUM(total) OVER (PARTITION BY t.zone_id)*agents*0.8e0+0.5e0)) AS INT) AS agents, modes[CAST((k-1) % len(modes) AS INT)+1] AS mode,
  CASE WHEN peak_hour = 0 THEN 20 ELSE peak_hour END AS h, n_transeunte, n_celular, n_coletivo, total FROM t JOIN m USING (zone_id))
 SELECT zone_id, position, street, agents, mode, h || 'h–' || CASE WHEN h BETWEEN 5 AND 11 THEN h+3 WHEN h BETWEEN 12 AND 17 THEN h+2 ELSE least(h+3,23) END || 'h' AS shift,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN n_transeunte > 0 THEN 'roubo a transeunte (' || n_transeunte || ')' END, CASE WHEN n_celular > 0 THEN 'furto celular (' || n_celular || ')' END,
   CASE WHEN n_coletivo > 0 THEN 'roubo em coletivo (' || n_coletivo || ')' END], lambda x: x IS NOT NULL)[1:2], ' · '), ''), 'monitoramento geral') AS focus, total AS crimes FROM p
 UNION ALL SELECT zone_id, max(position) + 1, 'Pontos de concentração de PSR', CAST(any_value(modes.mode_agents) AS INT), 'social', '07h–11h e 18h–22h', 'abordagem social — ' || any_value(ppl) || ' PSR mapeados', 0
 FROM p JOIN modes USING (zone_id) WHERE modes.mode = 'social' AND ppl > 100 GROUP BY zone_id""", "top_st modes")
def _(spark, d):
    rep, roster, modes = _modes(spark, d)
    people = roster.select("zone_id", (F.col("zone_order") * 40).alias("street_people"))
    return L.street_positions(rep.streets(), modes, street_people=people)


# ------------------------------------------------------------------ the assembled document
def _document_report(spark, d):
    rep = report_of(spark, d)
    rep.layers.neighbourhoods, rep.layers.census = B.neighbourhood_edges(spark, d), B.census(spark, d)
    return rep


ctes.TABLES["zmon"] = ("izone", "SELECT zone_id, CAST(date_trunc('month', day) AS DATE) AS month, COUNT(*) AS n FROM izone GROUP BY 1,2")
ctes.TABLES["zfilled"] = ("zmon", """SELECT s.zone_id, s.month, coalesce(m.n, 0) AS n FROM (SELECT zone_id, CAST(unnest(generate_series(greatest(lo, hi - INTERVAL 59 MONTH), hi, INTERVAL 1 MONTH)) AS DATE) AS month
 FROM (SELECT zone_id, CAST(min(month) AS TIMESTAMP) lo, CAST(max(month) AS TIMESTAMP) hi FROM zmon GROUP BY 1)) s LEFT JOIN zmon m USING (zone_id, month)""")


@query("area_documents", f"""SELECT m.zone_id, m.crimes, m.tips, m.factors, m.cameras, m.street_people, m.has_report, CASE WHEN contains(m.name,'Botafogo') OR contains(m.name,'Copacabana') THEN 'Litorânea' ELSE 'Central' END AS base,
 coalesce(s.n,0) AS n_streets, s.first_street, coalesce(s.layers2,0) AS n_bingo, coalesce(s.layers3,0) AS n_triple, coalesce(h.n,0) AS sum_hours, coalesce(o.n,0) AS sum_offences, o.kinds AS n_offences,
 c.total AS calls_total, round(c.served,6) AS calls_pct_served, round(c.overdue,6) AS calls_pct_overdue, c.types AS call_types, v.n AS n_agencies, v.factors AS agency_factors, v.calls AS agency_calls,
 least(coalesce(f.n,0),1000) AS factor_points, least(m.cameras,1000) AS camera_points, least(m.street_people,1000) AS people_points,
 least(m.tips,400) AS tip_points, mo.months, tr.direction, ft.types AS factor_types, round(po.population,4) AS population_inside, ctx.members AS neighbourhoods, ctx.population AS population_around
 FROM measures m LEFT JOIN (SELECT zone_id, string_agg(month || ':' || n, '|' ORDER BY month) AS months FROM (SELECT zone_id, strftime(month,'%Y-%m') AS month, n,
   row_number() OVER (PARTITION BY zone_id ORDER BY month DESC) AS r FROM zmon) WHERE r <= 24 GROUP BY 1) mo USING (zone_id)
 LEFT JOIN (SELECT zone_id, CASE WHEN COUNT(*) < 4 OR COUNT(DISTINCT n) = 1 OR any_value(s) = 0 THEN 'estavel' WHEN any_value(s) > 0 THEN 'crescente' ELSE 'decrescente' END AS direction
   FROM zfilled LEFT JOIN (SELECT a.zone_id, SUM(sign(b.n - a.n)) AS s FROM zfilled a JOIN zfilled b ON a.zone_id = b.zone_id AND a.month < b.month GROUP BY 1) USING (zone_id) GROUP BY 1) tr USING (zone_id)
 LEFT JOIN (SELECT zone_id, string_agg(agency || '=' || total || ':' || kinds, ';' ORDER BY total DESC, agency) AS types FROM
   (SELECT zone_id, agency, SUM(n) AS total, string_agg(kind || ' ' || n, ',' ORDER BY r) FILTER (r <= 5) AS kinds FROM (SELECT zone_id, agency, kind, COUNT(*) AS n,
     row_number() OVER (PARTITION BY zone_id, agency ORDER BY COUNT(*) DESC, kind) AS r FROM fzone GROUP BY 1,2,3) GROUP BY 1,2) GROUP BY 1) ft USING (zone_id)
 LEFT JOIN (SELECT a_zone_id AS zone_id, SUM(c.pop_2022*o.area/(18000e0*9000e0)) AS population FROM overlap o JOIN census c ON c.zone_id = o.b_zone_id WHERE c.pop_2022 IS NOT NULL GROUP BY 1) po USING (zone_id)
 LEFT JOIN (SELECT a_zone_id AS zone_id, string_agg(DISTINCT name, '|' ORDER BY name) AS members, CAST(SUM(coalesce(pop_2022,0)) AS BIGINT) AS population
   FROM overlap o JOIN census c ON c.zone_id = o.b_zone_id GROUP BY 1) ctx USING (zone_id) LEFT JOIN (SELECT zone_id, COUNT(*) n, first(street ORDER BY street_rank) AS first_street, COUNT(*) FILTER (1 + near_f::INT + near_t::INT >= 2) AS layers2, COUNT(*) FILTER (near_f AND near_t) AS layers3 FROM st_layers GROUP BY 1) s USING (zone_id)
 LEFT JOIN (SELECT zone_id, COUNT(*) n FROM izone WHERE hour IS NOT NULL GROUP BY 1) h USING (zone_id) LEFT JOIN (SELECT zone_id, COUNT(*) n, COUNT(DISTINCT offence) kinds FROM izone GROUP BY 1) o USING (zone_id)
 LEFT JOIN (SELECT zone_id, COUNT(*) total, AVG((status = 'Atendido')::INT)*100 AS served, AVG((due = 'Vencido')::INT)*100 AS overdue, least(COUNT(DISTINCT kind || agency),20) AS types FROM czone GROUP BY 1) c USING (zone_id)
 LEFT JOIN (SELECT zone_id, COUNT(*) n, CAST(SUM(field_factors) AS BIGINT) AS factors, CAST(SUM(calls) AS BIGINT) AS calls FROM cross_rows GROUP BY 1) v USING (zone_id)
 LEFT JOIN (SELECT zone_id, COUNT(lat) n FROM fzone GROUP BY 1) f USING (zone_id)""", "measures izone czone fzone st_layers cross_rows zmon zfilled overlap census")
def _(spark, d):
    doc = _document_report(spark, d).documents()
    total = lambda c, f: F.coalesce(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x[f]), F.lit(0))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    listed = lambda c, f: F.when(F.col(c).isNotNull(), total(c, f))
    return doc.select(
        "zone_id", "crimes", "tips", "factors", "cameras", "street_people", "has_report", "base", size("top_streets").alias("n_streets"),
        F.element_at("top_streets", 1)["street"].alias("first_street"), "n_bingo", "n_triple", total("hours", "n").alias("sum_hours"),
        total("by_offence", "n").alias("sum_offences"), F.when(F.col("by_offence").isNotNull(), F.size("by_offence")).alias("n_offences"),
        F.col("calls.total").alias("calls_total"), r6("calls.pct_served").alias("calls_pct_served"), r6("calls.pct_overdue").alias("calls_pct_overdue"),
        F.when(F.col("calls").isNotNull(), F.size("calls.by_type")).alias("call_types"),
        F.when(F.col("cross_validation").isNotNull(), F.size("cross_validation")).alias("n_agencies"),
        listed("cross_validation", "field_factors").alias("agency_factors"), listed("cross_validation", "calls").alias("agency_calls"),
        size("factor_points").alias("factor_points"), size("camera_points").alias("camera_points"), size("street_people_points").alias("people_points"),
        size("tip_points").alias("tip_points"), joined_text(F.transform("monthly", lambda m: F.concat(m["month"], F.lit(":"), m["n"]))).alias("months"),
        F.col("trend.direction").alias("direction"), joined_text(F.transform("factors_by_agency", lambda a: F.concat(
            a["agency"], F.lit("="), a["total"], F.lit(":"), joined_text(F.transform(a["tipos"], lambda t: F.concat(t["tipo"], F.lit(" "), t["count"])), ","))), ";")
        .alias("factor_types"), r6("population_inside", 4).alias("population_inside"), joined_text("neighbourhoods").alias("neighbourhoods"), "population_around")

