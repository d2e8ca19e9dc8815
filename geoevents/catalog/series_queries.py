"""Queries of the monthly series operators, on service calls by kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoevents.catalog import ctes
from geoevents.catalog.common import month_text, rounded
from geoevents.catalog.registry import query
from geoevents.functions import fixed_values as V
from geoevents.operators import queries as Q
from geoevents.operators import series as T
from geoevents.sources import bindings as B

BY = ["kind"]


def _monthly(spark, d):
    return T.monthly_counts(B.calls(spark, d), BY)


def _filled(spark, d):
    return T.gap_filled_series(_monthly(spark, d), BY)


@query("monthly_counts", "SELECT kind, strftime(month,'%Y-%m') AS month, n FROM mon", "mon")
def _(spark, d):
    return month_text(_monthly(spark, d))


@query("last_k_periods", "SELECT kind, strftime(month,'%Y-%m') AS month, n FROM mon QUALIFY row_number() OVER (PARTITION BY kind ORDER BY month DESC) <= 24", "mon")
def _(spark, d):
    return month_text(T.last_k_periods(_monthly(spark, d), BY, 24))


@query("query_monthly", "SELECT zone_id, strftime(month,'%Y-%m') AS month, n FROM (SELECT kind AS zone_id, month, n FROM mon) WHERE zone_id = '5-LOW' ORDER BY month DESC LIMIT 60", "mon")
def _(spark, d):
    return month_text(Q.query_monthly(_monthly(spark, d).withColumnRenamed("kind", "zone_id"), "5-LOW", window=500))


# calls of a street in a neighbourhood: few a month, so the gaps are real
ctes.TABLES["sparse"] = ("cal", "SELECT street, neighbourhood, CAST(date_trunc('month', day) AS DATE) AS month, COUNT(*) AS n FROM cal GROUP BY 1,2,3")


@query("gap_filled_series", """SELECT s.street, s.neighbourhood, strftime(s.month,'%Y-%m') AS month, coalesce(m.n,0) AS n
 FROM (SELECT street, neighbourhood, CAST(unnest(generate_series(greatest(lo, hi - INTERVAL 59 MONTH), hi, INTERVAL 1 MONTH)) AS DATE) AS month
 FROM (SELECT street, neighbourhood, CAST(min(month) AS TIMESTAMP) lo, CAST(max(month) AS TIMESTAMP) hi FROM sparse GROUP BY 1,2)) s
 LEFT JOIN sparse m USING (street, neighbourhood, month)""", "sparse")
def _(spark, d):
    by = ["street", "neighbourhood"]
    return month_text(T.gap_filled_series(T.monthly_counts(B.calls(spark, d), by), by))


# all calls by person: few a month, so the gaps are real without thinning the rows
ctes.TABLES["person_mon"] = ("cal", "SELECT person, CAST(date_trunc('month', day) AS DATE) AS month, COUNT(*) AS n FROM cal GROUP BY 1,2")


@query("gap_filled_people", """SELECT s.person, strftime(s.month,'%Y-%m') AS month, coalesce(m.n,0) AS n FROM (SELECT person, CAST(unnest(generate_series(greatest(lo, hi - INTERVAL 59 MONTH), hi, INTERVAL 1 MONTH)) AS DATE) AS month
 FROM (SELECT person, CAST(min(month) AS TIMESTAMP) lo, CAST(max(month) AS TIMESTAMP) hi FROM person_mon GROUP BY 1)) s LEFT JOIN person_mon m USING (person, month)""", "person_mon")
def _(spark, d):
    return month_text(T.gap_filled_series(T.monthly_counts(B.calls(spark, d), ["person"]), ["person"]))


ctes.TABLES["mk"] = ("filled", """SELECT kind, n_months, s, (n_months*(n_months-1)*(2*n_months+5) - t)/18e0 AS v FROM
 (SELECT a.kind, CAST(SUM(sign(b.n - a.n)) AS BIGINT) AS s FROM filled a JOIN filled b ON a.kind = b.kind AND a.month < b.month GROUP BY 1)
 JOIN (SELECT kind, CAST(COUNT(*) AS BIGINT) AS n_months FROM filled GROUP BY 1) USING (kind)
 JOIN (SELECT kind, SUM(c*(c-1)*(2*c+5)) AS t FROM (SELECT kind, n, COUNT(*) c FROM filled GROUP BY 1,2) GROUP BY 1) USING (kind)""")


@query("mann_kendall", """SELECT kind, CAST(n_months AS INT) AS n_months, v > 0 AS available, s, round((s - sign(s))/sqrt(v),6) AS z, round(s/(0.5e0*n_months*(n_months-1)),6) AS tau,
 CASE WHEN s > 0 THEN 'crescente' WHEN s < 0 THEN 'decrescente' ELSE 'estavel' END AS direction, abs((s - sign(s))/sqrt(v)) > 1.959963984540054e0 AS significant FROM mk""", "mk")
def _(spark, d):
    return rounded(T.mann_kendall(_filled(spark, d), BY, with_p=False), "z", "tau").drop("reason")


@query("mann_kendall_p", None)
def _(spark, d):
    return rounded(T.mann_kendall(_filled(spark, d), BY), "z", "tau", "p_value")


@query("poisson_ci", None)
def _(spark, d):
    return month_text(T.poisson_ci(_monthly(spark, d)))


@query("join_series_ci", "SELECT kind, strftime(month,'%Y-%m') AS month, n, TRUE AS inside FROM mon QUALIFY row_number() OVER (PARTITION BY kind ORDER BY month DESC) <= 12", "mon")
def _(spark, d):
    monthly = _monthly(spark, d)
    out = T.join_series_ci(T.last_k_periods(monthly, BY, 12), T.poisson_ci(monthly), BY)
    return month_text(out.select("kind", "month", "n", ((F.col("ci_lo") <= F.col("n")) & (F.col("n") <= F.col("ci_hi"))).alias("inside")))


# centred 2x12 average, least-squares ends, centred phase means
ctes.TABLES["dec"] = ("filled", """SELECT *, CASE WHEN core IS NOT NULL THEN core WHEN i < 6 THEN k1*i + c1 ELSE k2*i + c2 END AS trend FROM (SELECT *,
 regr_slope(core, i) FILTER (i >= 6 AND i < 18) OVER g AS k1, regr_intercept(core, i) FILTER (i >= 6 AND i < 18) OVER g AS c1,
 regr_slope(core, i) FILTER (i >= len-18 AND i < len-6) OVER g AS k2, regr_intercept(core, i) FILTER (i >= len-18 AND i < len-6) OVER g AS c2 FROM (SELECT *,
 CASE WHEN i >= 6 AND i < len-6 THEN (CAST(SUM(n) OVER (PARTITION BY kind ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS DOUBLE) + (lag(n,6) OVER o + lead(n,6) OVER o)/2e0)/12e0 END AS core
 FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY month) - 1 AS i, COUNT(*) OVER (PARTITION BY kind) AS len FROM filled) WHERE len >= 24 WINDOW o AS (PARTITION BY kind ORDER BY month)) WINDOW g AS (PARTITION BY kind))""")
ctes.TABLES["seas"] = ("dec", """SELECT d.*, p.pm - AVG(CASE WHEN i < 12 THEN p.pm END) OVER (PARTITION BY d.kind) AS seasonal FROM dec d JOIN
 (SELECT kind, i % 12 AS ph, AVG(n - trend) AS pm FROM dec GROUP BY 1,2) p ON p.kind = d.kind AND p.ph = d.i % 12""")


@query("seasonal_decompose_additive", "SELECT kind, strftime(month,'%Y-%m') AS month, n, round(trend,5) AS trend, round(seasonal,5) AS seasonal FROM seas", "seas")
def _(spark, d):
    out = T.seasonal_decompose_additive(_filled(spark, d), BY)
    return month_text(rounded(out.drop("i"), "trend", "seasonal", digits=5))


_SEASONAL = """SELECT kind, CAST(COUNT(*) AS BIGINT) AS n_months, round((arg_max(trend,i)-arg_min(trend,i))/abs(arg_min(trend,i))*100,5) AS trend_delta_pct,
 (SELECT CAST(m AS INT) FROM (SELECT month(month) AS m, AVG(seasonal) s FROM seas b WHERE b.kind = a.kind GROUP BY 1) ORDER BY round(s,9) DESC, m LIMIT 1) AS peak_month FROM seas a GROUP BY 1"""


@query("seasonal_summary", _SEASONAL, "seas")
def _(spark, d):
    out = T.seasonal_summary(T.seasonal_decompose_additive(_filled(spark, d), BY), BY)
    return rounded(out, "trend_delta_pct", digits=5)


@query("trend_report", f"""SELECT mk.kind, CAST(mk.n_months AS INT) AS n_months, round((s - sign(s))/sqrt(v),6) AS z, trend_delta_pct, peak_month,
 CASE WHEN abs((s - sign(s))/sqrt(v)) > 1.959963984540054e0 THEN CASE WHEN s < 0 THEN 'queda real' ELSE 'alta real' END ELSE 'ruído / sem tendência' END AS badge
 FROM mk JOIN ({_SEASONAL}) q USING (kind)""", "mk seas")
def _(spark, d):
    out = T.trend_report(B.calls(spark, d), BY, with_p=False)
    return rounded(rounded(out, "z"), "trend_delta_pct", digits=5).select("kind", "n_months", "z", "trend_delta_pct", "peak_month", "badge")


@query("cumulative_timeline", """SELECT offence, CAST(h AS INT) AS hour, coalesce(n,0) AS is_new, CAST(SUM(coalesce(n,0)) OVER (PARTITION BY offence ORDER BY h) AS BIGINT) AS shown,
 CAST(SUM(coalesce(n,0)) OVER (PARTITION BY offence) AS BIGINT) AS total, h >= 23 AS done FROM (SELECT DISTINCT offence FROM inc) CROSS JOIN range(0,24) t(h)
 LEFT JOIN (SELECT offence, hour AS h, COUNT(*) n FROM inc WHERE hour IS NOT NULL GROUP BY 1,2) USING (offence, h)""", "inc")
def _(spark, d):
    return T.cumulative_timeline(B.incidents(spark, d), ["offence"])


@query("year_counts", "SELECT kind, CAST(year(day) AS INT) AS year, COUNT(*) AS n FROM cal GROUP BY 1,2", "cal")
def _(spark, d):
    return T.year_counts(B.calls(spark, d), BY)


@query("union_keys", "SELECT DISTINCT kind, CAST(year(day) AS INT) AS year FROM cal", "cal")
def _(spark, d):
    c = B.calls(spark, d)
    return T.union_keys(T.year_counts(c.filter(c.status == "Atendido"), BY), T.year_counts(c.filter(~c.status.eqNullSafe("Atendido")), BY), BY)


@query("yoy_displacement", f"""WITH ay AS (SELECT neighbourhood, year(day) AS y, COUNT(*) n FROM cal WHERE status = 'Atendido' GROUP BY 1,2), ry AS (SELECT neighbourhood, year(day) AS y, COUNT(*) n FROM cal WHERE status <> 'Atendido' GROUP BY 1,2),
 two AS (SELECT ay.*, row_number() OVER (PARTITION BY neighbourhood ORDER BY y DESC) k FROM ay),
 w AS (SELECT neighbourhood, max(CASE WHEN k=2 THEN two.n END) a0, max(CASE WHEN k=1 THEN two.n END) a1, coalesce(max(CASE WHEN k=2 THEN ry.n END),0) r0, coalesce(max(CASE WHEN k=1 THEN ry.n END),0) r1
   FROM two LEFT JOIN ry USING (neighbourhood, y) WHERE k <= 2 GROUP BY 1),
 p AS (SELECT *, CASE WHEN a0 > 0 THEN round((a1-a0)*1e0/a0*100,1) END ap, CASE WHEN r0 > 0 THEN round((r1-r0)*1e0/r0*100,1) END rp FROM w)
 SELECT neighbourhood, ap AS area_yoy_pct, rp AS ring_yoy_pct, CASE WHEN ap IS NULL OR rp IS NULL THEN 'inconclusivo' WHEN ap <= -{V.YOY_DEAD_BAND} AND rp >= {V.YOY_DEAD_BAND} THEN 'deslocamento_provavel'
  WHEN ap <= -{V.YOY_DEAD_BAND} AND rp <= -{V.YOY_DEAD_BAND} THEN 'reducao_genuina' WHEN ap >= {V.YOY_DEAD_BAND} AND rp >= {V.YOY_DEAD_BAND} THEN 'intensificacao' ELSE 'inconclusivo' END AS label,
  CASE WHEN ap IS NULL OR rp IS NULL OR least(a0,r0) < 10 THEN 'baixa' WHEN abs(ap-rp) >= 50 AND least(a0,r0) >= 30 THEN 'alta' ELSE 'media' END AS confidence FROM p""", "cal")
def _(spark, d):
    c = B.calls(spark, d)
    by = ["neighbourhood"]
    out = T.yoy_displacement(T.year_counts(c.filter(c.status == "Atendido"), by), T.year_counts(c.filter(c.status != "Atendido"), by), by)
    return out.select("neighbourhood", "area_yoy_pct", "ring_yoy_pct", "label", "confidence")
