"""Shared SQL table expressions: the source roles and spatial joins in plain arithmetic.

They restate ``sources.bindings`` and the joins independently of the Spark code: point in
polygon by comparing every point with every edge, distances by comparing every pair.
"""

from __future__ import annotations

from geoevents.functions import geo as G
from geoevents.sources.bindings import AGENCIES


def place(key: str, a: int, b: int, missing: str = "FALSE") -> str:
    return (
        f"CASE WHEN NOT ({missing}) THEN -23.2e0 + (({key}*{a})%50000)/1e5 END AS lat, "
        f"CASE WHEN NOT ({missing}) THEN -43.9e0 + (({key}*{b})%90000)/1e5 END AS lon"
    )


def pick(names: list[str], index: str) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + f"][CAST({index} AS INT)+1]"


def utm(src: str) -> str:
    """Sub-query adding metric x, y to a relation with lat, lon (same series, in SQL)."""
    e = repr(G._ECC)
    xs = "".join(f" + {a!r}*cos({2.0 * j}*xi)*sinh({2.0 * j}*eta)" for j, a in enumerate(G._ALPHA, 1))
    ys = "".join(f" + {a!r}*sin({2.0 * j}*xi)*cosh({2.0 * j}*eta)" for j, a in enumerate(G._ALPHA, 1))
    return (
        f"(SELECT * EXCLUDE (s_, t_, dl_, xi, eta), 500000.0e0 + {G._RADIUS!r}*(eta{xs}) AS x, "
        f"10000000.0e0 + {G._RADIUS!r}*(xi{ys}) AS y FROM ("
        f"SELECT *, atan2(t_, cos(dl_)) AS xi, atanh(sin(dl_)/sqrt(1e0+t_*t_)) AS eta FROM ("
        f"SELECT *, sinh(atanh(s_) - {e}*atanh({e}*s_)) AS t_ FROM ("
        f"SELECT *, sin(radians(lat)) AS s_, radians(lon + 45e0) AS dl_ FROM {src})))) "
    )


def edges_sql(src: str, ident: str, corners: list[tuple[str, str]]) -> str:
    rows = []
    for i, (x, y) in enumerate(corners):
        nx, ny = corners[(i + 1) % len(corners)]
        rows.append(f"SELECT {ident} AS zone_id, {i + 1} AS seq, {x} AS x1, {y} AS y1, {nx} AS x2, {ny} AS y2 FROM {src}")
    return " UNION ALL ".join(rows)


def pip(points: str, edges: str = "edges", key: str = "id") -> str:
    """Points inside zones by crossing parity over all edges."""
    return (
        f"SELECT p.{key}, e.zone_id FROM {points} p JOIN {edges} e ON (e.y1 > p.lat) <> (e.y2 > p.lat) "
        f"AND p.lon < e.x1 + (p.lat - e.y1)*(e.x2 - e.x1)/(e.y2 - e.y1) "
        f"GROUP BY p.{key}, e.zone_id HAVING COUNT(*) % 2 = 1"
    )


def seg_dist2(px: str, py: str, e: str = "e") -> str:
    dx, dy = f"({e}.x2-{e}.x1)", f"({e}.y2-{e}.y1)"
    t = f"greatest(0e0, least(1e0, (({px}-{e}.x1)*{dx}+({py}-{e}.y1)*{dy})/({dx}*{dx}+{dy}*{dy})))"
    return f"(pow({px}-({e}.x1+{t}*{dx}),2)+pow({py}-({e}.y1+{t}*{dy}),2))"


#: Tags of a column ``text`` by the patterns that stand for them, in the fixed order; a text without a tag's pattern has NULL there.
MODUS_TAGS = """[
 CASE WHEN regexp_matches(lower(text),'(^|[^\\p{L}\\p{N}_])(a p[eé]($|[^\\p{L}\\p{N}_])|caminhando($|[^\\p{L}\\p{N}_])|transeunte)') THEN 'a_pe' END,
 CASE WHEN regexp_matches(lower(text),'(^|[^\\p{L}\\p{N}_])(moto($|[^\\p{L}\\p{N}_])|motocicleta|duas rodas)') THEN 'motocicleta' END,
 CASE WHEN regexp_matches(lower(text),'(^|[^\\p{L}\\p{N}_])(bicicleta|ciclista)') THEN 'bicicleta' END,
 CASE WHEN regexp_matches(lower(text),'(^|[^\\p{L}\\p{N}_])(arma de fogo|pistola|revolver|armados?($|[^\\p{L}\\p{N}_]))') THEN 'armado' END,
 CASE WHEN regexp_matches(lower(text),'(^|[^\\p{L}\\p{N}_])(faca($|[^\\p{L}\\p{N}_])|canivete|arma branca)') THEN 'arma_branca' END,
 CASE WHEN regexp_matches(lower(text),'(^|[^\\p{L}\\p{N}_])(grupo($|[^\\p{L}\\p{N}_])|dois indiv|tr[ée]s indiv|quatro indiv|bando)') THEN 'em_grupo' END,
 CASE WHEN regexp_matches(lower(text),'(^|[^\\p{L}\\p{N}_])(menores?|adolescentes?)($|[^\\p{L}\\p{N}_])') THEN 'menores' END,
 CASE WHEN regexp_matches(lower(text),'(^|[^\\p{L}\\p{N}_])(ve[ií]culos?|carros?)($|[^\\p{L}\\p{N}_])') THEN 'veiculo' END]"""

_L = [("ox", "oy"), ("ox+0.2e0", "oy"), ("ox+0.2e0", "oy+0.04e0"), ("ox+0.1e0", "oy+0.04e0"), ("ox+0.1e0", "oy+0.09e0"), ("ox", "oy+0.09e0")]
_R = [("ox+0.05e0", "oy+0.03e0"), ("ox+0.23e0", "oy+0.03e0"), ("ox+0.23e0", "oy+0.12e0"), ("ox+0.05e0", "oy+0.12e0")]

# name -> (tables it starts from, SQL)
TABLES: dict[str, tuple[str, str]] = {
    "inc": ("", f"""SELECT event_id AS id, ts, CAST(ts AS DATE) AS day,
        CASE WHEN event_id % 17 <> 0 THEN CAST(hour(ts) AS INT) END AS hour, CAST(dayofweek(ts) AS INT) AS weekday,
        CASE event_type WHEN 'click' THEN 'Roubo a transeunte' WHEN 'view' THEN 'Roubo de aparelho celular'
          WHEN 'purchase' THEN 'Roubo em coletivo' WHEN 'error' THEN 'Furto' WHEN 'signup' THEN 'Roubo de veículo' END AS offence,
        CASE WHEN user_id % 31 <> 0 THEN 'avenida sao ' || (user_id % 40) ELSE '' END AS street,
        CAST(user_id % 41 AS INT) AS aisp, CAST(user_id % 7 AS INT) AS risp, user_id, value,
        {place('event_id', 7919, 104729)} FROM events"""),
    "fac": ("", f"""SELECT p_partkey AS id, p_type AS kind, {pick(AGENCIES, "CAST(replace(p_brand,'Brand#','') AS INT) % 8")} AS agency,
        'avenida sao ' || (p_partkey % 60) AS street, {place('p_partkey', 6271, 15485863, 'p_size % 10 = 0')} FROM part"""),
    "tip": ("", f"""SELECT doc_id AS id, text, source, lang,
        {pick(['ROUBO/FURTO A TRANSEUNTES', 'CONSUMO DE DROGAS', 'Furto de veiculo'], 'doc_id % 3')} AS kind,
        'avenida sao ' || (doc_id % 80) AS street, DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS day,
        {place('doc_id', 7907, 104723, 'doc_id % 4 = 0')} FROM documents"""),
    "cam": ("", f"SELECT s_suppkey AS id, 'NATION_' || s_nationkey AS area_name, {place('s_suppkey', 4999, 9973)} FROM supplier"),
    "cal": ("", f"""SELECT o_orderkey AS id, o_custkey AS person, CAST(o_orderdate AS DATE) AS day,
        CASE o_orderstatus WHEN 'O' THEN 'Atendido' WHEN 'P' THEN 'Não atendido' WHEN 'F' THEN 'Atendido parcialmente' END AS status,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'Vencido' ELSE 'No prazo' END AS due, o_orderpriority AS kind,
        {pick(AGENCIES, 'o_custkey % 8')} AS agency, 'avenida sao ' || (o_orderkey % 50) AS street,
        CAST(o_custkey % 25 AS INT) AS neighbourhood, {place('o_orderkey', 7691, 99991, 'o_orderkey % 5 = 0')} FROM orders"""),
    "ppl": ("", f"SELECT c_custkey AS id, {place('c_custkey', 8101, 99989)} FROM customer"),
    "orig": ("", "SELECT n_nationkey AS k, -43.9e0 + (n_nationkey % 5)*0.18e0 AS ox, -23.2e0 + CAST(n_nationkey // 5 AS DOUBLE)*0.1e0 AS oy FROM nation"),
    "zones": ("", "SELECT 'Z' || n_nationkey AS zone_id, n_name AS name, n_nationkey AS zone_order FROM nation"),
    "edges": ("orig", edges_sql("orig", "'Z' || k", _L)),
    "nedges": ("orig", edges_sql("orig", "'N' || k", _R)),
    "census": ("", """SELECT 'N' || n.n_nationkey AS zone_id, n.n_name AS name, r.r_name AS region, p.pop_2022, p.pop_2010, p.dwellings,
        n.n_nationkey AS neighbourhood FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
        LEFT JOIN (SELECT c_nationkey, COUNT(*)*100 AS pop_2022, COUNT(*) FILTER (c_acctbal > 1000)*110 AS pop_2010,
          COUNT(*) FILTER (c_mktsegment = 'BUILDING')*30 AS dwellings FROM customer GROUP BY 1) p ON p.c_nationkey = n.n_nationkey"""),
    "inc_z": ("inc edges", pip("inc")),
    "izone": ("inc inc_z", "SELECT inc.*, inc_z.zone_id FROM inc JOIN inc_z USING (id)"),
    "fac_z": ("fac edges", pip("fac")),
    "fzone": ("fac fac_z", "SELECT fac.*, fac_z.zone_id FROM fac JOIN fac_z USING (id)"),
    "tip_z": ("tip edges", pip("tip")),
    "tzone": ("tip tip_z", "SELECT tip.*, tip_z.zone_id FROM tip JOIN tip_z USING (id)"),
    "cal_z": ("cal edges", pip("cal")),
    "czone": ("cal cal_z", "SELECT cal.*, cal_z.zone_id FROM cal JOIN cal_z USING (id)"),
    "cam_z": ("cam edges", pip("cam")),
    "ppl_z": ("ppl edges", pip("ppl")),
    "inc_m": ("inc", f"SELECT * FROM {utm('inc')}"),
    "fac_m": ("fac", f"SELECT * FROM {utm('fac')}"),
    "tip_m": ("tip", f"SELECT * FROM {utm('tip')}"),
    "cam_m": ("cam", f"SELECT * FROM {utm('cam')}"),
    "measures": ("zones izone tip_z fac_z cam_z ppl_z", """SELECT z.zone_id, z.name, z.zone_order, coalesce(i.crimes,0) AS crimes,
        coalesce(i.peak_ratio,0e0) AS peak_ratio, coalesce(i.night_pct,0e0) AS night_pct, coalesce(t.n,0) AS tips,
        coalesce(f.n,0) AS factors, coalesce(c.n,0) AS cameras, coalesce(p.n,0) AS street_people, z.zone_order % 3 = 0 AS has_report
        FROM zones z LEFT JOIN (SELECT a.zone_id, a.crimes, a.night*100.0e0/a.timed AS night_pct, b.top3*1e0/a.timed AS peak_ratio FROM
            (SELECT zone_id, COUNT(*) crimes, COUNT(hour) timed, COUNT(*) FILTER (hour >= 18 OR hour <= 5) night FROM izone GROUP BY 1) a
            LEFT JOIN (SELECT zone_id, SUM(n) top3 FROM (SELECT zone_id, hour, COUNT(*) n, row_number() OVER (PARTITION BY zone_id ORDER BY COUNT(*) DESC) rn
              FROM izone WHERE hour IS NOT NULL GROUP BY 1,2) WHERE rn <= 3 GROUP BY 1) b USING (zone_id)) i USING (zone_id)
        LEFT JOIN (SELECT zone_id, COUNT(*) n FROM tip_z GROUP BY 1) t USING (zone_id)
        LEFT JOIN (SELECT zone_id, COUNT(*) n FROM fac_z GROUP BY 1) f USING (zone_id)
        LEFT JOIN (SELECT zone_id, COUNT(*) n FROM cam_z GROUP BY 1) c USING (zone_id)
        LEFT JOIN (SELECT zone_id, COUNT(*) n FROM ppl_z GROUP BY 1) p USING (zone_id)"""),
    "parts": ("measures", """SELECT *, crimes*1e0/coalesce(nullif(max(crimes) OVER (),0),1)*40 AS p1, peak_ratio*15 AS p2,
        factors*1e0/coalesce(nullif(max(factors) OVER (),0),1)*25 AS p3, tips*1e0/coalesce(nullif(max(tips) OVER (),0),1)*15 AS p4,
        CASE WHEN has_report THEN 5e0 ELSE 0e0 END AS p5 FROM measures"""),
    "streets": ("izone", """SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY total DESC, street) AS street_rank FROM (
        SELECT zone_id, street, COUNT(*) AS total, AVG(lat) AS lat, AVG(lon) AS lon,
          COUNT(*) FILTER (offence = 'Roubo a transeunte') AS n_transeunte, COUNT(*) FILTER (offence = 'Roubo de aparelho celular') AS n_celular,
          COUNT(*) FILTER (offence = 'Roubo em coletivo') AS n_coletivo FROM izone GROUP BY 1,2)
        JOIN (SELECT zone_id, street, coalesce(first(hour ORDER BY n DESC, hour) FILTER (hour IS NOT NULL), 0) AS peak_hour FROM
          (SELECT zone_id, street, hour, COUNT(*) n FROM izone GROUP BY 1,2,3) GROUP BY 1,2) USING (zone_id, street)"""),
    "top_st": ("streets", "SELECT * FROM streets WHERE street_rank <= 10 AND length(street) > 3"),
    "mon": ("cal", "SELECT kind, CAST(date_trunc('month', day) AS DATE) AS month, COUNT(*) AS n FROM cal GROUP BY 1,2"),
    "filled": ("mon", """SELECT s.kind, s.month, coalesce(m.n, 0) AS n FROM (SELECT kind, CAST(unnest(generate_series(
        greatest(lo, hi - INTERVAL 59 MONTH), hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM
        (SELECT kind, CAST(min(month) AS TIMESTAMP) lo, CAST(max(month) AS TIMESTAMP) hi FROM mon GROUP BY 1)) s
        LEFT JOIN mon m USING (kind, month)"""),
    "posts": ("", """SELECT conv_id*1000 + turn AS id, role AS account, text || CASE WHEN conv_id % 3 = 0 THEN ' houve assalto' ELSE '' END AS text, turn % 7 = 6 AS is_retweet, conv_id, turn,
        DATE '2024-01-01' + CAST(conv_id % 60 AS INT) AS day FROM conversations"""),
}


def with_tables(needs: str, sql: str) -> str:
    """Prefix the SQL with the table expressions it needs, dependencies first."""
    order: list[str] = []

    def add(name: str) -> None:
        deps, _ = TABLES[name]
        for d in deps.split():
            add(d)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    if not order:
        return sql
    parts = ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in order)
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts},\n{sql.lstrip()[len('WITH RECURSIVE '):]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {parts},\n{sql.lstrip()[len('WITH '):]}"
    return f"WITH {parts}\n{sql}"
