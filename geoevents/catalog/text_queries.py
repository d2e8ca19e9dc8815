"""Queries of scalar text and date functions, extraction, articles and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoevents.catalog import ctes
from geoevents.catalog.common import joined_text
from geoevents.catalog.registry import query
from geoevents.functions import fixed_values as V
from geoevents.functions import temporal as D
from geoevents.functions import text as X
from geoevents.operators import articles as A
from geoevents.operators import extraction as E
from geoevents.operators import queries as Q
from geoevents.sources import bindings as B
from geoevents.sources import scans as SC


@query("norm_street", "SELECT doc_id, md5(trim(lower(strip_accents(text)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))) AS norm FROM documents")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(X.norm_street(F.col("text")).cast("binary")).alias("norm"))


def _abbreviated(text: str) -> str:
    for pattern, word in V.STREET_ABBREVIATIONS:
        text = f"regexp_replace({text}, '{pattern}', '{word}', 'g')"
    return text


@query("norm_street_abbrev", f"""SELECT doc_id, md5(trim(regexp_replace({_abbreviated("trim(upper(replace(strip_accents(text), 'ß', 'ss')), ' ' || chr(9) || chr(10) || chr(13))")}, '\\s+', ' ', 'g'), ' ')) AS norm FROM documents""")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(X.norm_street_abbrev(F.col("text")).cast("binary")).alias("norm"))


@query("dedupe_prefix", "SELECT id, street FROM (SELECT id, CASE WHEN street = '' THEN '' ELSE 'avenida são ' || split_part(street,' ',3) END AS street FROM inc)", "inc")
def _(spark, d):
    return B.incidents(spark, d).select("id", X.dedupe_prefix(F.col("locf")).alias("street"))


@query("parse_hour", "SELECT id, hour FROM inc", "inc")
def _(spark, d):
    e = B.table(spark, d, "events")
    text = F.when(F.col("event_id") % 17 == 0, "x:10").otherwise(F.date_format("ts", "HH:mm:ss"))
    return e.select(F.col("event_id").alias("id"), D.parse_hour(text).alias("hour"))


@query("safe_casts", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(trunc(o_totalprice) AS INT) END AS i, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS f FROM orders")
def _(spark, d):
    o = B.table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice"))
    return o.select(F.col("o_orderkey").alias("id"), D.safe_int(text).alias("i"), D.comma_decimal(F.replace(text, F.lit("."), F.lit(","))).alias("f"))


@query("parse_date_multi", """SELECT id, strftime(CASE id % 4 WHEN 3 THEN date_trunc('month', day) ELSE day END, '%Y-%m-%d') AS day FROM cal""", "cal")
def _(spark, d):
    c = B.calls(spark, d)
    k = F.col("id") % 4
    # day/month/year only where it is not also month/day: the order of formats decides there
    text = F.when(k == 0, F.date_format("day", "yyyy-MM-dd")).when(k == 1, F.date_format("day", "dd/MM/yyyy")).when(
        (k == 2) & (F.dayofmonth("day") > 12), F.date_format("day", "MM/dd/yyyy")).when(k == 2, F.date_format("day", "d/M/yyyy"))
    day = D.parse_date_multi(text, F.year("day").cast("string"), F.month("day").cast("string"))
    return c.select("id", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("parse_tip_date", "SELECT id, strftime(day, '%Y-%m-%d') AS day FROM cal", "cal")
def _(spark, d):
    text = F.concat(F.date_format("day", "M/d/yyyy"), F.lit(" 8:16:00"))
    return B.calls(spark, d).select("id", F.date_format(D.parse_tip_date(text), "yyyy-MM-dd").alias("day"))


@query("parse_iso_ts", "SELECT event_id AS id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events")
def _(spark, d):
    e = B.table(spark, d, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return e.select(F.col("event_id").alias("id"), F.unix_timestamp(D.parse_iso_ts(iso)).alias("s"))


@query("period_keys", "SELECT id, strftime(day,'%Y-%m') AS month, CAST(year(day) AS INT) AS year, CAST(dayofweek(day) AS INT) AS weekday FROM cal", "cal")
def _(spark, d):
    return B.calls(spark, d).select("id", D.month_label(D.month_key(F.col("day"))).alias("month"), F.year("day").alias("year"), (F.dayofweek("day") - 1).alias("weekday"))


@query("dayparts", """SELECT id, CASE WHEN hour IS NULL THEN 'desconhecido' WHEN hour < 5 THEN 'madrugada' WHEN hour < 7 THEN 'amanhecer' WHEN hour < 12 THEN 'manha' WHEN hour < 17 THEN 'tarde' WHEN hour < 19 THEN 'entardecer' ELSE 'noite' END AS six,
 CASE WHEN hour < 6 THEN 'Madrugada' WHEN hour < 12 THEN 'Manhã' WHEN hour < 18 THEN 'Tarde' WHEN hour >= 18 THEN 'Noite' END AS four FROM inc""", "inc")
def _(spark, d):
    h = F.col("hour")
    return B.incidents(spark, d).select("id", D.daypart6(h).alias("six"), D.daypart4(h).alias("four"))


@query("text_window_label", "SELECT DISTINCT hour, greatest(hour-1,0) || 'h–' || least(hour+2,23) || 'h' AS label FROM inc WHERE hour IS NOT NULL", "inc")
def _(spark, d):
    h = F.col("hour")
    return B.incidents(spark, d).filter("hour is not null").select("hour", D.window_label(h - 1, h + 2).alias("label")).distinct()


@query("extract_modus", f"SELECT doc_id, array_to_string(list_filter({ctes.MODUS_TAGS}, lambda x: x IS NOT NULL), '|') AS tags FROM documents")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", joined_text(X.extract_modus(F.col("text"))).alias("tags"))


@query("offence_to_type", "SELECT id, CASE offence WHEN 'Roubo a transeunte' THEN 'roubo_transeunte' WHEN 'Roubo em coletivo' THEN 'roubo_transporte_coletivo' WHEN 'Furto' THEN 'furto' WHEN 'Roubo de veículo' THEN 'roubo_veiculo' ELSE 'outro' END AS type FROM inc", "inc")
def _(spark, d):
    return B.incidents(spark, d).select("id", X.offence_to_type(F.col("offence")).alias("type"))


@query("tip_to_type", "SELECT id, CASE kind WHEN 'ROUBO/FURTO A TRANSEUNTES' THEN 'roubo_transeunte' WHEN 'CONSUMO DE DROGAS' THEN 'outro' ELSE 'roubo_veiculo' END AS type FROM tip", "tip")
def _(spark, d):
    return B.tips(spark, d).select("id", X.tip_to_type(F.lit(None).cast("string"), F.col("kind")).alias("type"))


@query("descriptor_brackets", """SELECT doc_id, CASE WHEN n_chars < 12 THEN 'crianca' WHEN n_chars < 18 THEN 'adolescente' WHEN n_chars < 30 THEN 'jovem' WHEN n_chars < 60 THEN 'adulto' ELSE 'idoso' END AS age,
 CASE WHEN contains(t,'baix') THEN 'baixa' WHEN contains(t,'alt') THEN 'alta' WHEN contains(t,'med') OR contains(t,'média') THEN 'media' ELSE 'desconhecida' END AS height,
 CASE WHEN contains(t,'magr') THEN 'magro' WHEN contains(t,'fort') OR contains(t,'atlet') THEN 'forte' WHEN contains(t,'obes') OR contains(t,'gord') THEN 'obeso' WHEN contains(t,'medi') OR contains(t,'média') THEN 'medio' ELSE 'desconhecido' END AS build
 FROM (SELECT *, lower(text) AS t FROM documents)""")
def _(spark, d):
    text = F.col("text")
    return B.table(spark, d, "documents").select(
        "doc_id", X.age_bracket(F.col("n_chars").cast("string")).alias("age"), X.height_bracket(text).alias("height"), X.build_bracket(text).alias("build"))


@query("skin_category", """SELECT doc_id, CASE WHEN contains(t,'branc') THEN 'branca' WHEN contains(t,'pard') OR contains(t,'morena') THEN 'parda' WHEN contains(t,'pret') OR contains(t,'negr') THEN 'preta'
 WHEN contains(t,'amarel') THEN 'amarela' WHEN contains(t,'indig') THEN 'indigena' ELSE 'desconhecida' END AS category FROM (SELECT *, lower(text) AS t FROM documents)""")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", X.skin_category(F.col("text")).alias("category"))


@query("parse_json_array", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN event_type || '|b' WHEN 1 THEN event_type ELSE '' END AS items FROM events")
def _(spark, d):
    k, t = F.col("event_id") % 3, F.col("event_type")
    raw = F.when(k == 0, F.concat(F.lit('["'), t, F.lit(' ", "", "b"]'))).when(k == 1, t).otherwise("[]")
    return B.table(spark, d, "events").select(F.col("event_id").alias("id"), joined_text(X.parse_json_array(raw)).alias("items"))


@query("profile_text", "SELECT conv_id, turn, role || ', ' || turn || ' anos' AS profile FROM conversations")
def _(spark, d):
    listed = lambda c: F.concat(F.lit('["'), c, F.lit('"]'))
    profile = X.profile_text(listed(F.col("role")), listed(F.col("turn").cast("double").cast("string")), F.lit("[]"))
    return B.table(spark, d, "conversations").select("conv_id", "turn", profile.alias("profile"))


@query("event_id", "SELECT event_id AS id, left(sha1('ocorrencia_oficial:' || event_id),16) AS eid, left(sha1('event_type=' || event_type || '|user_id=' || user_id),16) AS row_id FROM events")
def _(spark, d):
    e = B.table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), X.event_id(F.lit("ocorrencia_oficial"), F.col("event_id").cast("string")).alias("eid"), X.row_hash(["user_id", "event_type"]).alias("row_id"))


@query("canonical_url", "SELECT page_id, regexp_replace(url,'[?#].*$','') AS url, left(sha1(regexp_replace(url,'[?#].*$','')),16) AS article_id FROM pages")
def _(spark, d):
    clean = X.canonical_url(F.col("url"))
    return B.table(spark, d, "pages").select("page_id", clean.alias("url"), X.article_id(clean).alias("article_id"))


@query("parse_count_suffix", "SELECT o_orderkey AS id, CASE WHEN o_totalprice >= 200000 THEN floor(o_totalprice / 1000) * 1000 ELSE floor(o_totalprice) END::BIGINT AS n FROM orders")
def _(spark, d):
    price = F.col("o_totalprice")
    text = F.when(price >= 200_000, F.concat(F.floor(price / 1000).cast("string"), F.lit("K"))).otherwise(F.format_number(F.floor(price), 0))
    return B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.parse_count_suffix(text).alias("n"))


@query("parse_dates_from_text", "SELECT id, strftime(day,'%Y-%m-%d') || ' 15:35' AS published, 'EXTRA' AS author FROM cal", "cal")
def _(spark, d):
    line = F.concat(F.lit("Por EXTRA— Rio de Janeiro"), F.date_format("day", "dd/MM/yyyy"), F.lit(" 15h35"))
    return B.calls(spark, d).select("id", F.date_format(X.article_published(line), "yyyy-MM-dd HH:mm").alias("published"), X.article_author(line).alias("author"))


@query("truncate_text", "SELECT doc_id, md5(left(text,300)) AS head FROM documents")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(F.left("text", F.lit(300)).cast("binary")).alias("head"))


@query("strip_tags", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html,'<[^>]*>',' ','g'),'\\s+',' ','g'))) AS h FROM pages")
def _(spark, d):
    return B.table(spark, d, "pages").select("page_id", F.md5(X.strip_tags(F.col("html")).cast("binary")).alias("h"))


@query("short_name", """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(split_part(text, ' - ', 1), '^Estações? ', ''), '^Metrô ', ''), '^Av ', 'Av. '), ' ')) AS short,
 upper(left(source,1)) || lower(substr(source,2)) AS cap FROM documents""")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(X.short_name(F.col("text")).cast("binary")).alias("short"), X.capitalise(F.col("source")).alias("cap"))


@query("base_label", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Litorânea' ELSE 'Central' END AS base FROM nation")
def _(spark, d):
    name = F.when(F.col("n_nationkey") % 3 == 0, "Praia de Botafogo").otherwise(F.col("n_name"))
    return B.table(spark, d, "nation").select("n_nationkey", X.base_label(name).alias("base"))


@query("loose_json", "SELECT event_id AS id, CAST(json_extract(props,'$.k') AS INT) AS k FROM events")
def _(spark, d):
    e = B.table(spark, d, "events")
    answer = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return e.select(F.col("event_id").alias("id"), F.from_json(X.loose_json(answer), "k int")["k"].alias("k"))


@query("factor_agency", "SELECT kind, CASE kind WHEN 'ECONOMY' THEN 'SMAS' ELSE 'Outro' END AS agency FROM (SELECT DISTINCT p_type AS kind FROM part)")
def _(spark, d):
    k = B.table(spark, d, "part").select(F.col("p_type").alias("kind")).distinct()
    name = F.when(F.col("kind") == "ECONOMY", "Cena de uso de drogas").otherwise(F.col("kind"))
    return k.select("kind", X.lookup(name, V.FACTOR_AGENCY, F.lit("Outro")).alias("agency"))


# ------------------------------------------------------------------ articles and chunks
@query("html_links", """SELECT page_id, url, CAST(min(pos) AS INT) AS pos FROM (SELECT page_id, regexp_replace(href,'[?#].*$','') AS url, pos - 1 AS pos FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l,1) AS pos
 FROM (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS l FROM pages))) GROUP BY 1,2""")
def _(spark, d):
    return A.html_links(B.table(spark, d, "pages"))


@query("parse_articles", """SELECT page_id, left(sha1(regexp_replace(url,'[?#].*$','')),16) AS article_id, regexp_extract(url,'^[a-z]+://([^/?#]+)',1) AS domain, trim(regexp_replace(regexp_replace(t,'<[^>]*>',' ','g'),'\\s+',' ','g')) AS title
 FROM (SELECT *, regexp_extract(html,'(?is)<h1\\b[^>]*>(.*?)</h1>',1) AS t FROM pages) WHERE trim(regexp_replace(regexp_replace(t,'<[^>]*>',' ','g'),'\\s+',' ','g')) <> '' AND NOT contains(t,'Desculpe-nos') AND NOT contains(t,'Ops')""")
def _(spark, d):
    return A.parse_articles(B.table(spark, d, "pages")).select("page_id", "article_id", "domain", "title")


@query("html_paragraphs", None)
def _(spark, d):
    p = B.table(spark, d, "pages").select("page_id", F.posexplode(A.html_paragraphs(F.col("html"))).alias("pos", "paragraph"))
    return p


@query("scan_articles", "SELECT page_id, left('title ' || page_id || chr(10) || chr(10) || trim(html, ' '), 6000) AS raw_text FROM pages")
def _(spark, d):
    p = B.table(spark, d, "pages").select(
        "page_id", F.lit(None).cast("string").alias("article_id"), "url", F.concat(F.lit("title "), F.col("page_id").cast("string")).alias("title"),
        F.lit(" ").alias("subtitle"), F.col("html").alias("body_text"), F.lit(None).cast("string").alias("published_at"), F.lit(None).cast("string").alias("fetched_at"))
    return SC.article_source_text(p).select("page_id", "raw_text")


# Paragraph by paragraph: a chunk is open or not, and a paragraph opens the next one or joins it.
_CHUNKS = """WITH RECURSIVE paras AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i, trim(p) AS p FROM
  (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(p) <> ''),
 walk(doc, i, p, chunk, size, going) AS (SELECT DISTINCT doc, 0::BIGINT, '', -1, 0::BIGINT, FALSE FROM paras
  UNION ALL SELECT doc, i, p, chunk, size, NOT (size >= 2000 AND NOT heading) FROM (SELECT n.doc, n.i, n.p, starts_with(n.p, '##') AS heading,
    CASE WHEN w.going AND NOT (starts_with(n.p, '##') OR w.size + length(n.p) + 1 > 3500) THEN w.chunk ELSE w.chunk + 1 END AS chunk,
    CASE WHEN w.going AND NOT (starts_with(n.p, '##') OR w.size + length(n.p) + 1 > 3500) THEN w.size ELSE 0 END + length(n.p) + 1 AS size
   FROM walk w JOIN paras n ON n.doc = w.doc AND n.i = w.i + 1))
SELECT doc, chunk AS chunk_index, doc || ':' || chunk AS chunk_id, string_agg(p, chr(10) ORDER BY i) AS chunk FROM walk WHERE i > 0 GROUP BY doc, walk.chunk"""


@query("chunk_text", _CHUNKS)
def _(spark, d):
    return A.chunk_text(B.table(spark, d, "documents"))


@query("chunk_text_whole", "SELECT doc_id AS doc, CAST(SUM(length(trim(p))) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE trim(p) <> '' GROUP BY 1")
def _(spark, d):
    c = A.chunk_text(B.table(spark, d, "documents"))
    return c.groupBy("doc").agg(F.sum(F.length(F.replace("chunk", F.lit("\n"), F.lit("")))).alias("n"))


# ------------------------------------------------------------------ extraction
def _incident_events(spark, d):
    inc = B.incidents(spark, d).withColumn("area", F.lit(None).cast("string"))
    return E.incidents_to_events(inc)


@query("incidents_to_events", """SELECT left(sha1('ocorrencia_oficial:' || id),16) AS event_id, CASE offence WHEN 'Roubo a transeunte' THEN 'roubo_transeunte' WHEN 'Roubo em coletivo' THEN 'roubo_transporte_coletivo' WHEN 'Furto' THEN 'furto'
 WHEN 'Roubo de veículo' THEN 'roubo_veiculo' ELSE 'outro' END AS crime_type, CAST(day AS VARCHAR) AS date_iso, hour, 0.9e0 AS confidence, CAST(id AS VARCHAR) AS source_id FROM inc""", "inc")
def _(spark, d):
    return _incident_events(spark, d).select(
        "event_id", "crime_type", F.col("temporal.date_iso").alias("date_iso"), F.col("temporal.hour_24").alias("hour"),
        F.col("extraction.confidence").alias("confidence"), F.col("source.source_id").alias("source_id"))


def _tip_events(spark, d):
    t = B.tips(spark, d)
    k = F.col("id")
    blank = F.lit(None).cast("string")
    return E.tips_to_events(t.withColumns({
        "classe": blank, "number": (k % 9).cast("string"), "neighbourhood": blank, "area": blank, "sexo": blank,
        "idade": F.when(k % 2 == 0, (k % 70).cast("string")), "pele": blank, "estatura": blank, "porte": blank, "outras": blank}))


@query("tips_to_events", """SELECT left(sha1('disque_denuncia:' || id),16) AS event_id, street || ' ' || (id % 9) AS address, (id % 2 = 0)::INT AS n_agents, sha1(trim(text,' ')) AS hash FROM tip""", "tip")
def _(spark, d):
    e = _tip_events(spark, d)
    return e.select("event_id", F.col("spatial.address_text").alias("address"), F.size("agents").alias("n_agents"), F.col("source.raw_text_hash").alias("hash"))


@query("hybrid_events", """SELECT left(sha1('disque_denuncia:' || id),16) AS event_id, CASE WHEN id % 3 <> 0 THEN 'hybrid' ELSE 'structured' END AS method, CASE WHEN id % 3 <> 0 THEN 0.8e0 ELSE 0.7e0 END AS confidence,
 CASE WHEN id % 3 <> 0 THEN 'noite' ELSE 'desconhecido' END AS daypart, street AS logradouro FROM tip""", "tip")
def _(spark, d):
    base = _tip_events(spark, d)
    t = B.tips(spark, d).filter(F.col("id") % 3 != 0)
    over = E.make_events(t, {
        "event_id": X.event_id(F.lit("disque_denuncia"), F.col("id").cast("string")), "temporal.daypart": F.lit("noite"),
        "spatial.logradouro": F.lit("other"), "extraction.confidence": F.lit(0.8), "extraction.method": F.lit("model")})
    out = E.hybrid_events(base, over)
    return out.select("event_id", F.col("extraction.method").alias("method"), F.col("extraction.confidence").alias("confidence"),
                      F.col("temporal.daypart").alias("daypart"), F.col("spatial.logradouro").alias("logradouro"))


def _responses(spark, d):
    """Answers as stored by event: the type that the event's own type stands for and the number in its properties, fenced; a view has
    its bare properties, without a type, and the other types are none that an event may have."""
    kind = F.coalesce(X.lookup(F.col("event_type"), {"error": "furto", "signup": "roubo_veiculo"}), F.col("event_type"))
    answer = F.when(F.col("event_type") == "view", F.col("props")).otherwise(F.concat(
        F.lit('```json\n{"event_id": "x", "crime_type": "'), kind, F.lit('", "agent_count_total": '), F.get_json_object("props", "$.k"), F.lit("}\n```")))
    rows = B.table(spark, d, "events").select(answer.alias("response"), F.lit("tweet").alias("source_kind"), F.col("event_id").cast("string").alias("source_id"))
    return E.responses_to_events(rows)


@query("responses_to_events", """SELECT left(sha1('tweet:' || event_id),16) AS event_id, CAST(event_id AS VARCHAR) AS source_id, CASE event_type WHEN 'error' THEN 'furto' ELSE 'roubo_veiculo' END AS crime_type,
 CAST(json_extract(props,'$.k') AS INT) AS agents FROM events WHERE event_type IN ('error', 'signup')""")
def _(spark, d):
    return _responses(spark, d)[0].select("event_id", F.col("source.source_id").alias("source_id"), "crime_type", F.col("agent_count_total").alias("agents"))


@query("responses_rejected", "SELECT CAST(event_id AS VARCHAR) AS source_id FROM events WHERE event_type NOT IN ('error', 'signup')")
def _(spark, d):
    return _responses(spark, d)[1].select("source_id")


@query("apply_verdicts", """SELECT p.id, l.toxic = 0 AND l.quality = 1 AS is_relevant FROM posts p JOIN labels l ON l.doc_id = p.conv_id WHERE p.conv_id % 10 <> 0""", "posts")
def _(spark, d):
    lab = B.table(spark, d, "labels")
    verdicts = lab.select(F.col("doc_id").alias("conv_id"), (F.col("toxic") == 0).alias("in_city"), F.when(F.col("quality") == 1, "furto").otherwise("irrelevante").alias("category"))
    posts = B.posts(spark, d)
    known = posts.filter(F.col("conv_id") % 10 == 0)
    return E.apply_verdicts(posts, verdicts, "conv_id", known).select("id", "is_relevant")


@query("relevance_rule", "SELECT doc_id, toxic = 0 AND quality = 1 AS is_relevant FROM labels")
def _(spark, d):
    cat = F.when(F.col("quality") == 1, "roubo").otherwise("outros")
    return B.table(spark, d, "labels").select("doc_id", E.relevance_rule(F.col("toxic") == 0, cat).alias("is_relevant"))


@query("run_all_sources", "SELECT 'incidents' AS source_name, COUNT(*) AS n FROM events UNION ALL SELECT 'tips', COUNT(*) FROM documents")
def _(spark, d):
    return E.run_all_sources({"incidents": _incident_events(spark, d), "tips": _tip_events(spark, d)})[1]


@query("query_events", """SELECT lpad(CAST(event_id AS VARCHAR),12,'0') AS event_id, strftime(ts,'%Y-%m-%d') AS date_iso FROM events WHERE user_id % 12 <> 0 AND contains(lower('Area ' || (user_id % 12)), 'area 1') AND user_id % 5 <> 0
 AND contains(lower('Rua ' || (user_id % 15)), 'rua 1') ORDER BY 2 DESC, 1 LIMIT 25""")
def _(spark, d):
    return Q.query_events(E.event_summaries(B.nested_events(spark, d)), "Area 1", contains="RUA 1").select("event_id", "date_iso")

