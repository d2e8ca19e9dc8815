"""File scans, sinks and streams on small written fixtures."""

import datetime as dt
import json

from pyspark.sql import functions as F

from geoevents.operators import extraction, severity, spatial
from geoevents.sources import polygons, scans, sinks
from geoevents.streaming import store

BOX = [[[-43.3, -22.95], [-43.2, -22.95], [-43.2, -22.9], [-43.3, -22.9], [-43.3, -22.95]]]


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def geojson(tmp_path):
    feats = [
        {"type": "Feature", "properties": {"fid": 2, "nome": "Área A"}, "geometry": {"type": "Polygon", "coordinates": BOX}},
        {"type": "Feature", "properties": {"fid": 3, "nome": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [
            [[[-43.5, -22.9], [-43.4, -22.9], [-43.4, -22.8], [-43.5, -22.8]]]]}},
        {"type": "Feature", "properties": {"fid": 4, "nome": "bad"}, "geometry": None},
        {"type": "Feature", "properties": {"fid": 5, "nome": "pt"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    return write(tmp_path / "z.geojson", json.dumps({"type": "FeatureCollection", "features": feats}))


def test_zones_and_export(spark, tmp_path):
    zones, edges = polygons.scan_zones(spark, geojson(tmp_path), "nome", "fid int, nome string")
    assert sorted(r.zone_id for r in zones.collect()) == ["B", "Área A"]
    assert {r.zone_id: r.n for r in edges.groupBy("zone_id").agg(F.count("*").alias("n")).collect()} == {"Área A": 4, "B": 4}
    pts = spark.createDataFrame([(1, -22.92, -43.25), (2, -22.85, -43.45), (3, -22.7, -43.1), (4, None, None)], "id int, lat double, lon double")
    got = {r.id: r.zone_id for r in spatial.join_points_to_zones(pts, spatial.zone_index(edges, zones)).collect()}
    assert got == {1: "Área A", 2: "B", 3: None, 4: None}
    metrics = zones.select("zone_id", F.lit(7).alias("score"))
    out = [json.loads(r.feature) for r in sinks.export_zone_metrics_geojson(metrics, edges, ["zone_id", "score"]).collect()]
    assert all(f["properties"]["score"] == 7 and f["geometry"]["coordinates"][0][0][0] == f["geometry"]["coordinates"][0][0][-1] for f in out)


def test_missing_layer_is_empty(spark, tmp_path):
    zones, edges = polygons.scan_zones_or_empty(spark, str(tmp_path / "none.geojson"), "nome", "fid int, nome string")
    assert zones.count() == 0 and edges.count() == 0


def test_wkt(spark):
    df = spark.createDataFrame([(1, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), (2, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"), (3, "x")], "id int, w string")
    got = {r.zone_id: r.n for r in polygons.wkt_edges(df, "id", "w").groupBy("zone_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"1": 4, "2": 6}


def test_streets(spark, tmp_path):
    fc = {"features": [{"properties": {"completo": "Rua São João", "bairro": "X"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1], [2, 1]]}}]}
    rows = polygons.scan_streets(spark, write(tmp_path / "s.geojson", json.dumps(fc)), "completo", "completo string, bairro string").collect()
    assert len(rows) == 2 and {r.street_norm for r in rows} == {"rua sao joao"}


def test_tips_csv_latin1_comma(spark, tmp_path):
    head = "id_denuncia;numero_denuncia;data_denuncia;classe;tipo;latitude;longitude;logradouro;numero_logradouro;bairro_logradouro;relato_redacted;envolvidos.sexo;envolvidos.idade;envolvidos.pele;envolvidos.estatura;envolvidos.porte;envolvidos.outras_caracteristicas"
    rows = ["1;n;6/4/2020 8:16:00;c;ROUBO A MOTORISTAS;-22,9;-43,2;Praça é;1; Leblon ;texto;;;;;;", "2;n;;c;furto;;;R;1;b;;;;;;;", "3;n;;c;OUTRO;-22,9;-43,2;R;1;b;;;;;;;",
            "4;n;;c;CONSUMO DE DROGAS;-22,9;-43,2;R;1;b;;;;;;;"]
    path = write(tmp_path / "t.csv", "\n".join([head, *rows]), "latin-1")
    geo, nogeo = scans.scan_tips(spark, path)
    g, = geo.collect()
    assert (g.id_denuncia, g.lat, g.logradouro, g.bairro_norm, g.day) == ("1", -22.9, "Praça é", "LEBLON", dt.date(2020, 6, 4))
    assert [r.id_denuncia for r in nogeo.collect()] == ["2"]
    assert [r.id_denuncia for r in scans.scan_tips_by_type(spark, path).collect()] == ["4"]
    assert scans.scan_tips_all_geo(spark, path).count() == 3


def test_other_csv(spark, tmp_path):
    f = write(tmp_path / "f.csv", "coordenada_x,coordenada_y,tipo_ocorrencia_descricao,tipo_ocorrencia_ativo,orgao_responsavel,logradouro,bairro_nome\n"
              "-22.9,-43.2,Lixo,True,COMLURB,R,b\n-22.9,-43.2,Sem ocorrência,true,X,R,b\n-22.9,-43.2,Lixo,false,X,R,b\n0,0,Lixo,true,X,R,b\n")
    assert scans.scan_factors(spark, f).count() == 3 and scans.scan_factors(spark, f, active_only=True).count() == 1
    c = write(tmp_path / "c.csv", 'nome_area_fm,geometry\nA,POINT (-43.2 -22.9)\nB,bad\n')
    assert [(r.lat, r.lon) for r in scans.scan_cameras(spark, c).collect()] == [(-22.9, -43.2)]
    i = write(tmp_path / "i.csv", "id,latitude,longitude,data_parsed,hora_original,dia_semana,delito_descricao,locf,aisp,risp\n"
              "1,-22.9,-43.2,2024-02-03,14:30,Sab,Furto,Avenida Avenida X,23.0,1\n2,-22.9,-43.2,,x,Sab,Furto,,,\n3,0,0,,,,,,,\n")
    got = {r.id: (r.data, r.hour, r.street, r.aisp) for r in scans.scan_incidents(spark, i).collect()}
    assert got == {"1": ("03/02/2024", 14, "avenida x", 23), "2": (None, None, "", None)}
    k = write(tmp_path / "k.csv", "id_chamado,data_inicio,data_fim,id_bairro,nome_unidade_organizacional,tipo,subtipo,tipo_situacao,dentro_prazo,latitude,longitude,data_particao\n"
              "9,2024-01-02 10:00:00,bad,7.0,RIOLUZ,Luz,s,Atendido,Vencido,-22.9,,2024-01-01\n")
    call, = scans.scan_service_calls(spark, k, partitions=2).collect()
    assert call.id_bairro == 7 and call.data_fim is None and call.lon is None and call.data_particao == dt.datetime(2024, 1, 1)


def test_reports_and_jsonl(spark, tmp_path):
    rep = [{"filename": "x RI_014 y.docx", "full_text": " ", "sections": ["T1", "b1", "T2"]}, {"filename": "nope", "sections": []}]
    row, = scans.scan_reports_json(spark, write(tmp_path / "r.json", json.dumps(rep))).collect()
    assert row.area == "Rio Sul" and [tuple(s) for s in row.sections] == [("T1", "b1"), ("T2", "")] and row.full_text == "## T1\nb1\n\n## T2\n"
    ev = write(tmp_path / "e.jsonl", '{"event_id": "a", "weapons": [], "victims": null}\nbroken\n\n')
    good, bad = scans.read_jsonl(spark, ev, extraction.EVENT_SCHEMA)
    assert good.count() == 1 and bad.count() == 1
    e = scans.scan_events_jsonl(spark, ev).first()
    assert e.weapons == [] and e.victims is None
    out = str(tmp_path / "out")
    sinks.sink_json(scans.scan_events_jsonl(spark, ev), out)
    back = scans.scan_events_jsonl(spark, out).first()
    assert back.weapons == [] and back.victims is None
    posts = write(tmp_path / "p.jsonl", '{"tweet_id":"1","text":"assalto na rua","is_retweet":false,"relevance":{"is_relevant":true,"confidence":0.4}}\n'
                  '{"tweet_id":"4","text":"\\n\\t","is_retweet":false}\n{"tweet_id":"2","text":"assalto","is_retweet":true}\n{"tweet_id":"3","text":"bom dia"}\n')
    assert [r.tweet_id for r in scans.scan_posts_jsonl(spark, posts).collect()] == ["1"]
    assert scans.scan_classified_posts(spark, posts).count() == 0
    act = write(tmp_path / "a.jsonl", '{"action_id":"1","area_fm":"A","observed_event_id_deltas":{"x":2}}\n')
    assert scans.scan_actions_jsonl(spark, act).first().observed_event_id_deltas == {"x": 2}


def test_append_dedupe_stream(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    schema = "id int, ts timestamp, v string"
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a"), (2, dt.datetime(2024, 1, 1), "b"), (1, dt.datetime(2024, 1, 1), "c")], schema).write.parquet(src)

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        store.append_dedupe(stream, out, chk, id_col="id", ts_col="ts").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert run() == [1, 2]
    spark.createDataFrame([(2, dt.datetime(2024, 1, 9), "d"), (3, dt.datetime(2024, 1, 9), "e")], schema).write.mode("append").parquet(src)
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]                      # nothing new: no change
    last = spark.read.parquet(out).filter("id = 3").first().batch
    store.append_unseen(spark.read.parquet(src).filter("id > 1 and v > 'c'"), last, out, "id", "ts")   # the same batch again
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    spark.createDataFrame([(4, dt.datetime(2020, 1, 1), "late"), (4, dt.datetime(2019, 1, 1), "first")], schema).write.mode("append").parquet(src)
    assert run() == [1, 2, 3, 4]                   # an unseen id is kept however late it is
    assert spark.read.parquet(out).filter("id = 4").first().v == "first"


def test_upsert_stream(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("id int, version int, v string")
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (3, 1, "d")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        store.upsert_latest(stream, out, chk).trigger(availableNow=True).start().awaitTermination()
    got = {r.id: r.v for r in store.read_latest(spark, out, T.StructType.fromDDL("id int, version int, v string"), id_col="id", version="version").collect()}
    assert got == {1: "c", 2: "b", 3: "d"}


def test_streamed_zone_counts_and_rolling(spark, tmp_path):
    _zones, edges = polygons.scan_zones(spark, geojson(tmp_path), "nome", "fid int, nome string")
    src = str(tmp_path / "pts")
    schema = "ts timestamp, lat double, lon double, zone string, s_event double"
    rows = [(dt.datetime(2024, 1, 1, h), -22.92, -43.25, "a", 2.0) for h in (1, 1, 2)] + [(dt.datetime(2024, 3, 1), -22.92, -43.25, "a", 1.0)]
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    for name, df in (("zc", store.stream_zone_counts(stream, spatial.zone_index(edges))), ("rs", store.rolling_score(stream, ["zone"], days=2))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("zc").collect())[:2] == [1, 2]
    assert {r.s_sum for r in spark.table("rs").collect()} >= {6.0}


def test_score_report_end_to_end(spark):
    df = spark.createDataFrame([(i, 10) for i in range(6)], "id int, h int")
    ev = extraction.make_events(df, {
        "event_id": F.col("id").cast("string"), "crime_type": F.lit("furto"), "temporal.hour_24": F.col("h"),
        "temporal.date_iso": F.lit("2024-05-05"), "spatial.area_fm": F.lit("A"), "spatial.logradouro": F.lit("Rua X"),
        "environment.camera_present": F.lit(False), "source.kind": F.lit("tweet")})
    areas, streets = severity.score_report(ev)
    a = areas.first()
    assert (a.n, a.w_src, round(a.gini, 9)) == (6, 0.85, round(23 / 24, 9)) and {r.code for r in a.reasons} >= {"agg.pattern", "src.single", "env.camera_blind"}
    assert streets.first().street == "Rua X" and a.m_env == 1.2


def test_document_writers(spark, tmp_path):
    """Every writer gives one JSON line per row, NULL apart from [], and can be written twice."""
    import json
    from pathlib import Path

    from geoevents.sources import sinks

    def lines(path):
        return sorted((json.loads(x) for f in Path(path).rglob("*.json") for x in f.read_text().splitlines()), key=str)

    docs = spark.createDataFrame([("Z1", 1.5, None, []), ("Z2", None, [{"a": 1}], None)], "zone_id string, score double, gaps array<struct<a:int>>, x array<string>")
    for write, name in ((sinks.sink_area_documents, "areas"), (sinks.sink_city_context, "city"), (sinks.sink_score_report, "scores"), (sinks.sink_fleet_plan, "fleet")):
        for _ in range(2):
            write(docs, str(tmp_path / name))
        assert lines(tmp_path / name) == [{"zone_id": "Z1", "score": 1.5, "gaps": None, "x": []}, {"zone_id": "Z2", "score": None, "gaps": [{"a": 1}], "x": None}]
    sinks.sink_area_documents(docs, str(tmp_path / "runs"), run_id="r1")
    sinks.sink_area_documents(docs, str(tmp_path / "runs"), run_id="r2")
    sinks.sink_area_documents(docs, str(tmp_path / "runs"), run_id="r2")
    assert len(lines(tmp_path / "runs")) == 4
    rings = spark.createDataFrame([("Z1", "inconclusivo", "baixa", 1.0, None, "geometry")], "zone_id string, label string, confidence string, area_yoy_pct double, ring_yoy_pct double, geometry string")
    sinks.sink_displacement_summary(rings, str(tmp_path / "d"))
    assert lines(tmp_path / "d") == [{"zone_id": "Z1", "label": "inconclusivo", "confidence": "baixa", "area_yoy_pct": 1.0, "ring_yoy_pct": None}]


def test_city_context_parts(spark, tmp_path):
    """A zone with one year, one without anything; an incident without a day counts in the ring and in no year."""
    from geoevents.operators.spatial import zone_index
    from geoevents.plans.city_context import city_context
    from geoevents.sources.sinks import sink_context_parts

    box = lambda z, x: [(z, 0, 0, i, *a, *b) for i, (a, b) in enumerate(zip(
        [(x, -22.90), (x + 0.01, -22.90), (x + 0.01, -22.89), (x, -22.89)], [(x + 0.01, -22.90), (x + 0.01, -22.89), (x, -22.89), (x, -22.90)]))]
    edges = spark.createDataFrame(box("a", -43.20) + box("b", -43.50),
                                  "zone_id string, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    rows = [(1, -22.895, -43.195, "2024-01-02"), (2, -22.895, -43.195, None), (3, -22.895, -43.2002, "2023-05-01"), (4, -22.895, -43.2002, None),
            (5, -22.895, -43.30, "2024-01-01")]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, day string").selectExpr(
        "id", "lat", "lon", "cast(day as date) day", "'x' offence", "1 hour")
    tips = spark.createDataFrame([(7, -22.895, -43.1899, "k")], "id long, lat double, lon double, kind string")
    series = spark.createDataFrame([(3, 2024, 1), (3, 2020, 9), (None, 2024, 5), (4, 2023, 2)], "aisp int, ano int, hom_doloso int")
    land = spark.createDataFrame([("a", None, "hill")], "zone_id string, faction string, name string")
    parts = city_context(points, tips, edges, zone_index(edges), series, (land, edges))
    sink_context_parts(parts, str(tmp_path / "city"))
    read = {k: spark.read.json(str(tmp_path / "city" / k)).collect() for k in parts}
    by = {r.zone_id: r for r in read["rings"]}
    assert [(y.year, y.n) for y in by["a"].area_years] == [(2024, 1)] and [(y.year, y.n) for y in by["a"].ring_years] == [(2023, 1)]
    assert (by["a"].crimes_in_ring, by["a"].tips_in_ring, by["a"].label, by["a"].confidence) == (2, 1, "inconclusivo", "baixa")
    assert (by["b"].crimes_in_ring, by["b"].tips_in_ring, by["b"].area_years, by["b"].label) == (0, 0, [], "inconclusivo")
    meta = read["meta"][0]
    assert (meta.n_incidents, meta.n_incident_points, meta.n_tip_points, meta.n_territories, meta.n_districts) == (5, 5, 1, 1, len(read["districts"]))
    assert '"faction":"—"' in read["territories"][0].feature


def test_csv_columns_are_found_by_name(spark, tmp_path):
    """Other order, columns in between, a missing column, a value of the wrong type."""
    series = write(tmp_path / "isp.csv", "munic,ano,mes,aisp,regiao,hom_doloso,cisp,total_roubos\nRio,2024,1,17,Sul,3,x,40\nRio,2023,2,18,Sul,,5,7\n")
    rows = scans.scan_district_series(spark, series).collect()
    assert [(r.ano, r.aisp, r.cisp, r.hom_doloso, r.total_roubos, r.trafico_drogas) for r in rows] == [
        (2024, 17, None, "3", "40", None), (2023, 18, 5, None, "7", None)]
    people = write(tmp_path / "p.csv", "sexo,longitude,x,latitude,id,classificacao_idade\nF,-43.2,1,-22.9,a,adulto\nM,0,1,0,b,idoso\n")
    assert [(r.id, r.sexo, r.lat, r.lon, r.idade_classe) for r in scans.scan_street_census(spark, people).collect()] == [("a", "F", -22.9, -43.2, "adulto")]


def test_territories_in_range(spark, tmp_path):
    zones, edges = polygons.scan_territories(spark, geojson(tmp_path), "nome", "fid int, nome string", x_range=(-43.35, -43.0))
    assert [r.zone_id for r in zones.collect()] == ["Área A"] and edges.count() == 4
