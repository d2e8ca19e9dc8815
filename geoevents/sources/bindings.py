"""The supplied star-schema tables in the roles of the engine's sources.

The tables are not geographic; coordinates and texts are derived with integer arithmetic, so
every row has a place that any SQL engine can repeat exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoevents.functions import geo as G
from geoevents.functions import text as X
from geoevents.sources.polygons import edges_from_ring_array

AGENCIES = ["COMLURB - Companhia Municipal de Limpeza Urbana", "RIOLUZ", "Rio Luz", "SEOP", "CET-Rio", "Outra", "01A GC", "CAS Centro"]
OFFENCES = {
    "click": "Roubo a transeunte", "view": "Roubo de aparelho celular", "purchase": "Roubo em coletivo",
    "error": "Furto", "signup": "Roubo de veículo",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: str, a: int, b: int, missing: Column | None = None) -> dict[str, Column]:
    """lat/lon from an integer key; NULL where ``missing`` holds."""
    k = F.col(key)
    lat = F.lit(-23.2) + (k * a % 50000) / F.lit(100000.0)
    lon = F.lit(-43.9) + (k * b % 90000) / F.lit(100000.0)
    if missing is not None:
        lat, lon = F.when(~missing, lat), F.when(~missing, lon)
    return {"lat": lat, "lon": lon}


def _pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    locf = F.when(u % 31 != 0, F.concat(F.lit("Avenida Avenida São "), (u % 40).cast("string")))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts"), F.col("ts").cast("date").alias("day"),
        F.when(F.col("event_id") % 17 != 0, F.hour("ts")).alias("hour"),
        (F.dayofweek("ts") - 1).alias("weekday"), X.lookup(F.col("event_type"), OFFENCES).alias("offence"),
        locf.alias("locf"), X.dedupe_prefix(locf).alias("street_raw"), X.norm_street(X.dedupe_prefix(locf)).alias("street"),
        (u % 41).cast("int").alias("aisp"), (u % 7).cast("int").alias("risp"), u.alias("user_id"),
        F.col("value"), *[c.alias(n) for n, c in place("event_id", 7919, 104729).items()],
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), _pick(AGENCIES, brand % 8).alias("agency"),
        F.concat(F.lit("avenida sao "), (F.col("p_partkey") % 60).cast("string")).alias("street"),
        *[c.alias(n) for n, c in place("p_partkey", 6271, 15485863, F.col("p_size") % 10 == 0).items()],
    )


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("id"), F.col("text"), F.col("source"), F.col("lang"),
        _pick(["ROUBO/FURTO A TRANSEUNTES", "CONSUMO DE DROGAS", "Furto de veiculo"], k % 3).alias("kind"),
        F.concat(F.lit("avenida sao "), (k % 80).cast("string")).alias("street"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int")).alias("day"),
        *[c.alias(n) for n, c in place("doc_id", 7907, 104723, k % 4 == 0).items()],
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("camera_id"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("area_name"),
        *[c.alias(n) for n, c in place("s_suppkey", 4999, 9973).items()],
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = X.lookup(F.col("o_orderstatus"), {"O": "Atendido", "P": "Não atendido", "F": "Atendido parcialmente"})
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.col("o_orderdate").cast("date").alias("day"),
        status.alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "Vencido").otherwise("No prazo").alias("due"),
        F.col("o_orderpriority").alias("kind"), _pick(AGENCIES, F.col("o_custkey") % 8).alias("agency"),
        F.concat(F.lit("avenida sao "), (F.col("o_orderkey") % 50).cast("string")).alias("street"),
        (F.col("o_custkey") % 25).cast("int").alias("neighbourhood"),
        *[c.alias(n) for n, c in place("o_orderkey", 7691, 99991, F.col("o_orderkey") % 5 == 0).items()],
    )


def street_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), *[c.alias(n) for n, c in place("c_custkey", 8101, 99989).items()])


def _origin() -> tuple[Column, Column]:
    k = F.col("n_nationkey")
    return F.lit(-43.9) + (k % 5) * F.lit(0.18), F.lit(-23.2) + F.floor(k / 5) * F.lit(0.1)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("Z"), F.col("n_nationkey").cast("string")).alias("zone_id"), F.col("n_name").alias("name"),
        F.col("n_nationkey").alias("zone_order"), F.col("n_regionkey").alias("region_key"))


def _ring(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in [*points, points[0]]])


def zone_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped zones, overlapping their right-hand neighbour."""
    ox, oy = _origin()
    n = table(spark, sf_dir, "nation").select("n_nationkey", ox.alias("ox"), oy.alias("oy"))
    x, y = F.col("ox"), F.col("oy")
    ring = _ring([
        (x, y), (x + F.lit(0.2), y), (x + F.lit(0.2), y + F.lit(0.04)), (x + F.lit(0.1), y + F.lit(0.04)),
        (x + F.lit(0.1), y + F.lit(0.09)), (x, y + F.lit(0.09))])
    n = n.select(F.concat(F.lit("Z"), F.col("n_nationkey").cast("string")).alias("zone_id"), ring.alias("ring"))
    return edges_from_ring_array(n, "zone_id", "ring")


def neighbourhood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles shifted against the zones."""
    ox, oy = _origin()
    n = table(spark, sf_dir, "nation").select("n_nationkey", ox.alias("ox"), oy.alias("oy"))
    x0, x1 = F.col("ox") + F.lit(0.05), F.col("ox") + F.lit(0.23)
    y0, y1 = F.col("oy") + F.lit(0.03), F.col("oy") + F.lit(0.12)
    n = n.select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("zone_id"),
        _ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]).alias("ring"))
    return edges_from_ring_array(n, "zone_id", "ring")


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhood census from customers per nation."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        (F.count(F.lit(1)) * 100).alias("pop_2022"), (F.count_if(F.col("c_acctbal") > 1000) * 110).alias("pop_2010"),
        (F.count_if(F.col("c_mktsegment") == "BUILDING") * 30).alias("dwellings"))
    n = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return n.join(people, "n_nationkey", "left").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("zone_id"), F.col("n_name").alias("name"),
        F.col("r_name").alias("region"), "pop_2022", "pop_2010", "dwellings", F.col("n_nationkey").alias("neighbourhood"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with an intelligence report."""
    return table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 3 == 0).select(
        F.concat(F.lit("Z"), F.col("n_nationkey").cast("string")).alias("zone_id"))


def scaled(edges: DataFrame, factor: float = 100000.0) -> DataFrame:
    """Degree edges in units of 1e-5 degrees (a plane with whole-number corners)."""
    return edges.withColumns({c: F.round(F.col(c) * F.lit(factor)) for c in ("x1", "y1", "x2", "y2")})


def metric_edges(edges: DataFrame) -> DataFrame:
    x1, y1 = G.project_utm(F.col("y1"), F.col("x1"))
    x2, y2 = G.project_utm(F.col("y2"), F.col("x2"))
    return edges.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as posts of an account."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("account"),
        F.concat("text", F.when(F.col("conv_id") % 3 == 0, " houve assalto").otherwise("")).alias("text"),
        (F.col("turn") % 7 == 6).alias("is_retweet"), F.col("conv_id"), F.col("turn"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 60).cast("int")).alias("day"))


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested events from the event table: every part varies with the key."""
    from geoevents.operators.extraction import make_events

    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    pick = lambda names, mod: _pick(names, mod % len(names))
    one = lambda cond, s: F.when(cond, F.array(s)).otherwise(F.array())
    types = ["roubo_transeunte", "furto", "roubo_veiculo", "desconhecido", "roubo_carga", "golpe_fraude", "inexistente"]
    weapon = F.struct(
        pick(["arma_fogo", "arma_branca", "simulacro", "forca_fisica"], k).alias("type"), (k % 3 != 0).alias("brandished"),
        (k % 5 == 0).alias("used"), F.lit(None).cast("string").alias("description_text"))
    victim = F.struct(
        F.lit(None).cast("string").alias("gender"), pick(["idoso", "adulto", "adolescente", "crianca"], k).alias("age_bracket"),
        F.lit(None).cast("int").alias("age_estimated"), F.when(k % 4 != 3, k % 2 == 0).alias("exposed_item_before"),
        F.lit(None).cast("string").alias("item_exposed_text"), F.lit(None).cast("string").alias("reaction"),
        (k % 9 == 0).alias("injured"), (k % 101 == 0).alias("killed"), F.lit(None).cast("string").alias("occupation_text"))
    item = F.struct(
        pick(["celular", "carro", "documentos", "chaves"], k).alias("type"), (k % 3).cast("int").alias("quantity"),
        F.lit(None).cast("string").alias("description_text"), F.lit(None).cast("boolean").alias("recovered"))
    tags = ["iluminacao_deficiente", "vegetacao_cobrindo_iluminacao", "comercio_irregular", "ponto_retencao_trafego"]
    return make_events(e, {
        "event_id": F.lpad(k.cast("string"), 12, "0"), "crime_type": pick(types, k),
        "temporal.date_iso": F.date_format("ts", "yyyy-MM-dd"), "temporal.hour_24": F.when(k % 17 != 0, F.hour("ts")),
        "spatial.area_fm": F.when(F.col("user_id") % 12 != 0, F.concat(F.lit("Area "), (F.col("user_id") % 12).cast("string"))),
        "spatial.logradouro": F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("Rua "), (F.col("user_id") % 15).cast("string"))),
        "environment.urban_factors": F.when(k % 6 != 0, F.array(pick(tags, k), pick(tags, k + 1))),
        "environment.lighting": F.when(k % 2 == 0, "adequada").otherwise("deficiente"),
        "environment.patrol_presence": F.when(F.col("user_id") % 12 < 4, "recem_retirada").otherwise("ausente"),
        "environment.camera_present": F.when(k % 3 == 0, F.col("user_id") % 12 < 6),
        "agent_count_total": (k % 4).cast("int"), "victims": one(k % 2 == 0, victim), "weapons": one(k % 3 != 2, weapon),
        "stolen_items": one(k % 4 != 1, item),
        "approach.type": pick(["cerco", "desconhecida", "arrastao"], k), "escape.type": pick(["pulou_muro", "desconhecida"], k),
        "modus_operandi.tactics": F.when(k % 7 != 0, F.array(pick(["ameaca_verbal", "facada", "perseguicao"], k), pick(["outro", "coronhada"], k))),
        "outcome.status": pick(["consumado", "tentativa_fracassada", "desconhecido"], k),
        "source.kind": pick(["ocorrencia_oficial", "disque_denuncia", "tweet"], F.col("user_id")),
    })
