"""Typed scans of the tabular, JSON-lines and report sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoevents.functions import fixed_values as V
from geoevents.functions import temporal as D
from geoevents.functions import text as X

INCIDENT_SCHEMA = (
    "id string, latitude double, longitude double, data_parsed string, hora_original string, "
    "dia_semana string, delito_descricao string, locf string, aisp string, risp string"
)
TIP_SCHEMA = (
    "id_denuncia string, numero_denuncia string, data_denuncia string, classe string, tipo string, "
    "latitude string, longitude string, logradouro string, numero_logradouro string, "
    "bairro_logradouro string, relato_redacted string, `envolvidos.sexo` string, "
    "`envolvidos.idade` string, `envolvidos.pele` string, `envolvidos.estatura` string, "
    "`envolvidos.porte` string, `envolvidos.outras_caracteristicas` string"
)
FACTOR_SCHEMA = (
    "coordenada_x double, coordenada_y double, tipo_ocorrencia_descricao string, "
    "tipo_ocorrencia_ativo string, orgao_responsavel string, logradouro string, bairro_nome string"
)
CAMERA_SCHEMA = "nome_area_fm string, geometry string"
STREET_CENSUS_SCHEMA = "id string, latitude double, longitude double, classificacao_idade string, sexo string"
CALL_SCHEMA = (
    "id_chamado string, data_inicio string, data_fim string, id_bairro string, "
    "nome_unidade_organizacional string, tipo string, subtipo string, tipo_situacao string, "
    "dentro_prazo string, latitude string, longitude string, data_particao string"
)
DISTRICT_SCHEMA = (
    "cisp int, aisp int, ano int, mes int, hom_doloso string, letalidade_violenta string, "
    "total_roubos string, roubo_transeunte string, roubo_celular string, "
    "roubo_em_coletivo string, trafico_drogas string, total_furtos string"
)
POST_SCHEMA = (
    "tweet_id string, author_username string, account string, created_at string, text string, "
    "is_retweet boolean, hashtags array<string>, mentioned_users array<string>, "
    "urls array<string>, retweet_count int, favorite_count int, source_url string, "
    "relevance struct<is_rio_de_janeiro:boolean,category:string,is_relevant:boolean,"
    "confidence:double>"
)
ARTICLE_SCHEMA = (
    "article_id string, url string, domain string, published_at string, fetched_at string, "
    "title string, subtitle string, body_text string, author string, section string, "
    "tags array<string>"
)
ACTION_SCHEMA = (
    "action_id string, area_fm string, logradouro string, action_type string, "
    "started_at string, ended_at string, agents int, urgency string, "
    "observed_event_id_deltas map<string,int>"
)
REPORT_SCHEMA = "filename string, full_text string, sections array<string>"


def in_bbox(lat: Column, lon: Column, bbox=V.CITY_BBOX) -> Column:
    """Inclusive box test; NULL coordinates are outside."""
    inside = lat.between(bbox[0], bbox[1]) & lon.between(bbox[2], bbox[3])
    return F.coalesce(inside, F.lit(False))


def _read(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """The schema's columns, found by name: Parquet when the path says so, else CSV with a header line (gzip is read as is).
    Other columns and another order do no harm; a missing column, or a value that is not of its type, is NULL."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    for key, value in options.items():
        reader = reader.option(key, value)
    raw = reader.csv(path)
    held = set(raw.columns)
    wanted = T.StructType.fromDDL(schema)
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in held else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in wanted])


def scan_incidents(spark: SparkSession, path: str, *, bbox=V.CITY_BBOX) -> DataFrame:
    """Incidents in the box: offence, hour number, day, street normal form, districts."""
    raw = _read(spark, path, INCIDENT_SCHEMA)
    day = F.coalesce(F.try_to_date(F.left(F.col("data_parsed"), F.lit(10)), "yyyy-MM-dd"),
                     D.parse_date_multi(F.col("data_parsed")))
    return raw.filter(in_bbox(F.col("latitude"), F.col("longitude"), bbox)).select(
        "id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        F.date_format(day, "dd/MM/yyyy").alias("data"), day.alias("day"),
        F.coalesce("hora_original", F.lit("")).alias("hora"),
        D.parse_hour(F.col("hora_original")).alias("hour"), "dia_semana",
        F.col("delito_descricao").alias("offence"), "locf",
        X.dedupe_prefix(F.col("locf")).alias("street"),
        D.safe_int(F.col("aisp")).alias("aisp"), D.safe_int(F.col("risp")).alias("risp"),
    )


def _tips_raw(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path, TIP_SCHEMA, sep=";", encoding="ISO-8859-1")
    renamed = raw.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in raw.columns])
    return renamed.withColumns({
        "lat": D.comma_decimal(F.col("latitude")),
        "lon": D.comma_decimal(F.col("longitude")),
        "bairro_norm": F.trim(F.upper(F.coalesce("bairro_logradouro", F.lit("")))),
        "day": D.parse_tip_date(F.col("data_denuncia")),
    }).drop("latitude", "longitude")


def scan_tips(
    spark: SparkSession, path: str, *, pattern: str = "ROUBO|FURTO", bbox=V.CITY_BBOX
) -> tuple[DataFrame, DataFrame]:
    """(with usable coordinates, without) for tips whose type matches the pattern."""
    tips = _tips_raw(spark, path).filter(X.type_regex(F.col("tipo"), pattern))
    ok = in_bbox(F.col("lat"), F.col("lon"), bbox)
    return tips.filter(ok), tips.filter(~ok)


def scan_tips_by_type(
    spark: SparkSession, path: str, pattern: str = "CONSUMO DE DROGAS", *, bbox=V.CITY_BBOX
) -> DataFrame:
    return scan_tips(spark, path, pattern=pattern, bbox=bbox)[0]


def scan_tips_all_geo(spark: SparkSession, path: str, *, bbox=V.CITY_BBOX) -> DataFrame:
    return _tips_raw(spark, path).filter(in_bbox(F.col("lat"), F.col("lon"), bbox))


def scan_factors(
    spark: SparkSession, path: str, *, bbox=V.CITY_BBOX, active_only: bool = False
) -> DataFrame:
    """Street conditions; the source swaps its axes (x holds the latitude)."""
    df = _read(spark, path, FACTOR_SCHEMA).withColumnsRenamed(
        {"coordenada_x": "lat", "coordenada_y": "lon"}
    )
    df = df.filter(in_bbox(F.col("lat"), F.col("lon"), bbox))
    if active_only:
        kind = F.col("tipo_ocorrencia_descricao")
        df = df.filter(F.lower(F.trim("tipo_ocorrencia_ativo")) == "true").filter(
            kind.isNotNull() & ~kind.contains("Sem ocorrência")
        )
    return df


def wkt_point(c: Column) -> tuple[Column, Column]:
    """(lat, lon) of 'POINT (lon lat)'."""
    pattern = r"POINT \((-?[\d.]+)\s+(-?[\d.]+)\)"
    return (
        F.regexp_extract(c, pattern, 2).try_cast("double"),
        F.regexp_extract(c, pattern, 1).try_cast("double"),
    )


def scan_cameras(spark: SparkSession, path: str, *, bbox=V.CITY_BBOX) -> DataFrame:
    lat, lon = wkt_point(F.col("geometry"))
    df = _read(spark, path, CAMERA_SCHEMA).withColumns({"lat": lat, "lon": lon})
    return df.filter(in_bbox(F.col("lat"), F.col("lon"), bbox))


def scan_street_census(spark: SparkSession, path: str, *, bbox=V.CITY_BBOX) -> DataFrame:
    df = _read(spark, path, STREET_CENSUS_SCHEMA).withColumnsRenamed(
        {"latitude": "lat", "longitude": "lon", "classificacao_idade": "idade_classe"}
    )
    return df.filter(in_bbox(F.col("lat"), F.col("lon"), bbox))


def scan_service_calls(spark: SparkSession, path: str, *, partitions: int | None = None) -> DataFrame:
    """Service calls with three tolerant dates. One gzip file is one task: give
    ``partitions`` to spread its rows after the read."""
    df = _read(spark, path, CALL_SCHEMA)
    if partitions:
        df = df.repartition(partitions)
    dates = ["data_inicio", "data_fim", "data_particao"]
    return df.withColumns({
        **{c: F.try_to_timestamp(F.col(c)) for c in dates},
        "lat": D.safe_float(F.col("latitude")), "lon": D.safe_float(F.col("longitude")),
        "id_bairro": D.safe_int(F.col("id_bairro")),
    }).drop("latitude", "longitude")


def scan_district_series(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, DISTRICT_SCHEMA)


def pair_sections(sections: Column) -> Column:
    """[title, body, title, body, …] -> structs; an odd last title keeps an empty body."""
    n = F.size(sections)
    steps = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        steps,
        lambda i: F.struct(
            F.element_at(sections, i).alias("titulo"),
            F.coalesce(F.try_element_at(sections, i + 1), F.lit("")).alias("texto"),
        ),
    )


def report_fields(df: DataFrame) -> DataFrame:
    """``(area, full_text, sections)`` from file name, text and the flat section list."""
    code = F.concat(F.lit("RI_"), F.regexp_extract("filename", r"(?i)RI_(\d{3})", 1))
    paired = df.withColumns({
        "area": X.lookup(code, V.REPORT_AREAS),
        "sections": pair_sections(F.coalesce("sections", F.array().cast("array<string>"))),
    }).filter(F.col("area").isNotNull())
    rebuilt = F.array_join(
        F.transform(
            "sections",
            lambda s: F.concat(F.lit("## "), s["titulo"], F.lit("\n"), s["texto"]),
        ),
        "\n\n",
    )
    text = F.coalesce("full_text", F.lit(""))
    return paired.select(
        "area",
        F.when((X.strip(text) == "") & (F.size("sections") > 0), rebuilt).otherwise(text).alias("full_text"),
        "sections",
    )


def scan_reports_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(REPORT_SCHEMA).option("multiLine", "true").json(path)
    return report_fields(raw)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines): broken lines are kept aside to be counted, not lost."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    lines = spark.read.text(path).filter(X.strip(F.col("value")) != "")
    parsed = lines.select(
        F.from_json(
            "value", full,
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
        ).alias("r"),
    ).select("r.*")
    good = parsed.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = parsed.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    return good, bad


def scan_events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    from geoevents.operators.extraction import EVENT_SCHEMA

    return read_jsonl(spark, path, EVENT_SCHEMA)[0].filter(F.col("event_id").isNotNull())


def scan_actions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, ACTION_SCHEMA)[0].filter(F.col("action_id").isNotNull())


def usable_posts(posts: DataFrame, *, keyword_only: bool = True) -> DataFrame:
    """Original, non-blank posts; by default only those passing the keyword pre-filter."""
    out = posts.filter(~F.coalesce(F.col("is_retweet"), F.lit(False)))
    out = out.filter(X.strip(F.coalesce("text", F.lit(""))) != "")
    return out.filter(X.keyword_prefilter(F.col("text"))) if keyword_only else out


def scan_posts_jsonl(spark: SparkSession, path: str, *, keyword_only: bool = True) -> DataFrame:
    posts = read_jsonl(spark, path, POST_SCHEMA)[0]
    return usable_posts(posts, keyword_only=keyword_only).withColumn(
        "captured_at", D.parse_iso_ts(F.col("created_at"))
    )


def scan_classified_posts(spark: SparkSession, path: str, min_confidence: float = 0.5) -> DataFrame:
    posts = usable_posts(read_jsonl(spark, path, POST_SCHEMA)[0], keyword_only=False)
    return posts.filter(
        F.col("relevance.is_relevant") & (F.coalesce("relevance.confidence", F.lit(0.0)) >= min_confidence)
    )


def article_source_text(df: DataFrame, cap: int = 6000) -> DataFrame:
    """Source id and text (title, subtitle, body) of articles, at most ``cap`` characters."""
    blank_null = lambda c: F.nullif(X.strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(""))
    joined = F.concat_ws("\n\n", blank_null("title"), blank_null("subtitle"), blank_null("body_text"))
    return df.withColumns({
        "source_id": F.coalesce("article_id", "url"),
        "raw_text": F.left(joined, F.lit(cap)),
        "captured_at": F.coalesce(D.parse_iso_ts(F.col("published_at")), D.parse_iso_ts(F.col("fetched_at"))),
    }).filter(F.col("raw_text") != "")


def scan_articles_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return article_source_text(read_jsonl(spark, path, ARTICLE_SCHEMA)[0])


def continued_rows(df: DataFrame, id_col: str, line_col: str, block_lines: int = 1_000_000) -> DataFrame:
    """Lines without an id continue the last line with one: every line with the id it belongs to, its ``block`` of lines, and whether it
    is a head (it had an id itself). Lines before the first id are left out.

    The fill runs inside blocks of lines; what a block cannot fill itself it takes from the
    last id of the blocks before it, so no task sees more than one block of lines.
    """
    block = df.withColumn("block", F.floor(F.col(line_col) / F.lit(block_lines)))
    in_block = Window.partitionBy("block").orderBy(line_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = block.withColumn("_id", F.last(id_col, ignorenulls=True).over(in_block))
    # one row per block: safe to order in a single window
    ends = block.groupBy("block").agg(
        F.max_by(F.col(id_col), F.when(F.col(id_col).isNotNull(), F.col(line_col))).alias("_last")
    )
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("block", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    keyed = filled.join(carried, "block").withColumn("_id", F.coalesce("_id", "_carry")).filter(F.col("_id").isNotNull())
    keyed = keyed.withColumn("is_head", F.col(id_col).isNotNull())
    return keyed.select(*[F.col("_id").alias(c) if c == id_col else F.col(c) for c in df.columns], "block", "is_head")


def collapse_continuation_rows(df: DataFrame, id_col: str, line_col: str, nested: list[str],
                               block_lines: int = 1_000_000, per_block: bool = False) -> DataFrame:
    """One row per id with the nested fields of its lines as JSON arrays (see ``continued_rows``, which gathers nothing).

    With ``per_block`` one row per id and block of lines, in the order of ``block``, for ids whose lines are too many for one
    row; the other fields are those of the id's first head, and NULL in blocks without a head.
    """
    keyed = continued_rows(df, id_col, line_col, block_lines)
    plain = [c for c in df.columns if c not in (*nested, id_col, line_col)]
    aggs = [F.max_by(F.col(c), F.when(F.col("is_head"), -F.col(line_col))).alias(c) for c in plain]
    for c in nested:
        items = F.sort_array(
            F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(line_col).alias("l"), F.col(c).alias("v"))))
        )
        aggs.append(F.to_json(F.transform(items, lambda s: s["v"])).alias(c))
    return keyed.groupBy(id_col, *(["block"] if per_block else [])).agg(*aggs)


def flag_quality(df: DataFrame, id_col: str, lat: str = "lat", lon: str = "lon",
                 bbox=V.CITY_BBOX) -> DataFrame:
    """Quality flags as columns; no row is dropped. The duplicate flag joins per-id counts
    (pre-aggregated), so a heavily repeated id never becomes one task."""
    from geoevents.session import hashed_join

    repeated = df.groupBy(id_col).count().filter(F.col("count") > 1)
    repeated = repeated.select(id_col, F.lit(True).alias("_is_duplicate"))
    out = hashed_join(df, repeated, [id_col], "left")
    has = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return out.withColumns({
        "_is_duplicate": F.coalesce("_is_duplicate", F.lit(False)),
        "_has_coords": has,
        "_outside_city": has & ~in_bbox(F.col(lat), F.col(lon), bbox),
    })
