"""Nested events from structured rows, stored model answers and posts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoevents.functions import fixed_values as V
from geoevents.functions import temporal as D
from geoevents.functions import text as X

EVENT_SCHEMA = (
    "event_id string, crime_type string, "
    "temporal struct<date_iso:string,hour_24:int,daypart:string,weekday_bracket:string,"
    "is_peak_hour:boolean,coincides_with_patrol_change:boolean>, "
    "spatial struct<address_text:string,logradouro:string,altura:string,bairro:string,area_fm:string,"
    "aisp:string,latitude:double,longitude:double,venue:string,transport_line_text:string>, "
    "environment struct<urban_factors:array<string>,foot_traffic:string,vehicle_traffic:string,"
    "lighting:string,patrol_presence:string,camera_present:boolean,extra_notes_text:string>, "
    "victim_count_total int, agent_count_total int, "
    "victims array<struct<gender:string,age_bracket:string,age_estimated:int,exposed_item_before:boolean,"
    "item_exposed_text:string,reaction:string,injured:boolean,killed:boolean,occupation_text:string>>, "
    "agents array<struct<estimated_age:string,height:string,build:string,skin_tone:string,"
    "clothing_text:string,accessories:array<string>,distinctive_marks_text:string,role_text:string>>, "
    "vehicles array<struct<type:string,role:string,plate_visible:boolean,plate_text:string,color:string,"
    "brand_model_text:string>>, "
    "weapons array<struct<type:string,brandished:boolean,used:boolean,description_text:string>>, "
    "stolen_items array<struct<type:string,quantity:int,description_text:string,recovered:boolean>>, "
    "approach struct<type:string,description_text:string>, "
    "escape struct<type:string,direction_text:string,description_text:string>, "
    "modus_operandi struct<tactics:array<string>,summary_text:string>, "
    "outcome struct<status:string,victim_escaped:boolean,victim_reacted:boolean,agent_neutralized:boolean,"
    "third_party_intervention:boolean,injuries_text:string>, "
    "source struct<kind:string,source_id:string,source_file:string,raw_text:string,raw_text_hash:string,"
    "captured_at:timestamp,reliability:double>, "
    "extraction struct<method:string,model_id:string,ontology_version:string,extracted_at:timestamp,"
    "confidence:double,notes:string>, "
    "related_event_ids array<string>, triggered_fm_action_ids array<string>"
)


@lru_cache(maxsize=1)
def event_type() -> T.StructType:
    """The nested event as a type (parsing needs a running session)."""
    return T.StructType.fromDDL(EVENT_SCHEMA)



# fields that say "unknown" with the feminine word; all other closed fields use the masculine
_FEMININE = {"lighting", "patrol_presence", "venue", "height", "skin_tone"}
_CLOSED = {
    "crime_type", "daypart", "weekday_bracket", "venue", "foot_traffic", "vehicle_traffic", "lighting",
    "patrol_presence", "status",
}


def _default(path: str, dtype: T.DataType) -> Column:
    """An unknown value: unknown word for closed texts, [] for lists, NULL otherwise."""
    leaf = path.split(".")[-1]
    if isinstance(dtype, T.StructType):
        return _struct(path, dtype, {})
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    if leaf in _CLOSED or path in ("approach.type", "escape.type"):
        word = "desconhecida" if leaf in _FEMININE or path in ("approach.type", "escape.type") else "desconhecido"
        return F.lit(word)
    return F.lit(None).cast(dtype)


def _struct(path: str, dtype: T.StructType, given: dict[str, Column]) -> Column:
    fields = []
    for f in dtype.fields:
        p = f"{path}.{f.name}" if path else f.name
        if p in given:
            value = given[p].cast(f.dataType)
        elif isinstance(f.dataType, T.StructType):
            value = _struct(p, f.dataType, given)
        else:
            value = _default(p, f.dataType)
        fields.append(value.alias(f.name))
    return F.struct(*fields)


def make_events(df: DataFrame, given: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    """Events with the given leaf columns; everything else is unknown."""
    whole = _struct("", event_type(), given)
    return df.select(*keep, whole.alias("_e")).select(*keep, "_e.*")


def incidents_to_events(df: DataFrame, *, version: str = "1", file: str = "incidents") -> DataFrame:
    """Incident columns ``(id, offence, day, hour, locf, lat, lon, aisp, area)`` to events."""
    kind = F.lit("ocorrencia_oficial")
    return make_events(df, {
        "event_id": X.event_id(kind, F.col("id").cast("string")),
        "crime_type": X.offence_to_type(F.col("offence")),
        "temporal.date_iso": F.date_format("day", "yyyy-MM-dd"),
        "temporal.hour_24": F.col("hour"), "temporal.daypart": D.daypart6(F.col("hour")),
        "spatial.address_text": F.col("locf"), "spatial.logradouro": F.col("locf"),
        "spatial.latitude": F.col("lat"), "spatial.longitude": F.col("lon"),
        "spatial.aisp": F.col("aisp"), "spatial.area_fm": F.col("area"),
        "source.kind": kind, "source.source_id": F.col("id"), "source.source_file": F.lit(file),
        "source.reliability": F.lit(1.0),
        "extraction.method": F.lit("structured"), "extraction.ontology_version": F.lit(version),
        "extraction.confidence": F.lit(0.9),
    })


def tips_to_events(df: DataFrame, *, version: str = "1", file: str = "tips") -> DataFrame:
    """Tip columns to events; reported descriptors are carried as opaque agent fields only."""
    kind = F.lit("disque_denuncia")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    address = F.nullif(F.trim(F.concat_ws(" ", empty("street"), empty("number"))), F.lit(""))
    descriptors = ["sexo", "idade", "pele", "estatura", "porte", "outras"]
    present = F.lit(False)
    for c in descriptors:
        present = present | (empty(c) != "")
    agent_type = event_type()["agents"].dataType.elementType
    agent = F.struct(
        X.age_bracket(F.col("idade")).alias("estimated_age"), X.height_bracket(F.col("estatura")).alias("height"),
        X.build_bracket(F.col("porte")).alias("build"), X.skin_category(F.col("pele")).alias("skin_tone"),
        F.lit(None).cast("string").alias("clothing_text"), F.array().cast("array<string>").alias("accessories"),
        F.nullif(F.col("outras"), F.lit("")).alias("distinctive_marks_text"), F.lit(None).cast("string").alias("role_text"),
    ).cast(agent_type)
    text = F.nullif(F.trim("text"), F.lit(""))
    return make_events(df, {
        "event_id": X.event_id(kind, F.col("id").cast("string")),
        "crime_type": X.tip_to_type(F.col("classe"), F.col("kind")),
        "temporal.date_iso": F.date_format("day", "yyyy-MM-dd"),
        "temporal.daypart": F.lit("desconhecido"),
        "spatial.address_text": address, "spatial.logradouro": F.col("street"), "spatial.altura": F.col("number"),
        "spatial.bairro": F.col("neighbourhood"), "spatial.latitude": F.col("lat"),
        "spatial.longitude": F.col("lon"), "spatial.area_fm": F.col("area"),
        "agents": F.when(present, F.array(agent)).otherwise(F.array().cast(event_type()["agents"].dataType)),
        "source.kind": kind, "source.source_id": F.col("id"), "source.source_file": F.lit(file),
        "source.raw_text": text, "source.raw_text_hash": F.sha1(text.cast("binary")), "source.reliability": F.lit(0.7),
        "extraction.method": F.lit("structured"), "extraction.ontology_version": F.lit(version),
        "extraction.confidence": F.lit(0.7),
    })


def merge_known(base: Column, overlay: Column, dtype: T.DataType) -> Column:
    """Base wins unless NULL, unknown, '' or []; structs are merged leaf by leaf."""
    if isinstance(dtype, T.StructType):
        fields = [merge_known(base[f.name], overlay[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        both = F.struct(*fields)
        return F.when(base.isNull(), overlay).when(overlay.isNull(), base).otherwise(both)
    if isinstance(dtype, T.ArrayType):
        return F.when(F.coalesce(F.size(base), F.lit(0)) > 0, base).otherwise(F.coalesce(overlay, base))
    if isinstance(dtype, T.StringType):
        unknown = base.isNull() | base.isin("", *V.UNKNOWN_WORDS)
        return F.when(unknown, F.coalesce(overlay, base)).otherwise(base)
    return F.coalesce(base, overlay)


def hybrid_events(structured: DataFrame, enriched: DataFrame) -> DataFrame:
    """Structured events filled from enrichment events of the same id. Id and source stay
    structured, the confidence is the larger, the method becomes 'hybrid'."""
    over = enriched.select(F.col("event_id"), F.struct(*[F.col(c) for c in event_type().names]).alias("_o"))
    joined = structured.select(*event_type().names).join(over, "event_id", "left")
    hit = F.col("_o").isNotNull()
    cols = []
    for f in event_type().fields:
        own, other = F.col(f.name), F.col("_o")[f.name]
        if f.name in ("event_id", "source"):
            cols.append(own)
        elif f.name == "extraction":
            both = F.struct(
                F.lit("hybrid").alias("method"), other["model_id"].alias("model_id"),
                own["ontology_version"].alias("ontology_version"), other["extracted_at"].alias("extracted_at"),
                F.greatest(own["confidence"], other["confidence"]).alias("confidence"), own["notes"].alias("notes"))
            cols.append(F.when(hit, both).otherwise(own).alias(f.name))
        else:
            cols.append(F.when(hit, merge_known(own, other, f.dataType)).otherwise(own).alias(f.name))
    return joined.select(*cols)


def responses_to_events(df: DataFrame, *, response: str = "response", kind: str = "source_kind",
                        source_id: str = "source_id", known_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) from stored answer texts. Id and source are those of the row, never
    the answer's; an answer without a valid event type goes to the rejected table."""
    parsed = df.withColumn("_e", F.from_json(X.loose_json(F.col(response)), event_type()))
    valid = F.coalesce(F.col("_e.crime_type").isin(known_types or list(V.CRIME_TYPE_WEIGHT)), F.lit(False))
    source = F.struct(
        F.col(kind).alias("kind"), F.col(source_id).cast("string").alias("source_id"),
        F.col("_e.source.source_file").alias("source_file"), F.col("_e.source.raw_text").alias("raw_text"),
        F.col("_e.source.raw_text_hash").alias("raw_text_hash"), F.col("_e.source.captured_at").alias("captured_at"),
        F.col("_e.source.reliability").alias("reliability"))
    good = parsed.filter(valid).withColumn("_id", X.event_id(F.col(kind), F.col(source_id).cast("string")))
    cols = [
        F.col("_id").alias("event_id") if n == "event_id" else source.alias("source") if n == "source" else F.col(f"_e.{n}").alias(n)
        for n in event_type().names
    ]
    return good.select(*cols), parsed.filter(~valid).drop("_e")


def relevance_rule(in_city: Column, category: Column) -> Column:
    """Relevant means in the city and one of the relevant categories, whatever the model said."""
    return F.coalesce(in_city, F.lit(False)) & F.coalesce(category.isin(V.RELEVANT_CATEGORIES), F.lit(False))


def apply_verdicts(posts: DataFrame, verdicts: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """Posts with their verdict and the rule applied; posts already classified are skipped,
    posts without a verdict are left out. ``verdicts(key, in_city, category, …)``."""
    fresh = posts if known is None else posts.join(known.select(key).distinct(), key, "left_anti")
    return fresh.join(verdicts, key).withColumn("is_relevant", relevance_rule(F.col("in_city"), F.col("category")))


def run_all_sources(named: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(union of all events in the given order of sources, counts per source)."""
    events = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("source_name"), *event_type().names)
        events = part if events is None else events.unionByName(part)
    return events, events.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))


def event_summaries(events: DataFrame) -> DataFrame:
    """Flat rows of the query layer, unknown tactics and weapons dropped."""
    known = lambda arr, get: F.filter(F.transform(arr, get), lambda t: ~t.isin("desconhecido", "desconhecida"))
    return events.select(
        "event_id", "crime_type", F.coalesce("spatial.area_fm", F.lit("")).alias("area"),
        F.coalesce("temporal.date_iso", F.lit("")).alias("date_iso"), F.col("temporal.hour_24").alias("hour"),
        F.coalesce("spatial.logradouro", F.lit("")).alias("street"),
        known(F.col("modus_operandi.tactics"), lambda t: t).alias("tactics"),
        known(F.col("weapons"), lambda w: w["type"]).alias("weapons"), F.col("outcome.status").alias("outcome"))
