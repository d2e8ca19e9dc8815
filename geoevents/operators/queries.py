"""The query layer: filters, orders and limits over the area tables.

Each function takes the table the pipeline wrote and plain arguments; ``by_area`` names the
area where the table holds several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoevents.functions import text as X
from geoevents.operators.ranking import clamp_limit, top_k_per_group


def _area(df: DataFrame, area=None, key: str = "zone_id") -> DataFrame:
    return df if area is None else df.filter(F.col(key) == area)


def filter_bbox(df: DataFrame, bbox, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Inclusive box; NULL coordinates drop out."""
    return df.filter(F.col(lat).between(bbox[0], bbox[1]) & F.col(lon).between(bbox[2], bbox[3]))


def filter_type_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(X.type_regex(F.col(column), pattern))


def filter_hour_range(df: DataFrame, start: int | None, end: int | None, hour: str = "hour") -> DataFrame:
    """``start <= hour < end`` clamped to 0..24, unknown hours out; both None resets the filter."""
    if start is None and end is None:
        return df
    lo, hi = max(0, start or 0), min(24, 24 if end is None else end)
    return df.filter((F.col(hour) >= lo) & (F.col(hour) < hi))


def filter_points(df: DataFrame, kind: str | None = None, start: int | None = None, end: int | None = None,
                  offence: str = "offence", hour: str = "hour") -> DataFrame:
    """Map filter: kind words and either bound of the hour."""
    if kind:
        df = df.filter(X.match_kind(F.col(offence), kind))
    if start is not None:
        df = df.filter(F.col(hour) >= start)
    if end is not None:
        df = df.filter(F.col(hour) < end)
    return df


def query_streets(streets: DataFrame, area=None, *, order_by: str = "total", limit=None, bingo_only: bool = False,
                  hour: int | None = None, kind: str | None = None) -> DataFrame:
    df = _area(streets, area)
    if bingo_only:
        df = df.filter(F.coalesce("layers", F.lit(0)) >= 2)
    if hour is not None:
        df = df.filter(F.col("peak_hour") == hour)
    if kind:
        df = df.filter(F.col(f"n_{kind}") > 0)
    order = {"bingo": F.desc("layers"), "pico_hora": F.asc("peak_hour")}.get(order_by, F.desc("total"))
    return df.orderBy(order, "street", "zone_id").limit(clamp_limit(limit))


def query_narratives(tips: DataFrame, area=None, *, kind: str | None = None, contains: str | None = None,
                     street: str | None = None, limit=None, order: str = "id") -> DataFrame:
    df = _area(tips, area)
    for column, wanted in (("kind", kind), ("text", contains), ("street", street)):
        if wanted and wanted.strip():
            df = df.filter(X.contains_ci(F.col(column), wanted))
    return df.orderBy(order).limit(clamp_limit(limit, 20))


def query_service_calls(by_type: DataFrame, area=None, *, kind: str | None = None, agency: str | None = None,
                        overdue_only: bool = False, limit=None) -> DataFrame:
    df = _area(by_type, area)
    for column, wanted in (("kind", kind), ("agency", agency)):
        if wanted:
            df = df.filter(X.contains_ci(F.col(column), wanted))
    if overdue_only:
        df = df.filter(F.coalesce("overdue", F.lit(0)) > 0)
    return df.orderBy(F.desc("total"), "kind", "agency").limit(clamp_limit(limit, 30))


def query_factors(by_agency: DataFrame, area=None, *, agency: str | None = None) -> DataFrame:
    df = _area(by_agency, area)
    df = df.filter(X.contains_ci(F.col("agency"), agency)) if agency else df
    return df.orderBy(F.desc("total"), "agency")


def query_cross_validation(rows: DataFrame, area=None, *, agency: str | None = None) -> DataFrame:
    df = _area(rows, area)
    df = df.filter(X.contains_ci(F.col("agency_norm"), agency)) if agency else df
    return df.orderBy(F.desc("calls"), "agency_norm")


def query_gaps(gaps: DataFrame, area=None, *, top=None) -> DataFrame:
    return _area(gaps, area).orderBy(F.desc("priority"), "cluster_id").limit(clamp_limit(top, 20))


def query_report_section(reports: DataFrame, title: str | None = None) -> DataFrame:
    """Without a title the section titles; with one the first section whose title contains it."""
    titles = F.transform("sections", lambda s: s["titulo"])
    base = reports.filter(F.coalesce("full_text", F.lit("")) != "")
    if not title:
        return base.select("area", F.size("sections").alias("n_sections"), titles.alias("titulos"),
                           F.length("full_text").alias("n_chars"))
    match = F.try_element_at(F.filter("sections", lambda s: X.contains_ci(s["titulo"], title)), F.lit(1))
    return base.withColumn("_s", match).select(
        "area", F.col("_s").isNotNull().alias("found"), F.col("_s.titulo").alias("titulo"), F.col("_s.texto").alias("texto"))


def query_monthly(monthly: DataFrame, area=None, *, window=24, by: list[str] = ("zone_id",)) -> DataFrame:
    """The last w existing months, w at most 60."""
    return top_k_per_group(_area(monthly, area), list(by), [F.desc("month")], clamp_limit(window, 60))


def query_events(events: DataFrame, area: str, *, contains: str | None = None, limit=None) -> DataFrame:
    """Newest first: events whose area contains the first ten letters of the name."""
    df = events.filter(prefix_contains(F.col("area"), F.lit(area)))
    if contains and contains.strip():
        df = df.filter(X.contains_ci(F.col("street"), contains) | X.contains_ci(F.col("crime_type"), contains))
    return df.orderBy(F.desc("date_iso"), "event_id").limit(clamp_limit(limit, 25))


def query_hours(hours: DataFrame, area=None) -> DataFrame:
    return _area(hours, area).orderBy("zone_id", "hour")


def query_surroundings(surroundings: DataFrame, area=None) -> DataFrame:
    return _area(surroundings, area).select("zone_id", "name", "population", "tips", "calls")


# ------------------------------------------------------------------ name matching
def prefix_key(c: Column, n: int = 10) -> Column:
    return F.left(F.lower(c), F.lit(n))


def prefix_contains(c: Column, name: Column, n: int = 10) -> Column:
    return F.lower(c).contains(prefix_key(name, n))


def prefix_join(left: DataFrame, right: DataFrame, name: str, other: str, n: int = 10) -> DataFrame:
    """Names equal on their first n lower-case letters; the first right row per key matches."""
    first = right.groupBy(prefix_key(F.col(other), n).alias("_k")).agg(
        F.min_by(F.struct(*right.columns), F.col(other)).alias("_r"))
    return left.withColumn("_k", prefix_key(F.col(name), n)).join(first, "_k", "left").select(
        *left.columns, *[F.col(f"_r.{c}").alias(f"match_{c}") for c in right.columns])


def registry_join(df: DataFrame, registry: DataFrame, name: str) -> DataFrame:
    """Area id for any of the registered spellings (``registry(area_id, spellings)``)."""
    spelt = registry.select("area_id", F.explode("spellings").alias("_n")).select("area_id", X.norm_street(F.col("_n")).alias("_n")).distinct()
    return df.withColumn("_n", X.norm_street(F.col(name))).join(spelt, "_n", "left").drop("_n")


def match_streets_to_lines(streets: DataFrame, segments: DataFrame, *, street: str = "street") -> DataFrame:
    """Streets with their gazetteer lines: normal form first, else the name with a repeated
    first word removed. Adds ``street_norm`` (the matched name) and ``n_lines``.

    ``segments(street_norm, line_id, …)``; ``lines.street_lines`` gives the lines themselves, cut at the zones.
    """
    names = segments.groupBy("street_norm").agg(F.count_distinct("line_id").alias("n_lines"))
    keyed = streets.withColumn("_k1", X.norm_street(F.col(street))).withColumn("_k2", X.dedupe_leading_prefix(F.col("_k1")))
    first = names.select(F.col("street_norm").alias("_k1"), F.col("n_lines").alias("_n1"))
    second = names.select(F.col("street_norm").alias("_k2"), F.col("n_lines").alias("_n2"))
    out = keyed.join(first, "_k1", "left").join(second, "_k2", "left")
    matched = F.when(F.col("_n1").isNotNull(), F.col("_k1")).when(F.col("_n2").isNotNull(), F.col("_k2"))
    return out.withColumns({"street_norm": matched, "n_lines": F.coalesce("_n1", "_n2", F.lit(0))}).drop("_k1", "_k2", "_n1", "_n2")


def flag_in_critical_street(tips: DataFrame, critical: DataFrame, street: str = "street") -> DataFrame:
    """Is the tip's street among the critical ones?"""
    from geoevents.session import hashed_join

    names = critical.select(F.col(street)).distinct().withColumn("_hit", F.lit(True))
    return hashed_join(tips, names, [street], "left").withColumn(
        "in_critical_street", F.coalesce("_hit", F.lit(False))).drop("_hit")


def pip_by_name(df: DataFrame, zones: DataFrame, stored: str, name: str = "name") -> DataFrame:
    """Zone by the stored area name instead of geometry."""
    return df.join(zones.select(F.col(name).alias(stored), "zone_id"), stored, "left")


def anti_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not stored yet."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def union_layers(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_set(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def since_filter(rows: DataFrame, since, known: DataFrame | None = None, *, day: str = "day", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to keep, tally of new / known / too old)."""
    marked = rows if known is None else rows.join(
        known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    is_known = F.coalesce(F.col("_known"), F.lit(False)) if known is not None else F.lit(False)
    status = F.when(F.col(day) < F.lit(since).cast("date"), "too_old").when(is_known, "known").otherwise("new")
    marked = marked.withColumn("status", status)
    return marked.filter(F.col("status") == "new").select(*rows.columns), marked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
