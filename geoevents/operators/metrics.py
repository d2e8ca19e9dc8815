"""Grouped measures of incidents, tips, factors and calls.

Every operator is one grouped pass over all areas at once: ``by`` names the group columns.
Counts are taken on the finest key first, so later steps (modes, peaks, top lists) work on
small counted tables, not on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoevents.functions import fixed_values as V
from geoevents.functions import temporal as D
from geoevents.functions import text as X
from geoevents.operators.ranking import top_k_per_group
from geoevents.session import hashed_join


def count_by(df: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def smallest_mode(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties; NULLs do not count."""
    return df.groupBy(*by).agg(F.mode(value, True).alias(out))


# ------------------------------------------------------------------ hours and weekdays
def hour_histogram(df: DataFrame, by: list[str], hour: str = "hour") -> DataFrame:
    return count_by(df.filter(F.col(hour).isNotNull()), [*by, hour])


def weekday_histogram(df: DataFrame, by: list[str], weekday: str = "weekday") -> DataFrame:
    return count_by(df.filter(F.col(weekday).isNotNull()), [*by, weekday])


def hour_weekday_matrix(df: DataFrame, by: list[str], hour: str = "hour", weekday: str = "weekday") -> DataFrame:
    """7 x 24 counts per group, zero-filled. Weekdays are 0..6."""
    counts = count_by(df.filter(F.col(hour).isNotNull() & F.col(weekday).isNotNull()), [*by, weekday, hour])
    spine = counts.select(*by).distinct().withColumn(
        weekday, F.explode(F.sequence(F.lit(0), F.lit(6)))
    ).withColumn(hour, F.explode(F.sequence(F.lit(0), F.lit(23))))
    full = spine.join(counts, [*by, weekday, hour], "left")
    return full.withColumn("n", F.coalesce("n", F.lit(0)))


def hour_weekday_rollup(matrix: DataFrame, by: list[str], hour: str = "hour", weekday: str = "weekday") -> DataFrame:
    """Matrix totals by hour and by weekday in one pass (``axis`` says which)."""
    sets = [[*by, hour], [*by, weekday]]
    rolled = matrix.groupingSets(sets, *by, hour, weekday).agg(F.sum("n").alias("n"))
    return rolled.withColumn("axis", F.when(F.col(hour).isNotNull(), "hour").otherwise("weekday"))


def matrix_summary(matrix: DataFrame, by: list[str], hour: str = "hour", weekday: str = "weekday") -> DataFrame:
    """Total with time, busiest cell, hour and weekday (ties: earliest)."""
    cell = matrix.groupBy(*by).agg(
        F.sum("n").alias("total_with_time"),
        F.max(F.struct("n", (-F.col(weekday)).alias("d"), (-F.col(hour)).alias("h"))).alias("c"),
    )
    cell = cell.select(
        *by, "total_with_time", F.col("c.n").alias("peak_cell_n"),
        (-F.col("c.d")).alias("peak_cell_weekday"), (-F.col("c.h")).alias("peak_cell_hour"),
    )
    return (
        cell.join(peak_hour(count_sum(matrix, [*by, hour]), by, hour), by, "left")
        .join(
            count_sum(matrix, [*by, weekday]).groupBy(*by)
            .agg(F.max_by(weekday, F.struct("n", -F.col(weekday))).alias("peak_weekday")),
            by, "left",
        )
    )


def count_sum(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n").alias("n"))


def peak_hour(histogram: DataFrame, by: list[str], hour: str = "hour") -> DataFrame:
    """Busiest hour of a histogram, the earliest on ties, with its 'Nh' label."""
    best = histogram.groupBy(*by).agg(F.max_by(hour, F.struct("n", -F.col(hour))).alias("peak_hour"))
    label = F.concat(F.col("peak_hour").cast("string"), F.lit("h"))
    return best.withColumn("peak_label", F.coalesce(label, F.lit("N/D")))


def peak_ratio(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Share of the three busiest hours (at most 24 rows per group)."""
    sizes = F.reverse(F.sort_array(F.collect_list(F.col("n"))))
    top3 = F.aggregate(F.slice(sizes, 1, 3), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return histogram.groupBy(*by).agg((top3 / F.sum("n")).alias("peak_ratio"))


def night_share(df: DataFrame, by: list[str], hour: str = "hour", digits: int | None = 1,
                base: str = "timed") -> DataFrame:
    """Percent at night; the base is rows with an hour, or all rows with ``base='all'``."""
    night = F.count_if(D.is_night(F.col(hour)))
    denominator = F.count(hour) if base == "timed" else F.count(F.lit(1))
    pct = F.coalesce(F.try_divide(night * 100.0, denominator), F.lit(0.0))
    return df.groupBy(*by).agg((pct if digits is None else F.round(pct, digits)).alias("night_pct"))


# ------------------------------------------------------------------ streets
def street_profile(df: DataFrame, by: list[str], *, street: str = "street", hour: str = "hour",
                   offence: str = "offence") -> DataFrame:
    """Per street: incidents, mean place, three offence counts, modal hour."""
    rows = df.filter(F.col(street).isNotNull())
    n_of = lambda name: F.count_if(F.col(offence) == name)
    hourly = rows.groupBy(*by, street, hour).agg(
        F.count(F.lit(1)).alias("n"), F.sum("lat").alias("s_lat"), F.count("lat").alias("n_lat"),
        F.sum("lon").alias("s_lon"), F.count("lon").alias("n_lon"),
        n_of(V.ROBBERY_PASSERBY).alias("k1"), n_of(V.ROBBERY_PHONE).alias("k2"),
        n_of(V.ROBBERY_BUS).alias("k3"),
    )
    timed = F.when(F.col(hour).isNotNull(), F.struct(F.col("n"), -F.col(hour)))
    return hourly.groupBy(*by, street).agg(
        F.sum("n").alias("total"),
        F.try_divide(F.sum("s_lat"), F.sum("n_lat")).alias("lat"),
        F.try_divide(F.sum("s_lon"), F.sum("n_lon")).alias("lon"),
        F.sum("k1").alias("n_transeunte"), F.sum("k2").alias("n_celular"), F.sum("k3").alias("n_coletivo"),
        F.coalesce(F.max_by(hour, timed), F.lit(0)).alias("peak_hour"),
    )


def top_streets(df: DataFrame, by: list[str], n: int = 10, *, street: str = "street", **kw) -> DataFrame:
    """The n busiest streets per group; names of at most 3 letters are dropped after the cut."""
    profile = street_profile(df, by, street=street, **kw)
    top = top_k_per_group(profile, by, [F.desc("total"), F.col(street)], n, rank="street_rank")
    return top.filter(F.length(street) > 3)


def streets_profile_all(df: DataFrame, by: list[str], street: str = "street", name: str = "locf",
                        hour: str = "hour", order: str = "id") -> DataFrame:
    """Per street: first name, incidents, mean hour, peak hour, night share of all rows."""
    rows = df.filter(F.col(street).isNotNull())
    named = rows.filter(F.col(street) != "")
    hourly = named.groupBy(*by, street, hour).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(order, name)).alias("first")
    )
    timed = F.when(F.col(hour).isNotNull(), F.struct(F.col("n"), -F.col(hour)))
    night = F.when(D.is_night(F.col(hour)), F.col("n")).otherwise(0)
    timed_n = F.when(F.col(hour).isNotNull(), F.col("n"))
    return hourly.groupBy(*by, street).agg(
        F.min("first").getField(name).alias("name"), F.sum("n").alias("total"),
        F.try_divide(F.sum(F.col(hour) * F.col("n")), F.sum(timed_n)).alias("mean_hour"),
        F.max_by(hour, timed).alias("peak_hour"),
        (F.sum(night) * 100.0 / F.sum("n")).alias("night_pct"),
    )


def factors_by_street(df: DataFrame, by: list[str], street: str = "street", kind: str = "kind",
                      agency: str = "agency", first: list[str] = (), order: str = "id") -> DataFrame:
    """Per street: distinct factor types and agencies (closed lists, so bounded), count."""
    rows = df.filter(F.col(street).isNotNull() & (F.col(street) != ""))
    firsts = [F.min_by(c, order).alias(c) for c in first]
    return rows.groupBy(*by, street).agg(
        F.sort_array(F.collect_set(kind)).alias("factor_types"),
        F.sort_array(F.collect_set(agency)).alias("agencies"),
        F.count(F.lit(1)).alias("n_factors"), *firsts,
    )


def tips_by_street(df: DataFrame, by: list[str], street: str = "street", kind: str = "kind") -> DataFrame:
    """Per street: number of tips and their distinct types; ``tip_narratives`` has the texts."""
    rows = df.filter(F.col(street).isNotNull() & (F.col(street) != ""))
    return rows.groupBy(*by, street).agg(
        F.count(F.lit(1)).alias("n_tips"), F.sort_array(F.collect_set(kind)).alias("tip_types"))


def tip_narratives(df: DataFrame, by: list[str], street: str = "street", text: str = "text", order: str = "id") -> DataFrame:
    """Every narrative of every street, one row each: (street, order, text). Long form, so a
    street with any number of tips is never one list; sort by the order column to read it."""
    rows = df.filter(F.col(street).isNotNull() & (F.col(street) != "") & F.col(text).isNotNull())
    return rows.select(*by, street, F.col(order).alias("order"), text)


def join_left_street(streets: DataFrame, keys: list[str], *others: DataFrame) -> DataFrame:
    for other in others:
        streets = streets.join(other, keys, "left")
    return streets


# ------------------------------------------------------------------ agencies, calls, tips
def top_types(df: DataFrame, by: list[str], kind: str, k: int = 5) -> DataFrame:
    """Total per group with its k most frequent types as a nested list."""
    counts = count_by(df, [*by, kind])
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    top = top_k_per_group(counts.filter(F.col(kind).isNotNull()), by, [F.desc("n"), F.col(kind)], k, rank="pos")
    nested = top.groupBy(*by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", kind, "n"))),
            lambda s: F.struct(s[kind].alias("tipo"), s["n"].alias("count")),
        ).alias("tipos")
    )
    return totals.join(nested, by, "left")


def factors_by_agency(df: DataFrame, by: list[str], agency: str = "agency", kind: str = "kind") -> DataFrame:
    return top_types(df.filter(F.col(agency).isNotNull()), [*by, agency], kind)


def tips_by_neighbourhood(zoned_tips: DataFrame, kind: str = "kind", zone: str = "zone_id") -> DataFrame:
    """Totals and five main types per neighbourhood, from tips joined to neighbourhoods."""
    return top_types(zoned_tips.filter(F.col(zone).isNotNull()), [zone], kind)


def calls_summary(df: DataFrame, by: list[str], *, status: str = "status", due: str = "due",
                  served: str = "Atendido", late: str = "Vencido") -> DataFrame:
    """Total, with coordinates, percent served (equality) and percent overdue."""
    pct = lambda cond: F.coalesce(F.avg(F.coalesce(cond, F.lit(False)).cast("double")) * 100, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count("lat").alias("with_coords"),
        pct(F.col(status) == served).alias("pct_served"), pct(F.col(due) == late).alias("pct_overdue"),
    )


def served_equal(c: Column, word: str = "Atendido") -> Column:
    return F.coalesce(c == word, F.lit(False))


def served_contains(c: Column, word: str = "Atendido") -> Column:
    """Case-insensitive contains: also matches a negated status, as the source measure does."""
    return F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))


def served_prefix(c: Column, word: str = "Atendido") -> Column:
    return F.coalesce(c.startswith(word), F.lit(False))


def calls_by_type(df: DataFrame, by: list[str], *, kind: str = "kind", agency: str = "agency",
                  status: str = "status", due: str = "due", late: str = "Vencido", k: int = 20,
                  served: str = "Atendido") -> DataFrame:
    """The k most frequent (type, agency) pairs with served and overdue counts."""
    counts = calls_by_pair(df, by, kind=kind, agency=agency, status=status, due=due, late=late, served=served)
    order = [F.desc("total"), F.col(kind), F.col(agency)]
    return top_k_per_group(counts, by, order, k)


def calls_by_pair(df: DataFrame, by: list[str], *, kind: str = "kind", agency: str = "agency",
                  status: str = "status", due: str = "due", late: str = "Vencido", served: str = "Atendido") -> DataFrame:
    """All (type, agency) pairs with served and overdue counts."""
    return df.groupBy(*by, kind, agency).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(served_contains(F.col(status), served)).alias("served"),
        F.count_if(F.col(due) == late).alias("overdue"),
    )


def calls_monthly_by_type(df: DataFrame, by: list[str], day: str = "day", kind: str = "kind",
                          status: str = "status", served: str = "Atendido") -> DataFrame:
    month = D.month_key(F.col(day)).alias("month")
    return df.groupBy(*by, month, kind).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col(status) == served).alias("served"),
        F.count("lat").alias("with_coords"),
    )


def calls_hotspots(df: DataFrame, by: list[str], minimum: int = 3, day: str = "day") -> DataFrame:
    spots = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
    )
    return spots.filter(F.col("total") >= minimum)


def calls_by_neighbourhood(neighbourhoods: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """Calls of the whole table per neighbourhood id, 0 where none."""
    counts = calls.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("calls"))
    return neighbourhoods.join(counts, key, "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def cross_validate_sources(factors: DataFrame, calls: DataFrame, by: list[str], *, agency: str = "agency",
                           status: str = "status", due: str = "due", late: str = "Vencido",
                           served: str = "Atendido", dedupe: bool = False) -> DataFrame:
    """Field factors against citizen calls per agency normal form.

    As in the source measure, every spelling of an agency gets its own row with the full call
    count; ``dedupe=True`` merges the spellings instead.
    """
    spelt = count_by(factors.filter(F.col(agency).isNotNull()), [*by, agency], "field_factors")
    spelt = spelt.withColumn("agency_norm", X.norm_agency(F.col(agency)))
    if dedupe:
        spelt = spelt.groupBy(*by, "agency_norm").agg(F.sum("field_factors").alias("field_factors"))
    # count raw spellings first: the normal form is then computed once per spelling
    raw = calls.groupBy(*by, agency).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(served_prefix(F.col(status), served)).alias("s"),
        F.count_if(F.col(due) == late).alias("l"),
    )
    norm = raw.withColumn("agency_norm", X.norm_agency(F.coalesce(agency, F.lit("None"))))
    per_agency = norm.groupBy(*by, "agency_norm").agg(
        F.sum("n").alias("calls"), F.sum("s").alias("served"), F.sum("l").alias("overdue")
    )
    out = spelt.join(per_agency, [*by, "agency_norm"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("calls", "served", "overdue")}
    return out.withColumns(zero).withColumn("validated", F.col("calls") > 0)


# ------------------------------------------------------------------ areas
def modal_district(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Modal district numbers of each area."""
    return df.groupBy(*by).agg(*[F.mode(c, True).alias(c) for c in cols])


def dominant_territory(pairs: DataFrame, by: list[str], faction: str) -> DataFrame:
    """Most frequent faction among intersecting territories (ties: first name)."""
    counts = count_by(pairs.filter(F.col(faction).isNotNull()), [*by, faction])
    return top_k_per_group(counts, by, [F.desc("n"), F.col(faction)], 1).drop("n")


def district_violence(series: DataFrame, district: str = "aisp", year: str = "ano",
                      metrics: list[str] | None = None, years: int = 3) -> DataFrame:
    """Sums over the last years present in the data, NULL and bad values as 0."""
    present = [m for m in (metrics or V.DISTRICT_METRICS) if m in series.columns]
    recent = series.select(year).filter(F.col(year).isNotNull()).distinct().orderBy(F.desc(year)).limit(years)
    value = lambda m: F.coalesce(F.col(m).cast("string").try_cast("double"), F.lit(0.0))
    kept = series.filter(F.col(district).isNotNull()).join(F.broadcast(recent), year, "left_semi")
    return kept.groupBy(district).agg(*[F.sum(value(m)).cast("bigint").alias(m) for m in present])


def modus_counts(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """How many narratives carry each tag."""
    tagged = df.filter(F.col(text).isNotNull()).select(
        *by, F.explode(X.extract_modus(F.col(text))).alias("modus")
    )
    return count_by(tagged, [*by, "modus"])


def per_capita(df: DataFrame, crimes: str = "crimes", population: str = "population", digits: int = 1) -> DataFrame:
    """Incidents per 1000 residents; NULL without residents."""
    rate = F.when(F.col(population) > 0, F.col(crimes) / F.col(population) * 1000)
    return df.withColumn("crimes_per_1000", F.round(rate, digits))


def incidents_per_camera(df: DataFrame, crimes: str = "crimes", cameras: str = "cameras", digits: int = 1) -> DataFrame:
    return df.withColumn("crimes_per_camera", F.round(F.try_divide(F.col(crimes), F.col(cameras)), digits))


def count_by_urgency(actions: DataFrame, urgency: str = "urgency") -> DataFrame:
    return count_by(actions, [urgency])


def risk_level(score: Column, levels=V.RISK_LEVELS) -> Column:
    """First label whose cut the score reaches."""
    out = None
    for cut_at, label in levels:
        cond = score >= cut_at
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(levels[-1][1])


def group_by_risk(areas: DataFrame, score: str = "score") -> DataFrame:
    """Areas per risk level, and how many reach 40."""
    return areas.groupBy(risk_level(F.col(score)).alias("level")).agg(
        F.count(F.lit(1)).alias("n_areas"), F.count_if(F.col(score) >= 40).alias("n_40_plus")
    )


def multi_area_totals(areas: DataFrame, columns: list[str]) -> DataFrame:
    return areas.agg(*[F.sum(c).alias(f"total_{c}") for c in columns])


def store_stats(events: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension and in total, one pass with grouping sets."""
    sets = [[d] for d in dims] + [[]]
    grouped = events.groupingSets(sets, *dims).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*dims).alias("gid")
    )
    k = len(dims)
    name, value = F.lit("total"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        only_d = F.col("gid") == F.lit((1 << k) - 1 - (1 << (k - 1 - i)))
        name = F.when(only_d, d).otherwise(name)
        value = F.when(only_d, F.col(d).cast("string")).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def classify_summary(posts: DataFrame, account: str = "account", relevant: str = "is_relevant") -> DataFrame:
    """Per account: classified, relevant, discarded."""
    return posts.groupBy(account).agg(
        F.count(relevant).alias("classified"), F.count_if(F.col(relevant)).alias("relevant"),
        F.count_if(~F.col(relevant)).alias("discarded"),
    )


def run_meta(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the source tables as one row (one count per table, joined as scalars)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(f"total_{name}")).withColumn("_one", F.lit(1))
        out = one if out is None else out.join(F.broadcast(one), "_one")
    return out.drop("_one")


# ------------------------------------------------------------------ statistics
def pearson_layers(streets: DataFrame, by: list[str], layers: str = "layers", total: str = "total",
                   has_factor: str = "has_factor") -> DataFrame:
    """Correlation of layer count with incidents, mean with and without factors, ratio, label.
    Groups of fewer than three streets are left out; zero variance gives 0."""
    stats = streets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_streets"),
        F.count_if(F.col(has_factor)).alias("n_with"),
        F.corr(F.col(layers).cast("double"), F.col(total).cast("double")).alias("r0"),
        F.coalesce(F.avg(F.when(F.col(has_factor), F.col(total))), F.lit(0.0)).alias("mean_with"),
        F.coalesce(F.avg(F.when(~F.col(has_factor), F.col(total))), F.lit(0.0)).alias("mean_without"),
    ).filter(F.col("n_streets") >= 3)
    r = F.when(F.col("r0").isNull() | F.isnan("r0"), F.lit(0.0)).otherwise(F.col("r0"))
    out = stats.withColumn("r", r).drop("r0")
    return out.withColumns({
        "strength": F.when(F.abs("r") > 0.6, "forte").when(F.abs("r") > 0.3, "moderada").otherwise("fraca"),
        "ratio": F.when(F.col("mean_without") > 0, F.col("mean_with") / F.col("mean_without")),
    })


def gini_hours(df: DataFrame, by: list[str], hour: str = "hour") -> DataFrame:
    """Gini index of the 24-hour histogram; 0 with fewer than three timed rows, clamped 0..1."""
    counts = hour_histogram(df, by, hour)
    return gini_from_histogram(counts, by)


def gini_from_histogram(counts: DataFrame, by: list[str]) -> DataFrame:
    sizes = F.sort_array(F.collect_list(F.col("n")))           # at most 24 values
    per = counts.groupBy(*by).agg(sizes.alias("s"), F.sum("n").alias("total"))
    pad = F.lit(24) - F.size("s")
    weighted = F.aggregate(
        F.transform("s", lambda v, i: v * (i + 1 + pad)), F.lit(0).cast("bigint"), lambda a, v: a + v
    )
    gini = (weighted * 2.0) / (F.col("total") * 24.0) - F.lit(25.0 / 24.0)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), gini))
    return per.select(*by, F.when(F.col("total") < 3, F.lit(0.0)).otherwise(bounded).alias("gini"))


def distinct_sources(events: DataFrame, by: list[str], kind: str = "source_kind") -> DataFrame:
    return events.groupBy(*by).agg(F.count_distinct(kind).alias("n_sources"))


def recent_incidents(df: DataFrame, days: int, kind: str | None = None, *, day: str = "day",
                     offence: str = "offence") -> DataFrame:
    """Counts per offence within ``days`` of the latest day in the data."""
    return count_by(window_filter(df, days, day=day).filter(
        F.lit(True) if kind is None else X.match_kind(F.col(offence), kind)
    ), [offence])


def window_filter(df: DataFrame, days: int, end=None, day: str = "day") -> DataFrame:
    """Rows dated within ``days`` before the end (default: the latest day), NULL days dropped.

    The latest day is one number, read first (from Parquet statistics where the column is
    stored), so the filter is a literal that reaches the scan."""
    if end is None:
        end = df.agg(F.max(day)).first()[0]
    last = F.lit(end).cast("date")
    return df.filter(F.col(day).between(F.date_sub(last, days), last))


def lookup_join(df: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Dictionary join (offence→type, agency→normal form, factor→agency, type→factor)."""
    return hashed_join(df, table, [key], how)


def hour_profile(df: DataFrame, by: list[str], hour: str = "hour") -> DataFrame:
    """Peak hour, label, peak ratio and night share in one pass over the hour histogram."""
    hist = df.groupBy(*by, hour).agg(F.count(F.lit(1)).alias("n"))
    timed = F.when(F.col(hour).isNotNull(), F.struct(F.col("n"), -F.col(hour)))
    timed_n = F.when(F.col(hour).isNotNull(), F.col("n"))
    sizes = F.reverse(F.sort_array(F.collect_list(timed_n)))
    top3 = F.aggregate(F.slice(sizes, 1, 3), F.lit(0).cast("bigint"), lambda a, v: a + v)
    night = F.sum(F.when(D.is_night(F.col(hour)), F.col("n")).otherwise(0))
    base = F.sum(timed_n)
    return hist.groupBy(*by).agg(
        F.sum("n").alias("crimes"),
        F.max_by(hour, timed).alias("peak_hour"),
        F.coalesce(F.try_divide(top3, base), F.lit(0.0)).alias("peak_ratio"),
        F.coalesce(F.try_divide(night * 100.0, base), F.lit(0.0)).alias("night_pct"),
    )


def exists_name(names: Column, text: str) -> Column:
    return F.exists(names, lambda n: F.lower(n).contains(text.lower()))


def search_areas(areas: DataFrame, text: str, *, name: str = "name", district: str = "district",
                 members: str = "members") -> DataFrame:
    """Areas whose name, district id or any member neighbourhood contains the text."""
    q = text.strip().lower()
    hit = (
        F.lower(name).contains(q) | F.col(district).cast("string").contains(q)
        | F.coalesce(exists_name(F.col(members), q), F.lit(False))
    )
    return areas.filter(F.coalesce(hit, F.lit(False))) if q else areas

