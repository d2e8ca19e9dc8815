"""The area document from one long table.

All layers are put under each other, placed in their zones by one join and written once. Every row then says by itself what it
counts for: a list of (part, first key, second key), so that one grouped pass makes all counts of all parts; this is what
grouping sets do, but each layer only takes part in its own sets. One ranked cut keeps of every part what a document shows, and
one grouping by zone turns the parts into lists. Beside it stand what no count can tell: points to show, streets with layers near,
camera gaps, and population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoevents.functions import fixed_values as V
from geoevents.functions import geo as G
from geoevents.functions import temporal as D
from geoevents.functions import text as X
from geoevents.operators import graph as N
from geoevents.operators import metrics as M
from geoevents.operators import scoring as C
from geoevents.operators import series as T
from geoevents.operators import spatial as S
from geoevents.session import cut

#: Entries of a part in a document; parts that are not named are bounded by themselves.
SHOWN = {"call_type": 20, "factor_type": 5}
POINTS, NARRATIVES, PER_OFFENCE, STREETS, MONTHS = 1000, 400, 200, 10, 24
_COLUMNS = ["id", "lat", "lon", "hour", "weekday", "day", "offence", "aisp", "risp", "street", "kind", "agency", "status", "due", "text"]


def long_layers(layers, index: DataFrame, cell_size: float) -> DataFrame:
    """(zone_id, layer, x, y, …): every point of every layer in its zones; a column that a layer does not have is NULL."""
    named = {"incident": layers.incidents, "tip": layers.tips, "factor": layers.factors,
             "camera": layers.cameras.withColumnRenamed("camera_id", "id"), "call": layers.calls, "person": layers.street_people}
    rows = None
    for name, df in named.items():
        if df is not None:
            part = df.select(F.lit(name).alias("layer"), *[c for c in _COLUMNS if c in df.columns])
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    missing = [F.lit(None).cast("string").alias(c) for c in _COLUMNS if c not in rows.columns]
    return G.with_metric(S.join_points_to_zones(rows.select("*", *missing), index, how="inner", cell_size=cell_size))


def _memberships() -> Column:
    """What a row counts for: an array of (part, k1, k2)."""
    def fact(part: str, k1: Column | str = "", k2: Column | str = "") -> Column:
        as_text = lambda k: F.lit(k) if isinstance(k, str) else k.cast("string")
        return F.struct(F.lit(part).alias("part"), as_text(k1).alias("k1"), as_text(k2).alias("k2"))

    c = F.col
    own = {
        "incident": [fact("hour", c("hour")), fact("weekday", c("weekday")), fact("offence", c("offence")), fact("month", D.month_key(c("day"))),
                     fact("aisp", c("aisp")), fact("risp", c("risp")), fact("street_hour", c("street"), c("hour"))],
        "factor": [fact("factor_agency", c("agency")), fact("factor_type", c("agency"), c("kind"))],
        "call": [fact("call_type", c("kind"), c("agency")), fact("call_agency", c("agency"))],
    }
    whole = fact("all", c("layer"))
    modus = F.transform(X.extract_modus(c("text")), lambda m: fact("modus", m))
    out = F.when(c("layer") == "tip", F.concat(F.array(whole), F.coalesce(modus, F.array().cast("array<struct<part:string,k1:string,k2:string>>"))))
    for name, facts in own.items():
        out = out.when(c("layer") == name, F.array(whole, *facts))
    return out.otherwise(F.array(whole))


def long_counts(rows: DataFrame) -> DataFrame:
    """(zone_id, part, k1, k2) with counts and sums: one pass over all rows."""
    said = rows.select(
        "zone_id", F.explode(_memberships()).alias("f"), "lat", "lon", D.is_night(F.col("hour")).alias("night"), "hour",
        M.served_equal(F.col("status")).alias("equal"), M.served_contains(F.col("status")).alias("contains"),
        M.served_prefix(F.col("status")).alias("prefix"), F.coalesce(F.col("due") == "Vencido", F.lit(False)).alias("late"))
    return said.groupBy("zone_id", "f.part", "f.k1", "f.k2").agg(
        F.count(F.lit(1)).alias("n"), F.sum("lat").alias("s_lat"), F.count("lat").alias("n_lat"), F.sum("lon").alias("s_lon"),
        F.count("hour").alias("timed"), F.count_if("night").alias("night"), F.count_if("equal").alias("n_equal"),
        F.count_if("contains").alias("n_contains"), F.count_if("prefix").alias("n_prefix"), F.count_if("late").alias("n_late"))


def _street_table(counts: DataFrame) -> DataFrame:
    """Streets from the counts by street and hour, the busiest per zone."""
    hourly = counts.filter("part = 'street_hour' and k1 is not null").withColumn("hour", F.col("k2").cast("int"))
    streets = hourly.groupBy("zone_id", F.col("k1").alias("street")).agg(
        F.sum("n").alias("total"), F.try_divide(F.sum("s_lat"), F.sum("n_lat")).alias("lat"), F.try_divide(F.sum("s_lon"), F.sum("n_lat")).alias("lon"),
        F.coalesce(F.max_by("hour", F.when(F.col("hour").isNotNull(), F.struct("n", -F.col("hour")))), F.lit(0)).alias("peak_hour"))
    order = Window.partitionBy("zone_id").orderBy(F.desc("total"), "street")
    ranked = streets.withColumn("street_rank", F.row_number().over(order)).filter(F.col("street_rank") <= STREETS)
    return ranked.filter(F.length("street") > 3)


def _street_layers(streets: DataFrame, rows: DataFrame) -> DataFrame:
    """The shown streets with what lies within reach of their incidents, in the same zone."""
    unit = streets.select("zone_id", "street")
    own = rows.filter("layer = 'incident'").join(unit, ["zone_id", "street"], "left_semi").select("zone_id", "street", "x", "y").distinct()
    flags = streets
    for layer, name in (("factor", "has_factor"), ("tip", "has_tip")):
        near = S.within_radius(own, rows.filter(F.col("layer") == layer), V.BINGO_RADIUS_M, on=["zone_id"]).select("zone_id", "street").distinct()
        flags = flags.join(near.withColumn(name, F.lit(True)), ["zone_id", "street"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return flags.withColumn("layers", F.lit(1) + F.col("has_factor").cast("int") + F.col("has_tip").cast("int"))


def _shown_points(rows: DataFrame) -> DataFrame:
    """Points to show, all layers in one ranked cut: narratives first among tips, a seeded choice per offence, else by id."""
    layer = F.col("layer")
    first = F.when(layer == "incident", F.xxhash64("id", F.lit(42))).when(layer == "tip", F.col("text").isNull().cast("bigint")).otherwise(0)
    stratum = F.when(layer == "incident", F.coalesce("offence", F.lit("")))
    most = F.when(layer == "incident", PER_OFFENCE).when(layer == "tip", NARRATIVES).otherwise(POINTS)
    order = Window.partitionBy("zone_id", "layer", "_s").orderBy("_o", "id")
    kept = rows.filter("layer <> 'call'").withColumns({"_s": stratum, "_o": first})
    kept = kept.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= POINTS) & (F.col("_r") <= most))

    def of(name: str, *cols: Column | str) -> Column:
        place = F.struct(*["_r" if name == "tip" else "id", F.struct("id", "lat", "lon", *cols).alias("v")])
        return F.transform(F.sort_array(F.collect_list(F.when(layer == name, place))), lambda s: s["v"])

    text = F.left("text", F.lit(300)).alias("text")
    return kept.withColumn("modus", F.when(layer == "tip", X.extract_modus(F.col("text")))).groupBy("zone_id").agg(
        of("incident", "offence", "hour").alias("incident_points"), of("tip", "kind", text, "modus").alias("tip_points"),
        of("factor", "kind", "agency").alias("factor_points"), of("camera").alias("camera_points"), of("person").alias("street_people_points"))


def _parts(counts: DataFrame) -> DataFrame:
    """One row per zone: its parts as lists, after one ranked cut."""
    part, k1, k2, n = F.col("part"), F.col("k1"), F.col("k2"), F.col("n")
    group = F.when(part == "factor_type", k1)
    order = Window.partitionBy("zone_id", "part", "_g").orderBy(F.when(part == "month", k1).desc(), n.desc(), k1, k2)
    limit = F.when(part == "month", MONTHS)
    for name, most in SHOWN.items():
        limit = limit.when(part == name, most)
    shown = counts.filter("part <> 'street_hour'").filter(part.isin("all", "call_type", "factor_type", "modus", "offence") | k1.isNotNull())
    shown = shown.withColumn("_g", group).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.coalesce(limit, F.lit(1 << 30)))
    facts = F.collect_list(F.struct("part", "r", "k1", "k2", "n", "n_lat", "timed", "night", "n_equal", "n_contains", "n_prefix", "n_late"))
    zones = shown.groupBy("zone_id").agg(facts.alias("facts"))

    def of(name: str) -> Column:
        return F.filter("facts", lambda f: f["part"] == name)

    def listed(name: str, make, key=None) -> Column:
        """The part's entries by rank, or by ``key``; NULL where it has none."""
        order_by = key or (lambda f: f["r"])
        keyed = F.transform(of(name), lambda f: F.struct(order_by(f).alias("o"), make(f).alias("v")))
        return F.when(F.size(of(name)) > 0, F.transform(F.array_sort(keyed), lambda s: s["v"]))

    def one(layer: str, field: str) -> Column:
        return F.element_at(F.transform(F.filter(of("all"), lambda f: f["k1"] == layer), lambda f: f[field]), 1)

    count = lambda layer: F.coalesce(one(layer, "n"), F.lit(0))
    pair = lambda name, cast: lambda f: F.struct(f["k1"].cast(cast).alias(name), f["n"].alias("n"))
    number = lambda f: f["k1"].cast("int")
    mode = lambda name: F.element_at(F.transform(F.array_sort(F.transform(of(name), lambda f: F.struct((-f["n"]).alias("n"), f["k1"].cast("int").alias("k")))), lambda s: s["k"]), 1)
    sizes = F.reverse(F.array_sort(F.transform(of("hour"), lambda f: f["n"])))
    top3 = F.aggregate(F.slice(sizes, 1, 3), F.lit(0).cast("bigint"), lambda a, x: a + x)
    types = of("factor_type")
    calls = F.struct(
        one("call", "n").alias("total"), one("call", "n_lat").alias("with_coords"),
        (one("call", "n_equal") * 100.0 / one("call", "n")).alias("pct_served"), (one("call", "n_late") * 100.0 / one("call", "n")).alias("pct_overdue"),
        listed("call_type", lambda f: F.struct(f["k1"].alias("kind"), f["k2"].alias("agency"), f["n"].alias("total"), f["n_contains"].alias("served"),
                                               f["n_late"].alias("overdue"))).alias("by_type"))
    return zones.select(
        "zone_id", count("incident").alias("crimes"), count("tip").alias("tips"), count("factor").alias("factors"), count("camera").alias("cameras"),
        count("person").alias("street_people"), F.coalesce(F.try_divide(top3, one("incident", "timed")), F.lit(0.0)).alias("peak_ratio"),
        F.coalesce(F.round(F.try_divide(one("incident", "night") * 100.0, one("incident", "timed")), 1), F.lit(0.0)).alias("night_pct"),
        listed("hour", pair("hour", "int"), number).alias("hours"), listed("weekday", pair("weekday", "int"), number).alias("weekdays"),
        listed("offence", pair("offence", "string")).alias("by_offence"),
        listed("month", lambda f: F.struct(F.left(f["k1"], F.lit(7)).alias("month"), f["n"].alias("n")), lambda f: f["k1"]).alias("monthly"),
        listed("modus", pair("modus", "string")).alias("modus"), mode("aisp").alias("aisp"), mode("risp").alias("risp"),
        listed("factor_agency", lambda a: F.struct(
            a["k1"].alias("agency"), a["n"].alias("total"),
            F.transform(F.array_sort(F.transform(F.filter(types, lambda t: (t["k1"] == a["k1"]) & t["k2"].isNotNull()),
                                                 lambda t: F.struct(t["r"].alias("r"), t["k2"].alias("tipo"), t["n"].alias("count")))),
                        lambda t: F.struct(t["tipo"].alias("tipo"), t["count"].alias("count"))).alias("tipos"))).alias("factors_by_agency"),
        F.when(one("call", "n").isNotNull(), calls).alias("calls"))


def _cross_validation(counts: DataFrame) -> DataFrame:
    """Field factors against calls per agency normal form, every spelling of a factor's agency for itself."""
    spelt = counts.filter("part = 'factor_agency' and k1 is not null").select("zone_id", F.col("k1").alias("agency"), F.col("n").alias("field_factors"))
    spelt = spelt.withColumn("agency_norm", X.norm_agency(F.col("agency")))
    called = counts.filter("part = 'call_agency'").withColumn("agency_norm", X.norm_agency(F.coalesce("k1", F.lit("None"))))
    called = called.groupBy("zone_id", "agency_norm").agg(
        F.sum("n").alias("calls"), F.sum("n_prefix").alias("served"), F.sum("n_late").alias("overdue"))
    met = spelt.join(called, ["zone_id", "agency_norm"], "left")
    met = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("calls", "served", "overdue")}).withColumn("validated", F.col("calls") > 0)
    entry = F.struct(-F.col("field_factors"), "agency", F.struct("agency", "agency_norm", "field_factors", "calls", "served", "overdue", "validated").alias("v"))
    return met.groupBy("zone_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda s: s["v"]).alias("cross_validation"))


def documents(layers, index: DataFrame, cell_size: float = S.CELL_DEG) -> DataFrame:
    """One nested document per zone: identification, measures, scores, streets with their layers, camera gaps, factors,
    narratives, series with trend, calls, cross validation, population, report sections and map points."""
    from geoevents.plans.area_report import area_population

    rows = cut(long_layers(layers, index, cell_size))
    counts = cut(long_counts(rows))
    streets = _street_layers(cut(_street_table(counts)), rows)
    street = F.struct("street_rank", F.struct("street", "total", "lat", "lon", "peak_hour", "has_factor", "has_tip", "layers").alias("v"))
    gaps = N.top_gaps(N.scored_gaps(rows.filter("layer = 'incident'"), rows.filter("layer = 'camera'").withColumnRenamed("id", "camera_id"),
                                    by=["zone_id"]), by=["zone_id"])
    gap = F.struct(-F.col("priority"), "cluster_id", F.struct("n", "nearest_camera_m", "priority", "recommendation", "lat", "lon").alias("v"))
    nested = lambda df, entry, name: df.groupBy("zone_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda s: s["v"]).alias(name))
    monthly = counts.filter("part = 'month' and k1 is not null").select("zone_id", F.col("k1").cast("date").alias("month"), "n")
    trend = T.trend_of(monthly, ["zone_id"], with_p=False)
    reports = layers.reports.select("zone_id", F.lit(True).alias("has_report")).distinct()
    out = layers.zones.select("zone_id", "name", "zone_order").join(_parts(counts), "zone_id", "left").join(reports, "zone_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("crimes", "tips", "factors", "cameras", "street_people")}
    out = C.area_score(out.withColumns({**zero, "has_report": F.coalesce("has_report", F.lit(False)),
                                        **{c: F.coalesce(c, F.lit(0.0)) for c in ("peak_ratio", "night_pct")}}))
    parts = [nested(streets, street, "top_streets"), nested(gaps, gap, "camera_gaps"), _shown_points(rows), _cross_validation(counts),
             trend.select("zone_id", F.struct("direction", "significant", "trend_delta_pct", "peak_month", "badge").alias("trend"))]
    if layers.neighbourhoods is not None and layers.census is not None:
        parts.append(area_population(layers))
    if layers.report_texts is not None:
        parts.append(layers.report_texts.select("zone_id", F.col("sections").alias("report_sections")))
    for part in parts:
        out = out.join(part, "zone_id", "left")
    reached = lambda n: F.coalesce(F.size(F.filter("top_streets", lambda s: s["layers"] >= n)), F.lit(0))
    out = out.withColumns({"base": X.base_label(F.col("name")), "n_bingo": reached(2), "n_triple": reached(3)})
    if "population_inside" in out.columns:
        out = out.withColumn("crimes_per_1000", F.round(F.try_divide(F.col("crimes") * 1000.0, F.nullif("population_inside", F.lit(0.0))), 1))
    return out
