"""Area score, street coincidence scores, risk signals and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoevents.functions import fixed_values as V
from geoevents.functions import geo as G
from geoevents.operators import spatial as S
from geoevents.operators.metrics import risk_level
from geoevents.operators.ranking import top_k_per_group


def _all():
    """One window over areas: as many rows as there are zones."""
    return Window.partitionBy()


def _or_one(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(1)).otherwise(c)


def area_score(areas: DataFrame, digits: int = 1) -> DataFrame:
    """Parts and total of the area score from ``crimes, peak_ratio, factors, tips, has_report``."""
    p = V.AREA_SCORE_PARTS
    top = lambda c: _or_one(F.max(c).over(_all()))
    crime = F.col("crimes") / top("crimes") * p["crime"]
    peak = F.col("peak_ratio") * p["peak"]
    factors = F.col("factors") / top("factors") * p["factors"]
    tips = F.col("tips") / top("tips") * p["tips"]
    report = F.when(F.col("has_report"), F.lit(p["report"])).otherwise(F.lit(0.0))
    return areas.withColumns({
        "score": F.round(crime + peak + factors + tips + report, digits),
        "part_crime": F.round(crime, digits), "part_peak": F.round(peak, digits),
        "part_factors": F.round(factors, digits), "part_tips": F.round(tips, digits),
        "part_report": report,
    })


def reweight_score(scored: DataFrame, weights: dict[str, float] | None = None, out: str = "weighted") -> DataFrame:
    """The four parts rescaled to 0..1 under user weights (their sum 0 counts as 1), plus bonus."""
    w = weights or V.ROSTER_WEIGHTS
    total = sum(w.values()) or 1.0
    p = V.AREA_SCORE_PARTS
    value = (
        F.col("part_crime") / p["crime"] * (w["mancha"] / total * 100)
        + F.col("part_peak") / p["peak"] * (w["pico"] / total * 100)
        + F.col("part_factors") / p["factors"] * (w["fatores"] / total * 100)
        + F.col("part_tips") / p["tips"] * (w["dinamica"] / total * 100)
        + F.col("part_report") / p["report"] * 5
    )
    return scored.withColumn(out, G.round_half_up(value, 1))


# ------------------------------------------------------------------ street coincidence
def bingo_layers(
    streets: DataFrame, incidents: DataFrame, factors: DataFrame, tips: DataFrame,
    radius_m: float = V.BINGO_RADIUS_M,
) -> DataFrame:
    """Three booleans per street (incidents, factor near, tip near) and how many hold.

    ``streets(street, total, x, y)``; the other tables carry ``street`` normal form and metric
    ``x, y`` (NULL without coordinates: these match by equal street name only).
    """
    def layer(rows: DataFrame, out: str) -> DataFrame:
        near = S.near_any(streets, incidents, rows, radius_m)
        named = S.exact_name_fallback(streets, rows, key="street", name="street")
        return near.join(named, "street").select("street", (F.col("is_near") | F.col("named")).alias(out))

    out = streets.join(layer(factors, "has_factor"), "street", "left").join(
        layer(tips, "has_tip"), "street", "left"
    )
    out = out.withColumn("has_crime", F.col("total") > 0)
    flags = ["has_crime", "has_factor", "has_tip"]
    filled = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    return filled.withColumn("layers", sum((F.col(c).cast("int") for c in flags), F.lit(0)))


def bingo_counts(layers: DataFrame, by: list[str]) -> DataFrame:
    """Streets with at least two layers, and with all three."""
    return layers.groupBy(*by).agg(
        F.count_if(F.col("layers") >= 2).alias("n_bingo"), F.count_if(F.col("layers") >= 3).alias("n_triple")
    )


def step_points(value: Column, steps: list[tuple[int, int]]) -> Column:
    """Points of the highest step the value reaches."""
    out = F.lit(0)
    for bound, points in steps:
        out = F.when(value >= bound, F.lit(points)).otherwise(out)
    return out


def cut_label(value: Column, cuts: list[tuple[int, str]]) -> Column:
    return risk_level(value, cuts)


def subset_of(wanted: list[str], have: Column) -> Column:
    """Is every wanted element in the array?"""
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), have)) == 0


def bingo_points(streets: DataFrame) -> DataFrame:
    """0–10 points per street from ``total, n_factor_types, n_tips, has_camera``."""
    total = F.col("total")
    return streets.withColumns({
        "p_crime": step_points(total, list(zip(V.BINGO_CRIME_THRESHOLDS, V.BINGO_CRIME_SCORES))),
        "p_factors": step_points(F.col("n_factor_types"), list(zip(V.BINGO_FACTOR_THRESHOLDS, V.BINGO_FACTOR_SCORES))),
        "p_tips": step_points(F.col("n_tips"), list(zip(V.BINGO_TIP_THRESHOLDS, V.BINGO_TIP_SCORES))),
        "p_camera": F.when((total >= V.BINGO_BLIND_SPOT_CRIMES) & ~F.col("has_camera"), 1).otherwise(0),
    }).withColumn(
        "points", F.least(F.lit(10), F.col("p_crime") + F.col("p_factors") + F.col("p_tips") + F.col("p_camera"))
    ).withColumn("priority", cut_label(F.col("points"), V.BINGO_PRIORITY))


def bingo_combos(factor_types: Column, combos: list[list[str]] | None = None) -> Column:
    """Names of the high-risk factor pairs present."""
    named = [
        F.when(subset_of(c, factor_types), F.lit("Combo de alto risco: " + " + ".join(sorted(c))))
        for c in (combos or V.BINGO_COMBOS)
    ]
    return F.array_compact(F.array(*named))


def bingo_streets(
    streets: DataFrame, factors: DataFrame, tips: DataFrame, keys: list[str], has_camera: DataFrame | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """All streets with their factors and tips, scored."""
    joined = streets.join(factors, keys, "left").join(tips, keys, "left")
    if has_camera is not None:
        joined = joined.join(has_camera, by or keys, "left")
    elif "has_camera" not in joined.columns:
        joined = joined.withColumn("has_camera", F.lit(False))
    empty = F.array().cast("array<string>")
    filled = joined.withColumns({
        "factor_types": F.coalesce("factor_types", empty), "n_tips": F.coalesce("n_tips", F.lit(0)),
        "has_camera": F.coalesce("has_camera", F.lit(False)),
    }).withColumn("n_factor_types", F.size(F.array_distinct("factor_types")))
    return bingo_points(filled).withColumn("combos", bingo_combos(F.col("factor_types")))


def bingo_area(
    streets: DataFrame, factors: DataFrame, tips: DataFrame, keys: list[str], has_camera: DataFrame | None = None,
    by: list[str] | None = None, top_n: int = 20,
) -> DataFrame:
    """The top n of ``bingo_streets`` (per area when ``by``)."""
    scored = bingo_streets(streets, factors, tips, keys, has_camera, by)
    order = [F.desc("points"), F.desc("total"), F.col(keys[-1])]
    return top_k_per_group(scored, by, order, top_n) if by else scored.orderBy(*order).limit(top_n)


def bingo_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Streets per priority."""
    level = lambda p: F.count_if(F.col("priority") == p).alias(f"n_{p.lower()}")
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_streets"), *[level(p) for _, p in V.BINGO_PRIORITY])


# ------------------------------------------------------------------ areas compared
AREA_METRICS = ["score", "crimes", "night_pct", "factors", "n_triple", "tips"]


def rank_areas(areas: DataFrame, metric: str = "score", key: str = "zone_id") -> DataFrame:
    """Rank by one metric, with its share of the total."""
    if metric not in AREA_METRICS:
        raise ValueError(f"metric must be one of {AREA_METRICS}")
    order = Window.orderBy(F.desc(metric), key)
    share = F.try_divide(F.col(metric) * 100.0, F.sum(metric).over(_all()))
    return areas.select(
        F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(_all()).alias("of"), key,
        F.col(metric).alias("value"), share.alias("share_pct"),
    )


def risk_percentile_flags(areas: DataFrame, key: str = "zone_id") -> DataFrame:
    """Warning labels per area, in their fixed order."""
    median = F.percentile("crimes", F.lit(0.5)).over(_all())
    top3 = F.row_number().over(Window.orderBy(F.desc("factors"), key)) <= 3
    flags = areas.withColumns({"_median": median, "_top3": top3})
    rule = lambda cond, label: F.when(cond, F.lit(label))
    labels = F.array(
        rule(F.col("crimes") > F.col("_median"), "ALTO VOLUME CRIMINAL"),
        rule(F.col("cameras") == 0, "SEM CÂMERAS"),
        rule(F.col("night_pct") > 60, "ALTO ÍNDICE NOTURNO"),
        rule(F.col("territories") > 5, "PROXIMIDADE ORCRIM"),
        rule(~F.col("has_report"), "SEM RELINT"),
        rule(F.col("_top3"), "ALTA DENSIDADE DE FATORES"),
        rule(F.col("n_triple") > 3, "TRIPLE BINGO ELEVADO"),
        rule(F.col("n_gaps") > 3, "PONTOS CEGOS DE CÂMERA"),
    )
    return flags.select(key, F.array_compact(labels).alias("flags"))


def radar_normalise(areas: DataFrame, metrics: list[str], key: str = "zone_id") -> DataFrame:
    """Each metric divided by its maximum over areas (at least 1), long form."""
    scaled = areas.withColumns({
        m: F.col(m) / F.greatest(F.max(m).over(_all()), F.lit(1)) for m in metrics
    })
    return scaled.unpivot([key], metrics, "axis", "value")


def risk_forecast(streets: DataFrame, hours: DataFrame, by: list[str], at_hour: int | None = None,
                  round_digits: int | None = 0) -> DataFrame:
    """Heuristic risk per street for an hour (default: the street's own peak hour).

    45·volume/max + 25 around the peak (3 less per hour away) + 20·hour share + 10·layers/3.
    ``hours(by, hour, n)`` is the area's hour histogram.
    """
    h = F.lit(at_hour) if at_hour is not None else F.col("peak_hour")
    keyed = streets.withColumn("hour", h.cast("int"))
    busiest = hours.groupBy(*by).agg(F.greatest(F.max("n"), F.lit(1)).alias("_hmax"))
    joined = keyed.join(hours.select(*by, F.col("hour").cast("int").alias("hour"), "n"), [*by, "hour"], "left")
    joined = joined.join(busiest, by, "left")
    top = F.greatest(F.max("total").over(Window.partitionBy(*by)), F.lit(1))
    away = F.abs(F.col("hour") - F.col("peak_hour"))
    parts = joined.withColumns({
        "p_base": F.col("total") / top * 45.0,
        "p_peak": F.when(away <= 1, F.lit(25.0)).otherwise(F.greatest(F.lit(0.0), 25.0 - away * 3.0)),
        "p_hour": F.coalesce("n", F.lit(0)) / F.coalesce("_hmax", F.lit(1)) * 20.0,
        "p_layers": F.least(F.coalesce("layers", F.lit(0)), F.lit(3)) / 3.0 * 10.0,
    })
    risk = F.least(F.lit(100.0), F.col("p_base") + F.col("p_peak") + F.col("p_hour") + F.col("p_layers"))
    if round_digits is not None:
        risk = G.round_half_up(risk, round_digits)
    drivers = F.array_compact(F.array(
        F.when(F.col("p_base") > 25, F.lit("alto volume histórico de crimes")),
        F.when(F.col("p_peak") >= 20, F.concat(F.lit("coincide com a hora de pico ("), F.col("peak_hour").cast("string"), F.lit("h)"))),
        F.when(F.col("p_hour") > 10, F.concat(F.col("hour").cast("string"), F.lit("h é horário movimentado na área"))),
        F.when(F.col("p_layers") > 5, F.lit("sobreposição de fatores urbanos")),
    ))
    return parts.select(*by, "street", "hour", risk.alias("risk_score"), drivers.alias("drivers"))


def area_percentages(areas: DataFrame) -> DataFrame:
    """Risk level and colour band of the score."""
    return areas.withColumns({
        "level": risk_level(F.col("score")), "band": risk_level(F.col("score"), V.RISK_COLOURS),
    })
