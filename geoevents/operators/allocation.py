"""Fleet allocation, shift split, rosters and street positions.

All of it works on one row per area (or per area and shift), in windows per plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoevents.functions import fixed_values as V
from geoevents.functions import geo as G
from geoevents.functions import temporal as D
from geoevents.operators.metrics import risk_level
from geoevents.operators.ranking import top_k_per_group
from geoevents.operators.scoring import reweight_score


def overflow_redistribute(df: DataFrame, plan: list[str], value: str, cap: Column, out: str) -> DataFrame:
    """Values cut at the cap; what was cut goes to the uncut ones in proportion (one pass)."""
    w = Window.partitionBy(*plan)
    v = F.col(value)
    capped = F.least(v, cap)
    overflow = F.sum(v - capped).over(w)
    pool = F.sum(F.when(capped < cap, capped)).over(w)
    share = F.when((capped < cap) & (pool > 0), capped + overflow * (capped / pool))
    return df.withColumn(out, F.coalesce(share, capped))


def largest_remainder(df: DataFrame, plan: list[str], value: str, total: Column, key: list[Column], out: str) -> DataFrame:
    """Whole numbers summing to the total: floors, then one each to the largest fractions,
    going round again when more are missing than there are rows."""
    w = Window.partitionBy(*plan)
    floor = F.floor(value).cast("bigint")
    place = F.row_number().over(w.orderBy(F.desc(F.col(value) - floor), *key)) - 1
    missing = F.greatest(total - F.sum(floor).over(w), F.lit(0))
    rows = F.count(F.lit(1)).over(w)
    df = df.withColumns({"_f": floor, "_p": place, "_m": missing, "_r": rows})
    extra = F.floor(F.col("_m") / F.col("_r")) + (F.col("_p") < F.col("_m") % F.col("_r")).cast("int")
    return df.withColumn(out, (F.col("_f") + extra).cast("bigint")).drop("_f", "_p", "_m", "_r")


def allocate_fleet(
    scores: DataFrame, *, fleet_size: int = V.FLEET_SIZE, floor_agents: int = V.FLEET_FLOOR,
    max_share: float = V.FLEET_MAX_SHARE, plan: list[str] | None = None, area: str = "area",
    score: str = "final_score",
) -> DataFrame:
    """Agents per area: a floor each (smaller when it cannot be met), the rest in proportion to
    the score, a cap on any share, exact sum by largest remainder."""
    plan = plan or []
    w = Window.partitionBy(*plan)
    n = F.count(F.lit(1)).over(w)
    base = F.when(
        n * floor_agents >= fleet_size, F.greatest(F.lit(1), F.floor(F.lit(fleet_size) / (n * 2)))
    ).otherwise(F.lit(floor_agents))
    weight = F.greatest(F.col(score), F.lit(0.1))
    df = scores.withColumns({"_base": base, "_n": n})
    raw = F.col("_base") + weight / F.sum(weight).over(w) * (F.lit(fleet_size) - F.col("_base") * F.col("_n"))
    cap = F.lit(float(int(fleet_size * max_share)))
    df = overflow_redistribute(df.withColumn("_raw", raw), plan, "_raw", cap, "_capped")
    df = largest_remainder(df, plan, "_capped", F.lit(fleet_size), [F.desc(score), F.col(area)], "agents")
    return df.withColumn("share_of_fleet", F.round(F.col("agents") / fleet_size, 4)).drop("_base", "_n", "_raw", "_capped")


def shift_split(
    allocated: DataFrame, top_event_hours: DataFrame, *, plan: list[str] | None = None, area: str = "area",
    concentration: str = "gini",
) -> DataFrame:
    """Agents per day-part: default shares blended with those of the top events by the area's
    hour concentration; floors, the rest to the largest share. Day-parts of 0 are left out."""
    keys = [*(plan or []), area]
    parts = list(V.SHIFT_WEIGHTS)
    hours = top_event_hours.filter(F.col("hour").isNotNull()).select(*keys, D.daypart6(F.col("hour")).alias("daypart"))
    counts = hours.groupBy(*keys, "daypart").agg(F.count(F.lit(1)).alias("k"))
    spine = allocated.select(*keys, "agents", F.col(concentration).alias("c")).withColumn(
        "daypart", F.explode(F.array(*[F.lit(p) for p in parts]))
    )
    default = F.element_at(F.create_map(*[F.lit(x) for kv in V.SHIFT_WEIGHTS.items() for x in kv]), F.col("daypart"))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in zip(parts, range(len(parts))) for x in kv]), F.col("daypart"))
    df = spine.join(counts, [*keys, "daypart"], "left").withColumns({"d": default, "part_order": order})
    w = Window.partitionBy(*keys)
    total = F.sum("k").over(w)
    blend = F.when(total.isNull(), F.col("d")).otherwise(
        (F.lit(1.0) - F.col("c")) * F.col("d") + F.col("c") * F.coalesce("k", F.lit(0)) / total
    )
    df = df.withColumn("_b", blend)
    df = df.withColumn("weight", F.when(F.sum("_b").over(w) == 0, F.col("d")).otherwise(F.col("_b") / F.sum("_b").over(w)))
    df = df.withColumn("_f", F.floor(F.col("agents") * F.col("weight")).cast("bigint"))
    first = F.row_number().over(w.orderBy(F.desc("weight"), "part_order")) == 1
    left = F.col("agents") - F.sum("_f").over(w)
    out = df.withColumns({"shift_agents": F.col("_f") + F.when(first, left).otherwise(0)})
    rationale = (
        F.when(F.col("c") >= 0.5, F.concat(
            F.lit("Concentração temporal alta ("), F.format_string("%.0f", F.col("c") * 100),
            F.lit("%) — efetivo enviesado para o turno-pico.")))
        .when(F.col("c") >= 0.3, F.concat(
            F.lit("Concentração temporal moderada ("), F.format_string("%.0f", F.col("c") * 100), F.lit("%).")))
        .otherwise("Distribuição padrão (concentração temporal baixa).")
    )
    return out.filter(F.col("shift_agents") > 0).select(
        *keys, "daypart", F.col("shift_agents").alias("agents"), "weight", rationale.alias("rationale")
    )


def reason_text(reasons: Column, n: int = 3) -> Column:
    """The first n reasons as short texts."""
    def one(r: Column) -> Column:
        suffix = F.when(r["is_multiplier"], F.format_string(" (×%.2f)", r["delta"])).otherwise(
            F.format_string(" (+%.0f)", r["delta"]))
        tail = F.when(F.coalesce(r["evidence"], F.lit("")) != "", F.concat(F.lit(" — "), r["evidence"])).otherwise("")
        return F.concat(r["label"], suffix, tail)

    return F.transform(F.slice(reasons, 1, n), one)


def suggest_actions(reasons: Column, limit: int = 4, look_at: int = 8) -> Column:
    """Action texts for the first reasons, in reason order, at most ``limit``."""
    def one(r: Column) -> Column:
        out = None
        for code, prefix, text in V.ACTION_TEXT:
            cond = r["code"].startswith(code) if prefix else r["code"] == code
            if code == "weapon.":
                cond = cond & (r["delta"] >= V.ACTION_WEAPON_MIN_DELTA)
            out = F.when(cond, text) if out is None else out.when(cond, text)
        return out

    return F.slice(F.array_compact(F.transform(F.slice(reasons, 1, look_at), one)), 1, limit)


# ------------------------------------------------------------------ rosters
def roster_plan(scored: DataFrame, hours: DataFrame, weekdays: DataFrame, *, key: str = "zone_id",
                weights: dict[str, float] | None = None) -> DataFrame:
    """Agents per area over the floor, per shift, peak windows, busiest days, risk level.

    ``scored`` has the area-score parts and ``street_people``; ``hours(key, hour, n)`` and
    ``weekdays(key, weekday, n)`` are histograms.
    """
    df = reweight_score(scored, weights, "roster_score")
    w = Window.partitionBy()   # one row per area
    total = F.sum("roster_score").over(w)
    extra = F.lit(V.ROSTER_AGENTS) - F.lit(V.ROSTER_FLOOR) * F.count(F.lit(1)).over(w)
    share = F.col("roster_score") / F.when(total == 0, F.lit(1.0)).otherwise(total)
    df = df.withColumn("agents", (F.lit(V.ROSTER_FLOOR) + G.round_half_up(extra * share)).cast("bigint"))
    df = df.withColumns({
        "agents_per_shift": G.round_half_up(F.col("agents") / V.ROSTER_SHIFTS).cast("bigint"),
        "pct_of_force": G.round_half_up(F.col("agents") / V.ROSTER_AGENTS * 100).cast("bigint"),
        "risk": risk_level(F.col("roster_score")),
        "street_people_alert": F.col("street_people") > 200,
    })
    peaks = top_k_per_group(hours, [key], [F.desc("n"), F.col("hour")], 2, rank="k").groupBy(key).agg(
        F.max(F.when(F.col("k") == 1, F.col("hour"))).alias("h1"),
        F.max(F.when(F.col("k") == 2, F.col("hour"))).alias("h2"),
    )
    days = top_k_per_group(weekdays, [key], [F.desc("n"), F.col("weekday")], 3, rank="k").groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "weekday"))), lambda s: s["weekday"].cast("string")), ",").alias("critical_days")
    )
    df = df.join(peaks, key, "left").join(days, key, "left")
    h1, h2 = F.coalesce("h1", F.lit(20)), F.coalesce("h2", F.lit(21))
    return df.withColumns({
        "priority_shift": D.window_label(h1, h1 + 3), "hour_window": D.window_label(h1 - 1, h2 + 2),
    }).drop("h1", "h2")


def _thousands(c: Column) -> Column:
    """Whole number with points between thousands."""
    return F.translate(F.format_number(c, 0), ",", ".")


def _plain(c: Column) -> Column:
    """A number with one digit at most, none for whole numbers."""
    one = F.round(c, 1)
    return F.when(one == F.floor(one), one.cast("bigint").cast("string")).otherwise(one.cast("string"))


def mode_rationale() -> Column:
    """Why a mode is sent, by ``mode`` and the measures ``s_pe, night_pct, s_armed, street_people``."""
    measures = {
        "pe": (F.coalesce("s_pe", F.lit(0.0)), lambda c: G.round_half_up(c).cast("bigint").cast("string")),
        "moto": (F.coalesce("night_pct", F.lit(0.0)), _plain),
        "viatura": (F.coalesce("s_armed", F.lit(0.0)), lambda c: G.round_half_up(c).cast("bigint").cast("string")),
    }
    out = None
    for mode, (text, bound, plain) in V.MODE_RATIONALE.items():
        if mode == "social":
            said = F.replace(F.lit(text), F.lit("%s"), _thousands(F.col("street_people")))
        elif bound is None:
            said = F.lit(plain)
        else:
            value, show = measures[mode]
            said = F.when(value > bound, F.replace(F.lit(text), F.lit("%s"), show(value))).otherwise(F.lit(plain))
        out = F.when(F.col("mode") == mode, said) if out is None else out.when(F.col("mode") == mode, said)
    return out


def mode_mix(roster: DataFrame, modus: DataFrame, *, key: str = "zone_id", name: str = "name") -> DataFrame:
    """Patrol modes per area in long form (mode, agents, pct, rationale); what rounding leaves goes to foot.

    ``modus(key, modus, n)`` are tag counts; ``roster`` has ``agents_per_shift, night_pct,
    street_people`` and the area name.
    """
    share = lambda tag: F.coalesce(F.try_divide(F.sum(F.when(F.col("modus") == tag, F.col("n"))) * 100.0, F.sum("n")), F.lit(0.0))
    shares = modus.groupBy(key).agg(
        share("motocicleta").alias("s_moto"), share("a_pe").alias("s_pe"),
        share("armado").alias("s_armed"), share("em_grupo").alias("s_group"),
    )
    df = roster.join(shares, key, "left")
    hot = lambda c, bound: F.coalesce(F.col(c) > bound, F.lit(False))
    add = lambda cond, n: F.when(cond, F.lit(n)).otherwise(F.lit(0))
    moto, on_foot, armed, group = hot("s_moto", 10), hot("s_pe", 40), hot("s_armed", 20), hot("s_group", 25)
    night = hot("night_pct", 65)
    many, some = hot("street_people", 500), hot("street_people", 200)
    social = F.when(many, 12).when(some, 7).otherwise(0)
    by_bike = F.lit(False)
    for word in V.BICYCLE_AREAS:
        by_bike = by_bike | F.lower(name).contains(word)
    b = V.MODE_BASE
    bike = F.lit(b["bicicleta"]) - add(moto, 5)
    ratios = {
        "pe": F.lit(b["pe"]) - add(moto, 5) + add(on_foot, 10) - add(armed, 8) - add(group, 5) - add(night, 8)
        + F.when(by_bike, F.lit(0)).otherwise(bike) - social,
        "moto": F.lit(b["moto"]) + add(moto, 10) + add(group, 5) + add(night, 8),
        "viatura": F.lit(b["viatura"]) - add(on_foot, 10) + add(armed, 8),
        "bicicleta": F.when(by_bike, bike).otherwise(F.lit(0)),
        "social": social,
    }
    df = df.withColumns({f"q_{m}": r for m, r in ratios.items()})
    whole = sum((F.col(f"q_{m}") for m in ratios), F.lit(0))
    total = F.col("agents_per_shift")
    part = lambda m: F.when(F.col(f"q_{m}") > 0, G.round_half_up(F.col(f"q_{m}") / whole * total)).otherwise(F.lit(0.0))
    df = df.withColumns({f"a_{m}": part(m).cast("bigint") for m in ratios})
    rest = total - sum((F.col(f"a_{m}") for m in ratios), F.lit(0))
    df = df.withColumn("a_pe", (F.col("a_pe") + rest).cast("bigint"))
    rows = F.array(*[
        F.struct(F.lit(i).alias("mode_order"), F.lit(m).alias("mode"), F.col(f"a_{m}").alias("mode_agents"))
        for i, m in enumerate(ratios)
    ])
    said = ["s_pe", "s_armed", "night_pct", "street_people"]
    long = df.select(key, *said, total.alias("_t"), F.explode(rows).alias("r")).select(key, *said, "_t", "r.*")
    pct = G.round_half_up(F.try_divide(F.col("mode_agents") * 100.0, F.col("_t"))).cast("bigint")
    return long.filter(F.col("mode_agents") > 0).withColumns({"pct": pct, "rationale": mode_rationale()}).drop("_t", *said)


def street_positions(
    streets: DataFrame, modes: DataFrame, *, street_people: DataFrame | None = None, key: str = "zone_id", top: int = 6,
) -> DataFrame:
    """Positions on the busiest streets: 80 % of the non-social agents by share of incidents
    (at least 2), modes in turn, shift label and focus text.

    With ``street_people(key, street_people)``, areas that have streets, social agents and more
    than 100 people counted get one more position for the social agents."""
    first = top_k_per_group(streets, [key], [F.desc("total"), F.col("street")], top, rank="position")
    patrol = modes.filter(F.col("mode") != "social").groupBy(key).agg(
        F.sum("mode_agents").alias("_agents"),
        F.transform(F.sort_array(F.collect_list(F.struct("mode_order", "mode"))), lambda s: s["mode"]).alias("_modes"),
    )
    df = first.join(patrol, key)
    share = F.col("total") / F.sum("total").over(Window.partitionBy(key))
    agents = F.greatest(F.lit(2), G.round_half_up(share * F.col("_agents") * 0.8).cast("int"))
    mode = F.element_at("_modes", (F.pmod(F.col("position") - 1, F.size("_modes")) + 1).cast("int"))
    focus = lambda c, text: F.when(F.col(c) > 0, F.concat(F.lit(text + " ("), F.col(c).cast("string"), F.lit(")")))
    bits = F.slice(F.array_compact(F.array(
        focus("n_transeunte", "roubo a transeunte"), focus("n_celular", "furto celular"),
        focus("n_coletivo", "roubo em coletivo"))), 1, 2)
    text = F.when(F.size(bits) == 0, "monitoramento geral").otherwise(F.array_join(bits, " · "))
    out = df.select(
        key, F.col("position").cast("int").alias("position"), "street", agents.alias("agents"), mode.alias("mode"),
        D.position_label(F.col("peak_hour")).alias("shift"), text.alias("focus"), F.col("total").alias("crimes"),
    )
    if street_people is None:
        return out
    place, shift, focus_text = V.STREET_PEOPLE_POSITION
    last = out.groupBy(key).agg((F.max("position") + 1).alias("position"))
    social = modes.filter(F.col("mode") == "social").select(key, F.col("mode_agents").cast("int").alias("agents"), "mode")
    many = street_people.filter(F.col("street_people") > V.STREET_PEOPLE_POSITION_MIN).select(key, "street_people")
    extra = social.join(many, key).join(last, key).select(
        key, "position", F.lit(place).alias("street"), "agents", "mode", F.lit(shift).alias("shift"),
        F.replace(F.lit(focus_text), F.lit("%s"), _thousands(F.col("street_people"))).alias("focus"), F.lit(0).cast("bigint").alias("crimes"))
    return out.unionByName(extra)
