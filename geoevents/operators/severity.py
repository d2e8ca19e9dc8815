"""Event severity and the layered score of areas and streets.

``event_severity`` is narrow (array expressions, no shuffle). ``unit_score`` aggregates once
per unit with partial aggregation; only a unit's summary, never its events, meets in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoevents.functions import fixed_values as V
from geoevents.functions import text as X
from geoevents.operators.metrics import gini_from_histogram, window_filter
from geoevents.operators.ranking import top_k_per_group
from geoevents.operators.scoring import cut_label, subset_of

REASON = "struct<kind:string,code:string,label:string,delta:double,is_multiplier:boolean,weight:double,evidence:string>"


def reason(kind: str, code, label, delta: Column, weight: Column, *, multiplier: bool = False, evidence=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(kind).alias("kind"), as_col(code).alias("code"), as_col(label).alias("label"),
        delta.cast("double").alias("delta"), F.lit(multiplier).alias("is_multiplier"),
        weight.cast("double").alias("weight"), as_col(evidence).cast("string").alias("evidence"),
    )


def _weigh(mapping: dict[str, float], key: Column) -> Column:
    return X.lookup(key, mapping, F.lit(0.0))


def _sum(values: Column) -> Column:
    return F.aggregate(F.coalesce(values, F.array().cast("array<double>")), F.lit(0.0), lambda a, v: a + v)


def _words(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def event_severity(events: DataFrame) -> DataFrame:
    """Severity parts, ``s_event`` (5..100) and the list of reasons of every nested event."""
    empty = F.array().cast("array<string>")
    crime = F.col("crime_type")
    base = X.lookup(crime, V.CRIME_TYPE_WEIGHT, F.lit(V.CRIME_TYPE_DEFAULT))

    def weapon_points(w: Column) -> Column:
        return F.when(F.coalesce(w["used"], F.lit(False)), _weigh({k: used for k, (_, used) in V.WEAPON_WEIGHT.items()}, w["type"])).when(
            F.coalesce(w["brandished"], F.lit(False)), _weigh({k: shown for k, (shown, _) in V.WEAPON_WEIGHT.items()}, w["type"])
        ).otherwise(F.lit(0.0))

    def weapon_text(w: Column) -> Column:
        mode = F.when(F.coalesce(w["used"], F.lit(False)), "+usada").otherwise("+exibida")
        return F.when(weapon_points(w) > 0, F.concat(w["type"], mode))

    def victim_points(v: Column) -> Column:
        flag = lambda f, pts: F.when(F.coalesce(v[f], F.lit(False)), F.lit(pts)).otherwise(F.lit(0.0))
        return _weigh(V.VICTIM_AGE_WEIGHT, v["age_bracket"]) + flag("exposed_item_before", V.VICTIM_EXPOSED) + flag(
            "injured", V.VICTIM_INJURED)

    any_victim = lambda test: F.coalesce(F.exists("victims", test), F.lit(False))
    killed = any_victim(lambda v: F.coalesce(v["killed"], F.lit(False)))
    victims = _sum(F.transform("victims", victim_points))
    victims = F.when(killed, F.greatest(victims, F.lit(V.VICTIM_KILLED_FLOOR))).otherwise(victims)
    many = F.coalesce(F.col("agent_count_total") >= 2, F.lit(False))
    organised = (
        F.when(many, F.lit(V.MULTI_AGENT_WEIGHT)).otherwise(F.lit(0.0))
        + _weigh(V.APPROACH_WEIGHT, F.col("approach.type")) + _weigh(V.ESCAPE_WEIGHT, F.col("escape.type"))
    )
    items = _sum(F.transform(
        "stolen_items",
        lambda i: _weigh(V.ITEM_WEIGHT, i["type"]) * F.greatest(F.coalesce(i["quantity"], F.lit(1)), F.lit(1)),
    ))
    capped = lambda c, cap: F.least(c, F.lit(cap))
    scored = events.withColumns({
        "p_type": base,
        "p_weapon": capped(_sum(F.transform("weapons", weapon_points)), V.WEAPON_CAP),
        "p_tactics": capped(_sum(F.transform(F.col("modus_operandi.tactics"), lambda t: _weigh(V.TACTIC_WEIGHT, t))), V.TACTIC_CAP),
        "p_victim": capped(victims, V.VICTIM_CAP),
        "p_outcome": capped(_weigh(V.OUTCOME_WEIGHT, F.col("outcome.status")), V.OUTCOME_CAP),
        "p_organised": capped(organised, V.ORGANISATION_CAP),
        "p_items": capped(items, V.ITEM_CAP),
    })
    parts = ["p_type", "p_weapon", "p_tactics", "p_victim", "p_outcome", "p_organised", "p_items"]
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    scored = scored.withColumn("s_event", F.least(F.greatest(total, F.lit(V.EVENT_FLOOR)), F.lit(V.EVENT_CEIL)))

    weapons = F.array_compact(F.transform(F.coalesce("weapons", F.array()), weapon_text))
    tactics = F.filter(F.coalesce(F.col("modus_operandi.tactics"), empty), lambda t: _weigh(V.TACTIC_WEIGHT, t) > 0)
    kinds = F.filter(
        F.transform(F.coalesce("stolen_items", F.array()), lambda i: i["type"]), lambda t: _weigh(V.ITEM_WEIGHT, t) > 0
    )
    victim_bits = F.concat_ws(
        ", ", F.when(killed, "vítima fatal"),
        F.when(any_victim(lambda v: F.coalesce(v["injured"], F.lit(False))), "vítima ferida"),
        F.when(any_victim(lambda v: v["age_bracket"].isin(V.VICTIM_VULNERABLE)), "vítima vulnerável (idoso/criança)"),
        F.when(any_victim(lambda v: F.coalesce(v["exposed_item_before"], F.lit(False))), "item à mostra"),
    )
    org_bits = F.concat_ws(
        ", ", F.when(many, F.concat(F.col("agent_count_total").cast("string"), F.lit(" agentes"))),
        F.when(~F.col("approach.type").isin("desconhecida", "outra"), F.concat(F.lit("abordagem "), F.col("approach.type"))),
        F.when(~F.col("escape.type").isin("desconhecida", "outra", "nao_fugiu"), F.concat(F.lit("fuga "), F.col("escape.type"))),
    )
    or_text = lambda c, text: F.when(c == "", text).otherwise(c)
    more = F.when(F.size(tactics) > 3, " …").otherwise("")
    first3 = lambda a: F.array_join(F.slice(a, 1, 3), ", ")
    listed = [
        ("p_type", reason("event", F.concat(F.lit("crime_type."), crime), F.concat(F.lit("Tipo do crime: "), _words(crime)), F.col("p_type"), F.col("p_type") / 25)),
        ("p_weapon", reason("event", "weapon.total", F.concat(F.lit("Arma: "), F.array_join(weapons, ", ")), F.col("p_weapon"), F.col("p_weapon") / V.WEAPON_CAP)),
        ("p_tactics", reason("event", "mo.total", F.concat(F.lit("Modus operandi: "), first3(tactics), more), F.col("p_tactics"), F.col("p_tactics") / V.TACTIC_CAP)),
        ("p_victim", reason("event", "victim.vulnerability", F.concat(F.lit("Vítima: "), or_text(victim_bits, "fator presente")), F.col("p_victim"), F.col("p_victim") / V.VICTIM_CAP)),
        ("p_outcome", reason("event", F.concat(F.lit("outcome."), F.col("outcome.status")), F.concat(F.lit("Desfecho: "), _words(F.col("outcome.status"))), F.col("p_outcome"), F.col("p_outcome") / V.OUTCOME_CAP)),
        ("p_organised", reason("event", "agent.organization", F.concat(F.lit("Organização do agente: "), or_text(org_bits, "indícios")), F.col("p_organised"), F.col("p_organised") / V.ORGANISATION_CAP)),
        ("p_items", reason("event", "items.total", F.concat(F.lit("Itens de alto impacto: "), first3(kinds)), F.col("p_items"), F.col("p_items") / V.ITEM_CAP)),
    ]
    return scored.withColumn("reasons", F.array_compact(F.array(*[F.when(F.col(p) > 0, r) for p, r in listed])))


# ------------------------------------------------------------------ units
def unit_facts(scored: DataFrame, by: list[str]) -> DataFrame:
    """Everything the score needs from a unit's events, in two levels of partial aggregation.

    Columns: n, s_sum, top3_mean, gini, the urban factors of the combos, camera votes, patrol and light shares,
    distinct sources.
    """
    cam = F.col("environment.camera_present")
    combo_tags = sorted({t for tags, _ in V.ENV_COMBOS for t in tags})
    has_tag = lambda t: F.coalesce(F.array_contains("environment.urban_factors", t), F.lit(False))
    votes = lambda cond: F.count_if(cond)
    hourly = scored.groupBy(*by, F.col("temporal.hour_24").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("s_event").alias("s_sum"),
        votes(cam).alias("cam_yes"), votes(~cam).alias("cam_no"),
        votes(F.col("environment.patrol_presence") == "recem_retirada").alias("patrol_left"),
        votes(F.col("environment.lighting") == "adequada").alias("lit"),
        F.collect_set("source.kind").alias("kinds"),
        *[F.max(has_tag(t)).alias(f"tag_{t}") for t in combo_tags],
    )
    timed = hourly.filter(F.col("hour").isNotNull()).select(*by, "hour", "n")
    sums = hourly.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n", "s_sum", "cam_yes", "cam_no", "patrol_left", "lit")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"),
        F.array_compact(F.array(*[F.when(F.max(f"tag_{t}"), F.lit(t)) for t in combo_tags])).alias("tags"),
    )
    top = top_k_per_group(scored.select(*by, "s_event"), by, [F.desc("s_event")], 3)
    top3 = top.groupBy(*by).agg(F.avg("s_event").alias("top3_mean"))
    out = sums.join(top3, by, "left").join(gini_from_histogram(timed, by), by, "left")
    return out.withColumns({"gini": F.coalesce("gini", F.lit(0.0)), "n_sources": F.size("kinds")})


def unit_aggregate(facts: DataFrame) -> DataFrame:
    """Volume, extreme and pattern points and their capped sum."""
    return facts.withColumns({
        "pts_volume": F.lit(V.AGG_ALPHA) * F.log10(F.col("s_sum") + 1.0) * 10,
        "pts_extreme": F.col("top3_mean") / 100.0 * 30 * F.lit(V.AGG_BETA),
        "pts_pattern": F.lit(V.AGG_GAMMA) * F.col("gini"),
    }).withColumn(
        "s_loc", F.least(F.col("pts_volume") + F.col("pts_extreme") + F.col("pts_pattern"), F.lit(V.AGG_CEIL))
    )


def env_conditions() -> list[tuple[Column, float, Column]]:
    """(holds, factor, reason) of every environmental multiplier."""
    out = []
    for tags, factor in V.ENV_COMBOS:
        code = "combo." + "_".join(sorted(tags))
        label = "Combo de fatores urbanos: " + " + ".join(t.replace("_", " ") for t in tags)
        out.append((subset_of(tags, F.col("tags")), factor,
                    reason("env", code, label, F.lit(factor), F.lit((factor - 1) / 0.5), multiplier=True)))
    votes = F.col("cam_yes") + F.col("cam_no")
    blind = (votes > 0) & (F.col("cam_yes") == 0) & (F.col("s_loc") >= V.ENV_BLIND_MIN_SCORE)
    out.append((blind, V.ENV_BLIND_MULT, reason(
        "env", "env.camera_blind", "Ponto cego de câmera em região de alto risco", F.lit(V.ENV_BLIND_MULT),
        F.lit(0.8), multiplier=True,
        evidence=F.concat(F.lit("câmera ausente em "), votes.cast("string"), F.lit(" eventos")))))
    gap = F.col("patrol_left") / F.col("n") >= V.ENV_PATROL_GAP_SHARE
    out.append((gap, V.ENV_PATROL_GAP_MULT, reason(
        "env", "env.patrol_gap", "Crimes coincidem com saída da patrulha (janela operacional)",
        F.lit(V.ENV_PATROL_GAP_MULT), F.lit(0.9), multiplier=True,
        evidence=F.concat(F.col("patrol_left").cast("string"), F.lit("/"), F.col("n").cast("string"),
                          F.lit(" eventos pós-retirada de patrulha")))))
    good = (votes > 0) & (F.col("cam_no") == 0) & (F.col("lit") / F.col("n") >= V.ENV_GOOD_LIGHT_SHARE)
    out.append((good, V.ENV_GOOD_COVER_MULT, reason(
        "env", "env.good_coverage", "Cobertura adequada (câmera + iluminação) reduz prioridade",
        F.lit(V.ENV_GOOD_COVER_MULT), F.lit(0.3), multiplier=True)))
    return out


def env_multiplier(units: DataFrame) -> DataFrame:
    """Product of the multipliers that hold, clamped."""
    product = F.lit(1.0)
    for holds, factor, _ in env_conditions():
        product = product * F.when(holds, F.lit(factor)).otherwise(F.lit(1.0))
    return units.withColumn("m_env", F.greatest(F.lit(V.ENV_FLOOR), F.least(F.lit(V.ENV_CEIL), product)))


def source_multiplier(n_sources: Column) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in V.SOURCE_MULT.items() for x in kv]), n_sources)
    return F.coalesce(known, F.when(n_sources >= 5, F.lit(V.SOURCE_MULT_MANY)).otherwise(F.lit(V.SOURCE_MULT[1])))


def feedback_delta(pre: Column, post: Column, has_action: Column) -> Column:
    """-15 when the score fell by 30 % or more after an action, +8 when by less than 10 %."""
    drop = F.try_divide(pre - post, pre)
    delta = (
        F.when(drop >= V.FEEDBACK_SUCCESS_DROP, F.lit(V.FEEDBACK_SUCCESS_DELTA))
        .when(drop < V.FEEDBACK_INERT_DROP, F.lit(V.FEEDBACK_INERT_DELTA)).otherwise(F.lit(0.0))
    )
    bounded = F.greatest(F.lit(V.FEEDBACK_FLOOR), F.least(F.lit(V.FEEDBACK_CEIL), delta))
    usable = F.coalesce(has_action, F.lit(False)) & post.isNotNull() & (pre > 0)
    return F.when(usable, bounded).otherwise(F.lit(0.0))


def join_actions(units: DataFrame, actions: DataFrame, by: list[str]) -> DataFrame:
    """Action count and types per unit: by area, or by area and street ignoring case."""
    keys = {"area": F.coalesce("area_fm", F.lit(""))}
    if "street" in by:
        keys["street_up"] = F.upper(F.coalesce("logradouro", F.lit("")))
    counted = actions.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.array_join(F.array_sort(F.collect_set("action_type")), ", ").alias("action_types"),
    )
    if "street" in by:
        units = units.withColumn("street_up", F.upper("street"))
        return units.join(counted, ["area", "street_up"], "left").drop("street_up")
    return units.join(counted, ["area"], "left")


def unit_score(
    scored: DataFrame, by: list[str], actions: DataFrame | None = None, post_scores: DataFrame | None = None,
    *, with_reasons: bool = True, max_reasons: int | None = None,
) -> DataFrame:
    """Final score, priority and reasons per unit.

    ``post_scores(by…, post_score)`` is the score of a window after the actions; without it
    the feedback term is 0.
    """
    units = env_multiplier(unit_aggregate(unit_facts(scored, by)))
    units = units.withColumn("w_src", source_multiplier(F.col("n_sources")))
    units = units.withColumn("pre_score", F.col("s_loc") * F.col("m_env") * F.col("w_src"))
    if actions is not None:
        units = join_actions(units, actions, by)
    else:
        units = units.withColumns({"n_actions": F.lit(None).cast("bigint"), "action_types": F.lit(None).cast("string")})
    if post_scores is not None:
        units = units.join(post_scores.select(*by, "post_score"), by, "left")
    else:
        units = units.withColumn("post_score", F.lit(None).cast("double"))
    delta = feedback_delta(F.col("pre_score"), F.col("post_score"), F.col("n_actions") > 0)
    units = units.withColumn("delta_fb", delta)
    final = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("pre_score") + F.col("delta_fb")))
    units = units.withColumns({
        "final_score": F.round(final, 2), "priority": cut_label(final, V.PRIORITY_CUTS),
    })
    if not with_reasons:
        return units
    reasons = unit_reasons(scored, units, by)
    if max_reasons is not None:
        reasons = reasons.withColumn("reasons", F.slice("reasons", 1, max_reasons))
    return units.join(reasons, by, "left")


def unit_reasons(scored: DataFrame, units: DataFrame, by: list[str]) -> DataFrame:
    """Reasons per unit, strongest first (multipliers weigh five times). Event reasons are
    summed per code before they meet, so a unit holds one entry per code."""
    exploded = scored.select(*by, "event_id", F.explode("reasons").alias("r"))
    grouped = exploded.groupBy(*by, F.col("r.code").alias("code")).agg(
        F.min_by("r", "event_id").alias("r"), F.sum("r.delta").alias("delta"), F.count(F.lit(1)).alias("k")
    )
    evidence = F.when(F.col("k") == 1, "1 evento").otherwise(F.concat(F.col("k").cast("string"), F.lit(" eventos")))
    event_part = grouped.select(*by, F.struct(
        F.col("r.kind").alias("kind"), F.col("code"), F.col("r.label").alias("label"), F.col("delta"),
        F.col("r.is_multiplier").alias("is_multiplier"), F.col("r.weight").alias("weight"), evidence.alias("evidence"),
    ).cast(REASON).alias("r"))
    unit_part = units.select(*by, F.explode(F.array_compact(F.array(*_unit_level_reasons()))).alias("r"))
    both = event_part.unionByName(unit_part)
    strength = F.abs("r.delta") * F.when(F.col("r.is_multiplier"), 5.0).otherwise(1.0)
    ordered = F.sort_array(F.collect_list(F.struct((-strength).alias("o"), F.col("r.code").alias("c"), "r")))
    return both.groupBy(*by).agg(F.transform(ordered, lambda s: s["r"]).alias("reasons"))


def _unit_level_reasons() -> list[Column]:
    n = F.col("n").cast("string")
    pct = lambda c: F.format_string("%.0f", c * 100)
    out = [
        reason("aggregate", "agg.volume",
               F.concat(F.lit("Volume de gravidade: "), n, F.lit(" eventos, soma S_event = "), F.format_string("%.0f", F.col("s_sum"))),
               F.col("pts_volume"), F.col("pts_volume") / V.AGG_CEIL,
               evidence=F.concat(n, F.lit(" eventos com S_event médio "), F.format_string("%.1f", F.col("s_sum") / F.col("n")))),
        F.when(F.col("top3_mean") > 0, reason(
            "aggregate", "agg.extreme",
            F.concat(F.lit("Eventos mais graves: top-3 média "), F.format_string("%.0f", F.col("top3_mean")), F.lit("/100")),
            F.col("pts_extreme"), F.col("pts_extreme") / V.AGG_CEIL)),
        F.when(F.col("gini") > 0.3, reason(
            "aggregate", "agg.pattern",
            F.concat(F.lit("Concentração temporal: "), pct(F.col("gini")), F.lit("% (padrão de turno)")),
            F.col("pts_pattern"), F.col("pts_pattern") / V.AGG_CEIL,
            evidence="indício de grupo agindo em janela operacional fixa")),
    ]
    out += [F.when(holds, r) for holds, _, r in env_conditions()]
    out += [
        F.when(F.col("n_sources") == 1, reason(
            "source", "src.single",
            F.concat(F.lit("Apenas 1 fonte ("), F.try_element_at("kinds", F.lit(1)), F.lit(") — sinal precisa de corroboração")),
            F.col("w_src"), F.lit(0.5), multiplier=True)),
        F.when(F.col("n_sources") >= 3, reason(
            "source", "src.corroborated",
            F.concat(F.lit("Corroboração cross-source: "), F.col("n_sources").cast("string"), F.lit(" fontes distintas")),
            F.col("w_src"), F.lit(0.7), multiplier=True, evidence=F.array_join("kinds", ", "))),
        F.when(F.col("delta_fb") < 0, reason(
            "feedback", "fb.success",
            F.concat(F.lit("Ação da FM reduziu o score em "), pct((F.col("pre_score") - F.col("post_score")) / F.col("pre_score")), F.lit("%")),
            F.col("delta_fb"), F.lit(1.0), evidence=F.concat(F.lit("ações: "), F.col("action_types")))),
        F.when(F.col("delta_fb") > 0, reason(
            "feedback", "fb.displacement_or_inert",
            "Ação da FM não reduziu o crime (possível migração para vizinhos)", F.col("delta_fb"), F.lit(0.9))),
    ]
    return out


def top_events(scored: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The k most severe events per unit."""
    return top_k_per_group(scored, by, [F.desc("s_event"), F.col("event_id")], k, rank="event_rank")


def keyed_events(events: DataFrame) -> DataFrame:
    """Unit keys of events: area (unknown area named so), street and day."""
    return events.withColumns({
        "area": F.coalesce(F.nullif(F.col("spatial.area_fm"), F.lit("")), F.lit(V.UNKNOWN_AREA)),
        "street": F.col("spatial.logradouro"),
        "day": F.try_to_date(F.left(F.col("temporal.date_iso"), F.lit(10)), "yyyy-MM-dd"),
    })


def score_report(
    events: DataFrame, actions: DataFrame | None = None, *, window_days: int = 30, window_end=None,
    min_events: int = 1, post_scores: DataFrame | None = None, with_reasons: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(areas, streets) scored over the trailing window ending at the latest event date."""
    scored = event_severity(window_filter(keyed_events(events), window_days, end=window_end))
    enough = F.col("n") >= min_events
    areas = unit_score(scored, ["area"], actions, post_scores, with_reasons=with_reasons).filter(enough)
    named = scored.filter(F.coalesce("street", F.lit("")) != "")
    streets = unit_score(named, ["area", "street"], actions, with_reasons=with_reasons).filter(enough)
    return areas, streets
