"""Date and hour expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_hour(c: Column) -> Column:
    """Whole number before the first ':'; anything else is NULL."""
    return F.trim(F.split_part(c.cast("string"), F.lit(":"), F.lit(1))).try_cast("int")


def safe_int(c: Column) -> Column:
    return c.try_cast("double").try_cast("int")


def safe_float(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def comma_decimal(c: Column) -> Column:
    return safe_float(F.regexp_replace(c.cast("string"), ",", "."))


def _first_date(c: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def parse_date_multi(data: Column, year: Column | None = None, month: Column | None = None) -> Column:
    """ISO, then day/month/year, then month/day/year; else the first of the given month."""
    parsed = _first_date(data, ["yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy"])
    if year is None:
        return parsed
    month_text = F.concat_ws(
        "-", F.lpad(safe_int(year).cast("string"), 4, "0"), safe_int(month).cast("string"), F.lit("1")
    )
    return F.coalesce(parsed, F.try_to_date(month_text, "yyyy-M-d"))


def parse_tip_date(c: Column) -> Column:
    """Text before the first blank as month/day/year, then day/month/year, then ISO."""
    head = F.split_part(c, F.lit(" "), F.lit(1))
    return _first_date(head, ["M/d/yyyy", "d/M/yyyy", "yyyy-MM-dd"])


def parse_iso_ts(c: Column) -> Column:
    return F.try_to_timestamp(c)


def month_key(c: Column) -> Column:
    """First day of the month as a DATE."""
    return F.trunc(c.cast("date"), "month")


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def daypart6(h: Column) -> Column:
    return (
        F.when(h.isNull(), "desconhecido")
        .when(h.between(0, 4), "madrugada")
        .when(h.between(5, 6), "amanhecer")
        .when(h.between(7, 11), "manha")
        .when(h.between(12, 16), "tarde")
        .when(h.between(17, 18), "entardecer")
        .otherwise("noite")
    )


def daypart4(h: Column) -> Column:
    return (
        F.when(h < 6, "Madrugada").when(h < 12, "Manhã").when(h < 18, "Tarde").when(h >= 18, "Noite")
    )


def is_night(h: Column) -> Column:
    """18-23 or 0-5; NULL stays NULL."""
    return h.between(18, 23) | h.between(0, 5)


def window_label(start: Column, end: Column) -> Column:
    """'20h–23h' with both ends clamped to the day."""
    return F.concat(
        F.greatest(start, F.lit(0)).cast("int").cast("string"), F.lit("h–"),
        F.least(end, F.lit(23)).cast("int").cast("string"), F.lit("h"),
    )


def position_label(peak: Column) -> Column:
    """Shift label of a street position from its peak hour."""
    peak = F.when(F.coalesce(peak, F.lit(0)) == 0, F.lit(20)).otherwise(peak)
    end = (
        F.when(peak.between(5, 11), peak + 3)
        .when(peak.between(12, 17), peak + 2)
        .otherwise(F.least(peak + 3, F.lit(23)))
    )
    return F.concat(peak.cast("int").cast("string"), F.lit("h–"), end.cast("int").cast("string"), F.lit("h"))
