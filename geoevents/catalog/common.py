"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoevents.functions import geo as G
from geoevents.operators import spatial as S
from geoevents.plans.area_report import AreaReport, Layers
from geoevents.sources import bindings as B


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in cols})


def joined_text(c: Column | str, sep: str = "|") -> Column:
    """A list column as text, for comparison."""
    return F.array_join(c, sep)


def month_text(df: DataFrame, col: str = "month") -> DataFrame:
    return df.withColumn(col, F.date_format(col, "yyyy-MM"))


_INDEXES: dict[tuple[str, str], DataFrame] = {}


def index_of(spark: SparkSession, d: str) -> DataFrame:
    """The zone index of a folder, written once in an application and read by all its queries."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = S.zone_index(B.zone_edges(spark, d), B.zones(spark, d))
    return _INDEXES[key]


def zoned(spark: SparkSession, d: str, df: DataFrame, how: str = "inner", multi: str = "all") -> DataFrame:
    return S.join_points_to_zones(df, index_of(spark, d), how=how, multi=multi)


def report_of(spark: SparkSession, d: str) -> AreaReport:
    return AreaReport(Layers(
        zones=B.zones(spark, d), edges=B.zone_edges(spark, d), incidents=B.incidents(spark, d), tips=B.tips(spark, d),
        factors=B.factors(spark, d), cameras=B.cameras(spark, d), reports=B.reports(spark, d),
        street_people=B.street_people(spark, d), calls=B.calls(spark, d)), index=index_of(spark, d))


def metric(df: DataFrame) -> DataFrame:
    return G.with_metric(df)
