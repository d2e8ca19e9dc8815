"""Registered queries against their SQL; GEOEVENTS_ALL=1 runs every one of them."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = os.environ.get("GEOEVENTS_SF", "/root/testdata/sf0.001")
QUICK = """filter_bbox project_utm join_points_to_zones join_points_to_zones_first covered_by_camera nearest_camera ring_join
 zone_overlap_area zones_intersect_zones weighted_population grid_coincidence top_streets calls_by_type cross_validate_sources
 gini_hours mann_kendall seasonal_decompose_additive yoy_displacement area_score event_severity unit_score allocate_fleet
 norm_street html_links tips_to_events cluster_eps upsert_latest global_rank flag_quality""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("GEOEVENTS_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    assert oracle.difference(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_gaps_of_all_calls(spark, duck):
    """All calls of each person's last 60 months are counted, and the gaps are real."""
    got = entry.queries()["gap_filled_people"](spark, SF)
    assert oracle.difference(got, duck, entry.oracle_sql()["gap_filled_people"]) is None
    rows = got.collect()
    want = duck.execute("""SELECT count(*) FROM (SELECT o_custkey, date_trunc('month', o_orderdate) m FROM orders WHERE o_orderdate IS NOT NULL)
        JOIN (SELECT o_custkey, max(date_trunc('month', o_orderdate)) hi FROM orders GROUP BY 1) USING (o_custkey) WHERE m >= hi - INTERVAL 59 MONTH""").fetchone()[0]
    assert sum(r.n for r in rows) == want and any(r.n == 0 for r in rows)
