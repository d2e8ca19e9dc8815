"""All registered queries."""

from geoevents.catalog import (  # noqa: F401
    metric_queries,
    score_queries,
    series_queries,
    spatial_queries,
    store_queries,
    text_queries,
)
from geoevents.catalog.registry import QUERIES, oracles  # noqa: F401
