import os

import pytest

SF = os.environ.get("GEOEVENTS_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) with clashing extra columns."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, key int, mask string")
    return make
