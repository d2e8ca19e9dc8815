"""Clustering against plain rounds in exact integers, and against SQL; bounds never lose the nearest centroid."""

import hashlib
import math

import numpy as np
import oracle
import pytest

from geoevents.llm import vafile as V
from geoevents.llm.oracles import ORACLES
from geoevents.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, row string"


def plain(rows, clusters, rounds, dim):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) by comparing every vector with every centroid."""
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
           if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in own if i is not None)[:clusters]
    centroids = [v for _, v in start]
    if not centroids:
        return []
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centroids)), key=lambda c: (dist(v, centroids[c]), c))
    for _ in range(rounds):
        at = [near(v) for _, v in own]
        centroids = [[sum(x) // len(m) for x in zip(*m)] if (m := [v for (_, v), a in zip(own, at) if a == c]) else centroids[c]
                     for c in range(len(centroids))]
    final = [(i, near(v), v) for i, v in own]
    sums = [sum(dist(v, centroids[c]) for _, a, v in final if a == c) for c in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, dist(v, centroids[c]), sums[c], sum(sums), shas[c]) for i, c, v in final), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9, "x") for i, v in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def floats(rng, n, dim, spread=1.0):
    return rng.normal(0, spread, (n, dim)).astype(np.float32).tolist()


def test_whole_table_against_sql(spark, sf):
    assert oracle.difference(QUERIES["op11_va_clusters"](spark, sf), oracle.connect(sf), ORACLES["op11_va_clusters"]) is None


def test_against_plain_rounds(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (5, 6))
    clustered = [(i, (middles[i % 5] + rng.normal(0, 0.05, 6)).astype(np.float32).tolist()) for i in range(300)]
    loose = [(i, v) for i, v in enumerate(floats(rng, 200, 6))]
    grid = [(i, [float(i % 3), float(i % 2)] + [0.0] * 4) for i in range(120)]  # ties and repeated vectors
    for rows, k, rounds in ((clustered, 5, 10), (loose, 8, 3), (grid, 4, 10), (loose, 3, 0), (loose, 1, 2)):
        got = V.clustered(frame(spark, rows), clusters=k, rounds=rounds, dim=6)
        assert rows_of(got) == plain(rows, k, rounds, 6)


def test_coarse_cells_change_nothing(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(floats(rng, 150, 5)))
    want = plain(rows, 4, 5, 5)
    for bits in (1, 3, 8):
        assert rows_of(V.clustered(frame(spark, rows), clusters=4, rounds=5, dim=5, bits=bits)) == want


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(20):
        v = rng.integers(-500, 500, (200, 4))
        centroids = rng.integers(-800, 800, (6, 4))
        centroids[3] = centroids[1]
        borders = np.sort(rng.integers(-400, 400, (4, 7)), axis=1)  # equal borders leave empty cells
        cells = V.Cells(borders, v.min(axis=0), v.max(axis=0))
        codes = cells.codes(v)
        assert ((np.take_along_axis(cells.low, codes.T.astype(int), 1).T <= v) & (v <= np.take_along_axis(cells.high, codes.T.astype(int), 1).T)).all()
        distance = ((v[:, None] - centroids) ** 2).sum(axis=2)
        choices = V.open_choices(codes, cells.tables(centroids))
        assert choices[distance == distance.min(axis=1, keepdims=True)].all()
        best, own = V.exact_choice(v, choices, centroids)
        assert (best == distance.argmin(axis=1)).all() and (own == distance.min(axis=1)).all()


def test_most_vectors_stay_unread(spark):
    """Around well parted middles, later rounds ask for a small part of the vectors."""
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 1, (4, 16))
    rows = [(i, (middles[i % 4] + rng.normal(0, 0.1, 16)).astype(np.float32).tolist()) for i in range(800)]
    vectors = V.whole_vectors(frame(spark, rows), dim=16)
    cells = V.Cells.measured(vectors, 16)
    centroids = np.floor(middles * 1024).astype(np.int64)
    asked = V._asked(V._coded(vectors, cells, 16), vectors, cells, centroids, centroids + 3)
    assert asked.count() < 40


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 0.0]), (7, [0.0, inf]),
            (None, [5.0, 5.0]), (8, [-0.0005, 2.0]), (9, [1.0, 2.0, 3.0])]
    assert rows_of(V.clustered(frame(spark, rows), dim=2)) == plain(rows, 8, 10, 2)
    assert len(plain(rows, 8, 10, 2)) == 4
    assert rows_of(V.clustered(frame(spark, rows), dim=2, clusters=2)) == plain(rows, 2, 10, 2)
    assert V.clustered(frame(spark, []), dim=2).count() == 0
    assert V.clustered(frame(spark, [(None, [1.0, 2.0])]), dim=2).count() == 0
    with pytest.raises(Exception, match="squared distance"):
        V.clustered(frame(spark, [(1, [1e30, 0.0])]), dim=2).collect()
