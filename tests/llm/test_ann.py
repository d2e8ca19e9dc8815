"""The permutation index against brute force."""

import numpy as np
from pyspark.sql import functions as F

from geoevents.llm import ann
from geoevents.llm.common import table
from geoevents.llm.queries import QUERIES
from geoevents.session import cut, written_bytes


def brute(ids, vectors, queries, k=20):
    out = {}
    for i in queries:
        at = int(np.flatnonzero(ids == i)[0])
        score = (vectors * vectors[at]).sum(axis=1)
        keep = ids != i
        order = np.lexsort((ids[keep], -score[keep]))[:k]
        out[i] = [(int(ids[keep][j]), float(score[keep][j])) for j in order]
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got.get(q, [])}) for q in want)
    return hits / sum(map(len, want.values()))


def by_query(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r["rank"] == len(own)
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = by_query(QUERIES["op6_permutation_index"](spark, sf))
    want = brute(ids, vectors, [i for i in ids if i % 20 == 0])
    assert set(got) == set(want) and recall(got, want) >= 0.9
    true = {q: dict(v) for q, v in brute(ids, vectors, list(want), k=len(ids)).items()}
    assert all(true[q][v] == s for q, vs in got.items() for v, s in vs)


def test_recall_with_blocks_lengths_and_a_dense_group(spark):
    """Many blocks, vectors of different lengths, a third of them almost equal, some exactly."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 24)) * rng.lognormal(0, 0.4, (3000, 1))
    vectors[:1000] = vectors[0] + rng.normal(size=(1000, 24)) * 0.01
    vectors[:100] = vectors[0]
    ids = np.arange(3000)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    got = by_query(ann.nearest(frame, F.col("vec_id") % 20 == 0, rows_per_block=1100, queries_per_block=40))
    want = brute(ids, vectors, [int(i) for i in ids if i % 20 == 0])
    assert recall(got, want) >= 0.95


def test_rows_are_not_written_for_each_meeting(spark, monkeypatch):
    """Blocks of rows are sent to the meetings, and only queries are written; small blocks of queries find the same as one block."""
    rng, kept = np.random.default_rng(4), []
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(4000, 24)).tolist())], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    wanted = F.col("vec_id") % 20 == 0
    small = by_query(ann.nearest(frame, wanted, rows_per_block=500, queries_per_block=20))
    assert sum(written_bytes(x) for x in kept) < 4000 * 24 * 8
    assert small == by_query(ann.nearest(frame, wanted, rows_per_block=500)) and len(small) == 200


def test_gains_against_places():
    rng = np.random.default_rng(5)
    for pivots, size in ((40, 12), (300, 90), (700, 300)):
        held = np.array([rng.permutation(pivots)[:size] for _ in range(30)])
        near = rng.permutation(pivots)[:size]
        place = lambda row: {p: i for i, p in enumerate(row)}
        want = [sum(2 * size - i - j - abs(i - j) for p, i in place(near).items() for j in [place(row).get(p)] if j is not None) for row in held.tolist()]
        assert (2 * ann.gains(ann.inverted_files(held, pivots), near).astype(np.int64)).tolist() == want


def test_hopeful_rows_hold_the_best():
    rng = np.random.default_rng(6)
    vectors = np.repeat(rng.normal(size=(300, 16)), 3, axis=0) * 1e6
    vectors[1::3] += rng.normal(size=(300, 16)) * 1e-3
    q = rng.normal(size=16) * 1e-4
    score = (vectors * q).sum(axis=1)
    found = ann.hopeful((vectors / np.abs(vectors).max()).astype(np.float32), np.arange(900), q, 20)
    assert set(np.flatnonzero(score >= np.sort(score)[-20])) <= set(found) and len(found) < 60


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, rank string"
    rows = [(0, [1.0, 0.0], 1, "x"), (20, [0.0, 0.0], 1, "x"), (40, None, 1, "x"), (60, [float("nan"), 1.0], 1, "x"), (3, [1.0, None], 1, "x"),
            (5, [float("inf"), 0.0], 1, "x"), (None, [1.0, 1.0], 1, "x"), (7, [2.0, 0.0], 1, "x"), (6, [2.0, 0.0], 1, "x"), (9, [-1.0, 5.0], 1, "x"),
            (80, [], 1, "x")]
    got = by_query(ann.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0))
    assert got == {0: [(6, 2.0), (7, 2.0), (9, -1.0)]}
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
