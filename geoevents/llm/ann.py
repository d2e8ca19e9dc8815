"""Nearest neighbours by a permutation index.

Each vector is represented by its nearest pivots, in order. Pivots have inverted files: a byte for each vector of the block, how far from the
prefix's end it holds the pivot. A query walks the files of its own nearest pivots and adds up, per vector, by how much places differ
(Spearman's footrule on prefixes; a missing pivot counts as one place behind the prefix). The best share by footrule is ranked again by
exact inner products. Largest inner product becomes nearest distance by one more coordinate that gives all stored vectors one length.

Every valid row is indexed. Rows are dealt into blocks of bounded size by a hash of the id; a block holds its own inverted files, and
each block of queries meets each block of rows once. A meeting is a partition of its own: rows come to it packed, some hundred in a row of
bytes, nothing is listed by pairs, and a task holds one block of rows and one of queries at a time. Blocks of queries are as large as
``MOST_QUERIES`` lets them be while there are meetings enough for the session's cores, since each of them is sent all rows once. Each
meeting returns k rows per query, and a window keeps the best k. Pivots are a bounded sample and go to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from geoevents.llm.common import cut

PIVOTS = 256
PREFIX = 64
#: Vectors are ranked again if they are among this share of their block by footrule, and never fewer than LEAST_CANDIDATES.
SHARE = 0.3
LEAST_CANDIDATES = 600
#: Vectors whose footrule comes this near to that of the k-th best are ranked again too, however many: in a dense group of almost equal
#: vectors places hardly differ, and a share would cut through it.
SLACK = 0.1
ROWS_PER_BLOCK = 32_768
QUERIES_PER_BLOCK = 512
#: A block of queries holds up to so many, once there are so many meetings for each core.
MOST_QUERIES, MEETINGS_PER_CORE = 16_384, 2
#: Rows whose pivots are ordered at once.
_STEP = 4096
K = 20


def valid_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part: no null, zero or non-finite vectors; empty ones are zero."""
    v = F.col(f"`{vector}`").cast("array<double>")
    ok = (v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).filter(ok & F.col("id").isNotNull())


def pivot_sample(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` distinct vectors, taken by a hash of the id: the same for the same rows."""
    got = vectors.select("v", F.xxhash64("id").alias("h")).orderBy("h", F.col("v")).limit(4 * pivots).collect()
    distinct = list(dict.fromkeys(tuple(r.v) for r in got))[:pivots]
    return np.array(distinct, np.float64)


def prefixes(vectors: np.ndarray, pivots: np.ndarray, size: int, top: float) -> np.ndarray:
    """The nearest pivots of each vector, in order, after all stored vectors were given the length ``top``."""
    lift = lambda x: np.sqrt(np.maximum(0.0, top * top - (x * x).sum(axis=1)))
    out = np.empty((len(vectors), size), np.int32)
    for a in range(0, len(vectors), _STEP):
        near = vectors[a:a + _STEP] @ pivots.T + np.outer(lift(vectors[a:a + _STEP]), lift(pivots))
        out[a:a + _STEP] = np.argsort(-near, axis=1, kind="stable")[:, :size]
    return out


def query_prefixes(queries: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    """The same for queries, whose extra coordinate is zero."""
    return np.argsort(-(queries @ pivots.T), axis=1, kind="stable")[:, :size].astype(np.int32)


def inverted_files(prefix: np.ndarray, pivots: int) -> np.ndarray:
    """For each pivot and row the places from the row's place of the pivot to the end of its prefix; 0 where it is not held."""
    size = prefix.shape[1]
    files = np.zeros((pivots, len(prefix)), np.uint8 if size < 256 else np.uint16)
    rows = np.arange(len(prefix))
    for place in range(size):
        files[prefix[:, place], rows] = size - place
    return files


def gains(files: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Half the footrule's fall of each row against sharing no pivot: of a shared pivot the lesser of both distances from the prefix's end."""
    size = len(near)
    out = np.zeros(files.shape[1], np.uint16 if size < 256 else np.uint32)
    room = np.iinfo(files.dtype).max // size  # so many fit into an item of the files
    part, less = np.empty(files.shape[1], files.dtype), np.empty(files.shape[1], files.dtype)
    for a in range(0, size, room):
        np.minimum(files[near[a]], size - a, out=part)
        for place in range(a + 1, min(size, a + room)):
            np.add(part, np.minimum(files[near[place]], size - place, out=less), out=part)
        np.add(out, part, out=out)
    return out


def hopeful(rough: np.ndarray, found: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``found`` those that can be among the k best: single precision, less all that its rounding can change."""
    q = (q / np.abs(q).max()).astype(np.float32)
    some = rough.take(found, axis=0)
    score = some @ q
    most = math.sqrt(float(np.einsum("ij,ij->i", some, some).max())) * float(np.linalg.norm(q))
    slip = 1.1 * (len(q) + 3) * 2.0 ** -24 * most
    return found[score.astype(np.float64) >= float(np.partition(score, len(score) - k)[len(score) - k]) - 2 * slip]


def block_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, top: float,
                 k: int = K, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST_CANDIDATES,
                 slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best found in one block for each query. Rows of the block come in order of id."""
    size = min(prefix, len(pivots))
    files = inverted_files(prefixes(vectors, pivots, size, top), len(pivots))
    wanted = query_prefixes(queries, pivots, size)
    keep = min(len(ids), max(least, k + 1, math.ceil(share * len(ids))))
    rough = (vectors / np.abs(vectors).max()).astype(np.float32)
    out_q, out_v, out_s = [], [], []
    for q, own, near in zip(queries, query_ids, wanted):
        gain = gains(files, near)
        if keep < len(ids):
            ordered = np.partition(gain, (len(ids) - keep, len(ids) - k - 1))
            found = np.flatnonzero(gain >= min(ordered[len(ids) - keep], (1 - slack) * ordered[len(ids) - k - 1]))
        else:
            found = np.arange(len(ids))
        found = found[ids[found] != own]
        if len(found) > 4 * k:
            found = hopeful(rough, found, q, k)
        score = (vectors[found] * q).sum(axis=1)
        if len(found) > 4 * k:
            limit = np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[score >= limit], score[score >= limit]
        best = np.lexsort((ids[found], -score))[:k]
        out_q.append(np.full(len(best), own, np.int64))
        out_v.append(ids[found[best]])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _packed(rows: DataFrame, group: F.Column, kind: type) -> DataFrame:
    """(g, ids, vectors): the rows of a batch that belong to one group, as bytes; nothing is shuffled for it."""
    def work(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            if batch.num_rows:
                g, ids = batch.column(0).to_numpy(), batch.column(1).cast(pa.int64()).to_numpy()
                matrix = batch.column(2).flatten().to_numpy().reshape(len(ids), -1).astype(kind)
                order = np.argsort(g, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(g[order])) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([g[p[0]] for p in parts], pa.int32()), pa.array([ids[p].tobytes() for p in parts], pa.binary()),
                                                  pa.array([matrix[p].tobytes() for p in parts], pa.binary())], names=["g", "ids", "vectors"])

    return rows.select(group.cast("int").alias("g"), "id", "v").mapInArrow(work, "g int, ids binary, vectors binary")


def nearest(rows: DataFrame, is_query: F.Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K, pivots: int = PIVOTS,
            prefix: int = PREFIX, share: float = SHARE, rows_per_block: int = ROWS_PER_BLOCK,
            queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, rank, id_col, score): for each query row its k nearest other rows by inner product, ties to the smaller id.

    Rows without an id, and vectors that are null, zero, or hold null or non-finite components take no part. All vectors must have one
    number of components. Of rows with the same id each is indexed; none is compared with its own id; as a query stands the one
    with the smallest vector, component by component. No valid row: an empty table."""
    all_rows = valid_vectors(rows, id_col, vector)
    spark, result = rows.sparkSession, f"query_id bigint, rank int, `{id_col}` bigint, score double"
    head = all_rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"),
                        F.min(F.size("v")).alias("short"), F.max(F.size("v")).alias("long")).first()
    if not head.n:
        return spark.createDataFrame([], result)
    if head.short != head.long:
        raise ValueError(f"vectors have between {head.short} and {head.long} components")
    marks, top, dim = pivot_sample(all_rows, pivots), math.sqrt(head.top), head.long
    queries = cut(valid_vectors(rows.filter(is_query), id_col, vector).groupBy("id").agg(F.min("v").alias("v")))
    n_queries, n_blocks = queries.count(), max(1, math.ceil(head.n / rows_per_block))
    wished = math.ceil(MEETINGS_PER_CORE * spark.sparkContext.defaultParallelism / n_blocks)
    n_groups = max(1, math.ceil(n_queries / max(MOST_QUERIES, queries_per_block)), min(wished, math.ceil(n_queries / queries_per_block)))
    hashed = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n))
    kind = np.float32 if isinstance(rows.schema[vector].dataType.elementType, FloatType) else np.float64  # either holds the vectors as they are
    g, first = F.col("g"), F.col("g") * n_groups
    held = _packed(all_rows, hashed(n_blocks), kind).select(F.explode(F.sequence(first, first + (n_groups - 1))).alias("meeting"), F.lit(False).alias("asks"), "ids", "vectors")
    asked = _packed(queries, hashed(n_groups), kind).select(F.explode(F.sequence(g, g + (n_blocks - 1) * n_groups, F.lit(n_groups))).alias("meeting"),
                                                            F.lit(True).alias("asks"), "ids", "vectors")
    meetings = held.unionByName(asked).repartitionById(n_blocks * n_groups, "meeting")

    def search(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {False: ([], []), True: ([], [])}
        for batch in them:
            for asks, *own in zip(*(c.to_pylist() for c in batch.columns)):
                for kept, data in zip(parts[asks], own):
                    kept.append(data)
        sides = []
        for asks in (False, True):
            ids = np.frombuffer(b"".join(parts[asks][0]), np.int64)
            matrix = np.frombuffer(b"".join(parts.pop(asks)[1]), kind).reshape(-1, dim)
            order = np.argsort(ids, kind="stable")
            sides += ids[order], matrix[order].astype(np.float64)
        if len(sides[0]) and len(sides[2]):
            got = block_search(*sides, marks, top, k, prefix, share)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "id", "score"])

    found = meetings.select("asks", "ids", "vectors").mapInArrow(search, "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
