"""Importance resampling towards a target: hashed n-gram counts of both corpora, a gain per bucket, Gumbel scores, the best drawn.

Texts are handled as bytes. One 256-byte table lower-cases A-Z and blanks every separator, ``bytes.split`` yields the words, and the
hash of an n-gram is the CRC-32 of the last word with the hash of what stands before it as seed, so no n-gram is ever built as a
string. ``Counter`` reduces a text to distinct n-grams before anything is looked up.

Counts are taken over all documents and all target texts: every task adds up one array of ``buckets`` numbers and hands it over once, a
sum per bucket follows, and the driver gets ``buckets`` pairs of counts, whatever the size of the corpus. A second pass over the texts
gives each document its weight. The draw adds Gumbel noise from a hash of the id, which makes taking the highest scores the same as
drawing without replacement in proportion to exp(weight / 1000), and repeats on every run. Ranks come from one range sort of narrow
rows with an offset per partition, so no task sees all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoevents.llm.common import WORD_BYTES, batches, cut, slices, texts_of, utf8

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
SCALE = 1000


def words_of(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased."""
    return data.translate(WORD_BYTES).split()


def hash_counts(words: list[bytes], longest: int = LONGEST) -> Counter:
    """How often each CRC-32 of a run of 1 to ``longest`` consecutive words, joined by one space, occurs."""
    if longest == 1:
        found: Counter = Counter()
        for word, n in Counter(words).items():
            found[crc32(word)] += n
        return found
    seeds = list(map(crc32, words))
    found = Counter(seeds)
    spaced = [b" " + w for w in words]
    for n in range(1, longest):
        seeds = list(map(crc32, spaced[n:], seeds))  # the seed of a run is the hash of the same run without its last word
        found.update(seeds)
    return found


def n_features(n_words: int, longest: int = LONGEST) -> int:
    return sum(max(0, n_words - k) for k in range(longest))


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> dict[int, int]:
    """Features per bucket over all rows; at most ``buckets`` numbers leave a task or reach the driver. Null texts have none."""
    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in them:
            for part in slices(batch):
                for data in utf8(part.column(0)):
                    found = hash_counts(words_of(data), longest)
                    if found:
                        at = np.fromiter(found.keys(), np.int64, len(found)) % buckets
                        np.add.at(total, at, np.fromiter(found.values(), np.int64, len(found)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = texts_of(docs, [], text).mapInArrow(run, "bucket bigint, n bigint")
    return {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) per bucket, in doubles."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return np.array([math.floor(SCALE * math.log(
        float(target.get(b, 0) + 1) * float(s_all + buckets) / (float(source.get(b, 0) + 1) * float(t_all + buckets))))
        for b in range(buckets)], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the hash of seed and id; a null id counts as an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
             longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(id_col, n_words, n_features, weight, score), one row per row of ``docs``."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, text, buckets, longest), buckets)

    def work(batch: pa.RecordBatch) -> list:
        n, features, weights = [], [], []
        for data in utf8(batch.column(1)):
            words = words_of(data)
            found = hash_counts(words, longest)
            at = np.fromiter(found.keys(), np.int64, len(found)) % buckets
            weights.append(int(gain[at] @ np.fromiter(found.values(), np.int64, len(found))))
            n.append(len(words))
            features.append(n_features(len(words), longest))
        scores = [w + noise(i, seed) for w, i in zip(weights, batch.column(0).to_pylist())]
        return [batch.column(0), n, features, weights, scores]

    frame = texts_of(docs, [id_col], text)
    kind = frame.schema[0].dataType.simpleString()
    return batches(frame, work, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
              longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_features, weight, score, rank), one row per row of ``docs``; rank is null for rows that are not drawn.

    Of the N rows with at least ``least_words`` words, floor(percent N / 100) are drawn: the highest scores, ties to the smaller id,
    null ids last; equal rows are drawn each for itself. Null and empty texts have no features, weight 0, and are not drawn. An empty
    table gives an empty one, an empty target a target without features. Of ``docs`` only id and text are read, of ``target`` only the text."""
    may = F.col("n_words") >= least_words
    order = [F.col("_may").desc(), F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_last()]
    rows = weighted(docs, target, id_col, text, buckets, longest, seed).withColumn("_may", may).drop("n_words")
    # Written before it is sorted, so texts are not weighed again for the bounds of the ranges.
    placed = cut(cut(rows).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("_may").alias("may")).orderBy("part").collect()
    drawn = percent * sum(r.may for r in sizes) // 100
    before = np.concatenate(([0], np.cumsum([r.n for r in sizes]))).tolist()
    offsets = docs.sparkSession.createDataFrame([(r.part, n) for r, n in zip(sizes, before)], "_part bigint, _before bigint")
    rank = F.col("_before") + within + 1
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per partition
    return joined.select(id_col, "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
