"""Line dedup that can be taken back: sharded cuckoo filters over exact reference counts.

The state is an exact table (key, n_docs) of how many documents hold a line, and one cuckoo filter per shard of keys with the keys
that stand in ``least_docs`` documents or more. Adding documents adds to the counts, deleting them subtracts; keys that cross the
bound are put into or taken out of their shard's filter, which a cuckoo filter allows and a Bloom filter does not. A lookup probes
the filter first and asks the exact table only about hits, so a false hit never drops a line.

A key is the 128-bit XXH3 of the stripped, ASCII-lower-cased line; only keys are shuffled before the last step, and per document a
line counts once. Counts are partial aggregates, so a line that stands in a third of all documents is one row per task. Shards are
made by key hash, so many that each holds a bounded number of keys. Documents meet their dropped keys by one join on id and text hash.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoevents.llm.common import batches, cut, free_name, slices, texts_of, utf8

LEAST_DOCS = 10
LEAST_CHARS = 1
#: Distinct keys to a shard, which bounds what one filter task holds.
KEYS_PER_SHARD = 200_000
_SLOTS = 4
_KICKS = 500
_DIGEST = pa.binary()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets and can be deleted again. Full tables double in ``build``."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    @staticmethod
    def _of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = ((keys >> np.uint64(48)) & np.uint64(0xFFFF)).astype(np.uint64)
        return np.where(fp == 0, np.uint64(1), fp), keys & np.uint64(0xFFFFFFFF)

    def _other(self, at, fp):
        return (at ^ (fp * np.uint64(0x5BD1E995))) & np.uint64(len(self.buckets) - 1)

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        size = 1 << max(2, math.ceil(math.log2(max(1, len(keys)) / (_SLOTS * 0.85))))
        while True:
            made = cls(np.zeros((size, _SLOTS), np.uint16))
            if all(made.insert(k) for k in keys):
                return made
            size *= 2

    def insert(self, key: np.uint64) -> bool:
        """False if no room was found; the filter must be built anew then."""
        fps, lows = self._of(np.array([key], np.uint64))
        fp, at = fps[0], lows[0] & np.uint64(len(self.buckets) - 1)
        for place in (at, self._other(at, fp)):
            free = np.flatnonzero(self.buckets[int(place)] == 0)
            if len(free):
                self.buckets[int(place), free[0]] = fp
                return True
        for kick in range(_KICKS):
            slot = kick % _SLOTS
            fp, self.buckets[int(at), slot] = np.uint64(self.buckets[int(at), slot]), fp
            at = self._other(at, fp)
            free = np.flatnonzero(self.buckets[int(at)] == 0)
            if len(free):
                self.buckets[int(at), free[0]] = fp
                return True
        return False

    def delete(self, key: np.uint64) -> bool:
        fps, lows = self._of(np.array([key], np.uint64))
        fp, at = fps[0], lows[0] & np.uint64(len(self.buckets) - 1)
        for place in (at, self._other(at, fp)):
            hit = np.flatnonzero(self.buckets[int(place)] == fp)
            if len(hit):
                self.buckets[int(place), hit[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """No key that was inserted and not deleted is missed."""
        fp, low = self._of(keys)
        at = low & np.uint64(len(self.buckets) - 1)
        here = self.buckets[at.astype(np.int64)] == fp[:, None]
        there = self.buckets[self._other(at, fp).astype(np.int64)] == fp[:, None]
        return here.any(axis=1) | there.any(axis=1)

    def to_bytes(self) -> bytes:
        return self.buckets.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, _SLOTS).copy())


def digest(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The key of a line; none if the stripped line has fewer code points than asked."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < least_chars or not key.isascii() and len(key.decode(errors="replace")) < least_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _text_hash(col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("")))


def line_refs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id_col, text_hash, hi, lo): each distinct line key of each row of ``docs``."""
    frame = texts_of(docs, [id_col], text).select(id_col, _text_hash("_text").alias("text_hash"), "_text")

    def work(batch: pa.RecordBatch) -> list:
        found = [{d for d in (digest(x, least_chars) for x in t.split(b"\n")) if d} for t in utf8(batch.column(2))]
        at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        keys = np.frombuffer(b"".join(b"".join(f) for f in found), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
        return [batch.column(0).take(at), batch.column(1).take(at), pa.array(keys[:, 0]), pa.array(keys[:, 1])]

    kind = frame.schema[0].dataType.simpleString()
    return batches(frame, work, f"`{id_col}` {kind}, text_hash bigint, hi bigint, lo bigint")


@dataclass(frozen=True)
class LineStore:
    """Exact counts (hi, lo, n_docs) and filters (shard, buckets); a change gives a new store and leaves the old one as it was."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    least_docs: int = LEAST_DOCS

    @staticmethod
    def build(refs: DataFrame, least_docs: int = LEAST_DOCS, keys_per_shard: int = KEYS_PER_SHARD) -> LineStore:
        counts = cut(refs.groupBy("hi", "lo").agg(F.count("*").alias("n_docs")))
        shards = max(1, math.ceil(counts.count() / keys_per_shard))
        store = LineStore(counts, counts.sparkSession.createDataFrame([], "shard bigint, buckets binary"), shards, least_docs)
        return replace(store, filters=cut(store._filters(counts.filter(F.col("n_docs") >= least_docs).withColumn("put", F.lit(True)))))

    def _shard(self) -> Column:
        return F.pmod(F.col("lo"), F.lit(self.shards)).alias("shard")

    def _filters(self, changes: DataFrame) -> DataFrame:
        """Filters after changes (hi, lo, put): true puts a key in, false takes it out."""
        def change(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            put = new.loc[new["put"], "hi"].to_numpy(np.int64).view(np.uint64)
            out = new.loc[~new["put"], "hi"].to_numpy(np.int64).view(np.uint64)
            if not len(old):
                table = CuckooFilter.build(np.sort(put))
            else:
                table = CuckooFilter.from_bytes(old["buckets"].iloc[0])
                for k in out:
                    table.delete(k)
                if not all([table.insert(k) for k in put]):
                    return pd.DataFrame({"shard": [key[0]], "buckets": [b""]})
            return pd.DataFrame({"shard": [key[0]], "buckets": [table.to_bytes()]})

        keyed = changes.select(self._shard(), "hi", "put")
        return self.filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(change, "shard bigint, buckets binary")

    def _moved(self, refs: DataFrame, sign: int) -> LineStore:
        delta = refs.groupBy("hi", "lo").agg((F.count("*") * sign).alias("d"))
        both = self.counts.join(delta, ["hi", "lo"], "full")
        before = F.coalesce("n_docs", F.lit(0))
        after = before + F.coalesce("d", F.lit(0))
        now = cut(both.select("hi", "lo", before.alias("old"), after.alias("n_docs")))
        if not now.filter("n_docs < 0").isEmpty():
            raise ValueError("documents to remove hold lines that were never added")
        bound = F.lit(self.least_docs)
        crossed = now.filter((F.col("old") >= bound) != (F.col("n_docs") >= bound)).withColumn("put", F.col("n_docs") >= bound)
        filters = cut(self._filters(crossed))
        counts = now.filter("n_docs > 0").select("hi", "lo", "n_docs")
        full = filters.filter(F.length("buckets") == 0).select("shard")
        if not full.isEmpty():  # a filter without room is built anew from the exact counts of its shard
            fresh = replace(self, filters=self.filters.filter("false"))
            again = counts.filter(F.col("n_docs") >= bound).withColumn("put", F.lit(True)).withColumn("s", self._shard())
            again = again.join(full.withColumnRenamed("shard", "s"), "s", "left_semi").drop("s")
            filters = cut(filters.filter(F.length("buckets") > 0).unionByName(fresh._filters(again)))
        return replace(self, counts=counts, filters=filters)

    def add(self, refs: DataFrame) -> LineStore:
        """The store with these documents' lines counted in."""
        return self._moved(refs, 1)

    def remove(self, refs: DataFrame) -> LineStore:
        """The store as if these documents had never been added; an error if a line would count below zero, since then some never were."""
        return self._moved(refs, -1)

    def save(self, folder: str) -> None:
        """Write the state as Parquet; ``load`` gives an equal store, in another session too. An existing folder is an error."""
        self.counts.write.parquet(f"{folder}/counts")
        self.filters.write.parquet(f"{folder}/filters")
        spark = self.counts.sparkSession
        spark.createDataFrame([(self.shards, self.least_docs)], "shards int, least_docs int").coalesce(1).write.parquet(f"{folder}/settings")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LineStore:
        own = spark.read.parquet(f"{folder}/settings").first()
        return LineStore(spark.read.parquet(f"{folder}/counts"), spark.read.parquet(f"{folder}/filters"), own.shards, own.least_docs)

    def frequent(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct ``keys`` (hi, lo) that stand in enough documents: filter first, exact table for the hits."""
        def probe(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
            if not len(table) or not len(rows):
                return rows[["hi", "lo"]].iloc[:0]
            hit = CuckooFilter.from_bytes(table["buckets"].iloc[0]).contains(rows["hi"].to_numpy(np.int64).view(np.uint64))
            return rows.loc[hit, ["hi", "lo"]]

        sharded = keys.select(self._shard(), "hi", "lo").groupBy("shard")
        hits = sharded.cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "hi bigint, lo bigint")
        return hits.join(self.counts.filter(F.col("n_docs") >= self.least_docs), ["hi", "lo"], "left_semi")


def _with_drops(docs: DataFrame, store: LineStore | None, id_col: str, text: str, least_docs: int, least_chars: int) -> DataFrame:
    """``docs`` with one more column, the last: the keys of its lines that are to go (null: none)."""
    drop_id, drop_hash, drop_list = (free_name(docs, f"_drop_{x}") for x in ("id", "hash", "list"))
    refs = line_refs(docs, id_col, text, least_chars)
    store = store or LineStore.build(refs, least_docs)
    gone = cut(store.frequent(store.counts.select("hi", "lo")))
    drops = (refs.join(gone, ["hi", "lo"]).groupBy(F.col(id_col).alias(drop_id), F.col("text_hash").alias(drop_hash))
             .agg(F.collect_set(F.struct("hi", "lo")).alias(drop_list)))
    here = docs.withColumn(free_name(docs, "_text_hash"), _text_hash(text))
    key = here.columns[-1]
    joined = here.join(drops, here[id_col].eqNullSafe(drops[drop_id]) & (here[key] == drops[drop_hash]), "left")
    return joined.select(*[here[f"`{c}`"] for c in docs.columns], drops[drop_list])


def _kept_lines(data: bytes, drops: list | None, least_chars: int) -> tuple[list[bytes], int]:
    lines = data.split(b"\n")
    if not drops:
        return lines, len(lines)
    raw = np.array([(d["hi"], d["lo"]) for d in drops], np.int64).view(np.uint64).astype(">u8").tobytes()
    gone = {raw[i:i + 16] for i in range(0, len(raw), 16)}
    return [x for x in lines if digest(x, least_chars) not in gone], len(lines)


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS,
                  least_chars: int = LEAST_CHARS, store: LineStore | None = None) -> DataFrame:
    """(id_col, n_lines, n_dropped, kept_sha256), one row per row of ``docs``.

    Every row counts as a document, repeated ones too. A null or empty text is one empty line; empty keys never go. Null ids are
    kept as ids. An empty table gives an empty one; other columns are not read."""
    frame = _with_drops(docs.select(id_col, F.col(f"`{text}`").cast("string").alias(text)), store, id_col, text, least_docs, least_chars)

    def work(batch: pa.RecordBatch) -> list:
        n, dropped, shas = [], [], []
        for data, drops in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
            kept, lines = _kept_lines(data, drops, least_chars)
            n.append(lines)
            dropped.append(lines - len(kept))
            shas.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        return [batch.column(0), n, dropped, shas]

    kind = frame.schema[0].dataType.simpleString()
    return batches(frame, work, f"`{id_col}` {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str = "n_chars", least_docs: int = LEAST_DOCS,
          least_chars: int = LEAST_CHARS, store: LineStore | None = None) -> DataFrame:
    """``docs`` without the frequent lines, with all its columns, whatever their names; the length column follows.

    No row goes; null texts stay null. Rows with null ids count as documents like others, and so does each of repeated rows. An empty table
    gives an empty one."""
    frame = _with_drops(docs, store, id_col, text, least_docs, least_chars)
    at, length = docs.columns.index(text), docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(them):
        for batch in (part for whole in them for part in slices(whole)):
            raw, drops = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [None if t is None else b"\n".join(_kept_lines(t, d, least_chars)[0]).decode() if d else t.decode() for t, d in zip(raw, drops)]
            cols = list(batch.columns)[:-1]
            cols[at] = pa.array(new, batch.schema[at].type)
            if length is not None:
                cols[length] = pa.array([len(t) if d and t is not None else n for t, d, n in zip(new, drops, cols[length].to_pylist())],
                                        batch.schema[length].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    return frame.mapInArrow(run, docs.schema)
