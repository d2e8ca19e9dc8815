"""Incremental event store and streams.

The store is a folder of Parquet files in buckets by id hash: ``bucket=k/batch=b`` holds all rows of bucket k as batch b left them. A
batch reads and writes the buckets its own ids fall into and no others; a marker in ``_batches`` commits it, and only then the files
it replaced are removed. So a reader sees whole batches, a batch that broke off is written again from the state before it, a batch that
is committed already changes nothing, and a bucket has one set of files, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from geoevents.operators import spatial as S

#: Buckets of a new store; an existing one keeps its own number.
BUCKETS = 64


# ------------------------------------------------------------------ the folder
class StoreFolder:
    """Listing, committing and cleaning of a store folder. Driver-side, over names only: at most a few per bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        known = self._numbers("_buckets", "")
        self.buckets = known[0] if known else buckets

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        at = self._at(folder) if folder else self._root
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())

    def committed(self) -> int:
        """The last batch that is whole, -1 before the first."""
        return max(self._numbers("_batches", ""), default=-1)

    def versions(self, bucket: int) -> list[int]:
        return self._numbers(f"bucket={bucket}", "batch=")

    def current(self, touched: list[int] | None = None) -> list[str]:
        """Folders that hold the committed rows of the buckets (of all without ``touched``)."""
        last, out = self.committed(), []
        for k in self._numbers("", "bucket=") if touched is None else touched:
            whole = [b for b in self.versions(k) if b <= last]
            if whole:
                out.append(f"{self.path}/bucket={k}/batch={whole[-1]}")
        return out

    def discard(self, batch_id: int) -> None:
        """Remove what an attempt at this batch left behind."""
        for k in self._numbers("", "bucket="):
            if batch_id in self.versions(k):
                self._fs.delete(self._at(f"bucket={k}/batch={batch_id}"), True)

    def commit(self, batch_id: int) -> None:
        self._fs.create(self._at(f"_buckets/{self.buckets}"), True).close()
        self._fs.create(self._at(f"_batches/{batch_id}"), True).close()
        for b in self._numbers("_batches", ""):
            if b < batch_id:
                self._fs.delete(self._at(f"_batches/{b}"), False)

    def clean(self, touched: list[int]) -> None:
        """Remove the files that a committed batch replaced."""
        last = self.committed()
        for k in touched:
            whole = [b for b in self.versions(k) if b <= last]
            for b in whole[:-1]:
                self._fs.delete(self._at(f"bucket={k}/batch={b}"), True)


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """All committed rows; an absent store is empty."""
    return _read(spark, StoreFolder(spark, path).current(), schema)


def _read(spark: SparkSession, folders: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, batch_id: int, path: str, id_col: str, merged: Callable[[DataFrame, DataFrame], DataFrame],
                buckets: int = BUCKETS) -> None:
    """Replace the buckets that the ids of a batch fall into by ``merged(stored rows, batch rows)``."""
    spark = batch.sparkSession
    store = StoreFolder(spark, path, buckets)
    if batch_id <= store.committed():
        return
    store.discard(batch_id)
    bucket = F.pmod(F.xxhash64(id_col), F.lit(store.buckets)).cast("int")
    rows = batch.persist()
    try:
        touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())  # at most one number per bucket
        if touched:
            stored = _read(spark, store.current(touched), batch.schema)
            out = merged(stored, rows).select(*batch.columns, bucket.alias("bucket"), F.lit(batch_id).cast("bigint").alias("batch"))
            out.repartition(len(touched), "bucket").write.mode("append").partitionBy("bucket", "batch").parquet(path)
        store.commit(batch_id)
        store.clean(touched)
    finally:
        rows.unpersist()


# ------------------------------------------------------------------ what a store keeps
def latest(df: DataFrame, id_col: str, version: list[str]) -> DataFrame:
    """Newest version per id. An aggregate, not a window: copies of a hot id are reduced on
    every task before they meet."""
    rest = [c for c in df.columns if c != id_col]
    newest = F.max_by(F.struct(*rest), F.struct(*version))
    return df.groupBy(id_col).agg(newest.alias("_r")).select(id_col, *[F.col(f"_r.{c}") for c in rest])


def latest_first(df: DataFrame, id_col: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != id_col]
    picked = df.groupBy(id_col).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return picked.select(id_col, *[F.col(f"_r.{c}") for c in rest])


def append_dedupe_batch(existing: DataFrame, incoming: DataFrame, id_col: str, order: str) -> DataFrame:
    """Stored rows plus the first copy of every unseen id."""
    first = latest_first(incoming, id_col, order)
    return existing.unionByName(first.join(existing.select(id_col).distinct(), id_col, "left_anti").select(*existing.columns))


def newest_batch(existing: DataFrame, incoming: DataFrame, id_col: str, version: str) -> DataFrame:
    """The newest version per id of both; of equal versions the incoming one."""
    both = existing.withColumn("_new", F.lit(False)).unionByName(incoming.withColumn("_new", F.lit(True)))
    return latest(both, id_col, [version, "_new"]).drop("_new")


def append_unseen(batch: DataFrame, batch_id: int, path: str, id_col: str, order: str, buckets: int = BUCKETS) -> None:
    """Add the rows of a batch whose id the store does not hold; of copies in the batch the first by ``order``."""
    merge_batch(batch, batch_id, path, id_col, lambda old, new: append_dedupe_batch(old, new, id_col, order), buckets)


def append_dedupe(stream: DataFrame, path: str, checkpoint: str, *, id_col: str, ts_col: str) -> DataStreamWriter:
    """Append only unseen ids, however late: known ids are looked up in the buckets of the batch's
    own ids, so no row is dropped for its age and no batch reads the whole store."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: append_unseen(batch, batch_id, path, id_col, ts_col))


def put_newest(batch: DataFrame, batch_id: int, path: str, id_col: str, version: str, buckets: int = BUCKETS) -> None:
    """Put the rows of a batch in the place of older versions of their ids."""
    merge_batch(batch, batch_id, path, id_col, lambda old, new: newest_batch(old, new, id_col, version), buckets)


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, *, id_col: str = "id", version: str = "version") -> DataStreamWriter:
    """Keep the newest version per id; ``read_store`` shows it."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: put_newest(batch, batch_id, path, id_col, version))


def read_latest(spark: SparkSession, path: str, schema, *, id_col: str = "id", version: str = "version") -> DataFrame:
    """The newest version per id, as ``upsert_latest`` left it."""
    return read_store(spark, path, schema)


def checkpoint_state(df: DataFrame, account: str, id_col: str, ts_col: str) -> DataFrame:
    """Newest id, count and last time per account (a stream runs it in update mode)."""
    return df.groupBy(account).agg(
        F.max_by(id_col, F.struct(ts_col, id_col)).alias("newest_id"), F.count(F.lit(1)).alias("n"),
        F.max(ts_col).alias("updated_at"))


def rolling_score(scored: DataFrame, by: list[str], *, ts_col: str = "ts", days: int = 30,
                  slide: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Severity sum and events per unit over sliding windows; works on streams and tables."""
    base = scored.withWatermark(ts_col, delay) if scored.isStreaming else scored
    # one row per slide and unit first, so a row is copied to the long windows only once a day
    daily = base.groupBy(F.window(ts_col, slide).alias("_w"), *by).agg(
        F.sum("s_event").alias("s_sum"), F.count(F.lit(1)).alias("n"))
    return daily.groupBy(F.window(F.window_time("_w"), f"{days} days", slide), *by).agg(
        F.sum("s_sum").alias("s_sum"), F.sum("n").alias("n")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "s_sum", "n")


def stream_zone_counts(stream: DataFrame, index: DataFrame, *, ts_col: str = "ts", window: str = "1 hour",
                       delay: str = "2 hours", cell_size: float = S.CELL_DEG) -> DataFrame:
    """Points of a stream joined to zones (stream–static), counted per window and zone."""
    zoned = S.join_points_to_zones(stream, index, how="inner", cell_size=cell_size)
    base = zoned.withWatermark(ts_col, delay) if zoned.isStreaming else zoned
    return base.groupBy(F.window(ts_col, window), "zone_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), "zone_id", "n")
