"""Shared helpers: tables, Arrow batches, ASCII-only text rules, lineage cuts.

Texts are handled as UTF-8 bytes: ``bytes.lower`` changes A-Z alone and ``bytes.split`` cuts at ``[\\x20\\x09-\\x0D]`` alone, which is
what the operators' contracts ask for, and both run at C speed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoevents.session import cut

__all__ = ["batches", "cut", "texts_of", "utf8", "table", "char_offsets", "slices", "free_name", "WORD_BYTES"]

#: Bytes of text that a task works on at once; a longer text is one slice of its own.
SLICE_BYTES = 4 << 20
#: For ``bytes.translate``: A-Z to a-z, letters, digits and all bytes from 0x80 as they are, every other byte a blank.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def texts_of(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Only the columns that an operator reads, so that the scan reads no others."""
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))


def batches(df: DataFrame, work: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """``work`` turns one Arrow batch into the columns of ``schema``; runs in tasks, on slices of a bounded number of bytes."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for part in slices(batch) if batch.num_rows else ():
                cols = work(part)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(cols, arrow)],
                    schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of at most ``limit`` bytes or of one row: Arrow bounds a batch in rows first."""
    if batch.nbytes <= limit:
        yield batch
        return
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    sizes = np.full(batch.num_rows, 0 if texts else batch.nbytes // batch.num_rows, np.int64)
    for c in texts:
        sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores behind it until no column of ``df`` has that name (upper and lower case are one)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def char_offsets(data: bytes, at: list[int]) -> list[int]:
    """Byte offsets as code-point offsets."""
    if data.isascii() or not at:
        return list(at)
    starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    ends = np.concatenate(([0], starts))
    return [int(ends[i]) for i in at]
