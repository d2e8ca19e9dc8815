"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces are packed by decreasing length. A piece goes into the open bin that it leaves least room in. Where none has room, a bin is
opened in the length of least expected cost per token: the cost of a bin is its length plus a fixed overhead, and it can count on being
filled by the smaller pieces still to come. At the end each bin is cut down to the smallest permitted length that holds its contents,
so a last, half-filled bin does not pay for room it never used.

Packing is greedy over a sorted list, so the table is dealt into shards of a bounded number of documents, each packed by one task; with
thousands of pieces to a shard the loss against one list is below a bin or two per shard. Texts are read once, for their length; only
ids and lengths are shuffled. Documents longer than the longest sequence are cut into pieces of that length and a rest.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoevents.llm.common import batches, cut, texts_of, utf8

#: Permitted sequence lengths, in words.
LENGTHS = (256, 512, 1024, 2048, 4096)
#: What a sequence costs besides its length.
OVERHEAD = 16
#: Rows of a shard; bounds what a packing task holds and grows with nothing.
ROWS_PER_SHARD = 20_000


def opening_length(size: int, room_for: int, lengths: tuple[int, ...], overhead: int) -> int:
    """The length of least cost per token for a piece of ``size``, if at most ``room_for`` tokens of smaller pieces are still to come."""
    def cost(length: int) -> float:
        return (length + overhead) / (size + min(length - size, room_for))

    return min((x for x in lengths if x >= size), key=lambda x: (cost(x), x))


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset in the bin, final length of the bin) of each piece. Sizes lie in 1..max(lengths); order among equals is by place."""
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    fill: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    to_come = sum(sizes)
    for i in order:
        size = sizes[i]
        to_come -= size
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            b, left = len(fill), opening_length(size, to_come, lengths, overhead)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if left - size:
            insort(room, (left - size, b))
    final = [lengths[bisect_left(lengths, f)] for f in fill]
    return bins, offsets, [final[b] for b in bins]


def lengths_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_words): words ``[^\\x20\\x09-\\x0D]+`` of each text; null and empty texts have none."""
    def work(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [len(t.split()) for t in utf8(batch.column(1))]]

    frame = texts_of(docs, [id_col], text)
    kind = frame.schema[0].dataType.simpleString()
    return batches(frame, work, f"`{id_col}` {kind}, n_words bigint")


def packed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD,
           rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(id_col, piece, first_word, n_words, bin_id, bin_length, bin_offset), one row per piece; every word of every text is in one piece.

    Texts without words have no piece and no row. Repeated rows are packed each for itself, null ids are kept; an empty table gives an
    empty one; other columns are not read."""
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    sized = cut(lengths_of(docs, id_col, text).filter("n_words > 0").withColumn("_row", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(sized.count() / rows_per_shard))
    kind = sized.schema[0].dataType.simpleString()

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_row")
        words = rows.column("n_words").to_numpy()
        pieces = np.maximum(1, -(-words // longest))
        owner = np.repeat(np.arange(len(words)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = piece * longest
        size = np.minimum(longest, words[owner] - first)
        bins, offsets, final = pack(size.tolist(), lengths, overhead)
        # Ids never leave Arrow: a null among them must not turn the others into floating point numbers.
        cols = [rows.column(0).take(pa.array(owner)), piece, first, size, np.array(bins, np.int64) * shards + key[0].as_py(),
                np.array(final, np.int64), np.array(offsets, np.int64)]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, pa.int64()) for c in cols],
                        names=[id_col, "piece", "first_word", "n_words", "bin_id", "bin_length", "bin_offset"])

    dealt = sized.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(
        work, f"`{id_col}` {kind}, piece bigint, first_word bigint, n_words bigint, bin_id bigint, bin_length bigint, bin_offset bigint")
