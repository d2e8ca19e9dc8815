"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``bits`` <= 4 bits agree in at least four of their eight bytes, the guaranteed
minimum. The index posts a fingerprint under triples of positional bytes (position and value). The 20 triples are a covering: any
four positions contain one of them, so every such pair meets in a list, and a list holds 2^-24 of unrelated fingerprints where one
byte would hold 2^-8. Inside a list the shared positional bytes of each pair are tallied; pairs below four are dropped, the rest is
verified by counting differing bits.

Long lists (a dense group of near copies) are refined, never capped: first by one more positional byte, then by half bytes, until a
list holds at most 65,536 distinct fingerprints by construction. A list yields a spanning forest of its links, not its pairs.
Equal fingerprints are one node, so exact copies cost nothing after a partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoevents.llm.common import batches, cut, texts_of, utf8
from geoevents.llm.components import components

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
#: Bytes that a linked pair shares at least: each differing bit spoils one byte at most.
LEAST_SHARED = 8 - MAX_BITS
#: Lists longer than this are refined by a longer key. Only a matter of speed.
LONG_LIST = 8192
_STEP = 1 << 16


def covering_triples() -> list[tuple[int, ...]]:
    """20 triples of the 8 positions such that any 4 positions contain one (Turan's construction on 3 classes)."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [c for c in classes if len(c) == 3]
    for i, c in enumerate(classes):
        out += [(*pair, x) for pair in combinations(c, 2) for x in classes[(i + 1) % 3]]
    return [tuple(sorted(t)) for t in out]


def _mask(units: tuple[int, ...], width: int) -> int:
    return sum(((1 << width) - 1) << (width * u) for u in units)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


TRIPLE_MASKS = [_mask(t, 8) for t in covering_triples()]
#: For a set of equal positions (as 8 bits), the first triple inside it: the list in which a pair is reported.
_FIRST = np.array([next((i for i, t in enumerate(covering_triples()) if all(z >> p & 1 for p in t)), -1) for z in range(256)], np.int16)
_MASK_NO = {m: i for i, m in enumerate(TRIPLE_MASKS)}


def fingerprint(data: bytes, size: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text; 0 where it has no words. Long texts are hashed in steps, so memory stays bounded."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    first, last = starts[:n].tolist(), ends[min(size, len(words)) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        hashes = np.array([digest(line[a:b], HASH_SEED) for a, b in zip(first[at:at + _STEP], last[at:at + _STEP])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, text_hash, fp bigint), one row per row of ``docs``. Null and empty texts have fingerprint 0."""
    def work(batch: pa.RecordBatch) -> list:
        fps = np.array([fingerprint(b) for b in utf8(batch.column(2))], np.uint64)
        return [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))]

    frame = texts_of(docs, [id_col], text).select(id_col, _text_hash("_text").alias("text_hash"), "_text")
    kind = frame.schema[0].dataType.simpleString()
    return batches(frame, work, f"`{id_col}` {kind}, text_hash bigint, fp bigint")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def _equal_positions(x: np.ndarray) -> np.ndarray:
    """Which bytes are zero, as 8 bits."""
    return np.packbits(np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0, axis=-1, bitorder="little")[..., 0]


def linked(x: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """Count filter, then verification, on XORs of fingerprints."""
    kept = np.bitwise_count(_equal_positions(x)) >= LEAST_SHARED
    kept[kept] = np.bitwise_count(x[kept]) <= bits
    return kept


def spanning_links(fps: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that connect what is connected in one list; each fingerprint is compared with those not reached so far."""
    found: list[tuple[int, int]] = []
    left = fps
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            a, frontier = frontier[0], frontier[1:]
            hit = linked(left ^ a, bits)
            if hit.any():
                reached = left[hit]
                found += [(int(a), int(b)) for b in reached]
                frontier, left = np.concatenate((frontier, reached)), left[~hit]
    return found


def _scan_lists(them: Iterator[pa.RecordBatch], bits: int, long_list: int, first_level: bool) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) in order of (mask, key): links of each list (mask 0), or the rows of a long list as they are."""
    names = ["mask", "a", "b"]

    def rows(mask, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.uint64).view(np.int64)) for c in (mask, a, b)], names)

    def links_of(mask, key, fp):
        n = len(fp)
        new = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
        size = np.diff(np.append(new, n))
        run = np.repeat(np.arange(len(new)), size)
        small = np.repeat((size > 1) & (size <= 8), size)
        for lag in range(1, 8):
            i = np.flatnonzero(small[:-lag] & (run[lag:] == run[:-lag])) if n > lag else np.empty(0, np.int64)
            if not len(i):
                break
            x = fp[i] ^ fp[i + lag]
            good = linked(x, bits)
            if first_level:  # a pair meets in several lists; the first one reports it
                nos = np.array([_MASK_NO[int(m)] for m in mask[i[good]]], np.int16)
                good[good] = _FIRST[_equal_positions(x[good])] == nos
            if good.any():
                yield rows(np.zeros(good.sum()), fp[i[good]], fp[i[good] + lag])
        for k in np.flatnonzero(size > 8):
            got = spanning_links(fp[new[k]:new[k] + size[k]], bits)
            if got:
                a, b = np.array(got, np.uint64).T
                yield rows(np.zeros(len(a)), a, b)

    held, running_long = None, None
    for batch in them:
        cols = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        mask, key, fp = cols
        if not len(fp):
            continue
        if running_long is not None:
            same = (mask == running_long[0]) & (key == running_long[1])
            k = len(same) if same.all() else int(np.argmin(same))
            if k:
                yield rows(mask[:k], fp[:k], fp[:k])
            mask, key, fp = mask[k:], key[k:], fp[k:]
            if not len(fp):
                held = None
                continue
            running_long = None
        other = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
        cut_at = int(other[-1]) + 1 if len(other) else 0
        done, held = (mask[:cut_at], key[:cut_at], fp[:cut_at]), (mask[cut_at:], key[cut_at:], fp[cut_at:])
        if cut_at:
            new = np.flatnonzero(np.concatenate(([True], (done[0][1:] != done[0][:-1]) | (done[1][1:] != done[1][:-1]))))
            size = np.diff(np.append(new, cut_at))
            long_rows = np.repeat(size > long_list, size)
            if long_rows.any():
                yield rows(done[0][long_rows], done[2][long_rows], done[2][long_rows])
            if not long_rows.all():
                yield from links_of(*[c[~long_rows] for c in done])
        if len(held[0]) > long_list:
            running_long = (held[0][0], held[1][0])
            yield rows(held[0], held[2], held[2])
            held = None
    if held is not None and len(held[0]):
        yield from links_of(*held)


def _finer(batch: pa.RecordBatch, level: int) -> list:
    """Longer keys for the rows (mask, fp) of long lists: one more byte, then four of the eight half bytes left."""
    mask, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
    out_mask, out_fp = [], []
    for m in np.unique(mask):
        here = fp[mask == m]
        width = 8 if level == 1 else 4
        free = [u for u in range(64 // width) if not int(m) >> (width * u) & ((1 << width) - 1)]
        extra = combinations(free, 1 if level == 1 else len(free) - MAX_BITS)
        for units in extra:
            out_mask.append(np.full(len(here), int(m) | _mask(units, width), np.uint64))
            out_fp.append(here)
    m, f = np.concatenate(out_mask), np.concatenate(out_fp)
    return [pa.array(c.view(np.int64)) for c in (m, m & f, f)]


def links(fps: DataFrame, bits: int = MAX_BITS, long_list: int = LONG_LIST) -> DataFrame:
    """Distinct ``fps`` (fp bigint) to links (a, b) that connect exactly what pairs at ``bits`` or fewer differing bits connect."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits must lie in 0..{MAX_BITS}")
    masks = F.array(*[F.lit(_signed(m)) for m in TRIPLE_MASKS])
    posted = (fps.select(F.explode(masks).alias("mask"), "fp").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp"))
    out, level = None, 1
    while True:
        limit = long_list if level < 3 else 1 << 17
        ordered = posted.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = cut(ordered.mapInArrow(lambda it, lim=limit, one=level == 1: _scan_lists(it, bits, lim, one), "mask bigint, a bigint, b bigint"))
        here = found.filter("mask = 0").select("a", "b")
        out = here if out is None else out.unionByName(here)
        rest = found.filter("mask <> 0").select("mask", F.col("a").alias("fp"))
        if level == 3 or rest.isEmpty():
            return out.distinct()
        posted = batches(rest, lambda b, lv=level: _finer(b, lv), "mask bigint, key bigint, fp bigint").distinct()
        level += 1


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _rooted(docs: DataFrame, id_col: str, text: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """The marked rows, and (fp, root, component_id) of every fingerprint."""
    marked = cut(fingerprints(docs, id_col, text))
    nodes = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = components(links(nodes.select("fp"), bits)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked, rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per row of ``docs``; component_id is the smallest id reachable over links.

    Null or empty texts have fingerprint zero and link like others. Null ids stay rows with a component but never name one (null if
    a component has no other id). Repeated rows stay repeated. An empty table gives an empty one."""
    marked, rooted = _rooted(docs, id_col, text, bits)
    return marked.join(rooted, "fp").select(id_col, hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row of each group, with all columns of ``docs``: the smallest id's, then the smallest text hash's; a null id comes last.
    Of several rows with that id and text one stays, the one whose columns hash lowest. Columns may have any name; an empty table gives an
    empty one."""
    marked, rooted = _rooted(docs, id_col, text, bits)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash"))
    lead = marked.join(rooted, "fp").groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.id").alias("_id"), F.col("o.hash").alias("_hash"))
    every = [F.col(f"`{c}`") for c in docs.columns]
    here = docs.select(F.struct(*every).alias("row"), F.col(f"`{id_col}`").alias("id"), _text_hash(text).alias("hash"), F.xxhash64(*every).alias("order"))
    kept = here.join(lead, here["id"].eqNullSafe(lead["_id"]) & (here["hash"] == lead["_hash"]), "left_semi")
    return kept.groupBy("id", "hash").agg(F.min_by("row", "order").alias("row")).select("row.*")
