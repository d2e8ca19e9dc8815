"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is its hash and the hashes of two of its beginnings, each a row of one embedding table. Filters of several widths run over the
whole text, the maximum of each over all places goes to one linear layer. Since embeddings are summed and filters are linear, scoring
looks up precomputed products (embedding x filter) instead of multiplying, and takes any length of text in bounded steps.

The fit uses every labelled row that is not held out, dealt into parts of about ``PART_ROWS``. In each epoch every part goes on from the
common weights in a task of its own, and what the parts changed is averaged, block by block of the weights; these are a fixed number of
megabytes and go to the scoring tasks. A part of the labelled rows is kept from the fit and sets where the score stands at 0.3 (the best
F1), and a threshold of its own for each language; its log-odds are tallied in bins, so all of them count. The language chooses that threshold only; it is no input of the score.
"""

from __future__ import annotations

import io
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoevents.llm.common import batches, cut, utf8

#: Labelled rows that a part of the fit should hold, and pieces that the weights are averaged in.
PART_ROWS, PIECES = 5000, 64
#: Bins of the calibration for each unit of log-odds.
BINS = 256
THRESHOLD = 0.3
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.08, 5
_STARTS = (4, 7)
_STEP_WORDS = 150_000
_SPLIT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_COLUMNS = [(w, o) for w in WIDTHS for o in range(w)]  # blocks of FILTERS columns in the table of products


def word_list(data: bytes) -> list[bytes]:
    return data.lower().translate(_SPLIT).split()


def features(words: list[bytes]) -> np.ndarray:
    """Rows of the embedding table of each word; the last row stands for nothing."""
    digest, n = xxhash.xxh32_intdigest, BUCKETS - 1
    hashes = [map(digest, words), *(map(digest, [w[:k] for w in words], repeat(k)) for k in _STARTS)]
    return np.stack([np.fromiter(h, np.uint32, len(words)) % n for h in hashes], axis=1).astype(np.int32)


def numbering() -> defaultdict[bytes, int]:
    """Numbers each new word it is asked for."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    return number


class TextCnn:
    """Embeddings, one filter bank per width, a linear layer."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.table[-1] = 0
        self.filters = {c: rng.normal(0, 0.3, (DIM, FILTERS)).astype(np.float32) for c in _COLUMNS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.offset = np.float32(-2.0)

    def products(self) -> np.ndarray:
        """Embedding x filter for each bucket, all widths and places side by side."""
        return np.concatenate([self.table @ self.filters[c] for c in _COLUMNS], axis=1)

    def pooled(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, product: np.ndarray, places: bool = False):
        """Filter maxima per text over the windows that begin at one of its words. ``ids`` (words x features) holds the texts at
        ``starts``..``ends``, each with at least max(WIDTHS) - 1 empty words after it, so no window reaches into the next text."""
        summed = product.take(ids[:, 0], axis=0)
        for k in range(1, ids.shape[1]):
            summed += product.take(ids[:, k], axis=0)
        tops, at, done = [], [], 0
        for w in WIDTHS:
            value = summed[:, done:done + FILTERS].copy()
            for o in range(1, w):
                value[:-o] += summed[o:, done + o * FILTERS:done + (o + 1) * FILTERS]
            done += w * FILTERS
            top = np.maximum.reduceat(value, np.stack((starts, ends), axis=1).ravel(), axis=0)[::2]
            tops.append(top + self.bias[w])
            if places:
                at.append(np.array([a + np.argmax(value[a:b], axis=0) for a, b in zip(starts, ends)]))
        return np.concatenate(tops, axis=1), at

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.offset

    def arrays(self, seen: dict) -> list[np.ndarray]:
        """All weights and what Adagrad has ``seen`` of their gradients, in a fixed order."""
        keys = ["table", "out", "offset", *_COLUMNS, *[("b", w) for w in WIDTHS]]
        own = [self.table, self.out, self.offset, *[self.filters[c] for c in _COLUMNS], *[self.bias[w] for w in WIDTHS]]
        return [np.asarray(x, np.float32) for x in [*own, *[seen[k] for k in keys]]]

    def load(self, flat: np.ndarray, seen: dict) -> None:
        """Take back what ``arrays`` gave, as one row of numbers."""
        shapes = [x.shape for x in self.arrays(seen)]
        ends = np.cumsum([math.prod(x) for x in shapes])
        got = [x.reshape(shape).copy() for x, shape in zip(np.split(flat, ends[:-1]), shapes)]
        n = len(got) // 2
        self.table, self.out, self.offset = got[0], got[1], np.float32(got[2])
        self.filters, self.bias = dict(zip(_COLUMNS, got[3:3 + len(_COLUMNS)])), dict(zip(WIDTHS, got[3 + len(_COLUMNS):n]))
        seen |= dict(zip(["table", "out", "offset", *_COLUMNS, *[("b", w) for w in WIDTHS]], got[n:]))

    def seen_at_first(self) -> dict:
        seen = {"table": np.full(self.table.shape, 1e-4, np.float32), "out": np.full(self.out.shape, 1e-4, np.float32), "offset": 1e-4}
        seen |= {c: np.full((DIM, FILTERS), 1e-4, np.float32) for c in _COLUMNS} | {("b", w): np.full(FILTERS, 1e-4, np.float32) for w in WIDTHS}
        return seen

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, first: int = 0,
            seen: dict | None = None) -> None:
        """Adagrad on weighted log loss; texts are feature rows with the empty words after them. ``first`` epochs were done before."""
        rng = np.random.default_rng(seed)
        seen = self.seen_at_first() if seen is None else seen
        place = np.zeros(BUCKETS, np.int64)

        def step(value, grad, key, rate):
            seen[key] = seen[key] + grad * grad
            return value - rate * grad / np.sqrt(seen[key])

        for epoch in range(first, first + epochs):
            rate = RATE / (1 + epoch / 2)
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                picked = order[a:a + BATCH]
                ids = np.concatenate([texts[i] for i in picked])
                sizes = np.array([len(texts[i]) for i in picked])
                starts = np.cumsum(sizes) - sizes
                ends = starts + sizes - (max(WIDTHS) - 1)
                met = np.zeros(BUCKETS, bool)
                met[ids] = True
                words = np.flatnonzero(met)
                place[words] = np.arange(len(words))
                back = place[ids]
                rows = self.table[words]
                small = np.concatenate([rows @ self.filters[c] for c in _COLUMNS], axis=1)
                pooled, at = self.pooled(back, starts, ends, small, places=True)
                z = self.logits(pooled)
                dz = (1 / (1 + np.exp(-z)) - labels[picked]) * weights[picked] / len(picked)
                dpool = np.outer(dz, self.out) * (pooled > 0)
                table_grad = np.zeros((len(words), DIM), np.float32)
                new_filters = {}
                for k, w in enumerate(WIDTHS):
                    own = dpool[:, k * FILTERS:(k + 1) * FILTERS]
                    for o in range(w):
                        rows = back[np.minimum(at[k] + o, len(ids) - 1)]  # texts x filters x features
                        vec = self.table[words[rows]].sum(axis=2)
                        new_filters[w, o] = np.einsum("tf,tfd->df", own, vec)
                        g = own[:, :, None] * self.filters[w, o].T[None]
                        for j in range(ids.shape[1]):
                            np.add.at(table_grad, rows[:, :, j].ravel(), g.reshape(-1, DIM))
                    self.bias[w] = step(self.bias[w], own.sum(axis=0), ("b", w), rate)
                for c, grad in new_filters.items():
                    self.filters[c] = step(self.filters[c], grad, c, rate)
                live = np.flatnonzero((table_grad != 0).any(axis=1) & (words != BUCKETS - 1))
                rows = words[live]
                seen["table"][rows] += table_grad[live] ** 2
                self.table[rows] -= rate * table_grad[live] / np.sqrt(seen["table"][rows])
                self.out = step(self.out, np.maximum(pooled, 0).T @ dz, "out", rate)
                self.offset = np.float32(step(self.offset, dz.sum(), "offset", rate))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, product=self.products(), out=self.out, offset=self.offset, **{f"b{w}": self.bias[w] for w in WIDTHS})
        return out.getvalue()


def padded(words: list[bytes]) -> np.ndarray:
    tail = np.full((max(WIDTHS) - 1 + (not words), 1 + len(_STARTS)), BUCKETS - 1, np.int32)
    return np.concatenate((features(words), tail))


def coded(texts: list[bytes]) -> list[np.ndarray]:
    """``padded`` words of each text; a word that comes again is not hashed again."""
    number = numbering()
    numbers = [np.fromiter(map(number.__getitem__, word_list(t)), np.int64) for t in texts]
    nothing = len(number)
    rows = np.concatenate((features(list(number)), np.full((1, 1 + len(_STARTS)), BUCKETS - 1, np.int32)))
    return [rows[np.concatenate((k, np.full(max(WIDTHS) - 1 + (not len(k)), nothing)))] for k in numbers]


class Scorer:
    """A fitted model as tables; scores whole texts."""

    def __init__(self, raw: bytes):
        data = np.load(io.BytesIO(raw))
        self.model = TextCnn.__new__(TextCnn)
        self.product = data["product"]
        self.model.out, self.model.offset = data["out"], data["offset"]
        self.model.bias = {w: data[f"b{w}"] for w in WIDTHS}

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Log-odds of each text. Long texts are taken in overlapping parts whose maxima are joined, so no window is lost."""
        lap, out = max(WIDTHS) - 1, np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        parts: list[tuple[int, list[bytes]]] = []
        held = 0
        for i, t in enumerate(texts):
            words = word_list(t)
            for a in range(0, max(1, len(words)), _STEP_WORDS):
                part = words[a:a + _STEP_WORDS + lap]
                parts.append((i, part))
                held += len(part)
                if held >= _STEP_WORDS:
                    self._pool(parts, out)
                    parts, held = [], 0
        if parts:
            self._pool(parts, out)
        return self.model.logits(out)

    def _pool(self, parts: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        number = numbering()
        nothing, gap = number[b""], max(WIDTHS) - 1
        flat: list[int] = []
        starts, ends = [], []
        for _, words in parts:
            starts.append(len(flat))
            flat += map(number.__getitem__, words) if words else [nothing]
            ends.append(len(flat))
            flat += [nothing] * gap
        rows = features(list(number))
        table = self.product.take(rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            table += self.product.take(rows[:, k], axis=0)
        table[nothing] = 0
        pooled, _ = self.model.pooled(np.array(flat, np.int64)[:, None], np.array(starts), np.array(ends), table)
        np.maximum.at(out, [i for i, _ in parts], pooled)


def best_threshold(scores: np.ndarray, labels: np.ndarray, default: float = THRESHOLD, counts: np.ndarray | None = None) -> float:
    """The middle of the gap below the score at which F1 is largest; the default where a label is missing. With ``counts`` an entry stands
    for so many rows, ``labels`` of which are 1."""
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    if not labels.any() or labels.sum() == counts.sum():
        return default
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.cumsum(counts[order]) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores go together
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])


def held_out(id_col: str) -> Column:
    """crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def packed_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(role, packed, lang, label) of every labelled row, dealt into parts by a hash of the id. Never a held-out row.

    Texts travel and are kept packed: they are most of what is shuffled and written. A partition is a part, so parts are of one size.
    The join shuffles at any size: broadcast, small tables would tell nothing of the disk that large ones take."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    known = cut(labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (fold != 2)).select(
        id_col, F.col(label).cast("int").alias("label"), F.when(fold == 3, "calibrate").otherwise("fit").alias("role")).distinct())
    parts = max(1, math.ceil(known.filter("role = 'fit'").count() / PART_ROWS))
    texts = docs.filter((fold != 2) & F.col("text").isNotNull()).select(
        F.col(id_col), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    kind = texts.schema[0].dataType.simpleString()
    packed = batches(texts, lambda b: [b.column(0), [zlib.compress(t, 1) for t in utf8(b.column(1))], b.column(2)],
                     f"`{id_col}` {kind}, packed binary, lang string")
    rows = packed.join(known.hint("merge"), id_col)
    part = F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")
    return cut(rows.select("role", "packed", "lang", "label", part.alias("part")).repartitionById(parts, "part").drop("part"))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``packed_rows`` with their texts: (role, text, lang, label)."""
    return batches(packed_rows(docs, labels, id_col, label), lambda b: [b.column(0), [zlib.decompress(t).decode() for t in b.column(1).to_pylist()], b.column(2), b.column(3)],
                   "role string, text string, lang string, label int")


def fit_part(rows: pd.DataFrame, weights: tuple[float, float], epochs: int, first: int = 0, flat: np.ndarray | None = None) -> np.ndarray:
    """The weights after some epochs over the rows of a part, from ``flat`` on or from the beginning."""
    texts = [zlib.decompress(x) for x in rows["packed"]]
    y = rows["label"].to_numpy(np.float32)
    order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i]), texts[i], y[i]))
    texts, y = [texts[i] for i in order], y[order]
    model = TextCnn()
    seen = model.seen_at_first()
    if flat is not None:
        model.load(flat, seen)
    model.fit(coded(texts), y, np.where(y == 1, weights[1], weights[0]).astype(np.float32),
              epochs, SEED + first, first, seen)
    return np.concatenate([x.ravel() for x in model.arrays(seen)])


def fit_parts(rows: DataFrame, weights: tuple[float, float]) -> TextCnn:
    """Fit on all packed rows. One part is done in one go. Of several, each does an epoch from the common weights; a weight then moves by the
    mean of what the parts that met it changed, so rare words learn as fast as in their own part."""
    model = TextCnn()
    parts = rows.groupBy(F.spark_partition_id()).agg(F.count("*")).count()

    def changes(flat: np.ndarray | None, epochs: int, first: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [b for b in batches if len(b)]
            if held:
                got = fit_part(pd.concat(held, ignore_index=True), weights, epochs, first, flat)
                moved = got if flat is None else got - flat
                yield pd.DataFrame({"piece": range(PIECES), "moved": [x.tobytes() for x in np.array_split(moved, PIECES)]})

        return rows.select("packed", "label").mapInPandas(run, "piece int, moved binary")

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        moved = np.stack([np.frombuffer(x, np.float32) for x in sorted(pdf["moved"])])
        share = moved.sum(axis=0) / np.maximum(1, np.count_nonzero(moved, axis=0))
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "moved": [share.astype(np.float32).tobytes()]})

    def whole(pieces: list) -> np.ndarray:
        return np.concatenate([np.frombuffer(r.moved, np.float32) for r in sorted(pieces, key=lambda r: r.piece)])

    seen = model.seen_at_first()
    if parts == 1:
        model.load(whole(changes(None, EPOCHS, 0).collect()), seen)
    elif parts:
        flat = np.concatenate([x.ravel() for x in model.arrays(seen)])
        for epoch in range(EPOCHS):
            flat = flat + whole(changes(flat, 1, epoch).groupBy("piece").applyInPandas(mean, "piece int, moved binary").collect())
        model.load(flat, seen)
    return model


def tally(rows: DataFrame, raw: bytes) -> pd.DataFrame:
    """(lang, bin, n, ones) of the log-odds of all packed rows, in bins of a fixed width."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(raw)
        for pdf in batches:
            if len(pdf):
                z = np.clip(scorer.logits([zlib.decompress(x) for x in pdf["packed"]]), -60, 60)
                yield pd.DataFrame({"lang": pdf["lang"], "bin": np.floor(z * BINS).astype(np.int32), "label": pdf["label"]})

    binned = rows.select("packed", "lang", "label").mapInPandas(run, "lang string, bin int, label int")
    return binned.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).toPandas()


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic") -> tuple[bytes, float, dict[str, float]]:
    """(weights, shift of the log-odds, threshold by language) from all labelled rows; the driver gets weights and tallies."""
    rates = labels.filter(F.col(label).isin(0, 1) & ~held_out(id_col)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    share = min(0.5, max(0.01, rates or 0.01))
    rows = packed_rows(docs, labels, id_col, label)
    fit = rows.filter("role = 'fit'")
    ones = fit.agg(F.avg("label")).first()[0] or 0.0
    model = fit_parts(fit, ((1 - share) / (1 - ones), share / ones)) if 0 < ones < 1 else TextCnn()
    raw = model.to_bytes()
    bins = tally(rows.filter("role = 'calibrate'"), raw).sort_values("bin", ignore_index=True)
    aim = math.log(THRESHOLD / (1 - THRESHOLD))

    def cut_of(some: pd.DataFrame, default: float) -> float:
        per = some.groupby("bin")[["n", "ones"]].sum()
        z = (per.index.to_numpy(np.float64) + 0.5) / BINS
        return best_threshold(z, per["ones"].to_numpy(np.int64), default, per["n"].to_numpy(np.int64))

    shift = aim - cut_of(bins, aim)
    by_lang = {str(lang): 1 / (1 + math.exp(-cut_of(some, aim - shift) - shift)) for lang, some in bins.groupby("lang")}
    return raw, shift, by_lang


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id_col, held_out, score, predicted, lang_threshold, flagged), one row per row of ``docs``.

    predicted is 1 if score >= 0.3; flagged compares with the threshold of the row's language (0.3 for one without). Null and empty
    texts are scored as texts without words. Labels other than 0 and 1, and of null ids, are not used; without usable labels the
    weights stay as they began. Null ids are not held out. An empty table gives an empty one; extra columns are not read."""
    raw, shift, by_lang = fitted(docs.withColumnRenamed(text, "text").withColumnRenamed(lang, "lang"), labels, id_col)
    frame = docs.select(id_col, held_out(id_col).alias("held_out"), F.col(f"`{lang}`").cast("string").alias("_lang"),
                        F.col(f"`{text}`").cast("string").alias("_text"))
    kind = frame.schema[0].dataType.simpleString()

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(raw)
        for batch in them:
            if batch.num_rows:
                z = scorer.logits(utf8(batch.column(3))).astype(np.float64)
                score = 1 / (1 + np.exp(-np.clip(z + shift, -60, 60)))
                bound = np.array([by_lang.get(x, THRESHOLD) for x in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(bound),
                     pa.array(score >= bound)],
                    names=[id_col, "held_out", "score", "predicted", "lang_threshold", "flagged"])

    return frame.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, lang_threshold double, flagged boolean")
