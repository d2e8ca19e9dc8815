"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. What speaks for either are measures of the line and of the lines before and after it (shares of
symbols, capitals, digits, repeated words and windows, word length, number of words, how often the line stands in the text), each cut
into a few bins with a weight per bin; a 2 x 2 table of transitions ties neighbours together. The chance that a line is good is its
marginal by forward-backward, and a document's quality is the mean of these chances, weighted by the lines' lengths.

Forward-backward runs over all lines of a slice of texts as one chain: the step into a text's first line does not depend on the
state before it, so texts do not touch. The chain is folded into about sqrt(n) blocks whose 2 x 2 products are taken side by side, then
entered from left to right, then walked side by side again: three vectorised passes in place of a loop over lines.

Labels stand on documents, not on lines. Lines of a good document are good. Lines of a bad one start as bad; after a fit without
transitions, those that look clearly good are taken as good, as long as they are the lesser part of the text. Then the chain is fitted. The
fit uses every labelled row that is not held out, of any length: bins without texts, dealt into parts of about ``PART_ROWS``. A step goes by the
gradient of all lines, which the parts' tasks add up, each over slices of about ``SLICE_LINES``; a single part is fitted in one task. A part of
the labelled rows is kept from the fit and sets where the score stands at 0.7 (the best F1 over all of them, by one range sort).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoevents.llm.common import batches, cut, utf8
from geoevents.llm.toxicity import held_out

#: Labelled rows that a part of the fit should hold, and lines that are worked on at once; a longer text is a slice of its own.
PART_ROWS, SLICE_LINES = 5000, 100_000
THRESHOLD = 0.7
ITERATIONS, RATE, DECAY = 100, 0.1, 1e-4
#: A line of a bad document is taken as good if the line measures alone give it this chance or more.
CLEARLY_GOOD = 0.9

_SHARES = (0.01, 0.04, 0.1, 0.2, 0.35, 0.5, 0.75)
_COUNTS = (1, 2, 4, 8, 16, 32, 64)
#: Measures of a line and the borders of their bins.
MEASURES = {
    "symbols": _SHARES, "capitals": _SHARES, "digits": _SHARES, "marks": _SHARES, "exclamations": _SHARES, "beyond_ascii": _SHARES,
    "word_bytes": (1.5, 2.5, 3.5, 5, 7, 10, 15), "words": _COUNTS, "same_words": _SHARES, "adjacent_words": _SHARES,
    "same_windows": _SHARES, "same_lines": (1.5, 2.5, 4.5, 8.5, 16.5, 32.5, 64.5),
}
_BINS = 9  # eight of a line, one for "no such line"
_NONE = _BINS - 1
_LOWER, _UPPER, _DIGIT, _SYMBOL, _MARK, _BANG, _BEYOND, _BLANK = range(8)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[0x80:] = _BEYOND
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT),
                      (b"#*$%&|<>{}[]\\^~_=+@/", _SYMBOL), (b"!", _BANG), (b" \t\n\x0b\x0c\r", _BLANK)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _kind


def line_bins(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of each line, number of each line's text, weight of each line); an empty text is one empty line."""
    parts = [t.split(b"\n") for t in texts]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    lines = [line for p in parts for line in p]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.repeat(np.arange(len(lines)), sizes)
    kinds = np.bincount(at * 8 + _CLASS[np.frombuffer(b"".join(lines), np.uint8)], minlength=8 * len(lines)).reshape(-1, 8)
    words = np.zeros((len(lines), 4))  # words, repeated ones, equal to the word before, repeated windows
    for i, line in enumerate(lines):
        own = line.split()
        if len(own) > 1:
            nexts = own[1:]
            windows = len(own) - 2
            words[i] = (len(own), len(own) - len(set(own)), sum(map(eq, own, nexts)),
                        windows - len(set(zip(own, nexts, own[2:]))) if windows > 1 else 0)
        else:
            words[i, 0] = len(own)
    often = np.concatenate([np.fromiter(map(Counter(p).__getitem__, p), np.int64, len(p)) for p in parts])
    n, filled = np.maximum(words[:, 0], 1), np.maximum(sizes - kinds[:, _BLANK], 1)
    letters = np.maximum(kinds[:, _LOWER] + kinds[:, _UPPER], 1)
    values = {
        "symbols": kinds[:, _SYMBOL] / filled, "capitals": kinds[:, _UPPER] / letters, "digits": kinds[:, _DIGIT] / filled,
        "marks": kinds[:, _MARK] / filled, "exclamations": kinds[:, _BANG] / filled, "beyond_ascii": kinds[:, _BEYOND] / filled,
        "word_bytes": (sizes - kinds[:, _BLANK]) / n, "words": words[:, 0], "same_words": words[:, 1] / n,
        "adjacent_words": words[:, 2] / n, "same_windows": words[:, 3] / n, "same_lines": np.where(words[:, 0] > 0, often, 1),
    }
    bins = np.stack([np.searchsorted(borders, values[m], side="right") for m, borders in MEASURES.items()], axis=1).astype(np.uint8)
    return bins, owner, sizes + 1.0


def with_neighbours(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bins of each line, the line before and the line after; ``first`` marks the first line of each text."""
    before, after = np.full_like(bins, _NONE), np.full_like(bins, _NONE)
    inside = np.flatnonzero(~first)
    before[inside], after[inside - 1] = bins[inside - 1], bins[inside]
    return np.concatenate((bins, before, after), axis=1)


def firsts(owner: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)


def running(steps: np.ndarray) -> np.ndarray:
    """Row vectors v_t = v_{t-1} steps_t, each scaled to sum 1, from v = (1/2, 1/2): blocks side by side, then in turn, then again."""
    n = len(steps)
    width = max(1, math.isqrt(n))
    rows = -(-n // width)
    folded = np.concatenate((steps, np.broadcast_to(np.eye(2), (rows * width - n, 2, 2)))).reshape(rows, width, 2, 2)
    product = np.broadcast_to(np.eye(2), (rows, 2, 2))
    for k in range(width):
        product = product @ folded[:, k]
        product = product / product.max(axis=(1, 2), keepdims=True)
    enter = np.empty((rows, 2))
    v = np.array([0.5, 0.5])
    for r in range(rows):
        enter[r] = v
        v = v @ product[r]
        v = v / v.sum()
    out = np.empty((rows, width, 2))
    for k in range(width):
        enter = (enter[:, None] @ folded[:, k])[:, 0]
        enter = enter / enter.sum(axis=1, keepdims=True)
        out[:, k] = enter
    return out.reshape(-1, 2)[:n]


def forward_backward(lean: np.ndarray, first: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of good per line, joint chance of (state before, state) per line) of chains that begin at ``first``.

    ``lean`` is the log-odds that a line alone gives to good, ``ties`` the 2 x 2 log-weights of (before, now); state 1 is good."""
    step = np.exp(np.where(first[:, None, None], 0.0, ties[None]))
    step[:, :, 1] *= np.exp(np.clip(lean, -30, 30))[:, None]
    forward = running(step)
    backward = np.full((len(lean), 2), 0.5)
    backward[:-1] = running(step[:0:-1].transpose(0, 2, 1))[::-1]
    both = forward * backward
    chance = both[:, 1] / both.sum(axis=1)
    enter = np.concatenate((np.full((1, 2), 0.5), forward[:-1]))
    joint = enter[:, :, None] * step * backward[:, None, :]
    return chance, joint / joint.sum(axis=(1, 2), keepdims=True)


class LineCrf:
    """Weights per (place, measure, bin) and the ties of neighbouring states."""

    def __init__(self, weights: np.ndarray | None = None, ties: np.ndarray | None = None):
        self.weights = np.zeros((3 * len(MEASURES), _BINS)) if weights is None else weights
        self.ties = np.zeros((2, 2)) if ties is None else ties

    def lean(self, wide: np.ndarray) -> np.ndarray:
        out = np.zeros(len(wide))
        for k in range(wide.shape[1]):
            out += self.weights[k][wide[:, k]]
        return out

    def gradient(self, wide: np.ndarray, first: np.ndarray, good: np.ndarray, share: np.ndarray,
                 chained: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Of the log-likelihood of the line labels, each line's part weighted: what is seen less what is expected."""
        lean = self.lean(wide)
        chance, joint = forward_backward(lean, first, self.ties) if chained else (1 / (1 + np.exp(-lean)), None)
        off = share * (good - chance)
        by_bin = np.stack([np.bincount(wide[:, k], off, _BINS) for k in range(wide.shape[1])])
        if not chained:
            return by_bin, None
        inner = ~first
        seen = np.zeros((2, 2))
        np.add.at(seen, (good[:-1][inner[1:]], good[1:][inner[1:]]), share[1:][inner[1:]])
        return by_bin, seen - (joint[inner] * share[inner][:, None, None]).sum(axis=0)

    def climb(self, gradients: Callable[[LineCrf], list[np.ndarray]], chained: bool = True) -> None:
        """Adam by what ``gradients`` gives for all lines at once."""
        values = (self.weights, self.ties)[:2 if chained else 1]
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in values]
        for i in range(1, ITERATIONS + 1):
            for x, g, (m, s) in zip(values, gradients(self), state):
                g = g - DECAY * x
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                x += RATE * (m / (1 - 0.9 ** i)) / (np.sqrt(s / (1 - 0.99 ** i)) + 1e-8)

    def qualities(self, bins: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """Log-odds of each text's length-weighted mean chance."""
        first = firsts(owner)
        chance, _ = forward_backward(self.lean(with_neighbours(bins, first)), first, self.ties)
        mean = np.bincount(owner, chance * weight, texts) / np.bincount(owner, weight, texts)
        mean = np.clip(mean, 1e-9, 1 - 1e-9)
        return np.log(mean / (1 - mean))


def line_labels(lean: np.ndarray, owner: np.ndarray, good_text: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """1 for lines of good texts, and for the clearly good lines of bad ones where these are the lesser part of the text."""
    clear = lean >= math.log(CLEARLY_GOOD / (1 - CLEARLY_GOOD))
    n = int(owner.max()) + 1
    lesser = 2 * np.bincount(owner, weight * clear, n) < np.bincount(owner, weight, n)
    return np.where(good_text[owner] | (clear & lesser[owner]), 1, 0)


def training_bins(docs: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(role, label, h, bins, weights) of every labelled row that is not held out and has a text. Never a text.

    Texts are measured before they meet their labels, so it is their bins that are shuffled. ``h`` is a hash of id and text."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (fold != 2)).select(
        id_col, F.col(label).cast("int").alias("label"), F.when(fold == 3, "calibrate").otherwise("fit").alias("role")).distinct()
    texts = docs.filter((fold != 2) & F.col("_text").isNotNull()).select(id_col, F.xxhash64(id_col, "_text").alias("h"), "_text")
    kind = texts.schema[0].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> list:
        bins, owner, weight = line_bins(utf8(batch.column(2)))
        ends = np.append(np.flatnonzero(firsts(owner)), len(owner))
        spans = list(zip(ends[:-1], ends[1:]))
        return [batch.column(0), batch.column(1), [bins[a:b].tobytes() for a, b in spans], [weight[a:b].tobytes() for a, b in spans]]

    measured = batches(texts, work, f"`{id_col}` {kind}, h bigint, bins binary, weights binary")
    return measured.join(known, id_col).select("role", "label", "h", "bins", "weights")


def _joined(bins: list[bytes], weights: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = [np.frombuffer(b, np.uint8).reshape(-1, len(MEASURES)) for b in bins]
    return np.concatenate(own), np.repeat(np.arange(len(own)), [len(b) for b in own]), np.concatenate([np.frombuffer(w) for w in weights])


class Lines:
    """Lines of whole texts: bins, firsts, labels of lines (at first of their texts), weights, shares of the fit."""

    KINDS = {"bins": np.uint8, "first": np.bool_, "good": np.int64, "weight": np.float64, "share": np.float64}
    SCHEMA = ", ".join(f"{c} binary" for c in KINDS)

    def __init__(self, bins, first, good, weight, share):
        self.bins, self.first, self.good, self.weight, self.share = bins.reshape(-1, len(MEASURES)), first, good, weight, share

    @classmethod
    def of(cls, row: dict) -> Lines:
        return cls(*(np.frombuffer(row[c], kind) for c, kind in cls.KINDS.items()))

    def row(self) -> dict:
        return {c: np.ascontiguousarray(getattr(self, c), kind).tobytes() for c, kind in self.KINDS.items()}

    def gradient(self, model: LineCrf, chained: bool) -> tuple[np.ndarray, np.ndarray | None]:
        return model.gradient(with_neighbours(self.bins, self.first), self.first, self.good, self.share, chained)

    def relabelled(self, alone: LineCrf) -> Lines:
        owner = np.cumsum(self.first) - 1
        lean = alone.lean(with_neighbours(self.bins, self.first))
        return Lines(self.bins, self.first, line_labels(lean, owner, self.good[self.first] == 1, self.weight), self.weight, self.share)


def _in_slices(rows: pd.DataFrame, per_text: tuple[float, float]) -> Iterator[Lines]:
    """Lines of a part, in slices. Every text weighs the same among those of its label, its lines by their lengths."""
    rows = rows.sort_values(["h", "bins", "label"], ignore_index=True)
    ends, at = np.cumsum(rows["bins"].map(len).to_numpy() // len(MEASURES)), 0
    while at < len(rows):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_LINES, side="right")))
        own = rows.iloc[at:stop]
        bins, owner, weight = _joined(list(own["bins"]), list(own["weights"]))
        good = own["label"].to_numpy(np.int64)[owner]
        yield Lines(bins, firsts(owner), good, weight, weight / np.bincount(owner, weight)[owner] * np.array(per_text)[good])
        at = stop


def _summed(lines: Iterator[Lines], model: LineCrf, chained: bool) -> list[np.ndarray]:
    out = [np.zeros_like(model.weights), np.zeros_like(model.ties)]
    for own in lines:
        for total, g in zip(out, own.gradient(model, chained)):
            if g is not None:
                total += g
    return out


def fit_part(lines: list[Lines]) -> LineCrf:
    """All of the fit over lines held in one place."""
    alone, model = LineCrf(), LineCrf()
    alone.climb(lambda m: _summed(iter(lines), m, False), chained=False)
    lines = [own.relabelled(alone) for own in lines]
    model.climb(lambda m: _summed(iter(lines), m, True))
    return model


def fit_parts(lines: DataFrame) -> LineCrf:
    """The same over rows of ``Lines``: a job each step, in which each partition adds up its slices."""
    def each(df: DataFrame, work: Callable[[Iterator[Lines]], Iterator[dict]], schema: str) -> DataFrame:
        def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in work(Lines.of(r) for batch in them for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                yield pa.RecordBatch.from_pylist([row])

        return df.mapInArrow(run, schema)

    def gradients(df: DataFrame, model: LineCrf, chained: bool) -> list[np.ndarray]:
        def work(own: Iterator[Lines]) -> Iterator[dict]:
            yield {"weights": (got := _summed(own, model, chained))[0].tobytes(), "ties": got[1].tobytes()}

        rows = each(df, work, "weights binary, ties binary").collect()  # in order of the partitions
        return [np.sum([np.frombuffer(r[k]) for r in rows], axis=0).reshape(x.shape) for k, x in enumerate((model.weights, model.ties))]

    alone, model = LineCrf(), LineCrf()
    alone.climb(lambda m: gradients(lines, m, False), chained=False)
    told = cut(each(lines, lambda own: (x.relabelled(alone).row() for x in own), Lines.SCHEMA))
    model.climb(lambda m: gradients(told, m, True))
    return model


def fit(rows: DataFrame, counts: tuple[int, int], share_of_good: float) -> LineCrf:
    """The model of all ``rows`` (label, h, bins, weights), ``counts`` of them bad and good; labels stand as often as among all labelled rows."""
    per_text = (1 - share_of_good) / counts[0], share_of_good / counts[1]
    parts = math.ceil(sum(counts) / PART_ROWS)
    dealt = rows.select("label", "h", "bins", "weights", F.pmod("h", F.lit(parts)).cast("int").alias("part")).repartitionById(parts, "part")

    def held(them: Iterator[pd.DataFrame]) -> Iterator[Lines]:
        own = [pdf for pdf in them if len(pdf)]
        return _in_slices(pd.concat(own), per_text) if own else iter(())

    if parts == 1:
        def whole(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if lines := list(held(them)):
                model = fit_part(lines)
                yield pd.DataFrame({"weights": [model.weights.tobytes()], "ties": [model.ties.tobytes()]})

        got = dealt.mapInPandas(whole, "weights binary, ties binary").first()
        return LineCrf(np.frombuffer(got.weights).reshape(-1, _BINS), np.frombuffer(got.ties).reshape(2, 2))

    def sliced(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in held(them):
            yield pd.DataFrame([own.row()])

    return fit_parts(cut(dealt.mapInPandas(sliced, Lines.SCHEMA)))


def best_cut(scores: DataFrame, default: float) -> float:
    """``toxicity.best_threshold`` over rows (z, label): ranked by one range sort, each partition tells its best."""
    tally = scores.groupBy("z").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    tally = cut(tally.repartitionByRange(F.desc("z")).sortWithinPartitions(F.desc("z")))
    parts = {r.part: r for r in tally.groupBy(F.spark_partition_id().alias("part")).agg(
        F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.max("z").alias("top")).collect()}
    ones, n, before, seen = sum(r.ones for r in parts.values()), sum(r.n for r in parts.values()), {}, (0, 0)
    if not ones or ones == n:
        return default
    for part in sorted(parts):
        before[part] = seen
        seen = seen[0] + parts[part].n, seen[1] + parts[part].ones

    def work(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [pdf for pdf in them if len(pdf)]
        if own:
            pdf, part = pd.concat(own), TaskContext.get().partitionId()
            z, hit = pdf["z"].to_numpy(), before[part][1] + np.cumsum(pdf["ones"].to_numpy())
            f1 = 2 * hit / (before[part][0] + np.cumsum(pdf["n"].to_numpy()) + ones)
            k = int(np.argmax(f1))
            yield pd.DataFrame({"part": [part], "f1": [f1[k]], "z": [z[k]], "under": [z[k + 1] if k + 1 < len(z) else np.nan]})

    best = min(tally.mapInPandas(work, "part int, f1 double, z double, under double").collect(), key=lambda r: (-r.f1, r.part))
    under = best.under if not math.isnan(best.under) else next((parts[p].top for p in sorted(parts) if p > best.part), best.z)
    return (best.z + under) / 2


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, label: str) -> tuple[LineCrf, float]:
    """(model, shift of the log-odds) from all labelled rows; the driver gets gradients, some hundred numbers a part, and bests of partitions."""
    rate = labels.filter(F.col(label).isin(0, 1) & ~held_out(id_col)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    share = min(0.95, max(0.05, 0.5 if rate is None else rate))
    rows = cut(training_bins(docs, labels, id_col, label))
    of = {(r.role, r.label): r["count"] for r in rows.groupBy("role", "label").count().collect()}
    counts = of.get(("fit", 0), 0), of.get(("fit", 1), 0)
    model = fit(rows.filter("role = 'fit'"), counts, share) if all(counts) else LineCrf()
    aim = math.log(THRESHOLD / (1 - THRESHOLD))

    def work(batch: pa.RecordBatch) -> list:
        own = _joined(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        return [model.qualities(*own, batch.num_rows), batch.column(2)]

    scores = batches(rows.filter("role = 'calibrate'").select("bins", "weights", "label"), work, "z double, label int")
    return model, aim - best_cut(scores, aim)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted), one row per row of ``docs``; predicted is 1 if score >= 0.7.

    Null and empty texts are scored as one empty line. Labels other than 0 and 1, and of null ids, are not used; with one label only,
    or none, no line leans either way. Null ids are not held out; repeated rows are scored each for itself. An empty table gives an
    empty one; of ``docs`` only id and text are read. A task holds the lines of a few megabytes of text, or of one longer text."""
    frame = docs.select(F.col(f"`{id_col}`"), held_out(id_col).alias("held_out"), F.col(f"`{text}`").cast("string").alias("_text"))
    model, shift = fitted(frame, labels, id_col, label)
    kind = frame.schema[0].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> list:
        texts = utf8(batch.column(2))
        z = model.qualities(*line_bins(texts), len(texts)) + shift
        score = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        return [batch.column(0), batch.column(1), score, (score >= THRESHOLD).astype(np.int32)]

    return batches(frame, work, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def line_verdicts(docs: DataFrame, model: LineCrf, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, line, n_bytes, good): the chance of each line, lines counted from 0, of every row of ``docs``; nulls as in ``scored``."""
    frame = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = frame.schema[0].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> list:
        bins, owner, weight = line_bins(utf8(batch.column(1)))
        first = firsts(owner)
        chance, _ = forward_backward(model.lean(with_neighbours(bins, first)), first, model.ties)
        starts = np.flatnonzero(first)
        return [batch.column(0).take(pa.array(owner)), np.arange(len(owner)) - starts[owner], (weight - 1).astype(np.int64), chance]

    return batches(frame, work, f"`{id_col}` {kind}, line bigint, n_bytes bigint, good double")
