"""Quality rules as a short-circuit cascade.

Two base rules are fixed: too few words, and too many words in repeated three-word windows. The other rules look at shapes that
running text does not have. A rule's cost (seconds a text) and selectivity (share of texts it rejects) are measured on a bounded
sample, and rules run in order of rejections per cost; a text rejected by one rule is not shown to the next, and a text's measures are dropped before the next text. The order changes the
work only: a text is kept if no rule rejects it, whichever comes first, so equal inputs give equal verdicts.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoevents.llm.common import batches, slices, texts_of, utf8

SYMBOLS = b"#*$%&|<>"
#: Rows of the sample on which cost and selectivity are measured; the verdicts do not depend on it.
SAMPLE_ROWS = 500
_SPACE = b" \t\n\x0b\x0c\r"


class Measures:
    """What rules ask of one text; each measure is taken at its first use only."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        packed = self.data.translate(None, _SPACE)
        return len(packed) if packed.isascii() else int(np.count_nonzero((np.frombuffer(packed, np.uint8) & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows found twice or more, the first one included."""
        n = len(self.words)
        if n < 4:
            return 0
        no: dict[bytes, int] = {}
        ids = np.fromiter((no.setdefault(w, len(no)) for w in self.words), np.int64, n)
        m = len(no) + 1
        if m < 2_000_000:
            windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
            _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
            often = counts[at] > 1
        else:
            seen = Counter(zip(ids[:-2].tolist(), ids[1:-1].tolist(), ids[2:].tolist()))
            often = np.array([seen[w] > 1 for w in zip(ids[:-2].tolist(), ids[1:-1].tolist(), ids[2:].tolist())])
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k:n - 2 + k] |= often
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


def base_failed(m: Measures) -> bool:
    return len(m.words) < 50 or 100 * m.n_repeat_words > 50 * len(m.words)


#: Bounds lie well outside what running text in any of the languages shows; integers only, so they can be checked exactly.
RULES = [
    Rule("few_words", lambda m: len(m.words) < 50),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * len(m.words)),
    Rule("symbols", lambda m: 10 * m.n_symbols > len(m.words)),
    Rule("word_length", lambda m: not 2 * len(m.words) <= m.word_chars <= 20 * len(m.words)),
    Rule("duplicate_lines", lambda m: len(m.lines) >= 4 and 10 * m.n_dup_lines > 5 * len(m.lines)),
]


def measured_order(docs: DataFrame, key: list[str], text: str = "text", rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on the rows with the ``rows`` least hashes of key and text, the best first. Whole texts are
    measured inside tasks; the driver gets seconds and rejections per rule. On an empty table the given order."""
    at = F.xxhash64(*[F.col(f"`{c}`") for c in key], F.col(f"`{text}`"))
    least = docs.select(at.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if least is None:
        return list(rules)

    def work(batch: pa.RecordBatch) -> list:
        texts, out = utf8(batch.column(0)), []
        for rule in rules:
            began = time.perf_counter()
            rejected = sum(rule.rejects(Measures(t)) for t in texts)
            out.append((rule.name, rejected, time.perf_counter() - began))
        return [list(c) for c in zip(*out)]

    cost = batches(texts_of(docs.filter(at <= least), [], text), work, "name string, rejected bigint, seconds double")
    rate = {r.name: r.rejected / max(r.seconds, 1e-9)
            for r in cost.groupBy("name").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()}
    return sorted(rules, key=lambda r: rate.get(r.name, 0.0), reverse=True)


def passes(m: Measures, rules: list[Rule]) -> bool:
    """Whether a text passes all rules; the first rule that rejects it ends the cascade."""
    return not any(rule.rejects(m) for rule in rules)


def cascade(texts: Iterable[Measures], rules: list[Rule]) -> np.ndarray:
    """Whether each text passes all rules; the measures of one text are let go before the next is taken."""
    return np.array([passes(m, rules) for m in texts], bool)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: list[Rule] = RULES,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row per row of ``docs``.

    A null or empty text has no words and fails. Ids are carried as they are, null and repeated ones too; an empty table gives an
    empty one; other columns are not read."""
    order = [r.name for r in measured_order(docs, [id_col], text, rules, sample_rows)]
    by_name = {r.name: r for r in rules}

    def work(batch: pa.RecordBatch) -> list:
        ordered, rows = [by_name[n] for n in order], []
        for data in utf8(batch.column(1)):
            m = Measures(data)  # one text's measures at a time
            failed = base_failed(m)
            rows.append((len(m.words), m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, not failed and passes(m, ordered)))
        return [batch.column(0), *map(list, zip(*rows))]

    frame = texts_of(docs, [id_col], text)
    kind = frame.schema[0].dataType.simpleString()
    return batches(frame, work, f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                                "n_repeat_words bigint, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with all their columns; here rejected texts are measured no further.

    A null or empty text has no words and goes. Null ids and repeated rows are judged each by its text; an empty table gives an empty one;
    other columns are carried and may have any name."""
    order = [r.name for r in measured_order(docs, [], text, rules, sample_rows)]
    by_name = {r.name: r for r in rules}
    at = docs.columns.index(text)

    def run(them):
        ordered = [by_name[n] for n in order]
        for batch in them:
            for part in slices(batch):
                kept = cascade((Measures(data) for data in utf8(part.column(at).cast(pa.string()))), ordered)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
