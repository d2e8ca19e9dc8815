"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line or, with ``wrapped``, also a window over consecutive lines, sliding by one line: the end of a line and what follows it, as
many words on either side as a template can spread over, so a notice wrapped at any column lies in one window whole. A block matches a
template when it holds at least ``share`` of the template's distinct words. Tokens are ordered by how many lines of the whole corpus hold them, the rarest first; one pass over the texts counts them, only for words of templates, so
the table to order by is as large as the templates and no larger. With that order, a block can match only if it holds one of the first
|T| - need + 1 tokens of template T (prefix filter), if it holds enough template tokens at all (length filter), and if enough tokens
are left in both after the first one they share (positional filter). What passes is verified by the full overlap, so nothing is lost.
Templates are a parameter of bounded size and go to the tasks; texts are never shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame

from geoevents.llm.common import batches, texts_of, utf8

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Public license notices.
TEMPLATES = [
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                 "License. You may obtain a copy of the License at"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
              "conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
              "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
SHARE = Fraction(9, 10)

_SPLIT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 or b == 0x0A else 0x20 for b in range(256))


def words_by_line(data: bytes) -> list[list[bytes]]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of each line, A-Z lower-cased."""
    return [line.split() for line in data.lower().translate(_SPLIT).split(b"\n")]


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[bytes, ...]
    need: int
    #: Words on either side of a line's end that a window takes in.
    reach: int


def templates_of(pairs: list[tuple[str, str]] = TEMPLATES, share: Fraction = SHARE) -> list[Template]:
    """Distinct words of each template and how many of them a block must hold."""
    out = []
    for label, text in pairs:
        words = [w for line in words_by_line(text.encode()) for w in line]
        tokens = sorted(set(words))
        out.append(Template(label, tuple(tokens), max(1, math.ceil(share * len(tokens))), math.ceil(len(words) / share)))
    return out


class TemplateIndex:
    """Templates with tokens in global order, posted under their prefix tokens."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int]):
        order = sorted({t for x in templates for t in x.tokens}, key=lambda t: (frequency.get(t, 0), t))
        self.rank = {t: i for i, t in enumerate(order)}
        self.templates = [Template(x.label, tuple(sorted(x.tokens, key=self.rank.__getitem__)), x.need, x.reach) for x in templates]
        self.sets = [frozenset(x.tokens) for x in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, x in enumerate(self.templates):
            for at, t in enumerate(x.tokens[:len(x.tokens) - x.need + 1]):
                self.postings.setdefault(t, []).append((k, at))
        self.prefix_tokens = frozenset(self.postings)
        self.least = min((x.need for x in self.templates), default=1)

    def matches(self, words: list[bytes]) -> list[tuple[int, Fraction]]:
        """(template number, share of its tokens in the block) for all templates that match."""
        if len(words) < self.least:
            return []
        distinct = set(words)
        if self.prefix_tokens.isdisjoint(distinct):
            return []
        block = sorted(distinct.intersection(self.rank), key=self.rank.__getitem__)
        if len(block) < self.least:
            return []
        seen, out = set(), []
        for j, token in enumerate(block):
            for k, i in self.postings.get(token, ()):
                if k in seen:
                    continue
                seen.add(k)  # the first shared token in global order; later ones leave less room
                x = self.templates[k]
                if len(block) < x.need or 1 + min(len(x.tokens) - i - 1, len(block) - j - 1) < x.need:
                    continue
                overlap = len(self.sets[k] & distinct)
                if overlap >= x.need:
                    out.append((k, Fraction(overlap, len(x.tokens))))
        return out

    def window_matches(self, lines: list[list[bytes]], found: list[tuple[int, int, Fraction]]) -> list[tuple[int, int, Fraction]]:
        """(first line, template number, share) of windows over several lines that match. ``found`` has the lines that match by
        themselves; a window that takes in one of them adds nothing for its template."""
        words = [w for line in lines for w in line]
        distinct = set(words)
        if len(distinct) < self.least or self.prefix_tokens.isdisjoint(distinct):
            return []
        # what matches in a window matches in the whole text, so most texts end here
        able = [k for k, x in enumerate(self.templates) if len(self.sets[k] & distinct) >= x.need]
        if not able:
            return []
        ends = []
        for line in lines:
            ends.append((ends[-1] if ends else 0) + len(line))
        out = []
        for k in able:
            x = self.templates[k]
            prefix = frozenset(x.tokens[:len(x.tokens) - x.need + 1])
            at = [i for i, w in enumerate(words) if w in prefix]
            alone = sorted((ends[no] - len(lines[no]), ends[no]) for no, j, _ in found if j == k)
            for no, line in enumerate(lines):
                if not line or ends[no] == len(words):
                    continue
                a, b = max(ends[no] - len(line), ends[no] - x.reach), min(len(words), ends[no] + x.reach)
                i = bisect_left(at, a)
                if i == len(at) or at[i] >= b:
                    continue
                i = bisect_left(alone, (b, 0)) - 1  # lines do not overlap: the last one that begins before b ends last
                if i >= 0 and alone[i][1] > a:
                    continue
                overlap = len(self.sets[k].intersection(words[a:b]))
                if overlap >= x.need:
                    out.append((no, k, Fraction(overlap, len(x.tokens))))
        return out


def token_frequencies(docs: DataFrame, templates: list[Template], text: str = "text") -> dict[bytes, int]:
    """In how many lines of the corpus each template word stands; at most as many rows as templates have words."""
    vocabulary = frozenset(t for x in templates for t in x.tokens)

    def work(batch: pa.RecordBatch) -> list:
        seen: Counter = Counter()
        for data in utf8(batch.column(0)):
            for words in words_by_line(data):
                seen.update(vocabulary.intersection(words))
        return [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]

    counted = batches(texts_of(docs, [], text), work, "token binary, n bigint").groupBy("token").sum("n")
    return {bytes(r[0]): r[1] for r in counted.collect()}


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of every phrase."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES:
        needle = b" " + phrase.encode() + b" "
        at, done, no = line.find(needle), 0, 0
        while at >= 0:
            no += line.count(b" ", done, at)  # blanks are counted on from the last place, so each is counted once a phrase
            out.append((no, label))
            done, at = at, line.find(needle, at + 1)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", pairs: list[tuple[str, str]] = TEMPLATES,
         share: Fraction = SHARE, wrapped: bool = False) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, matches), one row per row of ``docs``.

    ``matches`` lists (line, label, share) of each block that meets a template: lines and, with ``wrapped``, windows by their first line. score is 1 with a base phrase, else the largest share
    met, else 0. Null and empty texts have no words, no labels (empty text) and score 0. Ids are carried as they are, null and
    repeated ones too; an empty table gives an empty one; other columns are not read."""
    templates = templates_of(pairs, share)
    index = TemplateIndex(templates, token_frequencies(docs, templates, text))
    match_type = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))

    def work(batch: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in range(8)]
        for data in utf8(batch.column(1)):
            lines = words_by_line(data)
            places = phrase_places([w for line in lines for w in line])
            met = [(no, k, s) for no, line in enumerate(lines) for k, s in index.matches(line)]
            if wrapped:
                met = sorted(met + index.window_matches(lines, met))
            found = [(no, index.templates[k].label, float(s)) for no, k, s in met]
            base = sorted({label for _, label in places})
            starts = [at for at, _ in places]
            row = (sum(map(len, lines)), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
                   ",".join(sorted({*base, *(label for _, label, _ in found)})),
                   1.0 if places else max((s for *_, s in found), default=0.0),
                   [{"line": a, "label": b, "share": c} for a, b, c in found])
            for col, v in zip(out, row):
                col.append(v)
        return [batch.column(0), *out[:-1], pa.array(out[-1], match_type)]

    frame = texts_of(docs, [id_col], text)
    kind = frame.schema[0].dataType.simpleString()
    return batches(frame, work, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
                                "labels string, score double, matches array<struct<line:bigint,label:string,share:double>>")
