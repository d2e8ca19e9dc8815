"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums.

One automaton pass over the lower-cased text finds every keyword a pattern can start with; the pattern is then matched at that place
alone. Since each pattern starts with one of its keywords, trying the hits in order of place and skipping those inside the last match
gives the same leftmost, non-overlapping matches as a search of the whole text. Runs of hex digits have no keyword; they are found by
a byte-class table. Tokens of two public formats carry a CRC-32 in their last six characters and count only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoevents.llm.common import batches, char_offsets, slices, texts_of, utf8

#: Kinds in the order in which spans with the same start are listed; the last two are the method's own.
KINDS = ["assign", "access", "hex", "github", "npm"]
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
                    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS_WORDS = ["akia"]
CHECKED_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for group, words in (("assign", ASSIGN_WORDS), ("access", ACCESS_WORDS), ("checked", CHECKED_WORDS)):
        for w in words:
            found.add_word(w, (group, len(w)))
    found.make_automaton()
    return found


def crc_holds(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the 30 before them (after the prefix)."""
    body, tail = token.split("_", 1)[1][:30], token[-6:]
    crc, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        out = _DIGITS[d] + out
    return out == tail


def byte_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then kind as listed. Every byte is one character here, so places are bytes."""
    text, spans = data.decode("latin-1"), []
    last = {"assign": 0, "access": 0, "checked": 0}
    hits: dict[str, list[int]] = {"assign": [], "access": [], "checked": []}
    for end, (group, size) in _automaton().iter(data.lower().decode("latin-1")):
        hits[group].append(end - size + 1)
    for group, pattern in (("assign", ASSIGN), ("access", ACCESS), ("checked", CHECKED)):
        for at in sorted(set(hits[group])):
            if at >= last[group] and (m := pattern.match(text, at)):
                last[group] = m.end()
                if group == "assign" and len(m[1]) >= ASSIGN_VALUE:
                    spans.append((at, m.end(), "assign"))
                elif group == "access" and m.end() - at >= ACCESS_LENGTH:
                    spans.append((at, m.end(), "access"))
                elif group == "checked" and crc_holds(m[0]):
                    spans.append((at, m.end(), "npm" if m[0].startswith("npm") else "github"))
    spans += [(a, b, "hex") for a, b in hex_runs(data)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def hex_runs(data: bytes, least: int = HEX_LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of ``[0-9a-f]`` of at least ``least`` characters: a coarse comb first, then the runs themselves."""
    if len(data) < least:
        return []
    is_hex = _HEX[np.frombuffer(data, np.uint8)]
    half = least // 2
    comb = is_hex[half - 1::half]  # a run of least characters covers two neighbouring teeth
    if not (comb[:-1] & comb[1:]).any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], is_hex, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def spans_of(data: bytes) -> list[tuple[int, int, str]]:
    """As ``byte_spans``, in code points of the text."""
    found = byte_spans(data)
    a, b = (char_offsets(data, [s[i] for s in found]) for i in (0, 1))
    return [(x, y, s[2]) for x, y, s in zip(a, b, found)]


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, spans array<struct<kind, start, end>>), one row per row of ``docs``; places in code points, end exclusive.

    Null and empty texts have no spans. Null and repeated ids stay as they are; an empty table gives an empty one."""
    def work(batch: pa.RecordBatch) -> list:
        spans = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t)] for t in utf8(batch.column(1))]
        return [batch.column(0), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    frame = texts_of(docs, [id_col], text)
    kind = frame.schema[0].dataType.simpleString()
    return batches(frame, work, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans text) from the spans of ``scan``."""
    def work(batch: pa.RecordBatch) -> list:
        counts, shas, joined = [[], [], []], [], []
        for spans in batch.column(1).to_pylist():
            for k, out in zip(BASE_KINDS, counts):
                out.append(sum(s["kind"] == k for s in spans))
            own = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
            base = [x for x, s in zip(own, spans) if s["kind"] in BASE_KINDS]
            shas.append(hashlib.sha256(",".join(base).encode()).hexdigest())
            joined.append(",".join(own))
        return [batch.column(0), *counts, shas, joined]

    found = scan(docs, id_col, text)
    kind = found.schema[0].dataType.simpleString()
    return batches(found, work, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact_text(data: bytes) -> bytes:
    """The text with every span (overlapping ones as one) replaced by ``[SECRET]``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in byte_spans(data):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [data[at:a], b"[SECRET]"]
        at = b
    return b"".join([*out, data[at:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text and the length column brought up to date; null texts stay null, no row goes."""
    at = docs.columns.index(text)
    length = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(them):
        for batch in (part for whole in them for part in slices(whole)):
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            new = [None if t is None else redact_text(t) for t in raw]
            cols = list(batch.columns)
            cols[at] = pa.array([None if t is None else t.decode() for t in new], batch.schema[at].type)
            if length is not None:
                cols[length] = pa.array([n if old == t else len(t.decode()) for old, t, n in zip(raw, new, cols[length].to_pylist())],
                                        batch.schema[length].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
