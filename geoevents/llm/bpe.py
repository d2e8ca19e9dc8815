"""BPE encoding and decoding by speculation and verification.

A word's tokens are guessed by greedy longest match. A guess is right exactly if every token encodes to itself and every adjacent pair
is compatible, that is, no merge across the boundary would have come before one of the merges inside the two tokens. Compatibility is
tested for all distinct pairs of a batch at once in numpy. Words with a failing pair are merged exactly, by rank: all of a batch
together, one merge in each word a round, and very long ones with a heap.

Texts are cut at ASCII white space; such a piece is normalised and split into words on its own, since neither step looks past white
space. Pieces and words are remembered per worker up to a bound: a piece that is met again costs a look-up, and a new piece made of
known words ("word" with another mark behind it) only a join.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
import re
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from geoevents.llm.common import batches, texts_of, utf8

#: Pieces remembered in one worker, and as many words; at this many the memory starts anew. Only a matter of speed.
REMEMBERED = 600_000
#: Words up to this length are merged together, as rows of a table.
SHORT = 40
_ROWS = 8192  # of such a table
_LINE = 1 << 16  # characters that are split in one call
_NONE = 1 << 62  # where there is no merge
#: ASCII and Latin-1 letters, then ASCII marks without the apostrophe, which may start a word of letters: at most two words.
_PLAIN = re.compile(rb"([A-Za-z]*(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][A-Za-z]*)*)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: Lower case of such letters: those of Latin-1 are 0xC3 and one of 0x80 to 0xBF, 32 apart.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E else b for b in range(256))
_PRINTABLE = frozenset([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
#: The characters that stand for the bytes 0 to 255: printable ones for themselves, the others from U+0100 on.
_ALPHABET = "".join(chr(b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256))
_END = "\0"  # stands for the end-of-word suffix while matching; no byte is written with this character


class Vocabulary:
    """Tables of one tokenizer file (BPE with an end-of-word suffix, byte alphabet)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        n = max([*self.ids.values(), *special.values()]) + 1
        self.strings = [""] * n
        for text, i in [*self.ids.items(), *special.items()]:
            self.strings[i] = text
        self.n = n
        self.rank_of: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ia, ib, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank_of.setdefault((ia, ib), (r, whole))
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, ia, ib
        keys = np.array([a * n + b for a, b in self.rank_of], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.rank_of.values()], np.int64)[order]
        self.pair_merges = np.array([r * n + whole for r, whole in self.rank_of.values()], np.int64)[order]
        tool = Tokenizer.from_file(path)
        self.normalise, self.pre_tokenise = tool.normalizer.normalize_str, tool.pre_tokenizer.pre_tokenize_str

    def words(self, pieces: list[bytes]) -> list[list[str]]:
        """Pieces without white space as words over the byte alphabet. Plain letters are one word in lower case and the marks behind
        them another; anything else goes through the file's own normaliser and splitter, many pieces at once."""
        out: list[list[str]] = []
        others = []
        for k, piece in enumerate(pieces):
            if piece.isalpha():  # bytes: A-Z and a-z alone
                out.append([piece.lower().decode()])
            elif plain := _PLAIN(piece):
                letters, marks = plain.groups()
                letters = codecs.charmap_decode(letters.translate(_LOWER), "strict", _ALPHABET)[0]
                out.append([w for w in (letters, marks.decode()) if w])
            else:
                out.append([])
                others.append(k)
        texts = [pieces[k].decode() for k in others]
        whole = [text.split() == [text] for text in texts]  # no white space of any kind
        for k, text, one in zip(others, texts, whole):
            if not one:
                out[k] = [w for w, _ in self.pre_tokenise(self.normalise(text)) if w]
        together = [(k, text) for k, text, one in zip(others, texts, whole) if one]
        sizes = np.cumsum([len(text) for _, text in together]) // _LINE
        for part in np.split(np.arange(len(together)), np.flatnonzero(np.diff(sizes)) + 1):
            line = self.normalise(" ".join([together[i][1] for i in part.tolist()]))
            ends = np.cumsum([len(piece) + 1 for piece in line.split(" ")])
            found = [(w, at) for w, (at, _) in self.pre_tokenise(line) if w]
            for (w, _), i in zip(found, np.searchsorted(ends, [at for _, at in found], side="right").tolist()):
                out[together[part[i]][0]].append(w)
        return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a large number where there is none."""
        keys = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], 1 << 40)

    def compatible(self, left: np.ndarray, right: np.ndarray, own_rank: np.ndarray | None = None) -> np.ndarray:
        """For each adjacent pair whether no merge crosses the boundary. With ``own_rank``, the pair's own merge is left out.

        The two tokens are undone merge by merge, the later one first. The pieces that then meet at the boundary stand side by side
        until one of them is merged further; a merge of the two that ranks before both would have come first. Equal ranks go from
        left to right: the left token's own merge wins, the right one's loses."""
        never = np.int64(1 << 39)
        x, y = left.astype(np.int64).copy(), right.astype(np.int64).copy()
        until_x, until_y = np.full(len(x), never), np.full(len(x), never)
        good, todo, first = np.ones(len(x), bool), np.arange(len(x)), own_rank is not None
        while len(todo):
            a, b = x[todo], y[todo]
            m = self.merge_rank(a, b)
            crossed = (m < until_x[todo]) & (m <= until_y[todo]) & (not first)
            good[todo[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & (np.maximum(ra, rb) >= 0)
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            in_left = ra > rb
            i, j = todo[in_left], todo[~in_left]
            until_x[i], x[i] = ra[in_left], self.right[a[in_left]]
            until_y[j], y[j] = rb[~in_left], self.left[b[~in_left]]
            first = False
        return good

    @cached_property
    def self_encoding(self) -> np.ndarray:
        """Tokens that are what their own text is encoded to; others are never proposed."""
        good = np.ones(self.n, bool)
        merged = np.flatnonzero(self.rank >= 0)
        good[merged] = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        for t in merged[np.argsort(self.rank[merged])]:
            good[t] = good[t] and good[self.left[t]] and good[self.right[t]]
        return good

    @cached_property
    def proposals(self) -> dict[str, int]:
        s = self.suffix
        usable = {i for i in self.ids.values() if self.self_encoding[i]}
        return {(t[:-len(s)] + _END if s and t.endswith(s) and len(t) > len(s) else t): i for t, i in self.ids.items() if i in usable}

    @cached_property
    def reach(self) -> dict[str, int]:
        """By its first four characters, how long a proposed token can be; one that has no such beginning is shorter than four."""
        out: dict[str, int] = {}
        for t in self.proposals:
            if len(t) >= 4:
                out[t[:4]] = max(out.get(t[:4], 4), len(t))
        return out

    @cached_property
    def merges(self) -> dict[tuple[int, int], int]:
        """``rank_of`` with rank and result as one number, which compares faster."""
        return {pair: r * self.n + whole for pair, (r, whole) in self.rank_of.items()}

    def propose(self, word: str) -> list[int]:
        """Greedy longest match on the word with its end marked."""
        text, at, out = word + (_END if self.suffix else ""), 0, []
        get, reach, n = self.proposals.get, self.reach.get, len(text)
        apart = n - 1 if self.suffix else -1  # the last character and the mark are one symbol
        while at < n:
            end = min(n, at + reach(text[at:at + 4], 3))
            while end > at:
                if end != apart:
                    found = get(text[at:end])
                    if found is not None:
                        break
                end -= 1
            else:
                raise ValueError(f"no token starts {text[at:at + 8]!r}")
            out.append(found)
            at = end
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: always the lowest rank, the leftmost of equals."""
        symbols = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.suffix]]
        n = len(symbols)
        if n <= SHORT:
            return self._merge_short(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.rank_of.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j] = self.rank_of[a, b][1], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.rank_of.get((symbols[k], symbols[after[k]]))):
                    heapq.heappush(heap, (r[0], k, symbols[k], symbols[after[k]]))
        return [s for s, there in zip(symbols, alive) if there]

    def _merge_short(self, symbols: list[int]) -> list[int]:
        """The same by plain search, which beats a heap on words of usual length."""
        none, get, n = 1 << 62, self.merges.get, self.n
        merges = [get(p, none) for p in zip(symbols, symbols[1:])]
        while merges:
            best = min(merges)
            if best == none:
                break
            i = merges.index(best)
            symbols[i:i + 2] = [best % n]
            del merges[i]
            if i:
                merges[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(merges):
                merges[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    @cached_property
    def first_symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """By character code: the symbol of a byte inside a word, and of one that ends it."""
        inner, last = np.full(512, -1, np.int64), np.full(512, -1, np.int64)
        for c in _ALPHABET:
            inner[ord(c)], last[ord(c)] = self.ids.get(c, -1), self.ids.get(c + self.suffix, -1)
        return inner, last

    def merges_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``merges`` of pairs; where there is none or a symbol is negative, ``_NONE``."""
        keys = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (a >= 0) & (b >= 0), self.pair_merges[at], _NONE)

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """``merge`` of every word. Short ones are rows of a table, in which a round makes the next merge of every row."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(sizes > SHORT).tolist():
            out[k] = self.merge(words[k])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= SHORT]
        for at in range(0, len(order), _ROWS):
            rows = order[at:at + _ROWS]
            for k, ids in zip(rows.tolist(), self._merge_rows([words[k] for k in rows.tolist()], sizes[rows])):
                out[k] = ids
        return out

    def _merge_rows(self, words: list[str], sizes: np.ndarray) -> list[list[int]]:
        inner, last = self.first_symbols
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        n, wide = len(words), int(sizes.max()) + 2  # a column on either side for "no neighbour"
        flat = inner[codes]
        flat[ends - 1] = last[codes[ends - 1]]
        if (flat < 0).any():
            raise ValueError("a byte is no token")
        base = np.arange(n) * wide
        place = np.repeat(base + 1 - (ends - sizes), sizes) + np.arange(len(flat))
        symbols = np.full(n * wide, -1, np.int64)
        symbols[place] = flat
        best = np.full(n * wide, _NONE, np.int64)
        best[place[:-1]] = self.merges_of(symbols[place[:-1]], symbols[place[:-1] + 1])
        after, before = np.arange(n * wide) + 1, np.arange(n * wide) - 1
        todo = base
        while len(todo):
            i = todo + best.reshape(n, wide)[todo // wide].argmin(1)
            merge = best[i]
            go = merge < _NONE
            todo, i, merge = todo[go], i[go], merge[go]
            j = after[i]
            k, h = after[j], before[i]
            symbols[i], symbols[j], best[j] = merge % self.n, -1, _NONE
            after[i], before[k] = k, i
            found = self.merges_of(np.concatenate((symbols[h], symbols[i])), np.concatenate((symbols[i], symbols[k])))
            best[h], best[i] = found[:len(i)], found[len(i):]
        left = symbols >= 0
        tokens, counts = symbols[left].tolist(), left.reshape(n, wide).sum(1)
        stops = np.cumsum(counts).tolist()
        return [tokens[a:b] for a, b in zip([0, *stops], stops)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Words over the byte alphabet to ids: propose, verify all pairs together, merge what fails."""
        guessed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, guessed), np.int64, len(guessed))
        flat = np.fromiter(chain.from_iterable(guessed), np.int64, int(sizes.sum()))
        inside = np.ones(max(0, len(flat) - 1), bool)
        inside[np.cumsum(sizes)[:-1] - 1] = False
        at = np.flatnonzero(inside)
        pairs, back = np.unique(flat[at] * self.n + flat[at + 1], return_inverse=True)
        good = self.compatible(pairs // self.n, pairs % self.n)[back]
        owner = np.repeat(np.arange(len(guessed)), sizes)
        wrong = np.unique(owner[at[~good]]).tolist()
        for k, ids in zip(wrong, self.merge_all([words[k] for k in wrong])):
            guessed[k] = ids
        return guessed


class _Numbers(dict):
    """Keys numbered in the order in which they are first looked up."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


class Encoder:
    """Texts to ids with a memory of pieces and words: their ids and their tokens, each joined by spaces, as UTF-8."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v, self.remembered = vocabulary, remembered
        self.numerals = [b"%d" % i for i in range(vocabulary.n)]
        self.strings = [t.encode() for t in vocabulary.strings]
        self.forget()

    def forget(self) -> None:
        self.number, self.ids, self.tokens = _Numbers(), [], []
        self.words, self.word_ids, self.word_tokens = _Numbers(), [], []

    def learn(self) -> None:
        """Encode the pieces without white space (and the ids of special tokens) that have a number but no ids yet."""
        new = list(islice(self.number, len(self.ids), None))
        words_of = iter(self.v.words([p for p in new if type(p) is bytes]))
        number = self.words.__getitem__
        parts = [list(map(number, next(words_of))) if type(p) is bytes else p for p in new]
        words = list(islice(self.words, len(self.word_ids), None))
        encoded = self.v.encode_words(words) if words else []
        for memory, of_word, names in ((self.ids, self.word_ids, self.numerals), (self.tokens, self.word_tokens, self.strings)):
            of_word += [b" ".join([names[i] for i in ids]) for ids in encoded]
            memory += [names[p] if type(p) is int else of_word[p[0]] if len(p) == 1 else b" ".join([of_word[w] for w in p]) for p in parts]

    def pieces(self, data: bytes) -> list[bytes | int]:
        """Pieces of a text in order; the strings of special tokens are their ids."""
        if self.v.split_special is None or b"<|" not in data:
            return self._cut(data)
        out: list[bytes | int] = []
        for k, part in enumerate(self.v.split_special.split(data.decode())):
            out += [self.v.special[part]] if k % 2 else self._cut(part.encode())
        return out

    @staticmethod
    def _cut(data: bytes) -> list[bytes]:
        """A-Z may become a-z before the normaliser sees it, except before a combining mark (U+0300 to U+036F), which can compose with
        one of the two alone."""
        return (data if b"\xcc" in data or b"\xcd" in data else data.lower()).split()

    def encode(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by spaces, decoded text) of each text. Without a decoder in the file, the decoded text is the
        tokens joined by spaces, as its library does."""
        return [(n, ids.decode(), back.decode()) for n, ids, back in self.encode_utf8(texts)]

    def encode_utf8(self, texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """The same as UTF-8. Nothing here refers to itself, so the collector, which would go through the memory every time, waits."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        cut = [self.pieces(t) for t in texts]
        numbers = [list(map(self.number.__getitem__, pieces)) for pieces in cut]
        if max(len(self.number), len(self.words)) > self.remembered and self.ids:
            self.forget()
            numbers = [list(map(self.number.__getitem__, pieces)) for pieces in cut]
        self.learn()
        out = []
        for places in numbers:
            both = []
            for memory in (self.ids, self.tokens):
                joined = b" ".join(map(memory.__getitem__, places))
                if b"  " in joined or joined[:1] == b" " or joined[-1:] == b" ":  # a piece without tokens
                    joined = re.sub(b" +", b" ", joined).strip(b" ")
                both.append(joined)
            out.append((both[0].count(b" ") + 1 if both[0] else 0, *both))
        return out


@lru_cache(maxsize=4)
def _encoder(path: str, shipped: bool) -> Encoder:
    return Encoder(Vocabulary(SparkFiles.get(path) if shipped else path))


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    return " ".join(vocabulary.strings[i] for i in ids)


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text: str = "text", shipped: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids array<int>, decoded), one row per row of ``docs``.

    ``tokenizer_file`` must be readable by every task; with ``shipped`` it is the name of a file given to ``SparkContext.addFile``.
    Null and empty texts have no tokens. Ids of rows are carried as they are; an empty table gives an empty one."""
    def work(batch: pa.RecordBatch) -> list:
        got = _encoder(tokenizer_file, shipped).encode(utf8(batch.column(1)))
        return [batch.column(0), [g[0] for g in got], [[int(i) for i in g[1].split()] for g in got], [g[2] for g in got]]

    frame = texts_of(docs, [id_col], text)
    kind = frame.schema[0].dataType.simpleString()
    return batches(frame, work, f"`{id_col}` {kind}, n_tokens bigint, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text: str = "text", shipped: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): what ``encode`` gives, as digests taken in the same task."""
    def work(batch: pa.RecordBatch) -> list:
        n, ids, decoded = [], [], []
        for count, joined, back in _encoder(tokenizer_file, shipped).encode_utf8(utf8(batch.column(1))):
            n.append(count)
            ids.append(hashlib.sha256(joined).hexdigest())
            decoded.append(hashlib.sha256(back).hexdigest())
        return [batch.column(0), n, ids, decoded]

    frame = texts_of(docs, [id_col], text)
    kind = frame.schema[0].dataType.simpleString()
    return batches(frame, work, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
