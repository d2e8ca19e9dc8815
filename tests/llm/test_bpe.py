"""BPE against the tokenizers library, and its parts against exact merging."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geoevents.llm import bpe
from geoevents.llm.common import table
from geoevents.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(PATH)
    tool.no_padding()
    tool.no_truncation()
    return tool


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_whole_table(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in QUERIES["op4_bpe"](spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(back))


def test_odd_texts(vocabulary, library):
    rng = random.Random(3)
    marks = "aabbcdeinoprstthe   \n\t\x0b\x0c\x1c\x85\xa0éÉßİΣςﬁ123'''s.,!?<|endoftext|>̧́e​漢字😀🇩🇪K \x00َ"
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "\xa0", "a\xa0b", "<|endoftext|>", "x<|startoftext|>y <|end", "etaoin" * 3000, "A" * 5000, "don't WE'LL", "é" * 500]
    encoder = bpe.Encoder(vocabulary)
    for text, (n, ids, back) in zip(texts, encoder.encode([t.encode() for t in texts])):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want), text
        assert back == library.decode(want, skip_special_tokens=False) == bpe.decode_ids(vocabulary, want)


def test_verification_finds_every_wrong_guess(vocabulary):
    rng = random.Random(5)
    words = list({"".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 60))) for _ in range(3000)})
    exact = [vocabulary.merge(w) for w in words]
    guessed = [vocabulary.propose(w) for w in words]
    assert sum(a != b for a, b in zip(guessed, exact)) > 100
    assert vocabulary.encode_words(words) == exact
    for g, e in zip(guessed, exact):  # a guess passes exactly if it is right
        a, b = np.array(g[:-1], np.int64), np.array(g[1:], np.int64)
        assert vocabulary.compatible(a, b).all() == (g == e)


def test_both_merges_agree(vocabulary):
    rng = random.Random(6)
    for _ in range(300):
        word = "".join(rng.choices("aab", k=rng.randint(41, 80)))
        symbols = [vocabulary.ids[c] for c in word[:-1]] + [vocabulary.ids[word[-1] + "</w>"]]
        assert vocabulary.merge(word) == vocabulary._merge_short(symbols)


def test_memory_starts_anew(vocabulary):
    small, large = bpe.Encoder(vocabulary, remembered=3), bpe.Encoder(vocabulary)
    for text in (b"one two three", b"four five", b"one six seven eight nine"):
        assert small.encode([text]) == large.encode([text])


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")]
    got = sorted((str(r.doc_id), r.n_tokens, tuple(r.ids)) for r in bpe.encode(docs_of(rows), PATH).collect())
    assert [(a, b) for a, b, _ in got] == [("1", 0), ("2", 0), ("3", 2), ("3", 2), ("None", 2)]
    assert bpe.encode_digests(docs_of([]), PATH).count() == 0


def test_few_lengths_are_tried():
    """Guessing looks up a few beginnings of each word, not all down from the longest token that starts with the same two letters."""
    v, asked = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json")), []
    words = [a + b for a in ("inter", "contra", "unre", "str", "ab") for b in ("zqx", "vukim", "plorend", "qo")]
    want = [v.propose(w) for w in words]

    class Counted(dict):
        def get(self, *key):
            asked.append(key)
            return super().get(*key)

    v.__dict__["proposals"] = Counted(v.proposals)
    assert [v.propose(w) for w in words] == want and len(asked) < 2.5 * sum(map(len, want))


def test_known_words_are_not_encoded_again(vocabulary, monkeypatch):
    """A piece is new with every mark behind it and in capitals, its word is not: only new words are guessed and verified."""
    asked, plain = [], vocabulary.encode_words
    monkeypatch.setattr(vocabulary, "encode_words", lambda words: asked.extend(words) or plain(words))
    encoder = bpe.Encoder(vocabulary)
    for text in ("plorend zqxuk", "Plorend, zqxuk&&& plorend###", "PLOREND zqxuk's (plorend), \u00c9t\u00c9 \u00e9t\u00e9."):
        encoder.encode([text.encode()])
    assert len(asked) == len(set(asked)) and asked.count("plorend") == asked.count("zqxuk") == 1


def test_rows_are_merged_like_single_words(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "_ROWS", 100)
    rng = random.Random(8)
    words = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for letters in ("aab", "etaoinshrdlu", "\u00c3\u00a9ent") for _ in range(400)]
    assert vocabulary.merge_all(words) == [vocabulary.merge(w) for w in words]
    assert vocabulary.merge_all([]) == []


def test_pieces_are_split_together_as_alone(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "_LINE", 64)
    rng = random.Random(9)
    marks = "abTH's.,&-_`{~123\u00c0\u00d6\u00d7\u00d8\u00de\u00df\u00f7\u00ff\u0331\u0301\u0307\u0130\u03a3\u212a\u00b5\u00aa\u00a0\u1680\x1c\x85\u6f22"
    pieces = ["".join(rng.choices(marks, k=rng.randint(1, 9))) for _ in range(4000)] + ["\u00a0", "\u0331", "''", "\u00c9T\u00c9!!"]
    alone = [[w for w, _ in vocabulary.pre_tokenise(vocabulary.normalise(p))] for p in pieces]
    assert vocabulary.words([p.encode() for p in pieces]) == alone


def test_capitals_before_combining_marks(vocabulary, library):
    """H and U+0331 stay two characters, h and U+0331 are composed: the order of lower case and composition shows."""
    for text in ("H\u0331 h\u0331", "HELLO H\u0331X", "I\u0307 A\u0301", "HELLO \u00c9T\u00c9"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.Encoder(vocabulary).encode([text.encode()])[0][1] == " ".join(map(str, ids))
