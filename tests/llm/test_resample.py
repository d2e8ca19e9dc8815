"""Resampling against SQL and against a plain computation with strings."""

import hashlib
import math
import re
import zlib
from collections import Counter

import oracle

from geoevents.llm import resample as R
from geoevents.llm.oracles import ORACLES
from geoevents.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, buckets, longest, least, percent):
    """(doc_id, n_features, weight, score, rank) by joining every n-gram as a string."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    source = Counter(bucket(g) for _, t in rows for g in grams(t, longest)[1])
    aim = Counter(bucket(g) for t in target for g in grams(t, longest)[1])
    s, t = sum(source.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)}
    scored = []
    for i, text in rows:
        n, own = grams(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in own)
        scored.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    order = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    ranks = {}
    for k, x in enumerate(order[:percent * len(order) // 100]):
        ranks.setdefault(x, []).append(k + 1)
    return sorted(((x[0], *x[2:], ranks[x].pop() if ranks.get(x) else None) for x in scored), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table_against_sql(spark, sf):
    assert oracle.difference(QUERIES["op12_resample"](spark, sf), oracle.connect(sf), ORACLES["op12_resample"]) is None


def test_whole_table_with_long_runs(spark, sf):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows, aim = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    for longest, buckets in ((2, 10_000), (3, 257)):
        got = R.resampled(docs, target, longest=longest, buckets=buckets)
        assert rows_of(got) == plain(rows, aim, buckets, longest, 20, 10)


def test_chained_hashes():
    words = "ä b ccc b ä b".encode().split()
    for longest in (1, 2, 4, 9):
        want = Counter(zlib.crc32(b" ".join(words[i:i + n])) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
        assert R.hash_counts(words, longest) == want and sum(want.values()) == R.n_features(len(words), longest)


def test_words():
    assert R.words_of("ÄB-c_d\x7f9 \x00É x".encode()) == ["Äb".encode(), b"c", b"d", b"9", "É x".encode()]


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "a b " * 20), (3, "a b c " * 10), (3, "a b c " * 10), (4, "Same Text " * 15), (5, "same text " * 15),
            (6, "long " * 300_000), (7, "- _ !")]
    rows += [(100 + i, f"word{i} more " * 12) for i in range(40)]
    target = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "item_id long, text string")
    assert rows_of(R.resampled(docs_of(rows), target, percent=30)) == plain(rows, ["a b c", None, ""], 10_000, 1, 20, 30)
    assert rows_of(R.resampled(docs_of(rows), target.limit(0), percent=100)) == plain(rows, [], 10_000, 1, 20, 100)
    assert R.resampled(docs_of([]), target).count() == 0
    assert all(r.rank is None for r in R.resampled(docs_of([(1, "too few words")]), target, percent=100).collect())


def test_equal_scores_are_drawn_by_id(spark, docs_of):
    """Rows with one id and one text have one score; each is drawn for itself and no rank is given twice."""
    rows = [(7, "w " * 30)] * 50 + [(8, "v " * 30)] * 50
    got = R.resampled(docs_of(rows), spark.createDataFrame([], "text string"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51)) and len({r.doc_id for r in got if r["rank"]}) == 1
