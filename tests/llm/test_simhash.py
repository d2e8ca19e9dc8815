"""SimHash against a plain bit count, and components against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from geoevents.llm import simhash as S
from geoevents.llm.common import table
from geoevents.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def check(rows, got):
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, format(f, "016x"), least.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=repr) == want


def test_cover_is_complete():
    triples = [set(t) for t in S.covering_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], S.near_duplicates(docs))


def test_edge_rows(docs_of):
    rows = [(5, None), (3, ""), (9, " \n\t"), (1, "One two"), (2, "one TWO"), (None, "one two"), (2, "one TWO"), (7, "É é A b c d e f"),
            (8, "w " * 70_000), (4, "a\x0bb\x0cc d"), (6, "a b c d"), (None, "alone among the others here")]
    check(rows, S.near_duplicates(docs_of(rows)))


def test_empty_table(docs_of):
    assert S.near_duplicates(docs_of([])).count() == 0
    assert S.keep_one(docs_of([])).count() == 0


@pytest.mark.parametrize("long_list", [4, 8192])
def test_links_connect_what_pairs_connect(spark, long_list):
    """Dense groups around few centres; a small bound sends them through all levels of finer keys."""
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for c in centres for _ in range(60)}
               | {rng.getrandbits(64) for _ in range(200)})
    frame = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in components(S.links(frame, long_list=long_list)).collect()}
    mine = [got.get(S._signed(f), S._signed(f)) for f in fps]
    want = plain_components(fps)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_lists_across_batches(spark):
    """A long list cut by small batches is found whole."""
    fps = [S._signed((0xABCDEF << 40) | i) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = spark.createDataFrame([(f,) for f in fps], "fp long")
        for bound in (50, 8192):
            roots = {r.root for r in components(S.links(frame, long_list=bound)).collect()}
            assert len(roots) == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keep_one(docs_of):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(3, text), (2, text), (2, text), (5, "something else entirely is written in this one here"), (None, text), (5, "other text under the same id as before")]
    kept = sorted((r.doc_id, r.text) for r in S.keep_one(docs_of(rows)).collect())
    assert kept == [(2, text), (5, rows[5][1]), (5, rows[3][1])]
    assert S.keep_one(docs_of(rows)).columns == docs_of(rows).columns


def test_components_shapes(spark):
    chain = [(i, i + 1) for i in range(500)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    odd = [(5000, 5000), (None, 1), (6000, 6001), (6001, 6000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()}
    assert len({got[i] for i in range(501)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1
    assert got[6000] == got[6001] and 5000 not in got and got[0] != got[1000]


def test_bits_bound():
    with pytest.raises(ValueError):
        S.links(None, bits=5)
    x = np.array([0, 0x0101010100000000, 0x0101010101000000, 0x1F], np.uint64)
    assert S.linked(x).tolist() == [True, True, False, False]
