"""Packing: nothing lost, nothing overfull, the same as a plain search, cheaper than one length alone."""

import random

from geoevents.llm import packing as P
from geoevents.llm.queries import QUERIES
from geoevents.llm.common import table


def plain_pack(sizes, lengths, overhead):
    """The same rules by looking at every bin each time."""
    to_come, bins, out = sum(sizes), [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        to_come -= sizes[i]
        fits = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0] - bins[b][1], b))
        else:
            b = len(bins)
            cost = {x: (x + overhead) / (sizes[i] + min(x - sizes[i], to_come)) for x in lengths if x >= sizes[i]}
            bins.append([min(cost, key=lambda x: (cost[x], x)), 0])
        out[i] = (b, bins[b][1])
        bins[b][1] += sizes[i]
    final = [min(x for x in lengths if x >= fill) for _, fill in bins]
    return [(*out[i], final[out[i][0]]) for i in range(len(sizes))]


def cost(packed, overhead):
    return sum(x + overhead for x in {b: length for b, _, length in packed}.values())


def test_against_plain_search():
    rng = random.Random(1)
    for lengths in ((8, 16, 64), (10,), (5, 7, 100)):
        for n in (0, 1, 2, 50, 300):
            sizes = [rng.randint(1, max(lengths)) if rng.random() < 0.5 else rng.randint(1, 5) for _ in range(n)]
            assert list(zip(*P.pack(sizes, lengths, 3))) == plain_pack(sizes, lengths, 3)


def test_several_lengths_cost_no_more():
    rng = random.Random(2)
    sizes = [min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)]
    several = cost(list(zip(*P.pack(sizes))), P.OVERHEAD)
    assert several <= cost(list(zip(*P.pack(sizes, (4096,)))), P.OVERHEAD)
    assert several < 1.03 * (sum(sizes) + P.OVERHEAD * sum(sizes) / 4096) + 4096


def check(rows, words):
    """Every word once, in order; bins within their length; lengths as small as may be."""
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.bin_id, []).append(r)
    assert {i: sum(r.n_words for r in rs) for i, rs in by_doc.items()} == {i: n for i, n in words.items() if n}
    for own in by_bin.values():
        own.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in own:
            assert r.bin_offset == at
            at += r.n_words
        assert {r.bin_length for r in own} == {min(x for x in P.LENGTHS if x >= at)}


def test_whole_table(spark, sf):
    words = {r.doc_id: len((r.text or "").encode().split()) for r in table(spark, sf, "documents").collect()}
    check(QUERIES["op3_packing"](spark, sf).collect(), words)


def test_edges(docs_of):
    rows = [(1, None), (2, " "), (3, "w " * 10_000), (4, "a b c"), (5, "x " * 4096)]
    got = P.packed(docs_of(rows)).collect()
    check(got, {3: 10_000, 4: 3, 5: 4096})
    assert sorted((r.piece, r.first_word, r.n_words) for r in got if r.doc_id == 3) == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1808)]
    assert P.packed(docs_of([])).count() == 0
    again = P.packed(docs_of([(7, "a b"), (7, "a b"), (None, "c")])).collect()
    assert sorted(str(r.doc_id) for r in again) == ["7", "7", "None"]


def test_shards_hold_bounded_rows(docs_of):
    rows = [(i, "w " * (i % 90 + 1)) for i in range(500)]
    got = P.packed(docs_of(rows), rows_per_shard=50).collect()
    check(got, {i: i % 90 + 1 for i in range(500)})


def test_ids_beside_null_stay_exact(docs_of):
    big = 9007199254740993
    assert {r.doc_id for r in P.packed(docs_of([(big, "a b"), (None, "c"), (-big, "d " * 5000)])).collect()} == {big, None, -big}
