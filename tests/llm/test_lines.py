"""Line dedup against plain counting; the store's changes can be taken back."""

import hashlib
import re
from collections import Counter

import numpy as np
import oracle
import pytest

from geoevents.llm import lines as L
from geoevents.llm.common import table
from geoevents.llm.oracles import ORACLES
from geoevents.llm.queries import QUERIES


def key(line):
    line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def plain(rows, least=10):
    often = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (key(x) and often[key(x)] >= least)]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table_against_sql(spark, sf):
    assert oracle.difference(QUERIES["op5_lines"](spark, sf), oracle.connect(sf), ORACLES["op5_lines"]) is None


def test_edges(docs_of):
    rows = [(i, f" Shared LINE\t\nown {i}\n\n  \n É") for i in range(10)] + [(90, None), (91, ""), (None, "shared line"), (3, "shared line\nshared line"),
            (3, "shared line\nshared line"), (92, "shared\x0bline"), (93, "x" * 300_000 + "\nshared line")]
    assert rows_of(L.dedup_digests(docs_of(rows))) == plain(rows)
    texts = {(r.doc_id, r.text, r.n_chars) for r in L.dedup(docs_of(rows)).collect()}
    assert (0, "own 0\n\n  ", 9) in texts and (90, None, None) in texts and (None, "", 0) in texts and (3, "", 0) in texts
    assert L.dedup_digests(docs_of([])).count() == 0 and L.dedup(docs_of([])).count() == 0


def test_store_is_reversible(spark, docs_of):
    a = L.line_refs(docs_of([(i, f"one\ntwo {i % 3}\nthree {i}") for i in range(30)]))
    b = L.line_refs(docs_of([(100 + i, f"two {i % 3}\nfour\nfive {i % 2}") for i in range(20)]))
    store = L.LineStore.build(a, least_docs=10, keys_per_shard=8)
    assert store.shards > 1
    fresh = L.LineStore.build(a.unionByName(b), least_docs=10, keys_per_shard=8)
    more = store.add(b)
    back = more.remove(b)
    counts = lambda s: rows_of(s.counts)
    assert counts(more) == counts(fresh) and counts(back) == counts(store)
    known = lambda s: sorted(tuple(r) for r in s.frequent(fresh.counts.select("hi", "lo")).collect())
    want = sorted((r.hi, r.lo) for r in more.counts.collect() if r.n_docs >= 10)
    assert known(more) == want and known(back) == sorted((r.hi, r.lo) for r in store.counts.collect() if r.n_docs >= 10)
    gone = back.remove(a)
    assert gone.counts.count() == 0 and known(gone) == []


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    made = L.CuckooFilter.build(keys)
    assert made.contains(keys).all()
    others = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert made.contains(others).mean() < 0.01
    for k in keys[:2500]:
        assert made.delete(k)
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01
    assert L.CuckooFilter.from_bytes(made.to_bytes()).contains(keys[2500:]).all()


def test_key_bound(spark, sf):
    assert L.digest(b" \t ") is None and L.digest(b" A ") == L.digest(b"a") and L.digest("é".encode(), 2) is None
    assert L.line_refs(table(spark, sf, "documents")).count() > 0


def test_store_refuses_what_was_never_added(spark, docs_of):
    store = L.LineStore.build(L.line_refs(docs_of([(1, "a\nb"), (2, "a")])), least_docs=2)
    with pytest.raises(ValueError, match="never added"):
        store.remove(L.line_refs(docs_of([(3, "c")])))
    again = store.remove(L.line_refs(docs_of([(2, "a")]))).add(L.line_refs(docs_of([(2, "a")])))
    assert rows_of(again.counts) == rows_of(store.counts)


def test_store_lives_on_in_a_folder(spark, docs_of, tmp_path):
    rows = [(i, f"shared\nown {i}") for i in range(12)]
    store = L.LineStore.build(L.line_refs(docs_of(rows)))
    store.save(str(tmp_path / "store"))
    held = L.LineStore.load(spark, str(tmp_path / "store"))
    assert rows_of(held.counts) == rows_of(store.counts) and held.least_docs == store.least_docs
    got = L.dedup_digests(docs_of([(99, "shared\nnew")]), store=held.add(L.line_refs(docs_of([(99, "shared\nnew")])))).first()
    assert (got.n_lines, got.n_dropped) == (2, 1)
