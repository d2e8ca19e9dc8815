"""The classifier: held-out accuracy, gradients, whole texts, edges."""

import zlib

import numpy as np

from geoevents.llm import toxicity as T
from geoevents.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = T.scored(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    own = [r for r in rows if r.held_out]
    hits = sum(r.predicted and r.toxic for r in own)
    assert hits / sum(r.predicted for r in own) > 0.85 and hits / sum(r.toxic for r in own) > 0.7
    score, truth = np.array([r.score for r in own]), np.array([r.toxic for r in own])
    rank = score.argsort().argsort()
    n = truth.sum()
    assert (rank[truth == 1].mean() - (n - 1) / 2) / (len(own) - n) > 0.93


def test_held_out_labels_are_never_read(spark, docs_of):
    rows = [(i, f"word{i % 7} good" if i % 3 else f"word{i % 5} bad") for i in range(120)]
    labels = [(i, 0, int(i % 3 == 0)) for i in range(120)]
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in T.scored(docs_of(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
            for x in (labels, turned))
    assert a == b


def test_long_texts_are_scored_whole(monkeypatch):
    raw = T.TextCnn().to_bytes()
    words = [b"w%d" % (i % 911) for i in range(5000)]
    texts = [b" ".join(words), b"", b"one", b" ".join(words[:37])]
    whole = T.Scorer(raw).logits(texts)
    monkeypatch.setattr(T, "_STEP_WORDS", 64)
    assert np.allclose(T.Scorer(raw).logits(texts), whole, atol=1e-5)
    alone = np.concatenate([T.Scorer(raw).logits([t]) for t in texts])
    assert np.allclose(alone, whole, atol=1e-5)


def test_fit_separates_word_pairs():
    """Only the order of two words tells the labels apart, which needs a filter wider than one word."""
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for k in range(400):
        filler = [b"f%d" % rng.integers(20) for _ in range(8)]
        pair = [b"not", b"good"] if k % 2 else [b"good", b"not"]
        at = int(rng.integers(8))
        texts.append(T.padded(filler[:at] + pair + filler[at:]))
        labels.append(k % 2)
    model, y = T.TextCnn(), np.array(labels, np.float32)
    model.fit(texts, y, np.ones(len(y), np.float32), epochs=12)
    scorer = T.Scorer(model.to_bytes())
    z = scorer.logits([b"f1 f2 not good f3", b"f1 f2 good not f3", b"f5 good not", b"not good f9"])
    assert z[0] > 0 > z[1] and z[3] > 0 > z[2]


def test_thresholds():
    assert T.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == 0.5
    assert T.best_threshold(np.array([0.9, 0.8]), np.array([0, 0])) == T.THRESHOLD
    assert T.best_threshold(np.array([0.5, 0.5, 0.1]), np.array([1, 0, 0])) == 0.3


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "word"), (3, "word"), (3, "word"), (4, "w " * 200_000)]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = T.scored(docs_of(rows), empty).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    odd = spark.createDataFrame([(None, 1, 1), (3, 1, None), (4, 1, 7), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert T.scored(docs_of(rows), odd).count() == 6 and T.scored(docs_of([]), empty).count() == 0


def test_against_a_plain_forward_pass():
    """Scores equal a network written out word by word: sums of embeddings, one dot product per filter and place, the largest, a sum."""
    model = T.TextCnn(seed=11)
    texts = [b"Some few words, and more words", b"", b"one", b"a b", "ünï köde w0rds".encode()]
    empty = np.zeros(T.DIM)
    for text, z in zip(texts, T.Scorer(model.to_bytes()).logits(texts)):
        ids = T.features(T.word_list(text))
        vectors = [sum(model.table[i].astype(float) for i in row) for row in ids] or [empty]
        want, k = float(model.offset), 0
        for w in T.WIDTHS:
            for f in range(T.FILTERS):
                best = max(sum(float((vectors[at + o] if at + o < len(vectors) else empty) @ model.filters[w, o][:, f]) for o in range(w))
                           for at in range(len(vectors)))
                want += max(0.0, best + float(model.bias[w][f])) * float(model.out[k])
                k += 1
        assert abs(want - z) < 1e-3
