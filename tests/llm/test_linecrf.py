"""The chain against enumeration of all state sequences and numeric gradients; held-out accuracy; edges."""

import itertools
import zlib

import numpy as np

from geoevents.llm import linecrf as C
from geoevents.llm.common import table
from geoevents.llm.queries import QUERIES
from geoevents.llm.toxicity import best_threshold


def enumerated(lean, ties):
    """(chances, joints, log of the sum) of one chain by adding up every sequence of states."""
    n = len(lean)
    total, chance, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for states in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(x * s for x, s in zip(lean, states)) + sum(ties[a, b] for a, b in zip(states, states[1:])))
        total += w
        chance += w * np.array(states)
        for t in range(1, n):
            joint[t, states[t - 1], states[t]] += w
    return chance / total, joint / total, np.log(total)


def test_chain_against_enumeration():
    rng = np.random.default_rng(0)
    for sizes in ([1], [5], [1, 1, 1], [3, 7, 1, 9, 2], [10, 10]):
        lean, ties = rng.normal(0, 2, sum(sizes)), rng.normal(0, 1, (2, 2))
        first = C.firsts(np.repeat(np.arange(len(sizes)), sizes))
        chance, joint = C.forward_backward(lean, first, ties)
        at = 0
        for n in sizes:
            own, pairs, _ = enumerated(lean[at:at + n], ties)
            assert np.allclose(chance[at:at + n], own) and np.allclose(joint[at + 1:at + n], pairs[1:])
            at += n


def test_long_chains_do_not_run_out_of_range():
    lean = np.where(np.arange(200_000) % 2, 40.0, -40.0)
    chance, _ = C.forward_backward(lean, np.arange(200_000) == 0, np.array([[3.0, -3.0], [-3.0, 3.0]]))
    assert np.isfinite(chance).all() and chance[1::2].min() > 0.9 and chance[::2].max() < 0.1


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    owner = np.repeat(np.arange(3), (4, 1, 5))
    first = C.firsts(owner)
    wide = C.with_neighbours(rng.integers(0, 8, (10, len(C.MEASURES))).astype(np.uint8), first)
    good = rng.integers(0, 2, 10)
    share = np.full(10, 1.0)

    def likelihood(weights, ties):
        model, out = C.LineCrf(weights, ties), 0.0
        lean = model.lean(wide)
        for d in range(3):
            at = np.flatnonzero(owner == d)
            y = good[at]
            out += (lean[at] * y).sum() + sum(ties[a, b] for a, b in zip(y, y[1:])) - enumerated(lean[at], ties)[2]
        return out

    model = C.LineCrf(rng.normal(0, 0.3, (3 * len(C.MEASURES), 9)), rng.normal(0, 0.5, (2, 2)))
    by_bin, by_tie = model.gradient(wide, first, good, share)
    step = 1e-5
    for value, grad, places in ((model.weights, by_bin, [(0, int(wide[0, 0])), (5, int(wide[3, 5])), (20, int(wide[7, 20]))]),
                                (model.ties, by_tie, [(0, 0), (0, 1), (1, 1)])):
        for p in places:
            value[p] += step
            up = likelihood(model.weights, model.ties)
            value[p] -= 2 * step
            down = likelihood(model.weights, model.ties)
            value[p] += step
            assert abs((up - down) / (2 * step) - grad[p]) < 1e-5


def test_neighbours_decide():
    """A line without a lean of its own follows its neighbours."""
    chance, _ = C.forward_backward(np.array([4.0, 0.0, 4.0, -4.0, 0.0, -4.0]), np.arange(6) % 3 == 0, np.array([[1.0, -1.0], [-1.0, 1.0]]))
    assert chance[1] > 0.9 and chance[4] < 0.1


def test_measures():
    bins, owner, weight = C.line_bins([b"Same line\n\nSame line\n#### $$$$", b"", "ÄÖ ab ab ab ab".encode()])
    assert owner.tolist() == [0, 0, 0, 0, 1, 2] and weight.tolist() == [10, 1, 10, 10, 1, 17]
    name = list(C.MEASURES).index
    assert bins[0, name("same_lines")] == bins[2, name("same_lines")] == 1 and bins[1, name("same_lines")] == 0
    assert bins[3, name("symbols")] == 7 and bins[0, name("symbols")] == 0 and bins[5, name("adjacent_words")] == 6
    wide = C.with_neighbours(bins, C.firsts(owner))
    k = len(C.MEASURES)
    assert (wide[0, k:2 * k] == 8).all() and (wide[3, 2 * k:] == 8).all() and (wide[1, k:2 * k] == bins[0]).all() and (wide[4, k:] == 8).all()


def test_lines_of_bad_texts():
    owner, weight = np.array([0, 0, 1, 1, 1, 2]), np.array([5.0, 5, 2, 2, 9, 3])
    lean = np.array([-9.0, 9, 9, 0, -9, 9])
    assert C.line_labels(lean, owner, np.array([True, False, False]), weight).tolist() == [1, 1, 1, 0, 0, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    rows = QUERIES["op13_line_crf"](spark, sf).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in own) / len(own) > 0.97
    for value in (0, 1):
        those = [r for r in own if r.quality == value]
        assert sum(r.predicted == value for r in those) / len(those) > 0.95


def test_held_out_labels_are_never_read(spark, docs_of):
    rows = [(i, f"word{i % 7} good text here" if i % 3 else f"#### $$$$ {i % 5}") for i in range(120)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(120)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    a, b = (sorted((r.doc_id, r.score, r.predicted) for r in C.scored(docs_of(rows), spark.createDataFrame(
        x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, turned))
    assert a == b and all(p == int(i % 3 > 0) for i, _, p in a)


def test_every_labelled_row_is_used(spark, docs_of):
    """More than a few thousand rows of a label, and texts of any length; each with its label, in its role."""
    rows = [(i, f"word{i % 7} good text here {i}" if i % 6 else f"#### $$$$ {i}") for i in range(8000)] + [(8001, "long " * 20_000), (8004, None)]
    labels = spark.createDataFrame([(i, int(i % 6 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    frame = docs_of(rows).selectExpr("doc_id", "text AS _text")
    got = C.training_bins(frame, labels, "doc_id", "quality").collect()
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in rows}
    for role, folds in (("fit", (0, 1)), ("calibrate", (3,))):
        for value in (0, 1):
            want = sum(fold[i] in folds and int(i % 6 > 0) == value for i, t in rows if t is not None)
            assert sum(r.role == role and r.label == value for r in got) == want
    assert max(np.frombuffer(r.weights).sum() for r in got) == 100_001 and fold[8001] != 2


def test_parts_climb_as_one(spark, docs_of, monkeypatch):
    """The fit over several parts and slices goes by the same gradients as over all lines at once, and so does the threshold."""
    rng = np.random.default_rng(2)
    rows = [(i, "\n".join("#### $$$$ !!" if rng.random() < (0.2 if i % 3 else 0.7) else f"fine words {i % 5} here" for _ in range(1 + i % 6))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = C.training_bins(docs_of(rows).selectExpr("doc_id", "text AS _text"), labels, "doc_id", "quality").filter("role = 'fit'")
    pdf, per_text = got.toPandas(), (0.002, 0.001)
    monkeypatch.setattr(C, "ITERATIONS", 12)
    whole = C.fit_part(list(C._in_slices(pdf, per_text)))
    monkeypatch.setattr(C, "SLICE_LINES", 50)
    slices = list(C._in_slices(pdf, per_text))
    parts = C.fit_parts(spark.createDataFrame([x.row() for x in slices], C.Lines.SCHEMA).repartition(3))
    assert len(slices) > 5 and np.allclose(whole.weights, parts.weights) and np.allclose(whole.ties, parts.ties) and whole.ties.any()


def test_best_cut_is_the_best_threshold(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 700):
        z, y = np.round(rng.normal(0, 1, n), 1), rng.integers(0, 2, n)
        z += y * rng.integers(0, 2)
        frame = spark.createDataFrame(list(zip(z.tolist(), y.tolist())), "z double, label int")
        assert abs(C.best_cut(frame, 0.25) - best_threshold(z, y, 0.25)) < 1e-12
    assert C.best_cut(spark.createDataFrame([], "z double, label int"), 0.25) == 0.25


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "word"), (3, "word"), (3, "word"), (4, "w " * 200_000), (5, "\n" * 50_000)]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = C.scored(docs_of(rows), empty).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    odd = spark.createDataFrame([(None, 1, 1), (3, None, 1), (4, 7, 1), (2, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert C.scored(docs_of(rows), odd).count() == 7 and C.scored(docs_of([]), empty).count() == 0


def test_line_verdicts(spark, docs_of):
    model = C.LineCrf()
    model.weights[list(C.MEASURES).index("symbols"), 7] = -8.0
    model.weights[list(C.MEASURES).index("symbols"), 0] = 4.0
    got = sorted((r.doc_id, r.line, r.n_bytes, r.good > 0.5) for r in C.line_verdicts(docs_of([(1, "fine words\n####"), (2, None)]), model).collect())
    assert got == [(1, 0, 10, True), (1, 1, 4, False), (2, 0, 0, True)]
