"""The fit uses all labelled rows, in as many parts as they need."""

import numpy as np

from geoevents.llm import toxicity as T


def labelled(spark, n):
    rows = [(i, f"word{i % 7} plain text {i % 11} " + ("vile scum" if i % 3 == 0 else "kind friend") + " more" * (20_000 if i == 9 else 1)) for i in range(n)]
    return rows, spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")


def test_every_labelled_row_is_used(spark, docs_of, monkeypatch):
    rows, labels = labelled(spark, 3000)
    monkeypatch.setattr(T, "PART_ROWS", 200)
    used = T.training_rows(docs_of(rows), labels)
    want = labels.filter(~T.held_out("doc_id")).count()
    assert used.count() == want and used.filter("length(text) > 50000").count() == 1
    sizes = [r["count"] for r in used.filter("role = 'fit'").groupBy(T.F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and sum(sizes) == used.filter("role = 'fit'").count()


def test_fit_in_parts_separates(spark, docs_of, monkeypatch):
    rows, labels = labelled(spark, 1500)
    monkeypatch.setattr(T, "PART_ROWS", 150)
    got = T.scored(docs_of(rows), labels).filter("held_out").collect()
    assert len(got) > 200 and all(r.predicted == int(r.doc_id % 3 == 0) for r in got)


def test_threshold_of_tallies():
    scores, labels = np.array([0.9, 0.9, 0.4, 0.4, 0.1]), np.array([1, 1, 1, 0, 0])
    assert T.best_threshold(np.array([0.9, 0.4, 0.1]), np.array([2, 1, 0]), 0.3, np.array([2, 2, 1])) == T.best_threshold(scores, labels)


def test_parts_are_of_one_size(spark, docs_of, monkeypatch):
    """A part's task must not get other parts too: the longest task of an epoch is one part long."""
    rows, labels = labelled(spark, 3000)
    monkeypatch.setattr(T, "PART_ROWS", 150)
    fit = T.training_rows(docs_of(rows), labels).filter("role = 'fit'")
    sizes = [r["count"] for r in fit.groupBy(T.F.spark_partition_id()).count().collect()]
    assert len(sizes) == -(-fit.count() // 150) and max(sizes) < 1.5 * 150


def test_words_are_hashed_once(monkeypatch):
    texts = [b"one two one", b"", b"two two three"] * 50
    want, met, plain = [T.padded(T.word_list(t)) for t in texts], [], T.features
    monkeypatch.setattr(T, "features", lambda words: met.extend(words) or plain(words))
    got = T.coded(texts)
    assert sorted(met) == [b"one", b"three", b"two"] and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
