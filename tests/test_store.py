"""The bucketed store: touched buckets only, whole batches only, bounded files."""

import os

import pytest

from geoevents.streaming import store

SCHEMA = "id long, version int, v string"


def rows_of(spark, path):
    return sorted((r.id, r.version, r.v) for r in store.read_store(spark, path, SCHEMA).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_files_stay_bounded_after_fifty_batches(spark, tmp_path):
    path, want = str(tmp_path / "s"), {}
    for b in range(50):
        rows = [(i, b, f"{b}") for i in {b, b * 7 % 30, 3}]
        store.put_newest(frame(spark, rows), b, path, "id", "version", buckets=4)
        want.update({i: (i, v, x) for i, v, x in rows})
    assert rows_of(spark, path) == sorted(want.values())
    assert len(files(path)) <= 4 and len(os.listdir(f"{path}/_batches")) <= 2  # the marker and its checksum file


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    store.append_unseen(frame(spark, [(i, 0, "a") for i in range(200)]), 0, path, "id", "version", buckets=16)
    before = set(files(path))
    store.append_unseen(frame(spark, [(7, 1, "known"), (1000, 1, "new")]), 1, path, "id", "version", buckets=999)
    after = set(files(path))
    assert len(before) == 16 and len(before & after) >= 14
    assert rows_of(spark, path) == sorted([*[(i, 0, "a") for i in range(200)], (1000, 1, "new")])


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.put_newest(frame(spark, [(1, 1, "a"), (2, 1, "b")]), 0, path, "id", "version", buckets=4)
    whole = rows_of(spark, path)

    def broken(self, batch_id):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.StoreFolder, "commit", broken)
        with pytest.raises(OSError):
            store.put_newest(frame(spark, [(1, 2, "half"), (3, 1, "c")]), 1, path, "id", "version")
    assert rows_of(spark, path) == whole                     # files of the attempt are there, and no reader sees them
    store.put_newest(frame(spark, [(1, 2, "again"), (4, 1, "d")]), 1, path, "id", "version")
    assert rows_of(spark, path) == [(1, 2, "again"), (2, 1, "b"), (4, 1, "d")]
    store.put_newest(frame(spark, [(1, 9, "twice")]), 1, path, "id", "version")
    assert rows_of(spark, path) == [(1, 2, "again"), (2, 1, "b"), (4, 1, "d")]   # a committed batch changes nothing


def test_versions_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    assert rows_of(spark, path) == []
    store.put_newest(frame(spark, []), 0, path, "id", "version")
    store.put_newest(frame(spark, [(1, 5, "new"), (1, 3, "old"), (2, 1, "x")]), 1, path, "id", "version")
    store.put_newest(frame(spark, [(1, 4, "late"), (2, 1, "same version, later batch"), (None, 1, "no id")]), 2, path, "id", "version")
    assert sorted(map(str, store.read_store(spark, path, SCHEMA).collect())) == sorted(map(str, frame(
        spark, [(1, 5, "new"), (2, 1, "same version, later batch"), (None, 1, "no id")]).collect()))
