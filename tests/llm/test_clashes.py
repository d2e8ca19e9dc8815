"""Every stage that returns its input's columns keeps them as they are, whatever their names, and takes batches of long texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoevents.llm import lines, quality, secrets, simhash
from geoevents.llm.common import free_name, slices

STAGES = {"quality": quality.keep_good, "lines": lines.dedup, "simhash": simhash.keep_one, "secrets": secrets.redact}
NAMES = ("_text_hash", "_hash", "_id", "_drops", "_drop_id", "_drop_hash", "_drop_list", "_text", "fp", "root", "row", "id", "hash", "order", "hi", "lo",
         "component_id", "least_id", "shard", "text_hash", "_row")


@pytest.mark.parametrize("name", STAGES)
def test_clashing_columns(spark, docs_of, name):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(i, f"{text} number{i * 7} {i}\nshared line") for i in range(12)] + [(None, text + " q" * 9), (3, text + " w" * 9)]
    plain = docs_of(rows)
    extra = plain.select("*", *[F.lit(f"kept {n}").alias(n) for n in NAMES])
    want = sorted(map(str, STAGES[name](plain).collect()))
    got = STAGES[name](extra)
    assert got.columns == extra.columns and sorted(map(str, got.select(*plain.columns).collect())) == want
    assert all(r[n] == f"kept {n}" for r in got.collect() for n in NAMES)


def test_rows_of_one_id_and_text(spark):
    """Of two rows with equal id and text but other columns the same one stays on every run and in any order."""
    rows = [(1, "some text", x) for x in "abcdef"]
    kept = {simhash.keep_one(spark.createDataFrame(r, "doc_id long, text string, x string")).first().x for r in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(kept) == 1


def test_free_name(spark):
    assert free_name(spark.createDataFrame([], "a int, A_ int, b int"), "a") == "a__"


def test_slices_hold_bounded_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "t": ["x" * 10, None, "", "y" * 100, "z" * 5, "z" * 5, "w", "", "v" * 50]})
    parts = list(slices(batch, 60))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 60 for p in parts)
    vectors = pa.RecordBatch.from_pydict({"v": [np.zeros(100).tolist()] * 50})
    assert max(p.num_rows for p in slices(vectors, 8000)) <= 10


def test_many_long_texts(spark):
    """10,000 texts of 100 KB: a worker that kept a whole batch's measures would need gigabytes."""
    def peak(them):
        import resource

        import pyarrow as pa

        for _ in them:
            pass
        yield pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024]})

    text = F.expr("repeat(concat('word', id % 10, ' some more of it '), 4762)")
    long = spark.range(0, 10_000, 1, 16).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert quality.keep_good(long).mapInArrow(peak, "mb long").agg(F.max("mb")).first()[0] < 1000
