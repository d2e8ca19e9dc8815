"""The pipeline's stages, each against a plain computation on what it was given."""

import corpus_pipeline
from test_lines import key
from test_scans import plain_spans
from test_simhash import plain_components, plain_fingerprint

from geoevents.llm import quality, secrets


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert tables[-1].columns == columns
    given, good, lined, single, clean, packed = [[r.asDict() for r in t.collect()] for t in tables]
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in given if not any(
        x.rejects(quality.Measures((r["text"] or "").encode())) for x in quality.RULES)}
    holders = {}
    for r in good:
        for k in {key(x) for x in r["text"].split("\n")}:
            holders[k] = holders.get(k, 0) + 1
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not key(x) or holders[key(x)] < 10) for r in good}
    assert {r["doc_id"]: r["text"] for r in lined} == want and all(r["n_chars"] == len(r["text"]) for r in lined)
    comps = plain_components([plain_fingerprint(r["text"]) for r in lined])
    least = {}
    for r, c in zip(lined, comps):
        least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    assert {r["doc_id"] for r in single} == set(least.values()) and len(single) == len(least)
    before = {r["doc_id"]: r["text"] for r in single}
    assert len(clean) == len(single)
    for r in clean:
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] or plain_spans(before[r["doc_id"]]) or secrets.spans_of(before[r["doc_id"]].encode())
    words = {}
    for r in packed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert words == {r["doc_id"]: n for r in clean if (n := len(r["text"].encode().split()))}
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
