"""One query per operator, over its whole table with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoevents.llm import (ann, bpe, html_text, licenses, linecrf, lines, packing, quality, resample, secrets, simhash, toxicity,
                           vafile)
from geoevents.llm.common import table
from geoevents.llm.oracles import ORACLES

TOKENIZER = "word_bpe_49k.json"


def op1_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op2_licenses(spark: SparkSession, d: str) -> DataFrame:
    found = licenses.scan(table(spark, d, "documents"), wrapped=True)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def op4_bpe(spark: SparkSession, d: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path(TOKENIZER)
    return bpe.encode_digests(table(spark, d, "documents"), tokenizer_file)


def op5_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.dedup_digests(table(spark, d, "documents"))


def op6_permutation_index(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_html_text(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(table(spark, d, "pages"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scored(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.verdicts(table(spark, d, "documents"))


def op10_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.digests(table(spark, d, "documents"))


def op11_va_clusters(spark: SparkSession, d: str) -> DataFrame:
    return vafile.clustered(table(spark, d, "embeddings"))


def op12_resample(spark: SparkSession, d: str) -> DataFrame:
    return resample.resampled(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op13_line_crf(spark: SparkSession, d: str) -> DataFrame:
    return linecrf.scored(table(spark, d, "documents"), table(spark, d, "labels"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_licenses, op3_packing, op4_bpe, op5_lines, op6_permutation_index, op7_html_text, op8_toxicity, op9_quality,
              op10_secrets, op11_va_clusters, op12_resample, op13_line_crf, pipeline)
}
__all__ = ["ORACLES", "QUERIES"]
