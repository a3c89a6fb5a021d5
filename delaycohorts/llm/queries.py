"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from delaycohorts.llm import decontaminate, kd_shards, line_dedup, merkle, nbsvm, ngram_join, packing, quality_rules, tag_paths, token_counts, toxicity, warc, whitening
from delaycohorts.llm.common import table

_OVER = {
    "op2_warc": ("pages", warc.digest_rows),
    "op4_quality_rules": ("documents", quality_rules.digest_rows),
    "op5_kd_shards": ("documents", kd_shards.digest_rows),
    "op7_line_dedup": ("documents", line_dedup.digest_rows),
    "op6_retrieval_packing": ("documents", packing.digest_rows),
    "op8_tag_paths": ("pages", tag_paths.digest_rows),
    "op9_ngram_jaccard": ("documents", ngram_join.digest_rows),
    "op10_token_counts": ("documents", token_counts.digest_rows),
    "op11_merkle_manifest": ("documents", merkle.digest_rows),
    "op13_spectrum_whitening": ("embeddings", whitening.digest_rows),
}


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels that are not held out."""
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of the corpus pipeline, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    single = {name: (lambda spark, sf_dir, t=t, f=f: f(table(spark, sf_dir, t))) for name, (t, f) in _OVER.items()}
    return single | {"op1_nbsvm_quality": quality_scores, "op3_benchmark_leaks": benchmark_leaks, "op12_text_cnn": toxicity_scores, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from delaycohorts.llm.oracle import oracle_sql as statements

    return {name: sql for name, sql in statements().items() if name in _OVER}
