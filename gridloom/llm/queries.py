"""The queries of this subpackage and the SQL that gives the same rows, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, decontaminate, html_text, line_dedup, pii_crf, quality_rules, simhash, suffix_array, suffix_tree


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": _pipeline,
        "op1_chat_format": _over("conversations", chat_format.op1),
        "op2_pii": _over("documents", pii_crf.op2),
        "op3_quality_rules": lambda spark, d: quality_rules.op3(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")),
        "op4_bpe": _over("documents", bpe.op4),
        "op5_decontaminate": lambda spark, d: decontaminate.op5(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")),
        "op6_line_dedup": _over("documents", line_dedup.op6),
        "op7_simhash": _over("documents", simhash.op7),
        "op8_substring_dedup": _over("documents", suffix_tree.op8),
        "op9_suffix_array": _over("documents", suffix_array.op9),
        "op10_html_text": _over("pages", html_text.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.SQL,
        "op5_decontaminate": decontaminate.SQL,
        "op6_line_dedup": line_dedup.SQL,
    }
