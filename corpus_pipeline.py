"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, decontamination and tokenization.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

In every stage a null text counts as empty, texts are read whole whatever their length, every row is a document of its own even
where ids are null or repeated, columns beyond those of ``documents`` go, whatever their names, and no documents in give none out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, line_dedup, near_copies, quality_rules
from gridloom.llm._base import TEXTS, _conf, write

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep. Rows without words fail the base rules; equal texts get equal
    verdicts; without usable labels only the base rules hold."""
    return quality_rules.filter_documents(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their frequent lines; ``n_chars`` follows the text. A text that loses all lines stays, empty; a null text
    becomes empty; a line counts once for each row that holds it."""
    return line_dedup.dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates. Candidates are the documents that op7's fingerprints link, and
    others by minima; both are verified: 5-word shingles, Jaccard similarity 0.8 or more. One row of each group stays, of equal ids the first, null ids last; empty and null texts are copies of each other."""
    return near_copies.keep_one(docs.select(COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are judged one by one, whatever their ids; empty texts hold nothing; without a
    benchmark all stay."""
    return decontaminate.drop_held(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes of each document left; an empty text has no tokens. Repeated rows give
    repeated rows."""
    coded = bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    with _conf(spark, **TEXTS):
        return write(coded, "tokens")


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokenize),
]

#: SQL can express neither the learned list nor the merges of the tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
