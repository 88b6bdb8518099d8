"""A training corpus from ``documents``: filter, dedupe lines, dedupe documents, mix sources, encode.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of the documents.

Defined results: null and empty texts fail the base rule and go with the first stage. Rows that repeat a doc_id are
judged by their own text; of equal rows near dedup keeps one. Rows without doc_id pass near dedup. Further columns are
carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from tripleframe.llm.common import count_words, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near copies of a training corpus: runs of five words at a similarity of 0.8. 36 bands of 5 miss such a pair with
# probability 6e-7; the 24 bands of the operator's own threshold would miss it with 7e-5.
NEAR_PERCENT = 80
NEAR_BANDS = 36


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table; repeated lines are left to the next stage."""
    return quality_rules.apply_rules(docs, rules=quality_rules.RULES_BEFORE_LINE_DEDUP).filter("kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier line; a document that has no word left goes."""
    cleaned = line_dedup.dedupe_lines(docs)
    return cleaned.filter(count_words(F.col("text")) > 0).withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of those with the smallest identifier in the group."""
    return near_dedup.keep_one(docs, bands=NEAR_BANDS, percent=NEAR_PERCENT).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target of its source asks for."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids: (doc_id, n_tokens, ids), one row for each copy of a document."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

# Token ids cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; tables between the stages go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
