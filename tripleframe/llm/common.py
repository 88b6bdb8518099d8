"""Expressions and small helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.session import ensure_checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[ \\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; no words for null or blank text.

    A text whose only white space is the space is cut at a plain character, which takes no regular expression.
    """
    trimmed = F.btrim(text, F.lit(WHITE))
    other = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in WHITE[1:]])
    none = F.array().cast("array<string>")
    mixed = F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE_RUN)).otherwise(none)
    return F.when(other, mixed).when(F.length(text) > 0, F.array_remove(F.split(text, " "), "")).otherwise(none)


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are in ``chars``; 0 for null."""
    return F.coalesce(F.length(text) - F.length(F.translate(text, chars, "")), F.lit(0)).cast("long")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under internal names, so that further columns of the caller cannot clash."""
    return df.select(*[df[source].alias(target) for target, source in columns.items()])


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from it: lineage ends there.

    The folder is the one that ``spark.checkpoint.dir`` names, so lost executors cost a retry, not a rerun.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
