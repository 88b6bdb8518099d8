"""SPARQL-JSON result documents: read, check and normalise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.operators.bindings import Bindings

_VALUE = "struct<type:string,value:string,datatype:string,`xml:lang`:string>"
_ROWS = f"array<map<string,{_VALUE}>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One result document per file, as ``(source, document)`` text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("document"))


def _field(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def check_select(documents: DataFrame) -> DataFrame:
    """Add ``error``: NULL for a well-formed SELECT document, else what is wrong with it."""
    doc = F.col("document")
    parsed = F.try_parse_json(doc)
    top = F.schema_of_variant(parsed)
    head = F.schema_of_variant(F.try_variant_get(parsed, "$.head", "variant"))
    results = F.schema_of_variant(F.try_variant_get(parsed, "$.results", "variant"))
    rows = F.schema_of_variant(F.try_variant_get(parsed, "$.results.bindings", "variant"))
    names = F.try_variant_get(parsed, "$.head.vars", "variant")
    error = (
        F.when(parsed.isNull(), "not valid JSON")
        .when(~F.startswith(top, F.lit("OBJECT")), "not a JSON object")
        .when(~F.coalesce(F.startswith(head, F.lit("OBJECT")), F.lit(False)) | names.isNull(), "missing head.vars")
        .when(
            ~F.coalesce(F.startswith(results, F.lit("OBJECT")), F.lit(False))
            | ~F.coalesce(F.startswith(rows, F.lit("ARRAY")), F.lit(False)),
            "missing results.bindings array",
        )
    )
    return documents.withColumn("error", error)


def check_ask(documents: DataFrame) -> DataFrame:
    """Add ``error`` and ``answer`` for ASK documents; the answer must be a JSON boolean."""
    parsed = F.try_parse_json(F.col("document"))
    value = F.try_variant_get(parsed, "$.boolean", "variant")
    kind = F.schema_of_variant(value)
    error = (
        F.when(parsed.isNull(), "not valid JSON")
        .when(value.isNull(), "missing boolean")
        .when(kind != "BOOLEAN", "boolean is not a JSON boolean")
    )
    return documents.withColumn("error", error).withColumn(
        "answer", F.when(error.isNull(), F.try_variant_get(parsed, "$.boolean", "boolean"))
    )


def value_key(v: Column) -> Column:
    """Term text of a result value; values of an unknown type are dropped."""
    body, datatype, tag = v["value"], v["datatype"], v["xml:lang"]
    body = F.coalesce(body, F.lit(""))
    suffix = (
        F.when(tag.isNotNull(), F.concat(F.lit("@"), F.lower(tag)))
        .when(datatype.isNotNull() & (datatype != V.XSD + "string"), F.concat(F.lit("^^"), datatype))
        .otherwise(F.lit(""))
    )
    return (
        F.when(v["type"] == "uri", body)
        .when(v["type"] == "bnode", F.concat(F.lit("_:"), body))
        .when(
            v["type"].isin("literal", "typed-literal"),
            F.concat(F.lit('"'), body, F.lit('"'), suffix),
        )
    )


def select_bindings(documents: DataFrame, variables: list[str]) -> Bindings:
    """Rows of well-formed documents with one term column per variable."""
    good = check_select(documents).where(F.col("error").isNull())
    rows = F.from_json(_field(F.col("document"), "$.results.bindings"), _ROWS)
    exploded = good.select(F.explode(rows).alias("row"))
    cols = [value_key(F.col("row")[v]).alias(v) for v in variables]
    return Bindings(exploded.select(*cols), certain=())


def result_variables(documents: DataFrame) -> DataFrame:
    """Declared variables of each document."""
    names = F.from_json(_field(F.col("document"), "$.head.vars"), "array<string>")
    return documents.select("*", names.alias("variables"))
