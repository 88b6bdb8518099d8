"""Evaluation cases, concept payloads, schema and metric files, endpoint addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = """
case_id string, question string,
required_terms array<string>, required_pattern_kinds array<string>,
required_triples array<struct<subject:string,predicate:string,object:string>>,
required_property_paths array<struct<subject:string,predicate:string,operator:string,object:string>>,
expected_bindings array<map<string,string>>, binding_aliases map<string,array<string>>,
result_expectation map<string,string>, expect_clarification boolean, expect_invalid boolean
"""

# Concept kinds and the payload keys that have a column of their own.
CONCEPT_KINDS = ["class", "property", "individual", "graph", "datatype", "unknown"]
CONCEPT_KEYS = [
    "iri", "prefixed_name", "label", "aliases", "kind", "description", "domain", "range",
    "examples", "source",
]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases as JSON lines."""
    return spark.read.schema(CASE_SCHEMA).json(path)


def _text(payload: Column, key: str) -> Column:
    value = payload[key]
    return F.when(value != "", value)


def _texts(payload: Column, key: str) -> Column:
    """A list stays a list without nulls, a scalar becomes a list of one, anything else is empty."""
    raw = payload[key]
    listed = F.filter(F.from_json(raw, "array<string>"), lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    return (
        F.when(raw.isNull(), empty)
        .when(raw.startswith("["), F.coalesce(listed, empty))
        .when(raw.startswith("{"), empty)
        .otherwise(F.array(raw))
    )


def concepts_from_payloads(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """JSON payloads to concept rows; returns ``(concepts, rejected)``, rejected lack an ``iri``."""
    parsed = payloads.withColumn("__p", F.from_json(F.col(column), "map<string,string>"))
    p = F.col("__p")
    # from_json prints numbers and objects too; an iri has to be a JSON string.
    quoted = F.get_json_object(F.col(column), "$.iri")
    is_string = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(column)), "$.iri", "variant")) == "STRING"
    ok = F.coalesce((quoted != "") & is_string, F.lit(False))
    kind = F.when(p["kind"].isin(CONCEPT_KINDS), p["kind"]).otherwise(F.lit("unknown"))
    concepts = parsed.where(ok).select(
        p["iri"].alias("iri"),
        _text(p, "prefixed_name").alias("prefixed_name"),
        _text(p, "label").alias("label"),
        _texts(p, "aliases").alias("aliases"),
        kind.alias("kind"),
        _text(p, "description").alias("description"),
        _texts(p, "domain").alias("domain"),
        _texts(p, "range").alias("range"),
        _texts(p, "examples").alias("examples"),
        _text(p, "source").alias("source"),
        F.map_filter(p, lambda k, _: ~k.isin(CONCEPT_KEYS)).alias("metadata"),
    )
    return concepts, parsed.where(~ok).drop("__p")


def write_schema(terms: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Schema terms as JSON, one folder per kind."""
    terms.write.mode(mode).partitionBy("kind").json(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``(metric, value)`` rows as JSON lines in name order; a report holds tens of metrics."""
    metrics.orderBy("metric").coalesce(1).write.mode(mode).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A baseline document, either flat or under ``metrics``, as ``(metric, value)`` numbers."""
    doc = spark.read.text(path, wholetext=True)
    nested = F.get_json_object("value", "$.metrics")
    body = F.when(nested.startswith("{"), nested).otherwise(F.col("value"))
    pairs = doc.select(F.explode(F.from_json(body, "map<string,string>")).alias("metric", "text"))
    value = F.when(F.col("text") == "true", 1.0).when(F.col("text") == "false", 0.0)
    value = F.coalesce(value, F.col("text").try_cast("double"))
    return pairs.select("metric", value.alias("value")).where(F.col("value").isNotNull())


def write_report(
    cases: DataFrame, metrics: DataFrame, failures: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """The full report: cases, metrics and gate failures in three folders of JSON lines."""
    cases.write.mode(mode).json(f"{path}/cases")
    write_metrics(metrics, f"{path}/metrics", mode)
    failures.coalesce(1).write.mode(mode).json(f"{path}/threshold_failures")


def redact_url(url: Column) -> Column:
    """Scheme, host, port and path of an address; user, password and query never pass."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(url, r"^[^/]+//(?:[^/@]*@)?(?:\[[^\]]*\]|[^/:?#]*):(\d+)", 1)
    shown = F.when(port.isin("", "0"), host).otherwise(F.concat_ws(":", host, port))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    whole = F.concat(scheme, F.lit("://"), F.coalesce(shown, F.lit("")), path)
    return F.when(url == "", F.lit("")).otherwise(whole)
