"""Registered queries: each name has a Spark function of (spark, folder) and, where SQL can say it, SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.runs: dict[str, Run] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Run], Run]:
        def register(run: Run) -> Run:
            name = run.__name__
            if name in self.runs:
                raise ValueError(f"query registered twice: {name}")
            self.runs[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return register


registry = Registry()


def once(build: Run) -> Run:
    """Build a graph view once per application and folder; queries then share the same plan."""
    built: dict[tuple, DataFrame] = {}

    @wraps(build)
    def view(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder)
        if key not in built:
            built[key] = build(spark, folder)
        return built[key]

    return view


def iri(kind: str, *columns: str) -> str:
    """SQL text of an entity IRI."""
    return "('http://example.org/" + kind + "'" + "".join(f" || '/' || {c}" for c in columns) + ")"


def load() -> Registry:
    from tripleframe.queries import evaluation, functions, graph, linking, retrieval, schema, stored  # noqa: F401

    return registry
