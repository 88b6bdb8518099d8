"""Triple patterns, basic graph patterns, graphs, prefixes and allowlists over ``quads(g, s, p, o)``.

A slot is a variable when it is a string starting with ``?``; anything else is a constant term.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.operators.bindings import Bindings

Slot = Any
# Quads as a DataFrame, or a source that narrows its rows by constants: a mapped or a stored graph.
Graph = Any


def is_variable(slot: Slot) -> bool:
    return isinstance(slot, str) and slot.startswith("?")


def _constant(slot: Slot) -> Column:
    return F.lit(slot) if isinstance(slot, str) else t.term(slot)


def all_quads(graph: Graph) -> DataFrame:
    """The rows of a graph as ``(g, s, p, o)``."""
    return graph if isinstance(graph, DataFrame) else graph.quads


def _key(slot: Slot) -> str | None:
    """The term text of a constant that is known before the query runs."""
    if is_variable(slot) or isinstance(slot, Column):
        return None
    return slot if isinstance(slot, str) else t.literal_key(slot)


def _candidates(quads: Graph, s: Slot, p: Slot, o: Slot, graph: str | None) -> DataFrame:
    """The rows among which a pattern's matches are; sources with pruning get its constants."""
    if isinstance(quads, DataFrame):
        return quads
    return quads.narrowed(_key(s), _key(p), _key(o), None if graph is None else _key(graph))


def active_graph(quads: Graph, graph: str | None = None) -> DataFrame:
    """Rows of the default graph, of one named graph, or of every named graph (``?g``)."""
    quads = all_quads(quads)
    if graph is None:
        return quads.where(F.col("g").isNull())
    if is_variable(graph):
        return quads.where(F.col("g").isNotNull())
    return quads.where(F.col("g") == graph)


def pattern(quads: Graph, s: Slot, p: Slot, o: Slot, graph: str | None = None) -> Bindings:
    """Match one triple pattern. Constants reach the scan; a repeated variable adds an equality."""
    df = active_graph(_candidates(quads, s, p, o, graph), graph)
    slots = [("s", s), ("p", p), ("o", o)]
    if graph is not None and is_variable(graph):
        slots.append(("g", graph))
    first: dict[str, str] = {}
    for column, slot in slots:
        if not is_variable(slot):
            df = df.where(F.col(column) == _constant(slot))
        elif slot in first:
            df = df.where(F.col(column) == F.col(first[slot]))
        else:
            first[slot] = column
    return Bindings(df.select(*[F.col(c).alias(v[1:]) for v, c in first.items()]))


# Rows, distinct subjects and distinct objects of a predicate.
Sizes = dict[str, tuple[int, int, int]]


def _statistics(quads: Graph, predicates: Iterable[Slot]) -> Sizes | None:
    """What a source knows of its predicates; None where it keeps no statistics."""
    if not hasattr(quads, "statistics"):
        return None
    return quads.statistics([p for p in predicates if isinstance(p, str) and not is_variable(p)])


def _estimate(p: tuple, seen: set[str], sizes: Sizes) -> float:
    """Rows that a pattern gives for each row found so far, or all its rows if it touches none of them."""
    rows, subjects, objects = sizes.get(p[1], (0, 0, 0)) if isinstance(p[1], str) else (float("inf"), 1, 1)
    known = [not is_variable(x) or x in seen for x in (p[0], p[2])]
    for hit, distinct in zip(known, (subjects, objects), strict=True):
        rows = rows / max(distinct, 1) if hit else rows
    return rows


def _join_order(patterns: list[tuple], sizes: Sizes | None) -> list[tuple]:
    """Whatever touches a known variable next, by the rows it is expected to give; without statistics most constants first."""

    def variables(p: tuple) -> set[str]:
        return {x for x in p if is_variable(x)}

    rest, ordered, seen = list(patterns), [], set()
    while rest:
        linked = [p for p in rest if variables(p) & seen] or rest
        best = min(linked, key=lambda p: len(variables(p)) if sizes is None else _estimate(p, seen, sizes))
        rest.remove(best)
        ordered.append(best)
        seen |= variables(best)
    return ordered


def bgp(
    quads: Graph,
    patterns: list[tuple[Slot, Slot, Slot]],
    graph: str | None = None,
    statistics: Sizes | None = None,
) -> Bindings:
    """Join several triple patterns on their shared variables.

    Inside ``graph="?g"`` all patterns match in the same named graph, because ``g`` is shared too.
    Columns come out in the order the variables are first written, whatever the join order. The order follows
    the statistics of a stored graph, or those that are given.
    """
    sizes = _statistics(quads, [p[1] for p in patterns]) if statistics is None else statistics
    parts = [pattern(quads, *p, graph=graph) for p in _join_order(patterns, sizes)]
    joined = reduce(Bindings.join, parts)
    written = [x[1:] for p in patterns for x in p if is_variable(x)]
    if graph is not None and is_variable(graph):
        written.append(graph[1:])
    return Bindings(joined.df.select(*dict.fromkeys(written)), joined.certain)


def star(
    quads: Graph, subject: str, predicates: dict[str, str], graph: str | None = None
) -> Bindings:
    """Several predicates of one subject in a single scan and one shuffle.

    Subjects with one value per predicate come straight from the aggregation. Those with several
    are joined the ordinary way, so the result always equals :func:`bgp` over the same patterns.

    Statistics decide before planning: where no subject has two values of a predicate, the aggregation is all there
    is; where predicates have many values on average, the patterns are joined.
    """
    subject_name = subject[1:]
    sizes = _statistics(quads, predicates)
    if sizes is not None and any(n > 2 * subjects for n, subjects, _ in sizes.values()):
        return bgp(quads, [(subject, p, v) for p, v in predicates.items()], graph, sizes)
    functional = sizes is not None and all(n == subjects for n, subjects, _ in sizes.values())
    if not isinstance(quads, DataFrame):
        quads = reduce(DataFrame.unionByName, [quads.narrowed(p=p) for p in predicates])
    names = {p: v[1:] for p, v in predicates.items()}
    rows = active_graph(quads, graph).where(F.col("p").isin(list(names)))
    aggs = []
    for i, p in enumerate(names):
        hit = F.col("p") == p
        aggs.append(F.count_if(hit).alias(f"__n{i}"))
        aggs.append(F.max(F.when(hit, F.col("o"))).alias(names[p]))
    counted = rows.groupBy("s").agg(*aggs)
    present = reduce(lambda a, b: a & b, [F.col(f"__n{i}") > 0 for i in range(len(names))])
    many = reduce(lambda a, b: a | b, [F.col(f"__n{i}") > 1 for i in range(len(names))])
    single = counted.where(present & ~many).select(
        F.col("s").alias(subject_name), *names.values()
    )
    if functional:
        return Bindings(single)
    busy = rows.join(counted.where(present & many).select("s"), "s", "left_semi")
    joined = bgp(
        busy.withColumn("g", F.lit(None).cast("string")),
        [(subject, p, v) for p, v in predicates.items()],
    )
    return Bindings(single.unionByName(joined.df))


# ---- prefixes -------------------------------------------------------------------------------


def expand_prefixed(c: Column, prefixes: dict[str, str] | None = None) -> Column:
    """``prefix:local`` to an IRI; absolute web IRIs and unknown prefixes stay as they are."""
    table = prefixes or V.DEFAULT_PREFIXES
    head = F.substring_index(c, ":", 1)
    base = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[head]
    local = c.substr(F.length(head) + F.lit(2), F.length(c))
    keep = ~c.contains(":") | c.startswith("http://") | c.startswith("https://") | base.isNull()
    return F.when(keep, c).otherwise(F.concat(base, local))


def to_prefixed(c: Column, prefixes: dict[str, str] | None = None) -> Column:
    """IRI to ``prefix:local`` by the longest namespace that leaves a legal local name."""
    table = sorted((prefixes or V.DEFAULT_PREFIXES).items(), key=lambda kv: -len(kv[1]))
    options = []
    for name, base in table:
        local = c.substr(F.lit(len(base) + 1), F.length(c))
        legal = c.startswith(base) & F.rlike(local, F.lit(V.LOCAL_NAME))
        options.append(F.when(legal, F.concat(F.lit(name + ":"), local)))
    return F.coalesce(*options)


# ---- allowlists -----------------------------------------------------------------------------


def _allow(quads: DataFrame, column: str, allowed: DataFrame | Iterable[str]) -> DataFrame:
    if isinstance(allowed, DataFrame):
        names = allowed.toDF("__allowed").distinct()
        return quads.join(names, F.col(column) == F.col("__allowed"), "left_semi")
    allowed = list(allowed)
    return quads.where(F.col(column).isin(allowed)) if allowed else quads


def allow_graphs(quads: DataFrame, allowed: DataFrame | Iterable[str]) -> DataFrame:
    """Keep the default graph and the listed named graphs; an empty list allows every graph."""
    if not isinstance(allowed, DataFrame):
        allowed = list(allowed)
        if not allowed:
            return quads
        return quads.where(F.col("g").isNull() | F.col("g").isin(allowed))
    named = _allow(quads.where(F.col("g").isNotNull()), "g", allowed)
    return quads.where(F.col("g").isNull()).unionByName(named)


def allow_path_predicates(quads: DataFrame, allowed: DataFrame | Iterable[str]) -> DataFrame:
    """Keep edges whose predicate may be used in a path; an empty list allows every predicate."""
    return _allow(quads, "p", allowed)
