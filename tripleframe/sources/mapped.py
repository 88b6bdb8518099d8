"""Relational tables as a graph whose constant terms are turned back into conditions on the columns they come from.

A table's key ``3`` is the term ``http://example.org/nation/3``, built per row; a filter on that text reads every row. So
every term of a mapping knows its inverse: the constant's key is parsed once, and the scan gets ``n_nationkey = 3``.
Branches whose predicate or whose kind of entity does not fit the constant are left out of the plan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t

# Spark types of whole numbers and the bytes they take.
_WHOLE = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}
# ``inverse`` of a term: the condition that holds where the term may equal the constant; None where it never does.
Inverse = Callable[[DataFrame, str], Column | None]


@dataclass(frozen=True)
class Term:
    """A term column of a table, and how a constant term becomes a condition on the table's columns.

    The condition may be wider than equality, since the pattern still compares the terms; it must not be narrower.
    """

    column: Column
    inverse: Inverse


def _anything(table: DataFrame, constant: str) -> Column:
    return F.lit(True)


def opaque(column: Column) -> Term:
    """A term without an inverse; the constant is compared with the built term."""
    return Term(column, _anything)


def constant(value: str) -> Term:
    return Term(F.lit(value), lambda table, asked: F.lit(True) if asked == value else None)


def _key_condition(kind: str, key: str, text: str) -> Column | None:
    if kind in _WHOLE:
        # Only the way a whole number is printed can be meant: no sign, no leading zero.
        if not re.fullmatch(r"0|-?[1-9][0-9]*", text):
            return None
        value = int(text)
        bits = 8 * _WHOLE[kind] - 1
        return F.col(key) == F.lit(value).cast(kind) if -(1 << bits) <= value < 1 << bits else None
    if kind == "string":
        return F.col(key) == text
    return F.lit(True)


def entity(kind: str, *keys: str) -> Term:
    """The IRI ``http://example.org/<kind>/<key>[/<key>…]`` of a row."""
    start = V.EX + kind + "/"
    column = F.concat(F.lit(V.EX + kind), *[x for k in keys for x in (F.lit("/"), F.col(k).cast("string"))])

    def inverse(table: DataFrame, asked: str) -> Column | None:
        if not asked.startswith(start):
            return None
        types = dict(table.dtypes)
        rest = asked[len(start) :]
        # A text key may hold the separator itself: alone it takes all of the rest, among others it is not taken apart.
        if len(keys) == 1:
            parts = [rest]
        elif any(types[k] == "string" for k in keys):
            return F.lit(True)
        else:
            parts = rest.split("/")
        if len(parts) != len(keys):
            return None
        found = [_key_condition(types[k], k, x) for k, x in zip(keys, parts, strict=True)]
        return None if any(x is None for x in found) else reduce(lambda a, b: a & b, found)

    return Term(column, inverse)


def text(key: str, lang: str | None = None) -> Term:
    """A plain or language-tagged text column."""
    column = t.lang_term(F.col(key), lang) if lang else t.string_term(F.col(key))
    end = f'"@{lang.lower()}' if lang else '"'

    def inverse(table: DataFrame, asked: str) -> Column | None:
        if len(asked) <= len(end) or not asked.startswith('"') or not asked.endswith(end):
            return None
        return F.col(key) == asked[1 : len(asked) - len(end)]

    return Term(column, inverse)


def _lexical(asked: str, datatype: str) -> str | None:
    end = '"^^' + datatype
    return asked[1 : len(asked) - len(end)] if asked.startswith('"') and asked.endswith(end) and len(asked) > len(end) else None


def integer(key: str) -> Term:
    def inverse(table: DataFrame, asked: str) -> Column | None:
        lexical = _lexical(asked, V.XSD + "integer")
        return None if lexical is None else _key_condition(dict(table.dtypes)[key], key, lexical)

    return Term(t.integer_term(F.col(key)), inverse)


def double(key: str) -> Term:
    """A number as a double; the condition compares numbers, so only one way of writing it is left to the pattern."""

    def inverse(table: DataFrame, asked: str) -> Column | None:
        lexical = _lexical(asked, V.DOUBLE)
        if lexical is None:
            return None
        if not re.fullmatch(r"-?[0-9]+\.[0-9]+(E-?[0-9]+)?", lexical):
            return F.lit(True) if lexical in ("NaN", "Infinity", "-Infinity") else None
        value = float(lexical)
        return F.col(key) == F.lit(value) if dict(table.dtypes)[key] == "double" and math.isfinite(value) else F.lit(True)

    return Term(t.double_term(F.col(key)), inverse)


def moment(key: str) -> Term:
    return opaque(t.datetime_term(F.col(key)))


@dataclass(frozen=True)
class Branch:
    """All rows of a table that have one property."""

    table: DataFrame
    subject: Term
    predicate: str
    object: Term
    graph: Term | None = None

    def rows(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame | None:
        """Quads that may match the constants, or None if none can."""
        if p is not None and p != self.predicate:
            return None
        df = self.table
        for term, asked in ((self.subject, s), (self.object, o), (self.graph, g)):
            if asked is None:
                continue
            condition = None if term is None else term.inverse(self.table, asked)
            if condition is None:
                return None
            df = df.where(condition)
        graph = F.lit(None).cast("string") if self.graph is None else self.graph.column
        quads = df.select(
            graph.alias("g"), self.subject.column.alias("s"), F.lit(self.predicate).alias("p"), self.object.column.alias("o")
        )
        return quads.where(F.col("o").isNotNull())


class MappedGraph:
    """Tables read as quads. Patterns ask for :meth:`narrowed` rows; everything else may use :attr:`quads`."""

    def __init__(self, branches: Iterable[Branch], others: Iterable[DataFrame] = ()) -> None:
        self.branches = list(branches)
        self.others = list(others)

    @property
    def quads(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [*[b.rows() for b in self.branches], *self.others])

    @property
    def sparkSession(self):  # noqa: N802 - the name a DataFrame has
        return (self.branches[0].table if self.branches else self.others[0]).sparkSession

    def narrowed(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
        """Quads among which all matches of the constants are; the caller still compares."""
        found = [x for x in (b.rows(s, p, o, g) for b in self.branches) if x is not None]
        found += self.others
        return reduce(DataFrame.unionByName, found) if found else self.branches[0].rows().limit(0)

    def unionByName(self, other: MappedGraph | DataFrame) -> MappedGraph:  # noqa: N802
        if isinstance(other, DataFrame):
            return MappedGraph(self.branches, [*self.others, other])
        return MappedGraph([*self.branches, *other.branches], [*self.others, *other.others])

    def where(self, condition: Column) -> DataFrame:
        return self.quads.where(condition)


def branches(table: DataFrame, subject: Term, properties: dict[str, Term], graph: Term | None = None) -> list[Branch]:
    return [Branch(table, subject, p, o, graph) for p, o in properties.items()]
