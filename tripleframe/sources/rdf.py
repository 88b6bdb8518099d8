"""N-Triples and N-Quads in and out of ``quads(g, s, p, o)`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t

# The statement grammar of the two line formats.
_NODE = r"<[^>\s]*>|_:[^\s<>\"]+"
# Possessive loops: the regex engine runs them without recursion, whatever the length of the text.
_LITERAL = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>\s]*>)?'
_SUFFIX = r"(@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>\s]*>)?"
STATEMENT = (
    rf"^\s*({_NODE})\s*<([^>\s]*)>\s*((?:{_NODE}|{_LITERAL})\s*(?:{_NODE})?)\s*\.\s*(?:#.*)?$"
)


def unescape(c: Column) -> Column:
    """Resolve string escapes. Only values with a backslash pay for it."""
    long_form = F.regexp_replace(
        c, r"(?<!\\)((?:\\\\)*)\\U0000([0-9A-Fa-f]{4})", r"$1\\u$2"
    )
    codes = F.array_distinct(
        F.regexp_extract_all(long_form, F.lit(r"\\U([0-9A-Fa-f]{8})"), F.lit(1))
    )
    astral = F.aggregate(
        codes,
        long_form,
        lambda acc, code: F.replace(
            acc, F.concat(F.lit("\\U"), code), F.decode(F.unhex(code), "UTF-32")
        ),
    )
    parsed = F.from_json(
        F.concat(F.lit('["'), astral, F.lit('"]')),
        "array<string>",
        {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"},
    )[0]
    return F.when(c.contains("\\"), parsed).otherwise(c)


def _node(c: Column) -> Column:
    return F.when(c.startswith("<"), unescape(c.substr(F.lit(2), F.length(c) - F.lit(2)))).otherwise(c)


def _object(rest: Column) -> Column:
    tail = F.substring_index(rest, '"', -1)
    body = rest.substr(F.lit(2), F.length(rest) - F.length(tail) - F.lit(2))
    given = F.regexp_extract(tail, rf"^{_SUFFIX}", 1)
    datatype = given.substr(F.lit(4), F.length(given) - F.lit(4))
    suffix = (
        F.when(given.startswith("@"), F.lower(given))
        .when((given == "") | (datatype == V.XSD + "string"), F.lit(""))
        .otherwise(F.concat(F.lit("^^"), datatype))
    )
    literal = F.concat(F.lit('"'), unescape(body), F.lit('"'), suffix)
    return F.when(rest.startswith('"'), literal).otherwise(
        _node(F.regexp_extract(rest, rf"^({_NODE})", 1))
    )


def _graph(rest: Column) -> Column:
    after_literal = F.regexp_extract(
        F.substring_index(rest, '"', -1), rf"^{_SUFFIX}\s*({_NODE})?$", 2
    )
    after_node = F.regexp_extract(rest, rf"^(?:{_NODE})\s*({_NODE})?$", 1)
    name = F.when(rest.startswith('"'), after_literal).otherwise(after_node)
    return F.when(name != "", _node(name))


def parse_statements(lines: DataFrame, column: str = "value") -> DataFrame:
    """Statement lines to ``(g, s, p, o, line)``; ``s`` is NULL for a line that does not parse.

    Long texts are matched as a whole once. Subject and predicate are read from the front of the
    line, language, datatype and graph from the short end behind the text.
    """
    raw = lines.where(~F.rlike(F.col(column), F.lit(r"^\s*(#.*)?$"))).select(
        F.col(column).alias("line"), F.regexp_extract(column, STATEMENT, 3).alias("rest")
    )
    ok, rest = F.col("rest") != "", F.col("rest")
    return raw.select(
        F.when(ok, _graph(rest)).alias("g"),
        F.when(ok, _node(F.regexp_extract("line", rf"^\s*({_NODE})", 1))).alias("s"),
        F.when(ok, unescape(F.regexp_extract("line", rf"^\s*(?:{_NODE})\s*<([^>\s]*)>", 1))).alias("p"),
        F.when(ok, _object(rest)).alias("o"),
        "line",
    )


def read_quads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read ``.nt`` or ``.nq`` files; returns ``(quads, rejected lines)``."""
    parsed = parse_statements(spark.read.text(path))
    good = parsed.where(F.col("s").isNotNull()).select("g", "s", "p", "o")
    return good, parsed.where(F.col("s").isNull()).select("line")


def _escaped(c: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def statement_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line per row, or N-Quads when there is a ``g`` column."""

    def node(c: Column) -> Column:
        return F.when(t.is_blank(c), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    def value(c: Column) -> Column:
        tail = F.substring_index(c, '"', -1)
        suffix = F.when(
            tail.startswith("^^"), F.concat(F.lit("^^<"), tail.substr(F.lit(3), F.length(tail)), F.lit(">"))
        ).otherwise(tail)
        text = F.concat(F.lit('"'), _escaped(t.lexical(c)), F.lit('"'), suffix)
        return F.when(t.is_literal(c), text).otherwise(node(c))

    parts = [node(F.col("s")), node(F.col("p")), value(F.col("o"))]
    if "g" in triples.columns:
        parts.append(node(F.col("g")))
    return triples.select(F.concat_ws(" ", *parts, F.lit(".")).alias("value"))


def write_statements(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    statement_lines(triples).write.mode(mode).text(path)


def write_quads(quads: DataFrame, path: str, by_predicate: bool = True, mode: str = "errorifexists") -> None:
    """Parquet laid out for pattern scans.

    Few predicates: one folder each, so a constant predicate prunes folders. Many: files ranged by
    ``(p, s)``, so row-group statistics prune. Both sort by subject for compression and skipping, and
    ranging by ``(p, s)`` splits a predicate that holds most of the data over many tasks.
    """
    ranged = quads.repartitionByRange("p", "s").sortWithinPartitions("p", "s")
    writer = ranged.write.mode(mode)
    (writer.partitionBy("p") if by_predicate else writer).parquet(path)
