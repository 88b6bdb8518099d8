"""Query forms, ordering, limits and result caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleframe.functions import terms as t
from tripleframe.operators.bindings import Bindings

# Row caps of interactive queries.
DEFAULT_ROWS = 100
MAX_ROWS = 1000


def order_by(bindings: Bindings, *clauses: str | Column | tuple[str | Column, str]) -> Bindings:
    """Sort by term order. A clause is a variable or term column, or ``(clause, "desc")``."""
    keys = []
    for clause in clauses:
        what, direction = clause if isinstance(clause, tuple) else (clause, "asc")
        column = bindings.df[what] if isinstance(what, str) else what
        key = t.order_key(column)
        keys.append(key.desc() if direction == "desc" else key.asc())
    return Bindings(bindings.df.orderBy(*keys), bindings.certain)


def slice_rows(bindings: Bindings, limit: int | None = None, offset: int = 0) -> Bindings:
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("limit and offset must not be negative")
    df = bindings.df.offset(offset) if offset else bindings.df
    return Bindings(df if limit is None else df.limit(limit), bindings.certain)


def select(
    bindings: Bindings,
    *items: str | tuple[str, Column],
    distinct: bool = False,
    order: list | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> Bindings:
    """SELECT: sort (also by variables that are not projected), project, deduplicate, slice."""
    if order and not distinct:
        bindings = order_by(bindings, *order)
    out = bindings.project(*items) if items else bindings
    if distinct:
        out = out.distinct()
        out = order_by(out, *order) if order else out
    return slice_rows(out, limit, offset)


def ask(bindings: Bindings) -> DataFrame:
    """One boolean row; reading stops at the first solution."""
    return bindings.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def construct(
    bindings: Bindings,
    template: list[tuple],
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Instantiate triples per solution; ``limit`` and ``offset`` count solutions.

    Slots are variable names (``?x``), constant IRIs or term columns. Triples with an unbound or
    illegal slot are skipped, and the result is a set.
    """

    def slot(x):
        if isinstance(x, Column):
            return x
        return F.col(x[1:]) if x.startswith("?") else F.lit(x)

    rows = slice_rows(bindings, limit, offset).df
    triples = F.array(
        *[
            F.struct(slot(s).alias("s"), slot(p).alias("p"), slot(o).alias("o"))
            for s, p, o in template
        ]
    )
    out = rows.select(F.explode(triples).alias("x")).select("x.*")
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    legal = ~t.is_literal(s) & t.is_iri(p) & o.isNotNull()
    return out.where(legal).distinct()


def typed_results(bindings: Bindings) -> DataFrame:
    """Every variable as ``struct(type, value, datatype, lang)``; unbound stays NULL."""
    return bindings.df.select(
        *[t.binding_struct(F.col(f"`{v}`")).alias(v) for v in bindings.variables]
    )


def row_cap(
    requested: int | None = None, default: int = DEFAULT_ROWS, maximum: int = MAX_ROWS
) -> int:
    return min(requested or default, maximum)


def capped(
    df: DataFrame, requested: int | None = None, default: int = DEFAULT_ROWS, maximum: int = MAX_ROWS
) -> DataFrame:
    """At most the permitted number of rows. For interactive use; batch jobs stay uncapped."""
    return df.limit(row_cap(requested, default, maximum))


def truncated(df: DataFrame, max_rows: int) -> DataFrame:
    """The first ``max_rows`` rows and whether there were more, by reading a single row extra."""
    window = Window.partitionBy(F.lit(0))
    head = df.limit(max_rows + 1).withColumn("truncated", F.count(F.lit(1)).over(window) > max_rows)
    return head.limit(max_rows)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The best ``k`` rows per key with a 0-based rank.

    ``row_number() <= k`` lets Spark drop losers in each task before the shuffle, so a hot key sends
    at most ``k`` rows per task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= k)
    return numbered.withColumn(rank, F.col("__n") - 1).drop("__n")
