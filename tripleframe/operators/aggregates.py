"""Aggregates over term columns, as Spark aggregate expressions.

``sum_term`` and ``avg_term`` return typed terms and are exact for integers and decimals; ``sum_`` and ``avg`` return
native doubles for results that are only read.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.operators.bindings import Bindings


def count_rows() -> Column:
    return F.count(F.lit(1))


def count(k: Column) -> Column:
    return F.count(k)


def count_distinct(k: Column) -> Column:
    return F.count_distinct(k)


def count_distinct_rows(bindings: Bindings, exclude: Iterable[str] = ()) -> Column:
    """Distinct solutions. A struct keeps rows in which some variables are unbound."""
    return F.count_distinct(F.struct(*[c for c in bindings.variables if c not in set(exclude)]))


def sum_(k: Column) -> Column:
    return F.coalesce(F.sum(t.num(k)), F.lit(0.0))


def avg(k: Column) -> Column:
    return F.coalesce(F.avg(t.num(k)), F.lit(0.0))


def _exact_sum(k: Column) -> Column:
    """Sum of the integers and decimals as a decimal term: whole parts and 28 digits after the point are added apart.

    A whole part, or a sum of them, of more than 38 digits is an error that ends the query, and so are more than 28 digits
    after the point; no number is left out.
    """
    def split(p: Column) -> Column:
        # Upper and lower digits are added apart, so that the sum of long numbers does not overflow on the way.
        digits = F.lpad(p["whole"], F.lit(38), F.lit("0"))
        fits = F.length(p["whole"]) <= 38
        sign = F.when(p["minus"], F.lit(-1)).otherwise(1).cast("decimal(1,0)")
        upper, lower = (sign * F.substring(digits, at, 19).cast("decimal(19,0)") for at in (1, 20))
        long = F.raise_error(F.lit("a decimal has more than 28 digits after the point")).cast("decimal(28,28)")
        part = F.when(F.length(p["part"]) > 28, long).otherwise(sign * F.concat(F.lit("0."), p["part"], F.lit("0")).try_cast("decimal(28,28)"))
        whole = F.when(fits, F.struct(upper.alias("upper"), lower.alias("lower"), part.alias("part")))
        return F.when(p.isNotNull(), F.coalesce(whole, t.too_wide().cast("struct<upper:decimal(21,0),lower:decimal(21,0),part:decimal(30,28)>")))

    # Taken apart once for each row, not once for each use.
    x = F.transform(F.array(t.exact_parts(k)), split)[0]
    upper, lower = (F.sum(x[name]).cast("decimal(38,0)") for name in ("upper", "lower"))
    part = F.sum(x["part"])
    joined = F.try_add(F.try_multiply(upper, F.lit(Decimal(10**19))), lower)
    whole = F.when(upper.isNotNull(), F.coalesce(joined, t.too_wide().cast("decimal(38,0)")))
    none = F.lit(t.literal_key("0.0", datatype=V.DECIMAL))
    whole_term = F.coalesce(t.decimal_term(whole), none)
    return t.add(whole_term, F.coalesce(t.decimal_term(part.cast("decimal(38,28)")), none))


def _typed(k: Column, exact: Column, real: Column) -> Column:
    """``real`` if any floating number is among the terms, else ``exact``."""
    rank = F.max(t.numeric_rank(k))
    return F.when(rank == 4, t.double_term(real)).when(rank == 3, t.typed_term(real.cast("float"), V.FLOAT)).otherwise(exact)


def sum_term(k: Column) -> Column:
    """Typed sum: an integer of integers, a decimal of decimals, else a float or double; 0 without numbers."""
    total = _exact_sum(k)
    whole = F.coalesce(F.max(t.numeric_rank(k)), F.lit(1)) == 1
    integer = t.wide_integer_term(F.substring_index(t.lexical(total), ".", 1))
    return _typed(k, F.when(whole, integer).otherwise(total), F.sum(t.num(k)))


def avg_term(k: Column) -> Column:
    """Typed mean: a decimal of exact numbers, else a float or double; 0 without numbers."""
    n = F.count(t.num(k))
    mean = t.divide(_exact_sum(k), t.integer_term(n))
    return _typed(k, F.when(n == 0, t.literal(0)).otherwise(mean), F.avg(t.num(k)))


def _unsorted(extreme: Column) -> Column:
    """``extreme`` beside an object aggregate that is always empty.

    Spark sorts all rows of a task before an aggregate that holds texts, unless an object aggregate stands beside it: then
    a task keeps one value for each group and sorts only from the 129th group on.
    """
    return F.when(F.size(F.collect_set(F.lit(None).cast("string"))) == 0, extreme)


def min_(k: Column) -> Column:
    """The smallest term by value; numbers compare as numbers."""
    return _unsorted(F.min_by(k, F.when(k.isNotNull(), t.order_key(k))))


def max_(k: Column) -> Column:
    return _unsorted(F.max_by(k, F.when(k.isNotNull(), t.order_key(k))))


def sample(k: Column) -> Column:
    """Any bound value; the smallest text, so that repeated runs agree."""
    return F.min(k)


def group_concat(k: Column, separator: str = " ", distinct: bool = False) -> Column:
    """Texts joined in text order, so that repeated runs agree. NULLs leave no trace.

    A group becomes one value, so it has to fit one task: deduplicate first with
    :meth:`Bindings.distinct` when a group may repeat the same texts very often.
    """
    gather = F.collect_set if distinct else F.collect_list
    texts = F.array_sort(gather(t.text(k)))
    return F.when(F.size(texts) > 0, F.array_join(texts, separator)).otherwise(F.lit(""))


def concat_groups(
    bindings: Bindings, by: list[str], name: str, variable: str, separator: str = " ", distinct: bool = False
) -> Bindings:
    """GROUP_CONCAT of groups of any size: the same value as :func:`group_concat`, one row for each group.

    Texts are ranged by group and text, so a large group spreads over many ranges. The texts of a group in one range
    become one piece, and the pieces of a group are joined in order at the end: no task holds a group's list,
    only the value itself.
    """
    texts = bindings.df.select(*by, t.text(F.col(f"`{variable}`")).alias("__text"))
    groups = texts.select(*by).distinct()
    texts = texts.where(F.col("__text").isNotNull())
    texts = texts.distinct() if distinct else texts
    ranged = texts.repartitionByRange(*by, "__text").withColumn("__range", F.spark_partition_id())
    pieces = ranged.groupBy(*by, "__range").agg(F.array_join(F.array_sort(F.collect_list("__text")), separator).alias("__piece"))
    ordered = F.array_sort(F.collect_list(F.struct("__range", "__piece")))
    joined = pieces.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["__piece"]), separator).alias(name))
    on = reduce(lambda a, b: a & b, [groups[v].eqNullSafe(joined[v]) for v in by])
    out = groups.join(joined, on, "left").select(*[groups[v] for v in by], F.coalesce(name, F.lit("")).alias(name))
    return Bindings(out, (bindings.certain & set(by)) | {name})


def group(
    bindings: Bindings,
    by: list[str | tuple[str, Column]],
    aggs: dict[str, Column],
    having: list[Column] | None = None,
) -> Bindings:
    """GROUP BY variables or named expressions. Without keys there is always exactly one row.

    ``having`` conditions read the keys and the aggregate names and must all hold.
    """
    keys = [F.col(b) if isinstance(b, str) else b[1].alias(b[0]) for b in by]
    names = [b if isinstance(b, str) else b[0] for b in by]
    cols = [c.alias(n) for n, c in aggs.items()]
    df = bindings.df.groupBy(*keys).agg(*cols) if keys else bindings.df.agg(*cols)
    if having:
        df = df.where(reduce(lambda a, b: a & b, having))
    sure = [n for n in names if n in bindings.certain]
    return Bindings(df, sure)


def group_distinct(
    bindings: Bindings, by: list[str], variable: str, aggs: dict[str, Column]
) -> Bindings:
    """Aggregates over DISTINCT terms of ``variable``.

    Distinct is over terms, so ``1`` and ``1.0`` both count; a distinct sum of the numbers would
    merge them. Duplicates are removed before the grouping shuffle, which also spreads a hot group.
    """
    terms_once = Bindings(bindings.df.select(*by, variable).distinct(), bindings.certain)
    return group(terms_once, list(by), aggs)


def top_per_group(
    bindings: Bindings, by: list[str], variable: str, descending: bool = True, ties: bool = True
) -> Bindings:
    """Rows holding the extreme value of ``variable`` in their group, ties included.

    Aggregate and join back instead of a window: the aggregate combines before the shuffle, so a
    hot group is never sorted in one task.
    """
    best = "max_by" if descending else "min_by"
    value = t.num(F.col(variable))
    if ties:
        agg = F.max(value) if descending else F.min(value)
        extreme = bindings.df.groupBy(*by).agg(agg.alias("__best"))
        joined = bindings.df.join(extreme, by).where(value == F.col("__best"))
        return Bindings(joined.select(*bindings.variables), bindings.certain)
    row = F.struct(*bindings.variables)
    tie = F.to_json(row)
    picked = bindings.df.groupBy(*by).agg(getattr(F, best)(row, F.struct(value, tie)).alias("__r"))
    return Bindings(picked.select("__r.*").select(*bindings.variables), bindings.certain)
