"""Solutions of a graph pattern: a DataFrame with one term column per variable.

``Bindings`` also knows which variables are *certain* (bound in every row). That decides whether a
join can be a plain equi-join or has to treat an unbound variable as compatible with any value. The
one-condition form of the latter would run as a nested loop over all pairs. Instead every row is tagged with a mask of its
unbound shared variables, and copied for each mask the other side may have; rows then meet in one equi-join on the pair of
masks and the variables that are bound on both sides. Each side is read once, with 2**k copies of its rows for k variables that
may be unbound on the other side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleframe.functions import terms as t

LEFT, RIGHT = "__left_", "__right_"
Condition = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def left_col(name: str) -> Column:
    return F.col(f"`{name}`")


def right_col(name: str) -> Column:
    return F.col(f"`{RIGHT}{name}`")


def _mask(names: list[str]) -> Column:
    """One bit for each variable that is unbound in the row."""
    bits = [F.when(left_col(n).isNull(), 1 << i).otherwise(0) for i, n in enumerate(names)]
    return reduce(lambda a, b: a + b, bits, F.lit(0))


# Internal columns: mask of the row, mask of the other side it is copied for, keys, number of the row.
_OWN, _FACING, _KEY, _ROW, _HIT = "__own", "__facing", "__key", "__row", "__hit"


class Bindings:
    def __init__(self, df: DataFrame, certain: Iterable[str] | None = None):
        self.df = df
        self.certain = frozenset(df.columns if certain is None else certain)

    @property
    def variables(self) -> list[str]:
        """Visible variables in the order they were first mentioned."""
        return self.df.columns

    def col(self, name: str) -> Column:
        return self.df[name]

    # ---- shape ------------------------------------------------------------------------------

    def project(self, *items: str | tuple[str, Column]) -> Bindings:
        """Keep variables and ``(alias, expression)`` pairs; aliases must be new."""
        names = [i if isinstance(i, str) else i[0] for i in items]
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate projection: {names}")
        clash = [i[0] for i in items if not isinstance(i, str) and i[0] in self.variables]
        if clash:
            raise ValueError(f"alias already in scope: {clash}")
        cols = [left_col(i) if isinstance(i, str) else i[1].alias(i[0]) for i in items]
        return Bindings(self.df.select(*cols), self.certain & set(names))

    def bind(self, name: str, expression: Column, certain: bool = False) -> Bindings:
        """Add a computed variable. An evaluation error leaves it unbound."""
        if name in self.variables:
            raise ValueError(f"variable already bound: {name}")
        kept = self.certain | {name} if certain else self.certain
        return Bindings(self.df.withColumn(name, expression), kept)

    def filter(self, condition: Column) -> Bindings:
        return Bindings(self.df.where(condition), self.certain)

    def distinct(self) -> Bindings:
        return Bindings(self.df.distinct(), self.certain)

    reduced = distinct

    def union(self, *others: Bindings) -> Bindings:
        """Bag union; a variable missing in a branch is unbound there."""
        df, certain = self.df, self.certain
        for o in others:
            df = df.unionByName(o.df, allowMissingColumns=True)
            certain = certain & o.certain
        return Bindings(df, certain)

    # ---- joins ------------------------------------------------------------------------------

    def _shared(self, other: Bindings) -> tuple[list[str], list[str], list[str]]:
        """Shared variables, and those that may be unbound on the left and on the right."""
        shared = [v for v in self.variables if v in other.variables]
        return (
            shared,
            [v for v in shared if v not in self.certain],
            [v for v in shared if v not in other.certain],
        )

    def _merged(self, joined: DataFrame, other: Bindings) -> DataFrame:
        cols = [
            F.coalesce(left_col(v), right_col(v)).alias(v)
            if v in other.variables and v not in self.certain
            else left_col(v)
            for v in self.variables
        ]
        new = [right_col(v).alias(v) for v in other.variables if v not in self.variables]
        return joined.select(*cols, *new)

    def _renamed(self) -> DataFrame:
        return self.df.toDF(*[RIGHT + v for v in self.variables])

    @staticmethod
    def _on(keys: list[str], condition: Condition | None) -> Column | None:
        parts = [left_col(k) == right_col(k) for k in keys]
        if condition is not None:
            parts.append(condition(left_col, right_col))
        return reduce(lambda a, b: a & b, parts) if parts else None

    def _facing(self, shared: list[str], own: list[str], other: list[str]) -> DataFrame:
        """Rows copied for every mask of ``other`` that the other side may have, with the key they meet on.

        A variable that is unbound on either side is left out of the key by both, since both know the two masks.
        """
        masks = F.explode(F.array(*[F.lit(i) for i in range(1 << len(other))]))
        df = self.df.withColumn(_OWN, _mask(own)).withColumn(_FACING, masks)
        keys = {}
        for i, v in enumerate(shared):
            free = F.lit(False)
            for names, mask in ((own, _OWN), (other, _FACING)):
                if v in names:
                    free = free | (F.col(mask).bitwiseAND(1 << names.index(v)) != 0)
            keys[f"{_KEY}{i}"] = F.when(free, F.lit("")).otherwise(left_col(v))
        return df.withColumns(keys)

    def _met(self, other: Bindings, condition: Condition | None, how: str, numbered: bool = False) -> DataFrame:
        """One equi-join of the tagged sides; ``_HIT`` marks rows that met a row on the right.

        Without variables that may be unbound this is the plain join on the shared variables.
        """
        shared, maybe_l, maybe_r = self._shared(other)
        left = Bindings(self.df.withColumn(_ROW, F.monotonically_increasing_id())) if numbered else self
        right = other._renamed().withColumn(_HIT, F.lit(True))
        if not maybe_l and not maybe_r:
            on = self._on(shared, condition)
            return left.df.join(right, F.lit(True) if on is None else on, how)
        tagged = other._facing(shared, maybe_r, maybe_l)
        right = tagged.toDF(*[RIGHT + v for v in tagged.columns]).withColumn(_HIT, F.lit(True))
        pairs = [(_OWN, _FACING), (_FACING, _OWN), *[(f"{_KEY}{i}", f"{_KEY}{i}") for i in range(len(shared))]]
        on = reduce(lambda a, b: a & b, [F.col(a) == F.col(RIGHT + b) for a, b in pairs])
        on = on if condition is None else on & condition(left_col, right_col)
        return left._facing(shared, maybe_l, maybe_r).join(right, on, how)

    def join(self, other: Bindings) -> Bindings:
        """Join on shared variables; unbound is compatible with anything. No shared: product."""
        certain = self.certain | other.certain
        if not self._shared(other)[0]:
            return Bindings(self._merged(self.df.crossJoin(other._renamed()), other), certain)
        return Bindings(self._merged(self._met(other, None, "inner"), other), certain)

    def join_equal(self, other: Bindings, *pairs: tuple[str, str]) -> Bindings:
        """Join on the shared variables and on value equality of each ``(left, right)`` pair of variables.

        What a filter ``?x = ?y`` above a join says, but the values' keys are part of the equi-join, so rows meet
        only where the values can be equal. Rows with an unbound side are removed, as the filter's error would.
        """
        names = [f"{_KEY}value{i}" for i in range(len(pairs))]

        def keyed(side: Bindings, columns: list[str]) -> Bindings:
            # Bound once: the optimiser may put a computed variable's expression in place of its name. An unbound
            # value has no key and meets nothing.
            keys = {n: F.transform(F.array(left_col(v)), t.value_key)[0] for n, v in zip(names, columns, strict=True)}
            return Bindings(side.df.withColumns(keys), side.certain | {*names, *columns})

        joined = keyed(self, [x for x, _ in pairs]).join(keyed(other, [y for _, y in pairs]))
        for x, y in pairs:
            joined = joined.filter(t.eq(left_col(x), left_col(y)))
        return joined.project(*[v for v in joined.variables if v not in names])

    def optional(self, other: Bindings, condition: Condition | None = None) -> Bindings:
        """Left join. ``condition(l, r)`` is a filter written inside the optional part."""
        copied = bool(self._shared(other)[2])
        met = self._met(other, condition, "left", numbered=copied)
        if copied:
            # A row was copied for each mask of the right; if no copy met anything, the first stands for the row.
            hits = F.count(_HIT).over(Window.partitionBy(_ROW))
            met = met.withColumn(_HIT, F.col(_HIT).isNotNull() | ((hits == 0) & (F.col(_FACING) == 0))).where(_HIT)
        return Bindings(self._merged(met, other), self.certain)

    def _flagged(self, other: Bindings, condition: Condition | None, need_shared: bool = False) -> DataFrame:
        """The rows with ``_HIT``: whether any compatible row is on the right. Each side is read once.

        The right is reduced to its distinct shared variables where no condition reads more of it.
        """
        shared, maybe_l, maybe_r = self._shared(other)
        right = other if condition is not None else Bindings(other.df.select(*shared).distinct(), other.certain)
        met = self._met(right, condition, "left", numbered=True)
        hit = F.col(_HIT).isNotNull()
        if need_shared and (maybe_l or maybe_r):
            both = [left_col(v).isNotNull() & right_col(v).isNotNull() for v in shared]
            hit = hit & reduce(lambda a, b: a | b, both)
        kept = [F.first(left_col(v)).alias(v) for v in self.variables]
        return met.groupBy(_ROW).agg(*kept, F.max(hit).alias(_HIT))

    def minus(self, other: Bindings) -> Bindings:
        """Drop rows with a compatible row on the right that shares a bound variable."""
        shared, maybe_l, maybe_r = self._shared(other)
        if not shared:
            return self
        if not maybe_l and not maybe_r:
            return self.not_exists(other)
        flagged = self._flagged(other, None, need_shared=True)
        return Bindings(flagged.where(~F.col(_HIT)).select(*self.variables), self.certain)

    def _tested(self, other: Bindings, condition: Condition | None, how: str) -> Bindings:
        if self._shared(other)[2]:
            hit = F.col(_HIT) if how == "left_semi" else ~F.col(_HIT)
            return Bindings(self._flagged(other, condition).where(hit).select(*self.variables), self.certain)
        return Bindings(self._met(other, condition, how).select(*self.variables), self.certain)

    def not_exists(self, other: Bindings, condition: Condition | None = None) -> Bindings:
        """Drop rows with a compatible row on the right; ``condition`` may read both sides."""
        return self._tested(other, condition, "left_anti")

    def exists(self, other: Bindings, condition: Condition | None = None) -> Bindings:
        """Keep rows with a compatible row on the right, each once."""
        return self._tested(other, condition, "left_semi")

    def filter_exists(
        self,
        other: Bindings,
        test: Callable[[Column], Column],
        condition: Condition | None = None,
    ) -> Bindings:
        """Filter with EXISTS as part of a larger condition: ``test(exists)`` gets the flag.

        Where shared variables may be unbound the flag comes from one join of the tagged sides. Otherwise it is a
        subquery; its outer columns are read through copies with names that cannot occur inside, since a subquery prefers its own
        columns when names agree.
        """
        shared, maybe_l, maybe_r = self._shared(other)
        if maybe_l or maybe_r:
            return Bindings(self._flagged(other, condition).where(test(F.col(_HIT))).select(*self.variables), self.certain)

        def outer(name: str) -> Column:
            return F.col(f"`{LEFT}{name}`").outer()

        parts = [right_col(k) == outer(k) for k in shared]
        if condition is not None:
            parts.append(condition(outer, right_col))
        inner = other._renamed()
        if parts:
            inner = inner.where(reduce(lambda a, b: a & b, parts))
        copies = {LEFT + v: left_col(v) for v in self.variables}
        kept = self.df.withColumns(copies).where(test(inner.exists())).select(*self.variables)
        return Bindings(kept, self.certain)


def values(spark: SparkSession, variables: list[str], rows: list[tuple]) -> Bindings:
    """Inline table of term texts; ``None`` is UNDEF. Small by nature: it is typed by hand."""
    bad = [r for r in rows if len(r) != len(variables)]
    if bad:
        raise ValueError(f"rows must have {len(variables)} cells: {bad[0]}")
    schema = T.StructType([T.StructField(v, T.StringType()) for v in variables])
    undefined = {v for i, v in enumerate(variables) if any(r[i] is None for r in rows)}
    return Bindings(spark.createDataFrame(rows, schema), set(variables) - undefined)
