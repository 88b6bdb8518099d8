"""Similarity joins that return every qualifying pair from filtered candidates."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleframe.functions import text as tx
from tripleframe.session import broadcast_if_small, stored, use_all_cores

# ---- containment ----------------------------------------------------------------------------


ANCHOR = 5


def contained_pairs(
    texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str, min_length: int = 1
) -> DataFrame:
    """All ``(key, needle)`` with the needle a substring of the text.

    A needle inside a text brings each of its five-character grams along, so one gram per needle,
    the rarest among all needles, is enough to meet on. Shorter needles are their own gram. Texts
    are expanded to grams without carrying the text; it is fetched again only for candidates.
    """
    wanted = needles.select(F.col(needle).alias("__needle")).where(
        F.length("__needle") >= min_length
    ).distinct()
    long = wanted.where(F.length("__needle") > ANCHOR).withColumn(
        "__gram", F.explode(tx.grams(F.col("__needle"), ANCHOR))
    )
    common = long.groupBy("__gram").agg(F.count(F.lit(1)).alias("__df"))
    anchors = (
        long.join(common, "__gram")
        .groupBy("__needle")
        .agg(F.min(F.struct("__df", "__gram")).alias("__a"))
        .select("__needle", F.col("__a.__gram").alias("__gram"))
    )
    short = wanted.where(F.length("__needle") <= ANCHOR)
    anchors = anchors.unionByName(short.withColumn("__gram", F.col("__needle")))
    sizes = list(range(max(min_length, 1), ANCHOR + 1))
    body = F.col(text)
    if key != text:
        texts = use_all_cores(texts, key)
        # Long texts make very many grams; with few needles they need not be shuffled at all, and lengths that no
        # needle meets on are not cut.
        anchors = broadcast_if_small(anchors)
        used = {r["n"] for r in anchors.select(F.length("__gram").alias("n")).distinct().collect()}
        sizes = [n for n in sizes if n in used] or [ANCHOR]
    expanded = texts.select(
        F.col(key).alias("__key"), F.explode(F.concat(*[tx.grams(body, n) for n in sizes])).alias("__gram")
    )
    met = expanded.join(anchors, "__gram").select("__key", "__needle")
    if key == text:
        hits = met.where(F.contains(F.col("__key"), F.col("__needle")))
    else:
        source = texts.select(F.col(key).alias("__key"), body.alias("__text"))
        # A short needle is the shared gram itself, so nothing is left to verify.
        sure = met.where(F.length("__needle") <= ANCHOR)
        hits = (
            met.where(F.length("__needle") > ANCHOR)
            .join(source, "__key")
            .where(F.contains(F.col("__text"), F.col("__needle")))
            .select("__key", "__needle")
            .unionByName(sure)
        )
    return hits.select(F.col("__key").alias(key), F.col("__needle").alias(needle))


# ---- matching-block ratio -------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks over the total length; argument order matters."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


# Rare letters first. Any order gives the same pairs; this one gives fewer candidates.
_RARE_FIRST = "0123456789zqxjkvbpygfwmucldrhsnioate "


def _character_tokens(c: Column) -> Column:
    """Characters with their occurrence number, as sortable texts: third ``a`` is not first ``a``."""
    coded = F.translate(c, _RARE_FIRST, "".join(chr(0x4E00 + i) for i in range(len(_RARE_FIRST))))
    chars = F.split(coded, "")
    numbered = F.transform(
        F.array_distinct(chars),
        lambda ch: F.transform(
            F.sequence(F.lit(1), F.size(F.filter(chars, lambda x: x == ch))),
            lambda i: F.concat(F.lpad((F.lit(9_999_999_999) - i).cast("string"), 10, "0"), ch),
        ),
    )
    return F.array_sort(F.flatten(numbered))


_EPS = 1e-9


def _prepared(df: DataFrame, side: str, ratio: Column) -> DataFrame:
    """Adds the characters of ``<side>_t`` and those of them that a pair of at least ``ratio`` has to share one of."""
    n = F.length(f"{side}_t")
    least = F.ceil(n * (ratio / (2 - ratio)) - _EPS)
    need = F.ceil((n + least) * (ratio / 2) - _EPS)
    keep = F.greatest((n - need + 1).cast("int"), F.lit(1))
    with_all = df.withColumns({f"{side}_n": n, f"{side}_all": _character_tokens(F.col(f"{side}_t"))})
    return with_all.withColumn(f"{side}_pre", F.slice(f"{side}_all", F.lit(1), keep))


def _ratio_candidates(left: DataFrame, right: DataFrame, level: float) -> DataFrame:
    """Pairs whose bound lies in ``[lower, covered)``: ``left(a_t, lower, covered)`` with ``lower >= level`` by ``right(b_t)``.

    The ratio cannot exceed twice the shared characters over the total length. So a qualifying pair
    has similar lengths and shares enough characters that the rarest ones of both sides must meet
    (prefix filtering). Pairs meet on such a character plus a length class, once each, then pass the bound.
    """
    spread = level / (2 - level)
    a, b = _prepared(left, "a", F.col("lower")), _prepared(right, "b", F.lit(level))

    def length_class(n: Column) -> Column:
        return F.floor(F.log2(n)).cast("int")

    a = a.withColumn("band", length_class(F.col("a_n"))).withColumn("token", F.explode("a_pre"))
    low = F.greatest(F.ceil(F.col("b_n") * spread - _EPS), F.lit(1))
    high = F.floor(F.col("b_n") / spread + _EPS)
    b = b.withColumn("band", F.explode(F.sequence(length_class(low), length_class(high))))
    b = b.withColumn("token", F.explode("b_pre"))
    first_shared = F.element_at(F.array_intersect("a_pre", "b_pre"), 1)
    bound = 2.0 * F.size(F.array_intersect("a_all", "b_all")) / (F.col("a_n") + F.col("b_n"))
    met = a.join(b, ["token", "band"]).where(F.col("token") == first_shared).withColumn("bound", bound)
    return met.where((F.col("bound") >= F.col("lower") - _EPS) & (F.col("bound") < F.col("covered") - _EPS)).select("a_t", "b_t", "bound")


def _texts(df: DataFrame, name: str, side: str) -> DataFrame:
    return df.select(F.col(name).alias(f"{side}_t")).where(F.length(f"{side}_t") > 0).distinct()


def ratio_pairs(
    left: DataFrame, left_col: str, right: DataFrame, right_col: str, min_ratio: float
) -> DataFrame:
    """All pairs of texts whose :func:`matching_ratio` is at least ``min_ratio``, with the ratio.

    Only pairs that pass the bound on shared characters are measured in Python.
    """
    if not 0 < min_ratio <= 1:
        raise ValueError("min_ratio must be above 0 and at most 1")
    asked = _texts(left, left_col, "a").withColumns({"lower": F.lit(min_ratio), "covered": F.lit(2.0)})
    met = _ratio_candidates(asked, _texts(right, right_col, "b"), min_ratio)
    measured = met.select(
        F.col("a_t").alias(left_col),
        F.col("b_t").alias(right_col),
        matching_ratio(F.col("a_t"), F.col("b_t")).alias("ratio"),
    )
    return measured.where(F.col("ratio") >= min_ratio)


# Bounds from which pairs are measured, round by round, before the smallest ratio asked for.
LEVELS = (0.85, 0.7, 0.55)


def best_ratio_pairs(
    left: DataFrame,
    right: DataFrame,
    min_ratio: float,
    known: DataFrame,
    kth_score: Callable[[DataFrame], DataFrame],
    levels: tuple[float, ...] = LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """Enough pairs ``(a_t, b_t, score)`` to know the best of every left text; ``known`` pairs have their score already.

    ``kth_score`` gives ``(a_t, theta)`` from the pairs so far: what a new pair has to reach to count, and at
    least ``min_ratio``. A round measures the pairs whose bound is below what was covered, but not below the round's
    level or the text's threshold; a text is done when its threshold has reached what is covered. So each pair is
    measured once at most, and only while it can still count; ties with the threshold are measured.

    Returns the pairs at ``min_ratio`` or above, and all that were measured.
    """
    texts, others = _texts(left, "a_t", "a"), _texts(right, "b_t", "b")
    known = stored(known.select("a_t", "b_t", "score"))
    state = stored(texts.join(kth_score(known), "a_t", "left").select("a_t", F.coalesce("theta", F.lit(min_ratio)).alias("theta"), F.lit(2.0).alias("covered")))
    rounds, measured = [known], []
    for level in [*[x for x in levels if x > min_ratio], min_ratio]:
        lower = F.greatest(F.lit(level), F.col("theta"))
        open_ = state.where(F.col("theta") < F.col("covered")).where(lower < F.col("covered"))
        met = _ratio_candidates(open_.select("a_t", lower.alias("lower"), "covered"), others, level)
        new = met.join(known.select("a_t", "b_t"), ["a_t", "b_t"], "left_anti")
        scored = stored(new.select("a_t", "b_t", matching_ratio(F.col("a_t"), F.col("b_t")).alias("score")))
        measured.append(scored)
        rounds.append(scored.where(F.col("score") >= min_ratio))
        theta = kth_score(reduce(DataFrame.unionByName, rounds))
        now = state.select("a_t", F.least(lower, F.col("covered")).alias("covered"))
        state = stored(now.join(theta, "a_t", "left").select("a_t", F.coalesce("theta", F.lit(min_ratio)).alias("theta"), "covered"))
        if state.where(F.col("theta") < F.col("covered")).isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds), reduce(DataFrame.unionByName, measured)


# ---- nearest vectors ------------------------------------------------------------------------

SCORE_DIGITS = 9
# Bytes of a block's vectors as doubles, and scores that a task holds at a time.
BLOCK_BYTES = 1 << 25
TILE = 1 << 22
# Columns whose largest score stands for them when the k-th best is bounded from below.
FOLD = 64
PAIRS = 1 << 16


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """One row for each vector; missing components are NaN."""
    one = vectors.combine_chunks() if vectors.num_chunks != 1 else vectors.chunk(0)
    size = np.diff(one.offsets.to_numpy()) if len(one) else np.empty(0, int)
    if one.null_count or (size != size[:1]).any():
        raise ValueError("vectors must be present and of one length")
    return one.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(one), -1)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _first_of_each(rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each run of equal numbers in ``rows``, which are sorted."""
    new = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, int)
    return np.flatnonzero(np.arange(len(rows)) - np.repeat(new, np.diff(np.r_[new, len(rows)])) < k)


def _kth_bound(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row a bound that at least ``k`` of its scores reach, and the largest scores of its groups: ``g, g + n, g + 2n...``."""
    n = scores.shape[1]
    groups = max(n // FOLD, min(n, 4 * k))
    whole = n - n % groups
    top = scores[:, :whole].reshape(len(scores), -1, groups).max(axis=1)
    if whole < n:
        np.maximum(top[:, : n - whole], scores[:, whole:], out=top[:, : n - whole])
    return (np.partition(top, groups - k, axis=1)[:, groups - k] if groups > k else np.full(len(scores), -np.inf)), top


class _Block:
    """The vectors of a cell, those of a kind side by side. Of equal vectors of a kind only the ``k`` first by IRI can be among the best."""

    def __init__(self, table: pa.Table, k: int) -> None:
        iris = table["iri"].to_pylist()
        unit = _unit_rows(_matrix(table["vector"]))
        kinds: dict[str | None, int] = {}
        kind = np.array([kinds.setdefault(x, len(kinds)) for x in table["kind"].to_pylist()], int)
        by_iri = np.argsort(np.array([str(x) for x in iris]), kind="stable")
        keep = by_iri[np.isfinite(unit).all(axis=1)[by_iri]]
        _, same = np.unique(np.ascontiguousarray(unit[keep]).view(f"V{unit.shape[1] * 8}").ravel(), return_inverse=True) if unit.shape[1] else (None, np.zeros(len(keep), int))
        order = np.lexsort((same, kind[keep]))
        order = order[_first_of_each(kind[keep][order] * (len(keep) + 1) + same[order], k)]
        # By kind, then by IRI: the place of a column among its kind follows its IRI.
        order = np.sort(order)
        order = order[np.argsort(kind[keep][order], kind="stable")]
        self.rank, at = order, keep[order]
        self.iris, self.unit, kind = np.array(iris, object)[at], unit[at], kind[at]
        self.short = self.unit.astype(np.float32)
        ends = np.searchsorted(kind, np.arange(len(kinds) + 1))
        self.kinds = {x: (int(ends[i]), int(ends[i + 1])) for x, i in kinds.items()}

    def best(self, unit: np.ndarray, rows: np.ndarray, first: int, last: int, k: int, floor: float):
        """(row, column, score) of the ``k`` best of each of ``rows`` among the columns ``first`` to ``last``, ties at the end by IRI.

        Products of single precision bound the ``k``-th best score from below; what may reach it is scored in double precision.
        """
        columns, dims = last - first, unit.shape[1]
        # What both rounding to single precision and adding up in it can change, and half a step of the last digit kept.
        slack = np.float32((dims + 16) * 2.0**-23 + 10.0**-SCORE_DIGITS)
        step = max(1, TILE // columns)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            scores = unit[some].astype(np.float32) @ self.short[first:last].T
            bound, top = _kth_bound(scores, k)
            least = np.maximum(bound - 2 * slack, np.float32(floor) - 2 * slack)
            i, group = np.nonzero(top >= least[:, None])
            places = group[:, None] + np.arange(0, columns, top.shape[1])
            inside = places < columns
            inside &= scores[i[:, None], np.where(inside, places, 0)] >= least[i][:, None]
            i, j = np.repeat(i, inside.sum(axis=1)), places[inside] + first
            score = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", unit[some[i[p : p + PAIRS]]], self.unit[j[p : p + PAIRS]]) for p in range(0, len(i), PAIRS))])
            score = np.round(score, SCORE_DIGITS)
            ok = score >= floor
            yield _ranked(some[i[ok]], j[ok], score[ok], self.rank, k)


def _ranked(row: np.ndarray, column: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int):
    order = np.lexsort((rank[column], -score, row))
    order = order[_first_of_each(row[order], k)]
    return row[order], column[order], score[order]


_BEST = "query_id string, iri string, score double"


def _cell(k: int, floor: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "iri", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], names)
        block, unit = _Block(right, k), _unit_rows(_matrix(left["vector"]))
        asked: dict[tuple[int, int], list[int]] = {}
        usable = np.isfinite(unit).all(axis=1)
        for r, wanted in enumerate(left["kinds"].to_pylist()):
            if usable[r]:
                for span in {block.kinds.get(x, (0, 0)) for x in wanted} if wanted else ((0, len(block.iris)),):
                    asked.setdefault(span, []).append(r)
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for (first, last), rows in sorted(asked.items()):
            if first < last:
                found += block.best(unit, np.array(rows), first, last, k, floor)
        row, column, score = _ranked(*map(np.concatenate, zip(*found, strict=True)), block.rank, k)
        ids = left["query_id"].combine_chunks().take(pa.array(row))
        return pa.Table.from_arrays([ids.cast(pa.string()), pa.array(block.iris[column], pa.string()), pa.array(score)], names)

    return run


def _rows_of_block(vectors: DataFrame) -> int:
    one = vectors.select(F.size("vector").alias("n")).first()
    return max(1, BLOCK_BYTES // (8 * max(1, one["n"] or 1))) if one else 1


def nearest_vectors(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    min_score: float | None = None,
    block_rows: int | None = None,
    chunk_rows: int = 20_000,
    slice_rows: int = 2_000,
    query_count: int | None = None,
    vector_count: int | None = None,
) -> DataFrame:
    """Exact cosine top ``k``: ``queries(query_id, vector[, kinds])`` by ``vectors(iri, vector[, kind])``.

    Both sides are hashed into blocks and every (chunk, block) cell emits only its own best ``k`` per query. A row is
    copied once for each block of the other side, so blocks of both sides are large where there is work for all cores:
    ``block_rows`` vectors, by default what takes 32 MB, and ``chunk_rows`` queries, or down to ``slice_rows`` where cells are few.
    A cell multiplies some queries at a time. So nothing is broadcast, a task holds one block, and the final
    ranking sees ``k`` rows per query and block. Queries of some kinds meet vectors of these kinds only. Scores are rounded to
    nine digits, then ties go by ``iri``, so copies of a vector rank the same wherever they land. ``kinds`` NULL or empty: no
    filter. Vectors of floats are carried as floats.
    """
    if "kinds" not in queries.columns:
        queries = queries.withColumn("kinds", F.lit(None).cast("array<string>"))
    if "kind" not in vectors.columns:
        vectors = vectors.withColumn("kind", F.lit(None).cast("string"))
    nq = queries.count() if query_count is None else query_count
    nv = vectors.count() if vector_count is None else vector_count
    blocks = max(1, -(-nv // (_rows_of_block(vectors) if block_rows is None else block_rows)))
    cells = 2 * queries.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-nq // chunk_rows), min(-(-nq // slice_rows), -(-cells // blocks)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def bucket(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    q = queries.select(
        F.col("query_id").cast("string").alias("query_id"), "vector", "kinds",
        bucket("query_id", chunks).alias("chunk"), every(blocks).alias("block"),
    )
    v = vectors.select(
        "iri", "kind", "vector", bucket("iri", blocks).alias("block"), every(chunks).alias("chunk")
    )
    floor = -np.inf if min_score is None else min_score
    best = q.groupBy("chunk", "block").cogroup(v.groupBy("chunk", "block")).applyInArrow(_cell(k, floor), _BEST)
    from tripleframe.operators.forms import top_k

    return top_k(best, ["query_id"], [F.desc("score"), F.asc("iri")], k)
