"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are dealt into shards of bounded size. In a shard every dimension has its posting segments: the rows whose
component falls on one of 32 equal levels. What a segment adds to a score, measured from the least that its dimension
can add, is its impact: query component times distance of the level from that end. For a query all segments of all
dimensions are processed by descending quantised impact, whatever their dimension:

* a row's accumulator gets the impact of each of its segments that was processed, and counts them;
* a row can gain at most the impact of the next segment for every dimension not processed yet, and one level's width for
  those processed; it never loses;
* processing stops only when, by these bounds, all rows but few cannot reach the k-th best lower bound any more, or when no segment is
  left. Rows that can, ties included, are rescored with the whole integers.

Shards and blocks of queries have a fixed number of components, so every cell of the search fits a task at any size;
each query keeps k rows of a shard, and the shards' rows are ranked again.

Defined results: a vector that is null or holds a null, NaN or infinite component takes no part. A shorter vector counts
as zero beyond its end. Repeated rows are rows: each is a candidate of the other, each repeated query has its own ranks.
Ties go to the smaller ``vec_id``, null last; a row without ``vec_id`` can be found but is no query. Scores beyond 64
bits are an error. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleframe.llm.common import written

LEVELS = 32
SHARD_CELLS = 1 << 21
QUERY_CELLS = 1 << 20
# Shares of a shard's postings after which a proof is tried, and the share of rows that it may leave to rescore.
CHECKS = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875)
RESCORE_SHARE = 1 / 4
# Bounds stay exact in a double below this; longer numbers are scored one by one with Python's integers.
EXACT = 1 << 52


class ImpactIndex:
    """Posting segments of one shard, by dimension and level."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        self.width = (self.high - self.low) // LEVELS + 1
        self.level = ((vectors - self.low) // self.width).astype(np.int8)
        dims, levels, self.rows = [], [], []
        for d in range(vectors.shape[1]):
            order = np.argsort(self.level[:, d], kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(self.level[order, d])) + 1):
                dims.append(d)
                levels.append(self.level[rows[0], d])
                self.rows.append(rows)
        self.dims, self.levels = np.array(dims), np.array(levels, dtype=np.int64)
        self.sizes = np.array([len(r) for r in self.rows])

    def impacts(self, query: np.ndarray) -> np.ndarray:
        """The most that each segment adds, measured from the least that its dimension can add."""
        q, width, low, high = (x[self.dims] for x in (query, self.width, self.low, self.high))
        above = np.minimum((self.levels + 1) * width - 1, high - low)
        below = high - low - self.levels * width
        return np.where(q > 0, q * above, -q * below)

    def members(self, query: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """Rows that may be among the k best, and the share of postings that was processed to prove it."""
        n, dims = self.vectors.shape
        if n <= k:
            return np.arange(n), 0.0
        impact = self.impacts(query)
        order = np.argsort(-impact, kind="stable")
        reached = np.cumsum(self.sizes[order])
        reach = np.abs(query) * (self.high - self.low)
        base = int(np.minimum(query * self.low, query * self.high).sum())
        gained = np.full(n, base, dtype=np.int64)
        # The next level to come of each dimension: from the top down for positive components, else from the bottom up.
        sign = np.where(query > 0, 1, -1).astype(np.int8)
        limit = np.where(query > 0, LEVELS, 1).astype(np.int8)
        at, best = 0, np.iinfo(np.int64).min
        for share in (*CHECKS, 1.0):
            stop = min(int(np.searchsorted(reached, share * n * dims)) + 1, len(order))
            for segment in order[at:stop].tolist():
                gained[self.rows[segment]] += impact[segment]
            # A later segment of a dimension lies nearer to its low end, so the last one marks how far it was processed.
            limit[self.dims[order[at:stop]]] = sign[self.dims[order[at:stop]]] * self.levels[order[at:stop]]
            at = stop
            frontier = impact[order[at]] if at < len(order) else 0
            open_most = np.minimum(reach, frontier).astype(np.float32) * np.float32(1 + 1e-6)
            # The k-th best exact score of some rows that lead so far is a lower bound of the k-th best of all.
            leading = np.argpartition(gained, n - min(n, 8 * k))[n - min(n, 8 * k) :]
            best = max(best, int(np.sort(self.vectors[leading] @ query)[-k]))
            # A sample tells whether a proof is worth trying; the proof itself looks at every row.
            if at < len(order) and self._possible(slice(None, None, 16), gained, sign, limit, open_most, best).mean() > RESCORE_SHARE:
                continue
            may = np.flatnonzero(self._possible(slice(None), gained, sign, limit, open_most, best))
            if len(may) <= n * RESCORE_SHARE:
                break
        return may, float(reached[at - 1]) / (n * dims)

    def _possible(self, rows, gained, sign, limit, open_most, best) -> np.ndarray:
        """Which rows may still score ``best``: dimensions not processed for a row add at most the frontier."""
        open_ = (self.level[rows] * sign < limit).astype(np.float32) @ open_most
        return gained[rows] + open_ * (1 + 1e-5) + 1 >= best


def _fits(vectors: np.ndarray, queries: np.ndarray) -> bool:
    widest = [max((abs(int(x)) for x in (v.min(), v.max())), default=0) for v in (vectors, queries) if v.size]
    return len(widest) < 2 or 2 * widest[0] * widest[1] * vectors.shape[1] < EXACT


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


_FOUND = "query_uid long, query_id long, vec_id long, score long, processed double"
_FOUND_SCHEMA = pa.schema(
    [("query_uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("processed", pa.float64())]
)


def _search(k: int, dims: int):
    def cell(queries: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(queries) and len(shard):
            vectors, asked = _matrix(shard["v"], dims), _matrix(queries["q_v"], dims)
            ids, uids = np.array(shard["vec_id"].to_pylist(), dtype=object), shard["uid"].to_numpy()
            exact = dims == 0 or not _fits(vectors, asked)
            index = None if exact else ImpactIndex(vectors)
            for query, uid, query_id in zip(asked, queries["q_uid"].to_pylist(), queries["q_id"].to_pylist(), strict=True):
                # One more than asked for, since the query's own row may be among them.
                may, share = (np.arange(len(ids)), 1.0) if exact else index.members(query, k + 1)
                may = may[uids[may] != uid]
                scores = (vectors[may].astype(object) @ query.astype(object)) if exact and dims else vectors[may] @ query
                best = sorted(zip((-scores).tolist(), (ids[may] == None).tolist(), ids[may].tolist(), strict=True), key=lambda r: (r[0], r[1], r[2] or 0))[:k]  # noqa: E711
                out += [(uid, query_id, vec_id, -score, share) for score, _, vec_id in best]
        columns = list(zip(*out, strict=True)) or [[]] * len(_FOUND_SCHEMA)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA)

    return cell


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(uid, vec_id, v): components times ``scale``, rounded down; only vectors with finite components throughout."""

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    wide = F.col("embedding").cast("array<double>")
    kept = rows.select("vec_id", wide.alias("e")).filter(F.col("e").isNotNull() & F.forall("e", usable))
    scaled = F.transform("e", lambda x: F.floor(x * scale))
    return written(kept.select(F.monotonically_increasing_id().alias("uid"), "vec_id", scaled.alias("v")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k highest inner products of each query with all rows of ``vectors`` but its own: (uid, vec_id, v) both.

    Returns query_id, rank, vec_id, score, and processed: the share of postings of the row's shard that the query took.
    """
    sizes = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = sizes[1]
    shards = max(1, -(-sizes[0] * max(dims, 1) // SHARD_CELLS))
    blocks = max(1, -(-queries.count() * max(dims, 1) // QUERY_CELLS))

    def number(count: int) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(count))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    # Both sides may come from one table; new names keep their columns apart in the pairing of groups.
    asked = queries.select(
        F.col("uid").alias("q_uid"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"),
        number(blocks).alias("block"), every(shards).alias("shard"),
    )
    dealt = vectors.select("uid", "vec_id", "v", number(shards).alias("shard"), every(blocks).alias("block"))
    found = asked.groupBy("block", "shard").cogroup(dealt.groupBy("block", "shard")).applyInArrow(_search(k, dims), _FOUND)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "processed")
