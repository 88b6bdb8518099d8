"""Property paths as functions over edge tables ``(s, o)``, or ``(g, s, o)`` inside ``GRAPH ?g``.

``edges``, ``inverse``, ``sequence`` and ``alternative`` keep duplicates; ``zero_or_one``,
``one_or_more`` and ``zero_or_more`` return distinct pairs.

A node with very many ways on, a hub, would put all its edges into one task of every join. So the ways on of a node are
cut into blocks of bounded size by the hash of their far end; pairs that arrive at a hub are copied to its blocks, all others
meet their one block. Nodes with a single way on are followed by doubled hops, so a chain costs the logarithm of its
length wherever it lies in the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.operators.bindings import Bindings
from tripleframe.operators.patterns import Graph, active_graph, is_variable
from tripleframe.session import cut_lineage, stored

# Ways on of one node that one block holds.
BLOCK = 50_000


def _graph_keys(edge_table: DataFrame) -> list[str]:
    return ["g"] if "g" in edge_table.columns else []


def edges(quads: Graph, *predicates: str, graph: str | None = None) -> DataFrame:
    """Edges of one predicate, or of several in one scan."""
    keys = ["g"] if graph is not None and is_variable(graph) else []
    p = F.col("p")
    hit = p == predicates[0] if len(predicates) == 1 else p.isin(list(predicates))
    if len(predicates) == 1 and not isinstance(quads, DataFrame):
        quads = quads.narrowed(p=predicates[0])
    return active_graph(quads, graph).where(hit).select(*keys, "s", "o")


def inverse(edge_table: DataFrame) -> DataFrame:
    return edge_table.select(
        *_graph_keys(edge_table), F.col("o").alias("s"), F.col("s").alias("o")
    )


def sequence(*steps: DataFrame) -> DataFrame:
    def hop(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = _graph_keys(a)
        left = a.select(*keys, F.col("s"), F.col("o").alias("__mid"))
        right = b.select(*keys, F.col("s").alias("__mid"), F.col("o"))
        return left.join(right, keys + ["__mid"]).select(*keys, "s", "o")

    return reduce(hop, steps)


def alternative(*options: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, options)


def nodes(
    quads: Graph, graph: str | None = None, constants: list[str] | None = None
) -> DataFrame:
    """Identity pairs of every subject and object, and of constants the graph may not contain."""
    keys = ["g"] if graph is not None and is_variable(graph) else []
    rows = active_graph(quads, graph)
    ends = F.explode(F.array("s", "o")).alias("s")
    found = rows.select(*keys, ends).distinct()
    if constants and not keys:
        extra = quads.sparkSession.createDataFrame([(c,) for c in constants], "s string")
        found = found.unionByName(extra).distinct()
    return found.select(*keys, "s", F.col("s").alias("o"))


def zero_or_one(edge_table: DataFrame, identity: DataFrame) -> DataFrame:
    return edge_table.unionByName(identity).distinct()


def _blocked(ways: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """``(keys, __from, __block, __to)`` of ``(keys, __from, __to)``, and the hubs with their number of blocks.

    The hubs are few, an entry for each ``block`` edges at most; they are written, so Spark broadcasts them if they
    are small and splits the skewed side of the join if they are not.
    """
    ends = [*keys, "__from"]
    counted = ways.groupBy(*ends).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    hubs = stored(counted.select(*ends, F.ceil(F.col("__n") / block).cast("int").alias("__blocks")))
    number = F.when(F.col("__blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("__to"), "__blocks")).cast("int")
    return ways.join(hubs, ends, "left").select(*ends, number.alias("__block"), "__to"), hubs


def _step(pairs: DataFrame, blocks: DataFrame, hubs: DataFrame, keys: list[str]) -> DataFrame:
    """One hop on from every pair; pairs that end at a hub are copied to each of its blocks."""
    ends = [*keys, "__from"]
    arrived = pairs.withColumnRenamed("o", "__from").join(hubs, ends, "left")
    copied = arrived.withColumn("__block", F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1)))
    return copied.join(blocks, [*ends, "__block"]).select(*keys, "s", F.col("__to").alias("o"))


def one_or_more(edge_table: DataFrame, block: int = BLOCK) -> DataFrame:
    """Transitive closure with both ends free.

    The newest pairs are joined with everything found so far, so the number of rounds is the
    logarithm of the longest shortest path. Each round writes its new pairs only. The answer itself can be quadratic in the number of
    nodes; use :func:`reach` when one end is known.
    """
    keys = _graph_keys(edge_table)
    cols = keys + ["s", "o"]
    newest = cut_lineage(edge_table.select(*cols).distinct())
    rounds = [newest]
    while True:
        found = reduce(DataFrame.unionByName, rounds)
        ways = found.select(*keys, F.col("s").alias("__from"), F.col("o").alias("__to"))
        step = _step(newest, *_blocked(ways, keys, block), keys)
        newest = cut_lineage(step.distinct().join(found, cols, "left_anti").select(*cols))
        if newest.isEmpty():
            return found
        rounds.append(newest)


def zero_or_more(edge_table: DataFrame, identity: DataFrame) -> DataFrame:
    return one_or_more(edge_table).unionByName(identity).distinct()


class _Ways:
    """The ways on of a graph: blocks of the nodes with several, doubled hops of the nodes with one."""

    def __init__(self, edge_table: DataFrame, keys: list[str], block: int) -> None:
        self.keys = keys
        self.all = cut_lineage(edge_table.select(*keys, F.col("s").alias("__from"), F.col("o").alias("__to")).distinct())
        self.block = block
        ends = [*keys, "__from"]
        # Counted without a window: a hub's edges are combined in the tasks that read them.
        one = self.all.groupBy(*ends).agg(F.count("*").alias("__n"), F.min("__to").alias("__to"))
        self.single = stored(one.where("__n = 1").select(*ends, F.lit(0).alias("__block"), "__to"))
        self.jumps = [self.single]

    def blocks(self, branching_only: bool) -> tuple[DataFrame, DataFrame]:
        ends = [*self.keys, "__from"]
        blocks, hubs = _blocked(self.all, self.keys, self.block)
        if branching_only:
            # By block as well, so that the ways of a hub do not meet in one task; a single way is block 0 of its node.
            cell = [*ends, "__block"]
            blocks = blocks.join(self.single.select(*cell), cell, "left_anti")
        return cut_lineage(blocks.repartition(*ends, "__block")), hubs

    def jump(self, level: int) -> DataFrame:
        """Hops of ``2**level`` along single ways; the table never outgrows the edges."""
        while len(self.jumps) <= level:
            half = self.jumps[-1]
            onward = half.select(*self.keys, F.col("__from").alias("__to"), F.col("__to").alias("__next"))
            joined = half.join(onward, [*self.keys, "__to"])
            self.jumps.append(stored(joined.select(*self.keys, "__from", F.col("__next").alias("__to"))))
        return self.jumps[level]

    def followed(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` and every node behind them up to the next one that branches or ends."""
        found, level = pairs, 0
        while True:
            hops = self.jump(level)
            new = found.withColumnRenamed("o", "__from").join(hops, [*self.keys, "__from"])
            new = new.select(*self.keys, "s", F.col("__to").alias("o")).join(found, [*self.keys, "s", "o"], "left_anti")
            new = cut_lineage(new.distinct())
            if new.isEmpty():
                return found
            found, level = cut_lineage(found.unionByName(new)), level + 1


def reach(
    edge_table: DataFrame,
    starts: DataFrame,
    include_start: bool = False,
    max_hops: int | None = None,
    on_limit: str = "error",
    consolidate_every: int = 8,
    block: int = BLOCK,
) -> DataFrame:
    """Distinct ``(start, node)`` pairs reachable from ``starts(s)``.

    Walk ``inverse(edges)`` when only the far end is known. A round takes one hop from the nodes that branch, then follows all single
    ways by doubled hops, so the number of rounds is that of the branching nodes on a path. With ``max_hops`` every round is
    one hop; an unfinished walk raises unless ``on_limit="stop"`` asks for the bounded answer.
    """
    keys = _graph_keys(edge_table)
    pair = keys + ["s", "o"]
    ways = _Ways(edge_table, keys, block)
    bounded = max_hops is not None
    blocks, hubs = ways.blocks(branching_only=not bounded)
    seeds = cut_lineage(starts.select(*keys, "s").distinct().withColumn("o", F.col("s")))

    def single_hop(pairs: DataFrame) -> DataFrame:
        hops = ways.single
        return pairs.withColumnRenamed("o", "__from").join(hops, [*keys, "__from"]).select(*keys, "s", F.col("__to").alias("o"))

    seen = [seeds] if include_start else []
    frontier, hop = seeds, 0
    while True:
        step = _step(frontier, blocks, hubs, keys)
        if hop == 0 and not bounded:
            # A start itself is no result yet, so its single way is taken as a hop of its own.
            step = step.unionByName(single_hop(frontier))
        step = step.distinct()
        if not bounded:
            step = ways.followed(cut_lineage(step))
        if seen:
            step = step.join(reduce(DataFrame.unionByName, seen), pair, "left_anti").select(*pair)
        if bounded and hop == max_hops:
            if on_limit == "error" and not step.isEmpty():
                raise ValueError(f"path goes on after {max_hops} hops; pass on_limit='stop' to cut")
            break
        frontier = cut_lineage(step)
        hop += 1
        if frontier.isEmpty():
            break
        seen.append(frontier)
        if len(seen) > consolidate_every:
            seen = [cut_lineage(reduce(DataFrame.unionByName, seen))]
    return reduce(DataFrame.unionByName, seen) if seen else frontier


def as_bindings(edge_table: DataFrame, s: str, o: str, graph: str | None = None) -> Bindings:
    """Pairs as bindings; each end is a variable or a constant, ``?x ?x`` asks for cycles."""
    df = edge_table
    out: dict[str, Column] = {}
    for column, slot in (("s", s), ("o", o)):
        if not is_variable(slot):
            df = df.where(F.col(column) == slot)
        elif slot[1:] in out:
            df = df.where(F.col("s") == F.col("o"))
        else:
            out[slot[1:]] = F.col(column)
    if graph is not None and is_variable(graph):
        out[graph[1:]] = F.col("g")
    return Bindings(df.select(*[c.alias(v) for v, c in out.items()]))
