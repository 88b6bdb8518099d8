"""Paths against a plain search, on graphs with cycles, branches and named graphs."""

import pytest

from tripleframe.operators import paths

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "h"), ("x", "x"), ("a", "b")]


def closure(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return out
        out |= more


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or ("s", "o"))).collect())


@pytest.fixture(scope="module")
def e(spark):
    return spark.createDataFrame(EDGES, "s string, o string")


def test_one_or_more(e):
    assert pairs(paths.one_or_more(e)) == sorted(closure(EDGES))


def test_zero_or_more_and_sequence(e, spark):
    ident = spark.createDataFrame([(n, n) for n in "abcdefghxz"], "s string, o string")
    assert pairs(paths.zero_or_more(e, ident)) == sorted(closure(EDGES) | {(n, n) for n in "abcdefghxz"})
    two = [(a, d) for a, b in EDGES for c, d in EDGES if b == c]
    assert pairs(paths.sequence(e, e)) == sorted(two)
    assert pairs(paths.alternative(e, paths.inverse(e))) == sorted(EDGES + [(b, a) for a, b in EDGES])
    assert pairs(paths.zero_or_one(e, ident)) == sorted(set(EDGES) | {(n, n) for n in "abcdefghxz"})


def test_reach_seeds_and_hops(e, spark):
    seeds = spark.createDataFrame([("c",), ("x",)], "s string")
    want = sorted(p for p in closure(EDGES) if p[0] in "cx")
    assert pairs(paths.reach(e, seeds)) == want
    assert pairs(paths.reach(e, seeds, consolidate_every=1)) == want
    near = paths.reach(e, seeds, max_hops=2, on_limit="stop")
    assert pairs(near) == sorted({("c", "a"), ("c", "d"), ("c", "b"), ("c", "e"), ("x", "x")})
    with pytest.raises(ValueError):
        paths.reach(e, seeds, max_hops=2)
    assert pairs(paths.reach(e, seeds, max_hops=9)) == want


def test_graph_is_part_of_every_hop(spark):
    rows = [("g1", "a", "b"), ("g2", "b", "c"), ("g1", "b", "d")]
    e = spark.createDataFrame(rows, "g string, s string, o string")
    assert pairs(paths.one_or_more(e), "g", "s", "o") == [("g1", "a", "b"), ("g1", "a", "d"), ("g1", "b", "d"), ("g2", "b", "c")]
    assert pairs(paths.sequence(e, e), "g", "s", "o") == [("g1", "a", "d")]
    seeds = spark.createDataFrame([("g1", "a"), ("g2", "a")], "g string, s string")
    assert pairs(paths.reach(e, seeds), "g", "s", "o") == [("g1", "a", "b"), ("g1", "a", "d")]


def test_single_way_on(spark):
    chain = [(str(i), str(i + 1)) for i in range(21)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("t", "c0"), ("l", "l")]
    e = spark.createDataFrame(chain, "s string, o string")
    seeds = spark.createDataFrame([("0",), ("5",), ("c1",), ("t",), ("l",), ("21",), ("none",)], "s string")
    names = {r[0] for r in seeds.collect()}
    want = {p for p in closure(chain) if p[0] in names}
    assert pairs(paths.reach(e, seeds)) == sorted(want)
    assert pairs(paths.reach(e, seeds, include_start=True)) == sorted(want | {(n, n) for n in names})


@pytest.mark.parametrize("block", [3, 50_000])
def test_hubs_are_cut_into_blocks(spark, block):
    """A node with a third of all edges in and out, chains behind it, a cycle through it, and branches behind chains."""
    edges = [(f"u{i}", "hub") for i in range(12)] + [("hub", f"v{i}") for i in range(12)] + [(f"v{i}", f"w{i}") for i in range(12)]
    edges += [("w0", "c0")] + [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("c9", "f"), ("f", "x"), ("f", "y"), ("y", "hub"), ("x", "z")]
    e = spark.createDataFrame(edges, "s string, o string")
    whole = closure(edges)
    assert pairs(paths.one_or_more(e, block=block)) == sorted(whole)
    seeds = spark.createDataFrame([("u3",), ("hub",), ("v0",), ("w5",), ("none",)], "s string")
    names = {r[0] for r in seeds.collect()}
    want = {p for p in whole if p[0] in names}
    assert pairs(paths.reach(e, seeds, block=block)) == sorted(want)
    assert pairs(paths.reach(e, seeds, block=block, include_start=True)) == sorted(want | {(n, n) for n in names})
    near = {(a, b) for a, b in edges if a in names} | {(a, d) for a, b in edges if a in names for c, d in edges if b == c}
    assert pairs(paths.reach(e, seeds, block=block, max_hops=2, on_limit="stop")) == sorted(near)


def test_blocks_bound_the_edges_of_a_key(spark):
    edges = spark.createDataFrame([("hub", f"v{i}") for i in range(1000)] + [("a", "b")], "__from string, __to string")
    blocks, hubs = paths._blocked(edges, [], 100)
    sizes = {(r[0], r[1]): r[2] for r in blocks.groupBy("__from", "__block").count().collect()}
    assert hubs.collect() == [("hub", 10)] and len(sizes) == 11 and max(sizes.values()) < 150


def test_reach_of_nothing(spark):
    e = spark.createDataFrame([], "s string, o string")
    seeds = spark.createDataFrame([("a",)], "s string")
    assert pairs(paths.reach(e, seeds)) == [] and pairs(paths.one_or_more(e)) == []
    assert pairs(paths.reach(e, seeds, include_start=True)) == [("a", "a")]


def test_ways_of_a_hub_do_not_meet_in_one_task(spark):
    """Ways of branching nodes are told from single ones by node and block, and no way is lost."""
    rows = [("hub", f"x{i}") for i in range(40)] + [(f"x{i}", "end") for i in range(40)] + [("two", "a"), ("two", "b")]
    ways = paths._Ways(spark.createDataFrame(rows, "s string, o string"), [], 4)
    seen = []
    kept, paths.cut_lineage = paths.cut_lineage, lambda df: seen.append(df) or kept(df)
    try:
        blocks, hubs = ways.blocks(branching_only=True)
    finally:
        paths.cut_lineage = kept
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    (anti,) = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert "__from" in anti and "__block" in anti
    assert sorted((r["__from"], r["__to"]) for r in blocks.collect()) == sorted(r for r in rows if r[0] in ("hub", "two"))
    assert [(r["__from"], r["__blocks"]) for r in hubs.collect()] == [("hub", 10)]
