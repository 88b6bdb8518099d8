"""Constants reach the scan: typed keys of mapped tables, folders and row groups of stored graphs."""

import pytest
from pyspark.sql import functions as F

from tests.sample import SCHEMA, quads
from tripleframe import vocab as V
from tripleframe.functions.terms import literal_key as lit
from tripleframe.operators import patterns as P
from tripleframe.sources import mapped as M
from tripleframe.sources import store

EX = V.EX


def plan(df):
    return df._jdf.queryExecution().toString()


def result(b):
    return sorted([tuple(r) for r in b.df.select(*sorted(b.variables)).collect()], key=str)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    nations = [(1, "A", 7, 1.5), (3, 'B "x"', 7, -2.0), (12, "3", 8, None), (None, "none", 8, 1e20), (-4, "", 9, float("nan"))]
    spark.createDataFrame(nations, "k int, name string, r bigint, w double").write.parquet(f"{path}/n")
    codes = [("a/b", 3), ("3", 3), (None, 1)]
    spark.createDataFrame(codes, "code string, k int").write.parquet(f"{path}/c")
    n, c = spark.read.parquet(f"{path}/n"), spark.read.parquet(f"{path}/c")
    return M.MappedGraph(
        M.branches(n, M.entity("nation", "k"), {
            V.RDF_TYPE: M.constant(EX + "Nation"), V.RDFS_LABEL: M.text("name", "EN"), EX + "inRegion": M.entity("region", "r"),
            EX + "weight": M.double("w"), EX + "number": M.integer("r"), EX + "pair": M.entity("pair", "k", "r")})
        + M.branches(c, M.entity("code", "code"), {EX + "of": M.entity("nation", "k"), V.RDFS_LABEL: M.text("code")},
                     graph=M.entity("graph", "k"))
    )


CONSTANTS = [
    ("?s", EX + "inRegion", EX + "region/7"), (EX + "nation/3", EX + "inRegion", "?o"), (EX + "nation/03", EX + "inRegion", "?o"),
    (EX + "nation/-4", "?p", "?o"), (EX + "nation/99999999999", "?p", "?o"), (EX + "nation/3/x", "?p", "?o"), (EX + "nation/", "?p", "?o"),
    ("?s", V.RDFS_LABEL, lit('B "x"', lang="en")), ("?s", V.RDFS_LABEL, lit("", lang="en")), ("?s", V.RDFS_LABEL, lit("3")),
    ("?s", EX + "weight", lit(1.5)), ("?s", EX + "weight", '"1.50"^^' + V.DOUBLE), ("?s", EX + "weight", '"1.0E20"^^' + V.DOUBLE),
    ("?s", EX + "weight", '"NaN"^^' + V.DOUBLE), ("?s", EX + "number", lit(8)), ("?s", EX + "number", '"08"^^' + V.XSD + "integer"),
    ("?s", EX + "number", 8), ("?s", "?p", EX + "region/9"), ("?s", EX + "pair", EX + "pair/3/7"), ("?s", EX + "pair", EX + "pair/3"),
    ("?s", V.RDF_TYPE, EX + "Nation"), ("?s", V.RDF_TYPE, EX + "Region"), ("?s", EX + "none", "?o"), ("?s", "?p", "?s"), ("?s", "?p", "?o"),
]


@pytest.mark.parametrize("pattern", CONSTANTS, ids=str)
def test_narrowed_patterns_equal_the_whole_graph(shop, pattern):
    assert result(P.pattern(shop, *pattern)) == result(P.pattern(shop.quads, *pattern))


def test_narrowed_named_graphs(shop):
    for pattern in ((EX + "code/a/b", EX + "of", "?o"), ("?s", EX + "of", EX + "nation/3"), ("?s", V.RDFS_LABEL, "?o")):
        for graph in (EX + "graph/3", EX + "graph/x", "?g", None):
            assert result(P.pattern(shop, *pattern, graph=graph)) == result(P.pattern(shop.quads, *pattern, graph=graph))


def test_constants_become_typed_filters(shop):
    by_object = plan(P.pattern(shop, "?s", EX + "inRegion", EX + "region/7").df)
    assert "EqualTo(r,7)" in by_object and by_object.count("FileScan") == 1
    by_subject = plan(P.pattern(shop, EX + "nation/3", EX + "inRegion", "?o").df)
    assert "EqualTo(k,3)" in by_subject
    assert "EqualTo(name,A)" in plan(P.pattern(shop, "?s", V.RDFS_LABEL, lit("A", lang="en")).df)
    assert "FileScan" not in plan(P.pattern(shop, "?s", V.RDF_TYPE, EX + "Region").df)
    more = shop.unionByName(shop.quads.limit(0))
    assert result(P.pattern(more, "?s", EX + "inRegion", "?o")) == result(P.pattern(shop, "?s", EX + "inRegion", "?o"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = quads() + quads()[:5] + [(None, EX + f"n{i}", EX + f"p{i % 40}", EX + f"n{i * 7 % 300}") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.distinct(), store.write(df, str(tmp_path_factory.mktemp("store")) + "/g")


def test_store_holds_the_set(stored, spark):
    df, graph = stored
    assert sorted(map(tuple, graph.quads.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    again = store.StoredGraph(spark, graph.path)
    assert again.statistics([EX + "knows", EX + "absent"]) == {EX + "knows": (3, 3, 3), EX + "absent": (0, 0, 0)}
    n = df.where(F.col("p") == V.RDF_TYPE).agg(F.count("*"), F.count_distinct("s"), F.count_distinct("o")).first()
    assert again.statistics([V.RDF_TYPE])[V.RDF_TYPE] == tuple(n)


@pytest.mark.parametrize("graph", [None, "?g", EX + "employmentGraph"])
def test_stored_patterns_equal_the_rows(stored, graph):
    df, kept = stored
    for pattern in (("?s", EX + "worksFor", "?o"), (EX + "alice", "?p", "?o"), ("?s", "?p", EX + "Acme"), (EX + "alice", EX + "worksFor", EX + "Acme"),
                    ("?s", V.RDF_TYPE, EX + "Person"), ("?s", EX + "p7", "?o"), ("?s", "?p", "?o")):
        assert result(P.pattern(kept, *pattern, graph=graph)) == result(P.pattern(df, *pattern, graph=graph))


def test_stored_patterns_prune(stored):
    _, kept = stored
    one = plan(P.pattern(kept, "?s", EX + "p7", "?o").df)
    assert "PartitionFilters: [isnotnull(folder" in one and "EqualTo(p," in one and "by_subject" in one
    assert "EqualTo(s," in plan(P.pattern(kept, EX + "alice", "?p", "?o").df)
    by_object = plan(P.pattern(kept, "?s", EX + "p7", EX + "n49").df)
    assert "by_object" in by_object and "EqualTo(o," in by_object and "PartitionFilters: [isnotnull(folder" in by_object


def test_hubs_common_objects_and_long_texts_spread_over_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "RANGE_BYTES", 20_000)
    rows = [(None, EX + f"n{i}", V.RDF_TYPE, EX + "Thing") for i in range(2000)]
    rows += [(EX + "g", EX + "hub", EX + "to", EX + f"n{i}") for i in range(2000)]
    rows += [(None, EX + f"n{i}", EX + "text", lit("word " * 400 + str(i))) for i in range(60)] + [(None, EX + "n1", EX + "text", lit("short"))]
    df = spark.createDataFrame(rows * 3, SCHEMA).repartition(6)
    kept = store.write(df, f"{tmp_path}/g")
    for name in ("by_subject", "by_object"):
        read = spark.read.parquet(f"{kept.path}/{name}")
        assert sorted(map(tuple, read.select("g", "s", "p", "o").collect()), key=str) == sorted(rows, key=str)
        files = read.groupBy("p", F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.sum(F.length("o")).alias("size")).collect()
        for p, most in ((V.RDF_TYPE, 1000), (EX + "to", 1000), (EX + "text", 30)):
            assert max(r["n"] for r in files if r["p"] == p) <= most, (name, p)
    assert kept.statistics([V.RDF_TYPE, EX + "to", EX + "text"]) == {
        V.RDF_TYPE: (2000, 2000, 1), EX + "to": (2000, 1, 2000), EX + "text": (61, 60, 61)}
    none = store.write(df.limit(0), f"{tmp_path}/none")
    assert none.quads.count() == none.predicates.count() == 0 and none.statistics([EX + "to"]) == {EX + "to": (0, 0, 0)}


def test_half_a_store_is_none(spark, stored, tmp_path):
    df, kept = stored
    kept.quads.write.parquet(f"{tmp_path}/h/by_subject")
    with pytest.raises(Exception, match="about"):
        store.StoredGraph(spark, f"{tmp_path}/h")


def test_join_order_follows_statistics(stored):
    sizes = {EX + "big": (1_000_000, 1_000_000, 1000), EX + "mid": (10_000, 1000, 10_000), EX + "small": (50, 50, 5)}
    order = P._join_order([("?a", EX + "big", "?b"), ("?b", EX + "mid", "?c"), ("?c", EX + "small", EX + "x")], sizes)
    assert [p[1] for p in order] == [EX + "small", EX + "mid", EX + "big"]
    df, kept = stored
    patterns = [("?x", V.RDFS_LABEL, "?l"), ("?x", EX + "worksFor", "?f"), ("?f", EX + "foundedBy", EX + "alice")]
    assert result(P.bgp(kept, patterns)) == result(P.bgp(df, patterns))


def test_star_is_decided_before_planning(stored):
    df, kept = stored
    single = {EX + "age": "?a", EX + "worksFor": "?w"}
    assert result(P.star(kept, "?x", single)) == result(P.bgp(df, [("?x", p, v) for p, v in single.items()]))
    assert plan(P.star(kept, "?x", {EX + "age": "?a", EX + "joined": "?j"}).df).count("FileScan") <= 2 * 4
    many = {V.RDF_TYPE: "?t", EX + "contributesTo": "?p"}
    assert result(P.star(kept, "?x", many)) == result(P.bgp(df, [("?x", p, v) for p, v in many.items()]))
