"""Known answers on the sample graph."""

import pytest
from pyspark.sql import functions as F

from tests.sample import EX, SCHEMA, quads
from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.operators import aggregates as A
from tripleframe.operators import forms, paths
from tripleframe.operators import patterns as P
from tripleframe.operators.bindings import Bindings, values


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame(quads(), SCHEMA).cache()


def rows(b, *cols):
    df = b.df if isinstance(b, Bindings) else b
    cols = cols or df.columns
    return sorted(
        (tuple(None if v is None else str(v).replace(EX, "") for v in r) for r in df.select(*cols).collect()),
        key=str,
    )


def test_who_works_for_acme(g):
    assert rows(P.pattern(g, "?p", EX + "worksFor", EX + "Acme")) == [("alice",), ("bob",)]


def test_english_labels(g):
    b = P.bgp(g, [("?p", V.RDF_TYPE, EX + "Person"), ("?p", V.RDFS_LABEL, "?l")])
    b = b.filter(t.lang_matches(t.lang(F.col("l")), "en"))
    assert len(rows(b)) == 5


def test_optional_keeps_people_without_company(g):
    people = P.pattern(g, "?p", V.RDF_TYPE, EX + "Person")
    b = people.optional(P.pattern(g, "?p", EX + "worksFor", "?c"))
    assert rows(b) == [
        ("alice", "Acme"), ("bob", "Acme"), ("carol", "Globex"), ("dan", None), ("erin", None),
    ]


def test_optional_filter_is_part_of_the_join(g):
    people = P.pattern(g, "?p", V.RDF_TYPE, EX + "Person")
    labels = P.pattern(g, "?p", V.RDFS_LABEL, "?l")
    b = people.optional(labels, lambda l, r: t.strstarts(r("l"), "A"))
    assert rows(b, "p") == [("alice",), ("bob",), ("carol",), ("dan",), ("erin",)]
    assert b.df.where("l is not null").count() == 1


def test_union(g):
    b = P.pattern(g, "?a", EX + "knows", "?b").union(P.pattern(g, "?a", EX + "worksFor", "?b"))
    assert ("alice", "bob") in rows(b) and ("alice", "Acme") in rows(b) and len(rows(b)) == 6


def test_not_exists_and_minus(g):
    people = P.pattern(g, "?p", V.RDF_TYPE, EX + "Person")
    assert rows(people.not_exists(P.pattern(g, "?p", V.RDFS_LABEL, "?l"))) == []
    founders = P.pattern(g, "?c", EX + "foundedBy", "?p")
    assert rows(people.minus(founders)) == [("bob",), ("carol",), ("dan",)]
    other = P.pattern(g, "?x", EX + "foundedBy", "?y")
    assert len(rows(people.minus(other))) == 5


def test_knows_plus_from_alice(g, spark):
    e = paths.edges(g, EX + "knows")
    start = spark.createDataFrame([(EX + "alice",)], "s string")
    assert rows(paths.reach(e, start), "o") == [("bob",), ("carol",)]
    assert rows(paths.reach(e, start, include_start=True), "o") == [("alice",), ("bob",), ("carol",)]
    back = spark.createDataFrame([(EX + "carol",)], "s string")
    assert rows(paths.reach(paths.inverse(e), back), "o") == [("alice",), ("bob",), ("erin",)]


def test_knows_optional_path(g):
    e = paths.edges(g, EX + "knows")
    pairs = paths.zero_or_one(e, paths.nodes(g, constants=[EX + "alice", "http://nowhere/x"]))
    assert rows(paths.as_bindings(pairs, EX + "alice", "?x")) == [("alice",), ("bob",)]
    assert rows(paths.as_bindings(pairs, "http://nowhere/x", "?x")) == [("http://nowhere/x",)]


def test_values(g, spark):
    v = values(spark, ["c"], [(EX + "Acme",)])
    b = v.join(P.pattern(g, "?p", EX + "worksFor", "?c"))
    assert rows(b, "p", "c") == [("alice", "Acme"), ("bob", "Acme")]
    with pytest.raises(ValueError):
        values(spark, ["a", "b"], [("x",)])


def test_bind_arithmetic(g):
    b = P.pattern(g, "?p", EX + "age", "?age").bind("dbl", t.multiply(F.col("age"), 2))
    got = {r[0] for r in b.df.select(t.text(F.col("dbl"))).collect()}
    assert {"64", "82"} <= got
    assert b.df.select(t.datatype(F.col("dbl"))).first()[0] == V.XSD + "integer"
    with pytest.raises(ValueError):
        b.bind("age", F.lit(1))


def test_group_having(g):
    works = P.pattern(g, "?p", EX + "worksFor", "?c")
    n = A.group(works, ["c"], {"n": A.count_distinct(F.col("p"))})
    assert rows(n) == [("Acme", "2"), ("Globex", "1")]
    many = A.group(works, ["c"], {"n": A.count_distinct(F.col("p"))}, having=[F.col("n") > 1])
    assert rows(many) == [("Acme", "2")]


def test_oldest_per_company_with_subquery(g):
    b = P.bgp(g, [("?p", EX + "worksFor", "?c"), ("?p", EX + "age", "?age")])
    best = A.group(b, ["c"], {"maxAge": A.max_(F.col("age"))})
    joined = b.join(best).filter(t.eq(F.col("age"), F.col("maxAge")))
    want = [("bob", "Acme"), ("carol", "Globex")]
    assert rows(joined, "p", "c") == want
    assert rows(A.top_per_group(b, ["c"], "age"), "p", "c") == want


def test_named_graph(g):
    employed = P.pattern(g, "?p", EX + "worksFor", "?c", graph=EX + "employmentGraph")
    assert rows(employed, "p") == [("alice",), ("bob",), ("carol",)]
    everywhere = P.bgp(
        g, [("?p", EX + "worksFor", "?c"), ("?c", V.RDF_TYPE, EX + "Company")], graph="?g"
    )
    assert rows(everywhere, "p", "g") == [
        ("alice", "employmentGraph"), ("bob", "employmentGraph"), ("carol", "employmentGraph"),
    ]


def test_date_and_number_filters(g):
    joined = P.pattern(g, "?p", EX + "joined", "?d")
    after = joined.filter(t.gt(F.col("d"), t.literal("2019-01-01", datatype=V.DATE)))
    assert rows(after, "p") == [("alice",), ("carol",)]
    old = P.pattern(g, "?p", EX + "age", "?a").filter(t.gt(F.col("a"), 30))
    assert rows(old, "p") == [("alice",), ("bob",), ("dan",), ("erin",)]


def test_star_equals_bgp(g):
    preds = {V.RDFS_LABEL: "?l", EX + "age": "?a", EX + "knows": "?k"}
    want = P.bgp(g, [("?p", p, v) for p, v in preds.items()])
    assert rows(P.star(g, "?p", preds), "p", "l", "a", "k") == rows(want, "p", "l", "a", "k")
    multi = {EX + "age": "?a", EX + "contributesTo": "?x"}
    want = P.bgp(g, [("?p", p, v) for p, v in multi.items()])
    assert rows(P.star(g, "?p", multi), "p", "a", "x") == rows(want, "p", "a", "x")


def test_construct_skips_illegal_triples_and_counts_solutions(g):
    people = P.pattern(g, "?p", V.RDF_TYPE, EX + "Person")
    b = people.optional(P.pattern(g, "?p", EX + "worksFor", "?c"))
    b = b.optional(P.pattern(g, "?p", V.RDFS_LABEL, "?l"))
    out = forms.construct(b, [("?c", EX + "employs", "?p"), ("?l", EX + "names", "?p")])
    assert len(rows(out)) == 3
    pair = [("?p", EX + "a", "?p"), ("?p", EX + "b", "?p")]
    assert forms.construct(people, pair, limit=2).count() == 4


def test_ask_order_caps(g, spark):
    ages = P.pattern(g, "?p", EX + "age", "?a")
    assert forms.ask(ages).first()[0] is True
    assert forms.ask(ages.filter(F.lit(False))).first()[0] is False
    ordered = forms.select(ages, "p", order=[("a", "desc")], limit=2, offset=1)
    assert [r[0].replace(EX, "") for r in ordered.df.collect()] == ["bob", "erin"]
    assert forms.row_cap(None) == 100 and forms.row_cap(5000) == 1000 and forms.row_cap(7) == 7
    fifty = spark.range(50)
    cut = forms.truncated(fifty, 10).collect()
    assert len(cut) == 10 and all(r["truncated"] for r in cut)
    assert not any(r["truncated"] for r in forms.truncated(fifty, 50).collect())


def test_exists_inside_or(g):
    ages = P.pattern(g, "?p", EX + "age", "?a")
    works = P.pattern(g, "?p", EX + "worksFor", "?c")
    b = ages.filter_exists(works, lambda found: t.gt(F.col("a"), 50) | found)
    assert rows(b, "p") == [("alice",), ("bob",), ("carol",), ("dan",)]
    named = ages.filter_exists(
        works, lambda found: t.gt(F.col("a"), 50) | found, lambda l, r: t.gt(l("a"), 30) & (r("c") != "")
    )
    assert rows(named, "p") == [("alice",), ("bob",), ("dan",)]
    assert rows(ages.exists(works), "p") == [("alice",), ("bob",), ("carol",)]


def test_select_star_order_and_projection_rules(g):
    b = P.bgp(g, [("?p", EX + "worksFor", "?c"), ("?c", EX + "foundedBy", "?f")])
    assert b.variables == ["p", "c", "f"]
    with pytest.raises(ValueError):
        b.project("p", ("c", F.lit("x")))
    with pytest.raises(ValueError):
        b.project("p", "p")


def test_repeated_variable(spark):
    df = spark.createDataFrame([(None, "a", "p", "a"), (None, "a", "p", "b")], SCHEMA)
    assert rows(P.pattern(df, "?x", "?p", "?x")) == [("a", "p")]


def test_allowlists(g, spark):
    allowed = P.allow_graphs(g, ["http://other/"])
    assert allowed.where("g is not null").count() == 0 and allowed.where("g is null").count() > 0
    assert P.allow_graphs(g, []).count() == g.count()
    table = spark.createDataFrame([(EX + "employmentGraph",)], "g string")
    assert P.allow_graphs(g, table).count() == g.count()
    assert P.allow_path_predicates(g, [EX + "knows"]).select("p").distinct().count() == 1
