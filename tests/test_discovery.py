import pytest
from pyspark.sql import functions as F

from tests.sample import EX, SCHEMA, quads
from tripleframe import vocab as V
from tripleframe.operators import patterns as P
from tripleframe.plans import discovery
from tripleframe.sources import records


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame(quads(), SCHEMA).cache()


def names(df, c="iri"):
    return sorted(r[c].replace(EX, "ex:").replace(V.RDFS, "rdfs:").replace(V.RDF, "rdf:") for r in df.collect())


def test_classes_and_properties(g):
    assert names(discovery.classes(g)) == ["ex:Company", "ex:Person", "ex:Project", "rdf:Property", "rdfs:Class"]
    assert names(discovery.classes(g, cap=2)) == ["ex:Company", "ex:Person"]
    props = {r["iri"]: r for r in discovery.properties(g).collect()}
    works = props[EX + "worksFor"]
    assert works["label"] == "works for"
    assert works["observed_domain"] == [EX + "Person"] and works["observed_range"] == [EX + "Company"]
    assert props[EX + "age"]["observed_range"] == [V.XSD + "integer"]
    assert V.RDF_TYPE in props and len(props) == 8


def test_declared_domain_range(spark):
    rows = [(None, "http://p", V.RDFS + d, o) for d, o in (("domain", "http://A"), ("range", "http://B"), ("range", "http://C"))]
    got = discovery.declared_domain_range(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got["domain"], got["range"]) == (["http://A"], ["http://B", "http://C"])


def test_individuals_and_graphs(g):
    found = discovery.individuals(g)
    assert names(found) == sorted("ex:" + n for n in ("Acme", "Globex", "alice", "bob", "carol", "dan", "erin", "ProjectA", "ProjectB", "ProjectC"))
    assert names(discovery.named_graphs(g)) == ["ex:employmentGraph"]


def test_snapshot_status_concepts(g, spark, tmp_path):
    snap = discovery.snapshot(g)
    assert {r["kind"]: r["n"] for r in discovery.status(snap).collect()} == {"class": 5, "property": 8, "individual": 10, "graph": 1}
    assert snap.where(F.col("iri") == EX + "worksFor").first()["prefixed_name"] == "ex:worksFor"
    concept = discovery.concepts(snap).where(F.col("iri") == EX + "worksFor").first()
    assert (concept["domain"], concept["range"]) == ([EX + "Person"], [EX + "Company"])
    records.write_schema(snap, str(tmp_path / "schema"))
    assert spark.read.json(str(tmp_path / "schema")).count() == 24


def test_refresh_respects_age(g, spark, tmp_path):
    path = str(tmp_path / "snap")
    first, done, notes = discovery.refresh(spark, g, path)
    assert done and not notes and first.count() == 24
    assert discovery.refresh(spark, g, path)[1] is False
    assert discovery.refresh(spark, g, path, force=True)[1] is True
    assert discovery.refresh(spark, g, path, ttl_seconds=0.0)[1] is True


def test_prefixes(spark):
    df = spark.createDataFrame([("rdf:type",), ("zz:a",), ("http://x/rdf:y",), ("plain",)], "x string")
    got = [r[0] for r in df.select(P.expand_prefixed(F.col("x"))).collect()]
    assert got == [V.RDF_TYPE, "zz:a", "http://x/rdf:y", "plain"]
    table = {"a": "http://e/", "b": "http://e/x/"}
    df = spark.createDataFrame([("http://e/x/y",), ("http://e/y",), ("http://e/x/y/z",), ("http://q/",)], "x string")
    got = [r[0] for r in df.select(P.to_prefixed(F.col("x"), table)).collect()]
    assert got == ["b:y", "a:y", None, None]


def scans(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("Initial Plan")[0].count("FileScan")


def test_one_scan_makes_all_sections(g, spark, tmp_path):
    g.write.parquet(f"{tmp_path}/g")
    stored = spark.read.parquet(f"{tmp_path}/g")
    assert scans(discovery.node_sets(stored)) == 1
    profile = discovery.Profile(stored)
    for section in (discovery.properties, discovery.classes, discovery.individuals, discovery.observed_range):
        assert scans(section(profile)) == 0
        assert sorted(map(str, section(profile).collect())) == sorted(map(str, section(stored).collect()))
    assert scans(discovery.snapshot(stored)) == 1  # the graphs; the rest is the profile's


def test_what_sections_read_again_is_written_once(g):
    """A section groups no nodes: characteristic sets and declared nodes are tables, and literals make no node of their own."""
    profile = discovery.Profile(g)
    for df in (profile.characteristic, profile.declared):
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert profile.nodes.where("node IS NULL").count() == 0
    assert profile.characteristic.agg(F.sum("n")).first()[0] == profile.nodes.count()


def test_sets_of_a_graph_with_odd_rows(spark):
    rows = [
        (None, "_:b", V.RDF_TYPE, "http://C"), (None, "http://a", "http://p", "_:b"), (None, "http://a", "http://p", '"x"@en'),
        (None, "http://a", "http://p", '"x"'), (None, "http://a", "http://q", "http://nowhere"), ("http://g", "http://z", "http://only", "http://a"),
        (None, "http://C", V.SKOS + "prefLabel", '"see"'), (None, "http://D", V.RDF_TYPE, V.OWL + "Class"), (None, "http://a", V.RDF_TYPE, '"odd"'),
    ]
    g = spark.createDataFrame(rows * 2, SCHEMA)
    assert {(r["iri"], r["type"]) for r in discovery.observed_range(g).collect()} == {
        ("http://p", "http://C"), ("http://p", V.RDF + "langString"), ("http://p", V.XSD + "string"), (V.SKOS + "prefLabel", V.XSD + "string"),
        (V.RDF_TYPE, V.XSD + "string"),
    }
    assert {r["iri"]: r["label"] for r in discovery.classes(g).collect()} == {"http://C": None, "http://D": None, V.OWL + "Class": None}
    assert names(discovery.property_names(g)) == sorted(["http://p", "http://q", "rdf:type", V.SKOS + "prefLabel"])
    assert names(discovery.individuals(g)) == ["http://a"]
    assert discovery.snapshot(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_failed_section_keeps_its_last_version(g, spark, tmp_path):
    path = str(tmp_path / "snap")
    assert discovery.stored_snapshot(spark, path).count() == 0
    discovery.refresh(spark, g, path)

    def half(quads):
        made = discovery.sections(quads.where(F.col("s") != EX + "dan"))
        broken = made["property"].withColumn("label", F.raise_error(F.lit("no properties today")))
        return {**made, "property": broken}

    terms, done, notes = discovery.refresh(spark, g, path, force=True, build=half)
    assert done and list(notes) == ["property"]
    counts = {r["kind"]: r["n"] for r in discovery.status(terms).collect()}
    assert counts == {"class": 5, "property": 8, "individual": 9, "graph": 1}
    assert sorted(map(str, discovery.stored_snapshot(spark, path).collect())) == sorted(map(str, terms.collect()))
