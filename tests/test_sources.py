import json

from pyspark.sql import functions as F

from tests.sample import SCHEMA, quads
from tripleframe import vocab as V
from tripleframe.sources import rdf, records, results


def test_statements_round_trip(spark, tmp_path):
    rows = quads() + [(None, "_:b1", "http://p", '"tab\t \\ "q" \n\r é😀"@en'), (None, "http://s", "http://p", '""')]
    df = spark.createDataFrame(rows, SCHEMA)
    rdf.write_statements(df.select("s", "p", "o", "g").where("g is not null"), str(tmp_path / "a"))
    rdf.write_statements(df.where("g is null").select("s", "p", "o"), str(tmp_path / "b"))
    good, bad = rdf.read_quads(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(map(tuple, good.collect()), key=str) == sorted(rows, key=str)
    assert bad.count() == 0


def test_statement_syntax(spark, tmp_path):
    lines = [
        r'<http://a> <http://p> "x\"y\\n\né\U0001F600\\u0041"@EN .', '# note', '', '_:b <http://p> <http://o> . # hi', "nonsense",
        '<http://a> <http://p> "5"^^<http://www.w3.org/2001/XMLSchema#string> <http://g> .', '<http://a> "lit" <http://o> .',
        r'<http://ab> <http://p> "\U00000041" .',
    ]
    path = tmp_path / "x.nq"
    path.write_text("\n".join(lines))
    good, bad = rdf.read_quads(spark, str(path))
    got = {tuple(r) for r in good.collect()}
    assert got == {
        (None, "http://a", "http://p", '"x"y\\n\né😀\\u0041"@en'), (None, "_:b", "http://p", "http://o"), ("http://g", "http://a", "http://p", '"5"'),
        (None, "http://ab", "http://p", '"A"'),
    }
    assert bad.count() == 2


def test_quads_layout_prunes(spark, tmp_path):
    df = spark.createDataFrame(quads(), SCHEMA)
    rdf.write_quads(df, str(tmp_path / "q"))
    back = spark.read.parquet(str(tmp_path / "q"))
    assert back.count() == df.count()
    plan = back.where(F.col("p") == V.RDF_TYPE).select("s")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan
    rdf.write_quads(df, str(tmp_path / "r"), by_predicate=False)
    plan = spark.read.parquet(str(tmp_path / "r")).where(F.col("p") == V.RDF_TYPE)._jdf.queryExecution().toString()
    assert "EqualTo(p," in plan


def test_result_documents(spark, tmp_path):
    docs = {
        "a": {"head": {"vars": ["x", "y"]}, "results": {"bindings": [
            {"x": {"type": "uri", "value": "http://a"}, "y": {"type": "typed-literal", "value": "5", "datatype": V.XSD + "integer"}},
            {"x": {"type": "bnode", "value": "b0"}, "y": {"type": "triple", "value": "v"}}, {"y": {"type": "literal", "value": "v", "xml:lang": "EN"}}]}},
        "b": [1], "c": {"head": {}, "results": {"bindings": []}}, "d": {"head": {"vars": []}, "results": {"bindings": {}}}, "f": {"boolean": True}, "g": {"boolean": "x"},
    }
    for n, d in docs.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "e.json").write_text("{nope")
    read = results.read_documents(spark, str(tmp_path))
    name = F.regexp_extract("source", r"([a-z])\.json$", 1)
    errors = {r[0]: r[1] for r in results.check_select(read).select(name, "error").collect()}
    assert errors == {"a": None, "b": "not a JSON object", "c": "missing head.vars", "d": "missing results.bindings array", "e": "not valid JSON", "f": "missing head.vars", "g": "missing head.vars"}
    asks = {r[0]: (r[1], r[2]) for r in results.check_ask(read).select(name, "error", "answer").collect()}
    assert asks["f"] == (None, True) and asks["g"][0] == "boolean is not a JSON boolean" and asks["a"][0] == "missing boolean"
    got = {tuple(r) for r in results.select_bindings(read, ["x", "y"]).df.collect()}
    assert got == {("http://a", f'"5"^^{V.XSD}integer'), ("_:b0", None), (None, '"v"@en')}
    assert results.result_variables(read).where(name == "a").first()["variables"] == ["x", "y"]


def test_payloads(spark):
    pl = spark.createDataFrame([('{"iri":"http://a","aliases":"one","kind":"zz","domain":["d",null,3],"extra":5,"label":"","range":{"a":1}}',), ('{"iri":5}',), ("{}",), ('{"iri":"x","kind":"class"}',)], "payload string")
    good, bad = records.concepts_from_payloads(pl)
    got = {r["iri"]: r for r in good.collect()}
    a = got["http://a"]
    assert (a["aliases"], a["kind"], a["domain"], a["range"], a["label"], a["metadata"]) == (["one"], "unknown", ["d", "3"], [], None, {"extra": "5"})
    assert got["x"]["kind"] == "class" and bad.count() == 2


def test_cases_metrics_urls(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text(json.dumps({"case_id": "c", "question": "q", "required_terms": ["ex:a"], "expected_bindings": [{"p": "ex:b"}]}) + "\n")
    case = records.read_cases(spark, str(tmp_path / "cases.jsonl")).first()
    assert case["expected_bindings"] == [{"p": "ex:b"}]
    m = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "metric string, value double")
    records.write_report(m, m, m, str(tmp_path / "rep"))
    assert [r["metric"] for r in spark.read.json(str(tmp_path / "rep" / "metrics")).collect()] == ["a", "b"]
    (tmp_path / "base.json").write_text('{"metrics": {"a": 1, "b": "text", "c": true}, "cases": []}')
    (tmp_path / "flat.json").write_text('{"a": 0.5}')
    assert {r["metric"]: r["value"] for r in records.read_metrics(spark, str(tmp_path / "base.json")).collect()} == {"a": 1.0, "c": 1.0}
    assert [tuple(r) for r in records.read_metrics(spark, str(tmp_path / "flat.json")).collect()] == [("a", 0.5)]
    df = spark.createDataFrame([("http://u:p@Host:80/a/b?q=1",), ("https://h/x#f",), ("",), ("http://h:8080",)], "u string")
    assert [r[0] for r in df.select(records.redact_url(F.col("u"))).collect()] == ["http://host:80/a/b", "https://h/x", "", "http://h:8080"]
