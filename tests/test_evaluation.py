import pytest
from pyspark.sql import functions as F

from tripleframe.plans import evaluation as E

DEFAULTS = dict(
    plan_generated=True, plan_valid=True, rendered_sparql="q", executed=True, row_count=1, failures=[],
    is_clarification_case=False, clarification_correct=False, is_unsafe_request_case=False, unsafe_request_rejected=False,
    repair_attempted=False, repair_succeeded=False, extracted_mentions=[], unresolved_mentions=[],
)
COUNTS = [f"{p}_{s}" for p in E.PAIRS for s in ("total", "present")] + [f"{p}_{s}" for p in E.FORBIDDEN for s in ("total", "violated")]
TYPES = {bool: "boolean", int: "int", str: "string", list: "array<string>"}


def metrics(spark, *cases):
    rows = [{**DEFAULTS, **{c: 0 for c in COUNTS}, **c} for c in cases]
    names = list(DEFAULTS) + COUNTS
    schema = ", ".join(f"{n} {TYPES[type({**DEFAULTS, **{c: 0 for c in COUNTS}}[n])]}" for n in names)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    return {r["metric"]: r["value"] for r in E.base_metrics(df).collect()}


def test_base_metrics(spark):
    m = metrics(
        spark,
        dict(required_features_total=4, required_features_present=4, forbidden_features_total=2, expected_terms_total=3, expected_terms_present=3),
        dict(required_features_total=4, required_features_present=2, forbidden_features_total=2, forbidden_features_violated=1,
             expected_terms_total=3, expected_terms_present=1, plan_valid=False, failures=["INVALID_PLAN: foo"]),
    )
    assert m["required_feature_recall"] == 0.75 and m["forbidden_feature_violation_rate"] == 0.25
    assert m["term_resolution_accuracy"] == pytest.approx(4 / 6) and m["structural_plan_score"] == 0.5625
    assert m["validation_error_rate"] == 0.5 and m["valid_plan_rate"] == 0.5 and m["case_pass_rate"] == 0.5
    assert m["clarification_accuracy"] == 1.0 and m["repair_success_rate"] == 0.0 and m["total_cases"] == 2.0 and len(m) == 23


def test_special_cases_leave_plan_rates(spark):
    m = metrics(
        spark,
        dict(repair_attempted=True, repair_succeeded=True, extracted_mentions=["a", "b"], unresolved_mentions=["b"]),
        dict(is_clarification_case=True, clarification_correct=True, plan_valid=False, plan_generated=False, rendered_sparql=None, executed=False),
        dict(is_unsafe_request_case=True, plan_valid=False, executed=False, rendered_sparql=None, failures=["SAFETY: x"]),
        dict(failures=["RESULT_MISMATCH: y"], group_by_total=1, group_by_present=1, order_by_total=1),
    )
    assert m["valid_plan_rate"] == 1.0 and m["execution_success_rate"] == 1.0 and m["planner_output_rate"] == 0.75
    assert m["repair_success_rate"] == 1.0 and m["repair_attempted_rate"] == 0.25 and m["term_resolution_accuracy"] == 0.5
    assert m["unsafe_request_rejection_accuracy"] == 0.0 and m["safety_violation_count"] == 1.0
    assert m["execution_result_accuracy"] == 0.5 and m["grouping_semantics_recall"] == 0.5


def test_no_cases(spark):
    m = metrics(spark, dict())
    assert m["result_binding_accuracy"] == 1.0


ITEM = "case_id string, iri string, prefixed_name string, label string, rank int"


def rag(spark, cases, retrieved, reranked, selected, k=8):
    def items(rows):
        return spark.createDataFrame([(c, i, None, i, r) for c, i, r in rows], ITEM)

    c = spark.createDataFrame([(n, 0, 0) for n in cases], "case_id string, unresolved int, errors int")
    spec = [(n, None, [("?_", "ex:worksFor", "ex:Acme")], None) for n in cases]
    triple = "array<struct<subject:string,predicate:string,object:string>>"
    gold = spark.createDataFrame(spec, f"case_id string, required_terms array<string>, required_triples {triple}, required_property_paths {triple}")
    out = E.retrieval_metrics(c, E.expected_iris(gold), items(retrieved), items(reranked), items(selected), k)
    return {r["metric"]: r["value"] for r in out.collect()}


def test_case_recall_needs_every_iri(spark):
    rows = [("c1", "ex:worksFor", 0), ("c2", "ex:worksFor", 0), ("c2", "ex:Acme", 1)]
    m = rag(spark, ["c1", "c2"], rows, rows, rows)
    assert (m["retrieval_case_recall_at_8"], m["selected_case_recall"], m["retrieval_concept_recall_at_8"]) == (0.5, 0.5, 0.75)


def test_precision_promotion_demotion(spark):
    rows = [("c1", "ex:worksFor", 0), ("c1", "ex:Acme", 1), ("c1", "ex:Other", 2)]
    m = rag(spark, ["c1"], rows, rows, rows)
    assert m["selected_precision"] == pytest.approx(2 / 3) and m["mean_selected_candidates"] == 3.0
    late = [("c1", "ex:n1", 0), ("c1", "ex:n2", 1), ("c1", "ex:worksFor", 2), ("c1", "ex:Acme", 3)]
    early = [("c1", "ex:worksFor", 0), ("c1", "ex:Acme", 1)]
    m = rag(spark, ["c1"], late, early, early[:1], k=2)
    assert m["reranker_promotion_rate"] == 1.0 and m["reranker_demotion_error_rate"] == 0.0
    m = rag(spark, ["c1"], early, [("c1", "ex:n", 0), ("c1", "ex:Acme", 1)], [], k=2)
    assert m["reranker_demotion_error_rate"] == 1.0 and m["empty_selection_rate"] == 1.0


def test_prefixed_name_counts_as_second_iri(spark):
    df = spark.createDataFrame([("c", "http://a/x", "zz:x", None, 0), ("c", "http://example.org/y", "ex:y", None, 1)], ITEM)
    assert sorted(r["iri"] for r in E.item_iris(df).collect()) == ["http://a/x", "http://example.org/y", "zz:x"]


def test_expected_iris(spark):
    t = "array<struct<subject:string,predicate:string,object:string>>"
    df = spark.createDataFrame(
        [("c", ["?x", "LANG:x", "ex:a", "plain", "$y"], [("?_", "rdf:type", "ex:B")], [("ex:a", "ex:p", "?z")])],
        f"case_id string, required_terms array<string>, required_triples {t}, required_property_paths {t}",
    )
    got = sorted(r["iri"].rsplit("/", 1)[-1] for r in E.expected_iris(df).collect())
    assert got == ["22-rdf-syntax-ns#type", "B", "a", "p"]


def matched(spark, actual, expected, aliases=None):
    a = spark.createDataFrame([("c", i, r) for i, r in enumerate(actual)], "case_id string, row_id int, bindings map<string,string>")
    e = spark.createDataFrame([("c", 0, expected)], "case_id string, expected_id int, bindings map<string,string>")
    al = spark.createDataFrame([("c", k, v) for k, v in aliases], "case_id string, name string, other string") if aliases else None
    return E.match_bindings(e, a, al).first()["matched"]


def test_binding_matches(spark):
    alice, bob = "http://example.org/alice", "http://example.org/bob"
    assert matched(spark, [{"person": alice}, {"person": bob}], {"p": "ex:bob"})
    assert matched(spark, [{"A": alice, "B": bob}], {"a": "ex:alice", "b": "ex:bob"})
    assert not matched(spark, [{"A": bob, "B": alice}], {"a": "ex:alice", "b": "ex:bob"})
    assert not matched(spark, [{"person": alice}], {"person": "ex:dan"})
    assert not matched(spark, [{"only": alice}], {"a": "ex:alice", "b": "ex:alice"})
    assert matched(spark, [{"n": "2.0"}], {"count": "2"}) and matched(spark, [{"n": '"7"^^http://x'}], {"n": "7"})
    # columns need a name or an alias; there is no search over other columns
    assert matched(spark, [{"X": alice, "Q": bob}], {"a": "ex:alice", "zed": "ex:bob"}, [("a", "X"), ("zed", "Q")])
    assert not matched(spark, [{"X": alice, "Q": bob}], {"a": "ex:alice", "zed": "ex:bob"}, [("a", "X")])
    assert not matched(spark, [{"q1": bob, "q2": alice}], {"u": "ex:alice", "v": "ex:bob"})
    assert not matched(spark, [{"n": "1d"}], {"n": "1"})
    assert not matched(spark, [{"u": alice}, {"v": bob}], {"u": "ex:alice", "v": "ex:bob"})
    assert matched(spark, [{"person": alice, "s": bob}], {"p": "ex:bob", "a": "ex:alice"})


def test_recall_failures_classes(spark):
    m = spark.createDataFrame([("c", True), ("c", False), ("d", True)], "case_id string, matched boolean")
    assert {r["case_id"]: (r["total"], r["present"]) for r in E.binding_recall(m).collect()} == {"c": (2, 1), "d": (1, 1)}
    e = spark.createDataFrame([("a", 2, None, None), ("b", None, 1, None), ("c", None, None, True), ("d", 1, 5, None)], "case_id string, min_rows int, max_rows int, ask boolean")
    o = spark.createDataFrame([("a", 1, None), ("b", 3, None), ("c", None, False), ("d", 3, None)], "case_id string, row_count int, answer boolean")
    got = {r["case_id"]: r["failure"] for r in E.result_failures(e, o).collect()}
    assert got == {"a": "RESULT_MISMATCH: expected >= 2 rows, got 1", "b": "RESULT_MISMATCH: expected <= 1 rows, got 3", "c": "RESULT_MISMATCH: expected ASK=true, got false"}
    rows = [
        ([], True, True, None), (["MISSING_BINDING: x"], True, True, "EVAL_FALSE_NEGATIVE"), (["MISSING_BINDING: x"], True, False, None),
        (["UNEXPECTED_REFUSAL", "INVALID_PLAN"], False, False, "PLANNER_SCHEMA_INFERENCE_GAP"), (["x EXECUTION_ERROR"], True, False, "REAL_PLANNER_OUTPUT_ERROR"), (["other"], True, True, None),
    ]
    df = spark.createDataFrame(rows, "f array<string>, e boolean, r boolean, want string")
    for r in df.select("want", E.failure_class(F.col("f"), F.col("e"), F.col("r")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_gates_deltas_sections(spark):
    m = spark.createDataFrame([("case_pass_rate", 0.9), ("safety_violation_count", 1.0), ("x", 5.0)], "metric string, value double")
    g = spark.createDataFrame([("case_pass_rate", 0.95, None), ("safety_violation_count", None, 0.0), ("absent", 1.0, 1.0), ("x", 5.0, 5.0)], "metric string, minimum double, maximum double")
    assert sorted(r["failure"] for r in E.gate_failures(m, g).collect()) == ["case_pass_rate: expected >= 0.950, got 0.900", "safety_violation_count: expected <= 0.000, got 1.000"]
    old = spark.createDataFrame([("case_pass_rate", 0.5), ("x", 1.0)], "metric string, value double")
    assert {r["metric"]: round(r["value"], 3) for r in E.baseline_deltas(m, old).collect()} == {"case_pass_rate_delta_vs_baseline": 0.4, "planner_case_pass_delta_vs_baseline": 0.4}
    names = {"a_delta_vs_baseline": "delta", "retrieval_recall_at_8": "deprecated", "retrieval_case_recall_at_3": "rag_case", "retrieval_concept_recall_at_8": "rag_concept",
             "unresolved_mention_rate": "rag_other", "case_pass_rate": "pipeline", "triple_pattern_recall": "quality"}
    df = spark.createDataFrame([(n,) for n in names], "m string")
    assert {r[0]: r[1] for r in df.select("m", E.metric_section(F.col("m"))).collect()} == names


def test_lists_summary_differences(spark):
    c = spark.createDataFrame([("a", 1, 0, 2, 0, 0), ("b", 0, 1, 1, 1, 1)], "case_id string, unresolved int, errors int, retrieved int, selected int, promoted int")
    assert sorted(tuple(r) for r in E.case_lists(c).collect()) == [("empty_selection", "a"), ("errors", "b"), ("promotions", "b"), ("unresolved", "a")]
    runs = spark.createDataFrame([("q", "ok", None, 3), ("q", "ok", "boom", 0), (None, "skip", None, 0), ("q", "ok", None, 0)], "query string, status string, error string, row_count int")
    assert tuple(E.run_summary(runs).first()) == (4, 3, 2, 1)
    p = spark.createDataFrame([("c", "x"), ("c", "y")], "case_id string, iri string")
    s = spark.createDataFrame([("c", "y"), ("c", "z")], "case_id string, iri string")
    assert sorted(tuple(r) for r in E.term_differences(p, s).collect()) == [("c", "x", "reported"), ("c", "z", "resolved")]


def test_term_differences_in_one_shuffle_and_of_nulls(spark):
    of = lambda rows: spark.createDataFrame(rows, "case_id string, iri string")
    found = E.term_differences(of([("c", "x"), ("c", None), (None, "y"), ("c", "x")]), of([("c", None), ("d", None), ("c", "z")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    want = [(None, "y", "reported"), ("c", "x", "reported"), ("c", "z", "resolved"), ("d", None, "resolved")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_assignments_are_found_whenever_they_exist(spark):
    import itertools
    import random

    rng = random.Random(12)
    rows = [[["x2", "x1"], ["x2", "x3"], ["x2", "x3"]], [], [["a"]], [["a"], []], [["a"], ["a"]]]
    rows += [[rng.sample("abcdef", rng.randint(0, 4)) for _ in range(rng.randint(1, 6))] for _ in range(150)]

    def possible(row):
        return any(len(set(picked)) == len(row) for picked in itertools.product(*row))

    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, choices array<array<string>>")
    got = {r["i"]: r["ok"] for r in df.select("i", E._assignable(F.col("choices")).alias("ok")).collect()}
    assert got == {i: possible(r) for i, r in enumerate(rows)}


def test_aliases_make_way_for_each_other(spark):
    same = "http://example.org/v"
    extra = [("ka", "x1"), ("ka", "x2"), ("kb", "x2"), ("kb", "x3"), ("kc", "x2"), ("kc", "x3")]
    assert matched(spark, [{"x1": same, "x2": same, "x3": same}], {"ka": "ex:v", "kb": "ex:v", "kc": "ex:v"}, extra)
    assert not matched(spark, [{"x2": same, "x3": same}], {"ka": "ex:v", "kb": "ex:v", "kc": "ex:v"}, extra)
