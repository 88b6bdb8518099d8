"""Evaluation jobs over case results taken from orders and their line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleframe.plans import evaluation as E
from tripleframe.queries import once, registry
from tripleframe.queries.graph import EX
from tripleframe.sources import relational as R

add = registry.add
c = F.col


def orders(spark, d):
    return R.read_tables(spark, d, "orders")["orders"]


# ---- bindings -------------------------------------------------------------------------------


@add(f"""WITH v AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS st FROM orders)
SELECT k, replace('ex:' || key, 'ex:', '{EX}') = '{EX}' || key AS prefixed, TRY_CAST(key AS DOUBLE) = TRY_CAST(key || '.0' AS DOUBLE) AS numeric,
st = split_part('"' || st || '"^^http://x', '"', 2) AS typed, TRY_CAST(cust AS DOUBLE) = TRY_CAST(key AS DOUBLE) AS differs,
coalesce(TRY_CAST(key || 'd' AS DOUBLE) = TRY_CAST(key AS DOUBLE), false) AS suffixed FROM v""")
def value_match(spark, d):
    key, cust = c("o_orderkey").cast("string"), c("o_custkey").cast("string")
    return orders(spark, d).select(
        c("o_orderkey").alias("k"), E.values_match(F.concat(F.lit("ex:"), key), F.concat(F.lit(EX), key)).alias("prefixed"),
        E.values_match(key, F.concat(key, F.lit(".0"))).alias("numeric"),
        E.values_match(c("o_orderstatus"), F.concat(F.lit('"'), c("o_orderstatus"), F.lit('"^^http://x'))).alias("typed"), E.values_match(key, cust).alias("differs"),
        E.values_match(F.concat(key, F.lit("d")), key).alias("suffixed"),
    )


@add("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderstatus AS st FROM orders)
SELECT CAST(c_custkey AS VARCHAR) AS case_id, 'one' AS expected_id, EXISTS (SELECT 1 FROM a WHERE k = c_custkey AND o = c_custkey * 10) AS matched FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'two', EXISTS (SELECT 1 FROM a WHERE k = c_custkey AND st = 'P') FROM customer""")
def match_expected_bindings(spark, d):
    o = orders(spark, d)
    actual = o.select(
        c("o_custkey").cast("string").alias("case_id"), c("o_orderkey").alias("row_id"),
        F.create_map(F.lit("Item"), F.concat(F.lit(EX), c("o_orderkey")), F.lit("person"), F.concat(F.lit(EX + "c"), c("o_custkey")), F.lit("State"), c("o_orderstatus")).alias("bindings"),
    )
    cust = R.read_tables(spark, d, "customer")["customer"]
    case = c("c_custkey").cast("string").alias("case_id")
    one = F.create_map(F.lit("x"), F.concat(F.lit("ex:"), (c("c_custkey") * 10).cast("string")))
    two = F.create_map(F.lit("p"), F.concat(F.lit("ex:c"), c("c_custkey").cast("string")), F.lit("st"), F.lit("P"))
    expected = cust.select(case, F.lit("one").alias("expected_id"), one.alias("bindings")).unionByName(cust.select(case, F.lit("two").alias("expected_id"), two.alias("bindings")))
    aliases = cust.select(case, F.lit("st").alias("name"), F.lit("state").alias("other"))
    return E.match_bindings(expected, actual, aliases).select("case_id", "expected_id", "matched")


@add("SELECT CAST(o_custkey AS VARCHAR) AS case_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS present FROM orders GROUP BY 1")
def binding_recall(spark, d):
    rows = orders(spark, d).select(c("o_custkey").cast("string").alias("case_id"), (c("o_orderstatus") == "F").alias("matched"))
    return E.binding_recall(rows)


@add("""WITH x AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS case_id, 'RESULT_MISMATCH: expected >= 12 rows, got ' || n AS failure FROM customer JOIN x ON k = c_custkey WHERE n < 12
UNION ALL SELECT c_custkey, 'RESULT_MISMATCH: expected <= 8 rows, got ' || n FROM customer JOIN x ON k = c_custkey WHERE c_acctbal > 5000 AND n > 8
UNION ALL SELECT c_custkey, 'RESULT_MISMATCH: expected ASK=true, got false' FROM customer JOIN x ON k = c_custkey WHERE n <= 10""")
def result_failures(spark, d):
    n = orders(spark, d).groupBy(c("o_custkey").alias("case_id")).agg(F.count(F.lit(1)).cast("int").alias("row_count"))
    observed = n.withColumn("answer", c("row_count") > 10)
    cust = R.read_tables(spark, d, "customer")["customer"]
    wanted = cust.select(c("c_custkey").alias("case_id"), F.lit(12).alias("min_rows"), F.when(c("c_acctbal") > 5000, 8).alias("max_rows"), F.lit(True).alias("ask"))
    return E.result_failures(wanted, observed)


# ---- case results of orders ------------------------------------------------------------------

_FAIL = """CASE o_orderpriority WHEN '1-URGENT' THEN ['MISSING_BINDING: a', 'MISSING_BINDING: b'] WHEN '2-HIGH' THEN CASE WHEN o_totalprice > 250000 THEN ['RESULT_MISMATCH: x'] ELSE [] END
WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'F' THEN ['UNEXPECTED_REFUSAL: y', 'INVALID_PLAN: z'] ELSE [] END WHEN '5-LOW' THEN CASE WHEN o_orderstatus = 'O' THEN ['SAFETY: s'] WHEN o_orderstatus = 'P' THEN ['INVALID_PLAN: t'] ELSE [] END ELSE [] END"""


@once
def case_results(spark, d):
    o = orders(spark, d)
    pr, st = c("o_orderpriority"), c("o_orderstatus")
    few = F.array().cast("array<string>")
    texts = lambda *x: F.array(*[F.lit(v) for v in x])
    failures = (
        F.when(pr == "1-URGENT", texts("MISSING_BINDING: a", "MISSING_BINDING: b"))
        .when((pr == "2-HIGH") & (c("o_totalprice") > 250000), texts("RESULT_MISMATCH: x"))
        .when((pr == "3-MEDIUM") & (st == "F"), texts("UNEXPECTED_REFUSAL: y", "INVALID_PLAN: z"))
        .when((pr == "5-LOW") & (st == "O"), texts("SAFETY: s"))
        .when((pr == "5-LOW") & (st == "P"), texts("INVALID_PLAN: t"))
        .otherwise(few)
    )
    month, day = F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    counts = {}
    for i, p in enumerate(E.PAIRS):
        counts[f"{p}_total"], counts[f"{p}_present"] = month + i, F.least(month, F.lit(6)) + i
    for p in E.FORBIDDEN:
        counts[f"{p}_total"], counts[f"{p}_violated"] = F.lit(4), F.when(st == "P", 1).otherwise(0)
    return o.select(
        c("o_orderkey").cast("string").alias("case_id"), (st != "P").alias("plan_generated"), (day > 3).alias("plan_valid"), F.when(day > 5, "q").alias("rendered_sparql"),
        (day > 7).alias("executed"), F.when(day > 9, day).alias("row_count"), failures.alias("failures"), (month == 1).alias("is_clarification_case"), (day > 15).alias("clarification_correct"),
        (month == 2).alias("is_unsafe_request_case"), (day > 20).alias("unsafe_request_rejected"), (month == 3).alias("repair_attempted"), ((month == 3) & (day < 10)).alias("repair_succeeded"),
        F.array_repeat(F.lit("m"), 3).alias("extracted_mentions"), F.when(st == "F", texts("m")).otherwise(few).alias("unresolved_mentions"), *[v.alias(k) for k, v in counts.items()],
    )


_CASES = f"cs AS (SELECT o_orderkey, o_orderstatus AS st, month(o_orderdate) AS mo, day(o_orderdate) AS dy, {_FAIL} AS fl FROM orders)"


def _ratio(top: str, bottom: str, neutral: str = "1.0") -> str:
    return f"coalesce(({top})::DOUBLE / nullif({bottom}, 0), {neutral})"


def _has(prefix: str) -> str:
    return f"len(list_filter(fl, lambda f: starts_with(f, '{prefix}'))) > 0"


def _recall(*offsets: int) -> str:
    return _ratio(" + ".join(f"sum(least(mo, 6) + {i})" for i in offsets), " + ".join(f"sum(mo + {i})" for i in offsets))


_REL = "mo NOT IN (1, 2)"
_BASE = {
    "valid_plan_rate": _ratio(f"count(*) FILTER ({_REL} AND dy > 3)", f"count(*) FILTER ({_REL})"),
    "render_success_rate": _ratio(f"count(*) FILTER ({_REL} AND dy > 5)", f"count(*) FILTER ({_REL})"),
    "execution_success_rate": _ratio(f"count(*) FILTER ({_REL} AND dy > 7)", f"count(*) FILTER ({_REL})"),
    "case_pass_rate": _ratio("count(*) FILTER (len(fl) = 0)", "count(*)"),
    "planner_output_rate": _ratio("count(*) FILTER (st <> 'P')", "count(*)"),
    "required_feature_recall": _recall(0),
    "forbidden_feature_violation_rate": _ratio("count(*) FILTER (st = 'P')", "4 * count(*)"),
    "term_resolution_accuracy": _ratio("3 * count(*) - count(*) FILTER (st = 'F')", "3 * count(*)"),
    "structural_plan_score": f"({_recall(0)}) * (1 - {_ratio("count(*) FILTER (st = 'P')", '4 * count(*)')})",
    "execution_result_accuracy": _ratio(f"count(*) FILTER (dy > 9 AND NOT {_has('RESULT_MISMATCH')})", "count(*) FILTER (dy > 9)"),
    "safety_violation_count": f"(count(*) FILTER ({_has('SAFETY:')}))::DOUBLE",
    "validation_error_rate": _ratio(f"count(*) FILTER ({_has('INVALID_PLAN')})", "count(*)"),
    "repair_attempted_rate": _ratio("count(*) FILTER (mo = 3)", "count(*)"),
    "repair_success_rate": _ratio("count(*) FILTER (mo = 3 AND dy < 10)", "count(*) FILTER (mo = 3)", "0.0"),
    "triple_pattern_recall": _recall(2),
    "filter_semantics_recall": _recall(3),
    "aggregate_semantics_recall": _recall(4),
    "grouping_semantics_recall": _recall(5, 6),
    "result_binding_accuracy": _recall(7),
    "forbidden_pattern_violation_rate": _ratio("count(*) FILTER (st = 'P')", "4 * count(*)"),
    "clarification_accuracy": _ratio("count(*) FILTER (mo = 1 AND dy > 15)", "count(*) FILTER (mo = 1)"),
    "unsafe_request_rejection_accuracy": _ratio("count(*) FILTER (mo = 2 AND dy > 20)", "count(*) FILTER (mo = 2)"),
    "total_cases": "count(*)::DOUBLE",
}
_METRICS = f"{_CASES}, mt AS (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, {v} AS value FROM cs" for k, v in _BASE.items()) + ")"


@add(f"WITH {_METRICS} SELECT metric, round(value, 9) AS value FROM mt")
def base_metrics(spark, d):
    return E.base_metrics(case_results(spark, d)).select("metric", F.round("value", 9).alias("value"))


@add(f"""WITH {_CASES} SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CASE WHEN len(fl) = 0 THEN NULL WHEN fl[1] LIKE 'MISSING%' THEN CASE WHEN dy > 7 AND dy > 9 THEN 'EVAL_FALSE_NEGATIVE' END
WHEN fl[1] LIKE 'UNEXPECTED%' THEN 'PLANNER_SCHEMA_INFERENCE_GAP' WHEN fl[1] LIKE 'SAFETY%' THEN NULL ELSE 'REAL_PLANNER_OUTPUT_ERROR' END AS cause FROM cs""")
def classify_failures(spark, d):
    cause = E.failure_class(c("failures"), c("executed"), c("row_count").isNotNull())
    return case_results(spark, d).select("case_id", cause.alias("cause"))


# ---- retrieval metrics ------------------------------------------------------------------------


def _cases(spark, d):
    o = orders(spark, d)
    return o.select(
        c("o_orderkey").cast("string").alias("case_id"), F.when(c("o_orderstatus") == "F", 1).otherwise(0).alias("unresolved"), F.when(c("o_orderpriority") == "5-LOW", 2).otherwise(0).alias("errors"),
    )


def _specs(spark, d):
    """Cases that expect the parts of their returned lines, named as terms, triples and paths."""
    lines = R.read_tables(spark, d, "lineitem")["lineitem"].where("l_returnflag = 'R'")
    part = F.concat(F.lit("ex:"), c("l_partkey").cast("string"))
    slot = lambda s, p, o: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"))
    by = c("l_linenumber") % 3
    return lines.select(
        c("l_orderkey").cast("string").alias("case_id"), F.array_compact(F.array(F.when(by == 0, part), F.lit("?x"), F.lit("LANG:en"), F.lit("plain"))).alias("required_terms"),
        F.array_compact(F.array(F.when(by == 1, slot(F.lit("?s"), part, F.lit("?_"))))).alias("required_triples"),
        F.array_compact(F.array(F.when(by == 2, slot(part, F.lit("$p"), F.lit("?o"))))).alias("required_property_paths"),
    )


@add("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS case_id, 'http://example.org/' || l_partkey AS iri FROM lineitem WHERE l_returnflag = 'R'")
def expected_iris(spark, d):
    return E.expected_iris(_specs(spark, d))


def _items(spark, d, order, keep=None):
    lines = R.read_tables(spark, d, "lineitem")["lineitem"]
    lines = lines if keep is None else lines.where(keep)
    best = lines.groupBy("l_orderkey", "l_partkey").agg(F.min(order).alias("rank"))
    key = c("l_partkey").cast("string")
    return best.select(
        c("l_orderkey").cast("string").alias("case_id"), F.concat(F.lit(EX), key).alias("iri"), F.concat(F.lit("ex:"), key).alias("prefixed_name"), (c("l_partkey") % 10).cast("string").alias("label"), "rank",
    )


@once
def retrieval_scores(spark, d):
    return E.retrieval_metrics(
        _cases(spark, d), E.expected_iris(_specs(spark, d)), _items(spark, d, c("l_linenumber")), _items(spark, d, F.floor("l_quantity").cast("int")),
        _items(spark, d, c("l_linenumber"), c("l_quantity") > 20), k=3,
    )


_RAG = """ex AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), rt AS (SELECT l_orderkey AS q, l_partkey AS k, min(l_linenumber) AS r FROM lineitem GROUP BY ALL),
re AS (SELECT l_orderkey AS q, l_partkey AS k, min(floor(l_quantity)) AS r FROM lineitem GROUP BY ALL), se AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS k FROM lineitem WHERE l_quantity > 20),
e AS (SELECT ex.q, ex.k, coalesce(rt.r < 3, false) AS t, coalesce(re.r < 3, false) AS r, se.k IS NOT NULL AS s FROM ex LEFT JOIN rt ON rt.q = ex.q AND rt.k = ex.k LEFT JOIN re ON re.q = ex.q AND re.k = ex.k LEFT JOIN se ON se.q = ex.q AND se.k = ex.k),
pc AS (SELECT q, count(*) AS n, count(*) FILTER (t) AS t, count(*) FILTER (s) AS s, bool_or(t OR r) AS el, bool_or(r AND NOT t) AS pr, bool_or(t AND NOT r) AS de FROM e GROUP BY q),
nr AS (SELECT q, count(*) AS n FROM rt GROUP BY q), ns AS (SELECT q, count(*) AS n, count(DISTINCT k % 10) < count(*) AS am FROM se GROUP BY q),
w AS (SELECT o_orderstatus AS st, o_orderpriority AS p, pc.*, coalesce(nr.n, 0) AS nr, coalesce(ns.n, 0) AS ns, coalesce(ns.am, false) AS am FROM orders LEFT JOIN pc ON pc.q = o_orderkey LEFT JOIN nr ON nr.q = o_orderkey LEFT JOIN ns ON ns.q = o_orderkey)"""
_RAG_METRICS = {
    "retrieval_concept_recall_at_3": _ratio("sum(t)", "sum(n)"),
    "retrieval_case_recall_at_3": _ratio("count(*) FILTER (t = n)", "count(n)"),
    "selected_concept_recall": _ratio("sum(s)", "sum(n)"),
    "selected_case_recall": _ratio("count(*) FILTER (s = n)", "count(n)"),
    "selected_precision": _ratio("sum(s)", "sum(ns)"),
    "mean_selected_candidates": _ratio("sum(ns)", "count(*)"),
    "mean_retrieved_candidates": _ratio("sum(nr)", "count(*)"),
    "unresolved_mention_rate": _ratio("count(*) FILTER (st = 'F')", "count(*)"),
    "concept_ambiguity_rate": _ratio("count(*) FILTER (am)", "count(*)"),
    "empty_selection_rate": _ratio("count(*) FILTER (nr > 0 AND ns = 0)", "count(*)"),
    "retrieval_error_rate": _ratio("count(*) FILTER (p = '5-LOW')", "count(*)"),
    "reranker_promotion_rate": _ratio("count(*) FILTER (pr)", "count(*) FILTER (el)", "0.0"),
    "reranker_demotion_error_rate": _ratio("count(*) FILTER (de)", "count(*) FILTER (el)", "0.0"),
}
_RAG_METRICS["retrieval_recall_at_3"] = _RAG_METRICS["retrieval_concept_recall_at_3"]
_RAG_METRICS["selected_concept_accuracy"] = _RAG_METRICS["selected_concept_recall"]
_RAG_METRICS["reranker_improvement_rate"] = _RAG_METRICS["reranker_promotion_rate"]
_RAG_SQL = f"{_RAG}, rm AS (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, {v} AS value FROM w" for k, v in _RAG_METRICS.items()) + ")"


@add(f"WITH {_RAG_SQL} SELECT metric, round(value, 9) AS value FROM rm")
def retrieval_metrics(spark, d):
    return retrieval_scores(spark, d).select("metric", F.round("value", 9).alias("value"))


# ---- comparing and grouping metrics ------------------------------------------------------------


@once
def all_metrics(spark, d):
    return E.combined_metrics(E.base_metrics(case_results(spark, d)), retrieval_scores(spark, d))


_ALL = f"WITH {_METRICS}, {_RAG_SQL}, am AS (SELECT * FROM mt UNION ALL SELECT * FROM rm UNION ALL SELECT 'planner_case_pass_rate', value FROM mt WHERE metric = 'case_pass_rate')"


@add(f"""{_ALL} SELECT metric, CASE WHEN metric IN ('selected_concept_accuracy', 'reranker_improvement_rate') THEN 'deprecated' WHEN metric IN ('selected_case_recall', 'selected_precision', 'retrieval_case_recall_at_3') THEN 'rag_case'
WHEN metric IN ('retrieval_concept_recall_at_3', 'selected_concept_recall', 'reranker_promotion_rate', 'reranker_demotion_error_rate') THEN 'rag_concept'
WHEN metric IN ('mean_selected_candidates', 'mean_retrieved_candidates', 'unresolved_mention_rate', 'concept_ambiguity_rate', 'empty_selection_rate', 'retrieval_error_rate', 'planner_case_pass_rate') THEN 'rag_other'
WHEN metric IN ('valid_plan_rate', 'render_success_rate', 'execution_success_rate', 'case_pass_rate', 'planner_output_rate', 'total_cases') THEN 'pipeline' ELSE 'quality' END AS section, round(value, 9) AS value FROM am""")
def metric_sections(spark, d):
    return all_metrics(spark, d).select("metric", E.metric_section(c("metric")).alias("section"), F.round("value", 9).alias("value"))


@add(f"""WITH {_METRICS}, ol AS (SELECT 0.5 AS v) SELECT metric || '_delta_vs_baseline' AS metric, round(value - 0.5, 9) AS value FROM mt WHERE metric IN ('case_pass_rate', 'valid_plan_rate', 'term_resolution_accuracy', 'execution_success_rate', 'result_binding_accuracy')
UNION ALL SELECT CASE metric WHEN 'case_pass_rate' THEN 'planner_case_pass_delta_vs_baseline' ELSE 'term_resolution_delta_vs_baseline' END, round(value - 0.5, 9) FROM mt WHERE metric IN ('case_pass_rate', 'term_resolution_accuracy')""")
def baseline_deltas(spark, d):
    now = E.base_metrics(case_results(spark, d))
    return E.baseline_deltas(now, now.withColumn("value", F.lit(0.5))).select("metric", F.round("value", 9).alias("value"))


@add(f"""WITH {_METRICS} SELECT metric, format('{{}}: expected >= 0.950, got {{:.3f}}', metric, value) AS failure FROM mt WHERE metric IN ('case_pass_rate', 'valid_plan_rate') AND value < 0.95
UNION ALL SELECT metric, format('{{}}: expected <= 0.000, got {{:.3f}}', metric, value) FROM mt WHERE metric = 'safety_violation_count' AND value > 0""")
def metric_gates(spark, d):
    gates = spark.createDataFrame(
        [("case_pass_rate", 0.95, None), ("valid_plan_rate", 0.95, None), ("safety_violation_count", None, 0.0), ("not_measured", 1.0, None)], "metric string, minimum double, maximum double"
    )
    return E.gate_failures(E.base_metrics(case_results(spark, d)), gates)


@add("""SELECT 'unresolved' AS condition, o_orderkey AS case_id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'errors', o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT 'empty_selection', o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000 UNION ALL SELECT 'promotions', o_orderkey FROM orders WHERE o_totalprice > 400000""")
def case_lists(spark, d):
    p = c("o_totalprice")
    rows = orders(spark, d).select(
        c("o_orderkey").alias("case_id"), (c("o_orderstatus") == "F").cast("int").alias("unresolved"), (c("o_orderpriority") == "5-LOW").cast("int").alias("errors"),
        F.when(p >= 1000, 3).otherwise(0).alias("retrieved"), F.when(p > 20000, 1).otherwise(0).alias("selected"), (p > 400000).cast("int").alias("promoted"),
    )
    return E.case_lists(rows)


@add("""SELECT count(*) AS total, count(*) FILTER (o_orderpriority <> '5-LOW') AS drafted, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice > 50000) AS executed, count(*) FILTER (o_totalprice > 50000 AND o_custkey > 10) AS answered FROM orders""")
def question_run_summary(spark, d):
    rows = orders(spark, d).select(
        F.when(c("o_orderpriority") != "5-LOW", "q").alias("query"), F.when(c("o_orderstatus") != "P", "ok").otherwise("failed").alias("status"),
        F.when(c("o_totalprice") <= 50000, "boom").alias("error"), F.when(c("o_custkey") > 10, 5).otherwise(0).alias("row_count"),
    )
    return E.run_summary(rows)


@add("""WITH a AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS k FROM lineitem WHERE l_linestatus = 'O')
SELECT q AS case_id, k AS iri, 'reported' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT q, k, 'resolved' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def term_differences(spark, d):
    lines = R.read_tables(spark, d, "lineitem")["lineitem"]
    of = lambda cond: lines.where(cond).select(c("l_orderkey").alias("case_id"), c("l_partkey").alias("iri"))
    return E.term_differences(of("l_returnflag = 'A'"), of("l_linestatus = 'O'"))
