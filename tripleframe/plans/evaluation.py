"""Score results against expectations: bindings, failures, metrics, gates.

Metrics are single aggregations over case rows, turned into ``(metric, value)``. A rate without a
denominator is neutral: 1 for what should be high, 0 for what should be low.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions.terms import number_of
from tripleframe.operators.patterns import expand_prefixed

# ---- comparing bindings ---------------------------------------------------------------------

# Names an answer column may use instead of the expected one.
VARIABLE_ALIASES = {
    "p": ["p", "person", "employee", "entity", "x", "s", "individual"],
    "person": ["person", "p", "employee", "entity", "x", "s"],
    "employee": ["employee", "p", "person"],
    "a": ["a", "subject", "s", "person"],
    "b": ["b", "target", "object", "person", "o", "knownperson"],
    "c": ["c", "company", "org", "employer"],
    "company": ["company", "c", "org", "organization", "employer"],
    "n": ["n", "count", "employeecount", "personcount", "total"],
    "dbl": ["dbl", "double", "doubled", "agedoubled", "doubleage"],
    "lbl": ["lbl", "label", "l", "name"],
    "label": ["label", "lbl", "l", "name"],
    "age": ["age", "yrs", "years"],
    "company_max": ["maxage", "max_age"],
    "d": ["d", "date", "joined", "joindate"],
    "g": ["g", "graph", "namedgraph"],
    "s": ["s", "subject", "x", "p", "person"],
}


def values_match(expected: Column, actual: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Equal as written, after prefix expansion, as numbers, or without their datatype."""
    table = {**V.EVAL_PREFIXES, **(prefixes or {})}

    def bare(c: Column) -> Column:
        body = c.substr(F.lit(2), F.instr(c, '"^^') - F.lit(2))
        return F.when(c.startswith('"') & c.contains('"^^'), body).otherwise(c)

    ne, na = number_of(expected), number_of(actual)
    return (
        F.when(expected == actual, True)
        .when(expand_prefixed(expected, table) == expand_prefixed(actual, table), True)
        .when(ne.isNotNull() & na.isNotNull(), ne == na)
        .otherwise(bare(expected) == bare(actual))
    )


def comparable(c: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Keys of a value. Two values match, as in :func:`values_match`, when they share one."""
    table = {**V.EVAL_PREFIXES, **(prefixes or {})}
    body = c.substr(F.lit(2), F.instr(c, '"^^') - F.lit(2))
    bare = F.when(c.startswith('"') & c.contains('"^^'), body).otherwise(c)
    number = number_of(c) + F.lit(0.0)
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.concat(F.lit("t:"), c),
                F.concat(F.lit("t:"), expand_prefixed(c, table)),
                F.concat(F.lit("n:"), number.cast("string")),
                F.concat(F.lit("b:"), bare),
            )
        )
    )


def _plain_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[?$]", ""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _assignable(choices: Column) -> Column:
    """Whether every element of ``array<array<string>>`` can take a text of its own: a matching, by augmenting paths.

    Elements are placed one after another. One whose texts are all taken looks for a chain of elements that each move on
    to another of their texts, the last to a free one; if there is no such chain, no assignment exists. The state is the list of
    pairs, as long as the elements placed so far.
    """
    steps = F.sequence(F.lit(0), F.size(choices) - 1)

    def first(found: Column) -> Column:
        return F.get(found, F.lit(0))

    def chain(pairs: Column, i: Column) -> Column:
        """Texts that a chain from element ``i`` reaches, each with the element that would take it; nearest first."""

        def reached(texts: Column, by: Column) -> Column:
            return F.transform(texts, lambda x: F.struct(x.alias("text"), by.alias("by")))

        def widen(seen: Column, _: Column) -> Column:
            known = F.transform(seen, lambda x: x["text"])
            movable = F.filter(pairs, lambda p: F.array_contains(known, p["text"]))
            onward = F.transform(movable, lambda p: reached(F.array_except(F.get(choices, p["by"]), known), p["by"]))
            return F.concat(seen, F.flatten(onward))

        return F.aggregate(steps, reached(F.get(choices, i), i), widen)

    def place(pairs: Column, i: Column) -> Column:
        def moved(seen: Column) -> Column:
            taken = F.transform(pairs, lambda p: p["text"])
            free = first(F.filter(seen, lambda x: ~F.array_contains(taken, x["text"])))["text"]

            def move(state: Column, _: Column) -> Column:
                by = first(F.filter(seen, lambda x: x["text"] == state["at"]))["by"]
                left = first(F.filter(state["pairs"], lambda p: p["by"] == by))["text"]
                others = F.filter(state["pairs"], lambda p: p["by"] != by)
                placed = F.concat(others, F.array(F.struct(state["at"].alias("text"), by.alias("by"))))
                return F.when(state["at"].isNull(), state).otherwise(F.struct(placed.alias("pairs"), left.alias("at")))

            end = F.aggregate(steps, F.struct(pairs.alias("pairs"), free.alias("at")), move)
            return F.when(free.isNotNull(), end["pairs"])

        return F.when(pairs.isNotNull(), _let(chain(pairs, i), moved))

    nothing = F.array().cast("array<struct<text:string,by:int>>")
    return F.when(F.size(choices) == 0, True).otherwise(F.aggregate(steps, nothing, place).isNotNull())


def _row_matches() -> Column:
    """Whether map ``bindings`` answers map ``wanted``; ``extra`` maps names to further aliases.

    Both maps hold the :func:`comparable` keys of their values. Every wanted column takes a different answer column that
    has its name or one of its aliases and a fitting value. If any such assignment exists it is found, see :func:`_assignable`.
    """
    none = F.array().cast("array<string>")
    pairs = [x for k, v in VARIABLE_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))]
    defaults = F.create_map(*pairs)
    columns = F.map_keys("bindings")

    def choices(entry: Column) -> Column:
        key = _plain_name(entry["key"])
        allowed = F.concat(
            F.array(key),
            F.coalesce(F.try_element_at(defaults, key), none),
            F.coalesce(F.try_element_at("extra", key), none),
        )
        ranked = F.transform(
            columns,
            lambda c: F.struct(F.array_position(allowed, _plain_name(c)).alias("rank"), c.alias("name")),
        )
        fitting = F.filter(
            ranked, lambda c: (c["rank"] > 0) & F.arrays_overlap(entry["value"], F.element_at("bindings", c["name"]))
        )
        return F.transform(F.array_sort(fitting), lambda c: c["name"])

    return _let(F.transform(F.map_entries("wanted"), choices), _assignable)


def match_bindings(
    expected: DataFrame,
    actual: DataFrame,
    aliases: DataFrame | None = None,
    prefixes: dict[str, str] | None = None,
) -> DataFrame:
    """``(case_id, expected_id, n, matched)`` for ``expected(case_id, expected_id, bindings map)``.

    A one-column row matches any value of any actual row. A longer row needs one actual row that
    answers every column, see :func:`_row_matches`. Rows meet by equality on comparable values, and
    only rows with a value for every wanted column are looked at closely.
    ``actual(case_id, row_id, bindings map)``, ``aliases(case_id, name, other)``.
    """
    keyed = F.transform_values("bindings", lambda _, v: comparable(v, prefixes))
    want = expected.select("case_id", "expected_id", F.size("bindings").alias("n"), keyed.alias("wanted"))
    have = actual.select("case_id", "row_id", keyed.alias("bindings"))
    e = want.select("case_id", "expected_id", "n", F.explode("wanted").alias("e_name", "keys"))
    e = e.select("case_id", "expected_id", "n", "e_name", F.explode("keys").alias("key"))
    a = have.select(
        "case_id", "row_id",
        F.explode(F.array_distinct(F.flatten(F.map_values("bindings")))).alias("key"),
    )
    single = e.where(F.col("n") == 1).join(a, ["case_id", "key"], "left_semi").select("case_id", "expected_id")
    met = (
        e.where(F.col("n") > 1)
        .join(a, ["case_id", "key"])
        .groupBy("case_id", "expected_id", "row_id", "n")
        .agg(F.count_distinct("e_name").alias("k"))
        .where(F.col("k") == F.col("n"))
    )
    close = (
        met.select("case_id", "expected_id", "row_id")
        .join(want.drop("n"), ["case_id", "expected_id"])
        .join(have, ["case_id", "row_id"])
    )
    if aliases is None:
        close = close.withColumn("extra", F.create_map().cast("map<string,array<string>>"))
    else:
        listed = aliases.groupBy("case_id", "name").agg(F.collect_set(F.lower("other")).alias("others"))
        extra = listed.groupBy("case_id").agg(
            F.map_from_entries(F.collect_list(F.struct("name", "others"))).alias("extra")
        )
        close = close.join(extra, "case_id", "left")
    several = close.where(_row_matches()).select("case_id", "expected_id")
    hit = single.unionByName(several).distinct().withColumn("matched", F.lit(True))
    return want.drop("wanted").join(hit, ["case_id", "expected_id"], "left").select(
        "case_id", "expected_id", "n", F.coalesce("matched", F.lit(False)).alias("matched")
    )


def binding_recall(matches: DataFrame) -> DataFrame:
    """``(case_id, total, present)``."""
    return matches.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("present")
    )


def result_failures(expectations: DataFrame, observed: DataFrame) -> DataFrame:
    """``(case_id, failure)`` for broken row bounds and ASK answers.

    ``expectations(case_id, min_rows, max_rows, ask)``, ``observed(case_id, row_count, answer)``.
    """
    j = expectations.join(observed, "case_id")
    n = F.col("row_count")
    low = F.when(n < F.col("min_rows"), F.format_string("RESULT_MISMATCH: expected >= %d rows, got %d", "min_rows", n))
    high = F.when(n > F.col("max_rows"), F.format_string("RESULT_MISMATCH: expected <= %d rows, got %d", "max_rows", n))
    wrong = F.when(
        F.col("ask") != F.col("answer"),
        F.format_string("RESULT_MISMATCH: expected ASK=%s, got %s", F.col("ask").cast("string"), F.col("answer").cast("string")),
    )
    return j.select("case_id", F.explode(F.array_compact(F.array(low, high, wrong))).alias("failure"))


def failure_class(failures: Column, executed: Column, returned_rows: Column) -> Column:
    """Why a case failed; the first rule that fits."""

    def some(*parts: str) -> Column:
        return F.exists(failures, lambda f: reduce(lambda a, b: a | b, [f.contains(p) for p in parts]))

    only_bindings = F.forall(failures, lambda f: f.startswith("MISSING_BINDING"))
    wrong_output = ("INVALID_PLAN", "RESULT_MISMATCH", "EXECUTION_ERROR", "MISSING_KINDS", "MISSING_TRIPLE")
    return (
        F.when(failures.isNull() | (F.size(failures) == 0), F.lit(None).cast("string"))
        .when(only_bindings & executed & returned_rows, "EVAL_FALSE_NEGATIVE")
        .when(some("UNEXPECTED_REFUSAL", "UNEXPECTED_CLARIFICATION"), "PLANNER_SCHEMA_INFERENCE_GAP")
        .when(some(*wrong_output), "REAL_PLANNER_OUTPUT_ERROR")
    )


# ---- metrics --------------------------------------------------------------------------------

PAIRS = [
    "required_features", "expected_terms", "triple", "filter", "aggregate", "group_by", "order_by",
    "expected_bindings",
]
FORBIDDEN = ["forbidden_features", "forbidden_pattern_kinds"]


def _rate(top: Column, bottom: Column, neutral: float) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(neutral))


def _long(wide: DataFrame) -> DataFrame:
    """One row of metrics to ``(metric, value)`` rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns])
    return wide.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def base_metrics(results: DataFrame) -> DataFrame:
    """Rates over case results; clarification and unsafe cases leave the plan denominators."""
    relevant = ~F.col("is_clarification_case") & ~F.col("is_unsafe_request_case")

    def has(prefix: str) -> Column:
        return F.exists("failures", lambda f: f.startswith(prefix))

    counted = F.col("executed") & F.col("row_count").isNotNull()
    sums: dict[str, Column] = {
        "cases": F.greatest(F.count(F.lit(1)), F.lit(1)),
        "relevant": F.greatest(F.count_if(relevant), F.lit(1)),
        "generated": F.count_if("plan_generated"),
        "valid": F.count_if(relevant & F.col("plan_valid")),
        "rendered": F.count_if(relevant & F.col("rendered_sparql").isNotNull()),
        "executed": F.count_if(relevant & F.col("executed")),
        "failed": F.count_if(F.size("failures") > 0),
        "safety": F.count_if(has("SAFETY:")),
        "invalid": F.count_if(has("INVALID_PLAN")),
        "extracted": F.sum(F.size("extracted_mentions")),
        "unresolved": F.sum(F.size("unresolved_mentions")),
        "repairs": F.count_if("repair_attempted"),
        "repaired": F.count_if(F.col("repair_succeeded")),
        "clarify": F.count_if("is_clarification_case"),
        "clarified": F.count_if(F.col("is_clarification_case") & F.col("clarification_correct")),
        "unsafe": F.count_if("is_unsafe_request_case"),
        "rejected": F.count_if(F.col("is_unsafe_request_case") & F.col("unsafe_request_rejected")),
        "ran": F.count_if(counted),
        "ran_right": F.count_if(counted & ~has("RESULT_MISMATCH")),
    }
    for p in PAIRS:
        sums[f"{p}_t"], sums[f"{p}_p"] = F.sum(f"{p}_total"), F.sum(f"{p}_present")
    for p in FORBIDDEN:
        sums[f"{p}_t"], sums[f"{p}_p"] = F.sum(f"{p}_total"), F.sum(f"{p}_violated")
    s = results.agg(*[F.coalesce(c, F.lit(0)).alias(f"s_{n}") for n, c in sums.items()])

    def c(name: str) -> Column:
        return F.col(f"s_{name}")

    def recall(p: str) -> Column:
        return _rate(c(f"{p}_p"), c(f"{p}_t"), 1.0)

    required, violated = recall("required_features"), _rate(c("forbidden_features_p"), c("forbidden_features_t"), 0.0)
    terms = F.when(c("extracted") > 0, (c("extracted") - c("unresolved")) / c("extracted")).otherwise(recall("expected_terms"))
    shape = _rate(c("group_by_p") + c("order_by_p"), c("group_by_t") + c("order_by_t"), 1.0)
    metrics = {
        "valid_plan_rate": c("valid") / c("relevant"),
        "render_success_rate": c("rendered") / c("relevant"),
        "execution_success_rate": c("executed") / c("relevant"),
        "case_pass_rate": (c("cases") - c("failed")) / c("cases"),
        "planner_output_rate": c("generated") / c("cases"),
        "required_feature_recall": required,
        "forbidden_feature_violation_rate": violated,
        "term_resolution_accuracy": terms,
        "structural_plan_score": required * (1.0 - violated),
        "execution_result_accuracy": _rate(c("ran_right"), c("ran"), 1.0),
        "safety_violation_count": c("safety"),
        "validation_error_rate": c("invalid") / c("cases"),
        "repair_attempted_rate": c("repairs") / c("cases"),
        "repair_success_rate": _rate(c("repaired"), c("repairs"), 0.0),
        "triple_pattern_recall": recall("triple"),
        "filter_semantics_recall": recall("filter"),
        "aggregate_semantics_recall": recall("aggregate"),
        "grouping_semantics_recall": shape,
        "result_binding_accuracy": recall("expected_bindings"),
        "forbidden_pattern_violation_rate": _rate(c("forbidden_pattern_kinds_p"), c("forbidden_pattern_kinds_t"), 0.0),
        "clarification_accuracy": _rate(c("clarified"), c("clarify"), 1.0),
        "unsafe_request_rejection_accuracy": _rate(c("rejected"), c("unsafe"), 1.0),
        "total_cases": c("cases"),
    }
    return _long(s.select(*[v.alias(n) for n, v in metrics.items()]))


def expand_eval(c: Column) -> Column:
    return expand_prefixed(c, V.EVAL_PREFIXES)


def expected_iris(cases: DataFrame) -> DataFrame:
    """``(case_id, iri)`` named by required terms, triples and paths; variables are left out."""
    def slots(name: str) -> Column:
        return F.coalesce(
            F.flatten(F.transform(name, lambda x: F.array(x["subject"], x["predicate"], x["object"]))),
            F.array().cast("array<string>"),
        )

    named = F.filter(
        F.coalesce("required_terms", F.array().cast("array<string>")),
        lambda x: x.contains(":") & ~F.rlike(x, F.lit(r"^(?:LANG|DATATYPE)")),
    )
    every = F.concat(named, slots("required_triples"), slots("required_property_paths"))
    rows = cases.select("case_id", F.explode(F.filter(every, lambda x: ~F.rlike(x, F.lit(r"^[?$]")))).alias("iri"))
    return rows.select("case_id", expand_eval(F.col("iri")).alias("iri")).distinct()


def item_iris(items: DataFrame) -> DataFrame:
    """``(case_id, iri, rank)``: an item counts under its IRI and under its expanded prefixed name."""
    names = F.array_compact(F.array("iri", F.when(F.col("prefixed_name") != "", F.col("prefixed_name"))))
    rows = items.select("case_id", "rank", F.explode(names).alias("iri"))
    return rows.groupBy("case_id", expand_eval(F.col("iri")).alias("iri")).agg(F.min("rank").alias("rank"))


def retrieval_metrics(
    cases: DataFrame, expected: DataFrame, retrieved: DataFrame, reranked: DataFrame, selected: DataFrame, k: int = 8
) -> DataFrame:
    """Recall, precision, rerank and health metrics of retrieval.

    ``cases(case_id, unresolved, errors)`` hold list sizes; ``expected(case_id, iri)``; item tables
    ``(case_id, iri, prefixed_name, label, rank)``.
    """
    top, re, sel = item_iris(retrieved), item_iris(reranked), item_iris(selected)

    def flag(df: DataFrame, name: str, within: int | None = None) -> DataFrame:
        rows = df if within is None else df.where(F.col("rank") < within)
        return rows.select("case_id", "iri").withColumn(name, F.lit(True))

    keys = ["case_id", "iri"]
    e = (
        expected.join(flag(top, "in_top", k), keys, "left")
        .join(flag(re, "in_re", k), keys, "left")
        .join(flag(sel, "in_sel"), keys, "left")
        .fillna(False, ["in_top", "in_re", "in_sel"])
    )
    per_case = e.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if("in_top").alias("top"),
        F.count_if("in_sel").alias("sel"),
        F.bool_or(F.col("in_top") | F.col("in_re")).alias("eligible"),
        F.bool_or(F.col("in_re") & ~F.col("in_top")).alias("promoted"),
        F.bool_or(F.col("in_top") & ~F.col("in_re")).alias("demoted"),
    )

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))

    labels = (
        selected.where(F.coalesce("label", F.lit("")) != "")
        .groupBy("case_id", F.lower("label").alias("l"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("case_id")
        .agg(F.bool_or(F.col("n") > 1).alias("ambiguous"))
    )
    wide = (
        cases.join(per_case, "case_id", "left")
        .join(sizes(retrieved, "n_retrieved"), "case_id", "left")
        .join(sizes(selected, "n_selected"), "case_id", "left")
        .join(sizes(sel, "n_selected_iris"), "case_id", "left")
        .join(labels, "case_id", "left")
        .fillna(0)
    )
    has = F.col("expected") > 0
    kept, found = F.col("n_selected"), F.col("n_retrieved")
    s = wide.agg(
        F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"),
        F.count_if(has).alias("with"),
        F.sum("expected").alias("expected"),
        F.sum("top").alias("top"),
        F.sum("sel").alias("sel"),
        F.count_if(has & (F.col("top") == F.col("expected"))).alias("full_top"),
        F.count_if(has & (F.col("sel") == F.col("expected"))).alias("full_sel"),
        F.sum("n_selected_iris").alias("sel_iris"),
        F.sum(kept).alias("kept"),
        F.sum(found).alias("found"),
        F.count_if(F.col("unresolved") > 0).alias("unresolved"),
        F.count_if(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"),
        F.count_if((kept == 0) & (found > 0)).alias("empty"),
        F.count_if(F.col("errors") > 0).alias("errors"),
        F.count_if("eligible").alias("eligible"),
        F.count_if("promoted").alias("promoted"),
        F.count_if("demoted").alias("demoted"),
    )
    c = F.col
    concept_recall, picked = _rate(c("top"), c("expected"), 1.0), _rate(c("sel"), c("expected"), 1.0)
    gained = _rate(c("promoted"), c("eligible"), 0.0)
    metrics = {
        f"retrieval_concept_recall_at_{k}": concept_recall,
        f"retrieval_case_recall_at_{k}": _rate(c("full_top"), c("with"), 1.0),
        "selected_concept_recall": picked,
        "selected_case_recall": _rate(c("full_sel"), c("with"), 1.0),
        "selected_precision": _rate(c("sel"), c("sel_iris"), 1.0),
        "mean_selected_candidates": c("kept") / c("n"),
        "mean_retrieved_candidates": c("found") / c("n"),
        "unresolved_mention_rate": c("unresolved") / c("n"),
        "concept_ambiguity_rate": c("ambiguous") / c("n"),
        "empty_selection_rate": c("empty") / c("n"),
        "retrieval_error_rate": c("errors") / c("n"),
        "reranker_promotion_rate": gained,
        "reranker_demotion_error_rate": _rate(c("demoted"), c("eligible"), 0.0),
        # Older names of three of the above.
        f"retrieval_recall_at_{k}": concept_recall,
        "selected_concept_accuracy": picked,
        "reranker_improvement_rate": gained,
    }
    return _long(s.select(*[v.alias(n) for n, v in metrics.items()]))


def combined_metrics(base: DataFrame, retrieval: DataFrame) -> DataFrame:
    """Both metric sets, with the pass rate repeated under its retrieval name."""
    passed = base.where(F.col("metric") == "case_pass_rate").select(
        F.lit("planner_case_pass_rate").alias("metric"), "value"
    )
    return base.unionByName(retrieval).unionByName(passed)


# Metrics compared with a baseline, and the second names of two of them.
DELTA_KEYS = [
    "case_pass_rate", "valid_plan_rate", "term_resolution_accuracy", "execution_success_rate",
    "result_binding_accuracy",
]
DELTA_ALIASES = {
    "case_pass_rate": "planner_case_pass_delta_vs_baseline",
    "term_resolution_accuracy": "term_resolution_delta_vs_baseline",
}


def baseline_deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    both = current.where(F.col("metric").isin(DELTA_KEYS)).join(
        baseline.select("metric", F.col("value").alias("__old")), "metric"
    )
    alias = F.create_map(*[F.lit(x) for kv in DELTA_ALIASES.items() for x in kv])[F.col("metric")]
    names = F.array_compact(F.array(F.concat("metric", F.lit("_delta_vs_baseline")), alias))
    return both.select(F.explode(names).alias("metric"), (F.col("value") - F.col("__old")).alias("value"))


def gate_failures(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """``(metric, failure)`` for ``gates(metric, minimum, maximum)``; unknown metrics are skipped."""
    j = metrics.join(gates, "metric")
    v = F.col("value")
    low = F.when(v < F.col("minimum"), F.format_string("%s: expected >= %.3f, got %.3f", "metric", "minimum", v))
    high = F.when(v > F.col("maximum"), F.format_string("%s: expected <= %.3f, got %.3f", "metric", "maximum", v))
    return j.select("metric", F.explode(F.array_compact(F.array(low, high))).alias("failure"))


# Report sections of the metrics.
SECTIONS = {
    "deprecated": ["retrieval_recall_at_8", "selected_concept_accuracy", "reranker_improvement_rate"],
    "rag_case": ["selected_case_recall", "selected_precision"],
    "rag_concept": [
        "retrieval_concept_recall_at_8", "selected_concept_recall", "reranker_promotion_rate",
        "reranker_demotion_error_rate",
    ],
    "rag_other": [
        "mean_selected_candidates", "mean_retrieved_candidates", "unresolved_mention_rate",
        "concept_ambiguity_rate", "empty_selection_rate", "retrieval_error_rate", "planner_case_pass_rate",
    ],
    "pipeline": [
        "valid_plan_rate", "render_success_rate", "execution_success_rate", "case_pass_rate",
        "planner_output_rate", "total_cases",
    ],
}


def metric_section(metric: Column) -> Column:
    out = F.when(metric.endswith("_delta_vs_baseline"), "delta")
    out = out.when(metric.isin(SECTIONS["deprecated"]), "deprecated")
    out = out.when(metric.isin(SECTIONS["rag_case"]) | metric.startswith("retrieval_case_recall_at_"), "rag_case")
    out = out.when(metric.isin(SECTIONS["rag_concept"]) | metric.startswith("retrieval_concept_recall_at_"), "rag_concept")
    for name in ("rag_other", "pipeline"):
        out = out.when(metric.isin(SECTIONS[name]), name)
    return out.otherwise("quality")


def case_lists(cases: DataFrame) -> DataFrame:
    """``(condition, case_id)`` for ``cases(case_id, unresolved, errors, retrieved, selected, promoted)``."""
    tests = {
        "unresolved": F.col("unresolved") > 0,
        "empty_selection": (F.col("retrieved") > 0) & (F.col("selected") == 0),
        "errors": F.col("errors") > 0,
        "promotions": F.col("promoted") > 0,
    }
    hit = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return cases.select(F.explode(hit).alias("condition"), "case_id")


def run_summary(runs: DataFrame) -> DataFrame:
    """Questions asked, drafted, executed and answered: ``runs(query, status, error, row_count)``."""
    fine = F.col("error").isNull()
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("query", F.lit("")) != "").alias("drafted"),
        F.count_if((F.col("status") == "ok") & fine).alias("executed"),
        F.count_if(fine & (F.col("row_count") > 0)).alias("answered"),
    )


def term_differences(reported: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(case_id, iri, side)``: terms only the planner reports, or only the resolver selected.

    One aggregation over the tagged rows of both sides, combined before its only shuffle; equal means equal or both null.
    """
    both = reported.select("case_id", "iri", F.lit(False).alias("__resolved")).unionByName(
        resolved.select("case_id", "iri", F.lit(True).alias("__resolved"))
    )
    sides = both.groupBy("case_id", "iri").agg(F.min("__resolved").alias("__low"), F.max("__resolved").alias("__high"))
    side = F.when(F.col("__low"), "resolved").otherwise("reported")
    return sides.where("__low = __high").select("case_id", "iri", side.alias("side"))
