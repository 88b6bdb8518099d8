"""Guess which property a question means when it does not name one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.functions import text as tx
from tripleframe.session import broadcast_if_small

# Cue words of each rule.
AGE_CUES = r"(?iU)\b(oldest|youngest|age|years|year-old)\b"
DATE_CUES = r"(?iU)\b(joined|hired|started|date|after|before)\b"
GROUPING_CUES = r"(?iU)\b(per|each|by|grouped)\b"
EMPLOYMENT_CUES = (
    r"(?iU)\b(employee|employees|employer|works\s+for|works\s+at|"
    r"their\s+company|their\s+employer|per\s+company|each\s+company|"
    r"company\s+of|in\s+a\s+company|at\s+(?:the\s+)?company)\b"
)
KNOWS_CUES = r"(?iU)\b(knows|connections?|friends?|acquaintances?)\b"
# Class labels of the two ends of employment, and name parts of date properties.
PERSON_LABELS = ["person", "people"]
COMPANY_LABELS = ["company", "organization", "organisation", "employer"]
DATE_NAMES = ["joined", "hired", "started", "date"]
# Rule order and scores.
RULES = {
    "employment": (1, 0.95),
    "age": (2, 0.9),
    "date": (3, 0.85),
    "knows": (4, 0.9),
    "class_pair": (5, 0.8),
    "grouping": (6, 0.75),
}


def _ends(properties: DataFrame, declared: str, observed: str, name: str) -> DataFrame:
    """``(property_iri, <name>)``: declared and observed classes at one end."""
    both = F.array_union(declared, observed)
    return properties.select(F.col("iri").alias("property_iri"), F.explode(both).alias(name)).distinct()


def domains(properties: DataFrame) -> DataFrame:
    return _ends(properties, "domain", "observed_domain", "subject_type")


def ranges(properties: DataFrame) -> DataFrame:
    return _ends(properties, "range", "observed_range", "object_type")


def connections(properties: DataFrame) -> DataFrame:
    """``(property_iri, subject_type, object_type)``: which classes a property connects."""
    return domains(properties).join(ranges(properties), "property_iri")


def cued(questions: DataFrame, pattern: str) -> DataFrame:
    return questions.where(F.rlike(F.col("question"), F.lit(pattern))).select("question_id")


def _hint(df: DataFrame, rule: str) -> DataFrame:
    order, score = RULES[rule]
    return df.select(
        "question_id",
        "property_iri",
        "subject_type",
        "object_type",
        F.lit(rule).alias("rule"),
        F.lit(order).alias("rule_order"),
        F.lit(score).alias("score"),
    )


def employment(questions: DataFrame, selected: DataFrame, terms: DataFrame) -> DataFrame:
    """Employment cue: properties from a person class, or a selected individual, to a company."""
    label = F.lower("label")
    classes = terms.where(F.col("kind") == "class")
    props = terms.where(F.col("kind") == "property")
    companies = classes.where(label.isin(COMPANY_LABELS)).select(F.col("iri").alias("object_type"))
    people = classes.where(label.isin(PERSON_LABELS)).select(F.col("iri").alias("subject_type"))
    to_company = ranges(props).join(companies, "object_type", "left_semi")
    to_company = to_company.groupBy("property_iri").agg(F.min("object_type").alias("object_type"))
    asked = cued(questions, EMPLOYMENT_CUES)
    general = domains(props).join(people, "subject_type", "left_semi").join(to_company, "property_iri")
    # Every cued question gets every such property: the result is that large by definition, and the
    # property side is measured before it is broadcast.
    rule = F.lit("employment")
    by_class = asked.withColumn("rule", rule).join(
        broadcast_if_small(general.withColumn("rule", rule)), "rule"
    )
    named = selected.where(F.col("kind") == "individual").select(
        "question_id", F.col("iri").alias("subject_type")
    )
    by_name = (
        asked.join(named, "question_id")
        .join(domains(props), "subject_type")
        .join(to_company, "property_iri")
    )
    cols = ["question_id", "property_iri", "subject_type", "object_type"]
    both = by_class.select(*cols).unionByName(by_name.select(*cols))
    ends = both.groupBy("question_id", "property_iri").agg(
        F.min("subject_type").alias("subject_type"), F.min("object_type").alias("object_type")
    )
    return _hint(ends, "employment")


def _short_name() -> Column:
    name = F.coalesce(F.when(F.col("prefixed_name") != "", F.col("prefixed_name")), F.col("iri"))
    return F.lower(F.substring_index(F.substring_index(name, ":", -1), "/", -1))


def _first_end(first: str, second: str) -> Column:
    return F.when(F.size(first) > 0, F.element_at(first, 1)).when(F.size(second) > 0, F.element_at(second, 1))


def named_property(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """Age, date and acquaintance cues: properties called like the cue.

    One equi-join on the rule name pairs every cued question with every property of that rule.
    """
    label, local = F.coalesce(F.lower("label"), F.lit("")), _short_name()
    dated = reduce(lambda a, b: a | b, [label.contains(c) | local.contains(c) for c in DATE_NAMES])
    rule_of = F.array_compact(
        F.array(
            F.when((label == "age") | (local == "age"), "age"),
            F.when(dated, "date"),
            F.when((label == "knows") | (local == "knows"), "knows"),
        )
    )
    props = terms.where(F.col("kind") == "property").select(
        F.col("iri").alias("property_iri"),
        _first_end("observed_domain", "domain").alias("subject_type"),
        _first_end("range", "observed_range").alias("object_type"),
        F.explode(rule_of).alias("rule"),
    )
    q = F.col("question")
    cues = F.array_compact(
        F.array(
            F.when(F.rlike(q, F.lit(AGE_CUES)), "age"),
            F.when(F.rlike(q, F.lit(DATE_CUES)), "date"),
            F.when(F.rlike(q, F.lit(KNOWS_CUES)), "knows"),
        )
    )
    asked = questions.select("question_id", F.explode(cues).alias("rule"))
    joined = asked.join(broadcast_if_small(props), "rule")
    order = F.create_map(*[F.lit(x) for r, (o, _) in RULES.items() for x in (r, o)])
    score = F.create_map(*[F.lit(x) for r, (_, s) in RULES.items() for x in (r, s)])
    return joined.select(
        "question_id", "property_iri", "subject_type", "object_type", "rule",
        order[F.col("rule")].alias("rule_order"), score[F.col("rule")].alias("score"),
    )


def class_pairs(selected: DataFrame, terms: DataFrame) -> DataFrame:
    """Two selected classes that exactly one property connects, in that direction.

    Goes from each selected class through the unique connections to the other one, so the selected
    classes of a question are never paired with each other.
    """
    links = connections(terms.where(F.col("kind") == "property"))
    unique = (
        links.groupBy("subject_type", "object_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min("property_iri").alias("property_iri"))
        .where((F.col("n") == 1) & (F.col("subject_type") != F.col("object_type")))
    )
    chosen = selected.where(F.col("kind") == "class").select("question_id", "iri").distinct()
    from_class = chosen.withColumnRenamed("iri", "subject_type").join(unique, "subject_type")
    to_class = chosen.withColumnRenamed("iri", "object_type")
    return _hint(from_class.join(to_class, ["question_id", "object_type"], "left_semi"), "class_pair")


def grouping(questions: DataFrame, selected: DataFrame, terms: DataFrame) -> DataFrame:
    """"per X" with a selected class X: properties whose range is X. Off by default in :func:`infer`."""
    asked = cued(questions, GROUPING_CUES)
    chosen = selected.where(F.col("kind") == "class")
    names = chosen.select(
        "question_id",
        F.explode(F.array(F.lower("label"), F.lower(tx.last_path_segment(F.col("iri"))))).alias("name"),
    ).distinct()
    classes = terms.where(F.col("kind") == "class").select(
        F.col("iri").alias("object_type"), F.lower("label").alias("name")
    )
    wanted = asked.join(names, "question_id").join(classes, "name").select("question_id", "object_type").distinct()
    into = ranges(terms.where(F.col("kind") == "property"))
    found = wanted.join(into, "object_type").withColumn("subject_type", F.lit(None).cast("string"))
    return _hint(found, "grouping")


def infer(
    questions: DataFrame, selected: DataFrame, terms: DataFrame, with_grouping: bool = False
) -> DataFrame:
    """All hints; a repeated (property, subject, object) keeps the earliest rule."""
    parts = [
        employment(questions, selected, terms),
        named_property(questions, terms),
        class_pairs(selected, terms),
    ]
    if with_grouping:
        parts.append(grouping(questions, selected, terms))
    keys = ["question_id", "property_iri", "subject_type", "object_type"]
    best = F.min_by(F.struct("rule", "score"), "rule_order").alias("x")
    once = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(best)
    return once.select(*keys, "x.rule", "x.score")


def listed(hints: DataFrame) -> DataFrame:
    """Best score first within a question."""
    return hints.orderBy("question_id", F.desc("score"), "property_iri")
