"""Rerank retrieved concepts with question cues, as one sum of conditional columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleframe.functions import text as tx
from tripleframe.operators.forms import top_k
from tripleframe.operators.similarity import contained_pairs


@dataclass(frozen=True)
class Weights:
    """How much each signal adds or takes away."""

    exact_label_match: float = 0.35
    alias_match: float = 0.15
    kind_match: float = 0.20
    kind_conflict_penalty: float = 0.20
    domain_range_match: float = 0.10
    relation_cue_match: float = 0.15
    ambiguity_penalty: float = 0.05


# Name parts of numeric and temporal properties, and the cues that ask for them.
NUMERIC_PARTS = ["integer", "decimal", "double", "float", "int", "number", "year", "age"]
TEMPORAL_PARTS = ["date", "datetime", "time", "timestamp", "joined", "founded"]
NUMERIC_CUES = ["oldest", "youngest", "average age", "older than"]
TEMPORAL_CUES = ["joined", "founded", "after ", "before ", "since ", " on 20"]


def _any_of(text: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | text.contains(p)
    return hit


def noop(candidates: DataFrame, limit: int) -> DataFrame:
    """Keep retrieval order; ``candidates`` need ``seq`` for it."""
    ranked = top_k(candidates, ["question_id"], [F.asc("seq")], max(0, limit))
    score = F.col("score")
    return ranked.select(
        "*", score.alias("retrieval_score"), score.alias("rerank_score"), score.alias("final_score")
    )


def inferred_class_terms(questions: DataFrame, baseline: DataFrame, terms: DataFrame) -> DataFrame:
    """``(question_id, class_terms)``: names of the classes a question is about, in lower case.

    Classes come from resolved mentions, ``baseline(question_id, iri, kind, label, prefixed_name)``,
    and from class labels found anywhere in the question.
    """
    classes = terms.where((F.col("kind") == "class") & F.col("label").isNotNull() & (F.col("label") != ""))
    classes = classes.select("iri", "label", "prefixed_name", F.lower("label").alias("__l"))
    lowered = questions.select("question_id", F.lower("question").alias("__q"))
    found = contained_pairs(lowered, "question_id", "__q", classes, "__l").join(classes, "__l")
    cols = ["question_id", "iri", "label", "prefixed_name"]
    known = baseline.where((F.col("kind") == "class") & (F.col("iri") != ""))
    both = known.select(*cols).unionByName(found.select(*cols)).distinct()
    names = F.transform(
        F.filter(F.array("iri", "label", "prefixed_name"), lambda x: x.isNotNull() & (x != "")), F.lower
    )
    return both.select("question_id", F.explode(names).alias("n")).groupBy("question_id").agg(
        F.sort_array(F.collect_set("n")).alias("class_terms")
    )


def described(concepts: DataFrame) -> DataFrame:
    """``concepts(kind, label, aliases, prefixed_name, domain, range)`` with all that scores read of a concept alone.

    Described before they are joined to hits, concepts are taken apart once each and not once for each hit.
    """
    no_text = F.array().cast("array<string>")
    domain, range_ = F.coalesce("domain", no_text), F.coalesce("range", no_text)
    related = F.concat(domain, range_)
    fragments = F.transform(
        F.filter(F.concat(related, F.array("label", "prefixed_name")), lambda x: x.isNotNull() & (x != "")),
        lambda x: F.lower(tx.last_segment(x)),
    )

    def has(parts: list[str]) -> Column:
        return F.exists(fragments, lambda f: _any_of(f, parts))

    return concepts.withColumns(
        {
            "__label": F.lower(F.coalesce("label", F.lit(""))),
            "__aliases": F.transform(F.filter(F.coalesce("aliases", no_text), lambda a: a != ""), F.lower),
            "__prefixed": F.lower(F.coalesce("prefixed_name", F.lit(""))),
            "__related": F.concat(F.transform(related, lambda x: F.lower(tx.last_segment(x))), F.transform(related, F.lower)),
            "__numeric": has(NUMERIC_PARTS),
            "__temporal": has(TEMPORAL_PARTS),
        }
    )


def heuristic(
    candidates: DataFrame,
    questions: DataFrame,
    limit: int,
    mention_kinds: DataFrame | None = None,
    class_terms: DataFrame | None = None,
    static_kinds: list[str] | None = None,
    static_class_terms: list[str] | None = None,
    weights: Weights = Weights(),
) -> DataFrame:
    """Add the boosts to the retrieval score and keep the best ``limit`` per question.

    ``candidates(question_id, iri, kind, label, aliases, prefixed_name, domain, range, score,
    retrieval_rank[, rag_mention])``; ``mention_kinds(question_id, mention, kinds)``;
    ``class_terms(question_id, class_terms)``. Candidates whose concepts are ``described`` already are not described again.
    """
    w = weights
    no_text = F.array().cast("array<string>")
    df = candidates if "__related" in candidates.columns else described(candidates)
    # counted over the rows that follow anyway, so that the candidates are computed once
    df = df.withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy("question_id", "__label")))
    if "rag_mention" not in df.columns:
        df = df.withColumn("rag_mention", F.lit(None).cast("string"))
    df = df.join(questions.select("question_id", F.lower("question").alias("__q")), "question_id")
    if mention_kinds is None:
        df = df.withColumn("__kinds", no_text)
    else:
        kinds = mention_kinds.select(
            "question_id", F.col("mention").alias("rag_mention"), F.col("kinds").alias("__kinds")
        )
        df = df.join(kinds, ["question_id", "rag_mention"], "left")
    given = F.array(*[F.lit(t.lower()) for t in static_class_terms or []]).cast("array<string>")
    if class_terms is None:
        df = df.withColumn("__classes", given)
    else:
        names = class_terms.select("question_id", F.col("class_terms").alias("__classes"))
        df = df.join(names, "question_id", "left").withColumn(
            "__classes", F.array_union(F.coalesce("__classes", no_text), given)
        )
    q, lab = F.col("__q"), F.col("__label")
    fallback = F.array(*[F.lit(k) for k in static_kinds or []]).cast("array<string>")
    kinds = F.when(F.coalesce(F.size("__kinds"), F.lit(0)) > 0, F.col("__kinds")).otherwise(fallback)
    in_kinds = F.coalesce(F.array_contains(kinds, F.col("kind")), F.lit(False))
    alias_hit = F.exists("__aliases", lambda a: F.contains(q, a))
    prefixed = F.col("__prefixed")
    near_class = (F.size("__classes") > 0) & F.arrays_overlap("__classes", "__related")
    cue = (F.col("kind") == "property") & (
        (_any_of(q, NUMERIC_CUES) & F.col("__numeric")) | (_any_of(q, TEMPORAL_CUES) & F.col("__temporal"))
    )
    signals = [
        ("label_in_question", (lab != "") & F.contains(q, lab), w.exact_label_match),
        ("alias", alias_hit, w.alias_match),
        ("prefixed_name_in_question", (prefixed != "") & F.contains(q, prefixed), w.exact_label_match),
        ("kind", (F.size(kinds) > 0) & in_kinds, w.kind_match),
        ("kind_conflict", (F.size(kinds) > 0) & ~in_kinds, -w.kind_conflict_penalty),
        ("domain_or_range_overlap", near_class, w.domain_range_match),
        ("relation_cue", cue, w.relation_cue_match),
        ("ambiguous_label", (lab != "") & (F.col("__same") > 1), -w.ambiguity_penalty),
    ]
    boost = F.lit(0.0)
    for _, hit, weight in signals:
        boost = boost + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    reasons = F.concat_ws(", ", *[F.when(hit, F.lit(name)) for name, hit, _ in signals])
    scored = (
        df.withColumn("rerank_score", boost)
        .withColumn("explanation", F.when(reasons == "", "no boosts applied").otherwise(reasons))
        .withColumn("final_score", F.col("score") + F.col("rerank_score"))
        .withColumnRenamed("score", "retrieval_score")
        .drop("__q", "__kinds", "__classes", "__same", "__label", "__aliases", "__prefixed", "__related", "__numeric", "__temporal")
    )
    order = [F.desc("final_score"), F.asc("retrieval_rank"), F.asc("iri")]
    return top_k(scored, ["question_id"], order, max(0, limit))
