"""Link free-text mentions to schema terms.

Mentions and surface forms are first reduced to their distinct normal forms. Equal forms meet in an
equi-join, contained ones by their rarest gram, similar ones by the filter of ``best_ratio_pairs``: a bound from shared characters
on every pair, and the score of each mention's last candidate as a threshold that rises from round to round. Results are
spread back to the rows that asked. The best candidates are those that measuring all pairs would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.functions import text as tx
from tripleframe.operators.forms import top_k
from tripleframe.operators.similarity import best_ratio_pairs, contained_pairs, ratio_pairs
from tripleframe.session import stored

# Scores of the two certain tiers and the thresholds of linking and deciding.
EXACT_SCORE = 1.0
CONTAINED_SCORE = 0.85
MIN_SCORE = 0.4
LIMIT = 10
SELECT_SCORE = 0.85
TIE_MARGIN = 0.05
# Order in which kinds are listed; it breaks ties.
KIND_ORDER = ["class", "property", "individual", "graph"]


def kind_rank(kind: Column) -> Column:
    ranks = F.array(*[F.lit(k) for k in KIND_ORDER])
    return F.when(F.array_contains(ranks, kind), F.array_position(ranks, kind)).otherwise(99)


def surface_forms(terms: DataFrame) -> DataFrame:
    """``(kind, iri, form, pos)``: the texts a term may be called by, in order of preference."""
    prefixed = F.col("prefixed_name")
    camel_local = tx.split_camel(tx.local_name(prefixed))
    label = F.when(F.col("label") != "", F.col("label"))
    plain = F.concat(
        F.array(label),
        F.coalesce("aliases", F.array().cast("array<string>")),
        F.array(camel_local, tx.split_camel(tx.last_segment(F.col("iri")))),
    )
    graph = F.array(
        label,
        tx.last_path_segment(F.col("iri")),
        F.when(prefixed != "", prefixed),
        F.when(prefixed != "", camel_local),
    )
    forms = F.filter(
        F.when(F.col("kind") == "graph", graph).otherwise(plain), lambda x: x.isNotNull()
    )
    return terms.select("kind", "iri", F.posexplode(forms).alias("pos", "form"))


def certain_forms(m: DataFrame, f: DataFrame, min_score: float) -> DataFrame:
    """``(nm, nf, score)`` of equal forms and of forms one of which contains the other."""
    tiers = m.join(f, F.col("nm") == F.col("nf")).withColumn("score", F.lit(EXACT_SCORE))
    if min_score <= CONTAINED_SCORE:
        inside = contained_pairs(f, "nf", "nf", m, "nm").select("nm", "nf")
        around = contained_pairs(m, "nm", "nm", f, "nf").select("nm", "nf")
        near = inside.unionByName(around).withColumn("score", F.lit(CONTAINED_SCORE))
        tiers = tiers.unionByName(near)
    return tiers.groupBy("nm", "nf").agg(F.max("score").alias("score"))


def scored_forms(mention_forms: DataFrame, term_forms: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``(nm, nf, score)`` for distinct normal forms; the best tier that applies."""
    m = mention_forms.select("nm").where(F.col("nm") != "").distinct()
    f = term_forms.select("nf").where(F.col("nf") != "").distinct()
    similar = ratio_pairs(m, "nm", f, "nf", min_score)
    # A pair in a certain tier keeps that tier's score even when its ratio is higher.
    certain = F.contains("nf", "nm") | F.contains("nm", "nf")
    similar = similar.where(~certain).withColumnRenamed("ratio", "score")
    return certain_forms(m, f, min_score).unionByName(similar)


def _asked(mentions: DataFrame) -> DataFrame:
    if "kinds" not in mentions.columns:
        mentions = mentions.withColumn("kinds", F.lit(None).cast("array<string>"))
    return (
        mentions.select("mention", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
        .distinct()
        .withColumn("nm", tx.normalise(F.col("mention")))
    )


def _spread(asked: DataFrame, forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of pairs of forms brought back to (mention, kinds) and terms, the best form of each term."""
    hits = asked.join(pairs, "nm").join(forms, "nf")
    allowed = (F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))
    best = F.max_by(
        F.struct("form", "score"), F.struct(F.col("score"), -F.col("pos"))
    ).alias("best")
    return (
        hits.where(allowed & F.col("kind").isin(KIND_ORDER))
        .groupBy("mention", "kinds", "kind", "iri")
        .agg(best)
        .select("mention", "kinds", "kind", "iri", F.col("best.form").alias("form"), F.col("best.score").alias("score"))
    )


def all_candidates(
    mentions: DataFrame, terms: DataFrame, min_score: float = MIN_SCORE
) -> DataFrame:
    """Every term with a form at or above ``min_score``, once per distinct (mention, kinds).

    ``mentions(mention[, kinds])``: an empty or missing ``kinds`` allows every kind.
    """
    asked = _asked(mentions)
    forms = surface_forms(terms).withColumn("nf", tx.normalise(F.col("form")))
    return _spread(asked, forms, scored_forms(asked, forms, min_score))


def best_candidates(
    mentions: DataFrame, terms: DataFrame, limit: int, min_score: float = MIN_SCORE
) -> tuple[DataFrame, DataFrame]:
    """Terms among which the best ``limit`` of every (mention, kinds) are, and the pairs of forms that were measured.

    The ``limit``-th best score of a mention is a threshold that rises while pairs are measured, most promising first;
    pairs whose bound lies below it are never measured.
    """
    asked = stored(_asked(mentions))
    forms = stored(surface_forms(terms).withColumn("nf", tx.normalise(F.col("form"))))
    m = asked.select("nm").where(F.col("nm") != "").distinct()
    f = forms.select("nf").where(F.col("nf") != "").distinct()

    def threshold(pairs: DataFrame) -> DataFrame:
        found = _spread(asked, forms, pairs.select(F.col("a_t").alias("nm"), F.col("b_t").alias("nf"), "score"))
        ranked = top_k(found, ["mention", "kinds"], [F.desc("score")], limit, "at")
        last = ranked.where(F.col("at") == limit - 1).select("mention", "kinds", "score")
        # A form that several (mention, kinds) share needs the lowest of their thresholds.
        each = asked.join(last, ["mention", "kinds"], "left").groupBy("nm")
        return each.agg(F.min(F.coalesce("score", F.lit(min_score))).alias("theta")).withColumnRenamed("nm", "a_t")

    known = certain_forms(m, f, min_score).select(F.col("nm").alias("a_t"), F.col("nf").alias("b_t"), "score")
    pairs, measured = best_ratio_pairs(
        m.withColumnRenamed("nm", "a_t"), f.withColumnRenamed("nf", "b_t"), min_score, known, threshold
    )
    scored = pairs.select(F.col("a_t").alias("nm"), F.col("b_t").alias("nf"), "score")
    if min_score > CONTAINED_SCORE:
        # Contained forms are no candidates then, whatever their ratio is.
        scored = scored.where((F.col("nm") == F.col("nf")) | ~(F.contains("nf", "nm") | F.contains("nm", "nf")))
    return _spread(asked, forms, scored), measured


def link(
    mentions: DataFrame,
    terms: DataFrame,
    limit: int = LIMIT,
    min_score: float = MIN_SCORE,
    keep_unmatched: bool = True,
) -> DataFrame:
    """Top candidates per distinct (mention, kinds), best first.

    A mention without any candidate gets one row of kind ``unknown`` with score 0.
    """
    found, _ = best_candidates(mentions, terms, limit, min_score)
    ranked = top_k(
        found,
        ["mention", "kinds"],
        [F.desc("score"), kind_rank(F.col("kind")), F.asc("iri")],
        limit,
    )
    names = terms.select("kind", "iri", "prefixed_name", "label")
    found = ranked.join(names, ["kind", "iri"]).withColumn(
        "explanation", F.format_string("matched %s via '%s'", F.col("kind"), F.col("form"))
    )
    cols = ["mention", "kinds", "iri", "prefixed_name", "kind", "label", "score", "explanation", "rank"]
    if not keep_unmatched:
        return found.select(*cols)
    if "kinds" not in mentions.columns:
        mentions = mentions.withColumn("kinds", F.lit(None).cast("array<string>"))
    asked = mentions.select(
        "mention", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds")
    ).distinct()
    out = asked.join(found, ["mention", "kinds"], "left")
    none = F.col("score").isNull()
    return out.select(
        "mention",
        "kinds",
        F.coalesce("iri", F.lit("")).alias("iri"),
        "prefixed_name",
        F.coalesce("kind", F.lit("unknown")).alias("kind"),
        "label",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(none, "no schema term matched this mention").otherwise(F.col("explanation")).alias("explanation"),
        F.coalesce("rank", F.lit(0)).alias("rank"),
    )


def is_exact_form(mention: Column, iri: Column, prefixed: Column, label: Column) -> Column:
    """The mention is the label, the prefixed name, the local name or the last IRI segment."""
    m = F.lower(F.trim(mention))
    tests = [
        F.lower(label) == m,
        F.lower(prefixed) == m,
        F.lower(tx.local_name(prefixed)) == m,
        F.lower(tx.last_segment(iri)) == m,
    ]
    hit = F.lit(False)
    for test in tests:
        hit = hit | F.coalesce(test, F.lit(False))
    return hit


def decide(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per mention: ``selected``, ``ambiguous`` or ``unresolved``, with the top candidate.

    Only the two best rows count, and they are picked by an aggregate, so no group is sorted.
    """
    by = by or ["mention", "kinds"]
    known = F.col("kind") != "unknown"
    row = F.struct("iri", "prefixed_name", "kind", "label", "score")
    top = F.max(F.when(known & (F.col("rank") == 0), row)).alias("top")
    runner = F.max(F.when(known & (F.col("rank") == 1), F.col("score"))).alias("runner")
    two = candidates.where(F.col("rank") <= 1).groupBy(*by).agg(top, runner)
    exact = is_exact_form(F.col("mention"), F.col("top.iri"), F.col("top.prefixed_name"), F.col("top.label"))
    status = (
        F.when(F.col("top").isNull(), "unresolved")
        .when(exact, "selected")
        .when(F.col("top.score") < SELECT_SCORE, "unresolved")
        .when((F.col("top.score") - F.col("runner")) < TIE_MARGIN, "ambiguous")
        .otherwise("selected")
    )
    return two.select(*by, "top.*", status.alias("status"))


def merge_supplemental(
    selected: DataFrame, unresolved: DataFrame, ambiguous: DataFrame, supplemental: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add supplemental candidates to the selected terms of each question.

    Inputs: ``selected(question_id, mention, iri, kind, score)``, ``unresolved`` and
    ``ambiguous(question_id, mention)``, ``supplemental(question_id, seq, mention, iri, kind, score)``.
    Returns ``(merged, promoted, remaining unresolved)``. Selected terms win by IRI; an ambiguous
    mention stays ambiguous; the first of several supplements for a new IRI is appended.
    """
    lowered = F.lower("mention")
    blocked = ambiguous.select("question_id", lowered.alias("__m")).distinct()
    usable = (
        supplemental.where(F.coalesce(F.col("iri"), F.lit("")) != "")
        .withColumn("__m", F.lower(F.coalesce("mention", F.lit(""))))
        .join(blocked.where(F.col("__m") != ""), ["question_id", "__m"], "left_anti")
    )
    # An anti-join needs no distinct rows, so known terms are not held once more before they are sorted for it.
    known = selected.select("question_id", "iri")
    new = usable.join(known, ["question_id", "iri"], "left_anti")
    cols = ["seq", "mention", "kind", "score"]
    # The origin is gathered as a text: Spark then goes through the rows in the order the join leaves them in, also where
    # only keys are read, and holds no table of groups.
    origin = F.max(F.lit("supplemental")).alias("origin")
    first = new.groupBy("question_id", "iri").agg(F.min_by(F.struct(*cols), "seq").alias("x"), origin)
    appended = first.select("question_id", "iri", "x.*", "origin")
    base = selected.withColumn("seq", F.lit(None).cast("long")).withColumn("origin", F.lit("baseline"))
    merged = base.unionByName(appended, allowMissingColumns=True)
    satisfied = appended.select("question_id", F.lower("mention").alias("__m")).where(F.col("__m") != "").distinct()
    remaining = (
        unresolved.withColumn("__m", F.lower("mention"))
        .join(satisfied, ["question_id", "__m"], "left_anti")
        .drop("__m")
    )
    return merged, usable.drop("__m"), remaining
