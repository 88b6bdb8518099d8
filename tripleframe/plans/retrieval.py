"""Retrieve, deduplicate, select and promote concepts for questions.

Tables: ``requests(question_id, mention, text, kinds)``, ``concepts`` as in ``discovery.concepts``,
``hits(question_id, seq, mention, iri, score, retrieval_rank, matched_text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import text as tx
from tripleframe.operators import paths
from tripleframe.operators.forms import top_k
from tripleframe.operators.similarity import contained_pairs, nearest_vectors
from tripleframe.session import stored

# Scores of the text tiers, limits, and the name of the whole-question request.
EQUAL_SCORE = 1.0
CONTAINED_SCORE = 0.85
OVERLAP_WEIGHT = 0.5
RETRIEVAL_LIMIT = 20
SELECTED_LIMIT = 8
WHOLE_QUESTION = "<question>"
# Kind names of the vector store and of the evaluation side.
STORE_TO_KIND = {
    "owl_class": "class",
    "skos_concept": "class",
    "object_property": "property",
    "datatype_property": "property",
    "annotation_property": "property",
    "rdf_property": "property",
}


def empty_kinds() -> Column:
    return F.array().cast("array<string>")


# ---- requests -------------------------------------------------------------------------------


def kind_hint(mentions: DataFrame, terms: DataFrame) -> DataFrame:
    """Fill ``kinds`` of mentions that have none: kinds of terms with that label, else by shape."""
    labels = (
        terms.where(F.col("kind").isin("class", "property", "individual"))
        .select(F.lower("label").alias("__l"), "kind")
        .where(F.col("__l").isNotNull())
        .groupBy("__l")
        .agg(F.collect_set("kind").alias("__found"))
    )
    text = F.col("text")
    shaped = (
        F.when(text.contains(" ") | text.endswith("ing") | text.endswith("ed"), F.array(F.lit("property")))
        .when(
            (F.upper(F.substring(text, 1, 1)) == F.substring(text, 1, 1))
            & (F.lower(F.substring(text, 1, 1)) != F.substring(text, 1, 1)),
            F.array(F.lit("class"), F.lit("individual")),
        )
        .otherwise(empty_kinds())
    )
    order = F.array(F.lit("class"), F.lit("property"), F.lit("individual"))
    by_label = F.filter(order, lambda k: F.array_contains("__found", k))
    given = F.coalesce("kinds", empty_kinds())
    joined = mentions.withColumn("__l", F.lower("text")).join(labels, "__l", "left")
    filled = (
        F.when(F.size(given) > 0, given)
        .when(F.col("__found").isNotNull(), by_label)
        .otherwise(shaped)
    )
    return joined.withColumn("kinds", filled).drop("__l", "__found")


def requests(questions: DataFrame, mentions: DataFrame, with_question: bool = False) -> DataFrame:
    """One request per mention; the whole question when asked for, or when it has no mention."""
    per_mention = mentions.select(
        "question_id", F.col("text").alias("mention"), F.col("text"), "kinds"
    )
    bare = questions
    if not with_question:
        bare = bare.join(mentions.select("question_id").distinct(), "question_id", "left_anti")
    whole = bare.select(
        "question_id",
        F.lit(WHOLE_QUESTION).alias("mention"),
        F.col("question").alias("text"),
        empty_kinds().alias("kinds"),
    )
    return per_mention.unionByName(whole)


# ---- retrieval ------------------------------------------------------------------------------


def concept_forms(concepts: DataFrame) -> DataFrame:
    """``(iri, kind, form, pos)``: label, aliases, prefixed name, local name, last IRI segment."""
    prefixed = F.when(F.col("prefixed_name") != "", F.col("prefixed_name"))
    forms = F.concat(
        F.array(F.when(F.col("label") != "", F.col("label"))),
        F.coalesce("aliases", F.array().cast("array<string>")),
        F.array(prefixed, tx.local_name(prefixed), tx.last_segment(F.col("iri"))),
    )
    usable = F.filter(forms, lambda x: x.isNotNull())
    return concepts.select("iri", "kind", F.posexplode(usable).alias("pos", "form")).where(
        F.trim("form") != ""
    )


def pair_score(q: Column, c: Column) -> Column:
    """The score of two lower-case texts: equal, one contained in the other, or shared words; 0 for none of these."""
    words = F.size(F.array_intersect(tx.tokens(q), tx.tokens(c)))
    longer = F.greatest(F.size(tx.tokens(q)), F.size(tx.tokens(c)))
    return (
        F.when(q == c, F.lit(EQUAL_SCORE))
        .when(F.contains(q, c) | F.contains(c, q), F.lit(CONTAINED_SCORE))
        .when(words > 0, overlap_score(words, longer))
        .otherwise(F.lit(0.0))
    )


def overlap_score(shared: Column, longer: Column) -> Column:
    """The score of ``shared`` words when the longer of the two texts has ``longer`` distinct words."""
    return OVERLAP_WEIGHT * shared / longer


def whole_matches(q: DataFrame, c: DataFrame) -> DataFrame:
    """``(qt, ct, score)`` of distinct texts that are equal or contained either way."""
    equal = q.join(c, F.col("qt") == F.col("ct")).select("qt", "ct", F.lit(EQUAL_SCORE).alias("score"))
    inside = contained_pairs(c, "ct", "ct", q, "qt").select("qt", "ct")
    around = contained_pairs(q, "qt", "qt", c, "ct").select("qt", "ct")
    other = inside.unionByName(around).where("qt <> ct").distinct()
    return equal.unionByName(other.withColumn("score", F.lit(CONTAINED_SCORE)))


class WordIndex:
    """Concept texts by word and number of words, each list also cut to the concepts that win its ties.

    ``offers(ct, kind, iri)`` are the first ``limit`` IRIs of a text and kind: all concepts of a text score alike, so no
    other can rank through it. ``postings(word, cn, ct, cw)`` has every text of a word. ``heads`` has those texts of a
    (word, cn, kind) that offer its first ``limit`` IRIs. ``sizes(word, cn, n)`` tells which lists exist before any is read.
    """

    def __init__(self, forms: DataFrame, limit: int):
        concepts = forms.select("ct", "kind", "iri").distinct()
        self.limit = limit
        self.offers = stored(top_k(concepts, ["ct", "kind"], [F.asc("iri")], limit).drop("rank"))
        texts = self.offers.select("ct").distinct().withColumn("cw", tx.tokens(F.col("ct")))
        self.postings = stored(texts.select(F.explode("cw").alias("word"), F.size("cw").alias("cn"), "ct", "cw"))
        self.sizes = self.postings.groupBy("word", "cn").agg(F.count(F.lit(1)).alias("n"))

    def heads(self, words: DataFrame) -> DataFrame:
        """``(word, cn, ct, cw)`` of the given words, at most ``limit`` texts for each (word, cn, kind)."""
        offered = self.postings.join(words.select("word").distinct(), "word", "left_semi").join(self.offers, "ct")
        per_iri = offered.groupBy("word", "cn", "kind", "iri").agg(F.min(F.struct("ct", "cw")).alias("t"))
        first = top_k(per_iri, ["word", "cn", "kind"], [F.asc("iri")], self.limit)
        return first.select("word", "cn", "t.ct", "t.cw").distinct()

    def query_words(self, q: DataFrame) -> DataFrame:
        """``(qt, qn, word, j, known)``: indexed words of a text, rarest first, with the words up to each."""
        rows = self.sizes.groupBy("word").agg(F.sum("n").alias("n"))
        split = q.withColumn("qw", tx.tokens(F.col("qt")))
        exploded = split.select("qt", F.size("qw").alias("qn"), F.explode("qw").alias("word"))
        listed = exploded.join(rows, "word").groupBy("qt", "qn").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("l"))
        known = listed.select("qt", "qn", F.transform("l", lambda x: x["word"]).alias("known"))
        return known.select("qt", "qn", "known", F.posexplode("known").alias("j", "word"))


def shared_words(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """``(qt, ct, score)`` of texts that meet on a word, each at the rarest word they share only."""
    met = asked.join(lists, ["word", "cn"])
    first = met.where((F.col("j") == 0) | ~F.arrays_overlap(F.slice("known", F.lit(1), F.col("j")), F.col("cw")))
    shared = F.size(F.array_intersect("known", "cw"))
    return first.select("qt", "ct", overlap_score(shared, F.greatest("qn", "cn")).alias("score"))


def ranked_concepts(pairs: DataFrame, asked: DataFrame, offers: DataFrame, limit: int) -> DataFrame:
    """``(qt, kinds, iri, score, retrieval_rank)``: the best concepts that scored texts offer to each request."""
    allowed = (F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))
    hits = asked.join(pairs, "qt").join(offers, "ct").where(allowed)
    best = hits.groupBy("qt", "kinds", "iri").agg(F.max("score").alias("score"))
    return top_k(best, ["qt", "kinds"], [F.desc("score"), F.asc("iri")], limit, "retrieval_rank")


def scored_texts(asked: DataFrame, index: WordIndex) -> DataFrame:
    """``(qt, ct, score)``: every pair of texts that can put a concept among the best ``limit`` of a request.

    Words are taken rarest first. Texts whose rarest shared word is the j-th of m share at most m - j + 1 words, which
    bounds their score for each number of words they may have. Lists whose bound is below the score that already holds
    the last place are not read. That score comes from equal and contained texts and from the heads of the rarest word.
    Of the last word only heads are read at all: texts that share nothing else score alike per (word, cn), so the first
    ``limit`` IRIs win. A word in every text thus adds no pairs but those, unless it is needed beside rarer ones.
    """
    q = asked.select("qt").distinct()
    whole = stored(whole_matches(q, index.offers.select("ct").distinct()))
    words = stored(index.query_words(q))
    last = F.col("j") == F.size("known") - 1
    heads = stored(index.heads(words.where((F.col("j") == 0) | last)))
    rarest = words.where("j = 0").join(index.sizes.select("word", "cn"), "word")
    early = whole.unionByName(shared_words(rarest, heads))
    held = (
        ranked_concepts(early, asked, index.offers, index.limit)
        .groupBy("qt", "kinds")
        .agg(F.when(F.count(F.lit(1)) == index.limit, F.min("score")).otherwise(F.lit(0.0)).alias("least"))
    )
    every = asked.join(held, ["qt", "kinds"], "left").groupBy("qt").agg(F.min(F.coalesce("least", F.lit(0.0))).alias("least"))
    most = F.least(F.size("known") - F.col("j"), F.col("cn"))
    open_lists = stored(
        words.join(every, "qt")
        .join(index.sizes.select("word", "cn"), "word")
        .where(overlap_score(most, F.greatest("qn", "cn")) >= F.col("least"))
    )
    return (
        whole.unionByName(shared_words(open_lists.where(~last), index.postings))
        .unionByName(shared_words(open_lists.where(last), heads))
    )


def token_retrieve(reqs: DataFrame, concepts: DataFrame, limit: int = RETRIEVAL_LIMIT) -> DataFrame:
    """Best concepts per request by text overlap; ties by IRI, ranks from 0.

    Equal requests are answered once and the answer is joined back to all of them. The matched text is the best form of
    a concept, the first of equals.
    """
    asked = reqs.withColumn("qt", F.lower(F.trim("text"))).where(F.col("qt") != "")
    asked = asked.withColumn("kinds", F.coalesce("kinds", empty_kinds()))
    distinct = asked.select("qt", "kinds").distinct()
    forms = concept_forms(concepts).withColumn("ct", F.lower(F.trim("form")))
    index = WordIndex(forms, limit)
    ranked = ranked_concepts(scored_texts(distinct, index), distinct, index.offers, limit)
    allowed = (F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))
    order = F.struct(pair_score(F.col("qt"), F.col("ct")), -F.col("pos"))
    matched = (
        ranked.join(forms, "iri")
        .where(allowed)
        .groupBy("qt", "kinds", "iri", "score", "retrieval_rank")
        .agg(F.max_by("form", order).alias("matched_text"))
    )
    back = asked.join(matched, ["qt", "kinds"])
    return back.select("question_id", "mention", "iri", "score", "retrieval_rank", "matched_text")


def vector_retrieve(
    queries: DataFrame, concepts: DataFrame, limit: int = RETRIEVAL_LIMIT, min_score: float | None = None, **blocks
) -> DataFrame:
    """Nearest concepts per query vector by exact cosine: ``queries(query_id, vector[, kinds])``."""
    vectors = concepts.select("iri", "kind", F.col("embedding").alias("vector"))
    found = nearest_vectors(queries, vectors, limit, min_score, **blocks)
    return found.withColumnRenamed("rank", "retrieval_rank")


def kind_from_store(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STORE_TO_KIND.items() for x in kv])
    return F.coalesce(table[c], F.lit("unknown"))


def kinds_for_store(kinds: Column) -> Column:
    """Expected kinds in the store's words; NULL, meaning no filter, when none has a counterpart."""
    groups: dict[str, list[str]] = {}
    for store, kind in STORE_TO_KIND.items():
        groups.setdefault(kind, []).append(store)
    table = F.create_map(
        *[x for k, names in groups.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names]))]
    )
    listed = F.flatten(F.transform(kinds, lambda k: F.coalesce(table[k], F.array().cast("array<string>"))))
    return F.when(F.size(listed) > 0, listed)


def search_filter(
    concepts: DataFrame,
    ontology_id: str | None = None,
    include_deprecated: bool = False,
    kinds: list[str] | None = None,
    branches: list[str] | None = None,
    groups: list[str] | None = None,
) -> DataFrame:
    """Concepts a search may return; score them with :func:`token_retrieve` or vectors."""
    if ontology_id is not None:
        concepts = concepts.where(F.col("ontology_id") == ontology_id)
    if not include_deprecated:
        concepts = concepts.where(~F.coalesce("deprecated", F.lit(False)))
    if kinds:
        concepts = concepts.where(F.col("kind").isin(kinds))
    for column, wanted in (("branch_ids", branches), ("group_ids", groups)):
        if wanted:
            concepts = concepts.where(F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted])))
    return concepts


def search(reqs: DataFrame, concepts: DataFrame, top: int = 10, **filters) -> DataFrame:
    return token_retrieve(reqs, search_filter(concepts, **filters), top)


def graph_context(quads: DataFrame, group_predicate: str | None = None) -> DataFrame:
    """``(iri, relation, other)``: parents, ancestors, children, siblings and groups of concepts.

    Long rows instead of arrays: a parent with very many children stays spread out. Siblings share a
    parent and are the one relation whose size is quadratic by definition; ask for it per concept
    with :func:`siblings_of`.
    """
    parents = paths.edges(quads, V.SKOS + "broader", V.RDFS + "subClassOf").distinct()
    ancestors = paths.one_or_more(parents)

    def rel(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.select(F.col("s").alias("iri"), F.lit(name).alias("relation"), F.col("o").alias("other"))

    out = (
        rel(parents, "parent")
        .unionByName(rel(ancestors, "ancestor"))
        .unionByName(rel(paths.inverse(parents), "child"))
    )
    if group_predicate is not None:
        out = out.unionByName(rel(paths.edges(quads, group_predicate).distinct(), "group"))
    return out


def siblings_of(quads: DataFrame, iris: DataFrame) -> DataFrame:
    """``(iri, relation, other)``: other children of the parents of the given concepts."""
    parents = paths.edges(quads, V.SKOS + "broader", V.RDFS + "subClassOf").distinct()
    asked = iris.select(F.col("iri").alias("s")).distinct().join(parents, "s")
    children = parents.select("o", F.col("s").alias("other"))
    pairs = asked.join(children, "o").where(F.col("s") != F.col("other"))
    return pairs.select(
        F.col("s").alias("iri"), F.lit("sibling").alias("relation"), "other"
    ).distinct()


def listed_context(context: DataFrame) -> DataFrame:
    """One row per concept with an array per relation, for concepts of ordinary size."""
    def gather(name: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("relation") == name, F.col("other"))))

    return context.groupBy("iri").agg(
        gather("parent").alias("parents"),
        gather("ancestor").alias("ancestors"),
        gather("child").alias("children"),
        gather("sibling").alias("siblings"),
        gather("group").alias("group_ids"),
    )


# ---- tagging and deduplication --------------------------------------------------------------


def tag(hits: DataFrame) -> DataFrame:
    """Add ``rag_mention`` and ``rag_mentions`` lineage and a running ``seq`` order per question."""
    return hits.withColumn("rag_mention", F.col("mention")).withColumn(
        "rag_mentions", F.array("mention")
    )


def dedupe(hits: DataFrame) -> DataFrame:
    """One row per question and IRI: best score, smallest rank, all mentions best first.

    Needs ``seq``, the order hits came in; it decides between equal scores. Repeats of one mention are
    folded before the final grouping.
    """
    usable = hits.where(F.coalesce("iri", F.lit("")) != "")
    order = F.struct((-F.col("score")).alias("neg"), F.col("seq"))
    matched = F.struct(order.alias("ord"), F.col("matched_text").alias("text"))
    has_text = F.coalesce(F.col("matched_text"), F.lit("")) != ""
    per_mention = usable.groupBy("question_id", "iri", "mention").agg(
        F.min(order).alias("ord"),
        F.min("retrieval_rank").alias("retrieval_rank"),
        F.min(F.when(has_text, matched)).alias("matched"),
    )
    lineage = F.array_sort(F.collect_list(F.struct("ord", "mention"))).alias("rows")
    out = per_mention.groupBy("question_id", "iri").agg(
        F.min("ord").alias("ord"),
        F.min("retrieval_rank").alias("retrieval_rank"),
        F.min("matched").alias("matched"),
        lineage,
    )
    mentions = F.array_distinct(F.filter(F.transform("rows", lambda r: r["mention"]), lambda m: m != ""))
    return out.select(
        "question_id",
        "iri",
        (-F.col("ord.neg")).alias("score"),
        "retrieval_rank",
        F.col("matched.text").alias("matched_text"),
        F.col("rows")[0]["mention"].alias("rag_mention"),
        mentions.alias("rag_mentions"),
        F.col("ord.seq").alias("seq"),
    )


def dedupe_reranked(reranked: DataFrame) -> DataFrame:
    """Best final score per question and IRI, with ranks rebuilt."""
    from pyspark.sql import Window

    usable = reranked.where(F.coalesce("iri", F.lit("")) != "")
    cols = [c for c in usable.columns if c not in ("question_id", "iri", "rank")]
    best = F.max_by(F.struct(*cols, "rank"), F.struct(F.col("final_score"), -F.col("rank"))).alias("b")
    once = usable.groupBy("question_id", "iri").agg(best).select("question_id", "iri", "b.*")
    window = Window.partitionBy("question_id").orderBy(F.desc("final_score"), F.asc("rank"), F.asc("iri"))
    return once.withColumn("rank", F.row_number().over(window) - 1)


# ---- selection ------------------------------------------------------------------------------


def select(reranked: DataFrame, threshold: float = 0.0, limit: int = SELECTED_LIMIT) -> DataFrame:
    """Rows at or above the threshold, the first ``limit`` per question."""
    kept = reranked.where(F.col("final_score") >= threshold).withColumnRenamed("rank", "__old")
    return top_k(kept, ["question_id"], [F.asc("__old")], limit).drop("__old")


def promote(selected: DataFrame, mention_kinds: DataFrame, threshold: float) -> DataFrame:
    """Selected concepts as term candidates.

    Unknown kinds, low scores and kinds that conflict with the mention's expected kinds are left
    out; ``datatype`` becomes ``unknown``. ``mention_kinds(question_id, mention, kinds)``.
    """
    ok = (
        (F.coalesce("iri", F.lit("")) != "")
        & (F.col("kind") != "unknown")
        & (F.col("final_score") >= threshold)
    )
    expected = mention_kinds.select(
        "question_id", F.col("mention").alias("rag_mention"), F.col("kinds").alias("__kinds")
    )
    joined = selected.where(ok).join(expected, ["question_id", "rag_mention"], "left")
    agrees = (F.coalesce(F.size("__kinds"), F.lit(0)) <= 0) | F.array_contains("__kinds", F.col("kind"))
    return joined.where(agrees).select(
        "question_id",
        F.coalesce("rag_mention", F.lit("")).alias("mention"),
        "iri",
        "prefixed_name",
        F.when(F.col("kind") == "datatype", "unknown").otherwise(F.col("kind")).alias("kind"),
        "label",
        F.col("final_score").alias("score"),
        F.format_string(
            "rag (final=%.2f, retrieval=%.2f, rerank+=%.2f)", "final_score", "retrieval_score", "rerank_score"
        ).alias("explanation"),
        F.col("rank").cast("long").alias("seq"),
    )


def unresolved(reqs: DataFrame, hits: DataFrame) -> DataFrame:
    """Mentions without any hit."""
    asked = reqs.where(F.col("mention") != WHOLE_QUESTION).select("question_id", "mention")
    return asked.join(hits.select("question_id", "mention").distinct(), ["question_id", "mention"], "left_anti")


def candidate_pack(selected: DataFrame, mentions: DataFrame) -> DataFrame:
    """Selected concepts under their mention, in rank order; leftovers under ``<question>``.

    At most ``SELECTED_LIMIT`` rows per question reach this point, so the lists are short.
    """
    known = mentions.select("question_id", F.col("text").alias("rag_mention")).distinct()
    tagged = known.withColumn("__known", F.lit(True))
    placed = selected.join(tagged, ["question_id", "rag_mention"], "left").withColumn(
        "mention", F.when(F.col("__known"), F.col("rag_mention")).otherwise(WHOLE_QUESTION)
    )
    rows = placed.select("question_id", "mention", F.struct("rank", "iri", "final_score").alias("concept"))
    # mentions join the grouping as rows without a concept, so that the ranking is computed once
    asked = known.withColumnRenamed("rag_mention", "mention")
    gathered = F.array_sort(F.collect_list("concept"))
    packed = rows.unionByName(asked, allowMissingColumns=True).groupBy("question_id", "mention").agg(gathered.alias("concepts"))
    return packed.withColumn("concepts", F.when(F.size("concepts") > 0, F.col("concepts")))


def of_kinds(selected: DataFrame, kinds: list[str]) -> DataFrame:
    return selected.where(F.col("kind").isin(kinds))


def selected_iris(selected: DataFrame) -> DataFrame:
    return selected.select("question_id", "iri").distinct()


def diagnostics(reqs: DataFrame, hits: DataFrame, reranked: DataFrame, selected: DataFrame) -> DataFrame:
    """``(question_id, name, n)``: hits per mention, and how many were reranked and selected."""
    per = hits.groupBy("question_id", F.col("mention").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    asked = reqs.select("question_id", F.col("mention").alias("name")).distinct()
    counts = asked.join(per, ["question_id", "name"], "left").select(
        "question_id", "name", F.coalesce("n", F.lit(0)).alias("n")
    )

    def total(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
        ids = reqs.select("question_id").distinct()
        return ids.join(n, "question_id", "left").select(
            "question_id", F.lit(name).alias("name"), F.coalesce("n", F.lit(0)).alias("n")
        )

    return counts.unionByName(total(reranked, "reranked")).unionByName(total(selected, "selected"))
