"""Concept retrieval, deduplication, reranking and selection over data taken from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.plans import rerank as K
from tripleframe.plans import retrieval as R
from tripleframe.queries import iri, once, registry
from tripleframe.queries.graph import EX, shop
from tripleframe.queries.linking import _QS, _QUESTION, name_terms, part_questions
from tripleframe.sources import relational as rel

EVERY = 2**31 - 1  # no limit
add = registry.add
c = F.col

# ---- token retrieval ------------------------------------------------------------------------

_CONCEPTS = """
cn AS (SELECT DISTINCT 'http://example.org/name/' || replace(p_name, ' ', '_') AS iri, 'individual' AS kind, p_name AS label FROM part UNION ALL SELECT DISTINCT 'http://example.org/type/' || p_type, 'class', p_type FROM part),
fm AS (SELECT iri, kind, 0 AS pos, label AS form FROM cn UNION ALL SELECT iri, kind, 1, split_part(label, ' ', 2) FROM cn WHERE kind = 'individual' UNION ALL SELECT iri, kind, 2, string_split(iri, '/')[-1] FROM cn
UNION ALL SELECT iri, kind, 1, 'ex:' || label FROM cn WHERE kind = 'class'),
ft AS (SELECT *, lower(form) AS ct, list_distinct(list_filter(regexp_split_to_array(lower(form), '[^a-z0-9]+'), lambda x: x <> '')) AS cw FROM fm)"""


def _retrieve_sql(texts: str, limit: int, allowed: str = "true") -> str:
    return f"""WITH {_CONCEPTS}, {texts},
qt AS (SELECT DISTINCT t, list_distinct(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: x <> '')) AS qw FROM tx),
sc AS (SELECT t, iri, max(CASE WHEN t = ct THEN 1.0 WHEN contains(ct, t) OR contains(t, ct) THEN 0.85 ELSE 0.5 * len(list_intersect(qw, cw)) / greatest(len(qw), len(cw)) END)::DOUBLE AS score FROM qt, ft WHERE {allowed} GROUP BY 1, 2 HAVING score > 0),
rk AS (SELECT t, iri, score, CAST(row_number() OVER (PARTITION BY t ORDER BY score DESC, iri) - 1 AS INT) AS retrieval_rank FROM sc QUALIFY retrieval_rank < {limit})"""


@once
def name_concepts(spark, d):
    empty = F.array().cast("array<string>")
    terms = name_terms(spark, d).where(c("kind").isin("individual", "class"))
    noun = F.when(c("kind") == "individual", F.array(F.substring_index("label", " ", -1))).otherwise(empty)
    return terms.select("iri", "prefixed_name", "label", noun.alias("aliases"), "kind", empty.alias("domain"), empty.alias("range"))


def part_requests(spark, d):
    part = rel.read_tables(spark, d, "part")["part"]
    text = F.concat_ws(" ", c("p_name"), F.when(c("p_size") > 25, F.lower("p_type")))
    return part.select(c("p_partkey").alias("question_id"), c("p_name").alias("mention"), text.alias("text"), R.empty_kinds().alias("kinds"))


_TX = "tx AS (SELECT p_partkey AS question_id, CASE WHEN p_size > 25 THEN p_name || ' ' || lower(p_type) ELSE p_name END AS t FROM part)"


@add(f"{_retrieve_sql(_TX, 5)} SELECT question_id, iri, round(score, 6) AS score, retrieval_rank FROM tx JOIN rk USING (t)")
def retrieve_by_tokens(spark, d):
    hits = R.token_retrieve(part_requests(spark, d), name_concepts(spark, d), limit=5)
    return hits.select("question_id", "iri", F.round("score", 6).alias("score"), "retrieval_rank")


_LIVE = "iri IN (SELECT iri FROM cn WHERE kind = 'individual' AND NOT lower(label) LIKE '%e')"


@add(f"{_retrieve_sql(_TX, 10, _LIVE)} SELECT question_id, iri, round(score, 6) AS score, retrieval_rank FROM tx JOIN rk USING (t)")
def concept_search_scores(spark, d):
    concepts = name_concepts(spark, d).withColumn("ontology_id", F.lit("shop")).withColumn("deprecated", F.lower("label").endswith("e"))
    hits = R.search(part_requests(spark, d), concepts, top=10, ontology_id="shop", kinds=["individual"])
    return hits.select("question_id", "iri", F.round("score", 6).alias("score"), "retrieval_rank")


@add("WITH x AS (SELECT page_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(url || ' ' || html), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS w FROM pages) SELECT page_id, array_to_string(w, ' ') AS words FROM x")
def tokenise(spark, d):
    from tripleframe.functions import text as tx

    pages = rel.read_tables(spark, d, "pages")["pages"]
    return pages.select("page_id", F.array_join(F.array_sort(tx.tokens(F.concat_ws(" ", "url", "html"))), " ").alias("words"))


@add("SELECT kind, CASE WHEN kind IN ('owl_class', 'skos_concept') THEN 'class' WHEN kind = 'rdf_property' THEN 'property' ELSE 'unknown' END AS eval_kind, CASE WHEN kind IN ('owl_class', 'skos_concept') THEN 'owl_class,skos_concept' WHEN kind = 'rdf_property' THEN 'object_property,datatype_property,annotation_property,rdf_property' END AS back, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'owl_class' WHEN 'view' THEN 'skos_concept' WHEN 'error' THEN 'rdf_property' ELSE event_type END AS kind FROM events) GROUP BY ALL")
def store_kinds(spark, d):
    e = c("event_type")
    kind = F.when(e == "click", "owl_class").when(e == "view", "skos_concept").when(e == "error", "rdf_property").otherwise(e)
    rows = rel.read_tables(spark, d, "events")["events"].select(kind.alias("kind"))
    eval_kind = R.kind_from_store(c("kind"))
    back = F.array_join(R.kinds_for_store(F.array(eval_kind)), ",")
    return rows.groupBy("kind", eval_kind.alias("eval_kind"), back.alias("back")).agg(F.count(F.lit(1)).alias("n"))


@add("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings)
SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS iri, round(round(list_cosine_similarity(a.e, b.e), 9), 6) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, CAST(b.vec_id AS VARCHAR)) - 1 AS INT) AS retrieval_rank
FROM v a, v b WHERE a.label % 2 = 0 OR a.label = b.label QUALIFY retrieval_rank < 5""")
def retrieve_by_vectors(spark, d):
    rows = rel.read_tables(spark, d, "embeddings")["embeddings"]
    kinds = F.when(c("label") % 2 != 0, F.array(c("label").cast("string")))
    queries = rows.select(c("vec_id").cast("string").alias("query_id"), c("embedding").alias("vector"), kinds.alias("kinds"))
    concepts = rows.select(c("vec_id").cast("string").alias("iri"), c("label").cast("string").alias("kind"), "embedding")
    out = R.vector_retrieve(queries, concepts, limit=5)
    return out.select("query_id", "iri", F.round("score", 6).alias("score"), "retrieval_rank")


@add("SELECT 'http://example.org/part/' || p_partkey AS iri FROM part WHERE p_size > 10 AND p_type IN ('LARGE', 'SMALL') AND p_brand IN ('Brand#1', 'Brand#2') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def concept_search_filters(spark, d):
    tb = rel.read_tables(spark, d, "part", "lineitem")
    flags = tb["lineitem"].groupBy(c("l_partkey").alias("p_partkey")).agg(F.collect_set("l_returnflag").alias("group_ids"))
    concepts = tb["part"].join(flags, "p_partkey").select(
        rel.entity("part", "p_partkey").alias("iri"), F.lit("shop").alias("ontology_id"), (c("p_size") <= 10).alias("deprecated"), c("p_type").alias("kind"),
        F.array("p_brand").alias("branch_ids"), "group_ids",
    )
    return R.search_filter(concepts, ontology_id="shop", kinds=["LARGE", "SMALL"], branches=["Brand#1", "Brand#2"], groups=["R"]).select("iri")


def _places(spark, d):
    g = shop(spark, d)
    up = g.where(c("p").isin(EX + "inNation", EX + "inRegion"))
    return up.select("g", "s", F.lit(V.SKOS + "broader").alias("p"), "o")


@add(f"""WITH e AS (SELECT {iri('customer', 'c_custkey')} AS s, {iri('nation', 'c_nationkey')} AS o FROM customer UNION SELECT {iri('supplier', 's_suppkey')}, {iri('nation', 's_nationkey')} FROM supplier UNION SELECT {iri('nation', 'n_nationkey')}, {iri('region', 'n_regionkey')} FROM nation),
a AS (SELECT * FROM e UNION SELECT x.s, y.o FROM e x JOIN e y ON x.o = y.s)
SELECT s AS iri, 'parent' AS relation, o AS other FROM e UNION ALL SELECT s, 'ancestor', o FROM a UNION ALL SELECT o, 'child', s FROM e""")
def concept_context(spark, d):
    return R.graph_context(_places(spark, d))


@add(f"SELECT {iri('nation', 'a.n_nationkey')} AS iri, 'sibling' AS relation, {iri('nation', 'b.n_nationkey')} AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def concept_siblings(spark, d):
    nations = rel.read_tables(spark, d, "nation")["nation"].select(rel.entity("nation", "n_nationkey").alias("iri"))
    return R.siblings_of(_places(spark, d), nations)


# ---- requests -------------------------------------------------------------------------------


def _question_mentions(spark, d):
    """Names of the larger parts as mentions of their own question; small ones have none."""
    part = rel.read_tables(spark, d, "part")["part"].where("p_size > 20")
    text = F.when(c("p_size") > 40, c("p_type")).when(c("p_size") > 30, c("p_name")).otherwise(F.initcap(F.substring_index("p_name", " ", 1)))
    return part.select(c("p_partkey").alias("question_id"), text.alias("text"), F.when(c("p_size") == 50, F.array(F.lit("class"))).alias("kinds"))


_QM = "qm AS (SELECT p_partkey AS question_id, CASE WHEN p_size > 40 THEN p_type WHEN p_size > 30 THEN p_name ELSE upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) END AS text, p_size FROM part WHERE p_size > 20)"


@add(f"WITH {_QM} SELECT question_id, text, CASE WHEN p_size > 40 THEN 'class' WHEN p_size > 30 THEN 'individual' WHEN text IN ('Red', 'Old', 'Hot', 'New', 'Cold', 'Blue', 'Large', 'Small') AND lower(text) IN (SELECT lower(p_type) FROM part) THEN 'class' WHEN text LIKE '%ed' OR text LIKE '%ing' THEN 'property' ELSE 'class,individual' END AS kinds FROM qm")
def mention_kind_hints(spark, d):
    hinted = R.kind_hint(_question_mentions(spark, d), name_terms(spark, d))
    return hinted.select("question_id", "text", F.array_join("kinds", ",").alias("kinds"))


@add(f"WITH {_QS}, {_QM} SELECT question_id, text AS mention, text FROM qm UNION ALL SELECT question_id, '<question>', q FROM qs WHERE question_id NOT IN (SELECT question_id FROM qm)")
def retrieval_requests(spark, d):
    return R.requests(part_questions(spark, d), _question_mentions(spark, d)).select("question_id", "mention", "text")


# ---- hits of orders: brands of their line items ----------------------------------------------

_HITS = "hits AS (SELECT DISTINCT l_orderkey AS question_id, l_linenumber * 1000000 + l_suppkey AS seq, l_returnflag AS mention, 'http://example.org/brand/' || substr(p_brand, 7) AS iri, l_discount AS score, l_linenumber AS retrieval_rank, l_linestatus AS matched_text FROM lineitem JOIN part ON l_partkey = p_partkey)"
_DD = f"""{_HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY question_id, iri ORDER BY score DESC, seq, mention, matched_text) AS rn FROM hits),
mb AS (SELECT question_id, iri, mention, min(rn) AS rn FROM b GROUP BY ALL), ml AS (SELECT question_id, iri, string_agg(mention, ',' ORDER BY rn) AS mentions FROM mb GROUP BY ALL),
dd AS (SELECT b.question_id, b.iri, b.score, r.retrieval_rank, b.mention AS rag_mention, ml.mentions AS rag_mentions FROM b JOIN ml USING (question_id, iri) JOIN (SELECT question_id, iri, min(retrieval_rank) AS retrieval_rank FROM hits GROUP BY ALL) r USING (question_id, iri) WHERE rn = 1)"""


@once
def brand_hits(spark, d):
    tb = rel.read_tables(spark, d, "lineitem", "part")
    lines = tb["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    j = lines.join(tb["part"].select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey"))
    return j.select(
        c("l_orderkey").alias("question_id"), (c("l_linenumber") * 1000000 + c("l_suppkey")).alias("seq"), c("l_returnflag").alias("mention"),
        F.concat(F.lit(EX + "brand/"), F.substring("p_brand", 7, 9)).alias("iri"), c("l_discount").alias("score"), c("l_linenumber").alias("retrieval_rank"),
        c("l_linestatus").alias("matched_text"),
    ).distinct()


@add(f"WITH {_DD} SELECT question_id, iri, score, retrieval_rank, rag_mention, rag_mentions FROM dd")
def dedupe_hits(spark, d):
    out = R.dedupe(R.tag(brand_hits(spark, d)).drop("rag_mention", "rag_mentions"))
    return out.select("question_id", "iri", "score", "retrieval_rank", "rag_mention", F.array_join("rag_mentions", ",").alias("rag_mentions"))


# Concept attributes of a brand: a few facts about its parts.
_BR = """br AS (SELECT 'http://example.org/brand/' || substr(p_brand, 7) AS iri, min(p_name) AS label, CASE WHEN min(p_size) = 1 AND max(p_partkey) % 2 = 0 THEN 'property' ELSE 'class' END AS kind, max(p_name) AS alias, 'ex:' || substr(p_brand, 7) AS prefixed_name,
CASE WHEN max(p_partkey) % 3 = 0 THEN 'http://example.org/Order' ELSE 'http://www.w3.org/2001/XMLSchema#integer' END AS rng FROM part GROUP BY p_brand)"""
_OQ = "oq AS (SELECT l_orderkey AS question_id, 'Show the oldest ' || min(p_name) || ' and ' || max(p_name) || ' of ex:7' AS question FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def brand_concepts(spark, d):
    part = rel.read_tables(spark, d, "part")["part"]
    g = part.groupBy("p_brand").agg(
        F.min("p_name").alias("label"), F.max("p_name").alias("alias"), F.min("p_size").alias("least"), F.max("p_partkey").alias("last")
    )
    number = F.substring("p_brand", 7, 9)
    kind = F.when((c("least") == 1) & (c("last") % 2 == 0), "property").otherwise("class")
    rng = F.when(c("last") % 3 == 0, EX + "Order").otherwise(V.XSD + "integer")
    return g.select(
        F.concat(F.lit(EX + "brand/"), number).alias("iri"), "label", F.array("alias").alias("aliases"), kind.alias("kind"), F.concat(F.lit("ex:"), number).alias("prefixed_name"),
        F.array().cast("array<string>").alias("domain"), F.array(rng).alias("range"),
    )


def order_questions(spark, d):
    tb = rel.read_tables(spark, d, "lineitem", "part")
    j = tb["lineitem"].select("l_orderkey", "l_partkey").join(tb["part"].select("p_partkey", "p_name"), c("l_partkey") == c("p_partkey"))
    text = F.concat(F.lit("Show the oldest "), F.min("p_name"), F.lit(" and "), F.max("p_name"), F.lit(" of ex:7"))
    return j.groupBy(c("l_orderkey").alias("question_id")).agg(text.alias("question"))


def mention_kinds(spark, d):
    lines = rel.read_tables(spark, d, "lineitem")["lineitem"]
    kinds = F.when(c("l_returnflag") == "R", F.array(F.lit("property"))).otherwise(R.empty_kinds())
    return lines.select(c("l_orderkey").alias("question_id"), c("l_returnflag").alias("mention"), kinds.alias("kinds")).distinct()


def reranked(spark, d, limit=3):
    candidates = R.dedupe(brand_hits(spark, d)).join(K.described(brand_concepts(spark, d)), "iri")
    return K.heuristic(
        candidates, order_questions(spark, d), limit, mention_kinds=mention_kinds(spark, d), static_class_terms=["Order"], static_kinds=["class"]
    )


_RR = f"""{_DD}, {_BR}, {_OQ}, cd AS (SELECT dd.*, br.*, lower(question) AS q, count(*) OVER (PARTITION BY dd.question_id, label) AS same FROM dd JOIN br USING (iri) JOIN oq USING (question_id)),
bo AS (SELECT *, CASE WHEN contains(q, label) THEN 0.35 ELSE 0 END + CASE WHEN contains(q, alias) THEN 0.15 ELSE 0 END + CASE WHEN contains(q, prefixed_name) THEN 0.35 ELSE 0 END
+ CASE WHEN kind = CASE WHEN rag_mention = 'R' THEN 'property' ELSE 'class' END THEN 0.2 ELSE -0.2 END + CASE WHEN rng LIKE '%/Order' THEN 0.1 ELSE 0 END
+ CASE WHEN kind = 'property' AND (rng LIKE '%integer' OR label LIKE '%age%') THEN 0.15 ELSE 0 END - CASE WHEN same > 1 THEN 0.05 ELSE 0 END AS boost FROM cd),
rr AS (SELECT *, score + boost::DOUBLE AS final_score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score + boost::DOUBLE, 6) DESC, retrieval_rank, iri) - 1 AS INT) AS rank FROM bo QUALIFY rank < 3)"""


@add(f"WITH {_RR} SELECT question_id, round(boost::DOUBLE, 6) AS boost, count(*) AS n FROM bo GROUP BY ALL")
def rerank_boosts(spark, d):
    out = reranked(spark, d, limit=EVERY)
    return out.groupBy("question_id", F.round("rerank_score", 6).alias("boost")).agg(F.count(F.lit(1)).alias("n"))


@add(f"WITH {_RR} SELECT question_id, round(max(score + boost::DOUBLE), 6) AS best FROM bo GROUP BY 1")
def rerank_top(spark, d):
    out = reranked(spark, d, limit=1)
    return out.select("question_id", F.round("final_score", 6).alias("best"))


@add(f"WITH {_DD} SELECT question_id, iri, score AS final_score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY retrieval_rank, iri) - 1 AS INT) AS rank FROM dd QUALIFY rank < 2")
def rerank_noop(spark, d):
    hits = R.dedupe(brand_hits(spark, d))
    ordered = hits.withColumn("seq", F.struct("retrieval_rank", "iri"))
    return K.noop(ordered, 2).select("question_id", "iri", "final_score", "rank")


@add(f"WITH {_HITS} SELECT question_id, iri, max(score) AS final_score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY max(score) DESC, arg_min(seq, (-score, seq)), iri) - 1 AS INT) AS rank FROM hits GROUP BY 1, 2")
def dedupe_reranked(spark, d):
    rows = brand_hits(spark, d).select("question_id", "iri", c("score").alias("final_score"), c("seq").alias("rank"))
    return R.dedupe_reranked(rows).select("question_id", "iri", "final_score", "rank")


@add(f"""WITH {_QS}, cl AS (SELECT DISTINCT p_type AS label, 'http://example.org/type/' || p_type AS iri, 'ex:' || p_type AS pn FROM part),
ns AS (SELECT question_id, label, iri, pn FROM qs, cl WHERE contains(lower(q), lower(label)) UNION SELECT p_partkey, p_type, 'http://example.org/type/' || p_type, 'ex:' || p_type FROM part WHERE p_size > 25)
SELECT question_id, string_agg(DISTINCT lower(n), ' ' ORDER BY lower(n)) AS names FROM (SELECT question_id, unnest([label, iri, pn]) AS n FROM ns) GROUP BY 1""")
def inferred_class_terms(spark, d):
    part = rel.read_tables(spark, d, "part")["part"].where("p_size > 25")
    base = part.select(
        c("p_partkey").alias("question_id"), F.concat(F.lit(EX + "type/"), c("p_type")).alias("iri"), F.lit("class").alias("kind"), c("p_type").alias("label"),
        F.concat(F.lit("ex:"), c("p_type")).alias("prefixed_name"),
    )
    found = K.inferred_class_terms(part_questions(spark, d), base, name_terms(spark, d))
    return found.select("question_id", F.array_join("class_terms", " ").alias("names"))


# ---- selection ------------------------------------------------------------------------------

# A ranking without close scores: discount and line number decide.
_SEL = f"""{_DD}, {_BR}, rk AS (SELECT dd.question_id, iri, label, kind, prefixed_name, rag_mention, score AS final_score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, iri) - 1 AS rank FROM dd JOIN br USING (iri)),
sl AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS INT) AS place FROM rk WHERE final_score >= 0.03 QUALIFY place < 2)"""


def selected(spark, d):
    from tripleframe.operators.forms import top_k

    rows = R.dedupe(brand_hits(spark, d)).join(brand_concepts(spark, d), "iri").withColumnRenamed("score", "final_score")
    rows = rows.withColumn("retrieval_score", c("final_score")).withColumn("rerank_score", F.lit(0.0))
    return R.select(top_k(rows, ["question_id"], [F.desc("final_score"), F.asc("iri")], EVERY), 0.03, 2)


@add(f"WITH {_SEL} SELECT question_id, iri, place AS rank, final_score FROM sl")
def select_concepts(spark, d):
    return selected(spark, d).select("question_id", "iri", "rank", "final_score")


@add(f"WITH {_SEL} SELECT question_id, iri, rag_mention AS mention, kind, final_score AS score FROM sl WHERE final_score >= 0.05 AND (rag_mention <> 'R' OR kind = 'property')")
def promote_concepts(spark, d):
    return R.promote(selected(spark, d), mention_kinds(spark, d), 0.05).select("question_id", "iri", "mention", "kind", "score")


@add(f"WITH {_SEL}, ms AS (SELECT DISTINCT l_orderkey AS question_id, l_returnflag AS mention FROM lineitem WHERE l_returnflag <> 'N'), pl AS (SELECT s.question_id, CASE WHEN m.mention IS NULL THEN '<question>' ELSE rag_mention END AS mention, iri, place FROM sl s LEFT JOIN ms m ON m.question_id = s.question_id AND m.mention = rag_mention) SELECT question_id, mention, string_agg(iri, ' ' ORDER BY place) AS concepts FROM pl GROUP BY ALL UNION ALL SELECT question_id, mention, NULL FROM ms WHERE (question_id, mention) NOT IN (SELECT (question_id, mention) FROM pl)")
def candidate_pack(spark, d):
    known = rel.read_tables(spark, d, "lineitem")["lineitem"].where("l_returnflag <> 'N'")
    pack = R.candidate_pack(selected(spark, d), known.select(c("l_orderkey").alias("question_id"), c("l_returnflag").alias("text")))
    return pack.select("question_id", "mention", F.array_join(F.transform("concepts", lambda x: x["iri"]), " ").alias("concepts"))


@add(f"WITH {_SEL} SELECT DISTINCT question_id, iri FROM sl WHERE kind = 'property'")
def selected_of_kind(spark, d):
    return R.selected_iris(R.of_kinds(selected(spark, d), ["property"]))


@add(f"{_retrieve_sql(_TX, 20)}, ot AS (SELECT p_partkey AS question_id, lower(p_brand) AS t FROM part) SELECT question_id, 'brand' AS mention FROM ot WHERE t NOT IN (SELECT lower(form) FROM fm)")
def unresolved_mentions(spark, d):
    part = rel.read_tables(spark, d, "part")["part"]
    asked = part.select(c("p_partkey").alias("question_id"), F.lit("brand").alias("mention"), c("p_brand").alias("text"), R.empty_kinds().alias("kinds"))
    both = asked.unionByName(part_requests(spark, d))
    return R.unresolved(both, R.token_retrieve(both, name_concepts(spark, d)))


@add(f"WITH {_SEL} SELECT question_id, mention AS name, count(*) AS n FROM hits GROUP BY ALL UNION ALL SELECT q.question_id, 'reranked', count(rk.iri) FROM (SELECT DISTINCT question_id FROM hits) q LEFT JOIN rk USING (question_id) GROUP BY 1 UNION ALL SELECT q.question_id, 'selected', count(sl.iri) FROM (SELECT DISTINCT question_id FROM hits) q LEFT JOIN sl USING (question_id) GROUP BY 1")
def retrieval_diagnostics(spark, d):
    hits = brand_hits(spark, d)
    return R.diagnostics(hits.select("question_id", "mention"), hits, R.dedupe(hits), selected(spark, d))
