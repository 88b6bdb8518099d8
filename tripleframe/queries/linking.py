"""Mentions, links and relation hints over names and questions taken from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.functions import text as tx
from tripleframe.plans import discovery, hints, linking, mentions
from tripleframe.operators.similarity import contained_pairs
from tripleframe.queries import once, registry
from tripleframe.queries.graph import EX
from tripleframe.session import cut_lineage
from tripleframe.sources import relational as R

add = registry.add
c = F.col

# ---- terms and mentions ---------------------------------------------------------------------

_TERMS = """
tm AS (SELECT DISTINCT 'individual' AS kind, 3 AS kr, 'http://example.org/name/' || replace(p_name, ' ', '_') AS iri, NULL AS prefixed_name, p_name AS label FROM part
UNION ALL SELECT DISTINCT 'class', 1, 'http://example.org/type/' || p_type, 'ex:' || p_type, p_type FROM part
UNION ALL SELECT DISTINCT 'property', 2, 'http://example.org/does/' || event_type, NULL, event_type FROM events
UNION ALL SELECT DISTINCT 'graph', 4, 'http://example.org/graph/' || source, 'ex:' || source, NULL FROM documents),
fm AS (SELECT kind, kr, iri, 0 AS pos, label AS form FROM tm WHERE kind <> 'graph'
UNION ALL SELECT kind, kr, iri, 1, string_split(iri, '/')[-1] FROM tm WHERE kind IN ('individual', 'property')
UNION ALL SELECT kind, kr, iri, n, label FROM tm, (VALUES (1), (2)) AS x(n) WHERE kind = 'class'
UNION ALL SELECT kind, kr, iri, 0, string_split(iri, '/')[-1] FROM tm WHERE kind = 'graph'
UNION ALL SELECT kind, kr, iri, 1, prefixed_name FROM tm WHERE kind = 'graph'
UNION ALL SELECT kind, kr, iri, 2, string_split(iri, '/')[-1] FROM tm WHERE kind = 'graph')"""
# Names here are at most two words, and only the last word can be a plural.
_NORM = "(CASE WHEN length(string_split({0}, ' ')[-1]) > 4 AND {0} LIKE '%s' AND right({0}, 2) NOT IN ('ss', 'us', 'is', 'os') THEN left({0}, length({0}) - 1) ELSE {0} END)"


def _norm(x: str) -> str:
    return _NORM.format(f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))")


_MENTIONS = "m AS (SELECT DISTINCT mention FROM (SELECT CASE WHEN p_name LIKE '%rod' OR p_name LIKE '%gizmo' THEN upper(p_name) ELSE p_name || 's' END AS mention FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_brand FROM part))"
_LINK = f"""WITH {_TERMS}, {_MENTIONS},
mn AS (SELECT mention, {_norm('mention')} AS nm FROM m), fn AS (SELECT *, {_norm('form')} AS nf FROM fm WHERE kind IN ('individual', 'class')),
sc AS (SELECT mention, kind, kr, iri, max(CASE WHEN nm = nf THEN 1.0 WHEN contains(nf, nm) OR contains(nm, nf) THEN 0.85 ELSE 0 END)::DOUBLE AS score FROM mn, fn GROUP BY ALL HAVING score >= 0.85),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY mention ORDER BY score DESC, kr, iri) - 1 AS INT) AS rank FROM sc QUALIFY rank < 10)"""


@once
def name_terms(spark, d) -> DataFrame:
    tb = R.read_tables(spark, d, "part", "events", "documents")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")

    def term(table, column, kind, name, prefixed, label):
        rows = tb[table].select(c(column).alias("v")).distinct()
        return rows.select(
            F.lit(kind).alias("kind"), F.concat(F.lit(f"{EX}{name}/"), F.replace("v", F.lit(" "), F.lit("_"))).alias("iri"),
            (F.concat(F.lit("ex:"), c("v")) if prefixed else none).alias("prefixed_name"),
            (c("v") if label else none).alias("label"), empty.alias("aliases"),
        )

    return reduce(
        DataFrame.unionByName,
        [
            term("part", "p_name", "individual", "name", False, True), term("part", "p_type", "class", "type", True, True),
            term("events", "event_type", "property", "does", False, True), term("documents", "source", "graph", "graph", True, False),
        ],
    )


def part_mentions(spark, d):
    part = R.read_tables(spark, d, "part")["part"]
    irregular = c("p_name").endswith("rod") | c("p_name").endswith("gizmo")
    name = F.when(irregular, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("s")))
    options = F.array(name, F.substring_index("p_name", " ", 1), c("p_type"), c("p_brand"))
    once_each = part.select(F.explode(options).alias("mention")).distinct()
    return once_each.withColumn("kinds", F.array(F.lit("individual"), F.lit("class")))


@add(f"WITH {_TERMS} SELECT kind, iri, CAST(pos AS INT) AS pos, form FROM fm")
def surface_forms(spark, d):
    return linking.surface_forms(name_terms(spark, d)).select("kind", "iri", "pos", "form")


_LEMMA = "CASE WHEN x = 'people' OR x = 'persons' THEN 'person' WHEN x = 'companies' THEN 'company' WHEN x = 'organisations' THEN 'organisation' WHEN x = 'organizations' THEN 'organization' WHEN x IN ('projects', 'employees', 'graphs') THEN left(x, length(x) - 1) WHEN length(x) > 4 AND x LIKE '%ies' THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 4 AND x LIKE '%s' AND right(x, 2) NOT IN ('ss', 'us', 'is', 'os') THEN left(x, length(x) - 1) ELSE x END"


@add(f"SELECT doc_id, md5(array_to_string(list_transform(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: {_LEMMA}), ' ')) AS hash FROM documents")
def normalise_texts(spark, d):
    docs = R.read_tables(spark, d, "documents")["documents"]
    return docs.select("doc_id", F.md5(tx.normalise(c("text"))).alias("hash"))


@add(f"""{_LINK} SELECT m.mention, coalesce(rk.iri, '') AS iri, coalesce(rk.kind, 'unknown') AS kind, tm.label, coalesce(score, 0.0) AS score, coalesce(rank, 0) AS rank
FROM m LEFT JOIN rk ON rk.mention = m.mention LEFT JOIN tm ON tm.iri = rk.iri AND tm.kind = rk.kind""")
def link_mentions(spark, d):
    return linking.link(part_mentions(spark, d), name_terms(spark, d), min_score=0.85).select("mention", "iri", "kind", "label", "score", "rank")


@add(f"""{_LINK}, tp AS (SELECT m.mention, a.iri, a.score, b.score AS runner, tm.label, tm.prefixed_name FROM m LEFT JOIN rk a ON a.mention = m.mention AND a.rank = 0 LEFT JOIN rk b ON b.mention = m.mention AND b.rank = 1 LEFT JOIN tm ON tm.iri = a.iri AND tm.kind = a.kind)
SELECT mention, iri, CASE WHEN iri IS NULL THEN 'unresolved' WHEN lower(mention) IN (lower(label), lower(prefixed_name), lower(string_split(iri, '/')[-1])) THEN 'selected' WHEN score - runner < 0.05 THEN 'ambiguous' ELSE 'selected' END AS status FROM tp""")
def decide_links(spark, d):
    linked = linking.link(part_mentions(spark, d), name_terms(spark, d), min_score=0.85)
    return linking.decide(linked).select("mention", "iri", "status")


@add()
def link_mentions_by_similarity(spark, d):
    part = R.read_tables(spark, d, "part")["part"]
    swapped = F.concat_ws(" ", F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1), F.lower("p_type"))
    return linking.link(part.select(swapped.alias("mention")), name_terms(spark, d)).select("mention", "iri", "kind", "score", "rank")


def _lines(spark, d, flag, *also):
    """Mentions of parts in orders; without further columns once each, by their keys, before texts are made of them."""
    lines = R.read_tables(spark, d, "lineitem")["lineitem"].where(c("l_returnflag") == flag).select("l_orderkey", "l_partkey", *also)
    lines = lines if also else lines.distinct()
    return lines.select(c("l_orderkey").alias("question_id"), F.concat(F.lit("Part "), c("l_partkey").cast("string")).alias("mention"), R.entity("part", "l_partkey").alias("iri"), *also)


@add("""WITH x AS (SELECT l_orderkey AS q, l_partkey AS k, l_returnflag AS f FROM lineitem), base AS (SELECT DISTINCT q, k FROM x WHERE f = 'A'),
amb AS (SELECT DISTINCT q, k FROM x WHERE f = 'N'), sup AS (SELECT DISTINCT q, k FROM x WHERE f = 'R' AND (q, k) NOT IN (SELECT q, k FROM amb))
SELECT q AS question_id, 'http://example.org/part/' || k AS iri, 'baseline' AS origin FROM base UNION ALL SELECT q, 'http://example.org/part/' || k, 'supplemental' FROM sup WHERE (q, k) NOT IN (SELECT q, k FROM base)""")
def merge_supplemental_links(spark, d):
    a, n, r = _lines(spark, d, "A"), _lines(spark, d, "N"), _lines(spark, d, "R", "l_linenumber", "l_suppkey")
    base = a.select("question_id", "mention", "iri", F.lit("individual").alias("kind"), F.lit(1.0).alias("score"))
    extra = r.select("question_id", (c("l_linenumber") * 1000000 + c("l_suppkey")).cast("long").alias("seq"), "mention", "iri", F.lit("individual").alias("kind"), F.lit(0.9).alias("score"))
    open_ones = r.select("question_id", "mention").distinct()
    merged, _, _ = linking.merge_supplemental(base, open_ones, n.select("question_id", "mention"), extra)
    return merged.select("question_id", "iri", "origin")


# ---- questions ------------------------------------------------------------------------------

_QUESTION = """CASE p_type WHEN 'ECONOMY' THEN 'How many employees per company make the ' || p_name WHEN 'LARGE' THEN 'Who knows the oldest ' || p_name || ' of Acme-7 or Foo-Bar'
WHEN 'MEDIUM' THEN 'Which people joined after 2019 with ' || p_brand WHEN 'PROMO' THEN 'List friends of ' || p_name || ' in a company' WHEN 'SMALL' THEN 'Show every project that ' || p_name || ' contributes to, founded by Acme'
ELSE 'Ping ' || p_name || ' or small' END"""
_QS = f"qs AS (SELECT p_partkey AS question_id, {_QUESTION} AS q FROM part)"


@once
def part_questions(spark, d):
    return R.read_tables(spark, d, "part")["part"].select(c("p_partkey").alias("question_id"), F.expr(_QUESTION).alias("question"))


_NEEDLES = """nd AS (SELECT DISTINCT kind, iri, needle, source FROM (SELECT kind, iri, lower(label) AS needle, 'label' AS source FROM tm WHERE label IS NOT NULL
UNION ALL SELECT kind, iri, lower(string_split(iri, '/')[-1]), 'local_name' FROM tm))"""
_NAMES = f"SELECT question_id, iri, kind, source, substr(q, strpos(lower(q), needle), length(needle)) AS text, CAST(strpos(lower(q), needle) - 1 AS INT) AS start FROM qs, nd WHERE contains(lower(q), needle)"


@add(f"WITH {_TERMS}, {_QS}, {_NEEDLES} SELECT question_id, kind, source, text, start FROM ({_NAMES})")
def mentions_of_known_names(spark, d):
    found = mentions.scan_names(part_questions(spark, d), name_terms(spark, d))
    return found.select("question_id", c("kinds")[0].alias("kind"), "source", "text", "start")


_VERBS = r"(?i)\b(works\s+for|knows|founded(?:\s+by)?|joined|contributes\s+to|labels?|age|knows[\^]\+?|transitively\s+knows)\b"
_NOUNS = r"(?i)\b(person|people|company|companies|project|projects|graph)\b"
_VERB_SQL = f"SELECT question_id, lower(unnest(regexp_extract_all(q, '{_VERBS}', 1))) AS text FROM qs"
_NOUN_SQL = f"SELECT question_id, lower(unnest(regexp_extract_all(q, '{_NOUNS}', 1))) AS text FROM qs"
_STOP = ", ".join(f"'{w}'" for w in mentions.STOPWORDS + mentions.IMPERATIVES)
_CAP_SQL = rf"SELECT * FROM (SELECT question_id, unnest(regexp_extract_all(q, '\b([A-Z][a-zA-Z0-9_-]+)\b', 1)) AS text FROM qs) WHERE lower(text) NOT IN ({_STOP}) AND NOT regexp_matches(text, '^[^-]*-[0-9]+$')"
_WORD_SQL = r"SELECT * FROM (SELECT question_id, unnest(regexp_extract_all(q, '\b([a-z][a-zA-Z0-9_-]+)\b', 1)) AS text FROM qs) WHERE text IN (SELECT lower(p_type) FROM part)"


@add(f"WITH {_QS} {_VERB_SQL}")
def mentions_of_verb_phrases(spark, d):
    return mentions.verb_phrases(part_questions(spark, d)).select("question_id", "text")


@add(f"WITH {_QS} {_NOUN_SQL}")
def mentions_of_class_nouns(spark, d):
    return mentions.class_nouns(part_questions(spark, d)).select("question_id", "text")


@add(f"WITH {_QS} {_CAP_SQL}")
def mentions_capitalised(spark, d):
    return mentions.capitalised_words(part_questions(spark, d)).select("question_id", "text")


@once
def type_individuals(spark, d):
    """Part types as individuals, whose single-word names can occur as words."""
    return name_terms(spark, d).where("kind = 'class'").withColumn("kind", F.lit("individual"))


@add(f"WITH {_QS} {_WORD_SQL}")
def mentions_of_individual_names(spark, d):
    return mentions.individual_names(part_questions(spark, d), type_individuals(spark, d)).select("question_id", "text")


@add(f"""WITH {_TERMS}, {_QS}, {_NEEDLES}, al AS (SELECT question_id, text FROM ({_NAMES}) UNION ALL {_VERB_SQL} UNION ALL {_NOUN_SQL} UNION ALL {_CAP_SQL})
SELECT question_id, count(DISTINCT lower(text)) AS n FROM al GROUP BY 1""")
def mentions_merged(spark, d):
    found = mentions.extract(part_questions(spark, d), name_terms(spark, d))
    return found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))


@add("""WITH nd AS (SELECT DISTINCT lower(text) AS needle FROM benchmark)
SELECT needle, count(*) AS docs FROM nd, documents WHERE length(needle) >= 2 AND contains(lower(documents.text), needle) GROUP BY 1""")
def names_inside_whole_documents(spark, d):
    tb = R.read_tables(spark, d, "documents", "benchmark")
    needles = tb["benchmark"].select(F.lower("text").alias("needle")).distinct()
    docs = tb["documents"].select("doc_id", F.lower("text").alias("body"))
    return contained_pairs(docs, "doc_id", "body", needles, "needle", min_length=2).groupBy("needle").agg(F.count(F.lit(1)).alias("docs"))


@add()
def mentions_in_whole_documents(spark, d):
    """All five finders over all documents: every mention with its kinds, finders and span."""
    tb = R.read_tables(spark, d, "documents", "benchmark")
    docs = tb["documents"].select(c("doc_id").alias("question_id"), c("text").alias("question"))
    # Benchmark passages as individuals: the passage is the label, its first word the short name.
    passages = tb["benchmark"].select(
        F.lit("individual").alias("kind"), R.entity("item", "item_id").alias("iri"),
        F.concat(F.lit("ex:"), F.lower(F.substring_index("text", " ", 1))).alias("prefixed_name"), c("text").alias("label"),
        F.array().cast("array<string>").alias("aliases"),
    )
    found = mentions.extract(docs, name_terms(spark, d).unionByName(passages))
    listed = [F.array_join(x, ",").alias(x) for x in ("kinds", "sources")]
    return found.select(c("question_id").alias("doc_id"), "text", *listed, "start", "end")


# ---- relation hints -------------------------------------------------------------------------


@once
def people_schema(spark, d):
    """Schema of customers as persons employed by nations, and orders as projects that know them."""
    tb = R.read_tables(spark, d, "customer", "orders", "nation")
    kind = lambda k: F.lit(EX + k)
    g = R.melted_triples(
        tb["customer"], R.entity("person", "c_custkey"),
        {V.RDF_TYPE: kind("Person"), EX + "worksFor": R.entity("company", "c_nationkey"), EX + "age": t.integer_term(F.floor(c("c_acctbal") / 200))},
    )
    g = g.unionByName(R.melted_triples(tb["nation"], R.entity("company", "n_nationkey"), {V.RDF_TYPE: kind("Company")}))
    g = g.unionByName(
        R.melted_triples(
            tb["orders"], R.entity("project", "o_orderkey"),
            {V.RDF_TYPE: kind("Project"), EX + "knows": R.entity("person", "o_custkey"), EX + "joined": t.date_term(c("o_orderdate"))},
        )
    )
    used = g.where(c("p") == V.RDF_TYPE).select("o").distinct()
    labels = R.triples(used, c("o"), {V.RDFS_LABEL: t.string_term(tx.last_segment(c("o")))})
    schema = discovery.snapshot(g.unionByName(labels))
    # Small and read many times: discover once, continue from the written rows.
    return cut_lineage(schema.where(c("kind").isin("class", "property")))


_E = "'http://example.org/"
_NAMED = f"""SELECT question_id, {_E}age' AS property_iri, {_E}Person' AS subject_type, 'http://www.w3.org/2001/XMLSchema#integer' AS object_type, 'age' AS rule, 0.9::DOUBLE AS score FROM qs JOIN part ON question_id = p_partkey WHERE p_type = 'LARGE'
UNION ALL SELECT question_id, {_E}knows', {_E}Project', {_E}Person', 'knows', 0.9 FROM qs JOIN part ON question_id = p_partkey WHERE p_type IN ('LARGE', 'PROMO')
UNION ALL SELECT question_id, {_E}joined', {_E}Project', 'http://www.w3.org/2001/XMLSchema#date', 'date', 0.85 FROM qs JOIN part ON question_id = p_partkey WHERE p_type = 'MEDIUM'"""
_HINTS = f"""{_NAMED} UNION ALL SELECT question_id, {_E}worksFor', {_E}Person', {_E}Company', 'employment', 0.95 FROM qs JOIN part ON question_id = p_partkey WHERE p_type IN ('ECONOMY', 'PROMO')
UNION ALL SELECT p_partkey, {_E}worksFor', {_E}Person', {_E}Company', 'class_pair', 0.8 FROM part WHERE p_type = 'SMALL'
UNION ALL SELECT p_partkey, {_E}knows', {_E}Project', {_E}Person', 'class_pair', 0.8 FROM part WHERE p_type = 'SMALL' AND p_size > 25"""


def selected_classes(spark, d):
    part = R.read_tables(spark, d, "part")["part"].where("p_type = 'SMALL'")
    names = F.array_compact(F.array(F.lit("Person"), F.lit("Company"), F.when(c("p_size") > 25, "Project")))
    rows = part.select(c("p_partkey").alias("question_id"), F.explode(names).alias("label"))
    return rows.select("question_id", F.lower("label").alias("mention"), F.concat(F.lit(EX), "label").alias("iri"), F.lit("class").alias("kind"), "label")


@add(f"SELECT {_E}worksFor' AS property_iri, {_E}Person' AS subject_type, {_E}Company' AS object_type FROM customer UNION SELECT {_E}knows', {_E}Project', {_E}Person' FROM orders UNION SELECT {_E}age', {_E}Person', 'http://www.w3.org/2001/XMLSchema#integer' FROM customer UNION SELECT {_E}joined', {_E}Project', 'http://www.w3.org/2001/XMLSchema#date' FROM orders")
def property_connections(spark, d):
    props = people_schema(spark, d).where(c("iri").startswith(EX))
    return hints.connections(props.where("kind = 'property'"))


@add(f"WITH {_QS} {_NAMED}")
def hints_from_cues(spark, d):
    found = hints.named_property(part_questions(spark, d), people_schema(spark, d))
    return found.select("question_id", "property_iri", "subject_type", "object_type", "rule", "score")


@add(f"WITH {_QS} {_HINTS}")
def hints_all_rules(spark, d):
    return hints.infer(part_questions(spark, d), selected_classes(spark, d), people_schema(spark, d))
