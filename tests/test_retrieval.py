import random

import pytest
from pyspark.sql import functions as F

from tests.sample import EX, SCHEMA
from tripleframe import vocab as V
from tripleframe.plans import rerank as K
from tripleframe.plans import retrieval as R

CONCEPTS = [
    ("Person", "Person", ["human"], "class", [], []),
    ("Company", "Company", [], "class", [], []),
    ("worksFor", "works for", [], "property", ["Person"], ["Company"]),
    ("Acme", "Acme", [], "individual", [], []),
]


@pytest.fixture(scope="module")
def concepts(spark):
    rows = [(EX + n, "ex:" + n, l, a, k, [EX + d for d in dom], [EX + r for r in rng]) for n, l, a, k, dom, rng in CONCEPTS]
    return spark.createDataFrame(
        rows,
        "iri string, prefixed_name string, label string, aliases array<string>, kind string, domain array<string>, range array<string>",
    )


def reqs(spark, *rows):
    return spark.createDataFrame(
        [(q, m, t, k) for q, m, t, k in rows], "question_id int, mention string, text string, kinds array<string>"
    )


def plain_score(text, concept):
    """The scoring rule written out for one pair."""
    n, label, aliases, _, _, _ = concept
    qt, best = text.lower().strip(), 0.0
    words = lambda s: {w for w in "".join(c if c.isalnum() else " " for c in s.lower()).split()}
    for form in [label, *aliases, "ex:" + n, n, n]:
        ct = form.lower().strip()
        if ct == qt:
            return 1.0
        if qt in ct or ct in qt:
            best = max(best, 0.85)
        elif words(qt) & words(ct):
            best = max(best, 0.5 * len(words(qt) & words(ct)) / max(len(words(qt)), len(words(ct))))
    return best


def test_scores_equal_the_rule(spark, concepts):
    texts = ["works for", "acme", "person company works", "nonsense_token", "  ", "HUMAN", "for a human being", "who works", "e"]
    got = {}
    for r in R.token_retrieve(reqs(spark, *[(i, t, t, []) for i, t in enumerate(texts)]), concepts).collect():
        got[(texts[r["question_id"]], r["iri"].replace(EX, ""))] = r["score"]
    want = {(t, c[0]): plain_score(t, c) for t in texts if t.strip() for c in CONCEPTS if plain_score(t, c) > 0}
    assert got == want


def test_kinds_limit_and_ties(spark, concepts):
    out = R.token_retrieve(reqs(spark, (1, "acme", "acme", ["individual"]), (2, "e", "e", None), (3, "e", "e", None)), concepts, limit=2)
    rows = {(r["question_id"], r["retrieval_rank"]): r["iri"].replace(EX, "") for r in out.collect()}
    assert rows == {(1, 0): "Acme", (2, 0): "Acme", (2, 1): "Company", (3, 0): "Acme", (3, 1): "Company"}


def plain_rank(text, kinds, rows, limit):
    """All pairs measured: (iri, score, matched text) of the best concepts."""
    words = lambda s: {w for w in s.lower().split() if w}
    best = {}
    for iri, kind, forms in rows:
        if kinds and kind not in kinds:
            continue
        for pos, form in enumerate(forms):
            q, c = text.lower().strip(), form.lower().strip()
            n = len(words(q) & words(c))
            score = 1.0 if q == c else 0.85 if q in c or c in q else 0.5 * n / max(len(words(q)), len(words(c))) if n else 0.0
            if score:
                best[iri] = min(best.get(iri, (0.0, 0, "")), (-score, pos, form))
    return [(i, -s, m) for i, (s, _, m) in sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:limit]]


def made_concepts(n, seed):
    """Texts of one to five words by falling frequency; "the" is in every text of the first alias."""
    rng, words = random.Random(seed), [f"w{i}x" for i in range(40)]
    pick = lambda: " ".join(words[min(39, int(rng.expovariate(0.12)))] for _ in range(rng.randint(1, 4)))
    return [(f"c{i:04d}", rng.choice(["class", "property"]), [pick(), "the " + pick(), "same for all"][: rng.randint(2, 3)]) for i in range(n)], pick


def as_concepts(spark, rows):
    return spark.createDataFrame(
        [(i, None, f[0], f[1:], k) for i, k, f in rows], "iri string, prefixed_name string, label string, aliases array<string>, kind string"
    )


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_word_lists_read_in_part_rank_as_all_pairs_do(spark, limit):
    rows, pick = made_concepts(150, limit)
    texts = [pick() for _ in range(12)] + ["the", "the " + pick(), "the for w1x", "unknown", "the unknown words", "same for", "same for all", "for all the w39x w0x w1x"]
    kinds = [[], ["class"], ["property", "class"], ["none"]]
    asked = [(i, t, t, k) for i, (t, k) in enumerate((t, k) for t in texts for k in kinds)]
    forms = [(i, k, [*f, i]) for i, k, f in rows]  # the last segment of the IRI is a form too
    got = {}
    for r in R.token_retrieve(reqs(spark, *asked), as_concepts(spark, rows), limit).orderBy("question_id", "retrieval_rank").collect():
        got.setdefault(r["question_id"], []).append((r["iri"], r["score"], r["matched_text"]))
    for q, t, _, k in asked:
        assert got.get(q, []) == plain_rank(t, k, forms, limit), (t, k)


def test_a_word_in_every_text_adds_no_pairs(spark):
    rows = [(f"c{i:04d}", "class", [f"the thing{i}"]) for i in range(400)] + [(f"d{i}", "class", [f"the rare word {i}"]) for i in range(8)]
    forms = R.concept_forms(as_concepts(spark, rows)).withColumn("ct", F.lower("form"))
    index = R.WordIndex(forms, 5)
    asked = spark.createDataFrame([("the rare word", []), ("the", []), ("rare the", [])], "qt string, kinds array<string>")
    per_text = {r["qt"]: r["count"] for r in R.scored_texts(asked, index).where("score < 0.85").groupBy("qt").count().collect()}
    assert per_text.get("the rare word", 0) == 0  # contained texts hold all places
    assert per_text["rare the"] <= 8 + 2 * 5
    assert per_text.get("the", 0) <= 2 * 5
    assert index.postings.where("word = 'the'").count() == 408


def test_search_scores_what_the_filters_leave(spark):
    c = spark.createDataFrame(
        [("ka", "x", "red car", "class", False, ["b1"], ["g1"]), ("kb", "x", "red", "class", True, ["b1"], ["g1"]), ("kc", "y", "red", "class", False, ["b1"], ["g1"]), ("kd", "x", "blue car", "class", None, ["b2"], ["g2"])],
        "iri string, ontology_id string, label string, kind string, deprecated boolean, branch_ids array<string>, group_ids array<string>",
    ).withColumn("prefixed_name", F.lit(None).cast("string")).withColumn("aliases", F.array().cast("array<string>"))
    find = lambda **k: [(r["iri"], r["score"]) for r in R.search(reqs(spark, (1, "m", "the red car", [])), c, **k).orderBy("retrieval_rank").collect()]
    assert find(ontology_id="x") == [("ka", 0.85), ("kd", 1 / 6)]
    assert find(ontology_id="x", include_deprecated=True) == [("ka", 0.85), ("kb", 0.85), ("kd", 1 / 6)]
    assert find(groups=["g1"], top=1) == [("ka", 0.85)]
    assert find(branches=["b3"]) == []


def test_requests_and_hints(spark):
    q = spark.createDataFrame([(1, "Who works for Acme?"), (2, "hm")], "question_id int, question string")
    m = spark.createDataFrame(
        [(1, "works for", ["property"]), (1, "Acme", None), (1, "Aurora", []), (1, "running", []), (1, "x", [])],
        "question_id int, text string, kinds array<string>",
    )
    t = spark.createDataFrame([("individual", "Acme"), ("class", "acme")], "kind string, label string")
    hinted = R.kind_hint(m, t)
    assert {r["text"]: r["kinds"] for r in hinted.collect()} == {
        "works for": ["property"], "Acme": ["class", "individual"], "Aurora": ["class", "individual"], "running": ["property"], "x": [],
    }
    out = R.requests(q, hinted)
    assert out.where("question_id = 2").first()["mention"] == R.WHOLE_QUESTION and out.count() == 6
    assert R.requests(q, hinted, with_question=True).count() == 7


def test_dedupe(spark):
    hits = spark.createDataFrame(
        [(1, 0, "b", "X", 0.5, 3, "mx"), (1, 1, "a", "X", 0.9, 5, ""), (1, 2, "c", "X", 0.9, 1, "m2"), (1, 3, "a", "", 1.0, 0, "z"), (1, 4, "a", "Y", 0.1, 9, None)],
        "question_id int, seq long, mention string, iri string, score double, retrieval_rank int, matched_text string",
    )
    got = {r["iri"]: r for r in R.dedupe(hits).collect()}
    assert set(got) == {"X", "Y"}
    x = got["X"]
    assert (x["score"], x["retrieval_rank"], x["rag_mention"], x["rag_mentions"], x["matched_text"]) == (0.9, 1, "a", ["a", "c", "b"], "m2")
    re = spark.createDataFrame(
        [(1, "X", 0.5, 0), (1, "X", 0.8, 1), (1, "Y", 0.6, 2)], "question_id int, iri string, final_score double, rank int"
    )
    assert sorted((r["rank"], r["iri"], r["final_score"]) for r in R.dedupe_reranked(re).collect()) == [(0, "X", 0.8), (1, "Y", 0.6)]


CAND = (
    "question_id int, iri string, label string, kind string, score double, retrieval_rank int, rag_mention string, "
    "aliases array<string>, prefixed_name string, domain array<string>, range array<string>"
)


def cand(n, score, rank=0, label=None, kind="class", mention=None, aliases=(), prefixed=None, domain=(), range_=()):
    return (1, n, label or n, kind, score, rank, mention, list(aliases), prefixed, list(domain), list(range_))


def ranked(spark, question, rows, limit=9, **kw):
    q = spark.createDataFrame([(1, question)], "question_id int, question string")
    out = K.heuristic(spark.createDataFrame(rows, CAND), q, limit, **kw).orderBy("rank").collect()
    return [(r["iri"], round(r["rerank_score"], 4)) for r in out]


def test_rerank_signals(spark):
    assert ranked(spark, "Show me every Person", [cand("Other", 0.9), cand("Person", 0.6, 1)]) == [("Person", 0.35), ("Other", 0.0)]
    two = [cand("a", 0.7, label="Person"), cand("b", 0.7, label="Person", kind="property")]
    assert ranked(spark, "Person", two, static_kinds=["property"]) == [("b", 0.5), ("a", 0.1)]
    works = cand("w", 0.6, 1, kind="property", domain=[EX + "Person"], range_=[EX + "Company"])
    assert ranked(spark, "q", [cand("r", 0.6, kind="property"), works], static_class_terms=["Person"])[0] == ("w", 0.1)
    assert ranked(spark, "each human", [cand("P", 0.5, aliases=["human", "h"]), cand("Other", 0.6)])[0] == ("P", 0.15)
    age = cand("age", 0.55, 1, kind="property", range_=[V.XSD + "integer"])
    assert ranked(spark, "who is the oldest", [cand("founded by", 0.6, kind="property"), age])[0] == ("age", 0.15)
    join = cand("j", 0.55, 1, label="joined", kind="property", range_=[V.XSD + "date"])
    assert ranked(spark, "joined after 2019", [age, join])[0] == ("j", 0.5)
    assert ranked(spark, "about ex:thing", [cand("t", 0.1, label="zq", prefixed="ex:Thing")])[0] == ("t", 0.35)
    assert len(ranked(spark, "c1", [cand(f"c{i}", 0.5, i) for i in range(5)], limit=3)) == 3
    none = K.Weights(exact_label_match=0.0)
    assert ranked(spark, "Person", [cand("Person", 0.5)], weights=none) == [("Person", 0.0)]


def test_rerank_context(spark):
    mk = spark.createDataFrame([(1, "people", ["class"])], "question_id int, mention string, kinds array<string>")
    rows = [cand("i", 0.7, 0, "Person", "individual", "people"), cand("c", 0.65, 1, "Person", "class", "people")]
    got = ranked(spark, "show every person", rows, mention_kinds=mk)
    assert got == [("c", 0.5), ("i", 0.1)]
    terms = spark.createDataFrame(
        [("class", EX + "Company", "Company", "ex:Company"), ("class", EX + "Zed", "Zed", "ex:Zed")], "kind string, iri string, label string, prefixed_name string"
    )
    q = spark.createDataFrame([(1, "the company of people")], "question_id int, question string")
    base = spark.createDataFrame([(1, EX + "Person", "class", "Person", None)], "question_id int, iri string, kind string, label string, prefixed_name string")
    got = K.inferred_class_terms(q, base, terms).first()["class_terms"]
    assert got == sorted(["company", "ex:company", EX.lower() + "company", EX.lower() + "person", "person"])


def test_noop_select_promote_pack(spark):
    c = spark.createDataFrame([(1, 0, "A", 0.4), (1, 1, "B", 0.9)], "question_id int, seq long, iri string, score double")
    assert [(r["iri"], r["final_score"]) for r in K.noop(c, 5).orderBy("rank").collect()] == [("A", 0.4), ("B", 0.9)]
    rows = [
        (1, "A", "ex:A", "class", "A", 0.9, 0.8, 0.1, 0, "m"), (1, "B", None, "unknown", "B", 0.9, 0.9, 0.0, 1, "m"),
        (1, "C", None, "individual", "C", 0.8, 0.8, 0.0, 2, "m"), (1, "D", None, "datatype", "D", 0.7, 0.7, 0.0, 3, None),
        (1, "E", None, "class", "E", 0.1, 0.1, 0.0, 4, "n"),
    ]
    sel = spark.createDataFrame(
        rows, "question_id int, iri string, prefixed_name string, kind string, label string, final_score double, "
        "retrieval_score double, rerank_score double, rank int, rag_mention string"
    )
    kept = R.select(sel, 0.5, 3)
    assert sorted((r["rank"], r["iri"]) for r in kept.collect()) == [(0, "A"), (1, "B"), (2, "C")]
    mk = spark.createDataFrame([(1, "m", ["class"])], "question_id int, mention string, kinds array<string>")
    got = {(r["iri"], r["kind"], r["mention"]) for r in R.promote(sel, mk, 0.5).collect()}
    assert got == {("A", "class", "m"), ("D", "unknown", "")}
    ms = spark.createDataFrame([(1, "m"), (1, "empty")], "question_id int, text string")
    pack = {r["mention"]: [x["iri"] for x in r["concepts"] or []] for r in R.candidate_pack(sel, ms).collect()}
    assert pack == {"m": ["A", "B", "C"], R.WHOLE_QUESTION: ["D", "E"], "empty": []}
    hits = spark.createDataFrame([(1, "m", "A"), (1, "m", "B")], "question_id int, mention string, iri string")
    rq = reqs(spark, (1, "m", "m", []), (1, "zz", "zz", []), (2, R.WHOLE_QUESTION, "q", []))
    assert [tuple(r) for r in R.unresolved(rq, hits).collect()] == [(1, "zz")]
    assert {(r["question_id"], r["name"]): r["n"] for r in R.diagnostics(rq, hits, sel, kept).collect()} == {
        (1, "m"): 2, (1, "zz"): 0, (2, R.WHOLE_QUESTION): 0, (1, "reranked"): 5, (2, "reranked"): 0, (1, "selected"): 3, (2, "selected"): 0,
    }


def test_store_kinds_and_search_filter(spark, concepts):
    df = spark.createDataFrame([(["class", "individual"],), (["graph"],), ([],)], "k array<string>")
    assert [r[0] for r in df.select(R.kinds_for_store(F.col("k"))).collect()] == [["owl_class", "skos_concept"], None, None]
    df = spark.createDataFrame([("rdf_property",), ("zzz",)], "k string")
    assert [r[0] for r in df.select(R.kind_from_store(F.col("k"))).collect()] == ["property", "unknown"]
    c = spark.createDataFrame(
        [("a", "o1", False, "class", ["b1"], ["g1"]), ("b", "o1", True, "class", ["b1"], []), ("c", "o2", None, "property", ["b2"], ["g2", "g1"])],
        "iri string, ontology_id string, deprecated boolean, kind string, branch_ids array<string>, group_ids array<string>",
    )
    pick = lambda **k: sorted(r["iri"] for r in R.search_filter(c, **k).collect())
    assert pick() == ["a", "c"] and pick(include_deprecated=True) == ["a", "b", "c"] and pick(ontology_id="o2") == ["c"]
    assert pick(groups=["g1"], kinds=["property"]) == ["c"] and pick(branches=["b1"]) == ["a"]


def test_graph_context(spark):
    b = V.SKOS + "broader"
    rows = [(None, "x", b, "p"), (None, "y", b, "p"), (None, "p", V.RDFS + "subClassOf", "r"), (None, "x", "grp", "g")]
    g = spark.createDataFrame(rows, SCHEMA)
    ctx = R.graph_context(g, "grp").unionByName(R.siblings_of(g, spark.createDataFrame([("x",)], "iri string")))
    got = {r["iri"]: r for r in R.listed_context(ctx).collect()}
    x = got["x"]
    assert (x["parents"], x["ancestors"], x["children"], x["siblings"], x["group_ids"]) == (["p"], ["p", "r"], [], ["y"], ["g"])
    assert got["p"]["children"] == ["x", "y"]


def _times_read(df, mark="Range (0, 4"):
    return df._jdf.queryExecution().optimizedPlan().toString().count(mark)


def test_candidates_are_computed_once(spark):
    rows = spark.range(4).selectExpr(
        "id % 2 AS question_id", "concat('i', id) AS iri", "'class' AS kind", "if(id < 3, 'Same', '') AS label",
        "array('x', NULL, 'red') AS aliases", "CAST(NULL AS STRING) AS prefixed_name", "array('http://e/Age') AS domain",
        "CAST(NULL AS array<string>) AS range", "0.5D AS score", "id AS retrieval_rank",
    )
    asked = spark.createDataFrame([(0, "the same RED"), (1, "other")], "question_id long, question string")
    whole = K.heuristic(rows, asked, 9, static_class_terms=["age"])
    concepts = K.described(rows.drop("question_id", "score", "retrieval_rank"))
    apart = K.heuristic(rows.select("question_id", "score", "retrieval_rank", "iri").join(concepts, "iri"), asked, 9, static_class_terms=["age"])
    assert _times_read(whole) == 1
    want = {("i0", 0.55), ("i1", 0.1), ("i2", 0.55), ("i3", 0.1)}
    for out in (whole, apart):
        assert not [c for c in out.columns if c.startswith("__")]
        assert {(r["iri"], round(r["rerank_score"], 6)) for r in out.collect()} == want


def test_selection_is_computed_once_for_the_pack(spark):
    picked = spark.range(4).selectExpr("id AS question_id", "'m' AS rag_mention", "concat('i', id) AS iri", "0 AS rank", "1D AS final_score")
    known = spark.createDataFrame([(0, "m"), (1, "n")], "question_id long, text string")
    pack = R.candidate_pack(picked, known)
    assert _times_read(pack) == 1
    got = {(r["question_id"], r["mention"]): r["concepts"] and [x["iri"] for x in r["concepts"]] for r in pack.collect()}
    ask = R.WHOLE_QUESTION
    assert got == {(0, "m"): ["i0"], (1, ask): ["i1"], (1, "n"): None, (2, ask): ["i2"], (3, ask): ["i3"]}
