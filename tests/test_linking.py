"""Linking and mention finding against brute force over all pairs."""

import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.sample import EX, SCHEMA, quads
from tripleframe.functions import text as tx
from tripleframe.operators.similarity import contained_pairs, nearest_vectors, ratio_pairs
from tripleframe.plans import discovery, hints, linking, mentions

TERMS = [
    ("class", "Person", "ex:Person", "Person", ["human"]),
    ("class", "Company", "ex:Company", "Company", []),
    ("property", "worksFor", "ex:worksFor", "works for", []),
    ("property", "knows", "ex:knows", "knows", []),
    ("graph", "g1", "ex:g1", "primary graph", []),
    ("graph", "employmentGraph", "ex:employmentGraph", None, []),
]


@pytest.fixture(scope="module")
def terms(spark):
    rows = [(k, EX + n, p, l, a) for k, n, p, l, a in TERMS]
    return spark.createDataFrame(
        rows, "kind string, iri string, prefixed_name string, label string, aliases array<string>"
    )


@pytest.fixture(scope="module")
def schema(spark):
    return discovery.snapshot(spark.createDataFrame(quads(), SCHEMA)).cache()


def ask(spark, *pairs):
    return spark.createDataFrame(list(pairs), "mention string, kinds array<string>")


def test_link_scores(spark, terms):
    asked = ask(
        spark, ("Person", ["class"]), ("human", ["class"]), ("work", ["property"]),
        ("completely_made_up_xyz", ["class"]), ("primary", ["graph"]), ("ex:employmentGraph", ["graph"]),
        ("employment graph", ["graph"]), ("people", ["class"]), ("companies", ["class"]), ("knwos", None),
    )
    top = {r["mention"]: r for r in linking.link(asked, terms).where("rank = 0").collect()}
    got = {m: (r["iri"].replace(EX, ""), r["score"]) for m, r in top.items()}
    assert got == {
        "Person": ("Person", 1.0), "human": ("Person", 1.0), "work": ("worksFor", 0.85),
        "completely_made_up_xyz": ("", 0.0), "primary": ("g1", 0.85),
        "ex:employmentGraph": ("employmentGraph", 1.0), "employment graph": ("employmentGraph", 1.0),
        "people": ("Person", 1.0), "companies": ("Company", 1.0),
        "knwos": ("knows", SequenceMatcher(None, "knwos", "know").ratio()),
    }
    assert top["completely_made_up_xyz"]["kind"] == "unknown"


def test_decisions(spark, terms):
    asked = ask(spark, ("Person", ["class"]), ("graph", ["graph"]), ("knwos", None), ("zzzzqqq", None), ("primary", None))
    linked = linking.link(asked, terms)
    got = {r["mention"]: r["status"] for r in linking.decide(linked).collect()}
    assert got == {
        "Person": "selected", "graph": "ambiguous", "knwos": "unresolved", "zzzzqqq": "unresolved", "primary": "selected",
    }


def test_normal_forms(spark):
    words = {"class": "class", "status": "status", "analysis": "analysis", "chaos": "chaos", "Parties!": "party",
             "worksFor_X": "worksfor x", "cars": "cars", "trains": "train", "People's": "person s", "--": ""}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r[0]: r[1] for r in df.select("w", tx.normalise(F.col("w"))).collect()}
    assert got == words


def test_segments(spark):
    df = spark.createDataFrame([("http://a/b#c",), ("http://a/b/",), ("http://a/b#c#",), ("x",)], "i string")
    got = [tuple(r) for r in df.select(tx.last_segment(F.col("i")), tx.last_path_segment(F.col("i"))).collect()]
    assert got == [("c", "b#c"), ("b", "b"), ("c", "b#c"), ("x", "x")]


WORDS = [
    "red widget", "red widgets", "blue gear", "large gizmo", "gizmo", "a", "ab", "abc", "hot rod", "hotrod", "rod hot",
    "old anvil", "new anvil", "zzz", "wid", "e", "large large gizmo", "get", "xyz 12", "12 zyx", "aaaa", "aaab", "bbbb",
]


@pytest.mark.parametrize("least", [0.4, 0.6, 0.8, 1.0])
def test_ratio_pairs_finds_all(spark, least):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    got = {(r[0], r[1]): r[2] for r in ratio_pairs(df, "w", df.withColumnRenamed("w", "v"), "v", least).collect()}
    want = {}
    for a in WORDS:
        for b in WORDS:
            r = SequenceMatcher(None, a, b).ratio()
            if r >= least:
                want[(a, b)] = r
    assert got == want


def test_contained_pairs_cuts_only_grams_that_needles_meet_on(spark):
    docs = spark.createDataFrame([(i, f"some words {i} of a longer body é{i}") for i in range(30)], "id long, body string")
    needles = spark.createDataFrame([("longer body",), ("words 7",), ("body é29",)], "n string")
    met = contained_pairs(docs, "id", "body", needles, "n", 2)
    assert sorted(map(tuple, met.collect())) == sorted([(i, "longer body") for i in range(30)] + [(7, "words 7"), (29, "body é29")])
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "(.{5})" in plan and not any(f"(.{{{n}}})" in plan for n in (2, 3, 4))
    assert contained_pairs(docs, "id", "body", needles.limit(0), "n", 2).count() == 0


def test_vectors_are_copied_once_per_large_block(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    q, v = spark.createDataFrame(rows, "query_id string, vector array<double>"), spark.createDataFrame(rows, "iri string, vector array<double>")
    got = nearest_vectors(q, v, 3, block_rows=5, chunk_rows=150, slice_rows=7)
    # Vectors meet two chunks of queries, not as many as there are slices.
    assert re.findall(r"sequence\(0, (\d+),", got._jdf.queryExecution().analyzed().toString()) == ["59", "1"]
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(m @ m.T), axis=1)[:, :3]
    assert sorted((r["query_id"], r["iri"]) for r in got.collect()) == sorted((str(i), str(j)) for i in range(300) for j in best[i])


def test_vectors_are_cut_into_blocks_of_bytes_and_stay_floats(spark):
    rows = [(str(i), [float(x) for x in np.eye(64)[i]]) for i in range(64)]
    q, v = spark.createDataFrame(rows, "query_id string, vector array<float>"), spark.createDataFrame(rows, "iri string, vector array<float>")
    got = nearest_vectors(q, v, 1, query_count=40_000, vector_count=120_000)
    plan = got._jdf.queryExecution().analyzed().toString()
    # 32 MB hold 65 536 vectors of 64 numbers; each query is copied twice, not six times.
    assert re.findall(r"sequence\(0, (\d+),", plan)[0] == "1" and "FlatMapCoGroupsInArrow" in plan and "array<double>" not in plan
    assert sorted((r["query_id"], r["iri"], r["score"]) for r in got.collect()) == sorted((r[0], r[0], 1.0) for r in rows)


@pytest.mark.parametrize("k, floor, tile", [(1, None, 64), (5, None, 1 << 22), (5, 0.4, 5000), (60, -0.2, 1 << 22)])
def test_nearest_vectors_of_near_and_equal_ones(spark, monkeypatch, k, floor, tile):
    """Neighbours that single precision cannot tell apart, copies, multiples, zeros, NaN (as zeros), kinds that repeat or do not exist."""
    from tripleframe.operators import similarity

    monkeypatch.setattr(similarity, "TILE", tile)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 12))
    near = [base[:40] + e * rng.normal(size=(40, 12)) for e in (1e-4, 1e-6, 1e-7)]
    vecs = np.vstack([base, *near, np.repeat(base[:2], 70, axis=0), base[:20] * 2.5, np.zeros((2, 12)), [[np.nan] * 12]])
    kinds = [None if i % 13 == 0 else f"k{i % 4}" for i in range(len(vecs))]
    asked = [[None, [], ["k1"], ["k1", "k3", "k1"], ["none"], ["k2", None]][i % 6] for i in range(len(vecs))]
    iris = [f"i{x}" for x in rng.permutation(len(vecs))]
    v = spark.createDataFrame([(a, b, c.tolist()) for a, b, c in zip(iris, kinds, vecs, strict=True)], "iri string, kind string, vector array<double>")
    q = spark.createDataFrame([(f"q{i}", c.tolist(), a) for i, (c, a) in enumerate(zip(vecs, asked, strict=True))], "query_id string, vector array<double>, kinds array<string>")
    norms = np.linalg.norm(vecs, axis=1, keepdims=True)
    unit = np.divide(vecs, norms, out=np.zeros_like(vecs), where=norms > 0)
    scores = np.round(unit @ unit.T, 9) + 0.0
    want = []
    for i, some in enumerate(asked):
        ok = [j for j in range(len(vecs)) if not np.isnan(scores[i, j]) and (floor is None or scores[i, j] >= floor) and (not some or kinds[j] in some)]
        want += [(f"q{i}", n, iris[j], scores[i, j]) for n, j in enumerate(sorted(ok, key=lambda j: (-scores[i, j], iris[j]))[:k])]
    got = nearest_vectors(q, v, k, floor, block_rows=250, chunk_rows=100).collect()
    assert sorted((r["query_id"], r["rank"], r["iri"], r["score"] + 0.0) for r in got) == sorted(want)


def test_vectors_of_a_cell_are_of_one_length(spark):
    from pyspark.errors import PythonException

    for odd in ([1.0], None):
        v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", odd)], "iri string, vector array<double>")
        with pytest.raises(PythonException, match="one length"):
            nearest_vectors(v.withColumnRenamed("iri", "query_id"), v, 1).collect()


def test_contained_pairs_finds_all(spark):
    texts = [(i, w + (" tail\nend" if i % 2 else "")) for i, w in enumerate(WORDS)]
    df = spark.createDataFrame(texts, "id int, body string")
    needles = spark.createDataFrame([(w,) for w in WORDS + ["l\ne"]], "n string")
    for least in (1, 2, 3):
        got = sorted(tuple(r) for r in contained_pairs(df, "id", "body", needles, "n", least).collect())
        want = sorted((i, n) for i, t in texts for n in set(WORDS + ["l\ne"]) if n in t and len(n) >= least)
        assert got == want


def test_nearest_vectors_is_exact_with_copies(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    vecs = np.vstack([base, np.repeat(base[:1], 20, axis=0)])
    rows = [(f"i{i:03d}", "class" if i % 3 else "property", v.tolist()) for i, v in enumerate(vecs)]
    vectors = spark.createDataFrame(rows, "iri string, kind string, vector array<double>")
    queries = spark.createDataFrame(
        [(f"q{i}", base[i].tolist(), ["class"] if i % 2 else None) for i in range(6)],
        "query_id string, vector array<double>, kinds array<string>",
    )
    got = {}
    for r in nearest_vectors(queries, vectors, 5, block_rows=7, chunk_rows=2).collect():
        got[(r["query_id"], r["rank"])] = (r["iri"], round(r["score"], 6))
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = {}
    for i in range(6):
        scores = [(round(float(unit[i] @ unit[j]), 9), rows[j][0]) for j in range(len(rows)) if i % 2 == 0 or rows[j][1] == "class"]
        for rank, (s, iri) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:5]):
            want[(f"q{i}", rank)] = (iri, round(s, 6))
    assert got == want


def test_merge_supplemental(spark):
    sel = spark.createDataFrame([(1, "a", "ex:A", "class", 1.0)], "question_id int, mention string, iri string, kind string, score double")
    un = spark.createDataFrame([(1, "b"), (1, "foo"), (1, "c")], "question_id int, mention string")
    amb = spark.createDataFrame([(1, "Foo")], "question_id int, mention string")
    sup = spark.createDataFrame(
        [(1, 0, "B", "ex:B", "property", 0.9), (1, 1, "a2", "ex:A", "class", 0.9), (1, 2, "foo", "ex:F", "class", 0.9),
         (1, 3, "c", "ex:B", "class", 0.5), (1, 4, "c", "", "class", 0.5)],
        "question_id int, seq long, mention string, iri string, kind string, score double",
    )
    merged, promoted, rest = linking.merge_supplemental(sel, un, amb, sup)
    assert {(r["iri"], r["mention"], r["origin"]) for r in merged.collect()} == {("ex:A", "a", "baseline"), ("ex:B", "B", "supplemental")}
    assert sorted(r["seq"] for r in promoted.collect()) == [0, 1, 3]
    assert sorted(r["mention"] for r in rest.collect()) == ["c", "foo"]


def test_merge_supplemental_holds_no_table_of_groups(spark):
    """The joins sort the rows; what comes after them goes through that order, also where only keys are read."""
    sel = spark.createDataFrame([(1, "a", "ex:A", "class", 1.0), (1, "b", "ex:A", "class", 1.0), (None, "a", "ex:N", "class", 1.0)], "question_id int, mention string, iri string, kind string, score double")
    amb = spark.createDataFrame([(1, "Foo")], "question_id int, mention string")
    sup = spark.createDataFrame(
        [(1, 2, "x", "ex:B", "class", 0.9), (1, 1, "y", "ex:B", "class", 0.5), (1, 3, "z", "ex:A", "class", 0.9), (None, 4, "n", "ex:N", "class", 0.9), (2, None, "q", "ex:C", "class", 0.9)],
        "question_id int, seq long, mention string, iri string, kind string, score double",
    )
    merged, _, _ = linking.merge_supplemental(sel, amb, amb, sup)
    rows = [(r["question_id"], r["iri"], r["mention"]) for r in merged.where("origin = 'supplemental'").collect()]
    assert sorted(rows, key=str) == [(1, "ex:B", "y"), (2, "ex:C", None), (None, "ex:N", "n")]
    plan = merged.select("question_id", "iri", "origin")._jdf.queryExecution().sparkPlan().toString()
    grouped = [line for line in plan.splitlines() if "HashAggregate" in line and "keys=[question_id" in line and "iri" in line]
    assert not grouped and "SortAggregate" in plan


QUESTIONS = [
    "Who works for Acme?", "List all people in the company.", "Show every Person.", "Find what alice knows.",
    "Show me information about Aurora.", "Top-1 Foo-Bar x-Baz Éric's Aé Abc_9 knows+ KNOWS  works   for", "",
]


def found(spark, schema):
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")
    out = {}
    for r in mentions.extract(q, schema).collect():
        assert QUESTIONS[r["question_id"]][r["start"]:r["end"]].lower().strip() == r["text"].lower()
        out.setdefault(r["question_id"], {})[r["text"].lower()] = r
    return out


def test_mentions(spark, schema):
    got = found(spark, schema)
    assert {"works for", "acme"} <= set(got[0]) and {"people", "company"} <= set(got[1])
    assert "show" not in got[2] and "person" in got[2] and {"alice", "knows"} <= set(got[3])
    assert got[4]["aurora"]["kinds"] == ["individual", "class"] and got[4]["aurora"]["start"] == 26
    assert got[0]["acme"]["kinds"] == ["individual", "class"] and got[0]["acme"]["sources"] == ["label", "local_name", "capitalized"]


def test_capitalised_words_like_a_plain_scan(spark):
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")
    got = sorted((r[0], r[1], r[2]) for r in mentions._matches(q, mentions.CAPITAL_WORD).collect())
    want = sorted(
        (i, m.group(1), m.start(1)) for i, t in enumerate(QUESTIONS) for m in re.finditer(r"\b([A-Z][a-zA-Z0-9_-]+)\b", t)
    )
    assert got == want
    kept = {r["text"] for r in mentions.capitalised_words(q).collect()}
    assert "Top-1" not in kept and "Show" not in kept and {"Foo-Bar", "Baz", "Abc_9"} <= kept


ODD = [
    "works for", "Works  For", "knows", "knows^", "knowſ", "KNOWS", "joİned", "foundeD\u2003by", "age", "companıes", "Top-1", "Show", "Foo-Bar",
    "foo-bar", "Éric", "eñ", "_x", "9X", "-", "\u0301", "\u200d", "Ⓐ", "漢字", "\U00010400", "\U00010d50", "\U00031350", "İx", "ΣΑΣ ", "\n", "\x85", "\x1c",
    ".", "^", "+", "large ring", "Large Ring", "Alice", "ALICE", "se", "x-", "foo_", "ring", "r",
]


def _odd_questions(spark, n):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) + rng.choice(["", " ", "-"]) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    texts += [f"knows{chr(c)}age Foo" for c in (*range(1, 0x250), *range(0x24B0, 0x24F0), *range(0x1F12E, 0x1F18C))]
    rows = [*enumerate(texts), (n * 10, None), (n * 10 + 1, ""), (None, "Alice knows Foo"), (None, "foo knows ALICE"), (1, texts[1])]
    return spark.createDataFrame(rows, "question_id long, question string")


def _odd_terms(spark):
    rows = [
        ("individual", "http://x/alice", "ex:alice", "Alice"), ("individual", "http://x/large_ring", None, "large ring"), ("class", "http://x/Ring", "ex:Ring", "ring"),
        ("individual", "http://x/se", "ex:se", "knows^age foo of a passage"), ("graph", "http://x/web", "ex:web", None), ("individual", "http://x/s", "ex:é", "ΣΑΣ "),
        ("class", "http://x/ab", "ex:Foo-Bar", "foo-bar"), ("individual", "http://y/ring", "ex:x", "Ring"), (None, "http://x/none", None, "knows"), ("odd", None, None, "age"),
        ("other", "http://x/foo", "ex:r", " foo"),
    ]
    rows = [(*r, []) for r in rows]
    return spark.createDataFrame(rows, "kind string, iri string, prefixed_name string, label string, aliases array<string>")


def test_one_pass_finds_what_the_single_finders_find(spark):
    q, terms = _odd_questions(spark, 300), _odd_terms(spark)
    one, many = (sorted(map(repr, mentions.extract(q, terms, **x).collect())) for x in ({}, {"max_bytes": -1}))
    assert len(one) > 3000 and one == many


def test_extract_neither_cuts_texts_to_grams_nor_shuffles_them(spark):
    q = spark.createDataFrame([(i, f"Alice knows {i} large rings") for i in range(20)], "question_id long, question string")
    got = mentions.extract(q.repartition(8), _odd_terms(spark))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Join" not in plan and "Aggregate" not in plan
    assert {r["text"] for r in got.where("question_id = 3").collect()} == {"Alice", "knows", "large ring", "ring"}


@pytest.mark.parametrize("window", [3, 64, 1 << 19])
def test_needles_like_find(monkeypatch, window):
    from tripleframe.functions import needles as nd

    monkeypatch.setattr(nd, "WINDOW", window)
    monkeypatch.setattr(nd, "CELLS", 20)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abé "), n)) for n in rng.integers(0, 200, 40)]
    names = sorted({t[i : i + n] for t in texts for i in (0, 7, 30) for n in (1, 2, 3, 5, 8, 13, 40) if len(t) >= i + n} | {"zz", "abcdefghijk"})
    raw, coded = [t.encode() for t in texts], [n.encode() for n in names]
    ends = np.cumsum([0, *map(len, raw)])
    found = nd.Needles(coded).first_in(np.frombuffer(b"".join(raw), np.uint8), ends)
    want = [(i, k, ends[i] + t.find(n)) for i, t in enumerate(raw) for k, n in enumerate(coded) if n in t]
    assert list(zip(*map(np.ndarray.tolist, found), strict=True)) == want
    assert [len(x) for x in nd.Needles([]).first_in(np.empty(0, np.uint8), np.zeros(3, int))] == [0, 0, 0]


def test_hints(spark, schema):
    qs = ["how many employees per company", "who is the oldest", "who joined after 2019", "friends of bob", "nothing"]
    q = spark.createDataFrame(list(enumerate(qs)), "question_id int, question string")
    sel = spark.createDataFrame(
        [(0, "company", EX + "Company", "class", "Company"), (4, "p", EX + "Person", "class", "Person"), (4, "c", EX + "Company", "class", "Company"),
         (4, "x", EX + "Project", "class", "Project")],
        "question_id int, mention string, iri string, kind string, label string",
    )
    got = {(r["question_id"], r["property_iri"].replace(EX, ""), r["rule"], r["score"]) for r in hints.infer(q, sel, schema).collect()}
    assert got == {
        (0, "worksFor", "employment", 0.95), (1, "age", "age", 0.9), (2, "joined", "date", 0.85), (3, "knows", "knows", 0.9),
        (4, "worksFor", "class_pair", 0.8), (4, "foundedBy", "class_pair", 0.8), (4, "contributesTo", "class_pair", 0.8),
    }
    more = hints.infer(q, sel, schema, with_grouping=True).where("rule = 'grouping'").collect()
    assert [(r["question_id"], r["property_iri"].replace(EX, "")) for r in more] == [(0, "worksFor")]


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_best_candidates_equal_all_pairs_and_measure_few(spark, limit):
    """Names of similar words: nearly all pairs pass the bound of 0.4, few have to be measured."""
    import random

    rng = random.Random(9)
    parts = ["red", "blue", "large", "small", "widget", "gear", "gizmo", "anvil", "rod", "bolt", "hinge", "copper", "steel", "oak"]
    names = sorted({" ".join(rng.sample(parts, rng.randint(1, 3))) + rng.choice(["", " x", " 12", " nine"]) for _ in range(160)})
    asked = sorted({n[: rng.randint(3, len(n))][::-1][::-1] + rng.choice(["", "z", " old"]) for n in rng.sample(names, 60)} | {"zzzz", "--"})
    kinds = ["class", "property"]
    rows = [(kinds[i % 2], f"http://t/{i:03d}", None, n, [names[i - 1]] if i % 9 == 0 else []) for i, n in enumerate(names)]
    terms = spark.createDataFrame(rows, "kind string, iri string, prefixed_name string, label string, aliases array<string>")
    mentions = spark.createDataFrame(
        [(a, ["class"] if i % 3 == 0 else None) for i, a in enumerate(asked)] + [(a, ["property"]) for a in asked[:20]], "mention string, kinds array<string>"
    )
    got = linking.link(mentions, terms, limit=limit)
    found = {}
    for r in got.collect():
        found.setdefault((r["mention"], tuple(r["kinds"])), []).append((r["rank"], r["iri"], round(r["score"], 9)))
    every = linking.top_k(
        linking.all_candidates(mentions, terms), ["mention", "kinds"], [F.desc("score"), linking.kind_rank(F.col("kind")), F.asc("iri")], limit
    )
    want = {}
    for r in every.collect():
        want.setdefault((r["mention"], tuple(r["kinds"])), []).append((r["rank"], r["iri"], round(r["score"], 9)))
    for key, rows in found.items():
        assert sorted(rows) == sorted(want.get(key, [(0, "", 0.0)]))
    assert set(want) <= set(found)
    _, measured = linking.best_candidates(mentions, terms, limit)
    pairs = measured.select("a_t", "b_t").collect()
    assert len(pairs) == len(set(map(tuple, pairs)))
    if limit == 1:
        assert len(pairs) < 0.1 * len(asked) * len(names)
