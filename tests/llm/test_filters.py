"""Quality rules, line dedup, near duplicates and mixing against plain Python."""

import random

import numpy as np

from tests.llm import plain
from tripleframe.llm import line_dedup, mixing, near_dedup, quality_rules
from tripleframe.llm.common import written


def test_measures_equal_plain_python(make_docs, texts):
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, texts[3])])
    rows = quality_rules.apply_rules(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        m = r["measures"]
        got = (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"])
        assert got == plain.base_measures(r["text"])
        assert r["base_failed"] == plain.base_failed(r["text"])
        assert not (r["base_failed"] and r["kept"])
    junk = {r["text"]: r["kept"] for r in rows}
    assert junk[texts[0]] and not junk["x* y# | z " * 30] and not junk["again " * 80] and not junk[None]


def test_rules_are_a_parameter_and_clashing_columns_are_replaced(make_docs, texts):
    docs = make_docs([(1, texts[0])]).selectExpr("*", "'mine' AS kept", "1 AS measures", "2 AS levels")
    none = quality_rules.apply_rules(docs, rules=[("n_words", 10_000, None)])
    assert none.columns == ["doc_id", "text", "lang", "source", "n_chars", "levels", "measures", "base_failed", "kept"]
    assert [r["kept"] for r in none.collect()] == [False]
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_removed_lines_equal_brute_force(make_docs, texts):
    docs = [(i * 3, t) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(make_docs(docs)).collect()}
    assert found == plain.removed_lines(docs)


def test_removed_lines_of_a_large_group_of_variants(make_docs):
    base = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(120):
        w = list(base)
        w[i % 40] = f"u{i}"
        w[(i * 7) % 40] = f"v{i}"
        if i % 5 == 0:
            w[(i * 3) % 40] = f"x{i}"
            w[(i * 11) % 40] = f"y{i}"
        docs.append((i, " ".join(w)))
    found = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(make_docs(docs)).collect()}
    assert found == plain.removed_lines(docs)


def test_dedupe_keeps_rows_columns_and_order_of_lines(spark, make_docs):
    docs = make_docs([(2, "a b c d\nnew line here\n\na b c d"), (1, "a b c d\nz"), (None, "a b c d"), (2, "a b c d\nnew line here\n\na b c d"), (4, None)])
    docs = docs.selectExpr("*", "'k' AS k", "1 AS removed", "'w' AS word")
    out = line_dedup.dedupe_lines(docs)
    assert out.columns == docs.columns
    got = sorted([(r["doc_id"], r["text"], r["k"]) for r in out.collect()], key=str)
    assert got == sorted(
        [(1, "a b c d\nz", "k"), (2, "new line here\n", "k"), (2, "new line here\n", "k"), (4, None, "k"), (None, "a b c d", "k")],
        key=str,
    )
    assert line_dedup.dedupe_lines(docs.limit(0)).count() == 0


def test_near_duplicates_equal_brute_force(make_docs, texts):
    docs = [(i * 2 + 1, t) for i, t in enumerate(texts)]
    rows = near_dedup.near_duplicates(make_docs(docs)).collect()
    want = plain.components(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_follow_chains_and_large_groups(make_docs):
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(60):  # each differs from the last by one word, so the ends are far apart
        base = list(base)
        base[(i * 13) % 200] = f"s{i}"
        docs.append((100 - i, " ".join(base)))
    for i in range(80):
        w = [f"g{j}" for j in range(120)]
        for k in range(1 + i % 4):
            w[(i * 17 + k * 31) % 120] = f"e{i}_{k}"
        docs.append((1000 + i, " ".join(w)))
    rows = near_dedup.near_duplicates(make_docs(docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain.components(docs)


def test_near_misses_of_a_large_group_are_not_all_compared(make_docs, monkeypatch):
    rng, base = random.Random(5), [f"w{i}" for i in range(240)]
    docs = []
    for d in range(150):
        spots = set(rng.sample(range(0, 240, 6), 4))
        docs.append((d, " ".join("new" + w if i in spots else w for i, w in enumerate(base))))
    asked, verify = [], near_dedup.verified

    def counted(pairs, sets, percent):
        asked.append(pairs.count())
        return verify(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "verified", counted)
    rows = near_dedup.near_duplicates(make_docs(docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain.components(docs)
    assert sum(asked) < near_dedup.BANDS * len(docs)


def test_parity_bits_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(3)
    for common, own in [(0, 0), (50, 0), (500, 40), (3000, 900)]:
        x, y = (np.unique(rng.integers(0, 1 << 64, own, dtype=np.uint64)) for _ in range(2))
        shared = rng.integers(0, 1 << 64, common, dtype=np.uint64)
        bits = [near_dedup.parity(np.concatenate([shared, z])) for z in (x, y)]
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(x) + len(y)


def test_near_duplicates_of_repeated_ids_go_by_their_texts(spark):
    words = [f"w{i}" for i in range(60)]
    base, near, other = " ".join(words), " ".join([*words[:59], "changed"]), " ".join(f"o{i}" for i in range(30))
    rows = [(5, base, "x", 1), (3, near, "y", 2), (5, other, "z", 3), (5, other, "z", 3), (8, base, "x", 4), (9, "", "x", 5), (9, None, "x", 6), (None, base, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, group int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect() if r["doc_id"])
    assert got == [(3, 56, 3, True), (5, 26, 5, True), (5, 26, 5, True), (5, 56, 3, False), (8, 56, 3, False), (9, 0, 9, True), (9, 0, 9, True)]
    left = near_dedup.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(r["group"] for r in left.collect()) == [2, 3, 5, 6, 7]
    assert near_dedup.keep_one(docs.limit(0)).count() == 0
    folded = spark.createDataFrame([(4, base), (4, base.upper()), (4, base)], "doc_id long, text string")
    assert near_dedup.keep_one(folded).count() == 1


def test_near_duplicates_odd_rows(make_docs):
    docs = make_docs([(5, "one two three four five six"), (5, "one two three four five six"), (2, "ONE two three four five six"),
                      (None, "one two three four five six"), (7, None), (8, " "), (9, "one two"), (10, "One Two")])
    docs = docs.selectExpr("*", "'x' AS digest", "'y' AS bands", "'z' AS id")
    rows = [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]
    assert sorted(rows, key=str) == sorted(
        [(5, 2, 2, False), (5, 2, 2, False), (2, 2, 2, True), (None, 2, None, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False)],
        key=str,
    )
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_mixing_targets_and_draws(make_docs, texts):
    docs = [(i, t, "en", [None, "b", "a", "é", "Z"][i % 5] if i > 3 else "rare") for i, t in enumerate(texts)]
    frame = make_docs(docs)
    rows = mixing.repetitions(frame).collect()
    sizes = {}
    for _, t, _, s in docs:
        sizes[s] = sizes.get(s, 0) + len(plain.words(t))
    want, source = plain.targets(sizes), {d[0]: d[3] for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert int(r["rate"]) <= r["copies"] <= min(3, int(r["rate"]) + 1)
    again = {r["doc_id"]: r["copies"] for r in mixing.repetitions(frame.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    copies = [r["doc_id"] for r in mixing.mix(frame).collect()]
    assert {i: copies.count(i) for i in again} == again


def test_mixing_caps_small_sources_and_comes_near_its_targets(make_docs):
    docs = [(i, "w " * (5 + i % 7), "en", "big") for i in range(3000)] + [(9000 + i, "w w", "en", "tiny") for i in range(4)]
    rows = mixing.repetitions(make_docs(docs)).collect()
    taken = sum(r["copies"] * r["size"] for r in rows if r["doc_id"] < 9000)
    target = next(r["target"] for r in rows if r["doc_id"] < 9000)
    assert abs(taken - target) < 0.05 * target
    assert all(r["copies"] == 3 and r["target"] == 24 for r in rows if r["doc_id"] >= 9000)


def test_mixing_odd_rows(make_docs):
    docs = make_docs([(None, "a b", None, None), (1, None, None, "s"), (1, None, None, "s")]).selectExpr("*", "1 AS rate", "2 AS salt")
    assert mixing.mix(docs).columns == docs.columns
    assert len(mixing.repetitions(docs).collect()) == 3
    assert mixing.repetitions(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_classes_carry_their_prefix_and_odd_white_space_parts_words(spark, make_docs, monkeypatch):
    """One shuffle by class gives first lines and prefixes: lines are not joined back to their classes for them."""
    docs = [
        (1, "a b  c d e f\tg h\r\n  i j k l m n o p \n\n \t "), (2, "h g f e d c b a\n p o n m l k j i x"),
        (3, "a\x0bb\x0cc d e f g  h z\n  q"), (4, "    q\none two"), (5, "two\tone\n  "),
    ]
    tables = []

    def kept(df):
        tables.append(df)
        return written(df)

    monkeypatch.setattr(line_dedup, "written", kept)
    found = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(make_docs(docs)).collect()}
    assert found == plain.removed_lines(docs)
    classes, met = tables[1], tables[2]
    assert {"n", "sig", "prefix"} <= set(classes.columns)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
