"""Each stage of the pipeline against plain Python on its own input, and the registered queries on the small tables."""

import os
import random

import pytest

import corpus_pipeline
from tests.llm import plain
from tripleframe.llm import mixing, quality_rules
from tripleframe.llm.common import written
from tripleframe.llm.queries import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")


def test_stages(spark, make_docs, texts):
    rng_sources = ["a", "b", None]
    docs = make_docs([(i, t, "en", rng_sources[i % 3]) for i, t in enumerate(texts)])
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    kept = written(stage["quality_rules"](spark, docs, ""))
    assert kept.columns == columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not any(plain.base_failed(texts[i]) for i in ids) and set(range(60)) & ids

    lines = written(stage["line_dedup"](spark, kept, ""))
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    gone = plain.removed_lines(rows)
    want = {}
    for i, text in rows:
        left = "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone.get(i, []))
        if plain.words(left):
            want[i] = left
    assert lines.columns == columns
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = written(stage["near_dedup"](spark, lines, ""))
    groups = plain.components(list(want.items()))
    assert single.columns == columns
    assert {r["doc_id"] for r in single.collect()} == {i for i in want if groups[i][1] == i}

    mixed = written(stage["mixing"](spark, single, ""))
    copies = {r["doc_id"]: r["copies"] for r in mixing.repetitions(single).collect()}
    got = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == columns and {i: got.count(i) for i in copies} == copies

    tokens = stage["byte_bpe"](spark, mixed, "").collect()
    assert sorted(r["doc_id"] for r in tokens) == sorted(got)
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in tokens)


def test_stages_on_odd_and_empty_tables(spark, make_docs):
    docs = make_docs([(None, None, None, None), (1, None, None, "s"), (1, "", None, "s")])
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, "").count()


@needs_tables
def test_run_and_queries_return_all_rows(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name, query in registry.runs.items():
        if name != "op7_chat_format":
            assert query(spark, FOLDER).count() == n, name


def test_near_dedup_stage_links_from_four_fifths_on(spark, make_docs):
    docs, rng = [], random.Random(12)
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(100)]
        docs.append((10 * group, " ".join(base)))
        for k in (1, 2, 3):  # one or two changed words: 0.90 and 0.81; three: 0.73
            w = list(base)
            for place in rng.sample(range(10, 90, 10), k):
                w[place] = f"changed{group}x{k}x{place}"
            docs.append((10 * group + k, " ".join(w)))
    groups = plain.components(docs, 80)
    want = {i for i, _ in docs if groups[i][1] == i}
    assert want != {i for i, (_, c) in plain.components(docs).items() if c == i}
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, make_docs(docs), "").collect()
    assert {r["doc_id"] for r in got} == want


def test_quality_stage_leaves_repeated_lines_to_line_dedup(spark, make_docs):
    long = " ".join(f"the word{i}" for i in range(40))
    half = [" ".join(f"the part{k}x{i}" for i in range(15)) for k in range(2)]
    docs = make_docs([
        (1, f"The short heading here\n{long}\nThe short heading here"),  # one line of three, 4 words of 88
        (2, "\n".join([half[0], half[1], half[0], half[0]])),  # 60 words of 120
        (3, long),
        (4, None),
    ])
    stage = dict(corpus_pipeline.STAGES)
    kept = written(stage["quality_rules"](spark, docs, ""))
    assert {r["doc_id"] for r in kept.collect()} == {1, 3}
    cleaned = {r["doc_id"]: r["text"] for r in stage["line_dedup"](spark, kept.filter("doc_id = 1"), "").collect()}
    assert cleaned == {1: f"The short heading here\n{long}"}
    shares = quality_rules.apply_rules(docs).select("doc_id", "measures.dup_word_share").collect()
    assert {r[0]: r[1] for r in shares} == {1: 4 / 88, 2: 0.5, 3: 0.0, 4: None}
