"""Chat formatting, language identification and quality ranking."""

import json
import random
import zlib

import numpy as np
import pytest

from tripleframe.llm import chat, language, quality_rank, queries

MESSAGES = "conv_id long, turn long, role string, text string"
SCHEMAS = {"find": {"q": ("string", True), "n": ("integer", False)}, "add": {"x": ("number", True)}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "after": d} for i, n, a, d in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_calls_are_linked_levelled_checked_and_serialised(spark):
    rows = [
        (1, 0, "user", 'say "hi"\n'),
        (1, 1, "assistant", call(("c", "add", {"x": 2.5}, ["b"]), ("b", "find", {"q": "é", "n": 3}, ["a"]), ("a", "find", {"n": 1}, []))),
        (1, 2, "tool", result("c", {"z": 1, "a": [1, None]})),
        (1, 3, "tool", result("b", "ok")),
        (1, 4, "tool", result("nobody", "?")),
        (1, 5, "assistant", call(("a", "find", {"q": "again"}, []), ("d", "nope", {}, []), ("e", "add", {"x": "1"}, []))),
        (1, 6, "assistant", call(("p", "add", {"x": 1}, ["q"]), ("q", "add", {"x": 1}, ["p"]), ("r", "add", {"x": 1}, ["zz"]))),
        (1, 7, "tool", result("a", True)),
        (2, 0, "assistant", '{"tool_calls": broken'),
        (2, 1, "tool", "plain text of a tool"),
        (2, 2, "assistant", call((None, "add", {"x": 1}, None))),
        (2, 3, "tool", result("c", "other conversation")),
    ]
    got = chat.format_chats(spark.createDataFrame(rows, MESSAGES), SCHEMAS).collect()
    by = {(r["conv_id"], r["turn"], r["part"]): r for r in got}
    assert len(got) == len(by) == 18
    assert by[1, 0, 0]["json"] == '{"content":"say \\"hi\\"\\n","role":"user"}'
    assert [(by[1, 1, p]["call_id"], by[1, 1, p]["level"], by[1, 1, p]["status"], by[1, 1, p]["linked_turn"]) for p in range(3)] == [
        ("c", 2, "ok", 2), ("b", 1, "ok", 3), ("a", 0, "bad_arguments", 7)]
    assert by[1, 1, 1]["json"] == '{"arguments":{"n":3,"q":"é"},"id":"b","name":"find","role":"assistant"}'
    assert by[1, 2, 0]["json"] == '{"content":{"a":[1,null],"z":1},"role":"tool","tool_call_id":"c"}'
    assert (by[1, 2, 0]["status"], by[1, 2, 0]["linked_turn"]) == ("ok", 1)
    assert by[1, 4, 0]["status"] == "orphan" and by[2, 3, 0]["status"] == "orphan"
    assert [by[1, 5, p]["status"] for p in range(3)] == ["duplicate_id", "unknown_tool", "bad_arguments"]
    assert [by[1, 6, p]["status"] for p in range(3)] == ["cycle", "cycle", "missing_call"]
    assert by[2, 0, 0]["kind"] == 0 and by[2, 1, 0]["kind"] == 0
    assert by[2, 2, 0]["kind"] == 1 and by[2, 2, 0]["status"] == "no_result"
    for r in got:
        json.loads(r["json"])
    place = {k: (r["conv_id"], r["order_turn"], r["level"], r["kind"], r["turn"], r["part"]) for k, r in by.items()}
    assert place[1, 1, 2] < place[1, 1, 1] < place[1, 1, 0] < place[1, 2, 0]


def test_long_chains_and_random_graphs_are_in_topological_order(spark):
    rng = random.Random(6)
    after, rows = {}, []
    for i in range(60):
        after[f"c{i}"] = [f"c{j}" for j in range(i) if rng.random() < 0.06]
    names = list(after)
    rng.shuffle(names)
    for t, name in enumerate(names):
        rows.append((7, t, "assistant", call((name, "add", {"x": t}, after[name]))))
    got = {r["call_id"]: (r["order_turn"], r["level"], r["kind"], r["turn"]) for r in chat.format_chats(spark.createDataFrame(rows, MESSAGES), SCHEMAS).collect()}
    assert all(got[d] < got[c] for c in after for d in after[c])


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "assistant", call(("x", "add", {"x": 1}, [])))]
    frame = spark.createDataFrame(rows, MESSAGES).selectExpr("*", "1 AS level", "2 AS id", "3 AS row")
    got = chat.format_chats(frame, SCHEMAS).collect()
    assert len(got) == 4 and sorted(r["status"] for r in got) == ["no_result", "ok", "ok", "ok"]
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_registered_query_checks_calls_by_the_tools_a_conversation_declares(spark, tmp_path):
    kinds = lambda **k: {"properties": {n: {"type": v} for n, v in k.items()}, "required": [n for n in k if n != "n"]}
    tools = json.dumps({"tools": [{"name": "find", "parameters": kinds(q="string", n="integer")}, {"name": "now"}]})
    more = json.dumps({"tools": [{"name": "find", "parameters": kinds(x="number")}, {"name": "add", "parameters": kinds(x="number", y="odd")}]})
    calls = [("a", "find", {"q": "s", "n": 1}, []), ("b", "find", {"n": 1}, []), ("c", "find", {"q": 1}, ["a"]), ("d", "nope", {}, []),
             ("e", "now", {}, []), ("f", "now", {"z": 1}, []), ("g", "add", {"x": 1.5, "y": [1]}, []), ("h", "add", {"x": "1", "y": 2}, []),
             ("i", "add", [1], [])]
    rows = [(k, 0, "system", tools if k == 1 else "be kind") for k in (1, 2)] + [(1, 1, "system", more)]
    rows += [(k, 2, "assistant", call(*calls)) for k in (1, 2, None)]
    rows += [(k, 3 + n, "tool", result(c[0], n)) for k in (1, 2) for n, c in enumerate(calls)]
    spark.createDataFrame(rows, MESSAGES).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op7_chat_format(spark, str(tmp_path)).collect()
    status = {(r["conv_id"], r["call_id"]): r["status"] for r in got if r["kind"] == 1}
    bad = {"b": "bad_arguments", "c": "bad_arguments", "d": "unknown_tool", "f": "bad_arguments", "h": "bad_arguments", "i": "bad_arguments"}
    assert [status[1, c[0]] for c in calls] == [bad.get(c[0], "ok") for c in calls]
    assert {status[2, c[0]] for c in calls} == {"ok"} and {status[None, c[0]] for c in calls} == {"no_result"}
    assert len(got) == len(rows) - 3 + 3 * len(calls) and sum(r["role"] == "system" for r in got) == 3


def speech(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


PARTS = {"en": "th er on an re he in ed nd ha".split(), "fr": "eau ou an elle é è tion re qu ê".split(), "zz": "щ ю я ж ка но".split()}


def test_languages_of_held_out_texts(make_docs):
    rng = random.Random(2)
    docs = [(i, speech(rng, PARTS[name], rng.randint(3, 60)), name, "s") for i, name in enumerate(["en", "fr", "zz"] * 80)]
    docs += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 !?", "fr", "s"), (903, "x", None, "s"), (904, "é", "fr", "s")]
    rows = language.identify(make_docs(docs)).collect()
    want = {d[0]: d[2] for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (900, 901, 902)] == ["und"] * 3
    assert all(r["lang_pred"] in PARTS for r in rows if r["doc_id"] in (903, 904))


def test_languages_do_not_depend_on_partitions_or_other_columns(make_docs):
    rng = random.Random(9)
    docs = [(i, speech(rng, PARTS[name], 12), name, name) for i, name in enumerate(["en", "fr"] * 30)]
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(make_docs(docs).coalesce(1)).collect()}
    other = make_docs(docs).selectExpr("doc_id", "text", "lang", "'x' AS source", "1 AS score", "2 AS held_out").repartition(5)
    two = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(other).collect()}
    assert one.keys() == two.keys()
    assert all(one[i][0] == two[i][0] and one[i][1] == pytest.approx(two[i][1], abs=1e-5) for i in one)


def test_languages_odd_rows(make_docs):
    docs = make_docs([(None, "only here", "qq", "s"), (5, None, None, None)])
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in language.identify(docs).collect()) == [("5", "und"), ("None", "und")]
    assert language.identify(docs.limit(0)).count() == 0


def test_quality_of_held_out_texts(spark, make_docs):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        text = speech(rng, PARTS["en"], rng.randint(10, 80))
        if not good:
            text = [text.upper() + "!!", " ".join(w + "###" for w in text.split()), text.replace(" ", " | "), "go " * 40][i // 4 % 4]
        docs.append((i, text))
        labels.append((i, int(good), 0))
    labels += [(1, None, 0), (2, 7, 0), (9999, 1, 0), (3, 1, 0)]
    docs += [(1000, None), (1001, "")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality_rank.rank_quality(make_docs(docs), marks).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 300]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_quality_model_is_fitted_on_all_labelled_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    size = len(quality_rank.MEASURES)
    label = (rng.random(900) < 0.8).astype(int)
    x = rng.normal(size=(900, size)) + label[:, None] * np.linspace(0.0, 0.6, size)
    x[:, 3] = 2.0
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, label))], "doc_id long, measures array<double>, label int")
    good, bad = int(label.sum()), int((label == 0).sum())
    spread = np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1)
    d = ((x[label == 1][:, None] - x[label == 0][None]) / spread).reshape(-1, size)
    w = np.zeros(size)
    for _ in range(25):
        p = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(size), d.T @ (1 - p) / len(d) - 1e-3 * w)
    monkeypatch.setattr(quality_rank, "PAIRS", good * bad)
    weights, cut = quality_rank.fit(rows)
    assert weights * spread == pytest.approx(w, abs=1e-6)
    scores = np.sort(x @ weights)
    assert cut == pytest.approx((scores[bad - 1] + scores[bad]) / 2, abs=1e-9)
    # With fewer pairs than all, every row still has its part.
    monkeypatch.setattr(quality_rank, "PAIRS", 1)
    one_hot = rows.selectExpr("doc_id", f"transform(sequence(1, {size}), i -> CAST(doc_id AS DOUBLE)) AS measures", "label")
    pairs, n = quality_rank.paired(one_hot, good, bad, np.ones(size))
    assert pairs.count() == n == 4 * good
    ids = {0: np.flatnonzero(label == 0), 1: np.flatnonzero(label == 1)}
    met = [r["x"][0] for r in pairs.collect()]
    # Sums of differences: each good row counts four times, bad rows as evenly as the numbers allow.
    assert abs(sum(met) - (4 * ids[1].sum() - 4 * good / bad * ids[0].sum())) <= 4 * ids[0].sum()
    near, _ = quality_rank.fit(rows)
    assert np.corrcoef(x @ near, x @ weights)[0, 1] > 0.98


def test_quality_without_labels_and_empty(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "a b"), (1, "a b"), (None, None)]).selectExpr("*", "1 AS measures", "2 AS label")
    assert [r["score"] for r in quality_rank.rank_quality(docs, none).collect()] == [0.5] * 3
    assert quality_rank.rank_quality(docs.limit(0), none).count() == 0
