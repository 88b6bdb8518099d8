"""Conversation repair, prefix trie and impact-ordered search against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe.llm import digests, impact_search, prefix_trie, queries, turn_repair

TURNS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def exhaustive(codes, inserts):
    """Least (cost, audit, initials) over all edits with at most ``inserts`` inserted turns."""
    best = None
    for where in itertools.product(range(inserts + 1), repeat=len(codes) + 1):
        if sum(where) > inserts:
            continue
        slots = []
        for i, n in enumerate(where):
            slots += [None] * n + ([codes[i]] if i < len(codes) else [])
        choices = []
        for c in slots:
            if c is None:
                choices.append([("I", "u", 2), ("I", "a", 2)])
            elif c == "x":
                choices.append([("D", "", 3)])
            else:
                cut = 1 if c.isupper() else 0
                own = {"o": "t"}.get(c.lower(), c.lower())
                choices.append([("D", "", 3), ("K", own, cut), ("R", "u", 2 + cut), ("R", "a", 2 + cut)])
        for picked in itertools.product(*choices):
            if GRAMMAR.fullmatch("".join(p[1] for p in picked)):
                best = min(x for x in (best, (sum(p[2] for p in picked), "".join(p[0] for p in picked))) if x)
    return best


def linear(codes):
    """The same by walking an automaton from left to right; for long inputs."""

    def closed(states):
        for _ in range(3):
            for p, q in (("0", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                if p in states:
                    c, audit = states[p]
                    states[q] = min(states.get(q, (10**9, "")), (c + 2, audit + "I"))
        return states

    states = closed({"0": (0, "")})
    for code in codes:
        after = {}
        for p, (c, audit) in states.items():
            steps = [(p, 3, "D")]
            if code != "x":
                cut = 1 if code.isupper() else 0
                for symbol, initial in (("0s", "s"), ("0u", "u"), ("su", "u"), ("au", "u"), ("ua", "a")):
                    if symbol[0] == p and initial == code.lower():
                        steps.append((symbol[1], cut, "K"))
                    if symbol[0] == p and initial != "s":
                        steps.append((symbol[1], 2 + cut, "R"))
            for q, cost, edit in steps:
                after[q] = min(after.get(q, (10**9, "")), (c + cost, audit + edit))
        states = closed(after)
    return min(states[p] for p in ("0", "a") if p in states)


def test_chart_equals_all_edits():
    for n in range(4):
        for codes in itertools.product("xsuaoUA", repeat=n):
            assert turn_repair.cheapest(turn_repair.parse_codes("".join(codes))) == exhaustive(codes, 3 if n < 3 else 2)


def test_chart_equals_the_automaton_on_long_rows():
    rng = random.Random(3)
    for n in (5, 16, 17, 64, 200, 700):
        codes = "".join(rng.choice("uauauauasxoUAS") for _ in range(n))
        cells = [turn_repair.parse_codes(codes[i : i + 64]) for i in range(0, n, 64)]
        assert turn_repair.cheapest(turn_repair.parse(cells)) == linear(codes)


def repaired(rows):
    """Summary and digest of each conversation of (conv_id, turn, role, text), in plain Python."""
    out = {}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    for conv, members in by_conv.items():
        members = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in members]
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
        seen, codes, counts = set(), "", [0, 0, 0]
        for _, role, text in members:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            init = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not last:
                counts[0], code = counts[0] + 1, "x"
            elif (role, text) in seen:
                counts[1], code = counts[1] + 1, "x"
            elif last not in ".!?":
                counts[2], code = counts[2] + 1, init.upper()
            else:
                code = init
            seen.add((role, text))
            codes += code
        turns = {m[0] for m in members if m[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(members, members[1:]))
        cost, audit = linear(codes)
        lines, it = [], iter(members)
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(it)[1:]
            if edit == "D":
                continue
            odd = (len(lines) - (1 if lines and lines[0].startswith("s") else 0)) % 2
            lines.append(f"{role if edit == 'K' else ('assistant' if odd else 'user')}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def summary_of(found):
    lines = found.rows.select("conv_id", "out_idx", F.concat("role", F.lit(":"), "text").alias("line"))
    sums = {r["k"]: r["sha256"] for r in digests.ordered_sha256(lines, "conv_id", "out_idx", "line", "\n").collect()}
    return {
        r["conv_id"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")],
                       sums.get(r["conv_id"], digests.EMPTY))
        for r in found.summary.collect()
    }


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            role = "system" if turn == 0 and rng.random() < 0.3 else "user" if turn % 2 == 0 else "assistant"
            rows.append((conv, turn if rng.random() < 0.95 else turn + 3, role, f"t{rng.randint(0, 40)} é{rng.choice('.!?x')}"))
    rows += [(100, None, "user", "first."), (100, 2, None, "none."), (100, 2, "user", None), (100, 4, "", ""), (100, 5, "tool", "x.")]
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "yes"), (101, 0, "user", " \t"), (101, 1, "user", "a.")]
    rows += [(102, 3, "user", "same."), (102, 3, "user", "same."), (102, 3, "user", "same."), (103, None, None, None)]
    rows += [(104, i, rng.choice(["user", "assistant", "tool"]), f"w{rng.randint(0, 99)}{rng.choice('.?,')}") for i in range(500)]
    rows += [(105, 0, "user", "long " * 50_000), (105, 1, "assistant", "long " * 50_000 + ".")]
    rng.shuffle(rows)
    return rows


def test_repair_equals_plain_python(spark, turns):
    table = spark.createDataFrame([(*r, "mine", 1) for r in turns], TURNS + ", audit string, at int")
    assert summary_of(turn_repair.repair(table)) == repaired(turns)


def test_repair_of_nothing(spark):
    found = turn_repair.repair(spark.createDataFrame([], TURNS))
    assert found.summary.count() == 0 and found.rows.count() == 0


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        how = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def test_op11_equals_plain_python(spark, turns, tmp_path):
    spark.createDataFrame(turns, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in queries.op11_turn_repair(spark, str(tmp_path)).collect()}
    want = repaired(damaged(turns))
    empty = (0, 0, 0, 0, 0, 0, "", digests.EMPTY)
    assert got == {conv: want.get(conv, empty) for conv in {r[0] for r in turns}}


def test_adaptive_layouts_hold_all_children():
    for n in (1, 4, 5, 16, 17, 48, 49, 256):
        node = prefix_trie._Inner(b"")
        order = random.Random(n).sample(range(256), n)
        for byte in order:
            node.put(byte, byte + 1000)
            node.put(byte, byte + 2000)
        assert [node.child(b) for b in range(256)] == [b + 2000 if b in order else None for b in range(256)]
        assert len(node.children()) == n and node.limit == min(x for x in (4, 16, 48, 256) if x >= n)


def brute_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    members = {}
    ends = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(rebuilt) + 1):
            members.setdefault(tuple(rebuilt[:d]), []).append(c)
        ends.setdefault(tuple(rebuilt), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    saved, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, inside in members.items():
        own_saved = (len(inside) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own_saved
            leaves[node[:d]] += node not in kids
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), kids.get(n, 0), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in members.items()
    )


@pytest.mark.parametrize("per_range", [250_000, 40])
def test_op12_equals_plain_python(spark, turns, tmp_path, monkeypatch, per_range):
    """The second run cuts the keys into many ranges, so that shared paths cross their ends."""
    monkeypatch.setattr(prefix_trie, "TURNS_PER_RANGE", per_range)
    rng = random.Random(per_range)
    rows = turns + [(200 + c, t, "user", "hot") for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(300 + c, t, "user", rng.choice(["a", "b"])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(400, t, "user", f"deep {t}") for t in range(300)]
    spark.createDataFrame([(*r, 7) for r in rows], TURNS + ", depth int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got) == brute_trie(rows)


def test_op12_of_nothing(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_prefix_trie(spark, str(tmp_path)).count() == 0


def brute_search(rows, k=5):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (query, q) in enumerate(whole):
        if query is None or query % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i is None, i or 0, i) for b, (i, v) in enumerate(whole) if b != a]
        out += [(query, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [1 << 21, 512])
def test_op13_equals_plain_python(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(impact_search, "SHARD_CELLS", cells)
    monkeypatch.setattr(impact_search, "QUERY_CELLS", cells // 8)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(400)]
    rows += [(i, [0.5] * 16) for i in range(400, 560)] + [(3, rows[3][1]), (50, rows[50][1]), (None, rows[100][1])]
    rows += [(600, None), (601, [None] + [1.0] * 15), (602, [float("nan")] * 16), (650, [float("inf")] * 16), (603, [1.0, -2.0]), (650, [])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_impact_search(spark, str(tmp_path))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_search(rows)


def test_op13_of_nothing_and_of_long_numbers(spark, tmp_path):
    kind = "vec_id long, embedding array<double>"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert queries.op13_impact_search(spark, f"{tmp_path}/a").count() == 0
    rows = [(0, [3e4, 2.0**40]), (1, [1.5, 2.0**4]), (2, [-3e8, 1.0]), (50, [7.0, -5.0])]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert sorted([tuple(r) for r in queries.op13_impact_search(spark, f"{tmp_path}/b").collect()], key=str) == brute_search(rows)


def test_search_stops_on_proof_where_scores_are_apart():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-20, 20, size=(4000, 16))
    vectors[:30] += 200
    index = impact_search.ImpactIndex(vectors)
    rows, processed = index.members(vectors[0], 6)
    exact = vectors @ vectors[0]
    assert set(np.argsort(-exact)[:6]) <= set(rows.tolist())
    assert processed < 0.5 and len(rows) < 300
