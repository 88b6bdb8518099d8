"""Fingerprints, personal data and byte-level BPE against plain Python and the public library."""

import base64
import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tripleframe.llm import bpe, fingerprints, pii

K, W = fingerprints.K, fingerprints.W


def winnow(text):
    runs = [text[i : i + K] for i in range(len(text) - K + 1)] if len(text) >= K else [text] if text else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() >> 33 for x in runs]
    out = []
    for a in range(max(1, len(hashes) - W + 1) if hashes else 0):
        window = hashes[a : a + W]
        place = a + max(i for i, h in enumerate(window) if h == min(window))
        if not out or out[-1][0] != place:
            out.append((place, hashes[place]))
    return out


def packed(marks):
    return " ".join(f"{(h << 31) + (1 << 31) - 1 - p:X}" for p, h in marks)


def likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_fingerprints_equal_plain_winnowing(make_docs, texts):
    docs = [(i * 5, t) for i, t in enumerate(texts)]
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_next(make_docs(docs), ranges=7).collect()}
    assert len(rows) == len(docs)
    order = sorted(docs, reverse=True)
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r, own = rows[doc_id], winnow(text)
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == packed(own)
        assert r["edited_fingerprint"] == packed(winnow(edited))
        assert r["near_edited"] == pytest.approx(likeness(own, winnow(edited)))
        assert r["near_next"] == pytest.approx(likeness(own, winnow(following)))


def test_shared_passages_share_marks(make_docs):
    shared = "".join(random.Random(1).choice("abcdefgh ") for _ in range(K + W - 1))
    docs = make_docs([(1, "xyz xyz xyz 123 " + shared + " tail of one"), (2, shared + "9876543210")])
    a, b = (dict((m["hash"], m["position"]) for m in r["marks"]) for r in fingerprints.fingerprints(docs).orderBy("doc_id").collect())
    assert any(a[h] - b[h] == 16 for h in a.keys() & b.keys())


def test_fingerprints_odd_rows(make_docs):
    docs = make_docs([(None, "null id"), (3, "same text, same text"), (3, "same text, same text"), (1, None)])
    docs = docs.selectExpr("*", "1 AS range", "2 AS tie", "3 AS extra")
    rows = fingerprints.compare_with_next(docs).collect()
    assert len(rows) == 4
    same = [r for r in rows if r["doc_id"] == 3]
    assert same[0]["fingerprint"] == same[1]["fingerprint"] and 1.0 in [r["near_next"] for r in same]
    alone = fingerprints.compare_with_next(docs.filter("doc_id = 1")).collect()
    assert [(r["near_edited"], r["near_next"], r["n_chars"]) for r in alone] == [(1.0, 1.0, 0)]
    assert fingerprints.compare_with_next(docs.limit(0)).count() == 0


# The base patterns as the contract gives them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if valid(kind, m.group())]
    return sorted(found)


def test_base_spans_equal_python_matches(spark):
    rng = random.Random(3)
    parts = list("0123456789..@@+-  ()ax%_1234567890") + "a@b.c 1.2.3.4 4111111111111111 é 😀".split()
    parts += ["+1 (234) 567-8901", "\n", "255.255.255.256", "4111 1111-1111 1111"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", pii.base_spans(F.col("text")).alias("b"))
    for r in frame.collect():
        assert [(x["start"], x["rank"], x["end"], x["kind"]) for x in r["b"]] == base_spans(r["text"])


def test_very_long_runs_need_no_deep_recursion(spark):
    text = "1" * 60_000 + " " + "a.b" * 20_000 + "@x." + "y." * 5_000 + "z " + "+1" + "2" * 40_000
    row = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(F.col("text")).alias("b")).first()
    assert [(x["kind"], x["start"]) for x in row["b"]] == [("email", 60_001)]


def test_terms_that_give_entities_away(make_docs):
    docs = [(i, f"filler word{i} of the text in") for i in range(60)]
    docs += [(100 + i, f"{a} the clerk Zorbax mail me@corp.org in the text") for i, a in enumerate("ab")]
    rows = {r["doc_id"]: r for r in pii.counts_and_spans(make_docs(docs)).collect()}
    assert all(rows[i]["spans"] == "" and rows[i]["n_email"] == 0 for i in range(60))
    text = docs[60][1]
    spans = rows[100]["spans"].split(",")
    at = text.index("me@corp.org")
    assert f"email:{at}:{at + 11}" in spans
    z = text.index("Zorbax")
    assert f"term:{z}:{z + 6}" in spans and rows[100]["n_terms"] == 3  # clerk, Zorbax and mail, not in
    assert rows[100]["base_sha256"] == hashlib.sha256(f"email:{at}:{at + 11}".encode()).hexdigest()
    made = make_docs([docs[60], docs[61]] + docs[:60])
    spotted = pii.personal_data(made).join(made.select("doc_id", "text"), "doc_id")
    clean = {r["doc_id"]: r["c"] for r in spotted.select("doc_id", pii.sanitised(F.col("text"), F.col("base"), F.col("terms")).alias("c")).collect()}
    assert clean[0] == docs[0][1]
    assert "Zorbax" not in clean[100] and "[email]" in clean[100] and clean[100].endswith(" in the text")


def test_terms_of_whole_documents_at_every_place(make_docs):
    rng = random.Random(6)
    url = "https://example.org/" + "a1b/" * 60
    far = " ".join(f"w{i % 17}" for i in range(300))
    docs = [(i, f"plain w{i % 17} text {i}") for i in range(80)]
    docs += [(100 + i, f"é😀 Zorbax\twrote.  {far} x{i} mail me@corp.org or {url}\nthen Zorbax and {far} {url} Zorbax.") for i in range(2)]
    docs += [(200 + i, " ".join(rng.choice("abcdefghij") for _ in range(9)) + f" 10.0.0.{i % 3} u{i % 4}") for i in range(9)]
    docs += [(300, "me@other.org alone Quux"), (301, "me@third.org"), (302, "me@third.org Solo"), (303, "me@third.org Solo")]
    holding = {}
    for k, (_, text) in enumerate(docs):
        for a, _, b, kind in base_spans(text):
            holding.setdefault(f"{kind}:{text[a:b]}", set()).add(k)
    spans = [base_spans(t) for _, t in docs]
    free = [
        [m for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if not any(s[0] < m.end() and m.start() < s[2] for s in found)]
        for (_, t), found in zip(docs, spans, strict=True)
    ]
    outside = [{m.group() for m in f} for f in free]
    every = [set(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in docs]
    want = {d: {} for d, _ in docs}
    for rows in holding.values():
        for term in set().union(*(outside[k] for k in rows)):
            both, n = sum(term in outside[k] for k in rows), len(docs)
            share = math.log2(both * n / (sum(term in e for e in every) * len(rows))) / math.log2(n / len(rows))
            if both >= 2 and share >= 0.5:
                for k in rows:
                    for m in free[k]:
                        if m.group() == term:
                            place = want[docs[k][0]]
                            place[m.span()] = max(share, place.get(m.span(), 0))
    got = {r["doc_id"]: {(x["start"], x["end"]): x["action"] for x in r["terms"]} for r in pii.personal_data(make_docs(docs)).collect()}
    assert got == {d: {s: "remove" if x >= 0.9 else "generalise" for s, x in places.items()} for d, places in want.items()}
    found = [docs[80][1][a:b] for a, b in sorted(got[100])]
    assert found.count("Zorbax") == 2 and found.count(url) == 2


def test_personal_data_odd_rows(make_docs):
    docs = make_docs([(None, "x a@b.cd"), (1, None), (1, ""), (2, "a@b.cd"), (2, "a@b.cd")]).selectExpr("*", "1 AS row", "2 AS base")
    rows = sorted([(str(r["doc_id"]), r["n_email"]) for r in pii.counts_and_spans(docs).collect()])
    assert rows == [("1", 0), ("1", 0), ("2", 1), ("2", 1), ("None", 1)]
    assert pii.counts_and_spans(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    with open(public.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_decode_back(make_docs, texts, library):
    rng = random.Random(5)
    parts = list(" '  \n\t\r 　aestrlvmd'SXé中1٣½#!?<|>\u0085\x1c​😀") + ["'s", "'ll", "'re", "'ve", " '", "''", "'l"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    odd += ["<|endoftext|>", "a" * 3000, "ab'" * 500, "don't we'll I'VE they're", " " * 700 + "x"]
    rows = list(enumerate([*texts, *odd]))
    docs = make_docs(rows)
    encoded = bpe.encode(docs)
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(encoded).collect()}
    for r in encoded.collect():
        text = rows[r["doc_id"]][1] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert back[r["doc_id"]] == text.encode()
        assert (r["ends"] or [0])[-1] == len(text.encode())
    for r in bpe.digests(docs).collect():
        ids = library.encode_ordinary(rows[r["doc_id"]][1] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((rows[r["doc_id"]][1] or "").encode()).hexdigest()


def test_long_and_short_merges_agree_and_the_cache_is_bounded(library):
    coder = bpe.encoder(bpe.VOCABULARY)
    rng = random.Random(8)
    for _ in range(200):
        piece = "".join(rng.choice("abnath e") for _ in range(rng.randint(2, 60))).encode()
        assert bpe._merge_short(piece, coder.ranks) == bpe._merge_long(piece, coder.ranks)
    small = bpe.Encoder(__import__("public_tokenizers").path(bpe.VOCABULARY), cache_pieces=50)
    import numpy as np

    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(30))
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        ids, _ = small.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == library.encode_ordinary(text)
        assert len(small.slots) <= 150


def test_bpe_empty_table(make_docs):
    docs = make_docs([(1, "x")]).selectExpr("*", "1 AS ids", "2 AS ends").limit(0)
    assert bpe.encode(docs).count() == 0 and bpe.digests(docs).count() == 0


def test_marks_of_edited_texts_come_from_the_windows_of_their_originals(spark):
    rng = random.Random(8)
    rows = []
    for n in [*range(60), 75, 76, 200]:
        for m in (0, 1, 9, 30, 100):
            text, tail = ("".join(rng.choice("ab\n\u00e9\U0001f600") for _ in range(x)) for x in (n, m))
            rows.append((text, n - n // 3, tail[: n // 3]))
    df = spark.createDataFrame(rows, "text string, kept int, tail string").withColumn("own", fingerprints.windows(F.col("text")))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("kept")), "tail")
    cols = [F.col(x) for x in ("own", "kept", "text", "tail")]
    got = df.select(fingerprints.marks(edited).alias("whole"), fingerprints.edited_marks(*cols).alias("joined")).collect()
    assert len(got) == len(rows) and all(r["whole"] == r["joined"] for r in got)
