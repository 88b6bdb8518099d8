"""All five finders of :mod:`tripleframe.plans.mentions` in one pass over each text, in Arrow batches.

The finders of that module say what a mention is; this one reads a text once, keeps the first place of each name and
word, and merges them where they are. Python's regular expressions get the word characters and lower-case letters of the
JVM, so both find the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleframe.functions.needles import Needles

# Rows of one output batch, about.
ROWS = 50_000
# What ``(?iU)`` matches beside both cases of an ASCII letter.
OTHER_CASES = {"i": "ıİ", "k": "K", "s": "ſ"}
# What ``\s`` matches under ``(?U)``.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

MERGED = "text string, kinds array<string>, sources array<string>, start int, end int, ord struct<phase:int,rank:int,name:string,pos:int>"
SINGLE = "text string, kinds array<string>, source string, start int, end int, ord struct<phase:int,rank:int,name:string,pos:int>"


class Tables(NamedTuple):
    """What differs between Python and the JVM: its word characters as a regular expression, lower case of letters Python does not know."""

    word: str
    lower: dict[int, str]


_TABLES: list[Tables] = []


def jvm_tables(spark: SparkSession) -> Tables:
    """Asked of the JVM once in a process."""
    if not _TABLES:
        every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and i != 10]
        rows = [(k, "".join(every[k : k + 8192]), "\n".join(every[k : k + 8192])) for k in range(0, len(every), 8192)]
        asked = spark.createDataFrame(rows, "k int, run string, lines string")
        told = asked.select("k", F.regexp_replace("run", r"(?U)\W", "\n").alias("words"), F.lower("lines").alias("low")).collect()
        words, lower = [], {}
        for k, kept, low in told:
            words += [ord(c) for c in kept if c != "\n"]
            lower |= {ord(c): x for c, x in zip(every[k : k + 8192], low.split("\n"), strict=True) if c.lower() != x}
        code = np.sort(np.array(words))
        runs = np.split(code, np.flatnonzero(np.diff(code) > 1) + 1)
        _TABLES.append(Tables("".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs), lower))
    return _TABLES[0]


def _folded(pattern: str) -> str:
    """A Java pattern of letters, ``\\s``, groups and escapes, without regard to case."""
    out = []
    for piece in re.findall(r"\\.|\(\?:|.", pattern):
        if piece == r"\s":
            out.append(SPACE)
        elif piece.isalpha():
            out.append(f"[{piece}{piece.upper()}{OTHER_CASES.get(piece, '')}]")
        else:
            out.append(piece)
    return "".join(out)


def _phrases(pattern: str, word: str, edge: str) -> str:
    """``\\b(one|other)\\b``, with all first letters ahead so that Python skips what is none."""
    choices = re.fullmatch(r"\(\?iU\)\\b\((.*)\)\\b", pattern)[1].split("|")
    heads = {c[0]: _folded(c[0]) for c in choices}
    tails = "|".join(f"(?<={heads[c[0]]}){_folded(c[1:])}" for c in choices)
    return f"[{''.join(h[1:-1] for h in heads.values())}](?<!{word}.)(?:{tails}){edge}"


class Patterns:
    """The four patterns for texts of ASCII or of any letters."""

    def __init__(self, verbs: str, nouns: str, word: str | None) -> None:
        w, edge = (f"[{word}]", f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))") if word else (r"\w", r"\b")
        # The words of the two last patterns are of ASCII: after one of their letters no word character may follow.
        after = f"(?:(?<=[a-zA-Z0-9_])(?!{w})|(?<=-)(?={w}))" if word else edge
        flags = 0 if word else re.ASCII
        self.verbs, self.nouns = re.compile(_phrases(verbs, w, edge), flags), re.compile(_phrases(nouns, w, edge), flags)
        self.capital, self.low = (re.compile(f"[{a}](?<!{w}.)[a-zA-Z0-9_-]+{after}", flags) for a in ("A-Z", "a-z"))


_CUE = re.compile(r"[^-]*-[0-9]+")


class Name(NamedTuple):
    """One kind and source of a needle, with the first term by listing order."""

    needle: str
    kind: str | None
    source: str
    rank: int
    iri: str | None
    pos: int


def _interned(lists: list[tuple], value: tuple, at: dict[tuple, int]) -> int:
    if value not in at:
        at[value] = len(lists)
        lists.append(value)
    return at[value]


class _Out:
    """Rows of one output batch."""

    def __init__(self, merged: bool) -> None:
        self.merged, self.rows, self.lists, self.at = merged, [], [], {}

    def add(self, row: int, parts: list[tuple]) -> None:
        """``parts`` of one text in lower case: (order, kinds, source, text, start, end, ord)."""
        if len(parts) > 1:
            parts.sort(key=lambda p: p[:3])
        if self.merged:
            kinds = tuple(dict.fromkeys(k for p in parts for _, k in p[1]))
            self._row(row, parts[0], kinds, tuple(dict.fromkeys(p[2] for p in parts)))
        else:
            for p in parts:
                self._row(row, p, tuple(k for _, k in p[1]), p[2])

    def _row(self, row: int, part: tuple, kinds: tuple, source) -> None:
        sources = _interned(self.lists, source, self.at) if self.merged else source
        self.rows.append((row, part[3], _interned(self.lists, kinds, self.at), sources, part[4], part[5], *part[6]))

    def batch(self, keys: pa.Array, names: list[str]) -> pa.RecordBatch:
        row, text, kinds, source, start, end, phase, rank, name, pos = zip(*self.rows, strict=True)
        lists = pa.array(self.lists, pa.list_(pa.string()))
        ints = lambda x: pa.array(x, pa.int32())
        sources = lists.take(ints(source)) if self.merged else pa.array(source, pa.string())
        order = pa.StructArray.from_arrays([ints(phase), ints(rank), pa.array(name, pa.string()), ints(pos)], ["phase", "rank", "name", "pos"])
        return pa.RecordBatch.from_arrays([keys.take(ints(row)), pa.array(text, pa.string()), lists.take(ints(kinds)), sources, ints(start), ints(end), order], names=names)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and where each begins, the end of the last included; a null is empty."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    ends = np.frombuffer(places, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), ends


class Scanner:
    """``names`` and ``words`` (lower-case names of individuals that are one word) against texts."""

    def __init__(self, names: list[Name], words: list[str], skipped: list[str], verbs: str, nouns: str, tables: Tables) -> None:
        self.words, self.skipped, self.lower = frozenset(words), frozenset(skipped), tables.lower
        self.held: dict[str, list[Name]] = {}
        for n in names:
            self.held.setdefault(n.needle, []).append(n)
        self.texts = list(self.held)
        self.needles = Needles([t.encode() for t in self.texts])
        self.ascii, self.any = Patterns(verbs, nouns, None), Patterns(verbs, nouns, tables.word)

    def _lowered(self, text: str) -> str:
        if self.lower and not text.isascii():
            text = "".join(self.lower.get(ord(c), c) for c in text)
        return text.lower()

    def _names(self, text: str, hits: list[tuple[int, int]], found: dict) -> None:
        for needle, start in hits:
            name = self.texts[needle]
            own = text[start : start + len(name)]
            key = self._lowered(own.strip(" "))
            for n in self.held[name]:
                order = (1, n.rank, (n.iri is not None, n.iri or ""), n.pos)
                part = (order, ((n.kind is not None, n.kind),), n.source, own, start, start + len(name), (1, n.rank, n.iri, n.pos))
                parts = found.setdefault(key, [])
                for k, p in enumerate(parts):
                    if p[1:3] == part[1:3]:
                        if order < p[0]:
                            parts[k] = part
                        break
                else:
                    parts.append(part)

    def _words(self, text: str, found: dict) -> None:
        """A word is met from left to right, so that its first place stays."""
        use = self.ascii if text.isascii() else self.any

        def add(key: str, shown: str, kinds: tuple, source: str, phase: int, start: int, end: int) -> None:
            part = ((phase, 0, (True, ""), start), kinds, source, shown, start, end, (phase, 0, "", start))
            found.setdefault(key, []).append(part)

        property_, class_, individual = ((True, "property"),), ((True, "class"),), ((True, "individual"),)
        for pattern, kinds, source, phase in ((use.verbs, property_, "verb_phrase", 2), (use.nouns, class_, "class_noun", 3)):
            seen = set()
            for m in pattern.finditer(text):
                if (key := self._lowered(m[0])) not in seen:
                    seen.add(key)
                    add(key, key, kinds, source, phase, m.start(), m.end())
        seen = set(self.skipped)
        for m in use.capital.finditer(text):
            if (key := (token := m[0]).lower()) not in seen:
                seen.add(key)
                if not _CUE.fullmatch(token):
                    add(key, token, individual + class_, "capitalized", 4, m.start(), m.end())
        if self.words:
            seen = set()
            for m in use.low.finditer(text):
                if (key := (token := m[0]).lower()) in self.words and key not in seen:
                    seen.add(key)
                    add(key, token, individual, "individual_name", 5, m.start(), m.end())

    def scan(self, keys: pa.Array, texts: pa.Array, lowered: pa.Array, merged: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
        data, ends = _buffers(texts)
        low, low_ends = _buffers(lowered)
        row, needle, start = self.needles.first_in(low[: low_ends[-1]], low_ends)
        first = np.searchsorted(row, np.arange(len(keys) + 1))
        out = _Out(merged)
        for r in range(len(keys)):
            text = str(data[ends[r] : ends[r + 1]].data, "utf-8", "replace")
            found: dict[str, list[tuple]] = {}
            hits = slice(first[r], first[r + 1])
            # Names are looked up by the key of the text, so a text without one has none.
            if first[r] < first[r + 1] and keys[r].is_valid:
                begin, at = low_ends[r], start[hits]
                if not text.isascii():
                    at = [begin + np.count_nonzero((low[begin:x] & 0xC0) != 0x80) for x in at]
                self._names(text, [(n, int(x - begin)) for n, x in zip(needle[hits], at, strict=True)], found)
            if text:
                self._words(text, found)
            for parts in found.values():
                out.add(r, parts)
            if len(out.rows) >= ROWS:
                yield out.batch(keys, names)
                out = _Out(merged)
        if out.rows:
            yield out.batch(keys, names)


def scanned(questions: DataFrame, scanner: Scanner, merged: bool) -> DataFrame:
    """Mentions of each row of ``questions``: merged, or one for each text, kind and source."""
    kind = questions.schema["question_id"].dataType
    schema = T.StructType([T.StructField("question_id", kind), *T._parse_datatype_string(MERGED if merged else SINGLE).fields])
    body: Column = F.col("question")
    rows = questions.select("question_id", body.cast("binary").alias("text"), F.lower(body).cast("binary").alias("low")).where(body.isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from scanner.scan(batch.column("question_id"), batch.column("text"), batch.column("low"), merged, schema.names)

    return rows.mapInArrow(run, schema)
