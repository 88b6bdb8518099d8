"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point alone. A trigram binds three of them:
the first permuted twice, the second once, multiplied place by place. A text bundles (adds) the vectors of its trigrams,
a language bundles the texts that carry its name, and a text gets the language whose prototype has the highest cosine.

Learning reads every text that may be learned from: each partition adds up its own bundle for each language, so what is
shuffled is one vector per partition and language, in whole numbers, and the sum does not depend on the order. The
prototypes (``DIMENSIONS`` numbers a language) are the only thing that reaches the driver and the tasks.

Letters are lower-cased; anything else ends a word, and a border counts as a letter of its trigrams. Text, and nothing
else, is the input of a prediction.

Defined results: null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be
learned. Rows with null text or null language are not learned from. Cosines that are equal go to the first language in
code point order. Rows without doc_id are held out. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.llm import arrow_text as at
from tripleframe.llm.common import only

DIMENSIONS = 1024
UNKNOWN = "und"
TEXTS = 256
DENSE_CODES = 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case code point of every letter, 0 for all that is no letter."""
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(letters: np.ndarray, size: int) -> np.ndarray:
    """One row of +1 and -1 for each code point."""
    words = size // 64
    with np.errstate(over="ignore"):
        seeds = letters.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
        bits = at.mix(at.mix(seeds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def trigrams(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, trigrams as rows of three places in letters, how often each text has each trigram)."""
    texts = len(ends) - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    begin = np.searchsorted(lead, ends)
    symbols = np.insert(_letters()[points], begin, 0)
    owner = np.repeat(np.arange(texts + 1), np.diff(begin, append=len(points)) + 1)
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    symbols, owner = symbols[keep], owner[keep]
    if len(symbols) < 3:
        return np.zeros(1, dtype=np.int64), np.zeros((0, 3), dtype=np.int64), np.zeros((texts, 0), dtype=np.float32)
    seen = np.zeros(0x110000, dtype=bool)
    seen[symbols] = True
    letters = np.flatnonzero(seen)
    n = len(letters)
    place = np.zeros(0x110000, dtype=np.int64)
    place[letters] = np.arange(n)
    x = place[symbols]
    middle = symbols[1:-1] != 0
    codes = ((x[:-2] * n + x[1:-1]) * n + x[2:])[middle]
    owner = owner[1:-1][middle]
    if n**3 <= DENSE_CODES:
        present = np.zeros(n**3, dtype=bool)
        present[codes] = True
        known = np.flatnonzero(present)
        to = np.zeros(n**3, dtype=np.int64)
        to[known] = np.arange(len(known))
        column = to[codes]
    else:
        known, column = np.unique(codes, return_inverse=True)
    counts = np.bincount(owner * len(known) + column, minlength=texts * len(known)).reshape(texts, len(known))
    return letters, np.stack([known // (n * n), known // n % n, known % n], axis=1), counts.astype(np.float32)


def bundles(raw: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The hypervector of each text; zeros for a text without letters."""
    letters, grams, counts = trigrams(raw, ends)
    vectors = letter_vectors(letters, size)
    twice, once = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    out = np.zeros((counts.shape[0], size), dtype=np.float32)
    for i in range(0, len(grams), 4096):
        a, b, c = grams[i : i + 4096].T
        bound = twice[a] * once[b] * vectors[c]
        out += counts[:, i : i + 4096] @ bound.astype(np.float32)
    return out


def _learn(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for row, stop, raw, ends in at.chunks(batch.column("text"), rows=TEXTS):
                vectors = bundles(raw, ends, size)
                here = names[row:stop]
                for name in set(here):
                    total = np.rint(vectors[here == name]).astype(np.int64).sum(axis=0)
                    sums[name] = sums[name] + total if name in sums else total
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.string()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["lang", "bundle"]
            )

    return run


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = DIMENSIONS) -> DataFrame:
    """(lang, place, value): the bundle of each language over all rows that have a text and a language."""
    rows = only(docs, lang=lang, text=text).filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(_learn(size), "lang string, bundle array<long>")
    return (
        parts.select("lang", F.posexplode("bundle").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
    )


def _predict(names: list[str], profiles: np.ndarray):
    size = profiles.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = [], []
            for row, stop, raw, ends in at.chunks(batch.column("text"), rows=TEXTS):
                vectors = bundles(raw, ends, size)
                norms = np.linalg.norm(vectors, axis=1)
                if not names:
                    found += [UNKNOWN] * (stop - row)
                    scores += [0.0] * (stop - row)
                    continue
                cosines = (vectors @ profiles.T) / np.maximum(norms, 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                for i in range(stop - row):
                    found.append(names[best[i]] if norms[i] > 0 else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, cosines[i, best[i]]))) if norms[i] > 0 else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a row is kept from learning: crc32 of its identifier as text, modulo ``folds``, is ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = DIMENSIONS
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learns from the rows that are not held out."""
    rows = only(docs, doc_id=doc_id, text=text, lang=lang).withColumn("held_out", held_out(F.col("doc_id")))
    learned = prototypes(rows.filter(~F.col("held_out")), "text", "lang", size).collect()
    names = sorted({r["lang"] for r in learned})
    profiles = np.zeros((len(names), size), dtype=np.float64)
    for r in learned:
        profiles[names.index(r["lang"]), r["place"]] = r["value"]
    profiles /= np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        _predict(names, profiles.astype(np.float32)), f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
