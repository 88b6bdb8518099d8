"""Quality classifier: Bradley-Terry scores from preference pairs.

A text has a short vector of measures of its form. Each pair of a good and a bad labelled text says that the good one is
preferred; the model gives texts a score w.x so that the probability of the preference is the logistic function of the
difference of the scores. The scores are cut at the quantile that equals the share of bad labels, and the reported score
is the probability of being preferred to a text at the cut.

Measures are taken from every whole text in one pass without a shuffle and written, as a few numbers a document; labels
meet that table, not the texts. The model is fitted on all labelled rows that may be learned from: they are numbered in
the order of a hash of their identifier, and every row of the commoner label meets rows of the other in even steps around
its numbers, so that every row takes part. These are all pairs up to ``PAIRS`` of them, and beyond at least
``PARTNERS`` for each row of the commoner label. Newton steps and the cut are jobs over these tables; the driver gets
sums, and the two scores on both sides of the cut.

Defined results: null text is empty; empty text has measures of zero and a score like any other. Labels that are null or
neither 0 nor 1 are not used; a document that is labelled more than once counts each time. Without labels of both kinds
all scores are 0.5. Rows without doc_id are held out. Only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleframe.llm import arrow_text as at
from tripleframe.llm.common import only, written
from tripleframe.llm.language import held_out

PAIRS = 100_000
PARTNERS = 4
RIDGE = 1e-3
MEASURES = (
    "log_words bytes_per_word symbols_per_word upper_share digits_share marks_per_word stops_per_word lines_per_word "
    "beyond_ascii_share distinct_share same_as_previous repeated_triples"
).split()

_LOWER, _UPPER, _DIGIT, _SYMBOL, _MARK, _STOP, _LINE, _HIGH, _REST = range(9)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _REST, dtype=np.int64)
    kinds[128:] = _HIGH
    for chars, kind in (
        ("abcdefghijklmnopqrstuvwxyz", _LOWER),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
        ("0123456789", _DIGIT),
        ("#*$%&|<>{}[]=_~^\\", _SYMBOL),
        ("!?", _MARK),
        (".,;:", _STOP),
        ("\n", _LINE),
    ):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


_KINDS = _byte_kinds()


def _distinct(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """How many distinct values each text has."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=texts)


def measures(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of measures for each text."""
    texts = len(ends) - 1
    owner = np.repeat(np.arange(texts), np.diff(ends))
    kinds = np.bincount(owner * 9 + _KINDS[raw], minlength=texts * 9).reshape(texts, 9)
    begin, end, first = at.word_spans(raw, ends)
    words = np.diff(first)
    word_owner = np.repeat(np.arange(texts), words)
    hashes = at.word_hashes(raw, begin, end)
    same = np.zeros(texts, dtype=np.int64)
    if len(hashes) > 1:
        again = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
        same = np.bincount(word_owner[1:][again], minlength=texts)
    triples, starts = at.shingle_hashes(hashes, first, 3)
    n_triples = np.diff(starts)
    distinct_triples = _distinct(triples, np.repeat(np.arange(texts), n_triples), texts)
    n = np.maximum(words, 1)
    ascii_letters = np.maximum(kinds[:, _LOWER] + kinds[:, _UPPER], 1)
    solid = np.maximum(np.bincount(word_owner, weights=end - begin, minlength=texts), 1)
    return np.stack(
        [
            np.log1p(words),
            np.bincount(word_owner, weights=end - begin, minlength=texts) / n,
            kinds[:, _SYMBOL] / n,
            kinds[:, _UPPER] / ascii_letters,
            kinds[:, _DIGIT] / solid,
            kinds[:, _MARK] / n,
            kinds[:, _STOP] / n,
            kinds[:, _LINE] / n,
            kinds[:, _HIGH] / solid,
            np.where(words > 0, _distinct(hashes, word_owner, texts) / n, 0),
            same / n,
            np.where(n_triples > 0, 1 - distinct_triples / np.maximum(n_triples, 1), 0),
        ],
        axis=1,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [measures(raw, ends) for _, _, raw, ends in at.chunks(batch.column("text"))]
        table = np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)))
        flat = pa.array(np.ascontiguousarray(table).ravel())
        places = pa.array(np.arange(len(table) + 1, dtype=np.int32) * len(MEASURES))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.ListArray.from_arrays(places, flat)],
            names=["doc_id", "held_out", "measures"],
        )


def _sums(w: np.ndarray):
    """The sums of the gradient and of the curvature of a task's preferences at the weights ``w``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) * (len(w) + 1))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            total += np.concatenate([x.T @ (1 - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    return run


def fit_pairs(pairs: DataFrame, n: int, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights that maximise the likelihood of all ``n`` preferences (x: the differences), by Newton steps."""
    size = len(MEASURES)
    w = np.zeros(size)
    for _ in range(rounds):
        sums = pairs.mapInArrow(_sums(w), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        total = np.array([r["value"] for r in sorted(sums.collect())]) / n
        gradient = total[:size] - ridge * w
        step = np.linalg.solve(total[size:].reshape(size, size) + ridge * np.eye(size), gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``number``, their place in the order from 0; ranges are sorted and counted, none is gathered."""
    ranged = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    ranges = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("range", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranged.withColumn("place", place).join(starts, "range").withColumn("number", F.col("start") + F.col("place"))


def paired(rows: DataFrame, good: int, bad: int, scale: np.ndarray) -> tuple[DataFrame, int]:
    """(x) of the preferences, the scaled differences of good and bad rows, and how many there are."""
    many, few = max(good, bad), min(good, bad)
    partners = min(few, max(PARTNERS, -(-PAIRS // many)))
    number = F.col("number") - F.when(F.col("label") == 1, bad).otherwise(0)
    placed = written(_numbered(rows.withColumn("hash", F.xxhash64("doc_id")), "label", "hash", "doc_id", "measures").select("label", "measures", number.alias("number")))
    common = int(good >= bad)
    meets = F.transform(F.sequence(F.lit(0), F.lit(partners - 1)), lambda k: (F.col("number") + F.floor(k * few / partners)) % few)
    left = placed.filter(F.col("label") == common).select(F.col("measures").alias("a"), F.explode(meets).alias("number"))
    right = placed.filter(F.col("label") != common).select(F.col("measures").alias("b"), "number")
    sign = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 1) * (1 if common else -1)
    difference = F.zip_with(F.zip_with("a", "b", lambda x, y: x - y), F.array(*[F.lit(float(v)) for v in sign]), lambda x, v: x * v)
    return written(left.join(right, "number").select(difference.alias("x"))), many * partners


def _product(w: np.ndarray) -> Column:
    products = F.zip_with("measures", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """(weights, cut) of ``rows`` (doc_id, measures, label): w.x - cut is a score relative to the quantile of the bad share."""
    spread = [F.stddev_pop(F.col("measures")[i]).alias(name) for i, name in enumerate(MEASURES)]
    about = rows.agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"), *spread).first()
    good, bad = about["good"], about["bad"]
    if not good or not bad:
        return np.zeros(len(MEASURES)), 0.0
    scale = np.array([about[name] for name in MEASURES])
    pairs, n = paired(rows, good, bad, scale)
    w = fit_pairs(pairs, n) / np.where(scale > 0, scale, 1)
    scored = _numbered(rows.select(_product(w).alias("score")), "score")
    # The scores on both sides of the quantile of the bad share.
    edge = scored.filter(F.col("number").isin(bad - 1, bad)).agg(F.avg("score")).first()[0]
    return w, float(edge)


def rank_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learns from labelled rows that are not held out."""
    rows = only(docs, doc_id=doc_id, text=text).withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = written(rows.mapInArrow(_measure, f"doc_id {kind}, held_out boolean, measures array<double>"))
    marks = only(labels, doc_id=doc_id, label=label).filter("label IN (0, 1)")
    known = written(measured.filter(~F.col("held_out")).join(marks, "doc_id").select("doc_id", "measures", "label"))
    w, cut = fit(known)
    margin = _product(w) - F.lit(cut)
    return measured.select(
        "doc_id", "held_out", (1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(50.0)), F.lit(-50.0))))).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
