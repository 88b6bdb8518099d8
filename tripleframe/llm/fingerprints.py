"""Document fingerprints by winnowing.

All runs of ``K`` code points are hashed, and of every ``W`` neighbouring hashes the smallest is chosen, the rightmost
of equal ones. A chosen hash is packed above its position counted from the right, so one minimum does both; minima over
W places come from minima over 2, 4, 8 places. Chosen marks keep their positions: any two texts that share W + K - 1
code points share a mark in that place. An edited text keeps the windows of the part it shares with its original, and
only those behind are computed again.

Comparing each document with its successor needs an order of all documents, but neither one task nor a second shuffle of
texts: quantiles of the identifiers (a bounded number of them) cut ranges, each range also receives the first row of the
range below it, and neighbours meet in a window inside a range.

Defined results: null text is empty. Empty text has no marks; two empty fingerprints are alike (1), an empty and another
are not (0). A text shorter than K is its own only run, fewer runs than W are one window. Rows are ordered by doc_id
descending, null last, then by the hash of the text; repeated rows follow each other. A single row is its own successor.
An empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleframe.llm.common import bind, only

K = 10
W = 16
POSITION_BITS = 31


def windows(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen (hash, position) pair of every window, packed in longs."""
    size = F.length(text)
    runs = (
        F.when(size >= k, F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))." % k), F.lit(1)))
        .when(size > 0, F.array(text))
        .otherwise(F.array().cast("array<string>"))
    )
    last = (1 << POSITION_BITS) - 1
    packed = F.transform(
        runs,
        lambda run, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(run), 64 - POSITION_BITS), POSITION_BITS)
        + (F.lit(last).cast("long") - i),
    )

    def least(values: Column, step: int) -> Column:
        return bind(
            values,
            lambda v: F.zip_with(
                v, F.slice(v, F.lit(1 + step), F.greatest(F.size(v) - step, F.lit(0))), lambda a, b: F.least(a, b)
            ),
        )

    reach, lowest = 1, packed
    while reach * 2 <= w:
        lowest, reach = least(lowest, reach), reach * 2
    if reach < w:
        lowest = least(lowest, w - reach)
    return bind(lowest, lambda v: F.slice(v, F.lit(1), F.greatest(F.size(v) - (w - 1), F.least(F.size(v), F.lit(1)))))


def marks(text: Column, k: int = K, w: int = W) -> Column:
    """Chosen (hash, position) pairs, packed in longs, in order of position."""
    return F.array_distinct(windows(text, k, w))


def edited_marks(own: Column, kept: Column, text: Column, tail: Column, k: int = K, w: int = W) -> Column:
    """``marks`` of the first ``kept`` code points of ``text`` followed by ``tail``, from the windows ``own`` of ``text``.

    The windows computed again begin one before the first that reaches into the tail, so there is a whole one at least.
    """
    same = F.greatest(kept - (k + w - 1), F.lit(0))
    behind = F.concat(F.substring(text, same + 1, kept - same), tail)
    moved = F.transform(marks(behind, k, w), lambda mark: mark - same)
    return F.array_distinct(F.concat(F.slice(own, F.lit(1), same), moved))


def hash_of(mark: Column) -> Column:
    return F.shiftright(mark, POSITION_BITS)


def position_of(mark: Column) -> Column:
    return F.lit((1 << POSITION_BITS) - 1).cast("long") - mark.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long"))


def as_text(chosen: Column) -> Column:
    """Every mark in hexadecimal, hash above position, joined by spaces."""
    return F.array_join(F.transform(chosen, F.hex), " ")


def hashes_of(chosen: Column) -> Column:
    """The distinct hashes of the marks."""
    return F.array_distinct(F.transform(chosen, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sets of distinct hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return bind(
        F.struct(common.alias("common"), (F.size(a) + F.size(b)).alias("both")),
        lambda x: F.when(x["both"] == 0, F.lit(1.0)).otherwise(x["common"] / (x["both"] - x["common"])),
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(doc_id, marks): for each row the chosen marks as (position, hash)."""
    chosen = marks(F.coalesce("text", F.lit("")), k, w)
    return only(docs, doc_id=doc_id, text=text).select(
        "doc_id",
        F.transform(chosen, lambda m: F.struct(position_of(m).alias("position"), hash_of(m).alias("hash"))).alias("marks"),
    )


def _below(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, found in two steps of about the square root of them."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    block = F.size(F.filter(heads, lambda b: b < value))
    inside = F.element_at(F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks]), F.greatest(block, F.lit(1)))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + F.size(F.filter(inside, lambda b: b < value)))


def _ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (doc_id, text) with ``range`` and ``extra``: each range has the first row of the range below as well.

    The driver holds at most one identifier a range.
    """
    points = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("doc_id", points, 10 * ranges).alias("cuts")).first() if points else None
    bounds = sorted(set(found["cuts"] or [])) if found else []
    placed = rows.withColumn("range", F.coalesce(_below(bounds, F.col("doc_id")), F.lit(-1)))
    tops = {r["range"]: r["top"] for r in placed.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(tops)
    lower = {r: used[i - 1] for i, r in enumerate(used)}  # the lowest range is followed by the highest
    extra = None
    for target, source in lower.items():
        pair = F.struct(F.lit(target).alias("range"), F.lit(source).alias("source"), F.lit(tops[source]).cast("long").alias("top"))
        extra = [pair] if extra is None else [*extra, pair]
    if extra is None:
        return placed.withColumn("extra", F.lit(0))
    wanted = F.filter(F.array(*extra), lambda x: (x["source"] == F.col("range")) & x["top"].eqNullSafe(F.col("doc_id")))
    heads = [t for t in tops.values() if t is not None]
    is_head = F.col("doc_id").isin(heads) | (F.col("doc_id").isNull() if None in tops.values() else F.lit(False))
    borrowed = placed.filter(is_head).select(
        "doc_id", "text", F.explode(F.transform(wanted, lambda x: x["range"])).alias("range"), F.lit(1).alias("extra")
    )
    return placed.select("doc_id", "text", "range", F.lit(0).alias("extra")).union(borrowed)


def compare_with_next(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W, ranges: int | None = None
) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness of the first to the second and to the next one.

    The edited text ends in the first floor(n / 3) code points of the next document's text in place of its own last ones.
    """
    rows = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if ranges is None:
        ranges = min(2000, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = Window.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), "tie")
    met = (
        _ranges(rows, ranges)
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    )
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    kept = F.col("kept")
    shared = met.select(
        "range",
        "extra",
        "doc_id",
        "tie",
        n.alias("n_chars"),
        "text",
        (n - cut).alias("kept"),
        F.substring(F.col("next"), F.lit(1), cut).alias("tail"),
        windows(F.col("text"), k, w).alias("windows"),
    )
    both = shared.select(
        "range",
        "extra",
        "doc_id",
        "tie",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.concat(F.substring(F.col("text"), F.lit(1), kept), "tail"), 256).alias("edited_sha256"),
        F.array_distinct("windows").alias("own"),
        F.when(F.col("extra") == 0, edited_marks(F.col("windows"), kept, F.col("text"), F.col("tail"), k, w)).alias("changed"),
    )
    hashed = both.withColumns({"own_hashes": hashes_of(F.col("own")), "changed_hashes": hashes_of(F.col("changed"))})
    return (
        hashed.withColumn("following", F.lead("own_hashes").over(order))
        .filter("extra = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("own")).alias("fingerprint"),
            as_text(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own_hashes"), F.col("changed_hashes")).alias("near_edited"),
            likeness(F.col("own_hashes"), F.col("following")).alias("near_next"),
        )
    )
