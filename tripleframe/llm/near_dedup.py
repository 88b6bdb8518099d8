"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct runs of five words (A-Z lower-cased). Its signature takes two permutations only:
the first places every run in a circle of slots, the second, shifted by k places, ranks the slots for coordinate k. The
coordinates are cut into bands; documents that share a band meet.

Nothing compares all members of a bucket:

1. Documents with equal sets form one class with a number of its own; from here on only one text of a class is handled.
2. Runs that no other of the remaining documents has cannot be common to a pair. Counting them once per document bounds
   the overlap of every pair from above, exactly, and drops most of the near misses of large groups.
3. Every member of a bucket is compared with the smallest class of the bucket. Exact links give components.
4. Members of buckets that still have several components are dealt into narrower buckets by two neighbouring bands, and
   meet the smallest class there. That links large groups of near copies without meeting all their pairs.
5. What is left of a bucket are members outside the component of its smallest class. Only these meet the other members of
   the bucket, and only across components: a link inside a component would change nothing. Parity bitmaps of the sets
   bound the difference of a pair from below, exactly, so that near misses are not emitted.

So each pair that shares a band is verified on full sets or already connected. With 24 bands of 5 a pair at a
similarity of 0.85 shares none with probability 8e-7.

Defined results: null text or text without words has an empty set, is linked with nothing and is its own component.
Fewer than five words: the whole sequence is the one run. Rows without doc_id are linked with nothing, have no component
and are kept. Rows that repeat a doc_id are judged by their own text: classes, sets and links go by the 128-bit digest of
the set, and a component has the smallest doc_id of its rows. ``near_duplicates`` keeps every row of that doc_id in the
component; ``keep_one`` keeps one row, the one whose text has the smallest hash, and of equal rows any. An empty table
gives an empty result. Other columns of the input take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.llm import arrow_text as at
from tripleframe.llm.common import only, written
from tripleframe.session import cut_lineage

WIDTH = 5
BANDS = 24
ROWS = 5
PERCENT = 85
SLOT_BITS = 20
PARITY_BITS = 1024


@lru_cache(maxsize=1)
def _circle(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The placing permutation, and all windows of ``size`` ranks along the circle of the ranking permutation."""
    slots = 1 << SLOT_BITS
    place = np.argsort(at.numbers(slots, 31)).astype(np.int64)
    rank = np.argsort(at.numbers(slots, 37)).astype(np.uint32)
    return place, np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: size - 1]]), size)


def signature(hashes: np.ndarray, size: int, block: int = 4096) -> np.ndarray:
    """Coordinate k is the smallest rank, k places on, of the slots of all elements."""
    place, windows = _circle(size)
    slots = place[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    least = np.full(size, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(slots), block):
        np.minimum(least, windows[slots[i : i + block]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the number of the band is part of it."""
    factors = at.numbers(bands * rows, 41).reshape(bands, rows) | np.uint64(1)
    with np.errstate(over="ignore"):
        summed = (least.astype(np.uint64).reshape(bands, rows) * factors).sum(axis=1, dtype=np.uint64)
        return at.mix(summed + at.numbers(bands, 43)).view(np.int64)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text."""
    for first_row, last_row, raw, ends in at.chunks(column):
        begin, end, first = at.word_spans(raw, ends)
        hashes, starts = at.shingle_hashes(at.word_hashes(raw, begin, end, at.FOLDED_VALUES), first, width)
        for i in range(last_row - first_row):
            yield np.unique(hashes[starts[i] : starts[i + 1]])


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for hashes in _sets(batch.column("text"), width):
                sizes.append(len(hashes))
                if len(hashes):
                    digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(signature(hashes, bands * rows), bands, rows))
                else:
                    digests.append(None)
                    keys.append(np.zeros(0, dtype=np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, held, size = 0, [], 0
            for hashes in _sets(batch.column("text"), width):
                held.append(hashes)
                size += len(hashes)
                if size > 1 << 20:
                    yield _set_batch(batch.column("id").slice(row, len(held)), held)
                    row, held, size = row + len(held), [], 0
            if held:
                yield _set_batch(batch.column("id").slice(row, len(held)), held)

    return run


def parity(hashes: np.ndarray) -> np.ndarray:
    """``PARITY_BITS`` bits in longs: whether an odd number of elements fall on each. Sets differ by as many at least."""
    places = (hashes >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=PARITY_BITS).astype(np.uint8) & 1).view(np.int64)


def _set_batch(ids: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
    bits = np.arange(len(held) + 1, dtype=np.int32) * (PARITY_BITS // 64)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).view(np.int64))),
            pa.ListArray.from_arrays(pa.array(bits), pa.array(np.concatenate([parity(x) for x in held]))),
        ],
        names=["id", "items", "bits"],
    )


def _may_link(n: Column, shared: Column, other_n: Column, other_shared: Column, percent: int) -> Column:
    """Necessary for a link: two sets have no more in common than either shares with any other document."""
    most = F.least(shared, other_shared)
    return (100 + percent) * most >= percent * (n + other_n)


def _near(n: Column, bits: Column, other_n: Column, other_bits: Column, percent: int) -> Column:
    """Necessary for a link: two sets differ at least by the bits that differ."""
    differing = sum(
        F.bit_count(F.get(bits, F.lit(i)).bitwiseXOR(F.get(other_bits, F.lit(i)))) for i in range(PARITY_BITS // 64)
    )
    return (100 + percent) * differing <= (100 - percent) * (n + other_n)


def _own_items(sets: DataFrame) -> DataFrame:
    """(id, own): how many items of a document occur in no other of these documents."""
    return (
        sets.select("id", F.explode("items").alias("item"))
        .groupBy("item")
        .agg(F.count("*").alias("times"), F.min("id").alias("id"))
        .filter("times = 1")
        .groupBy("id")
        .agg(F.count("*").alias("own"))
    )


def _foreign_items(sets: DataFrame, named: DataFrame) -> DataFrame:
    """(id, foreign): how many items of a document occur in a document of another component.

    ``named`` has (id, component). Items of one component are counted as such before they meet the documents again, and
    only documents that still look for a link are asked about.
    """
    held = sets.join(named, "id").select("id", "component", "seeking", F.explode("items").alias("item"))
    shared = (
        held.groupBy("item")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("item")
    )
    return held.filter("seeking").join(shared, "item").groupBy("id").agg(F.count("*").alias("foreign"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("b_items"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("a_items", "b_items"))
    union = F.size("a_items") + F.size("b_items") - common
    return both.filter(100 * common >= percent * union).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id: smallest label of the neighbours, then the label's label, until stable."""
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select(
            "id", F.least("component", "near").alias("to"), F.col("component").alias("was")
        )
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("next"))
        moved = cut_lineage(lower.join(jump, "to").select("id", F.least("to", "next").alias("component"), "was"))
        labels = moved.select("id", "component")
        if moved.filter("component <> was").isEmpty():
            return labels


def _with_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (id, head_id, ...) with the component of either; what has no link yet is its own."""
    of_head = labels.select(F.col("id").alias("head_id"), F.col("component").alias("head_component"))
    named = members.join(labels, "id", "left").join(of_head, "head_id", "left")
    return named.withColumns(
        {"component": F.coalesce("component", "id"), "head_component": F.coalesce("head_component", "head_id")}
    )


def _narrow_pairs(named: DataFrame, bands: int, percent: int) -> DataFrame:
    """(a, b): each member of a bucket of two neighbouring bands with the smallest one there, if their components differ."""
    of_two = F.array(*[F.xxhash64(F.get("bands", F.lit(i)), F.get("bands", F.lit((i + 1) % bands))) for i in range(bands)])
    members = named.dropDuplicates(["id"]).select("id", "component", "n", "bits", F.explode(of_two).alias("two"))
    heads = members.groupBy("two").agg(F.min(F.struct("id", "component", "n", "bits")).alias("head"))
    met = members.join(heads, "two").filter(
        (F.col("component") != F.col("head.component"))
        & _near(F.col("n"), F.col("bits"), F.col("head.n"), F.col("head.bits"), percent)
    )
    return met.select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct()


def _class_texts(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, text): one text of each class. Only classes of several rows can match a text twice, and only they are grouped."""
    named = texts.join(classes.select("doc_id", "text_hash", "id", "several"), ["doc_id", "text_hash"])
    folded = named.filter("several").groupBy("id").agg(F.first("text").alias("text"))
    return named.filter("NOT several").select("id", "text").union(folded)


def judged(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, group), one row for each row of ``docs``.

    ``group`` numbers components; it is null, as component_id may be, where a row is linked with nothing by definition.
    """
    texts = only(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    sketches = written(
        texts.mapInArrow(
            _sketches(width, bands, rows), "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>"
        )
    )
    known = sketches.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = written(
        known.groupBy("digest")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min_by(F.struct("text_hash", "bands"), "doc_id").alias("of_first"),
            F.first("n_shingles").alias("n"),
            (F.count("*") > 1).alias("several"),
        )
        .select(
            F.monotonically_increasing_id().alias("id"), "digest", "doc_id", "of_first.text_hash", "of_first.bands", "n", "several"
        )
    )
    members = classes.select("id", "n", F.explode("bands").alias("key"))
    crowded = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    met = written(members.join(crowded, "key").select("key", "id", "n"))
    sets = written(
        _class_texts(texts, classes.join(met.select("id").distinct(), "id", "left_semi")).mapInArrow(
            _full_sets(width), "id long, items array<long>, bits array<long>"
        )
    )
    live = (
        met.join(_own_items(sets), "id", "left")
        .select("key", "id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))
        .filter(100 * F.col("shared") >= percent * F.col("n"))
    )
    live = written(live)
    heads = live.groupBy("key").agg(
        F.min("id").alias("head_id"),
        F.min_by("n", "id").alias("head_n"),
        F.min_by("shared", "id").alias("head_shared"),
        F.count("*").alias("size"),
    )
    buckets = live.join(heads.filter("size > 1"), "key").filter("id <> head_id")
    first_pairs = (
        buckets.filter(_may_link(F.col("n"), F.col("shared"), F.col("head_n"), F.col("head_shared"), percent))
        .select(F.col("head_id").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    first_links = written(verified(first_pairs, sets, percent))
    labels = components(first_links)

    several = _with_components(buckets.filter("size > 2").select("key", "id", "head_id", "n", "shared"), labels)
    unsettled = several.filter("component <> head_component").select("key").distinct()
    named = written(
        several.join(unsettled, "key", "left_semi")
        .drop("component", "head_component")
        .join(classes.select("id", "bands"), "id")
        .join(sets.select("id", "bits"), "id")
    )
    first_links = written(first_links.union(verified(_narrow_pairs(_with_components(named, labels), bands, percent), sets, percent)))
    labels = components(first_links)

    named = written(_with_components(named, labels))
    who = named.groupBy("id", "component").agg(F.max(F.col("component") != F.col("head_component")).alias("seeking"))
    foreign = _foreign_items(sets, who)
    apart = (
        named.filter("component <> head_component")
        .join(foreign, "id")
        .withColumn("shared", F.least("shared", "foreign"))
        .filter(100 * F.col("shared") >= percent * F.col("n"))
    )
    x, y = apart.alias("x"), named.alias("y")
    across = (
        x.join(
            y,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.component") != F.col("y.component"))
            & _may_link(F.col("x.n"), F.col("x.shared"), F.col("y.n"), F.col("y.shared"), percent)
            & _near(F.col("x.n"), F.col("x.bits"), F.col("y.n"), F.col("y.bits"), percent)
            & (F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.key")),
        )
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
    )
    links = written(first_links.union(verified(across, sets, percent)))
    labels = components(links)

    first = classes.join(labels, "id").groupBy("component").agg(F.min("doc_id").alias("first"))
    linked = labels.join(first, "component")
    of_class = classes.join(linked, "id", "left").select(
        "digest", F.coalesce("component", "id").alias("group"), F.coalesce("first", "doc_id").alias("first")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return sketches.join(of_class, "digest", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"),
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return judged(docs, doc_id, text, width, bands, rows, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
    percent: int = PERCENT,
) -> DataFrame:
    """The rows of ``docs`` without all but one row of each component, with all their columns.

    Decisions go by identifier and hash of the text, so rows that repeat an identifier keep their own fate.
    """
    found = judged(docs, doc_id, text, width, bands, rows, percent).filter("group IS NOT NULL")
    counted = written(found.groupBy("group", "component_id", "doc_id", "text_hash").agg(F.count("*").alias("times")))
    firsts = counted.filter("doc_id = component_id")
    top = firsts.groupBy("group").agg(F.min("text_hash").alias("top"))
    last = firsts.join(top, "group").filter("text_hash = top")
    goes = counted.select("group", "doc_id", "text_hash").subtract(last.select("group", "doc_id", "text_hash"))
    again = written(last.filter("times > 1").select("doc_id", "text_hash"))

    def met(keys: DataFrame):
        return (docs[doc_id].cast("long") == keys["__near_id"]) & (F.xxhash64(docs[text]) == keys["__near_hash"])

    again = again.select(F.col("doc_id").alias("__near_id"), F.col("text_hash").alias("__near_hash"))
    out = goes.select(F.col("doc_id").alias("__near_id"), F.col("text_hash").alias("__near_hash")).union(again)
    once = docs.join(out, met(out), "left_anti")
    repeated = docs.join(again, met(again)).dropDuplicates(["__near_id", "__near_hash"]).drop("__near_id", "__near_hash")
    return once.union(repeated)
