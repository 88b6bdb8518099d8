"""Line dedup: an exact set-similarity join over the words of lines; later matches are removed.

A line is the set of its distinct words. A line goes if an earlier one (smaller doc_id, then smaller line number) has the
same set or a Jaccard similarity of ``PERCENT`` or more, whether or not that earlier line goes itself.

Rarity order: words are hashed into a fixed number of counters over the whole corpus; the logarithm of its counter is the
high byte of a word's key. Any order that is the same for all lines is exact, and this one needs a table of fixed size
only, so no join per word. Two lines that are similar share a word among the first n - ceil(n * 0.8) + 1 of each
(prefix), at places that leave enough words for the overlap (position), and have similar sizes (length). A parity bitmap
bounds the difference of the sets as a further filter.

Nothing compares all members of a word's list with each other and emits it:

1. Equal sets are one class, named by its first line.
2. A semi-join of the classes on prefix words keeps the rows that have a partner at all; it returns each row once.
3. Each class meets the first class of its words' lists; verified matches are done.
4. The others meet all earlier classes; the likeliest partner of each is verified first, all others only if it fails.

Verification compares the words, as 64-bit hashes. They are fetched by a second pass that keeps the lines asked for: a
bitmap of fixed size thins them out in place, an equi-join decides. Texts are not shuffled.

Defined results: null or blank text has no lines with words; lines without words are never removed. Rows without doc_id
take no part and lose nothing. Rows that share a doc_id are one document: their lines at one place are not matches of
each other, and the same lines go from all of them. An empty table gives an empty result. Further columns stay as they
are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.llm.common import WHITE, WHITE_RUN, bind, only, words, written

PERCENT = 80
COUNTERS = 1 << 18
FILTER_BITS = 1 << 22


def _shifted_one(by: Column) -> Column:
    """A long with the one bit that the lowest six bits of an int name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), by)


def _dense(spark: SparkSession, values: DataFrame, size: int) -> Column:
    """One array of ``size`` values from a table (place, value), 0 elsewhere, as a scalar subquery."""
    places = spark.range(size).withColumnRenamed("id", "place")
    filled = places.join(values, "place", "left").select("place", F.coalesce("value", F.lit(0)).alias("value"))
    return filled.agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("a")).select("a.value").scalar()


def _counter(h: Column, counters: int) -> Column:
    """The counter of a word by the lowest bits of its hash."""
    return h.bitwiseAND(F.lit(counters - 1).cast("long")).cast("int")


def rarity_levels(texts: DataFrame, counters: int = COUNTERS) -> Column:
    """An array with one level for each counter: four times the binary logarithm of how many words it counted.

    Levels stand in the high byte, where keys have them.
    """
    # Whole texts are cut, line ends as spaces: the empty words between two spaces share a counter, which is as good an order.
    text = F.col("text")
    other = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in WHITE if c not in " \n"])
    cut = F.when(other, words(text)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "))
    place = _counter(F.xxhash64("word"), counters)
    counted = texts.select(F.explode(cut).alias("word")).groupBy(place.alias("place")).agg(F.count("*").alias("n"))
    level = F.shiftleft(F.least(F.floor(4 * F.log2("n")), F.lit(127)).cast("long"), 56)
    return _dense(texts.sparkSession, counted.select("place", level.alias("value")), counters)


def bitmap_of(keys: DataFrame, bits: int = FILTER_BITS) -> Column:
    """A bitmap of fixed size over the hashes in ``keys`` (h); ``in_bitmap`` never misses one of them."""
    place = keys.select(F.col("h").bitwiseAND(F.lit(bits - 1).cast("long")).alias("bit"))
    packed = place.groupBy(F.shiftright("bit", 6).alias("place")).agg(
        F.bit_or(_shifted_one(F.col("bit").cast("int"))).alias("value")
    )
    return _dense(keys.sparkSession, packed, bits // 64)


def in_bitmap(bitmap: Column, h: Column, bits: int = FILTER_BITS) -> Column:
    bit = h.bitwiseAND(F.lit(bits - 1).cast("long"))
    word = F.get(bitmap, F.shiftright(bit, 6).cast("int"))
    return word.bitwiseAND(_shifted_one(bit.cast("int"))) != 0


def _lines(texts: DataFrame) -> DataFrame:
    """(doc_id, line, content) of all lines."""
    return texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))


def _word_hashes(content: Column) -> Column:
    """Distinct 64-bit hashes of the words of a line; empty words between two spaces leave by their hash."""
    other = reduce(lambda a, b: a | b, [F.contains(content, F.lit(c)) for c in WHITE if c not in " \n"])
    cut = F.when(other, F.split(content, WHITE_RUN)).otherwise(F.split(content, " "))
    return F.array_remove(F.array_distinct(F.transform(cut, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _described(texts: DataFrame, levels: Column, percent: int, counters: int) -> DataFrame:
    """(doc_id, line, k, n, sig, prefix) of all lines with words: class, size, parity bitmap, keys of the prefix."""

    def key(h: Column) -> Column:
        # without nulls the keys are sorted as plain longs
        level = F.coalesce(F.get(F.col("levels"), _counter(h, counters)), F.lit(0).cast("long"))
        return level.bitwiseOR(F.shiftrightunsigned(h, 8))

    # the optimiser puts the subquery into the expression that uses it, so the array is not copied into rows
    worded = _lines(texts).filter(F.length(F.btrim("content", F.lit(WHITE))) > 0).withColumn("levels", levels)
    # Columns that are used several times stay projections of their own, each of which is compiled.
    hashed = worded.select("doc_id", "line", "levels", _word_hashes(F.col("content")).alias("hashes"))
    keyed = hashed.select("doc_id", "line", F.sort_array(F.transform("hashes", key)).alias("keys"))
    n = F.size("keys")
    parity = F.aggregate("keys", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(_shifted_one(_counter(x, 64))))
    length = n - F.ceil(n * percent / 100).cast("int") + 1
    return keyed.select(
        "doc_id", "line", F.xxhash64("keys").alias("k"), n.alias("n"), parity.alias("sig"), F.slice("keys", F.lit(1), length).alias("prefix")
    )


def _may_match(x: str, y: str, percent: int, bitmaps: list[str]) -> Column:
    """Length, positional and bitmap filter on rows with size (n), place in the prefix (pos) and parity bitmaps."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    room = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & ((100 + percent) * room >= percent * (n + m))
        & ((100 + percent) * _differing(x, y, bitmaps) <= (100 - percent) * (n + m))
    )


def _differing(x: str, y: str, bitmaps: list[str]) -> Column:
    """A lower bound of how many words only one of two lines has."""
    return sum(F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in bitmaps)


WIDE_BITMAP = ["s0", "s1", "s2", "s3"]


def _wide_bitmap(items: Column) -> list[Column]:
    """A parity bitmap of 256 bits in four longs."""

    def quarter(i: int) -> Column:
        return F.aggregate(
            items,
            F.lit(0).cast("long"),
            lambda acc, x: F.when(
                F.shiftright(x, 6).bitwiseAND(F.lit(3).cast("long")) == i, acc.bitwiseXOR(_shifted_one(F.hash(x)))
            ).otherwise(acc),
        )

    return [quarter(i).alias(name) for i, name in enumerate(WIDE_BITMAP)]


def _verified(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """(k) of the later classes of the pairs (x, y) whose words are similar enough."""
    left = contents.select(F.col("k").alias("x"), F.col("items").alias("x_items"))
    right = contents.select(F.col("k").alias("y"), F.col("items").alias("y_items"))
    both = pairs.select("x", "y").join(right, "y").join(left, "x")
    common = F.size(F.array_intersect("x_items", "y_items"))
    enough = (100 + percent) * common >= percent * (F.size("x_items") + F.size("y_items"))
    return both.filter(enough).select(F.col("y").alias("k")).distinct()


def removed_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, counters: int = COUNTERS
) -> DataFrame:
    """(doc_id, removed): the sorted numbers, from 0, of the lines that go, for documents that lose any."""
    texts = only(docs, doc_id=doc_id, text=text).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = written(_described(texts, rarity_levels(texts, counters), percent, counters))
    # equal sets have the same size, bitmap and prefix, so any line of a class gives them
    same = [F.first(name).alias(name) for name in ("n", "sig", "prefix")]
    classes = written(
        lines.groupBy("k").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("times"), *same)
    )

    # sets of up to three words are similar to equal sets only
    firsts = classes.select("k", "first.doc_id", "first.line")
    prefixes = classes.filter("n > 3")
    # columns in the order of the table: no projection, so that both sides of the self-join read the same shuffle
    listed = prefixes.select("k", "n", "sig", F.posexplode("prefix").alias("pos", "word"))
    x, y = listed.alias("x"), listed.alias("y")
    partnered = (F.col("x.word") == F.col("y.word")) & (F.col("x.k") != F.col("y.k")) & _may_match("x", "y", percent, ["sig"])
    met = written(x.join(y, partnered, "left_semi"))

    asked = written(firsts.join(met.select("k").distinct(), "k", "left_semi"))
    place = F.xxhash64("doc_id", "line")
    sought = bitmap_of(asked.select(place.alias("h")))
    contents = written(
        _lines(texts)
        .filter(in_bitmap(sought, place))
        .join(asked, ["doc_id", "line"])
        .select("k", "doc_id", "line", _word_hashes(F.col("content")).alias("items"))
    )
    wide = contents.select("k", "doc_id", "line", *_wide_bitmap(F.col("items")))
    rows = written(met.drop("sig").join(wide, "k"))

    together = F.col("x.word") == F.col("y.word")
    alike = _may_match("x", "y", percent, WIDE_BITMAP)
    order = ["doc_id", "line", "k", "n", "pos", *WIDE_BITMAP]
    earliest = rows.groupBy("word").agg(F.min(F.struct(*order)).alias("f")).select("word", "f.*")
    first_pairs = (
        rows.alias("y")
        .join(earliest.alias("x"), together & (F.col("x.k") != F.col("y.k")) & alike)
        .select(F.col("x.k").alias("x"), F.col("y.k").alias("y"))
        .distinct()
    )
    done = written(_verified(first_pairs, contents, percent))

    before = (F.col("x.doc_id") < F.col("y.doc_id")) | (
        (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.line") < F.col("y.line"))
    )
    distance = _differing("x", "y", WIDE_BITMAP) / (F.col("x.n") + F.col("y.n"))
    other_pairs = written(
        rows.join(done, "k", "left_anti")
        .alias("y")
        .join(rows.alias("x"), together & before & alike)
        .select(F.col("x.k").alias("x"), F.col("y.k").alias("y"), distance.alias("distance"))
        .distinct()
    )
    likeliest = other_pairs.groupBy("y").agg(F.min_by("x", "distance").alias("x"))
    done = written(done.union(_verified(likeliest, contents, percent)))
    other_pairs = other_pairs.join(done.select(F.col("k").alias("y")), "y", "left_anti")
    similar = done.union(_verified(other_pairs, contents, percent)).withColumn("similar", F.lit(True))

    losing = classes.select("k", "first", "times").join(similar, "k", "left").filter((F.col("times") > 1) | F.col("similar").isNotNull())
    gone = lines.select("doc_id", "line", "k").join(losing, "k").filter(
        F.col("similar").isNotNull() | (F.col("doc_id") != F.col("first.doc_id")) | (F.col("line") != F.col("first.line"))
    )
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def without(text: Column, removed: Column) -> Column:
    """The text without the lines of the given numbers."""

    def rebuilt(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return bind(F.split(text, "\n"), rebuilt)


def dedupe_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the later matches taken out of ``text``; all rows and columns stay."""
    removed = removed_lines(docs, doc_id, text, percent).select(
        F.col("doc_id").alias("__doc_id"), F.col("removed").alias("__removed")
    )
    joined = docs.join(removed, docs[doc_id] == F.col("__doc_id"), "left")
    cleaned = F.when(F.col("__removed").isNull(), F.col(text)).otherwise(without(F.col(text), F.col("__removed")))
    return joined.select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns])
