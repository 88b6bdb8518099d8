"""Mixing sources to target weights.

Words are summed per source, each source gets a target, and target / size is its repetition rate. A document is emitted
floor(rate) times, plus once more when its hash falls below the fraction of the rate.

Targets share the whole amount by weight. A source may be repeated ``MAX_RATE`` times at most; what is above that is
shared again among the others by weight until no source is above. That fixed point is min(cap, level * weight) with one
level for all, found in one pass over the sources in order of cap / weight.

The text is read once: document sizes are written, then summed (partial sums come before the shuffle, so a source with a
third of all rows is one row per task). Sources meet documents in a join on source and a salt, so a hot source is spread
over ``SALTS`` keys; the one-row-per-source table is the only thing that is ordered in one task.

Defined results: null text has size 0. A null source is a source of its own, ordered last. Null doc_id hashes like any
other value. Equal rows share their fate, since the draw depends on doc_id and the seed only. A source without words has
rate 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleframe.llm.common import count_words, only
from tripleframe.session import cut_lineage

MAX_RATE = 3.0
WEIGHTS = (1, 2, 3)
SALTS = 16
SEED = 7


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) of a table (source, size)."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    weighted = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_rate))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    full = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = (
        weighted.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(full) - F.col("spent")) / F.col("left"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("first", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(full))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("first")["level"], F.lit(0.0)) * F.col("weight"))
    return levelled.select(
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        target.cast("double").alias("target"),
        F.coalesce(target / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("rate"),
    )


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the identifier and the seed only."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def repetitions(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_rate: float = MAX_RATE,
    seed: int = SEED,
    salts: int = SALTS,
) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies), one row for each row of ``docs``."""
    sizes = cut_lineage(
        only(docs, doc_id=doc_id, source=source, text=text).select("doc_id", "source", count_words(F.col("text")).alias("size"))
    )
    rates = source_targets(sizes, weights, max_rate).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))
    )
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    joined = salted.alias("d").join(
        rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.salt") == F.col("r.salt"))
    )
    rate = F.col("r.rate")
    copies = F.floor(rate) + (draw(F.col("d.doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("d.size").alias("size"),
        F.col("r.source_size").alias("source_size"),
        F.col("r.target").alias("target"),
        rate.alias("rate"),
        copies.cast("long").alias("copies"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as its source's rate asks for.

    Texts are not shuffled: only (source, rate), one row per source and salt, meets the documents.
    """
    sizes = cut_lineage(only(docs, source=source, text=text).select("source", count_words(F.col("text")).alias("size")))
    salts = options.get("salts", SALTS)
    rates = source_targets(
        sizes, options.get("weights", WEIGHTS), options.get("max_rate", MAX_RATE)
    ).select(
        F.col("source").alias("__source"),
        F.col("rate").alias("__rate"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("__salt"),
    )
    salted = docs.withColumn("__salt_of", F.pmod(F.xxhash64(docs[doc_id]), F.lit(salts)))
    joined = salted.join(rates, salted[source].eqNullSafe(F.col("__source")) & (F.col("__salt_of") == F.col("__salt")))
    rate = F.col("__rate")
    copies = F.floor(rate) + (draw(F.col(doc_id), options.get("seed", SEED)) < rate - F.floor(rate)).cast("long")
    again = F.explode(F.array_repeat(F.lit(True), copies.cast("int")))
    return joined.select(*[F.col(c) for c in docs.columns], again.alias("__again")).drop("__again")
