"""Quads stored for pattern scans, with the statistics that order joins.

Layout of a store, a folder of three Parquet tables:

* ``by_subject`` lies in a fixed number of folders by the hash of the predicate, in files ranged by (predicate, subject). A constant
  predicate prunes folders, a constant subject row groups; a predicate that holds most rows spreads over many files.
* ``by_object`` holds the same rows ranged by (predicate, object) for constant objects. It is optional.
* ``predicates`` has one row for each predicate: rows, distinct subjects, distinct objects, whether ``g`` occurs.

The number of folders does not grow with the number of predicates, and no file name holds an IRI.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = 32
# Bytes of a range, and of a range of a graph that is too small to keep all cores busy otherwise.
RANGE_BYTES = 64 << 20
SMALL_RANGE_BYTES = 4 << 20
# Objects beyond are laid in ranges of their own; characters of an object that ranges are cut by.
LONG_BYTES = 1024
PREFIX = 64
_COLUMNS = ["g", "s", "p", "o"]


def _folder(predicate: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(predicate), F.lit(folders)).cast("int")


class StoredGraph:
    """A store that was written; patterns read only the folders and row groups their constants allow."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.sparkSession = spark
        self.path = path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.folders, self.with_objects = about["folders"], about["with_objects"]

    @property
    def quads(self) -> DataFrame:
        return self._table("by_subject").select(*_COLUMNS)

    @property
    def predicates(self) -> DataFrame:
        return self.sparkSession.read.parquet(f"{self.path}/predicates")

    def _table(self, name: str) -> DataFrame:
        return self.sparkSession.read.schema("g string, s string, p string, o string, folder int").parquet(f"{self.path}/{name}")

    def narrowed(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
        """Quads among which all matches of the constants are, from the copy that is clustered for them."""
        df = self._table("by_object" if o is not None and s is None and self.with_objects else "by_subject")
        if p is not None:
            df = df.where(F.col("folder") == _folder(F.lit(p), self.folders)).where(F.col("p") == p)
        for column, asked in (("s", s), ("o", o), ("g", g)):
            df = df if asked is None else df.where(F.col(column) == asked)
        return df.select(*_COLUMNS)

    def statistics(self, predicates: Iterable[str]) -> dict[str, tuple[int, int, int]]:
        """(rows, distinct subjects, distinct objects) of the predicates asked for; a query names few."""
        asked = sorted(set(predicates))
        rows = self.predicates.where(F.col("p").isin(asked)).collect() if asked else []
        found = {r["p"]: (r["rows"], r["subjects"], r["objects"]) for r in rows}
        return {p: found.get(p, (0, 0, 0)) for p in asked}


def _parts(size: int, cores: int) -> int:
    """Ranges for so many bytes: a range is sorted in memory, so its size is fixed and their number grows."""
    return max(-(-size // RANGE_BYTES), min(cores, -(-size // SMALL_RANGE_BYTES)), 1)


def write(quads: DataFrame, path: str, by_object: bool = True, folders: int = FOLDERS) -> StoredGraph:
    """Store ``(g, s, p, o)`` as a set under ``path`` and open it.

    Ranges have about equal numbers of rows, so rows with long objects get ranges of their own, and the number of ranges
    follows the bytes. The ranges of a subject go on by object and those of an object by subject: neither a hub nor the
    object of most rows is one task. Equal rows lie in one range and are folded there.

    ``about`` is written last: a folder without it is no store, so a reader never opens half of one.
    """
    spark, path = quads.sparkSession, path.rstrip("/")
    cores = spark.sparkContext.defaultParallelism
    rows = quads.select(*_COLUMNS).withColumn("folder", _folder(F.col("p"), folders))
    long = F.coalesce(F.octet_length("o") > LONG_BYTES, F.lit(False))
    size = F.lit(64) + reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(x), F.lit(0)) for x in _COLUMNS])
    sizes = {r["long"]: r["size"] for r in rows.groupBy(long.alias("long")).agg(F.sum(size).alias("size")).collect()}

    def lay(df: DataFrame, name: str, second: str, then: Column, fold: bool) -> None:
        # An empty graph is written as well, so that its tables exist.
        for kind in sizes or {False: 0}:
            part = df.where(long) if kind else df.where(~long)
            start = F.substring(second, 1, PREFIX) if second == "o" else F.col(second)
            ranged = part.withColumns({"__start": start, "__then": then}).repartitionByRange(
                _parts(sizes.get(kind, 0), cores), "folder", "p", "__start", "__then"
            )
            ranged = (ranged.distinct() if fold else ranged).drop("__start", "__then")
            ranged.sortWithinPartitions("folder", "p", second).write.mode("append").partitionBy("folder").parquet(f"{path}/{name}")

    lay(rows, "by_subject", "s", F.xxhash64("o"), True)
    kept = spark.read.schema("g string, s string, p string, o string, folder int").parquet(f"{path}/by_subject")
    if by_object:
        lay(kept, "by_object", "o", F.xxhash64("s"), False)

    # Statistics only: hashes stand for the terms, so that no text is shuffled or held.
    def ends(of: str, rows_too: bool) -> DataFrame:
        # Distinct ends in two levels: the counts of a predicate with most rows come from many tasks.
        distinct = kept.groupBy(F.xxhash64("p").alias("id"), F.xxhash64(of).alias("x")).agg(F.count("*").alias("n"))
        totals = [F.sum("n").alias("rows")] if rows_too else []
        return distinct.groupBy("id").agg(*totals, F.count("*").alias("subjects" if of == "s" else "objects"))

    names = kept.select("p").distinct().withColumn("id", F.xxhash64("p"))
    stats = names.join(ends("s", True), "id").join(ends("o", False), "id").select("p", "rows", "subjects", "objects")
    stats.write.parquet(f"{path}/predicates")
    about = spark.range(1).select(F.lit(folders).alias("folders"), F.lit(by_object).alias("with_objects"))
    about.coalesce(1).write.parquet(f"{path}/about")
    return StoredGraph(spark, path)
