"""Map relational rows to quads without copying them.

Every property becomes one branch of a union whose predicate is a constant. A pattern with a
constant predicate then folds all other branches away, so it reads a single table and only the
columns of that property.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.sources import mapped as M


def entity(kind: str, *keys: str | Column) -> Column:
    """IRI of a row: ``http://example.org/<kind>/<key>[/<key>…]``."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit("/"), c.cast("string")]
    return F.concat(F.lit(V.EX + kind), *parts)


def triples(
    table: DataFrame, subject: Column, properties: dict[str, Column], graph: Column | None = None
) -> DataFrame:
    """Rows to quads, one branch per property; rows without a value give no triple."""
    g = F.lit(None).cast("string") if graph is None else graph
    branches = [
        table.select(g.alias("g"), subject.alias("s"), F.lit(p).alias("p"), o.alias("o")).where(
            F.col("o").isNotNull()
        )
        for p, o in properties.items()
    ]
    return reduce(DataFrame.unionByName, branches)


def melted_triples(
    table: DataFrame, subject: Column, properties: dict[str, Column], graph: Column | None = None
) -> DataFrame:
    """The same quads in a single pass over the table; for patterns with a variable predicate."""
    g = F.lit(None).cast("string") if graph is None else graph
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in properties.items()])
    rows = table.select(g.alias("g"), subject.alias("s"), F.explode(pairs).alias("x"))
    return rows.select("g", "s", "x.p", "x.o").where(F.col("o").isNotNull())


def shop_properties() -> dict[str, tuple[M.Term, dict[str, M.Term]]]:
    """Table name to (subject, properties) of the order-and-parts tables."""

    def kind(name: str) -> M.Term:
        return M.constant(V.EX + name)

    return {
        "region": (
            M.entity("region", "r_regionkey"),
            {V.RDF_TYPE: kind("Region"), V.RDFS_LABEL: M.text("r_name")},
        ),
        "nation": (
            M.entity("nation", "n_nationkey"),
            {
                V.RDF_TYPE: kind("Nation"),
                V.RDFS_LABEL: M.text("n_name"),
                V.EX + "inRegion": M.entity("region", "n_regionkey"),
            },
        ),
        "customer": (
            M.entity("customer", "c_custkey"),
            {
                V.RDF_TYPE: kind("Customer"),
                V.RDFS_LABEL: M.text("c_name"),
                V.EX + "inNation": M.entity("nation", "c_nationkey"),
                V.EX + "balance": M.double("c_acctbal"),
                V.EX + "segment": M.text("c_mktsegment", "en"),
            },
        ),
        "supplier": (
            M.entity("supplier", "s_suppkey"),
            {
                V.RDF_TYPE: kind("Supplier"),
                V.RDFS_LABEL: M.text("s_name"),
                V.EX + "inNation": M.entity("nation", "s_nationkey"),
                V.EX + "balance": M.double("s_acctbal"),
            },
        ),
        "part": (
            M.entity("part", "p_partkey"),
            {
                V.RDF_TYPE: kind("Part"),
                V.RDFS_LABEL: M.text("p_name"),
                V.EX + "brand": M.text("p_brand"),
                V.EX + "size": M.integer("p_size"),
                V.EX + "price": M.double("p_retailprice"),
            },
        ),
        "orders": (
            M.entity("order", "o_orderkey"),
            {
                V.RDF_TYPE: kind("Order"),
                V.EX + "placedBy": M.entity("customer", "o_custkey"),
                V.EX + "status": M.text("o_orderstatus"),
                V.EX + "total": M.double("o_totalprice"),
                V.EX + "placedOn": M.moment("o_orderdate"),
            },
        ),
    }


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def shop_graph(spark: SparkSession, folder: str) -> M.MappedGraph:
    """Customers, orders, parts and places as a default graph."""
    specs = shop_properties()
    tables = read_tables(spark, folder, *specs)
    return M.MappedGraph([x for n, (s, props) in specs.items() for x in M.branches(tables[n], s, props)])


def melted_shop_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The same graph with one pass over each table."""
    specs = shop_properties()
    tables = read_tables(spark, folder, *specs)
    parts = [
        melted_triples(tables[n], s.column, {p: o.column for p, o in props.items()}) for n, (s, props) in specs.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def contains_graph(spark: SparkSession, folder: str) -> DataFrame:
    """``order hasPart part`` edges of the line items; a graph is a set, so pairs appear once."""
    lines = read_tables(spark, folder, "lineitem")["lineitem"]
    pairs = lines.select("l_orderkey", "l_partkey").distinct()
    return triples(
        pairs, entity("order", "l_orderkey"), {V.EX + "hasPart": entity("part", "l_partkey")}
    )


def document_graph(spark: SparkSession, folder: str) -> M.MappedGraph:
    """Documents with a language-tagged title text, one named graph per source."""
    docs = read_tables(spark, folder, "documents")["documents"]
    properties = {
        V.RDF_TYPE: M.constant(V.EX + "Document"),
        V.DEFAULT_PREFIXES["dct"] + "title": M.opaque(t.lang_term(F.col("text"), F.col("lang"))),
        V.EX + "length": M.integer("n_chars"),
    }
    return M.MappedGraph(M.branches(docs, M.entity("doc", "doc_id"), properties, graph=M.entity("graph", "source")))


def reply_graph(spark: SparkSession, folder: str) -> DataFrame:
    """``turn repliesTo previous turn`` edges of the conversations: chains without cycles."""
    turns = read_tables(spark, folder, "conversations")["conversations"]
    return triples(
        turns.where(F.col("turn") > 0),
        entity("turn", "conv_id", "turn"),
        {V.EX + "repliesTo": entity("turn", F.col("conv_id"), F.col("turn") - 1)},
    )


def event_graph(spark: SparkSession, folder: str) -> DataFrame:
    """``user acts type`` edges and the value of each event."""
    events = read_tables(spark, folder, "events")["events"]
    return triples(
        events,
        entity("event", "event_id"),
        {
            V.EX + "by": entity("user", "user_id"),
            V.EX + "kind": t.string_term(F.col("event_type")),
            V.EX + "value": t.double_term(F.col("value")),
            V.EX + "at": t.datetime_term(F.col("ts")),
        },
    )
