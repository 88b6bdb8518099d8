"""Graphs that are written to the shared folder and read again: statements as text, quads laid out for patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.operators import aggregates as A
from tripleframe.operators import forms
from tripleframe.operators import patterns as P
from tripleframe.queries import iri, once, registry
from tripleframe.queries.graph import CUST, ORDER, documents, num, shop, text
from tripleframe.session import shared_path
from tripleframe.sources import rdf, store

EX = V.EX
add = registry.add
c = F.col


@once
def stored_shop(spark, d):
    """Customers, orders, places and documents as one stored graph."""
    return store.write(shop(spark, d).quads.unionByName(documents(spark, d).quads), shared_path(spark))


@add(f"""
SELECT {CUST} AS c, count(*) AS orders, count(DISTINCT {ORDER}) AS distinct_orders FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_nationkey = 3 GROUP BY 1""")
def constructed_statements_read_back(spark, d):
    """CONSTRUCT output as N-Triples in the shared folder, read and matched again."""
    b = P.bgp(shop(spark, d), [("?o", EX + "placedBy", "?c"), ("?c", EX + "inNation", "?n")])
    made = forms.construct(b, [("?c", EX + "ordered", "?o"), ("?c", EX + "livesIn", "?n")])
    path = shared_path(spark)
    rdf.write_statements(made, path)
    good, _ = rdf.read_quads(spark, path)
    back = P.bgp(good, [("?c", EX + "livesIn", EX + "nation/3"), ("?c", EX + "ordered", "?o")])
    return A.group(back, ["c"], {"orders": A.count_rows(), "distinct_orders": A.count_distinct(c("o"))}).df


@add(f"""
SELECT {CUST} AS x FROM customer WHERE c_nationkey = 3
UNION ALL SELECT {iri('supplier', 's_suppkey')} FROM supplier WHERE s_nationkey = 3""")
def stored_pattern_by_object(spark, d):
    return P.pattern(stored_shop(spark, d), "?x", EX + "inNation", EX + "nation/3").df


@add(f"""
SELECT {CUST} AS c, c_name AS name, round(c_acctbal, 2) AS bal, count(o_orderkey) AS n
FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1, 2, 3""")
def stored_join_by_statistics(spark, d):
    """Order of the joins from the store's statistics: the written order would start with all orders."""
    b = P.bgp(
        stored_shop(spark, d),
        [
            ("?o", EX + "placedBy", "?c"), ("?c", V.RDFS_LABEL, "?name"), ("?c", EX + "balance", "?bal"),
            ("?c", EX + "inNation", "?n"), ("?n", EX + "inRegion", EX + "region/2"),
        ],
    )
    return A.group(b, ["c", "name", "bal"], {"n": A.count_rows()}).df.select("c", text("name"), num("bal"), "n")


@add(f"SELECT {ORDER} AS o, o_orderstatus AS status, round(o_totalprice, 2) AS total, {iri('customer', 'o_custkey')} AS c FROM orders")
def stored_star(spark, d):
    b = P.star(stored_shop(spark, d), "?o", {EX + "status": "?status", EX + "total": "?total", EX + "placedBy": "?c"})
    return b.df.select("o", text("status"), num("total"), "c")


@add("SELECT 'src3' AS source, count(*) AS docs, CAST(sum(n_chars) AS DOUBLE) AS chars FROM documents WHERE source = 'src3'")
def stored_named_graph(spark, d):
    g = EX + "graph/src3"
    b = P.bgp(stored_shop(spark, d), [("?doc", V.RDF_TYPE, EX + "Document"), ("?doc", EX + "length", "?n")], graph=g)
    return A.group(b, [], {"docs": A.count(c("doc")), "chars": A.sum_(c("n"))}).df.select(F.lit("src3").alias("source"), "docs", "chars")


@add("""
SELECT p, count(*) AS rows, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM (
  SELECT 'placedBy' AS p, o_orderkey AS s, o_custkey AS o FROM orders
  UNION ALL SELECT 'inRegion', n_nationkey, n_regionkey FROM nation)
GROUP BY p""")
def stored_statistics(spark, d):
    kept = stored_shop(spark, d).predicates.where(c("p").isin(EX + "placedBy", EX + "inRegion"))
    return kept.select(F.regexp_replace("p", EX, "").alias("p"), "rows", "subjects", "objects")
