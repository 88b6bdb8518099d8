"""Patterns, joins, paths, aggregates and query forms over the relational tables read as a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.operators import aggregates as A
from tripleframe.operators import forms, paths
from tripleframe.operators import patterns as P
from tripleframe.operators.bindings import Bindings, values
from tripleframe.queries import iri, once, registry
from tripleframe.sources import relational as R

EX = V.EX
add = registry.add
c = F.col


@once
def shop(spark, d):
    return R.shop_graph(spark, d)


@once
def melted_shop(spark, d):
    return R.melted_shop_graph(spark, d)


documents = once(R.document_graph)
replies_graph = once(R.reply_graph)
contains = once(R.contains_graph)
event_graph = once(R.event_graph)


def num(name, digits=2):
    return F.round(t.num(c(name)), digits).alias(name)


def text(name):
    return t.text(c(name)).alias(name)


ORDER, CUST = iri("order", "o_orderkey"), iri("customer", "c_custkey")
PLACED = iri("customer", "o_custkey")

# ---- scan, projection, filter ---------------------------------------------------------------


@add(f"""
SELECT {CUST} AS x FROM customer WHERE c_nationkey = 3
UNION ALL SELECT {iri('supplier', 's_suppkey')} FROM supplier WHERE s_nationkey = 3""")
def triple_pattern(spark, d):
    return P.pattern(shop(spark, d), "?x", EX + "inNation", EX + "nation/3").df


@add("""
SELECT 'http://example.org/balance' AS p, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL UNION ALL SELECT s_suppkey FROM supplier WHERE s_acctbal IS NOT NULL)
UNION ALL SELECT 'http://example.org/inNation', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'http://example.org/inRegion', count(*) FROM nation
UNION ALL SELECT 'http://example.org/segment', count(*) FROM customer
UNION ALL SELECT 'http://example.org/brand', count(*) FROM part
UNION ALL SELECT 'http://example.org/size', count(*) FROM part
UNION ALL SELECT 'http://example.org/price', count(*) FROM part
UNION ALL SELECT 'http://example.org/' || k, n FROM (SELECT count(*) AS n FROM orders), (VALUES ('placedBy'), ('status'), ('total'), ('placedOn')) AS x(k)
UNION ALL SELECT 'http://www.w3.org/2000/01/rdf-schema#label', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)
UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM orders)""")
def variable_predicate(spark, d):
    b = P.pattern(melted_shop(spark, d), "?s", "?p", "?o")
    return A.group(b, ["p"], {"n": A.count_rows()}).df


@add(f"SELECT {CUST} AS c, round(c_acctbal * 2, 2) AS twice FROM customer")
def project_expression(spark, d):
    b = P.pattern(shop(spark, d), "?c", EX + "balance", "?bal").join(
        P.pattern(shop(spark, d), "?c", V.RDF_TYPE, EX + "Customer")
    )
    b = b.project("c", ("twice", t.multiply(c("bal"), 2)))
    return b.df.select("c", num("twice"))


@add(f"""
SELECT {ORDER} AS o, {PLACED} AS c, {iri('nation', 'c_nationkey')} AS n, n_name AS l
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def select_star(spark, d):
    g = shop(spark, d)
    b = P.bgp(g, [("?o", EX + "placedBy", "?c"), ("?c", EX + "inNation", "?n"), ("?n", V.RDFS_LABEL, "?l")])
    return forms.select(b).df.select("o", "c", "n", text("l"))


@add(f"""
SELECT {CUST} AS s, 'balance' AS p, round(c_acctbal + 1, 2) AS more FROM customer
UNION ALL SELECT {CUST}, 'segment', NULL FROM customer""")
def bind_error_is_unbound(spark, d):
    g = shop(spark, d)
    customers = P.pattern(g, "?s", V.RDF_TYPE, EX + "Customer")
    balance = P.pattern(g, "?s", EX + "balance", "?v").bind("p", F.lit("balance"), certain=True)
    segment = P.pattern(g, "?s", EX + "segment", "?v").bind("p", F.lit("segment"), certain=True)
    b = balance.union(segment).join(customers).bind("more", t.add(c("v"), 1))
    return b.df.select("s", "p", num("more"))


@add(f"SELECT {ORDER} AS o FROM orders WHERE o_totalprice > 400000 AND o_orderstatus <> 'O'")
def filter_conditions(spark, d):
    g = shop(spark, d)
    b = P.bgp(g, [("?o", EX + "total", "?t"), ("?o", EX + "status", "?st")])
    return b.filter(t.and_(t.gt(c("t"), 400000), t.ne(c("st"), "O"))).project("o").df


@add(f"SELECT {CUST} AS c, c_mktsegment AS seg FROM customer WHERE c_acctbal > 5000 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def nested_group(spark, d):
    g = shop(spark, d)
    inner = P.bgp(g, [("?c", EX + "inNation", "?n"), ("?n", EX + "inRegion", EX + "region/1")])
    rich = P.bgp(g, [("?c", EX + "segment", "?seg"), ("?c", EX + "balance", "?b")]).filter(t.gt(c("b"), 5000))
    return rich.join(inner).df.select("c", text("seg"))


@add(f"SELECT {iri('doc', 'doc_id')} AS doc, lang FROM documents WHERE source = 'src3'")
def named_graph_constant(spark, d):
    b = P.pattern(documents(spark, d), "?doc", V.DEFAULT_PREFIXES["dct"] + "title", "?title", graph=EX + "graph/src3")
    return b.df.select("doc", t.lang_text(c("title")).alias("lang"))


@add(f"SELECT {iri('graph', 'source')} AS g, count(*) AS docs, CAST(sum(n_chars) AS DOUBLE) AS chars FROM documents GROUP BY source")
def named_graph_variable(spark, d):
    b = P.bgp(
        documents(spark, d), [("?doc", V.RDF_TYPE, EX + "Document"), ("?doc", EX + "length", "?n")], graph="?g"
    )
    return A.group(b, ["g"], {"docs": A.count(c("doc")), "chars": A.sum_(c("n"))}).df


@add("""
SELECT short, CASE WHEN short LIKE 'ex:%' THEN 'http://example.org/' || substr(short, 4)
  WHEN short LIKE 'skos:%' THEN 'http://www.w3.org/2004/02/skos/core#' || substr(short, 6) ELSE short END AS long, count(*) AS n
FROM (SELECT CASE event_type WHEN 'click' THEN 'ex:' WHEN 'view' THEN 'skos:' WHEN 'error' THEN 'none:' ELSE 'http://x/' END || event_type AS short FROM events)
GROUP BY 1, 2""")
def expand_prefixes(spark, d):
    kind = c("event_type")
    head = F.when(kind == "click", "ex:").when(kind == "view", "skos:").when(kind == "error", "none:").otherwise("http://x/")
    df = R.read_tables(spark, d, "events")["events"].select(F.concat(head, kind).alias("short"))
    long = P.expand_prefixed(c("short"), {**V.DEFAULT_PREFIXES, "ex": EX})
    return df.groupBy("short", long.alias("long")).agg(F.count(F.lit(1)).alias("n"))


@add("""
SELECT 'cust:' || c_custkey AS short FROM customer UNION ALL SELECT 'ex:Customer' FROM customer
UNION ALL SELECT NULL FROM orders""")
def compact_iris(spark, d):
    g = shop(spark, d)
    rows = P.pattern(g, "?x", V.RDF_TYPE, EX + "Customer").df
    rows = rows.unionByName(rows.select(F.lit(EX + "Customer").alias("x")))
    rows = rows.unionByName(P.pattern(g, "?x", V.RDF_TYPE, EX + "Order").df)
    return rows.select(P.to_prefixed(c("x"), {"ex": EX, "cust": EX + "customer/"}).alias("short"))


@add(f"""
SELECT {iri('graph', 'source')} AS g, count(*) AS n FROM documents
WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM region""")
def graph_allowlist(spark, d):
    docs = documents(spark, d).where(c("p") == V.RDF_TYPE)
    regions = shop(spark, d).where((c("p") == V.RDF_TYPE) & (c("o") == EX + "Region"))
    nation = R.read_tables(spark, d, "nation")["nation"].where("n_regionkey = 2")
    allowed = nation.select(F.concat(F.lit(EX + "graph/src"), c("n_nationkey")).alias("g"))
    kept = P.allow_graphs(docs.unionByName(regions), allowed)
    return kept.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT 'http://example.org/inNation' AS p, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'http://example.org/inRegion', count(*) FROM nation")
def path_predicate_allowlist(spark, d):
    kept = P.allow_path_predicates(shop(spark, d).quads, [EX + "inNation", EX + "inRegion"])
    return kept.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


# ---- joins ----------------------------------------------------------------------------------


@add(f"SELECT {ORDER} AS o, {PLACED} AS c, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def orders_of_a_nation(spark, d):
    g = shop(spark, d)
    b = P.bgp(
        g, [("?o", EX + "placedBy", "?c"), ("?c", EX + "inNation", EX + "nation/3"), ("?o", EX + "total", "?total")]
    )
    return b.df.select("o", "c", num("total"))


@add(f"""
SELECT r_name AS region, count(DISTINCT o) AS orders, count(*) AS parts FROM (SELECT DISTINCT l_orderkey AS o, l_partkey FROM lineitem)
JOIN orders ON o = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name""")
def five_hop_join(spark, d):
    g = shop(spark, d).unionByName(contains(spark, d))
    b = P.bgp(
        g,
        [
            ("?o", EX + "hasPart", "?part"), ("?o", EX + "placedBy", "?c"), ("?c", EX + "inNation", "?n"),
            ("?n", EX + "inRegion", "?r"), ("?r", V.RDFS_LABEL, "?region"),
        ],
    )
    out = A.group(b, ["region"], {"orders": A.count_distinct(c("o")), "parts": A.count_rows()}).df
    return out.select(text("region"), "orders", "parts")


@add(f"SELECT {CUST} AS c, c_name AS name, c_mktsegment AS seg, round(c_acctbal, 2) AS bal FROM customer")
def star_join(spark, d):
    g = melted_shop(spark, d)
    b = P.star(g, "?c", {V.RDFS_LABEL: "?name", EX + "segment": "?seg", EX + "balance": "?bal"})
    return b.df.select("c", text("name"), text("seg"), num("bal"))


@add(f"SELECT {ORDER} AS o FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def product_with_one_row(spark, d):
    totals = P.pattern(shop(spark, d), "?o", EX + "total", "?t")
    mean = A.group(P.pattern(shop(spark, d), "?x", EX + "total", "?y"), [], {"mean": A.avg(c("y"))})
    return totals.join(mean).filter(t.num(c("t")) > c("mean")).project("o").df


_URGENT = "SELECT o_custkey AS k, o_orderkey AS o FROM orders WHERE o_orderpriority = '1-URGENT'"
_DEAR = "SELECT o_custkey AS k, o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'"


def _customers_with(spark, d, orders):
    found = Bindings(orders.select(R.entity("customer", "o_custkey").alias("c"), R.entity("order", "o_orderkey").alias("o")))
    return P.pattern(shop(spark, d), "?c", V.RDF_TYPE, EX + "Customer").optional(found)


def _dear_and_urgent(spark, d):
    o = R.read_tables(spark, d, "orders")["orders"]
    dear = _customers_with(spark, d, o.where("o_orderstatus = 'F'"))
    urgent = _customers_with(spark, d, o.where("o_orderpriority = '1-URGENT'"))
    return dear, urgent


_TWO = f"""
WITH l AS (SELECT c_custkey AS k, o FROM customer LEFT JOIN ({_DEAR}) ON k = c_custkey),
r AS (SELECT c_custkey AS k, o FROM customer LEFT JOIN ({_URGENT}) ON k = c_custkey)"""


@add(f"{_TWO} SELECT {iri('customer', 'l.k')} AS c, {iri('order', 'coalesce(l.o, r.o)')} AS o FROM l JOIN r ON l.k = r.k AND (l.o IS NULL OR r.o IS NULL OR l.o = r.o)")
def join_maybe_unbound(spark, d):
    dear, urgent = _dear_and_urgent(spark, d)
    return dear.join(urgent).df


@add(f"""{_TWO}, u AS (SELECT k, o FROM r WHERE o IS NOT NULL)
SELECT {iri('customer', 'l.k')} AS c, {iri('order', 'coalesce(l.o, u.o)')} AS o FROM l LEFT JOIN u ON l.k = u.k AND (l.o IS NULL OR l.o = u.o)""")
def optional_maybe_unbound(spark, d):
    dear, urgent = _dear_and_urgent(spark, d)
    return dear.optional(Bindings(urgent.df.where("o IS NOT NULL"))).df


@add(f"{_TWO} SELECT {iri('customer', 'l.k')} AS c, {iri('order', 'l.o')} AS o FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = l.k AND r.o IS NOT NULL AND (l.o IS NULL OR l.o = r.o))")
def minus_maybe_unbound(spark, d):
    dear, urgent = _dear_and_urgent(spark, d)
    return dear.minus(Bindings(urgent.df.where("o IS NOT NULL"))).df


@add(f"SELECT {CUST} AS c, {iri('order', 'o_orderkey')} AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 450000) ON o_custkey = c_custkey")
def optional_join(spark, d):
    g = shop(spark, d)
    dear = P.bgp(g, [("?o", EX + "placedBy", "?c"), ("?o", EX + "status", t.literal_key("P")), ("?o", EX + "total", "?t")])
    dear = dear.filter(t.gt(c("t"), 450000)).project("c", "o")
    return P.pattern(g, "?c", V.RDF_TYPE, EX + "Customer").optional(dear).df


@add(f"SELECT {CUST} AS c, {iri('order', 'o_orderkey')} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 60")
def optional_with_filter(spark, d):
    g = shop(spark, d)
    rich = P.bgp(g, [("?c", V.RDF_TYPE, EX + "Customer"), ("?c", EX + "balance", "?bal")])
    orders = P.bgp(g, [("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")])
    b = rich.optional(orders, lambda l, r: t.num(r("t")) > t.num(l("bal")) * 60)
    return b.project("c", "o").df


@add(f"SELECT {CUST} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def minus_pattern(spark, d):
    g = shop(spark, d)
    pending = P.bgp(g, [("?o", EX + "placedBy", "?c"), ("?o", EX + "status", t.literal_key("P"))])
    return P.pattern(g, "?c", V.RDF_TYPE, EX + "Customer").minus(pending).df


@add(f"SELECT {iri('nation', 'n_nationkey')} AS n FROM nation")
def minus_without_shared_variable(spark, d):
    g = shop(spark, d)
    return P.pattern(g, "?n", V.RDF_TYPE, EX + "Nation").minus(P.pattern(g, "?x", V.RDF_TYPE, EX + "Customer")).df


@add(f"SELECT {CUST} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 100)")
def not_exists_correlated(spark, d):
    g = shop(spark, d)
    rich = P.bgp(g, [("?c", V.RDF_TYPE, EX + "Customer"), ("?c", EX + "balance", "?bal")])
    orders = P.bgp(g, [("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")])
    return rich.not_exists(orders, lambda l, r: t.num(r("t")) > t.num(l("bal")) * 100).project("c").df


@add(f"SELECT {CUST} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_pattern(spark, d):
    g = shop(spark, d)
    pending = P.bgp(g, [("?o", EX + "placedBy", "?c"), ("?o", EX + "status", t.literal_key("P"))])
    return P.pattern(g, "?c", V.RDF_TYPE, EX + "Customer").exists(pending).df


@add(f"SELECT {CUST} AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
def exists_inside_or(spark, d):
    g = shop(spark, d)
    rich = P.bgp(g, [("?c", V.RDF_TYPE, EX + "Customer"), ("?c", EX + "balance", "?bal")])
    dear = P.bgp(g, [("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")]).filter(t.gt(c("t"), 490000))
    return rich.filter_exists(dear, lambda found: t.gt(c("bal"), 9000) | found).project("c").df


@add(f"""{_TWO}, u AS (SELECT k, o FROM r JOIN customer ON c_custkey = k WHERE o IS NOT NULL OR c_nationkey = 3)
SELECT {iri('customer', 'l.k')} AS c, {iri('order', 'l.o')} AS o FROM l JOIN customer ON c_custkey = l.k
WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM u WHERE u.k = l.k AND (l.o IS NULL OR u.o IS NULL OR l.o = u.o))""")
def exists_inside_or_maybe_unbound(spark, d):
    """EXISTS as a flag where the shared order may be unbound on both sides."""
    g = shop(spark, d)
    dear, urgent = _dear_and_urgent(spark, d)
    third = P.pattern(g, "?c", EX + "inNation", EX + "nation/3").df.withColumn("third", F.lit(True))
    some = urgent.df.join(third, "c", "left").where("o IS NOT NULL OR third").select("c", "o")
    rich = dear.join(P.pattern(g, "?c", EX + "balance", "?bal"))
    return rich.filter_exists(Bindings(some, ["c"]), lambda found: t.gt(c("bal"), 9000) | found).project("c", "o").df


@add(f"SELECT {CUST} AS c, c_mktsegment AS seg FROM customer WHERE (c_nationkey = 1 AND c_mktsegment = 'BUILDING') OR (c_nationkey = 2 AND c_mktsegment = 'MACHINERY')")
def values_join(spark, d):
    g = shop(spark, d)
    table = values(
        spark, ["n", "seg"],
        [(EX + "nation/1", t.literal_key("BUILDING", lang="en")), (EX + "nation/2", t.literal_key("MACHINERY", lang="en"))],
    )
    b = table.join(P.bgp(g, [("?c", EX + "inNation", "?n"), ("?c", EX + "segment", "?seg")]))
    return b.df.select("c", text("seg"))


@add(f"""
SELECT {CUST} AS c FROM customer WHERE c_nationkey = 1
UNION ALL SELECT {CUST} FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def values_with_undef(spark, d):
    g = shop(spark, d)
    table = values(spark, ["n", "seg"], [(EX + "nation/1", None), (None, t.literal_key("MACHINERY", lang="en"))])
    return table.join(P.bgp(g, [("?c", EX + "inNation", "?n"), ("?c", EX + "segment", "?seg")])).project("c").df


@add(f"SELECT {CUST} AS c FROM customer WHERE c_nationkey = 2")
def values_intersection(spark, d):
    a = values(spark, ["n"], [(EX + "nation/1",), (EX + "nation/2",)])
    b = values(spark, ["n"], [(EX + "nation/2",), (EX + "nation/3",)])
    customers = P.bgp(shop(spark, d), [("?c", V.RDF_TYPE, EX + "Customer"), ("?c", EX + "inNation", "?n")])
    return a.join(b).join(customers).project("c").df


@add(f"""
SELECT {iri('order', 'o_orderkey')} AS o, c_name AS name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25) JOIN customer ON o_custkey = c_custkey""")
def subquery_with_limit(spark, d):
    g = shop(spark, d)
    inner = P.bgp(g, [("?o", EX + "total", "?t"), ("?o", EX + "placedBy", "?c")])
    key = c("o").substr(F.lit(len(EX + "order/") + 1), F.length("o")).cast("bigint")
    top = Bindings(inner.df.orderBy(t.num(c("t")).desc(), key).limit(25).select("o", "c"))
    b = top.join(P.pattern(g, "?c", V.RDFS_LABEL, "?name"))
    return b.df.select("o", text("name"))


@add(f"""
SELECT {ORDER} AS o, {PLACED} AS c FROM orders JOIN (SELECT o_custkey AS k, max(o_totalprice) AS m FROM orders GROUP BY 1) ON k = o_custkey AND m = o_totalprice""")
def top_one_by_subquery(spark, d):
    g = shop(spark, d)
    b = P.bgp(g, [("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")])
    best = A.group(b, ["c"], {"most": A.max_(c("t"))})
    return b.join(best).filter(t.eq(c("t"), c("most"))).project("o", "c").df


@add(f"""
SELECT {ORDER} AS o, {PLACED} AS c FROM orders JOIN (SELECT o_custkey AS k, min(o_totalprice) AS m FROM orders GROUP BY 1) ON k = o_custkey AND m = o_totalprice""")
def top_one_per_group(spark, d):
    b = P.bgp(shop(spark, d), [("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")])
    return A.top_per_group(b, ["c"], "t", descending=False).project("o", "c").df


@add(f"""
SELECT {CUST} AS c, {iri('supplier', 's_suppkey')} AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE floor(c_acctbal / 500) = floor(s_acctbal / 500)""")
def value_equality_join(spark, d):
    g = shop(spark, d)
    cust = P.bgp(g, [("?c", V.RDF_TYPE, EX + "Customer"), ("?c", EX + "inNation", "?n"), ("?c", EX + "balance", "?cb")])
    supp = P.bgp(g, [("?s", V.RDF_TYPE, EX + "Supplier"), ("?s", EX + "inNation", "?n"), ("?s", EX + "balance", "?sb")])
    level = lambda b, v, name: b.bind(name, t.floor(t.divide(c(v), 500)), certain=True).project(*[x for x in b.variables if x != v], name)
    return level(cust, "cb", "x").join_equal(level(supp, "sb", "y"), ("x", "y")).project("c", "s").df


@add(f"""
SELECT {iri('supplier', 's_suppkey')} AS s, {iri('nation', 'n_nationkey')} AS n, p.k AS parts
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT p_size, count(*) AS k FROM part GROUP BY p_size) p ON p_size = n_nationkey""")
def value_join_across_types(spark, d):
    """Doubles, decimals and integers of equal value meet."""
    tb = R.read_tables(spark, d, "supplier", "nation", "part")
    doubles = Bindings(tb["supplier"].select(R.entity("supplier", "s_suppkey").alias("s"), t.double_term(c("s_nationkey")).alias("x")))
    decimals = Bindings(tb["nation"].select(R.entity("nation", "n_nationkey").alias("n"), t.decimal_term(c("n_nationkey").cast("decimal(9,2)")).alias("y")))
    sizes = tb["part"].groupBy("p_size").agg(F.count(F.lit(1)).alias("parts"))
    integers = Bindings(sizes.select(t.integer_term(c("p_size")).alias("z"), "parts"))
    return doubles.join_equal(decimals, ("x", "y")).join_equal(integers, ("y", "z")).df.select("s", "n", "parts")


# ---- paths ----------------------------------------------------------------------------------


@add(f"SELECT {iri('nation', 'c_nationkey')} AS s, {CUST} AS o FROM customer UNION ALL SELECT {iri('nation', 's_nationkey')}, {iri('supplier', 's_suppkey')} FROM supplier")
def path_inverse(spark, d):
    return paths.inverse(paths.edges(shop(spark, d), EX + "inNation"))


@add(f"SELECT {ORDER} AS s, {iri('region', 'n_regionkey')} AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def path_sequence(spark, d):
    g = shop(spark, d)
    return paths.sequence(paths.edges(g, EX + "placedBy"), paths.edges(g, EX + "inNation"), paths.edges(g, EX + "inRegion"))


@add(f"""
SELECT {iri('nation', 'n_nationkey')} AS s, {iri('region', 'n_regionkey')} AS o FROM nation
UNION ALL SELECT {CUST}, {iri('nation', 'c_nationkey')} FROM customer UNION ALL SELECT {iri('supplier', 's_suppkey')}, {iri('nation', 's_nationkey')} FROM supplier""")
def path_alternative(spark, d):
    return paths.edges(shop(spark, d), EX + "inNation", EX + "inRegion")


@add(f"""
SELECT {iri('nation', 'n_nationkey')} AS s, {iri('region', 'n_regionkey')} AS o FROM nation
UNION SELECT {iri('nation', 'n_nationkey')}, {iri('nation', 'n_nationkey')} FROM nation
UNION SELECT {iri('region', 'r_regionkey')}, {iri('region', 'r_regionkey')} FROM region
UNION SELECT 'http://example.org/nowhere', 'http://example.org/nowhere'""")
def path_zero_or_one(spark, d):
    g = shop(spark, d).where(c("p") == EX + "inRegion")
    return paths.zero_or_one(paths.edges(g, EX + "inRegion"), paths.nodes(g, constants=[EX + "nowhere"]))


_TURN = "WITH RECURSIVE e AS (SELECT conv_id AS c, turn AS t, turn - 1 AS p FROM conversations WHERE turn > 0), r AS (SELECT c, p AS root, t AS n, 1 AS hops FROM e WHERE p = 0 UNION SELECT r.c, r.root, e.t, hops + 1 FROM r JOIN e ON e.c = r.c AND e.p = r.n)"


def _roots(replies):
    return replies.select(c("o").alias("s")).where(c("s").endswith("/0"))


@add(f"{_TURN} SELECT {iri('turn', 'c', 'root')} AS s, {iri('turn', 'c', 'n')} AS o FROM r")
def path_one_or_more_from_start(spark, d):
    replies = paths.edges(replies_graph(spark, d), EX + "repliesTo")
    return paths.reach(paths.inverse(replies), _roots(replies))


@add(f"{_TURN} SELECT {iri('turn', 'c', 'root')} AS s, {iri('turn', 'c', 'n')} AS o FROM r UNION SELECT {iri('turn', 'c', '0')}, {iri('turn', 'c', '0')} FROM e WHERE p = 0")
def path_zero_or_more_from_start(spark, d):
    replies = paths.edges(replies_graph(spark, d), EX + "repliesTo")
    return paths.reach(paths.inverse(replies), _roots(replies), include_start=True)


@add(f"{_TURN} SELECT DISTINCT {iri('turn', 'c', 'root')} AS s, {iri('turn', 'c', 'n')} AS o FROM r WHERE hops <= 3")
def path_bounded(spark, d):
    replies = paths.edges(replies_graph(spark, d), EX + "repliesTo")
    return paths.reach(paths.inverse(replies), _roots(replies), max_hops=3, on_limit="stop")


@add(f"""
{_TURN} SELECT {iri('conversation', 'c')} AS g, count(*) AS pairs FROM r GROUP BY c""")
def path_inside_graph_variable(spark, d):
    turns = R.read_tables(spark, d, "conversations")["conversations"].where("turn > 0")
    g = R.triples(
        turns, R.entity("turn", "conv_id", "turn"),
        {EX + "repliesTo": R.entity("turn", c("conv_id"), c("turn") - 1)}, graph=R.entity("conversation", "conv_id"),
    )
    replies = paths.edges(g, EX + "repliesTo", graph="?g")
    roots = replies.select("g", c("o").alias("s")).where(c("s").endswith("/0"))
    return paths.reach(paths.inverse(replies), roots).groupBy("g").agg(F.count(F.lit(1)).alias("pairs"))


_TRADE = """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _trade(spark, d):
    tb = R.read_tables(spark, d, "lineitem", "orders", "customer", "supplier")
    j = (
        tb["lineitem"].select("l_orderkey", "l_suppkey")
        .join(tb["orders"].select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
        .join(tb["customer"].select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
        .join(tb["supplier"].select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
    )
    return j.select(R.entity("nation", "c_nationkey").alias("s"), R.entity("nation", "s_nationkey").alias("o")).distinct()


@add(f"{_TRADE}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT {iri('nation', 'a')} AS s, {iri('nation', 'b')} AS o FROM r")
def path_one_or_more_with_cycles(spark, d):
    return paths.one_or_more(_trade(spark, d))


@add(f"{_TRADE}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT {iri('nation', 'a')} AS s, {iri('nation', 'b')} AS o FROM r UNION SELECT {iri('nation', 'n_nationkey')}, {iri('nation', 'n_nationkey')} FROM nation")
def path_zero_or_more_with_cycles(spark, d):
    nations = P.pattern(shop(spark, d), "?s", V.RDF_TYPE, EX + "Nation").df
    return paths.zero_or_more(_trade(spark, d), nations.withColumn("o", c("s")))


_ALL = EX + "all"


@add(f"""
WITH w AS (SELECT {ORDER} AS o, {PLACED} AS c, {iri('nation', 'c_nationkey')} AS n, {iri('region', 'n_regionkey')} AS r, o_orderstatus AS st
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT '{_ALL}' AS s, o FROM w UNION SELECT '{_ALL}', c FROM w UNION SELECT '{_ALL}', n FROM w UNION SELECT '{_ALL}', r FROM w
UNION SELECT o, c FROM w WHERE st = 'P' UNION SELECT o, n FROM w WHERE st = 'P' UNION SELECT o, r FROM w WHERE st = 'P'""")
def path_reach_through_hub(spark, d):
    """A hub with nearly half of all edges, followed by chains, from the hub and from open orders."""
    g = shop(spark, d)
    placed = paths.edges(g, EX + "placedBy")
    hub = placed.select(F.lit(_ALL).alias("s"), c("s").alias("o"))
    edges = paths.alternative(hub, placed, paths.edges(g, EX + "inNation"), paths.edges(g, EX + "inRegion"))
    pending = P.pattern(g, "?s", EX + "status", t.literal_key("P")).df
    starts = pending.unionByName(spark.createDataFrame([(_ALL,)], "s string"))
    return paths.reach(edges, starts, block=1000)


_USE = """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'user/' || user_id AS a, 'kind/' || event_type AS b FROM events
  UNION SELECT DISTINCT 'kind/' || event_type, 'all' FROM events
  UNION SELECT DISTINCT 'all', 'hour/' || strftime(ts, '%Y-%m-%d') FROM events),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""


@add(f"{_USE} SELECT '{EX}' || a AS s, '{EX}' || b AS o FROM r")
def path_closure_through_hubs(spark, d):
    """Closure over all users of the events: few kinds that everybody uses, one node behind them, then days."""
    events = R.read_tables(spark, d, "events")["events"]
    at = lambda kind, x: F.concat(F.lit(EX + kind + "/"), x)
    user, kind = at("user", c("user_id").cast("string")), at("kind", c("event_type"))
    day = at("hour", F.date_format("ts", "yyyy-MM-dd"))
    every = F.lit(_ALL)
    edges = [events.select(a.alias("s"), b.alias("o")).distinct() for a, b in ((user, kind), (kind, every), (every, day))]
    return paths.one_or_more(paths.alternative(*edges), block=200)


# ---- aggregates -----------------------------------------------------------------------------


@add("SELECT o_orderstatus AS st, count(*) AS n, count(o_totalprice) AS bound, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def aggregate_counts(spark, d):
    b = P.bgp(shop(spark, d), [("?o", EX + "status", "?st"), ("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")])
    out = A.group(b, ["st"], {"n": A.count_rows(), "bound": A.count(c("t")), "customers": A.count_distinct(c("c"))})
    return out.df.select(text("st"), "n", "bound", "customers")


@add("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END FROM orders)")
def aggregate_distinct_rows(spark, d):
    g = shop(spark, d)
    done = P.pattern(g, "?o", EX + "status", "?st").filter(t.eq(c("st"), "F"))
    b = P.pattern(g, "?o", EX + "placedBy", "?c").optional(done).project("c", "st")
    return A.group(b, [], {"n": A.count_distinct_rows(b)}).df


@add(f"SELECT {PLACED} AS c, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def aggregate_sum_avg(spark, d):
    b = P.bgp(shop(spark, d), [("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")])
    out = A.group(b, ["c"], {"total": A.sum_(c("t")), "mean": A.avg(c("t"))}).df
    return out.select("c", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"))


@add("SELECT p_brand AS brand, CAST(sum(DISTINCT p_size) AS DOUBLE) AS sizes, round(avg(DISTINCT p_size), 4) AS mean FROM part GROUP BY 1")
def aggregate_distinct_terms(spark, d):
    b = P.bgp(shop(spark, d), [("?p", EX + "brand", "?brand"), ("?p", EX + "size", "?size")])
    out = A.group_distinct(b, ["brand"], "size", {"sizes": A.sum_(c("size")), "mean": A.avg(c("size"))}).df
    return out.select(text("brand"), "sizes", F.round("mean", 4).alias("mean"))


@add("SELECT p_brand AS brand, CAST(min(p_size) AS BIGINT) AS least, CAST(max(p_size) AS BIGINT) AS most FROM part GROUP BY 1")
def aggregate_min_max(spark, d):
    b = P.bgp(shop(spark, d), [("?p", EX + "brand", "?brand"), ("?p", EX + "size", "?size")])
    out = A.group(b, ["brand"], {"least": A.min_(c("size")), "most": A.max_(c("size"))}).df
    return out.select(text("brand"), *[t.num(c(x)).cast("bigint").alias(x) for x in ("least", "most")])


@add("SELECT p_brand AS brand, min(p_name) AS any_name FROM part GROUP BY 1")
def aggregate_sample(spark, d):
    b = P.bgp(shop(spark, d), [("?p", EX + "brand", "?brand"), ("?p", V.RDFS_LABEL, "?l")])
    out = A.group(b, ["brand"], {"any_name": A.sample(c("l"))}).df
    return out.select(text("brand"), text("any_name"))


@add(f"SELECT {iri('nation', 'c_nationkey')} AS n, string_agg(seg, ', ' ORDER BY seg) AS segments FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS seg FROM customer) GROUP BY 1")
def aggregate_group_concat(spark, d):
    b = P.bgp(shop(spark, d), [("?c", EX + "inNation", "?n"), ("?c", EX + "segment", "?seg")])
    once = b.project("n", "seg").distinct()
    return A.group(once, ["n"], {"segments": A.group_concat(c("seg"), ", ")}).df


@add("SELECT o_orderstatus AS st, md5(string_agg(o_orderpriority || ' ' || o_orderkey, '|' ORDER BY o_orderpriority || ' ' || o_orderkey)) AS hash FROM orders GROUP BY 1")
def aggregate_group_concat_of_large_groups(spark, d):
    """Three groups that hold all orders, two of them nearly half each."""
    orders = R.read_tables(spark, d, "orders")["orders"]
    rows = orders.select(c("o_orderstatus").alias("st"), t.string_term(F.concat_ws(" ", "o_orderpriority", "o_orderkey")).alias("x"))
    found = A.concat_groups(Bindings(rows), ["st"], "all", "x", separator="|")
    return found.df.select("st", F.md5("all").alias("hash"))


@add("SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1")
def group_by_expression(spark, d):
    b = P.pattern(shop(spark, d), "?o", EX + "placedOn", "?d")
    out = A.group(b, [("y", t.year(c("d")))], {"n": A.count_rows()}).df
    return out.select(t.num(c("y")).cast("bigint").alias("y"), "n")


@add("SELECT count(*) AS n, 0.0::DOUBLE AS total, 0.0::DOUBLE AS mean FROM orders WHERE o_totalprice < 0")
def aggregate_empty_input(spark, d):
    b = P.pattern(shop(spark, d), "?o", EX + "total", "?t").filter(t.lt(c("t"), 0))
    return A.group(b, [], {"n": A.count_rows(), "total": A.sum_(c("t")), "mean": A.avg(c("t"))}).df


@add(f"SELECT {PLACED} AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10 AND max(o_totalprice) > 400000")
def having_conditions(spark, d):
    b = P.bgp(shop(spark, d), [("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")])
    out = A.group(b, ["c"], {"n": A.count_rows(), "most": A.max_(c("t"))}, having=[c("n") > 10, t.gt(c("most"), 400000)])
    return out.project("c", "n").df


@add("SELECT p_brand AS brand, round(sum(p_retailprice) / count(*) + max(p_size), 6) AS mix FROM part GROUP BY 1")
def aggregates_in_expressions(spark, d):
    b = P.bgp(shop(spark, d), [("?p", EX + "brand", "?brand"), ("?p", EX + "price", "?price"), ("?p", EX + "size", "?size")])
    out = A.group(b, ["brand"], {"s": A.sum_(c("price")), "n": A.count_rows(), "m": A.max_(c("size"))})
    return out.df.select(text("brand"), F.round(c("s") / c("n") + t.num(c("m")), 6).alias("mix"))


@add("SELECT DISTINCT c_nationkey AS k, c_mktsegment AS seg FROM customer")
def select_distinct(spark, d):
    b = P.bgp(shop(spark, d), [("?c", EX + "inNation", "?n"), ("?c", EX + "segment", "?seg")])
    out = forms.select(b, "n", "seg", distinct=True).df
    return out.select(F.substring_index("n", "/", -1).cast("int").alias("k"), text("seg"))


@add("SELECT DISTINCT o_orderstatus AS st FROM orders")
def select_reduced(spark, d):
    b = P.pattern(shop(spark, d), "?o", EX + "status", "?st")
    return b.project("st").reduced().df.select(text("st"))


# ---- forms, order, limits -------------------------------------------------------------------


@add(f"SELECT {ORDER} AS o FROM orders ORDER BY o_totalprice DESC, {ORDER} LIMIT 40 OFFSET 10")
def order_limit_offset(spark, d):
    b = P.pattern(shop(spark, d), "?o", EX + "total", "?t")
    return forms.select(b, "o", order=[("t", "desc"), "o"], limit=40, offset=10).df


@add(f"SELECT {PLACED} AS c, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def order_by_aggregate(spark, d):
    b = A.group(P.pattern(shop(spark, d), "?o", EX + "placedBy", "?c"), ["c"], {"n": A.count_rows()})
    return b.df.orderBy(F.desc("n"), t.order_key(c("c"))).limit(20)


@add("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 499000) AS answer")
def ask_form(spark, d):
    return forms.ask(P.pattern(shop(spark, d), "?o", EX + "total", "?t").filter(t.gt(c("t"), 499000)))


@add(f"""
SELECT DISTINCT {iri('nation', 'c_nationkey')} AS s, 'http://example.org/has' AS p, {iri('customer', 'c_custkey')} AS o FROM customer
UNION SELECT {CUST}, 'http://example.org/spent', {ORDER} FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 480000""")
def construct_form(spark, d):
    g = shop(spark, d)
    dear = P.bgp(g, [("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")]).filter(t.gt(c("t"), 480000)).project("c", "o")
    b = P.bgp(g, [("?c", V.RDF_TYPE, EX + "Customer"), ("?c", EX + "inNation", "?n"), ("?c", V.RDFS_LABEL, "?l")]).optional(dear)
    return forms.construct(b, [("?n", EX + "has", "?c"), ("?c", EX + "spent", "?o"), ("?l", EX + "names", "?c")])


@add(f"""
WITH x AS (SELECT * FROM orders ORDER BY o_totalprice DESC, {ORDER} LIMIT 15)
SELECT {ORDER} AS s, 'http://example.org/by' AS p, {PLACED} AS o FROM x UNION SELECT {PLACED}, 'http://example.org/made', {ORDER} FROM x""")
def construct_limit_counts_solutions(spark, d):
    b = P.bgp(shop(spark, d), [("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")])
    top = forms.order_by(b, ("t", "desc"), "o")
    return forms.construct(top, [("?o", EX + "by", "?c"), ("?c", EX + "made", "?o")], limit=15)


@add(f"SELECT {ORDER} AS o FROM orders ORDER BY o_totalprice, {ORDER} LIMIT 100")
def row_cap_default(spark, d):
    b = P.pattern(shop(spark, d), "?o", EX + "total", "?t")
    return forms.capped(forms.order_by(b, "t", "o").project("o").df)


@add("SELECT true AS truncated, 30 AS n")
def truncation_flag(spark, d):
    b = P.pattern(shop(spark, d), "?o", EX + "total", "?t")
    cut = forms.truncated(b.df, 30)
    return cut.groupBy("truncated").agg(F.count(F.lit(1)).cast("int").alias("n"))


@add(f"""
SELECT {PLACED} AS c, {ORDER} AS o, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, {ORDER}) - 1 AS INT) AS rank
FROM orders QUALIFY rank < 3""")
def top_k_per_key(spark, d):
    b = P.bgp(shop(spark, d), [("?o", EX + "placedBy", "?c"), ("?o", EX + "total", "?t")])
    return forms.top_k(b.df, ["c"], [t.num(c("t")).desc(), c("o").asc()], 3).select("c", "o", "rank")


@add(f"SELECT 'uri' AS kind, {CUST} AS subject, c_mktsegment AS value, 'en' AS lang FROM customer")
def typed_result_values(spark, d):
    b = P.pattern(shop(spark, d), "?c", EX + "segment", "?seg")
    out = forms.typed_results(b)
    return out.select(c("c.type").alias("kind"), c("c.value").alias("subject"), c("seg.value").alias("value"), c("seg.lang").alias("lang"))


# ---- set operations -------------------------------------------------------------------------


@add(f"""
SELECT {CUST} AS x, {iri('nation', 'c_nationkey')} AS n, NULL AS st FROM customer
UNION ALL SELECT {iri('supplier', 's_suppkey')}, {iri('nation', 's_nationkey')}, NULL FROM supplier
UNION ALL SELECT {ORDER}, NULL, o_orderstatus FROM orders""")
def union_with_unbound(spark, d):
    g = shop(spark, d)
    b = P.pattern(g, "?x", EX + "inNation", "?n").union(P.pattern(g, "?x", EX + "status", "?st"))
    return b.df.select("x", "n", text("st"))


@add(f"SELECT DISTINCT {PLACED} AS c FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_difference(spark, d):
    g = shop(spark, d)
    of = lambda st: P.bgp(g, [("?o", EX + "placedBy", "?c"), ("?o", EX + "status", t.literal_key(st))]).project("c")
    return of("F").minus(of("P")).distinct().df
