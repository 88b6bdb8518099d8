"""Expression functions over the terms of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.operators import aggregates as A
from tripleframe.operators import patterns as P
from tripleframe.operators.bindings import Bindings
from tripleframe.queries import iri, registry
from tripleframe.sources import relational as R
from tripleframe.queries.graph import CUST, EX, ORDER, documents, event_graph, melted_shop, shop

add = registry.add
c = F.col


def total(spark, d):
    return P.pattern(shop(spark, d), "?o", EX + "total", "?t")


def customers(spark, d):
    return P.bgp(
        shop(spark, d),
        [("?c", V.RDF_TYPE, EX + "Customer"), ("?c", V.RDFS_LABEL, "?l"), ("?c", EX + "segment", "?seg"), ("?c", EX + "balance", "?b")],
    )


def n(column, kind="double", digits=None):
    out = t.num(column)
    return F.round(out, digits) if digits is not None else out.cast(kind)


@add("SELECT p_partkey AS k, p_size = 7 AS same_number, p_size <> 7 AS other, p_brand = 'Brand#3' AS same_text, false AS mixed, NULL::BOOLEAN AS unknown FROM part")
def value_equality(spark, d):
    b = P.bgp(shop(spark, d), [("?p", EX + "size", "?s"), ("?p", EX + "brand", "?b")])
    odd = t.typed_term(t.lexical(c("s")), "http://example.org/odd")
    return b.df.select(
        F.substring_index("p", "/", -1).cast("bigint").alias("k"), t.eq(c("s"), 7.0).alias("same_number"), t.ne(c("s"), 7).alias("other"),
        t.eq(c("b"), "Brand#3").alias("same_text"), t.eq(c("b"), 7).alias("mixed"), t.eq(odd, c("b")).alias("unknown"),
    )


@add(f"""SELECT {ORDER} AS o, o_totalprice < 100000 AS low, o_totalprice >= 250000 AS high, o_orderdate > TIMESTAMP '1997-01-01' AS late,
o_orderdate <= TIMESTAMP '1996-01-01' AS early, NULL::BOOLEAN AS mixed FROM orders""")
def order_comparison(spark, d):
    b = P.bgp(shop(spark, d), [("?o", EX + "total", "?t"), ("?o", EX + "placedOn", "?d")])
    return b.df.select(
        "o", t.lt(c("t"), 100000).alias("low"), t.ge(c("t"), 250000.0).alias("high"),
        t.gt(c("d"), t.literal("1997-01-01", datatype=V.DATE)).alias("late"),
        t.le(c("d"), t.literal("1996-01-01T00:00:00", datatype=V.DATETIME)).alias("early"), t.lt(c("t"), "x").alias("mixed"),
    )


@add("""SELECT p_partkey AS k, CAST(p_size + 3 AS BIGINT) AS plus3, CAST(p_size - 50 AS BIGINT) AS minus50, CAST(p_size * p_size AS BIGINT) AS sq, p_size / 8.0::DOUBLE AS eighth,
NULL::DOUBLE AS by_zero, CAST(-p_size AS BIGINT) AS neg, round(p_retailprice * p_size, 2) AS cost FROM part""")
def arithmetic(spark, d):
    b = P.bgp(shop(spark, d), [("?p", EX + "size", "?s"), ("?p", EX + "price", "?r")])
    s = c("s")
    return b.df.select(
        F.substring_index("p", "/", -1).cast("bigint").alias("k"), n(t.add(s, 3), "bigint").alias("plus3"), n(t.subtract(s, 50), "bigint").alias("minus50"),
        n(t.multiply(s, s), "bigint").alias("sq"), n(t.divide(s, 8)).alias("eighth"), n(t.divide(s, 0)).alias("by_zero"), n(t.negate(s), "bigint").alias("neg"),
        n(t.multiply(c("r"), t.plus(s)), digits=2).alias("cost"),
    )


@add(f"""SELECT {CUST} AS c, (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') AS both, (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') AS either, NOT (c_acctbal > 5000) AS poor,
CASE WHEN c_acctbal > 5000 THEN true END AS or_error, CASE WHEN NOT (c_acctbal > 5000) THEN false END AS and_error FROM customer""")
def three_valued_logic(spark, d):
    rich, building = t.gt(c("b"), 5000), t.eq(t.str_(c("seg")), "BUILDING")
    error = t.lt(c("b"), "text")
    return customers(spark, d).df.select(
        "c", t.and_(rich, building).alias("both"), t.or_(rich, building).alias("either"), t.not_(rich).alias("poor"),
        t.or_(rich, error).alias("or_error"), t.and_(rich, error).alias("and_error"),
    )


@add("SELECT p_partkey AS k, p_size IN (1, 5, 9) AS listed, p_size NOT IN (1, 5, 9) AS unlisted FROM part")
def in_list(spark, d):
    b = P.pattern(shop(spark, d), "?p", EX + "size", "?s")
    options = [1, 5.0, "x", 9]
    return b.df.select(
        F.substring_index("p", "/", -1).cast("bigint").alias("k"), t.in_(c("s"), options).alias("listed"), t.not_in(c("s"), options).alias("unlisted"),
    )


@add("SELECT p_partkey AS k, p_size - 10 <> 0 AS number, true AS words, false AS empty, NULL::BOOLEAN AS resource FROM part")
def effective_boolean_value(spark, d):
    b = P.bgp(shop(spark, d), [("?p", EX + "size", "?s"), ("?p", EX + "brand", "?b")])
    return b.df.select(
        F.substring_index("p", "/", -1).cast("bigint").alias("k"), t.ebv(t.subtract(c("s"), 10)).alias("number"), t.ebv(c("b")).alias("words"),
        t.ebv(t.substr(c("b"), 100)).alias("empty"), t.ebv(c("p")).alias("resource"),
    )


@add(f"""SELECT {CUST} AS c, lower(c_name) AS low, upper(c_name) AS up, CAST(length(c_name) AS BIGINT) AS len, contains(c_name, '0007') AS has, starts_with(c_mktsegment, 'B') AS head,
ends_with(c_mktsegment, 'Y') AS tail, 'en' AS lang FROM customer""")
def string_functions(spark, d):
    return customers(spark, d).df.select(
        "c", t.text(t.lcase(c("l"))).alias("low"), t.text(t.ucase(c("l"))).alias("up"), n(t.strlen(c("l")), "bigint").alias("len"), t.contains(c("l"), "0007").alias("has"),
        t.strstarts(c("seg"), "B").alias("head"), t.strends(c("seg"), "Y").alias("tail"), t.lang_text(t.lcase(c("seg"))).alias("lang"),
    )


@add(f"SELECT {CUST} AS c, substr(c_name, 1, 4) AS head, substr(c_name, 10) AS tail, substr(c_name, 1, 2) AS before, c_mktsegment || '-' || c_name AS pair, {CUST} AS iri_text FROM customer")
def substring_and_concat(spark, d):
    return customers(spark, d).df.select(
        "c", t.text(t.substr(c("l"), 1, 4)).alias("head"), t.text(t.substr(c("l"), 10)).alias("tail"), t.text(t.substr(c("l"), 0, 3)).alias("before"),
        t.text(t.concat(c("seg"), "-", c("l"))).alias("pair"), t.text(t.str_(c("c"))).alias("iri_text"),
    )


@add("""SELECT p, bool_and(lit) AS lit, bool_and(res) AS res, bool_or(blank) AS blank, bool_and(numeric) AS numeric, min(dt) AS dt, count(*) AS n FROM (
SELECT 'size' AS p, true AS lit, false AS res, false AS blank, true AS numeric, 'http://www.w3.org/2001/XMLSchema#integer' AS dt FROM part
UNION ALL SELECT 'brand', true, false, false, false, 'http://www.w3.org/2001/XMLSchema#string' FROM part
UNION ALL SELECT 'placedBy', false, true, false, false, NULL FROM orders
UNION ALL SELECT 'placedOn', true, false, false, false, 'http://www.w3.org/2001/XMLSchema#dateTime' FROM orders
UNION ALL SELECT 'total', true, false, false, true, 'http://www.w3.org/2001/XMLSchema#double' FROM orders
UNION ALL SELECT 'segment', true, false, false, false, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' FROM customer) GROUP BY p""")
def type_tests_and_datatype(spark, d):
    names = ["size", "brand", "placedBy", "placedOn", "total", "segment"]
    g = melted_shop(spark, d).where(c("p").isin([EX + x for x in names]))
    o = c("o")
    return P.pattern(g, "?s", "?p", "?o").df.groupBy(F.substring_index("p", "/", -1).alias("p")).agg(
        F.bool_and(t.is_literal(o)).alias("lit"), F.bool_and(t.is_iri(o)).alias("res"), F.bool_or(t.is_blank(o)).alias("blank"),
        F.bool_and(t.is_numeric(o)).alias("numeric"), F.min(t.datatype(o)).alias("dt"), F.count(F.lit(1)).alias("n"),
    )


@add("SELECT lang, lang IN ('en', 'fr') AS wanted, true AS some_tag, count(*) AS n FROM documents GROUP BY 1")
def language_functions(spark, d):
    b = P.pattern(documents(spark, d), "?doc", V.DEFAULT_PREFIXES["dct"] + "title", "?title", graph="?g")
    tag = t.lang(c("title"))
    wanted = t.or_(t.lang_matches(tag, "EN"), t.lang_matches(tag, "fr"))
    return b.df.groupBy(t.text(tag).alias("lang"), wanted.alias("wanted"), t.lang_matches(tag, "*").alias("some_tag")).agg(F.count(F.lit(1)).alias("n"))


@add(f"""SELECT {CUST} AS c, abs(floor(-c_acctbal / 1000)) AS a, CASE WHEN ceil(c_acctbal / 1000) = 0 THEN 0.0 ELSE ceil(c_acctbal / 1000) END AS up, floor(c_acctbal / 1000) AS down, CASE WHEN c_acctbal / 1000 > 0.5 THEN floor(-c_acctbal / 1000 + 0.5) ELSE abs(floor(-c_acctbal / 1000 + 0.5)) END AS half FROM customer""")
def rounding_functions(spark, d):
    k = t.divide(c("b"), 1000)
    return customers(spark, d).df.select(
        "c", n(t.abs_(t.floor(t.negate(k)))).alias("a"), n(t.ceil(k)).alias("up"), n(t.floor(k)).alias("down"), n(t.add(t.round_(t.negate(k)), 0)).alias("half"),
    )


@add(f"""SELECT {CUST} AS c, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'poor' END AS label, NULL AS failed, c_mktsegment AS first_bound, true AS bound_c FROM customer""")
def if_and_coalesce(spark, d):
    return customers(spark, d).df.select(
        "c", t.text(t.if_(t.gt(c("b"), 5000), "rich", "poor")).alias("label"), t.text(t.if_(t.gt(c("b"), "x"), "a", "b")).alias("failed"),
        t.text(t.coalesce(t.add(c("seg"), 1), t.str_(c("seg")), "none")).alias("first_bound"), t.bound(c("c")).alias("bound_c"),
    )


@add("SELECT p_partkey AS k, 'http://example.org/name/' || replace(p_name, ' ', '_') AS good, NULL AS bad FROM part")
def make_iri(spark, d):
    b = P.pattern(shop(spark, d), "?p", V.RDFS_LABEL, "?l").join(P.pattern(shop(spark, d), "?p", V.RDF_TYPE, EX + "Part"))
    name = t.string_term(F.replace(t.lexical(c("l")), F.lit(" "), F.lit("_")))
    return b.df.select(
        F.substring_index("p", "/", -1).cast("bigint").alias("k"), t.iri(t.concat("http://example.org/name/", name)).alias("good"), t.iri(c("l")).alias("bad"),
    )


@add(f"SELECT {iri('doc', 'doc_id')} AS doc, regexp_matches(text, '[0-9]{{4}}') AS digits, regexp_matches(text, '^the ', 'i') AS opens FROM documents")
def regex_function(spark, d):
    b = P.pattern(documents(spark, d), "?doc", V.DEFAULT_PREFIXES["dct"] + "title", "?title", graph="?g")
    return b.df.select("doc", t.regex(c("title"), "[0-9]{4}").alias("digits"), t.regex(c("title"), "^the ", "i").alias("opens"))


@add("""SELECT event_id AS k, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS mo, CAST(day(ts) AS BIGINT) AS dd, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS DOUBLE) AS se, true AS past FROM events""")
def date_fields(spark, d):
    b = P.pattern(event_graph(spark, d), "?e", EX + "at", "?at")
    at = c("at")
    whole = {"y": t.year(at), "mo": t.month(at), "dd": t.day(at), "h": t.hours(at), "mi": t.minutes(at)}
    return b.df.select(
        F.substring_index("e", "/", -1).cast("bigint").alias("k"), *[n(v, "bigint").alias(k) for k, v in whole.items()], n(t.seconds(at)).alias("se"), t.lt(at, t.now()).alias("past"),
    )


@add("""SELECT p_partkey AS k, p_size || '' AS whole, CAST(p_size AS VARCHAR) || '.0' AS double_text, CASE WHEN p_size % 4 = 0 THEN (p_size // 4) || '.0' WHEN p_size % 4 = 2 THEN (p_size // 4) || '.5'
WHEN p_size % 4 = 1 THEN (p_size // 4) || '.25' ELSE (p_size // 4) || '.75' END AS quarter FROM part""")
def number_formatting(spark, d):
    b = P.pattern(shop(spark, d), "?p", EX + "size", "?s")
    return b.df.select(
        F.substring_index("p", "/", -1).cast("bigint").alias("k"), t.text(t.add(c("s"), 0)).alias("whole"), t.text(t.add(c("s"), 0.0)).alias("double_text"),
        t.text(t.divide(c("s"), 4)).alias("quarter"),
    )


BEYOND = 9007199254740992  # the first integer whose successor is no double


@add(f"""WITH v AS (SELECT o_orderkey AS k, o_custkey AS u, CAST(o_totalprice AS DECIMAL(18, 2)) AS p FROM orders),
x AS (SELECT k, CAST(k AS HUGEINT) + {BEYOND} AS a, CAST(u AS HUGEINT) + {BEYOND} AS b, p * CAST(0.0000000001 AS DECIMAL(18, 10)) AS small FROM v)
SELECT k, a = b AS same, a < b AS less, a >= b AS no_less, CAST(a + b AS VARCHAR) AS added, CAST(a * b AS VARCHAR) AS times, CAST(-a AS VARCHAR) AS negative,
rtrim(CAST(small AS VARCHAR), '0') AS small, small < CAST(0.00001 AS DECIMAL(18, 10)) AS tiny FROM x""")
def exact_numbers(spark, d):
    b = R.read_tables(spark, d, "orders")["orders"]
    one = t.wide_integer_term(c("o_orderkey").cast("decimal(38,0)") + F.lit(BEYOND))
    two = t.wide_integer_term(c("o_custkey").cast("decimal(38,0)") + F.lit(BEYOND))
    price = t.decimal_term(c("o_totalprice").cast("decimal(18,2)"))
    small = t.multiply(price, t.literal("0.0000000001", datatype=V.DECIMAL))
    return b.select(
        c("o_orderkey").alias("k"), t.eq(one, two).alias("same"), t.lt(one, two).alias("less"), t.ge(one, two).alias("no_less"),
        t.text(t.add(one, two)).alias("added"), t.text(t.multiply(one, two)).alias("times"), t.text(t.negate(one)).alias("negative"),
        t.text(small).alias("small"), t.lt(small, t.literal("0.00001", datatype=V.DECIMAL)).alias("tiny"),
    )


@add(f"""SELECT o_custkey AS c, CAST(sum(CAST(o_orderkey AS HUGEINT) + {BEYOND}) AS VARCHAR) AS whole,
rtrim(rtrim(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2)) * CAST(0.0000000001 AS DECIMAL(18, 10))) AS VARCHAR), '0'), '.') AS small,
CAST(min(CAST(-o_orderkey AS HUGEINT) - {BEYOND}) AS VARCHAR) AS lowest FROM orders GROUP BY 1""")
def aggregate_typed_sums(spark, d):
    rows = R.read_tables(spark, d, "orders")["orders"]
    wide = c("o_orderkey").cast("decimal(38,0)") + F.lit(BEYOND)
    small = t.decimal_term(c("o_totalprice").cast("decimal(18,2)") * F.lit("0.0000000001").cast("decimal(18,10)"))
    b = Bindings(rows.select(c("o_custkey").alias("c"), t.wide_integer_term(wide).alias("w"), t.wide_integer_term(-wide).alias("m"), small.alias("s")), ["c"])
    out = A.group(b, ["c"], {"whole": A.sum_term(c("w")), "small": A.sum_term(c("s")), "lowest": A.min_(c("m"))})
    text = {x: t.text(c(x)).alias(x) for x in ("whole", "small", "lowest")}
    return out.df.select("c", *text.values())
