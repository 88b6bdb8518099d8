"""Schema discovery and the readers and writers, over data taken from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.plans import discovery
from tripleframe.queries import iri, once, registry
from tripleframe.queries.graph import EX, documents, melted_shop
from tripleframe.session import shared_path
from tripleframe.sources import rdf, records, results
from tripleframe.sources import relational as R

add = registry.add
c = F.col

X = "http://www.w3.org/2001/XMLSchema#"
_SPECS = [
    ("region", "r_regionkey", "Region", [(V.RDFS_LABEL, "r_name", X + "string")]),
    ("nation", "n_nationkey", "Nation", [(V.RDFS_LABEL, "n_name", X + "string"), (EX + "inRegion", iri("region", "n_regionkey"), None)]),
    ("customer", "c_custkey", "Customer", [(V.RDFS_LABEL, "c_name", X + "string"), (EX + "inNation", iri("nation", "c_nationkey"), None), (EX + "balance", "''", X + "double"), (EX + "segment", "c_mktsegment", V.RDF + "langString")]),
    ("supplier", "s_suppkey", "Supplier", [(V.RDFS_LABEL, "s_name", X + "string"), (EX + "inNation", iri("nation", "s_nationkey"), None), (EX + "balance", "''", X + "double")]),
    ("part", "p_partkey", "Part", [(V.RDFS_LABEL, "p_name", X + "string"), (EX + "brand", "p_brand", X + "string"), (EX + "size", "''", X + "integer"), (EX + "price", "''", X + "double")]),
    ("orders", "o_orderkey", "Order", [(EX + "placedBy", iri("customer", "o_custkey"), None), (EX + "status", "o_orderstatus", X + "string"), (EX + "total", "''", X + "double"), (EX + "placedOn", "''", X + "dateTime")]),
]


def _quads_sql() -> str:
    parts = []
    for table, key, kind, props in _SPECS:
        subject = iri("order" if table == "orders" else table, key)
        for p, o, dt in [(V.RDF_TYPE, f"'{EX}{kind}'", None), *props]:
            parts.append(f"SELECT {subject} AS s, '{p}' AS p, {o} AS o, {repr(dt) if dt else 'NULL'} AS dt FROM {table}")
    return "q AS (" + " UNION ALL ".join(parts) + f"), ty AS (SELECT s, o AS k FROM q WHERE p = '{V.RDF_TYPE}'), lb AS (SELECT s, min(o) AS l FROM q WHERE p = '{V.RDFS_LABEL}' GROUP BY s)"


_Q = "WITH " + _quads_sql()
_DOM = "SELECT DISTINCT q.p, k FROM q JOIN ty ON q.s = ty.s"
_RNG = "SELECT DISTINCT p, dt AS k FROM q WHERE dt IS NOT NULL UNION SELECT DISTINCT q.p, k FROM q JOIN ty ON q.o = ty.s WHERE dt IS NULL"


@add(f"{_Q} SELECT DISTINCT k AS iri, 'ex:' || substr(k, 20) AS prefixed_name, l AS label FROM ty LEFT JOIN lb ON lb.s = k")
def discover_classes(spark, d):
    found = discovery.with_prefixed_names(discovery.classes(melted_shop(spark, d)), {**V.DEFAULT_PREFIXES, "ex": EX})
    return found.select("iri", "prefixed_name", "label")


@add(f"""{_Q}, dm AS (SELECT p, string_agg(k, ',' ORDER BY k) AS v FROM ({_DOM}) GROUP BY p), rg AS (SELECT p, string_agg(k, ',' ORDER BY k) AS v FROM ({_RNG}) GROUP BY p)
SELECT x.p AS iri, NULL AS label, '' AS domain, coalesce(dm.v, '') AS observed_domain, coalesce(rg.v, '') AS observed_range FROM (SELECT DISTINCT p FROM q) x LEFT JOIN dm ON dm.p = x.p LEFT JOIN rg ON rg.p = x.p""")
def discover_properties(spark, d):
    found = discovery.properties(melted_shop(spark, d))
    return found.select("iri", "label", *[F.array_join(x, ",").alias(x) for x in ("domain", "observed_domain", "observed_range")])


@add(f"{_Q} {_DOM.replace('q.p, k', 'q.p AS iri, k AS type')}")
def discover_observed_domain(spark, d):
    return discovery.observed_domain(melted_shop(spark, d))


@add(f"{_Q} SELECT p AS iri, k AS type FROM ({_RNG})")
def discover_observed_range(spark, d):
    return discovery.observed_range(melted_shop(spark, d))


@add("SELECT 'http://example.org/' || lang AS iri, string_agg(DISTINCT 'http://example.org/' || source, ',' ORDER BY 'http://example.org/' || source) AS domain, 'http://example.org/Text' AS range FROM documents GROUP BY lang")
def discover_declared_domain_range(spark, d):
    docs = R.read_tables(spark, d, "documents")["documents"].select("lang", "source").distinct()
    stated = R.triples(docs, F.concat(F.lit(EX), c("lang")), {V.RDFS + "domain": F.concat(F.lit(EX), c("source")), V.RDFS + "range": F.lit(EX + "Text")})
    found = discovery.declared_domain_range(stated)
    return found.select("iri", F.array_join("domain", ",").alias("domain"), F.array_join("range", ",").alias("range"))


@add(f"{_Q} SELECT ty.s AS iri, min(l) AS label, min(k) AS type FROM ty LEFT JOIN lb ON lb.s = ty.s GROUP BY 1")
def discover_individuals(spark, d):
    return discovery.individuals(melted_shop(spark, d)).select("iri", "label", c("types")[0].alias("type"))


@add(f"{_Q} SELECT DISTINCT s AS iri FROM q WHERE p = '{V.RDFS_LABEL}' AND s NOT IN (SELECT s FROM ty WHERE k IN ('{EX}Customer', '{EX}Part'))")
def remove_schema_terms(spark, d):
    g = melted_shop(spark, d)
    labelled = g.where(c("p") == V.RDFS_LABEL).select(c("s").alias("iri")).distinct()
    of = lambda k: g.where((c("p") == V.RDF_TYPE) & (c("o") == EX + k)).select(c("s").alias("iri"))
    return discovery.remove_schema_terms(labelled, of("Customer"), of("Part"))


@add(f"SELECT DISTINCT {iri('graph', 'source')} AS iri FROM documents")
def discover_named_graphs(spark, d):
    return discovery.named_graphs(documents(spark, d).quads).select("iri")


@once
def shop_snapshot(spark, d):
    return discovery.snapshot(melted_shop(spark, d).unionByName(documents(spark, d).quads))


@add(f"""{_Q} SELECT 'class' AS kind, count(DISTINCT k) AS n FROM ty UNION ALL SELECT 'property', count(DISTINCT p) FROM q
UNION ALL SELECT 'individual', count(DISTINCT s) FROM ty UNION ALL SELECT 'graph', count(DISTINCT source) FROM documents""")
def schema_status(spark, d):
    return discovery.status(shop_snapshot(spark, d))


@add(f"""{_Q} SELECT x.p AS iri, 'property' AS kind, coalesce(string_agg(DISTINCT dm.k, ',' ORDER BY dm.k), '') AS domain, 'schema_snapshot' AS source FROM (SELECT DISTINCT p FROM q) x LEFT JOIN ({_DOM}) dm ON dm.p = x.p GROUP BY x.p
UNION ALL SELECT DISTINCT {iri('graph', 'source')}, 'graph', '', 'schema_snapshot' FROM documents""")
def schema_concepts(spark, d):
    found = discovery.concepts(shop_snapshot(spark, d)).where(c("kind").isin("property", "graph"))
    return found.select("iri", "kind", F.array_join("domain", ",").alias("domain"), "source")


@add(f"""{_Q} SELECT 'class' AS kind, count(DISTINCT k) AS n, 'second' AS from_run FROM ty WHERE k <> '{EX}Customer'
UNION ALL SELECT 'property', count(DISTINCT p), 'first' FROM q
UNION ALL SELECT 'individual', count(DISTINCT s), 'second' FROM ty WHERE k <> '{EX}Customer'""")
def snapshot_after_failed_refresh(spark, d):
    """A refresh, a second one over fewer rows whose properties fail, then what a reader finds."""
    g = melted_shop(spark, d)
    path = shared_path(spark)
    first, _, _ = discovery.refresh(spark, g, path)
    started = first.agg(F.max("last_refresh_at")).first()[0]

    def fewer(quads):
        customers = c("s").startswith(EX + "customer/") & (c("p") == V.RDF_TYPE)
        made = discovery.sections(quads.where(~customers))
        return {**made, "property": made["property"].withColumn("label", F.raise_error(F.lit("fails")))}

    discovery.refresh(spark, g, path, force=True, build=fewer)
    run = F.when(c("last_refresh_at") == F.lit(started), "first").otherwise("second")
    found = discovery.stored_snapshot(spark, path).withColumn("from_run", run)
    return found.groupBy("kind", "from_run").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", "from_run")


# ---- readers and writers --------------------------------------------------------------------


@add(f"SELECT {iri('doc', 'doc_id')} AS s, md5(text) AS hash, lang, {iri('graph', 'source')} AS g FROM documents")
def statements_round_trip(spark, d):
    lines = rdf.statement_lines(documents(spark, d).where(c("p").endswith("title")))
    back = rdf.parse_statements(lines).where("s IS NOT NULL")
    return back.select("s", F.md5(t.text(c("o"))).alias("hash"), t.lang_text(c("o")).alias("lang"), "g")


def _result_documents(spark, d):
    """One result document per order; a quarter of them broken in different ways."""
    o = R.read_tables(spark, d, "orders")["orders"]
    part = F.when(c("o_orderpriority") == "1-URGENT", F.lit("typed-literal")).otherwise(F.lit("literal"))
    value = lambda kind, v, dt: F.struct(kind.alias("type"), v.alias("value"), dt.alias("datatype"))
    row = F.struct(
        value(F.lit("uri"), R.entity("order", "o_orderkey"), F.lit(None).cast("string")).alias("x"),
        value(part, c("o_totalprice").cast("string"), F.lit(X + "double")).alias("y"),
    )
    rows = F.when(c("o_orderstatus") != "P", F.to_json(F.struct(F.struct(F.array(F.lit("x"), F.lit("y")).alias("vars")).alias("head"), F.struct(F.array(row).alias("bindings")).alias("results"))))
    broken = F.when(c("o_custkey") % 2 == 0, F.lit('{"head":{"vars":["x"]},"results":{"bindings":7}}')).otherwise(F.lit('{"boolean":true}'))
    return o.select(R.entity("order", "o_orderkey").alias("source"), F.coalesce(rows, broken).alias("document"))


@add(f"SELECT {iri('order', 'o_orderkey')} AS x, round(o_totalprice, 2) AS y FROM orders WHERE o_orderstatus <> 'P'")
def read_result_documents(spark, d):
    b = results.select_bindings(_result_documents(spark, d), ["x", "y"])
    return b.df.select("x", F.round(t.num(c("y")), 2).alias("y"))


@add("""SELECT CASE WHEN o_orderstatus <> 'P' THEN NULL WHEN o_custkey % 2 = 0 THEN 'missing results.bindings array' ELSE 'missing head.vars' END AS error,
CASE WHEN o_orderstatus <> 'P' OR o_custkey % 2 = 0 THEN NULL ELSE true END AS answer, count(*) AS n FROM orders GROUP BY 1, 2""")
def check_result_documents(spark, d):
    asked = results.check_ask(_result_documents(spark, d)).drop("error")
    return results.check_select(asked).groupBy("error", "answer").agg(F.count(F.lit(1)).alias("n"))


@add("""SELECT 'http://example.org/part/' || p_partkey AS iri, CASE WHEN p_type = 'LARGE' THEN 'class' ELSE 'unknown' END AS kind, p_name AS aliases, CAST(p_size AS VARCHAR) AS extra, CAST(1 AS BIGINT) AS domains FROM part WHERE p_type <> 'PROMO'""")
def read_concept_payloads(spark, d):
    part = R.read_tables(spark, d, "part")["part"]
    payload = F.to_json(
        F.struct(
            F.when(c("p_type") != "PROMO", R.entity("part", "p_partkey")).alias("iri"),
            F.when(c("p_type") == "LARGE", F.lit("class")).otherwise(F.lit("widget")).alias("kind"),
            c("p_name").alias("aliases"), F.array("p_brand").alias("domain"), c("p_size").alias("size"),
        )
    )
    good, _ = records.concepts_from_payloads(part.select(payload.alias("payload")))
    return good.select("iri", "kind", F.array_join("aliases", ",").alias("aliases"), c("metadata")["size"].alias("extra"), F.size("domain").cast("bigint").alias("domains"))


@add("""SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://(?:[^/@]*@)?([^/:?#]+)', 1)) ||
CASE WHEN regexp_extract(url, '^[^:]+://(?:[^/@]*@)?[^/:?#]+:([0-9]+)', 1) <> '' THEN ':' || regexp_extract(url, '^[^:]+://(?:[^/@]*@)?[^/:?#]+:([0-9]+)', 1) ELSE '' END ||
regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS shown FROM pages""")
def redact_addresses(spark, d):
    pages = R.read_tables(spark, d, "pages")["pages"]
    return pages.select("page_id", records.redact_url(c("url")).alias("shown"))
