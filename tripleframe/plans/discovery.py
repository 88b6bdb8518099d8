"""Describe a graph: classes, properties, observed domains and ranges, individuals, graphs.

Everything is computed over the whole default graph and ordered before any cap, so repeated runs
agree. Caps are off unless asked for.

All sections come from one table, the :class:`Profile`: for every node the sets of its types, of the predicates it is
subject of and of those it is object of. One scan and one shuffle by node make it, with sets combined before the
shuffle, so a node that a third of all rows mention sends one small row from each task. Nodes with the same sets are one
characteristic set; domains and ranges are read from these few rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.operators.patterns import Graph, active_graph, all_quads, to_prefixed
from tripleframe.session import cut_lineage

# What declares a class or a property, and what labels a thing.
CLASS_TYPES = [V.RDFS + "Class", V.OWL + "Class"]
PROPERTY_TYPES = [V.RDF + "Property", V.OWL + "ObjectProperty", V.OWL + "DatatypeProperty"]
LABEL_PREDICATES = [V.RDFS_LABEL, V.SKOS + "prefLabel"]
# Interactive caps.
CAPS = {"class": 200, "property": 500, "individual": 200, "graph": 200}

TERM_SCHEMA = (
    "kind string, iri string, prefixed_name string, label string, description string, "
    "aliases array<string>, domain array<string>, range array<string>, "
    "observed_domain array<string>, observed_range array<string>, types array<string>"
)


def node_sets(quads: Graph) -> DataFrame:
    """One row for each node of the default graph.

    ``outs``: predicates it is subject of, each with the datatype of its literals or with none where the object is a node.
    ``ins``: predicates it is object of. ``types``, ``domain``, ``range``: objects of the statements about it. ``label``: its
    smallest label, ``any_label``: also of other labelling predicates. The sizes of the sets are those of a schema.
    """
    p, o = F.col("p"), F.col("o")

    def when(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    nothing = F.lit(None).cast("string")
    own = F.struct(
        F.col("s").alias("node"), F.struct(p.alias("p"), t.datatype_iri(o).alias("type")).alias("out"), nothing.alias("in"),
        when(p == V.RDF_TYPE, o).alias("type"),
        when(p == V.RDFS + "domain", o).alias("domain"),
        when(p == V.RDFS + "range", o).alias("range"),
        when(p == V.RDFS_LABEL, t.text(o)).alias("label"),
        when(p.isin(LABEL_PREDICATES), t.text(o)).alias("any_label"),
    )
    far = F.struct(
        when(~t.is_literal(o), o).alias("node"), F.lit(None).cast("struct<p:string,type:string>").alias("out"), p.alias("in"),
        *[nothing.alias(x) for x in ("type", "domain", "range", "label", "any_label")],
    )
    facts = active_graph(quads).where(p.isNotNull()).select(F.explode(F.array(own, far)).alias("x")).select("x.*")
    # Literals are no nodes: what is known of them lies with their subjects.
    facts = facts.where(F.col("node").isNotNull() | F.col("out").isNotNull())
    sets = {"outs": "out", "ins": "in", "types": "type", "domain": "domain", "range": "range"}
    return facts.groupBy("node").agg(
        *[F.sort_array(F.collect_set(c)).alias(name) for name, c in sets.items()], F.min("label").alias("label"), F.min("any_label").alias("any_label")
    )


class Profile:
    """The nodes of a graph with their sets, written once; every section below takes a graph or its profile.

    Written beside them are the few rows that the sections read again and again: the characteristic sets, and the nodes
    that are declared to be a class or a property.
    """

    def __init__(self, quads: Graph) -> None:
        self.nodes = cut_lineage(node_sets(quads))
        self.characteristic = cut_lineage(self.nodes.groupBy("outs", "ins", "types").agg(F.count("*").alias("n")))
        self.declared = cut_lineage(self.nodes.where(_is_any(CLASS_TYPES + PROPERTY_TYPES)).select("node", "types"))

    def labels(self, terms: DataFrame) -> DataFrame:
        """``(iri, label)`` of distinct terms ``(iri)``."""
        labels = self.nodes.where(F.col("node").isNotNull() & F.col("label").isNotNull()).select(F.col("node").alias("iri"), "label")
        return terms.join(labels, "iri", "left")


def profiled(graph: Graph | Profile) -> Profile:
    return graph if isinstance(graph, Profile) else Profile(graph)


def _cap(df: DataFrame, cap: int | None, key: str = "iri") -> DataFrame:
    return df if cap is None else df.orderBy(key).limit(cap)


def _is_any(kinds: list[str]) -> Column:
    return F.arrays_overlap("types", F.array(*[F.lit(k) for k in kinds]))


def _named_or_declared(profile: Profile, used: str, kinds: list[str]) -> DataFrame:
    """IRIs in the sets of the named column, and nodes that are declared to be one."""
    named = profile.characteristic.select(F.explode(used).alias("iri"))
    declared = profile.declared.where(_is_any(kinds)).select(F.col("node").alias("iri"))
    return named.distinct().unionByName(declared).where(t.is_iri(F.col("iri"))).distinct()


def classes_only(quads: Graph | Profile) -> DataFrame:
    """Class IRIs without their labels: declared ones and everything used as a type."""
    return _named_or_declared(profiled(quads), "types", CLASS_TYPES)


def classes(quads: Graph | Profile, cap: int | None = None) -> DataFrame:
    """Declared classes and everything used as a type: ``(iri, label)``."""
    profile = profiled(quads)
    return _cap(profile.labels(classes_only(profile)), cap)


def property_names(quads: Graph | Profile) -> DataFrame:
    return _named_or_declared(profiled(quads), "outs.p", PROPERTY_TYPES)


def declared_domain_range(quads: Graph | Profile) -> DataFrame:
    """``(iri, domain, range)`` as stated in the graph."""
    stated = profiled(quads).nodes.where((F.size("domain") > 0) | (F.size("range") > 0))
    return stated.where(t.is_iri(F.col("node"))).select(F.col("node").alias("iri"), "domain", "range")


def observed_domain(quads: Graph | Profile) -> DataFrame:
    """``(iri, type)``: types of the subjects a predicate is used with."""
    used = profiled(quads).characteristic.select(F.explode("outs.p").alias("iri"), "types")
    return used.select("iri", F.explode("types").alias("type")).distinct()


def observed_range(quads: Graph | Profile) -> DataFrame:
    """``(iri, type)``: types of the objects, and datatypes of literal objects."""
    profile = profiled(quads)
    used = profile.characteristic.select(F.explode("ins").alias("iri"), "types")
    typed = used.select("iri", F.explode("types").alias("type"))
    literals = profile.characteristic.select(F.explode("outs").alias("x")).where("x.type IS NOT NULL")
    return literals.select(F.col("x.p").alias("iri"), "x.type").unionByName(typed).distinct()


def properties(quads: Graph | Profile, cap: int | None = None) -> DataFrame:
    """``(iri, label, domain, range, observed_domain, observed_range)``."""
    profile = profiled(quads)
    base = _cap(profile.labels(property_names(profile)), cap)

    def gathered(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.groupBy("iri").agg(F.sort_array(F.collect_set("type")).alias(name))

    out = (
        base.join(declared_domain_range(profile), "iri", "left")
        .join(gathered(observed_domain(profile), "observed_domain"), "iri", "left")
        .join(gathered(observed_range(profile), "observed_range"), "iri", "left")
    )
    empty = F.array().cast("array<string>")
    lists = ["domain", "range", "observed_domain", "observed_range"]
    return out.select("iri", "label", *[F.coalesce(c, empty).alias(c) for c in lists])


def individuals(quads: Graph | Profile, cap: int | None = None) -> DataFrame:
    """Typed resources that are neither a class nor a property: ``(iri, label, types)``.

    The exclusion uses the complete class and property sets, not capped ones.
    """
    profile = profiled(quads)
    typed = profile.nodes.where((F.size("types") > 0) & t.is_iri(F.col("node"))).select(
        F.col("node").alias("iri"), F.col("any_label").alias("label"), F.slice("types", 1, 1).alias("types")
    )
    schema = classes_only(profile).unionByName(property_names(profile))
    return _cap(typed.join(schema, "iri", "left_anti"), cap)


def remove_schema_terms(found: DataFrame, *schema_sets: DataFrame) -> DataFrame:
    """Drop individuals whose IRI is a class or a property."""
    known = reduce(DataFrame.unionByName, [s.select("iri") for s in schema_sets])
    return found.join(known, "iri", "left_anti")


def named_graphs(quads: Graph, cap: int | None = None) -> DataFrame:
    found = all_quads(quads).where(F.col("g").isNotNull()).select(F.col("g").alias("iri")).distinct()
    return _cap(found.withColumn("label", F.lit(None).cast("string")), cap)


def with_prefixed_names(terms: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    return terms.withColumn("prefixed_name", to_prefixed(F.col("iri"), prefixes))


def sections(quads: Graph, caps: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The parts of a snapshot; all but the graphs come from one profile."""
    caps, profile = caps or {}, Profile(quads)
    return {
        "class": classes(profile, caps.get("class")),
        "property": properties(profile, caps.get("property")),
        "individual": individuals(profile, caps.get("individual")),
        "graph": named_graphs(quads, caps.get("graph")),
    }


def _as_terms(kind: str, found: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A section in the columns of ``TERM_SCHEMA``."""
    rows = with_prefixed_names(found, prefixes or {**V.DEFAULT_PREFIXES, "ex": V.EX})
    empty = F.array().cast("array<string>")
    lists = ["domain", "range", "observed_domain", "observed_range", "types"]
    return rows.select(
        F.lit(kind).alias("kind"), "iri", "prefixed_name", "label",
        F.lit(None).cast("string").alias("description"),
        empty.alias("aliases"),
        *[F.coalesce(c, empty).alias(c) if c in rows.columns else empty.alias(c) for c in lists],
    )


def snapshot(
    quads: Graph,
    prefixes: dict[str, str] | None = None,
    caps: dict[str, int] | None = None,
) -> DataFrame:
    """All schema terms in one table, see ``TERM_SCHEMA``."""
    return reduce(DataFrame.unionByName, [_as_terms(k, df, prefixes) for k, df in sections(quads, caps).items()])


def status(terms: DataFrame) -> DataFrame:
    """Number of terms per section; a section without terms counts zero."""
    spark = terms.sparkSession
    kinds = spark.createDataFrame([(k,) for k in CAPS], "kind string")
    counted = terms.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


_POINTER = "section string, version string, at timestamp"
_STAMPED = TERM_SCHEMA + ", last_refresh_at timestamp"


def _pointers(spark: SparkSession, path: str) -> list:
    """The newest version of each section, or nothing where no refresh has ended yet."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(_POINTER).parquet(f"{path}/current")
        return rows.groupBy("section").agg(F.max_by("version", "at").alias("version"), F.max("at").alias("at")).collect()
    except AnalysisException:
        return []


def stored_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last good version of every section; empty before the first refresh."""
    found = [spark.read.schema(_STAMPED).parquet(f"{path}/data/{r['version']}/{r['section']}") for r in _pointers(spark, path)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _STAMPED)


def refresh(
    spark: SparkSession,
    quads: Graph,
    path: str,
    ttl_seconds: float = 300.0,
    force: bool = False,
    build: Callable[[Graph], dict[str, DataFrame]] = sections,
) -> tuple[DataFrame, bool, dict[str, str]]:
    """Stored snapshot, recomputed when older than the time to live.

    Returns ``(terms, recomputed, diagnostics)``. Every refresh writes new folders, then one pointer row for each
    section that succeeded, so readers see whole sections only. A section that fails keeps its last good version and
    leaves its message.
    """
    from pyspark.errors import PySparkException

    path = path.rstrip("/")
    if not force:
        newest = max((r["at"] for r in _pointers(spark, path)), default=None)
        if newest is not None:
            age = F.current_timestamp() - F.make_dt_interval(secs=F.lit(ttl_seconds))
            if spark.range(1).select((F.lit(newest) > age).alias("fresh")).first()["fresh"]:
                return stored_snapshot(spark, path), False, {}
    stamped_at = spark.range(1).select(F.current_timestamp().alias("now")).first()["now"]
    version, diagnostics, done = uuid.uuid4().hex, {}, []
    for kind, found in build(quads).items():
        part = _as_terms(kind, found).withColumn("last_refresh_at", F.lit(stamped_at))
        try:
            part.write.parquet(f"{path}/data/{version}/{kind}")
            done.append((kind, version, stamped_at))
        except PySparkException as e:
            diagnostics[kind] = str(e).splitlines()[0]
    if done:
        spark.createDataFrame(done, _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/current")
    return stored_snapshot(spark, path), True, diagnostics


def concepts(terms: DataFrame) -> DataFrame:
    """Schema terms as concepts; declared and observed domains and ranges are put together."""
    kind = F.col("kind")
    empty = F.array().cast("array<string>")
    return terms.select(
        "iri", "prefixed_name", "label", "aliases", "kind", "description",
        F.when(kind == "property", F.concat("domain", "observed_domain"))
        .when(kind == "individual", F.col("types"))
        .otherwise(empty)
        .alias("domain"),
        F.when(kind == "property", F.concat("range", "observed_range")).otherwise(empty).alias("range"),
        empty.alias("examples"),
        F.lit("schema_snapshot").alias("source"),
    )
