"""Personal data: fixed patterns, then information-theoretic sanitisation of what surrounds them.

``base_spans`` finds e-mail addresses, IP addresses, card and phone numbers, leftmost and non-overlapping for each kind.
Java's matcher gives no offsets here, so a text is split at its matches and the lengths are added up. The patterns are
written with possessive quantifiers and anchored runs: same matches, but no backtracking and no deep recursion.

The found values are the protected entities. A term in a document with an entity gives it away when knowing the term says
much about the entity: with documents as events, information(term; entity) = log2(n(both) * N / (n(term) * n(entity))) is
compared with all there is to know, log2(N / n(entity)). From ``GENERALISE`` of it on a term is generalised, from
``REMOVE`` on removed, provided that at least ``SUPPORT`` documents show it together with the entity; in one document
alone everything would reveal everything. All counts are over whole documents, and every occurrence of a term in a
document with the entity is marked. Terms are whole words outside all base spans, of any length.

Texts are read twice (spans and, where there is one, the words; in how many documents the terms occur) and never
shuffled; the distinct words of documents with an entity are, and pairs are built only for entities in ``SUPPORT``
documents, since no other can reach it. Pairs meet their counts in equi-joins, so a frequent entity is a row.

Defined results: null text is empty and has no spans. Repeated rows get equal results and each counts as a document. Rows
without doc_id are treated like others. An empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.common import bind, only, words, written

_LOCAL = "[A-Za-z0-9._%+-]"
# kind -> pattern, in the order of the list of kinds
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TERM = "term"
BLOCK = 128
SUPPORT = 2
GENERALISE = 0.5
REMOVE = 0.9
PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"


def found(text: Column, pattern: str) -> Column:
    """Every match as (start, end, value), code points, end exclusive."""

    def place(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        summed = F.aggregate(
            F.sequence(F.lit(0), F.size(hits) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda acc, i: F.struct(
                (acc["at"] + F.length(F.get(gaps, i)) + F.length(F.get(hits, i))).alias("at"),
                F.array_append(acc["starts"], acc["at"] + F.length(F.get(gaps, i))).alias("starts"),
            ),
        )["starts"]
        return F.zip_with(
            summed,
            hits,
            lambda s, h: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.alias("value")),
        )

    none = F.array().cast("array<struct<start: int, end: int, value: string>>")
    return bind(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, none).otherwise(
            bind(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps")), place)
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits, every second from the right doubled, add up to a multiple of ten."""
    backwards = F.split(F.reverse(_digits(value)), "")

    def weighed(d: Column, i: Column) -> Column:
        digit = d.cast("int")
        return F.when(i % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.transform(backwards, weighed), F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda part: part.rlike(PART))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid matches of all kinds as (start, rank of kind, end, kind, value), in that order."""
    def of_kind(kind: str) -> Column:
        good = F.filter(found(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
        return F.transform(
            good,
            lambda x: F.struct(
                x["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                x["end"].alias("end"),
                F.lit(kind).alias("kind"),
                x["value"].alias("value"),
            ),
        )

    return F.array_sort(F.concat(*[of_kind(kind) for kind in KINDS]))


def entity_of(span: Column) -> Column:
    """The protected entity that a span names: numbers by their digits, addresses in lower case."""
    number = span["kind"].isin("card", "phone")
    value = F.when(number, _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def placed_words(text: Column, spans: Column, block: int = BLOCK) -> Column:
    """(term, start, end) of the words outside all base spans, in order.

    Lengths are added up for blocks of pieces first, so a long text costs no quadratic copying.
    """

    def in_block(pieces: Column, begin: Column) -> Column:
        return F.aggregate(
            pieces,
            F.struct(begin.alias("at"), F.array().cast("array<struct<term: string, start: int, end: int>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x) + 1).alias("at"),
                F.when(F.length(x) == 0, acc["out"])
                .otherwise(
                    F.array_append(
                        acc["out"],
                        F.struct(x.alias("term"), acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end")),
                    )
                )
                .alias("out"),
            ),
        )["out"]

    def of_blocks(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, w: acc + F.length(w) + 1))
        begins = F.aggregate(
            sizes,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        )["out"]
        return F.flatten(F.zip_with(blocks, begins, in_block))

    def cut(pieces: Column) -> Column:
        count = F.ceil(F.size(pieces) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(pieces, i * block + 1, F.lit(block)))

    blocks = bind(F.split(text, "[\\x20\\x09-\\x0D]", -1), cut)
    return F.filter(
        bind(blocks, of_blocks), lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    )


def disclosing_terms(near: DataFrame, entities: DataFrame, texts: DataFrame, documents: Column | int) -> DataFrame:
    """(entity, term, share) of the distinct (row, entity, term) in ``near``: how much of the entity the term gives away.

    ``entities`` has (entity, n_entity), in how many documents each occurs.
    """
    together = near.groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= SUPPORT)
    asked = together.select("term").distinct()
    everywhere = (
        texts.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_term"))
    )
    counted = together.join(entities, "entity").join(everywhere.join(asked, "term"), "term")
    n = F.lit(documents) if isinstance(documents, int) else documents
    known = F.log2(F.col("n_both") * n / (F.col("n_term") * F.col("n_entity")))
    all_there_is = F.log2(n / F.col("n_entity"))
    return counted.select("entity", "term", F.when(all_there_is > 0, known / all_there_is).otherwise(F.lit(0.0)).alias("share"))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, base, terms) for each row of ``docs``: base spans, and terms with what is to be done to them."""
    texts = only(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    spotted = written(
        texts.select("doc_id", "text", base_spans(F.col("text")).alias("base")).select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            "base",
            F.when(F.size("base") > 0, placed_words(F.col("text"), F.col("base"))).alias("words"),
        )
    )
    holders = spotted.filter("size(base) > 0")
    named = holders.select("row", F.explode(F.array_distinct(F.transform("base", entity_of))).alias("entity"))
    entities = named.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= SUPPORT)
    held = holders.select("row", F.explode(F.array_distinct(F.transform("words", lambda x: x["term"]))).alias("term"))
    near = written(named.join(entities.select("entity"), "entity").join(held, "row").select("row", "entity", "term"))
    shares = disclosing_terms(near, entities, texts, spotted.count()).filter(F.col("share") >= GENERALISE)
    action = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")
    marked = near.join(shares, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))
    terms = (
        holders.select("row", F.explode("words").alias("x"))
        .select("row", "x.*")
        .join(marked, ["row", "term"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", action.alias("action")))).alias("terms"))
    )
    none = F.array().cast("array<struct<start: int, end: int, action: string>>")
    return spotted.select("doc_id", "row", "base").join(terms, "row", "left").withColumn("terms", F.coalesce("terms", none))


def described(base: Column, terms: Column | None = None) -> Column:
    """kind:start:end of all spans, by start, then kind, joined by commas."""
    spans = F.transform(base, lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s["end"].alias("c"), s["kind"].alias("k")))
    if terms is not None:
        added = F.transform(
            terms, lambda s: F.struct(s["start"].alias("a"), F.lit(len(KINDS)).alias("b"), s["end"].alias("c"), F.lit(TERM).alias("k"))
        )
        spans = F.array_sort(F.concat(spans, added))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans and terms replaced: kinds in brackets, generalised terms by their length, removed ones gone."""
    pieces = F.array_sort(
        F.concat(
            F.transform(base, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("c"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("by"))),
            F.transform(
                terms,
                lambda s: F.struct(
                    s["start"].alias("a"), s["end"].alias("c"), F.when(s["action"] == "remove", "").otherwise("[term]").alias("by")
                ),
            ),
        )
    )
    done = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["a"] < acc["at"], F.struct(F.greatest(acc["at"], s["c"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(
                s["c"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), s["by"]).alias("out"),
            )
        ),
    )
    return bind(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))


def counts_and_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_<kind>, base_sha256, spans, n_terms) of every row."""
    spotted = personal_data(docs, doc_id, text)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return spotted.select(
        "doc_id",
        *counts,
        F.sha2(described(F.col("base")), 256).alias("base_sha256"),
        described(F.col("base"), F.col("terms")).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
