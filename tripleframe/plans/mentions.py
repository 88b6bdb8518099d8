"""Find term mentions in questions: known names, verb phrases, class nouns, capitalised words.

Each finder returns ``(question_id, text, kinds, source, start, end, ord)`` with 0-based character
spans; ``ord`` says in which order mentions are listed. ``extract`` merges them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.functions import text as tx
from tripleframe.operators.similarity import contained_pairs
from tripleframe.plans.linking import kind_rank
from tripleframe.plans.text_scan import Name, Scanner, jvm_tables, scanned
from tripleframe.session import stored, use_all_cores

# Phrases that point at a property and nouns that point at a class.
VERB_PHRASES = (
    r"(?iU)\b(works\s+for|knows|founded(?:\s+by)?|joined|contributes\s+to|labels?|"
    r"age|knows[\^]\+?|transitively\s+knows)\b"
)
CLASS_NOUNS = r"(?iU)\b(person|people|company|companies|project|projects|graph)\b"
CAPITAL_WORD = r"(?U)\b([A-Z][a-zA-Z0-9_-]+)\b"
LOWER_WORD = r"(?U)\b([a-z][a-zA-Z0-9_-]+)\b"

# Words that never name a schema term, even when capitalised.
STOPWORDS = [
    "the", "a", "an", "of", "and", "or", "in", "at", "for", "to", "with", "by", "from", "on", "via", "is", "are",
    "was", "were", "show", "find", "who", "which", "what", "list", "all", "every", "each", "use", "drop", "delete",
    "raw", "sparql", "graph", "query", "select", "ask", "construct", "filter", "optional", "union", "minus",
    "values", "bind", "having", "group", "order", "explicitly", "english", "norwegian", "french", "german",
    "spanish", "japanese", "chinese", "italian", "portuguese", "dutch", "swedish", "en", "nb", "no", "fr", "de",
    "es", "it", "ja", "zh", "pt", "nl", "sv", "top", "top-1", "top1", "oldest", "youngest", "after", "before",
    "greater", "less", "more", "fewer", "most", "least", "max", "min", "exactly", "than", "term", "thing", "entity",
    "item", "value",
]
# Imperative verbs that open a request.
IMPERATIVES = [
    "show", "list", "find", "use", "restrict", "drop", "return", "count", "pick", "anyone",
]

COLUMNS = ["question_id", "text", "kinds", "source", "start", "end", "ord"]


def _ord(phase: int, rank: Column | None = None, name: Column | None = None, pos: Column | None = None) -> Column:
    return F.struct(
        F.lit(phase).alias("phase"),
        (F.lit(0) if rank is None else rank).cast("int").alias("rank"),
        (F.lit("") if name is None else name).alias("name"),
        (F.lit(0) if pos is None else pos).cast("int").alias("pos"),
    ).alias("ord")


def known_names(terms: DataFrame) -> DataFrame:
    """``(needle, source, kind, iri, pos)``: lower-case names of at least two characters."""
    prefixed = F.when(F.col("kind") != "graph", F.col("prefixed_name"))
    local = tx.local_name(prefixed)
    split = F.lower(tx.split_camel(local))

    def named(c: Column, source: str) -> Column:
        return F.struct(c.alias("needle"), F.lit(source).alias("source"))

    options = F.array_distinct(
        F.array(
            named(F.lower("label"), "label"),
            named(F.lower(local), "local_name"),
            named(split, "local_name"),
            named(F.lower(tx.last_segment(F.col("iri"))), "local_name"),
        )
    )
    usable = F.filter(options, lambda x: F.length(x["needle"]) >= 2)
    return terms.select("kind", "iri", F.posexplode(usable).alias("pos", "n")).select(
        "n.needle", "n.source", "kind", "iri", "pos"
    )


def scan_names(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """First occurrence of every known name, anywhere in the text and in any case."""
    lowered = questions.select("question_id", "question", F.lower("question").alias("__q"))
    names = known_names(terms)
    hits = contained_pairs(lowered, "question_id", "__q", names, "needle", min_length=2)
    located = hits.join(lowered, "question_id").select(
        "question_id",
        "needle",
        (F.instr("__q", F.col("needle")) - 1).alias("start"),
        F.col("question").substr(F.instr("__q", F.col("needle")), F.length("needle")).alias("text"),
    )
    found = located.join(names, "needle")
    return found.select(
        "question_id",
        "text",
        F.array("kind").alias("kinds"),
        "source",
        "start",
        (F.col("start") + F.length("needle")).alias("end"),
        _ord(1, kind_rank(F.col("kind")), F.col("iri"), F.col("pos")),
    )


def _matches(questions: DataFrame, pattern: str) -> DataFrame:
    """``(question_id, token, start)`` of every match.

    Spans come from the pieces between matches, so the text is cut twice and never sent anywhere.
    """
    body = F.col("question")
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    gaps = F.transform(F.split(body, pattern, -1), F.length)
    sizes = F.transform(found, F.length)
    starts = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), sizes.alias("size")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["size"].isNull(), acc["out"])
            .otherwise(F.array_append(acc["out"], acc["at"] + x["gap"]))
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    rows = questions.where(F.rlike(body, F.lit(pattern))).select(
        "question_id",
        F.explode(F.arrays_zip(found.alias("token"), starts.alias("start"))).alias("m"),
    )
    return rows.select("question_id", "m.token", "m.start")


def _mentions(matches: DataFrame, text: Column, kinds: list[str], source: str, phase: int) -> DataFrame:
    return matches.select(
        "question_id",
        text.alias("text"),
        F.array(*[F.lit(k) for k in kinds]).alias("kinds"),
        F.lit(source).alias("source"),
        "start",
        (F.col("start") + F.length("token")).alias("end"),
        _ord(phase, pos=F.col("start")),
    )


def verb_phrases(questions: DataFrame) -> DataFrame:
    lowered = F.trim(F.lower("token"))
    return _mentions(_matches(questions, VERB_PHRASES), lowered, ["property"], "verb_phrase", 2)


def class_nouns(questions: DataFrame) -> DataFrame:
    return _mentions(_matches(questions, CLASS_NOUNS), F.lower("token"), ["class"], "class_noun", 3)


def capitalised_words(questions: DataFrame) -> DataFrame:
    """Capitalised words that are no stopword, no imperative and no ``Top-1`` style cue."""
    token = F.col("token")
    cue = F.rlike(token, F.lit(r"^[^-]*-\d+$"))
    skip = F.lower(token).isin(STOPWORDS + IMPERATIVES)
    found = _matches(questions, CAPITAL_WORD).where(~cue & ~skip)
    return _mentions(found, token, ["individual", "class"], "capitalized", 4)


def _individual_words(terms: DataFrame) -> DataFrame:
    """``(__n)``: labels and local names of individuals in lower case."""
    people = terms.where(F.col("kind") == "individual")
    names = F.array(F.lower("label"), F.lower(tx.local_name(F.col("prefixed_name"))))
    return people.select(F.explode(names).alias("__n")).where(F.col("__n").isNotNull()).distinct()


def individual_names(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """Lower-case words equal to the label or local name of an individual."""
    words = _matches(questions, LOWER_WORD).withColumn("__n", F.lower("token"))
    found = words.join(_individual_words(terms), "__n", "left_semi")
    return _mentions(found, F.col("token"), ["individual"], "individual_name", 5)


def merge(*found: DataFrame) -> DataFrame:
    """One row per question and lower-case text: all kinds and sources, first text and span.

    Repeats are folded per source before the final grouping, so its groups stay small.
    """
    rows = reduce(DataFrame.unionByName, found).withColumn("__t", F.lower(F.trim("text")))
    first = F.min_by(F.struct("text", "start", "end"), "ord").alias("first")
    partial = rows.groupBy("question_id", "__t", "kinds", "source").agg(F.min("ord").alias("ord"), first)
    listed = F.array_sort(F.collect_list(F.struct("ord", "kinds", "source", "first"))).alias("rows")
    merged = partial.groupBy("question_id", "__t").agg(listed)
    head = F.col("rows")[0]
    return merged.select(
        "question_id",
        head["first"]["text"].alias("text"),
        F.array_distinct(F.flatten(F.transform("rows", lambda r: r["kinds"]))).alias("kinds"),
        F.array_distinct(F.transform("rows", lambda r: r["source"])).alias("sources"),
        head["first"]["start"].alias("start"),
        head["first"]["end"].alias("end"),
        head["ord"].alias("ord"),
    )


# Names beyond this many bytes are not held by tasks; texts and names then meet by shuffles.
NAME_BYTES = 16 * 1024 * 1024


def _names_and_words(terms: DataFrame) -> DataFrame:
    """``(needle, kind, source, iri, pos)`` of the first term by listing order, and without a source the words of :func:`individual_names`."""
    first = F.min(F.struct("iri", "pos")).alias("first")
    names = known_names(terms).groupBy("needle", "kind", "source").agg(first).select("needle", "kind", "source", "first.iri", "first.pos")
    words = _individual_words(terms).where(F.rlike("__n", F.lit("^[a-z][a-z0-9_-]+$")))
    none = [F.lit(None).cast(names.schema[c].dataType).alias(c) for c in ("kind", "source", "iri", "pos")]
    return names.unionByName(words.select(F.col("__n").alias("needle"), *none))


def _scanner(terms: DataFrame, max_bytes: int) -> Scanner | None:
    """What tasks need to know of the terms; None if that is too much for them."""
    listed = stored(_names_and_words(terms))
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("needle", "kind", "source", "iri")]
    size = listed.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, sizes) + 16), F.lit(0))).first()[0]
    if size > max_bytes:
        return None
    rows = listed.withColumn("rank", kind_rank(F.col("kind")).cast("int")).collect()
    names = [Name(r["needle"], r["kind"], r["source"], r["rank"], r["iri"], r["pos"]) for r in rows if r["source"] is not None]
    words = [r["needle"] for r in rows if r["source"] is None]
    return Scanner(names, words, STOPWORDS + IMPERATIVES, VERB_PHRASES, CLASS_NOUNS, jvm_tables(terms.sparkSession))


def extract(questions: DataFrame, terms: DataFrame, max_bytes: int = NAME_BYTES) -> DataFrame:
    """All mentions of all questions; sort by ``ord`` within a question for the listing order.

    With names that fit a task all finders go over a text at once and merge its mentions there: texts and mentions are
    not shuffled. Only questions that share their key are merged by a shuffle.
    """
    scanner = _scanner(terms, max_bytes)
    if scanner is None:
        return merge(
            scan_names(questions, terms),
            verb_phrases(questions),
            class_nouns(questions),
            capitalised_words(questions),
            individual_names(questions, terms),
        )
    counted = questions.groupBy(F.col("question_id").alias("__id")).agg(F.count(F.lit(1)).alias("__rows"))
    shared = stored(counted.where("__rows > 1").select("__id"))
    spread = use_all_cores(questions, "question_id")
    if shared.isEmpty():
        return scanned(spread, scanner, merged=True)
    same = F.col("question_id").eqNullSafe(F.col("__id"))
    own = scanned(spread.join(shared, same, "left_anti"), scanner, merged=True)
    return own.unionByName(merge(scanned(spread.join(shared, same, "left_semi"), scanner, merged=False)))
