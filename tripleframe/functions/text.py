"""Names and text: normal forms, tokens, segments. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular plurals of common class nouns.
LEMMAS = {
    "people": "person",
    "persons": "person",
    "companies": "company",
    "organisations": "organisation",
    "organizations": "organization",
    "projects": "project",
    "employees": "employee",
    "graphs": "graph",
}


def lemma(token: Column) -> Column:
    """Singular of one lower-case word. Words of up to four letters and ss/us/is/os stay."""
    irregular = F.create_map(*[F.lit(x) for kv in LEMMAS.items() for x in kv])[token]
    size = F.length(token)
    plural = (
        (size > 4)
        & token.endswith("s")
        & ~F.substring(token, -2, 2).isin("ss", "us", "is", "os")
    )
    regular = (
        F.when((size > 4) & token.endswith("ies"), F.concat(token.substr(F.lit(1), size - 3), F.lit("y")))
        .when(plural, token.substr(F.lit(1), size - 1))
        .otherwise(token)
    )
    return F.coalesce(irregular, regular)


def normalise(c: Column) -> Column:
    """Lower case, punctuation to single spaces, every word in the singular."""
    words = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.when(words == "", words).otherwise(
        F.array_join(F.transform(F.split(words, " "), lemma), " ")
    )


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")


def local_name(prefixed: Column) -> Column:
    """What follows the first colon; the whole name when there is none."""
    return F.when(
        prefixed.contains(":"), prefixed.substr(F.instr(prefixed, ":") + 1, F.length(prefixed))
    ).otherwise(prefixed)


def last_segment(iri: Column) -> Column:
    """Last part of an IRI after ``/`` or ``#``, ignoring trailing ones."""
    return F.regexp_extract(iri, r"(?s)([^#/]*)[#/]*$", 1)


def last_path_segment(iri: Column) -> Column:
    """Last part after ``/`` only, so a fragment stays attached."""
    return F.substring_index(F.regexp_replace(iri, "[#/]+$", ""), "/", -1)


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def grams(c: Column, size: int) -> Column:
    """Distinct overlapping substrings of ``size`` characters, in one pass over the text."""
    return F.array_distinct(
        F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    )


def non_empty(*parts: Column) -> Column:
    """Array of the parts that are neither NULL nor empty, in order."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))
