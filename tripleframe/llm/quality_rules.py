"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every rule names a measure and the bounds in which it has to lie. ``measures`` gives the measures of a text as one
struct, ``verdict`` compiles the table into one boolean expression, ``apply_rules`` adds both to a table. No row leaves
its task: there is no shuffle.

Defined results: null or blank text has no words, so it fails the base rule (fewer than 50 words). Repeated rows are
judged one by one. Columns of the input named like a result column are replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.common import WHITE, bind, count_chars, count_words, words

SYMBOLS = "#*$%&|<>"

# Frequent words of the languages in scope, matched as written; a parameter of apply_rules.
STOP_WORDS = (
    "the of and to in is that it for was on with as are be this by at from or an not have "
    "der die das und ist von zu den mit im für auf nicht eine ein sich des "
    "les le la de et est que en un une du pour dans qui sur au pas par "
    "el los las y del se una por con no es lo para su"
).split()

# measure, smallest and largest value that is kept (None: no bound)
RULES: list[tuple[str, float | None, float | None]] = [
    ("chars_per_word", 2.5, 12.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_share", 0.04, None),
    ("dup_line_share", None, 0.3),
    ("words_per_line", 3.0, None),
]

# Where line dedup follows, repetition counts by the words that it would take away, whatever the number of lines.
RULES_BEFORE_LINE_DEDUP = [("dup_word_share", low, high) if name == "dup_line_share" else (name, low, high) for name, low, high in RULES]

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more, first occurrence included.

    Windows are compared by a 64-bit hash. Sorting (hash, position) puts equal windows side by side, so the work is
    n log n in the words of one text; texts without a repeated window stop after one distinct.
    """

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = bind(
            ordered,
            lambda s: F.transform(
                s,
                lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]),
            ),
        )
        starts = F.sort_array(F.filter(repeated, lambda i: i.isNotNull()))
        gaps = bind(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(width), F.get(p, i + 1) - x)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def windows_of(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
        )

    def count(w: Column) -> Column:
        counted = bind(
            windows_of(w),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
        )
        return F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(counted)

    return bind(tokens, count)


def measures(text: Column, stop_words: list[str] | None = None) -> Column:
    """All measures of one text as a struct; ratios are null where they have no denominator."""
    stops = STOP_WORDS if stop_words is None else stop_words
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        def with_distinct(d: Column) -> Column:
            left = F.aggregate(d, F.lit(0).cast("long"), lambda acc, line: acc + count_words(line))
            return F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(d)).cast("long").alias("n_dup_lines"),
                F.when(F.size(d) < F.size(x), left).alias("n_distinct_line_words"),
            )

        return bind(F.array_distinct(x), with_distinct)

    counts = F.struct(
        bind(words(text), of_words).alias("w"),
        bind(lines, of_lines).alias("l"),
        F.coalesce(F.length(F.translate(text, WHITE, "")), F.lit(0)).cast("long").alias("word_chars"),
        count_chars(text, SYMBOLS).alias("n_symbols"),
    )

    def with_ratios(c: Column) -> Column:
        n = F.nullif(c["w"]["n_words"], F.lit(0))
        n_lines = F.nullif(c["l"]["n_lines"], F.lit(0))
        return F.struct(
            c["w"]["n_words"].alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["l"]["n_dup_lines"].alias("n_dup_lines"),
            c["w"]["n_repeat_words"].alias("n_repeat_words"),
            c["l"]["n_lines"].alias("n_lines"),
            (c["word_chars"] / n).alias("chars_per_word"),
            (c["n_symbols"] / n).alias("symbols_per_word"),
            (c["w"]["n_stop_words"] / n).alias("stop_word_share"),
            (c["l"]["n_dup_lines"] / n_lines).alias("dup_line_share"),
            (n / n_lines).alias("words_per_line"),
            ((n - F.coalesce(c["l"]["n_distinct_line_words"], n)) / n).alias("dup_word_share"),
        )

    return bind(counts, with_ratios)


def verdict(m: Column, rules: list[tuple[str, float | None, float | None]] | None = None) -> Column:
    """True where every measure lies within its bounds; a missing ratio fails its rule."""
    passed = F.lit(True)
    for name, low, high in RULES if rules is None else rules:
        if low is not None:
            passed = passed & F.coalesce(m[name] >= F.lit(low), F.lit(False))
        if high is not None:
            passed = passed & F.coalesce(m[name] <= F.lit(high), F.lit(False))
    return passed


def apply_rules(
    docs: DataFrame,
    text: str = "text",
    rules: list[tuple[str, float | None, float | None]] | None = None,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``measures`` (struct), ``base_failed`` and ``kept``."""
    others = [docs[c] for c in docs.columns if c not in ("measures", "base_failed", "kept")]
    measured = docs.select(*others, measures(docs[text], stop_words).alias("measures"))
    m = F.col("measures")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(m, rules))
