"""RDF terms as one canonical string, and the expression functions over them.

A term is a string column: an IRI is its bare text, a blank node is ``_:id``, a literal is ``"lex"``,
``"lex"@lang`` or ``"lex"^^datatype`` (no escaping, ``xsd:string`` dropped, language in lower case).
Equal strings are equal *terms*, which is what joins need. ``eq`` and friends compare *values*.

Every function maps term columns to a term column; predicates return a native boolean column. An
evaluation error is ``NULL``, so three-valued logic is Spark's own. Python constants are lifted: a
``str`` to a plain literal, ``int``/``float``/``bool`` to typed literals. All of it is built-in
expressions, so it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleframe import vocab as V

Q = '"'
_WIDE = "decimal(38,0)"


# ---- construction ---------------------------------------------------------------------------


def iri_const(value: str) -> Column:
    return F.lit(value)


def literal_key(value: Any, lang: str | None = None, datatype: str | None = None) -> str:
    """The term text of a Python constant."""
    if lang is not None and datatype is not None:
        raise ValueError("a literal has a language or a datatype, not both")
    if datatype is None and lang is None:
        if isinstance(value, bool):
            value, datatype = str(value).lower(), V.BOOLEAN
        elif isinstance(value, int):
            datatype = V.XSD + "integer"
        elif isinstance(value, float):
            datatype = V.DOUBLE
    if isinstance(value, bool):
        value = str(value).lower()
    if lang:
        return f'"{value}"@{lang.lower()}'
    if datatype and datatype != V.XSD + "string":
        return f'"{value}"^^{datatype}'
    return f'"{value}"'


def literal(value: Any, lang: str | None = None, datatype: str | None = None) -> Column:
    return F.lit(literal_key(value, lang, datatype))


def term(x: Any) -> Column:
    """Lift a Python constant to a term column; columns pass through."""
    return x if isinstance(x, Column) else literal(x)


def string_term(c: Column) -> Column:
    return F.concat(F.lit(Q), c, F.lit(Q))


def lang_term(c: Column, lang: Column | str) -> Column:
    tag = F.lit(lang) if isinstance(lang, str) else lang
    return F.concat(F.lit(Q), c, F.lit('"@'), F.lower(tag))


def typed_term(c: Column, datatype: Column | str) -> Column:
    dt = F.lit(datatype) if isinstance(datatype, str) else datatype
    return F.concat(F.lit(Q), c.cast("string"), F.lit('"^^'), dt)


def integer_term(c: Column) -> Column:
    return typed_term(c.cast("bigint"), V.XSD + "integer")


def wide_integer_term(c: Column) -> Column:
    """An integer of up to 38 digits."""
    return typed_term(c.cast(_WIDE), V.XSD + "integer")


def double_term(c: Column) -> Column:
    return typed_term(c.cast("double"), V.DOUBLE)


def decimal_term(c: Column) -> Column:
    """Decimals print without trailing zeros and always keep one digit after the point."""
    text = F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
    text = F.regexp_replace(text, r"^(-?\d+)\.?$", "$1.0")
    return typed_term(text, V.DECIMAL)


def boolean_term(c: Column) -> Column:
    return typed_term(c.cast("string"), V.BOOLEAN)


def datetime_term(c: Column) -> Column:
    return typed_term(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), V.DATETIME)


def date_term(c: Column) -> Column:
    return typed_term(F.date_format(c, "yyyy-MM-dd"), V.DATE)


# ---- decoding -------------------------------------------------------------------------------


def is_literal(k: Column) -> Column:
    return k.startswith(Q)


def is_blank(k: Column) -> Column:
    return k.startswith("_:")


def is_iri(k: Column) -> Column:
    return ~is_literal(k) & ~is_blank(k)


def _tail(k: Column) -> Column:
    """What follows the closing quote: empty, ``@lang`` or ``^^datatype``."""
    return F.substring_index(k, Q, -1)


def lexical(k: Column) -> Column:
    """Native text of a literal, NULL for other terms."""
    return _let(
        k,
        lambda x: F.when(
            is_literal(x), x.substr(F.lit(2), F.length(x) - F.length(_tail(x)) - F.lit(2))
        ),
    )


def text(k: Column) -> Column:
    """Native text of a literal, or the IRI itself; the usual output column."""
    return _let(k, lambda x: F.when(is_literal(x), lexical(x)).when(is_iri(x), x))


def lang_text(k: Column) -> Column:
    def body(x: Column) -> Column:
        tail = _tail(x)
        tag = F.when(tail.startswith("@"), F.substring(tail, 2, 1 << 30)).otherwise(F.lit(""))
        return F.when(is_literal(x), tag)

    return _let(k, body)


def datatype_iri(k: Column) -> Column:
    def body(x: Column) -> Column:
        tail = _tail(x)
        named = (
            F.when(tail == "", F.lit(V.XSD + "string"))
            .when(tail.startswith("@"), F.lit(V.RDF + "langString"))
            .otherwise(F.substring(tail, 3, 1 << 30))
        )
        return F.when(is_literal(x), named)

    return _let(k, body)


def _let(x: Column, body) -> Column:
    """Apply ``body`` to ``x``, evaluating ``x`` once.

    Bodies mention their argument many times. For a column that is free; a computed argument is
    bound to a lambda variable, or nested calls would grow the expression exponentially.
    """
    shown = str(x)
    if "(" not in shown and "CASE" not in shown:
        return body(x)
    return F.transform(F.array(x), body)[0]


def _tails(*datatypes: str) -> list[str]:
    return ["^^" + d for d in datatypes]


_INTEGER, _FLOATING = _tails(*V.INTEGER_TYPES), _tails(V.DECIMAL, V.FLOAT, V.DOUBLE)
_TEMPORAL = _tails(V.DATE, V.DATETIME)


def _typed_text(k: Column) -> Column:
    """Text of a literal that has a datatype."""
    return F.substring(F.substring_index(k, '"^^', 1), 2, 1 << 30)


def numeric_rank(k: Column) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double; NULL when not numeric."""
    tail = _tail(k)
    return (
        F.when(tail.isin(_INTEGER), 1)
        .when(tail == "^^" + V.DECIMAL, 2)
        .when(tail == "^^" + V.FLOAT, 3)
        .when(tail == "^^" + V.DOUBLE, 4)
    )


def number_of(text: Column) -> Column:
    """Native double of a number as written, else NULL. A bare cast would also take suffixes such as ``1d``."""
    return F.when(F.translate(text, "0123456789+-.eE", "").isin("", "INF", "NaN"), text.try_cast("double"))


def num(k: Column) -> Column:
    """Native double of a numeric literal, else NULL. Exact kinds may be rounded: compare with ``eq``, ``lt``, ``order_key``."""
    return _let(k, lambda x: F.when(_tail(x).isin(_INTEGER + _FLOATING), number_of(_typed_text(x))))


def _is_exact(k: Column) -> Column:
    """Whether a term is an integer or a decimal."""
    return _tail(k).isin(_INTEGER + _tails(V.DECIMAL))


def exact_parts(k: Column) -> Column:
    """An integer or decimal literal as (minus, whole, part): digits without leading, or trailing, zeros; else NULL."""
    return F.when(_is_exact(k), F.transform(F.array(_typed_text(k)), _digits)[0])


def _digits(text: Column) -> Column:
    """The text of an exact number as (minus, whole, part)."""
    body = F.translate(text, "+-", "")
    part = F.when(F.instr(body, ".") > 0, F.substring_index(body, ".", -1)).otherwise(F.lit(""))
    return F.when(
        F.rlike(text, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)$")),
        F.struct(
            text.startswith("-").alias("minus"),
            F.ltrim(F.substring_index(body, ".", 1), F.lit("0")).alias("whole"),
            F.rtrim(part, F.lit("0")).alias("part"),
        ),
    )


def exact_key(k: Column) -> Column:
    """A struct that orders integers and decimals of any length by value; NULL for other terms.

    Length of the whole part, then digits; for negative numbers both are turned round.
    """

    def body(p: Column) -> Column:
        sign = F.when((p["whole"] == "") & (p["part"] == ""), 0).when(p["minus"], -1).otherwise(1)
        digits = F.concat(p["whole"], p["part"])
        turned = F.concat(F.translate(digits, "0123456789", "9876543210"), F.lit("~"))
        return F.when(
            p.isNotNull(),
            F.struct(
                sign.alias("sign"),
                (sign * F.length(p["whole"])).alias("size"),
                F.when(sign < 0, turned).otherwise(digits).alias("digits"),
            ),
        )

    return F.transform(F.array(exact_parts(k)), body)[0]


def _by_value(x: Column, y: Column, compare) -> Column:
    """Compare two numbers: by their doubles where these differ or one is no exact kind, else digit by digit."""
    dx, dy = num(x), num(y)
    tie = _is_exact(x) & _is_exact(y) & (dx == dy)
    return F.when(tie, compare(exact_key(x), exact_key(y))).otherwise(compare(dx, dy))


def boolean(k: Column) -> Column:
    """Native boolean of an ``xsd:boolean`` literal, else NULL."""

    def body(x: Column) -> Column:
        t = _typed_text(x)
        value = F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)
        return F.when(_tail(x) == "^^" + V.BOOLEAN, value)

    return _let(k, body)


def timestamp(k: Column) -> Column:
    """Native timestamp of a date or dateTime literal, else NULL."""
    return _let(k, lambda x: F.when(_tail(x).isin(_TEMPORAL), _typed_text(x).try_cast("timestamp")))


def plain(k: Column) -> Column:
    """Native text of an untagged string literal, else NULL."""
    return _let(
        k,
        lambda x: F.when(
            is_literal(x) & (_tail(x) == ""), x.substr(F.lit(2), F.length(x) - F.lit(2))
        ),
    )


def binding_struct(k: Column) -> Column:
    """Typed result value ``(type, value, datatype, lang)``; unbound stays NULL."""

    def body(x: Column) -> Column:
        dt, tag = datatype_iri(x), lang_text(x)
        kind = F.when(is_literal(x), "literal").when(is_blank(x), "bnode").otherwise(F.lit("uri"))
        value = F.when(is_blank(x), F.substring(x, 3, 1 << 30)).otherwise(text(x))
        return F.when(
            x.isNotNull(),
            F.struct(
                kind.alias("type"),
                value.alias("value"),
                F.when(~dt.isin(V.XSD + "string", V.RDF + "langString"), dt).alias("datatype"),
                F.when(tag != "", tag).alias("lang"),
            ),
        )

    return _let(k, body)


# ---- comparison and logic -------------------------------------------------------------------


def eq(a: Any, b: Any) -> Column:
    """Value equality. Same term is equal; literals of unknown datatype are otherwise an error."""
    if not isinstance(a, Column) and isinstance(b, Column):
        a, b = b, a
    error = F.lit(None).cast("boolean")

    def constant(x: Column) -> Column:
        kind, read = _kind(x), _reader(b)
        wanted = {num: 1, boolean: 3, plain: 4}[read]
        same = _by_value(x, term(b), lambda p, q: p == q) if read is num else read(x) == F.lit(b)
        return F.when(x.isNull() | (kind == 9), error).when(kind == wanted, same).otherwise(False)

    def general(x: Column, y: Column) -> Column:
        kx, ky = _kind(x), _kind(y)
        return (
            F.when(x.isNull() | y.isNull(), error)
            .when(x == y, True)
            .when((kx == 0) | (ky == 0), False)
            .when((kx == 9) | (ky == 9), error)
            .when(kx != ky, False)
            .when(kx == 1, _by_value(x, y, lambda p, q: p == q))
            .when(kx == 2, timestamp(x) == timestamp(y))
            .when(kx == 3, boolean(x) == boolean(y))
            .otherwise(False)
        )

    if not isinstance(b, Column):
        return _let(term(a), constant)
    return _let(a, lambda x: _let(b, lambda y: general(x, y)))


def ne(a: Any, b: Any) -> Column:
    return ~eq(a, b)


def value_key(k: Column) -> Column:
    """A text that is the same for any two terms of equal value: what a join on value equality can hash.

    Numbers give the bits they have as a double, so ``1``, ``1.0`` and ``1e0`` meet; so may long exact numbers that only
    differ beyond a double's digits, which :func:`eq` tells apart afterwards. Dates give their instant, booleans their
    value, all other terms themselves.
    """

    def body(x: Column) -> Column:
        kind = _kind(x)
        value = (
            F.when(kind == 1, F.concat(F.lit("n"), (num(x) + F.lit(0.0)).cast("string")))
            .when(kind == 2, F.concat(F.lit("d"), F.unix_micros(timestamp(x)).cast("string")))
            .when(kind == 3, F.concat(F.lit("b"), boolean(x).cast("string")))
        )
        # The control character keeps keys apart from terms.
        return F.coalesce(F.concat(F.lit("\x01"), value), x)

    return _let(k, body)


def _kind(k: Column) -> Column:
    """0 no literal, 1 number, 2 date or dateTime, 3 boolean, 4 string, 5 tagged string, 9 other."""
    tail = _tail(k)
    return (
        F.when(~is_literal(k), 0)
        .when(tail == "", 4)
        .when(tail.isin(_INTEGER + _FLOATING), 1)
        .when(tail.isin(_TEMPORAL), 2)
        .when(tail == "^^" + V.BOOLEAN, 3)
        .when(tail.startswith("@"), 5)
        .otherwise(9)
    )


def _reader(constant: Any):
    """How to read the other side when one side is a Python constant."""
    if isinstance(constant, bool):
        return boolean
    return num if isinstance(constant, (int, float)) else plain


def _ordered(a: Any, b: Any, compare) -> Column:
    constant = b if not isinstance(b, Column) else a if not isinstance(a, Column) else None
    if constant is not None and _reader(constant) is not num:
        read = _reader(constant)
        one, other = read(term(a)), read(term(b))
        return compare(one, other)
    if constant is not None:
        return _let(term(a), lambda x: _let(term(b), lambda y: _by_value(x, y, compare)))

    def general(x: Column, y: Column) -> Column:
        others = [compare(read(x), read(y)) for read in (timestamp, boolean, plain)]
        return F.coalesce(_by_value(x, y, compare), *others)

    return _let(a, lambda x: _let(b, lambda y: general(x, y)))


def lt(a: Any, b: Any) -> Column:
    return _ordered(a, b, lambda x, y: x < y)


def le(a: Any, b: Any) -> Column:
    return _ordered(a, b, lambda x, y: x <= y)


def gt(a: Any, b: Any) -> Column:
    return _ordered(a, b, lambda x, y: x > y)


def ge(a: Any, b: Any) -> Column:
    return _ordered(a, b, lambda x, y: x >= y)


def and_(*conditions: Column) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def or_(*conditions: Column) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def not_(condition: Column) -> Column:
    return ~condition


def in_(k: Any, options: list[Any]) -> Column:
    """Value equality against any option; an error counts only when nothing matches."""
    return or_(*[eq(k, o) for o in options]) if options else F.lit(False)


def not_in(k: Any, options: list[Any]) -> Column:
    return ~in_(k, options)


def ebv(k: Any) -> Column:
    """Effective boolean value of a term."""

    def body(x: Column) -> Column:
        kind = _kind(x)
        return (
            F.when(kind == 3, F.coalesce(boolean(x), F.lit(False)))
            .when(kind == 1, F.coalesce((num(x) != 0) & ~F.isnan(num(x)), F.lit(False)))
            .when(kind.isin(4, 5), F.length(x) - F.length(_tail(x)) > 2)
        )

    return _let(term(k), body)


def bound(k: Column) -> Column:
    return k.isNotNull()


def if_(condition: Column, then: Any, otherwise: Any) -> Column:
    """An error in the condition is an error of the whole expression."""
    return F.when(condition, term(then)).when(~condition, term(otherwise))


def coalesce(*options: Any) -> Column:
    return F.coalesce(*[term(o) for o in options])


# ---- arithmetic -----------------------------------------------------------------------------


def too_wide() -> Column:
    """The error of exact numbers beyond 38 digits: it ends the query, since an unbound value would hide the number."""
    return F.raise_error(F.lit("an exact number needs more than 38 digits"))


def _scaled(k: Column, parts: Callable[[Column], Column] = exact_parts) -> Column:
    """An integer or decimal as (n, scale) with value n / 10**scale. More than 38 digits are an error, not an unbound value."""

    def body(p: Column) -> Column:
        digits = F.concat(F.when(p["minus"], "-").otherwise(""), p["whole"], p["part"], F.lit(""))
        n = F.when((p["whole"] == "") & (p["part"] == ""), F.lit(0).cast(_WIDE)).otherwise(digits.try_cast(_WIDE))
        return F.when(
            p.isNotNull(),
            F.struct(F.coalesce(n, too_wide().cast(_WIDE)).alias("n"), F.length(p["part"]).alias("scale")),
        )

    return F.transform(F.array(parts(k)), body)[0]


def _grown(n: Column, zeros: Column) -> Column:
    """n * 10**zeros."""
    return F.coalesce(F.concat(n.cast("string"), F.repeat(F.lit("0"), zeros)).try_cast(_WIDE), too_wide().cast(_WIDE))


def _point(n: Column, scale: Column, datatype: Column | str = V.DECIMAL) -> Column:
    """The decimal n / 10**scale: no trailing zeros, but one digit after the point at least."""

    def body(x: Column) -> Column:
        minus = F.when(x["n"].startswith("-"), "-").otherwise("")
        digits = F.translate(x["n"], "-", "")
        padded = F.lpad(digits, F.greatest(F.length(digits), x["scale"] + 1), F.lit("0"))
        size = F.length(padded) - x["scale"]
        part = F.rtrim(padded.substr(size + 1, F.length(padded)), F.lit("0"))
        whole = F.ltrim(padded.substr(F.lit(1), size), F.lit("0"))
        value = F.concat(
            minus, F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(part == "", "0").otherwise(part)
        )
        return typed_term(F.when(value == "-0.0", "0.0").otherwise(value), datatype)

    packed = F.struct(n.cast("string").alias("n"), scale.cast("int").alias("scale"))
    return F.when(n.isNotNull() & scale.isNotNull(), F.transform(F.array(packed), body)[0])


def _summed(x: Column, y: Column, op) -> tuple[Column, Column]:
    scale = F.greatest(x["scale"], y["scale"])
    return op(_grown(x["n"], scale - x["scale"]), _grown(y["n"], scale - y["scale"])), scale


def _quotient(x: Column, y: Column) -> Column:
    """At least 28 significant digits, halves up; exact where the quotient ends before."""
    size = F.length(F.translate(x["n"].cast("string"), "-", ""))
    grown = F.greatest(28 - size, F.lit(0))
    top = _grown(x["n"], grown).try_cast("decimal(28,0)")
    quotient = F.try_divide(F.coalesce(top, too_wide().cast("decimal(28,0)")), y["n"])
    digits = F.translate(quotient.cast("decimal(38,10)").cast("string"), ".", "")
    scale = grown + x["scale"] - y["scale"] + 10
    shifted = F.concat(digits, F.repeat(F.lit("0"), F.greatest(-scale, F.lit(0))))
    return F.when(y["n"] != 0, _point(shifted, F.greatest(scale, F.lit(0))))


def _wide(text: Column) -> Column:
    """A whole number of up to 38 digits; more are an error, other texts are NULL."""
    plain = F.translate(text, "0123456789", "").isin("", "-", "+")
    too_long = F.when(F.rlike(text, F.lit(r"^[+-]?\d+$")), too_wide().cast(_WIDE))
    return F.coalesce(F.when(plain, text.try_cast(_WIDE)), too_long)


def _short_decimal(text: Column) -> Column:
    """A decimal with at most eight digits before and ten after the point; NULL for others. Sums and products of two are exact."""
    after = F.when(F.instr(text, ".") > 0, F.length(F.substring_index(text, ".", -1))).otherwise(0)
    plain = F.translate(text, "0123456789.", "").isin("", "-", "+") & (after <= 10)
    return F.when(plain & (F.length(text) - after <= 9), text.try_cast("decimal(18,10)"))


def _short_quotient(x: Column, y: Column) -> Column:
    """The quotient of two short decimals where it ends after ten digits at most, which multiplying back proves."""
    quotient = F.try_divide(x, y).try_cast("decimal(19,10)")
    return F.when(quotient * y == x, quotient)


def _arithmetic(a: Any, b: Any, on_int, on_exact, on_dbl) -> Column:
    """``on_int`` on whole numbers and short decimals, ``on_exact`` on (n, scale) pairs gives (n, scale) or a term, ``on_dbl`` on doubles.

    Text and kind of both operands are read once. Whole numbers are computed as long integers where they fit and as
    decimals of 38 digits else, short decimals as such; only longer decimals are taken apart into digits.
    """

    def exact(x: Column, y: Column) -> Column:
        def body(p: Column) -> Column:
            found = on_exact(p["x"], p["y"])
            if isinstance(found, Column):
                return found
            n, scale = F.coalesce(found[0], too_wide().cast(_WIDE)), found[1]
            return F.when(p["x"].isNotNull() & p["y"].isNotNull(), _point(n, scale))

        pair = F.struct(_scaled(x, _digits).alias("x"), _scaled(y, _digits).alias("y"))
        return F.transform(F.array(pair), body)[0]

    def whole(x: Column, y: Column) -> Column:
        short = integer_term(on_int(x.try_cast("bigint"), y.try_cast("bigint")))

        def long(p: Column) -> Column:
            n = F.coalesce(on_int(p["x"], p["y"]), too_wide().cast(_WIDE))
            return F.when(p["x"].isNotNull() & p["y"].isNotNull(), wide_integer_term(n))

        wide = F.transform(F.array(F.struct(_wide(x).alias("x"), _wide(y).alias("y"))), long)[0]
        return F.coalesce(short, wide)

    def outcome(p: Column) -> Column:
        x, y = p["x"], p["y"]
        rank = F.when(p["rx"].isNotNull() & p["ry"].isNotNull(), F.greatest(p["rx"], p["ry"]))
        real = on_dbl(number_of(x), number_of(y))
        digits = exact(x, y)
        native = on_int or _short_quotient
        decimals = F.coalesce(decimal_term(native(_short_decimal(x), _short_decimal(y))), digits)
        return (
            F.when(rank == 1, decimals if on_int is None else whole(x, y))
            .when(rank == 4, double_term(real))
            .when(rank == 2, decimals)
            .when(rank == 3, typed_term(real.cast("float"), V.FLOAT))
        )

    def body(x: Column, y: Column) -> Column:
        parts = {"x": _typed_text(x), "y": _typed_text(y), "rx": numeric_rank(x), "ry": numeric_rank(y)}
        return F.transform(F.array(F.struct(*[v.alias(k) for k, v in parts.items()])), outcome)[0]

    return _let(term(a), lambda x: _let(term(b), lambda y: body(x, y)))


def add(a: Any, b: Any) -> Column:
    """Exact for integers and decimals; a result of more than 38 digits is an error that ends the query."""
    return _arithmetic(a, b, F.try_add, lambda x, y: _summed(x, y, F.try_add), lambda x, y: x + y)


def subtract(a: Any, b: Any) -> Column:
    """Exact for integers and decimals; a result of more than 38 digits is an error that ends the query."""
    return _arithmetic(a, b, F.try_subtract, lambda x, y: _summed(x, y, F.try_subtract), lambda x, y: x - y)


def multiply(a: Any, b: Any) -> Column:
    """Exact for integers and decimals; a result of more than 38 digits is an error that ends the query."""
    return _arithmetic(
        a, b, F.try_multiply, lambda x, y: (F.try_multiply(x["n"], y["n"]), x["scale"] + y["scale"]), lambda x, y: x * y
    )


def divide(a: Any, b: Any) -> Column:
    """Integers divide to a decimal; a zero divisor is an error. Exact operands keep at least 28 significant digits."""
    return _arithmetic(a, b, None, _quotient, F.try_divide)


def negate(a: Any) -> Column:
    return subtract(0, a)


def plus(a: Any) -> Column:
    return _let(term(a), lambda x: F.when(num(x).isNotNull(), x))


def _unary(a: Any, minus, up, on_dbl) -> Column:
    """``up`` tells, of the (minus, whole, part) of a decimal, what to add to its whole part; ``minus`` keeps the sign."""

    def whole(p: Column) -> Column:
        n = F.coalesce(F.concat(F.lit("0"), p["whole"]).try_cast(_WIDE), too_wide().cast(_WIDE))
        signed = F.when(p["minus"] & F.lit(minus), -n).otherwise(n)
        return (signed + up(p)).cast(_WIDE)

    def body(x: Column) -> Column:
        rank = numeric_rank(x)
        real = on_dbl(number_of(_typed_text(x)))
        if up is None:
            integer = lambda p: wide_integer_term(F.abs(p["n"]))
            decimal = F.transform(F.array(_scaled(x)), lambda p: _point(F.abs(p["n"]), p["scale"]))[0]
        else:
            integer = lambda p: wide_integer_term(p["n"])
            decimal = F.transform(F.array(exact_parts(x)), lambda p: _point(whole(p), F.lit(0)))[0]
        return (
            F.when(rank == 1, F.transform(F.array(_scaled(x)), integer)[0])
            .when(rank == 2, decimal)
            .when(rank == 3, typed_term(real.cast("float"), V.FLOAT))
            .when(rank == 4, double_term(real))
        )

    return _let(term(a), body)


def abs_(a: Any) -> Column:
    return _unary(a, False, None, F.abs)


def ceil(a: Any) -> Column:
    return _unary(a, True, lambda p: F.when(~p["minus"] & (p["part"] != ""), 1).otherwise(0), lambda x: F.ceil(x).cast("double"))


def floor(a: Any) -> Column:
    return _unary(a, True, lambda p: F.when(p["minus"] & (p["part"] != ""), -1).otherwise(0), lambda x: F.floor(x).cast("double"))


def round_(a: Any) -> Column:
    """Halves go up, also below zero: -2.5 becomes -2."""

    def up(p: Column) -> Column:
        return F.when(~p["minus"] & (p["part"] >= "5"), 1).when(p["minus"] & (p["part"] > "5"), -1).otherwise(0)

    return _unary(a, True, up, lambda x: F.floor(x + 0.5).cast("double"))


# ---- strings --------------------------------------------------------------------------------


def str_(k: Any) -> Column:
    return string_term(text(term(k)))


def _relabel(k: Any, change) -> Column:
    """Change the text of a literal and keep its language or datatype."""
    return _let(term(k), lambda x: F.concat(F.lit(Q), change(lexical(x)), F.lit(Q), _tail(x)))


def lcase(k: Any) -> Column:
    return _relabel(k, F.lower)


def ucase(k: Any) -> Column:
    return _relabel(k, F.upper)


def strlen(k: Any) -> Column:
    return integer_term(F.char_length(lexical(term(k))))


def contains(k: Any, part: Any) -> Column:
    return F.contains(lexical(term(k)), lexical(term(part)))


def strstarts(k: Any, part: Any) -> Column:
    return F.startswith(lexical(term(k)), lexical(term(part)))


def strends(k: Any, part: Any) -> Column:
    return F.endswith(lexical(term(k)), lexical(term(part)))


def _whole_number(x: Any) -> Column:
    """A position or length: a Python integer, or a numeric term rounded to a whole number."""
    return F.lit(x) if isinstance(x, int) else num(round_(x)).cast("int")


def substr(k: Any, start: Any, length: Any = None) -> Column:
    """1-based; a start before the text shortens the result instead of counting from the end.

    ``start`` and ``length`` are Python integers or numeric terms.
    """
    begin = _whole_number(start)
    first = F.greatest(begin, F.lit(1))
    size = F.lit(1 << 30) if length is None else F.greatest(begin + _whole_number(length) - first, F.lit(0))
    known = begin.isNotNull() & size.isNotNull()
    return _relabel(k, lambda t: F.when(known, F.substring(t, first, size)))


def concat(*parts: Any) -> Column:
    """Texts joined; a language tag that all arguments share stays."""
    lifted = [term(p) for p in parts]
    tails = [_tail(p) for p in lifted]
    shared = reduce(lambda x, y: x & y, [x == tails[0] for x in tails], tails[0].startswith("@"))
    return F.concat(F.lit(Q), *[lexical(p) for p in lifted], F.lit(Q), F.when(shared, tails[0]).otherwise(F.lit("")))


def regex(k: Any, pattern: str, flags: str = "") -> Column:
    """True when the pattern is found anywhere in the text. Flags: ``i s m x``."""
    if set(flags) - set("ismx"):
        raise ValueError(f"unsupported regex flags: {flags!r}")
    return F.rlike(lexical(term(k)), F.lit(f"(?{flags}){pattern}" if flags else pattern))


def lang(k: Any) -> Column:
    return string_term(lang_text(term(k)))


def lang_matches(tag: Any, wanted: Any) -> Column:
    """Whether a tag is in a language range: a Python string or a string term."""
    given = lexical(term(tag))
    if isinstance(wanted, str):
        w = wanted.lower()
        return given != "" if w == "*" else _let(F.lower(given), lambda t: (t == w) | t.startswith(w + "-"))

    def body(t: Column, w: Column) -> Column:
        return F.when(w == "*", t != "").otherwise((t == w) | F.startswith(t, F.concat(w, F.lit("-"))))

    return _let(F.lower(given), lambda t: _let(F.lower(lexical(wanted)), lambda w: body(t, w)))


def datatype(k: Any) -> Column:
    return datatype_iri(term(k))


def is_numeric(k: Any) -> Column:
    return _let(term(k), lambda x: F.when(x.isNotNull(), num(x).isNotNull()))


def iri(k: Any) -> Column:
    """An IRI from a string or an IRI; anything that is not absolute is an error."""

    def body(x: Column) -> Column:
        t = F.when(is_literal(x), plain(x)).when(is_iri(x), x)
        return F.when(F.rlike(t, F.lit(V.ABSOLUTE_IRI)), t)

    return _let(term(k), body)


# ---- dates ----------------------------------------------------------------------------------


def _field(k: Any, pattern: str, cast: str) -> Column:
    """A field as written, without any shift to the session time zone."""

    def body(x: Column) -> Column:
        found = F.regexp_extract(_typed_text(x), pattern, 1)
        return F.when(_tail(x).isin(_TEMPORAL), found.try_cast(cast))

    return _let(term(k), body)


_DAY_RE = r"^-?\d{4,}-\d{2}-(\d{2})"
_TIME_RE = r"^-?\d{4,}-\d{2}-\d{2}T"


def year(k: Any) -> Column:
    return integer_term(_field(k, r"^(-?\d{4,})-\d{2}-\d{2}", "int"))


def month(k: Any) -> Column:
    return integer_term(_field(k, r"^-?\d{4,}-(\d{2})-\d{2}", "int"))


def day(k: Any) -> Column:
    return integer_term(_field(k, _DAY_RE, "int"))


def hours(k: Any) -> Column:
    return integer_term(_field(k, _TIME_RE + r"(\d{2})", "int"))


def minutes(k: Any) -> Column:
    return integer_term(_field(k, _TIME_RE + r"\d{2}:(\d{2})", "int"))


def seconds(k: Any) -> Column:
    text = _field(k, _TIME_RE + r"\d{2}:\d{2}:(\d{2}(?:\.\d+)?)", "string")
    return add(F.when(text != "", typed_term(text, V.DECIMAL)), literal("0.0", datatype=V.DECIMAL))


def now() -> Column:
    """One instant for the whole query."""
    return datetime_term(F.current_timestamp())


# ---- ordering -------------------------------------------------------------------------------


def order_key(k: Column) -> Column:
    """Sort key: unbound, blank nodes, IRIs, numbers, dates, booleans, then other literals."""

    def body(x: Column) -> Column:
        rank = (
            F.when(x.isNull(), 0)
            .when(is_blank(x), 1)
            .when(is_iri(x), 2)
            .when(num(x).isNotNull(), 3)
            .when(timestamp(x).isNotNull(), 4)
            .when(boolean(x).isNotNull(), 5)
            .otherwise(6)
        )
        return F.struct(
            rank.alias("rank"),
            num(x).alias("num"),
            exact_key(x).alias("exact"),
            timestamp(x).alias("ts"),
            F.coalesce(lexical(x), x).alias("lex"),
            x.alias("key"),
        )

    return _let(k, body)
