"""Expression functions on single terms."""

import pytest
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t

INT, DEC, DBL, FLT = V.XSD + "integer", V.DECIMAL, V.DOUBLE, V.FLOAT
lit = t.literal_key


def evaluate(spark, *cols):
    # A one-row frame keeps the optimiser from folding everything on the driver.
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return list(row) if len(cols) > 1 else row[0]


def test_round_trip_and_accessors(spark):
    tricky = 'say "hi"@en\nthere'
    got = evaluate(
        spark,
        t.text(t.literal(tricky)), t.text(t.literal(tricky, lang="EN-us")), t.lang_text(t.literal(tricky, lang="EN-us")),
        t.text(F.lit("http://a/b")), t.text(F.lit("_:b1")), t.datatype(t.literal("x")), t.datatype(t.literal("x", lang="en")),
        t.datatype(F.lit("http://a")), t.lang(t.literal("x")),
    )
    assert got == [tricky, tricky, "en-us", "http://a/b", None, V.XSD + "string", V.RDF + "langString", None, '""']


def test_term_and_value_equality(spark):
    got = evaluate(
        spark,
        t.literal(32) == t.literal("32.0", datatype=DEC),
        t.eq(32, t.literal("32.0", datatype=DEC)),
        t.eq(t.literal("a"), t.literal("a", lang="en")),
        t.ne(t.literal("a"), t.literal("b")),
        t.eq(t.literal("a", datatype="http://x/t"), t.literal("b", datatype="http://x/t")),
        t.eq(t.literal("a", datatype="http://x/t"), t.literal("a", datatype="http://x/t")),
        t.eq(F.lit("http://a"), t.literal("http://a")),
        t.eq(True, t.literal("1", datatype=V.BOOLEAN)),
        t.lt(9, 10.5), t.lt("b", "a"), t.lt(1, "a"),
        t.lt(t.literal("2020-01-02", datatype=V.DATE), t.literal("2020-01-03", datatype=V.DATE)),
        t.in_(1, [2, 1.0]), t.not_in(1, [2, 3]), t.in_(1, []),
    )
    assert got == [False, True, False, True, None, True, False, True, True, False, None, True, True, True, False]


def test_arithmetic_promotes_and_fails_to_null(spark):
    got = evaluate(
        spark,
        t.add(1, 2), t.multiply(3, t.literal("1.50", datatype=DEC)), t.divide(7, 2), t.divide(4, 2), t.divide(1, 0),
        t.subtract(1, 0.5), t.add(1, "x"), t.negate(3), t.abs_(-3), t.ceil(t.literal("1.2", datatype=DEC)),
        t.floor(-1.5), t.round_(-2.5), t.round_(2.5), t.round_(t.literal("-2.5", datatype=DEC)),
        t.add(t.literal("abc", datatype=INT), 1), t.plus(3), t.plus("a"), t.add(t.literal("1", datatype=FLT), 1),
    )
    assert got == [
        lit(3), lit("4.5", datatype=DEC), lit("3.5", datatype=DEC), lit("2.0", datatype=DEC), None, lit(0.5), None,
        lit(-3), lit(3), lit("2.0", datatype=DEC), lit(-2.0), lit(-2.0), lit(3.0), lit("-2.0", datatype=DEC), None,
        lit(3), None, lit("2.0", datatype=FLT),
    ]


def test_logic_and_effective_boolean_value(spark):
    error = F.lit(None).cast("boolean")
    got = evaluate(
        spark,
        t.or_(error, F.lit(True)), t.and_(error, F.lit(False)), t.and_(error, F.lit(True)), t.not_(F.lit(True)),
        t.ebv(0), t.ebv(0.5), t.ebv(""), t.ebv("x"), t.ebv(True), t.ebv(F.lit("http://a")), t.ebv(float("nan")),
        t.if_(F.lit(True), 1, 2), t.if_(error, 1, 2), t.coalesce(F.lit(None).cast("string"), 5), t.bound(F.lit(None).cast("string")),
    )
    assert got == [
        True, False, None, False, False, True, False, True, True, None, False, lit(1), None, lit(5), False,
    ]


def test_strings(spark):
    tagged = t.literal("Foobar", lang="en")
    got = evaluate(
        spark,
        t.str_(F.lit("http://a")), t.lcase(tagged), t.ucase(tagged), t.strlen("héé"), t.contains(tagged, "oba"),
        t.strstarts(tagged, "Foo"), t.strends(tagged, "bar"), t.substr(tagged, 4), t.substr("foobar", 4, 1), t.substr("foobar", 0, 3),
        t.concat("a", tagged), t.concat("a", F.lit("http://x")), t.regex("Hello", "^h", "i"), t.regex("Hello", "^h"),
        t.lang_matches(t.literal("en-GB"), "EN"), t.lang_matches(t.literal("en"), "*"), t.lang_matches(t.literal(""), "*"),
        t.iri("http://x/y"), t.iri("x y"), t.is_numeric(3), t.is_numeric("3"),
    )
    assert got == [
        '"http://a"', lit("foobar", lang="en"), lit("FOOBAR", lang="en"), lit(3), True, True, True, lit("bar", lang="en"),
        lit("b"), lit("fo"), lit("aFoobar"), None, True, False, True, True, False, "http://x/y", None, True, False,
    ]
    with pytest.raises(ValueError):
        t.regex("a", "b", "q")
    with pytest.raises(ValueError):
        t.literal_key("a", lang="en", datatype=INT)


def test_date_fields_stay_as_written(spark):
    stamp = t.literal("2020-03-04T23:30:07.25+09:00", datatype=V.DATETIME)
    day = t.literal("2020-03-04", datatype=V.DATE)
    got = evaluate(
        spark,
        t.year(stamp), t.month(stamp), t.day(stamp), t.hours(stamp), t.minutes(stamp), t.seconds(stamp),
        t.year(day), t.hours(day), t.year("2020-03-04"), t.datatype(t.now()),
    )
    assert got == [
        lit(2020), lit(3), lit(4), lit(23), lit(30), lit("7.25", datatype=DEC), lit(2020), None, None, V.DATETIME,
    ]


def test_order(spark):
    keys = [None, "_:b", "http://a", lit(2), lit(10.0), lit("2020-01-01", datatype=V.DATE), lit(True), lit("a"), lit("b", lang="en")]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k string")
    assert [r[0] for r in df.orderBy(t.order_key(F.col("k"))).collect()] == keys
    assert [r[0] for r in df.orderBy(t.order_key(F.col("k")).desc()).collect()] == keys[::-1]


def test_result_struct(spark):
    got = evaluate(spark, t.binding_struct(t.literal("x", lang="en")), t.binding_struct(F.lit("_:b")), t.binding_struct(t.term(1)))
    assert [tuple(g) for g in got] == [("literal", "x", None, "en"), ("bnode", "b", None, None), ("literal", "1", INT, None)]


def test_numbers_are_exact(spark):
    big, near = t.literal(9007199254740993), t.literal(9007199254740992)
    dec = lambda x: t.literal(x, datatype=DEC)
    got = evaluate(
        spark,
        t.eq(big, near), t.lt(near, big), t.lt(big, near), t.eq(big, 9007199254740992), t.in_(big, [9007199254740992]),
        t.eq(dec("-1.50"), dec("-1.5")), t.lt(dec("-1.51"), dec("-1.5")), t.lt(dec("1"), dec("1.00000000000000000001")),
        t.lt(dec("99999999999999999999999"), dec("100000000000000000000000")), t.eq(t.literal("1d", datatype=DBL), 1),
        t.divide(900000000000000, 2), t.add(dec("1000000000000000.5"), 1), t.round_(dec("1000000000000000.5")),
        t.add(dec("0.1234567891"), 0), t.add(t.literal("12345678901234567890", datatype=INT), 1), t.multiply(dec("-0.00000000001"), dec("3.5")),
        t.divide(1, 3), t.divide(dec("-7.5"), dec("0.25")), t.abs_(dec("-00.50")), t.floor(dec("-0.5")), t.ceil(dec("-0.5")), t.round_(dec("-2.51")),
        t.abs_(t.literal("-12345678901234567890", datatype=INT)), t.subtract(dec("0.5"), dec("0.5")), t.divide(dec("1.5"), 0),
        t.seconds(t.literal("2020-01-01T00:00:07.1234567", datatype=V.DATETIME)),
    )
    assert got == [
        False, True, False, False, False, True, True, True, True, None, lit("450000000000000.0", datatype=DEC),
        lit("1000000000000001.5", datatype=DEC), lit("1000000000000001.0", datatype=DEC), lit("0.1234567891", datatype=DEC),
        lit("12345678901234567891", datatype=INT), lit("-0.000000000035", datatype=DEC),
        lit("0." + "3" * 37, datatype=DEC), lit("-30.0", datatype=DEC), lit("0.5", datatype=DEC), lit("-1.0", datatype=DEC), lit("0.0", datatype=DEC),
        lit("-3.0", datatype=DEC), lit("12345678901234567890", datatype=INT), lit("0.0", datatype=DEC), None, lit("7.1234567", datatype=DEC),
    ]
    with pytest.raises(Exception, match="38 digits"):
        evaluate(spark, t.multiply(t.literal("9" * 30, datatype=INT), t.literal("9" * 30, datatype=INT)))


def test_exact_order(spark):
    values = [-9007199254740993, -9007199254740992, -5, 0, 5, 9007199254740992, 9007199254740993]
    df = spark.createDataFrame([(lit(v),) for v in reversed(values)], "k string")
    assert [r[0] for r in df.orderBy(t.order_key(F.col("k"))).collect()] == [lit(v) for v in values]


def test_arguments_may_be_expressions(spark):
    three, two = F.lit(lit(3)), F.lit(lit(2.0))
    got = evaluate(
        spark,
        t.substr("foobar", three, two), t.substr("foobar", 0, three), t.substr("foobar", F.lit('"x"')),
        t.lang_matches(t.literal("en-GB"), F.lit('"EN"')), t.lang_matches(t.literal(""), F.lit('"*"')), t.lang_matches(t.literal("de"), F.lit('"en"')),
        t.concat(t.literal("a", lang="en"), t.literal("b", lang="en")), t.concat(t.literal("a", lang="en"), t.literal("b", lang="fr")),
    )
    assert got == [lit("ob"), lit("fo"), None, True, False, False, lit("ab", lang="en"), lit("ab")]
