import pytest
from pyspark.sql import functions as F

from tripleframe import vocab as V
from tripleframe.functions import terms as t
from tripleframe.operators import aggregates as A
from tripleframe.operators.bindings import Bindings

one, one0 = t.literal_key(1), t.literal_key("1.0", datatype=V.DECIMAL)


@pytest.fixture()
def b(spark):
    rows = [("g1", one), ("g1", one0), ("g1", one), ("g1", t.literal_key(10)), ("g2", None), (None, t.literal_key("9"))]
    return Bindings(spark.createDataFrame(rows, "g string, x string"), [])


def by(b, *cols):
    return {r["g"]: tuple(r[c] for c in cols) for r in b.df.collect()}


def test_counts_and_sums(b):
    x = F.col("x")
    out = A.group(b, ["g"], {
        "n": A.count_rows(), "c": A.count(x), "d": A.count_distinct(x), "s": A.sum_(x), "a": A.avg(x),
        "lo": A.min_(x), "hi": A.max_(x), "any": A.sample(x),
    })
    assert by(out, "n", "c", "d", "s", "a") == {
        "g1": (4, 4, 3, 13.0, 3.25), "g2": (1, 0, 0, 0.0, 0.0), None: (1, 1, 1, 0.0, 0.0),
    }
    assert by(out, "hi")["g1"] == (t.literal_key(10),) and by(out, "lo", "any")["g2"] == (None, None)


def test_distinct_is_over_terms(b):
    x = F.col("x")
    out = A.group_distinct(b, ["g"], "x", {"s": A.sum_(x), "a": A.avg(x)})
    assert by(out, "s", "a")["g1"] == (12.0, 4.0)


def test_count_distinct_rows_keeps_unbound(b):
    assert A.group(b, [], {"n": A.count_distinct_rows(b)}).df.first()["n"] == 5


def test_group_concat(b):
    x = F.col("x")
    out = A.group(b, ["g"], {"l": A.group_concat(x, "|"), "d": A.group_concat(x, "|", distinct=True)})
    got = by(out, "l", "d")
    assert sorted(got["g1"][0].split("|")) == ["1", "1", "1.0", "10"]
    assert sorted(got["g1"][1].split("|")) == ["1", "1.0", "10"]


def test_empty_input_and_expression_keys(b, spark):
    none = b.filter(F.lit(False))
    row = A.group(none, [], {"n": A.count_rows(), "s": A.sum_(F.col("x"))}).df.collect()
    assert [(r["n"], r["s"]) for r in row] == [(0, 0.0)]
    assert A.group(none, ["g"], {"n": A.count_rows()}).df.count() == 0
    keyed = A.group(b, [("k", F.coalesce("g", F.lit("none")))], {"n": A.count_rows()}, having=[F.col("n") > 0, F.col("n") < 4])
    assert {r["k"] for r in keyed.df.collect()} == {"g2", "none"}


def test_typed_sums_and_means(spark):
    dec = lambda x: t.literal_key(x, datatype=V.DECIMAL)
    rows = [("i", t.literal_key(9007199254740993)), ("i", t.literal_key(-1)), ("i", t.literal_key(2)), ("d", dec("0.0000000001")), ("d", t.literal_key(3)),
            ("d", dec("-0.5")), ("f", t.literal_key(1)), ("f", t.literal_key(0.5)), ("n", None), ("n", t.literal_key("x")), ("b", t.literal_key(10**20)), ("b", t.literal_key(1))]
    b = Bindings(spark.createDataFrame(rows, "g string, x string"), [])
    x = F.col("x")
    got = by(A.group(b, ["g"], {"s": A.sum_term(x), "a": A.avg_term(x), "lo": A.min_(x)}), "s", "a")
    assert got["i"] == (t.literal_key(9007199254740994), dec("3002399751580331." + "3" * 22))
    assert got["d"] == (dec("2.5000000001"), dec("0.8333333333666666666666666666666666667"))
    assert got["f"] == (t.literal_key(1.5), t.literal_key(0.75)) and got["n"] == (t.literal_key(0), t.literal_key(0))
    assert got["b"][0] == t.literal_key(10**20 + 1)
    low = Bindings(spark.createDataFrame([(t.literal_key(v),) for v in (-9007199254740993, -9007199254740992)], "x string"), [])
    assert A.group(low, [], {"m": A.min_(x)}).df.first()["m"] == t.literal_key(-9007199254740993)


def test_sums_of_long_numbers_are_exact_or_an_error(spark):
    big = "9" * 38

    def total(*numbers, of=A.sum_term):
        rows = [(f'"{n}"^^{V.XSD}{"decimal" if "." in n else "integer"}',) for n in numbers]
        df = spark.createDataFrame([*rows, (None,), ('"text"',)], "x string")
        return df.agg(of(F.col("x")).alias("s")).first()["s"][1:].split('"')[0]

    assert total("1", "9" * 37) == str(10**37)
    assert total(big, "-1") == "9" * 37 + "8"
    assert total(big, "-" + big, "5") == "5"
    assert total("00" + big, "-" + big) == "0"
    assert total("9" * 27, "1", of=A.avg_term) == "5" + "0" * 26 + ".0"
    for numbers in (("1", big), ("9" * 39,), ("-" + "9" * 39, "1"), ("1." + "0" * 28 + "1",)):
        with pytest.raises(Exception, match="digits"):
            total(*numbers)
    with pytest.raises(Exception, match="digits"):
        total("1", big, of=A.avg_term)


def test_large_groups_are_joined_in_pieces(spark):
    rows = [("a", f'"{i % 700:03d}"') for i in range(2000)] + [("b", '"x"'), ("b", None), (None, '"n"'), ("c", None), ("b", "http://iri")]
    b = Bindings(spark.createDataFrame(rows, "g string, x string"), [])
    for distinct in (False, True):
        one = A.group(b, ["g"], {"all": A.group_concat(F.col("x"), "|", distinct)}).df
        several = A.concat_groups(b, ["g"], "all", "x", "|", distinct).df
        assert sorted(map(tuple, several.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)


def test_extremes_do_not_sort_the_rows_of_few_groups(spark):
    rows = spark.range(2000).select((F.col("id") % 300).cast("string").alias("g"), t.integer_term(F.col("id")).alias("x"))
    x = F.col("x")
    out = A.group(Bindings(rows, ["g", "x"]), ["g"], {"n": A.count_rows(), "lo": A.min_(x), "hi": A.max_(x)})
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "Sort" not in plan
    # more groups than a task holds unsorted
    got = by(out, "n", "lo", "hi")
    assert len(got) == 300 and got["7"] == (7, t.literal_key(7), t.literal_key(1807)) and got["299"] == (6, t.literal_key(299), t.literal_key(1799))
