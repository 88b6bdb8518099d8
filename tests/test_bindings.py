"""Unbound variables: split joins against the condition written out, on every null pattern."""

import pytest
from pyspark.sql import functions as F

from tripleframe.operators.bindings import Bindings, values


def compatible(l, r, shared):
    return all(l[v] is None or r[v] is None or l[v] == r[v] for v in shared)


LEFT = [("a", "1", "l1"), ("a", None, "l2"), (None, "1", "l3"), (None, None, "l4"), ("b", "2", "l5"), ("b", "2", "l5")]
RIGHT = [("a", "1", "r1"), ("a", None, "r2"), (None, "2", "r3"), ("c", "9", "r4")]


@pytest.fixture()
def pair(spark):
    left = Bindings(spark.createDataFrame(LEFT, "x string, y string, l string"), ["l"])
    right = Bindings(spark.createDataFrame(RIGHT, "x string, y string, r string"), ["r"])
    return left, right


def dicts(rows, third):
    return [dict(zip(("x", "y", third), r)) for r in rows]


def result(b):
    return sorted([tuple(r) for r in b.df.select(*sorted(b.variables)).collect()], key=str)


def merged(l, r):
    out = {**r, **{k: v for k, v in l.items() if v is not None}}
    return tuple(out.get(k) for k in sorted(set(l) | set(r)))


def test_join(pair):
    want = [merged(l, r) for l in dicts(LEFT, "l") for r in dicts(RIGHT, "r") if compatible(l, r, "xy")]
    assert result(pair[0].join(pair[1])) == sorted(want, key=str)


def test_optional(pair):
    want = []
    for l in dicts(LEFT, "l"):
        hits = [merged(l, r) for r in dicts(RIGHT, "r") if compatible(l, r, "xy")]
        want += hits or [(l["l"], None, l["x"], l["y"])]
    assert result(pair[0].optional(pair[1])) == sorted(want, key=str)


def test_minus_needs_a_shared_bound_variable(pair):
    def removed(l):
        return any(
            compatible(l, r, "xy") and any(l[v] is not None and r[v] is not None for v in "xy")
            for r in dicts(RIGHT, "r")
        )

    want = [(l["l"], l["x"], l["y"]) for l in dicts(LEFT, "l") if not removed(l)]
    assert result(pair[0].minus(pair[1])) == sorted(want, key=str)


def test_exists_and_not_exists(pair):
    def hit(l):
        return any(compatible(l, r, "xy") and r["r"] != "r4" for r in dicts(RIGHT, "r"))

    def cond(l, r):
        return r("r") != "r4"

    keep = sorted([(l["l"], l["x"], l["y"]) for l in dicts(LEFT, "l") if hit(l)], key=str)
    drop = sorted([(l["l"], l["x"], l["y"]) for l in dicts(LEFT, "l") if not hit(l)], key=str)
    assert result(pair[0].exists(pair[1], cond)) == keep
    assert result(pair[0].not_exists(pair[1], cond)) == drop


def test_values_undef_and_intersection(spark):
    v = values(spark, ["x", "y"], [("a", None), (None, "2")])
    assert v.certain == frozenset()
    data = Bindings(spark.createDataFrame([("a", "1"), ("b", "2")], "x string, y string"))
    assert result(data.join(v)) == [("a", "1"), ("b", "2")]
    both = values(spark, ["x"], [("a",), ("a",), ("b",)]).join(values(spark, ["x"], [("a",), ("c",)]))
    assert result(both) == [("a",), ("a",)]


def test_union_certainty(spark):
    a = Bindings(spark.createDataFrame([("1", "2")], "x string, y string"))
    b = Bindings(spark.createDataFrame([("3",)], "x string"))
    u = a.union(b)
    assert u.certain == {"x"} and u.variables == ["x", "y"]


def test_product(spark):
    a = Bindings(spark.createDataFrame([("1",), ("2",)], "x string"))
    b = Bindings(spark.createDataFrame([("3",), ("4",)], "y string"))
    assert a.join(b).df.count() == 4
    assert a.filter(F.lit(True)).optional(b.filter(F.lit(False))).df.count() == 2


def test_exists_as_a_flag_beside_unbound_variables(pair):
    """EXISTS inside a larger condition, with and without a condition that reads both sides."""
    left, right = pair
    hit = lambda l: any(compatible(l, r, "xy") for r in dicts(RIGHT, "r"))
    got = left.filter_exists(right, lambda e: e | (F.col("l") == "l5"))
    assert result(got) == sorted([(r[2], r[0], r[1]) for r in LEFT if hit(dict(zip("xyl", r))) or r[2] == "l5"], key=str)
    got = left.filter_exists(right, lambda e: ~e)
    assert result(got) == sorted([(r[2], r[0], r[1]) for r in LEFT if not hit(dict(zip("xyl", r)))], key=str)
    wanted = lambda l: any(compatible(l, r, "xy") and r["r"] > "r1" for r in dicts(RIGHT, "r"))
    for got, keep in (
        (left.filter_exists(right, lambda e: e, lambda l, r: r("r") > "r1"), True), (left.exists(right, lambda l, r: r("r") > "r1"), True),
        (left.not_exists(right, lambda l, r: r("r") > "r1"), False),
    ):
        assert result(got) == sorted([(r[2], r[0], r[1]) for r in LEFT if wanted(dict(zip("xyl", r))) == keep], key=str)


def test_each_side_is_read_once(pair, spark, tmp_path):
    paths = []
    for name, side in zip("lr", pair):
        side.df.write.parquet(f"{tmp_path}/{name}")
        paths.append(Bindings(spark.read.parquet(f"{tmp_path}/{name}"), side.certain))
    left, right = paths
    for made in (
        left.join(right), left.optional(right), left.minus(right), left.exists(right), left.not_exists(right),
        left.filter_exists(right, lambda e: e | F.col("l").isNull()), left.optional(right, lambda l, r: r("r") > l("l")),
    ):
        plan = made.df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_unbound_variables(spark):
    rng = __import__("random").Random(6)
    names = ["a", "b", "c", "d"]
    make = lambda n, third: [tuple(rng.choice([None, "1", "2"]) for _ in names) + (f"{third}{i}",) for i in range(n)]
    rows_l, rows_r = make(40, "l"), make(30, "r")
    left = Bindings(spark.createDataFrame(rows_l, "a string, b string, c string, d string, l string"), ["l"])
    right = Bindings(spark.createDataFrame(rows_r, "a string, b string, c string, d string, r string"), ["r"])
    ls, rs = [dict(zip([*names, "l"], r)) for r in rows_l], [dict(zip([*names, "r"], r)) for r in rows_r]
    want = [merged(l, r) for l in ls for r in rs if compatible(l, r, names)]
    assert result(left.join(right)) == sorted(want, key=str)
    alone = [merged(l, {"r": None, **dict.fromkeys(names)}) for l in ls if not any(compatible(l, r, names) for r in rs)]
    assert result(left.optional(right)) == sorted(want + alone, key=str)
    shares = lambda l, r: any(l[v] is not None and l[v] == r[v] for v in names)
    kept = [tuple(l[k] for k in sorted(l)) for l in ls if not any(compatible(l, r, names) and shares(l, r) for r in rs)]
    assert result(left.minus(right)) == sorted(kept, key=str)


def test_join_on_equal_values(spark):
    from tripleframe import vocab as V
    from tripleframe.functions import terms as t
    from tripleframe.functions.terms import literal_key as lit

    x = V.XSD
    terms = [
        lit(1), lit("1.0", datatype=V.DECIMAL), '"1e0"^^' + V.DOUBLE, '"01"^^' + x + "int", lit("0.1", datatype=V.DECIMAL), '"0.1"^^' + V.FLOAT,
        lit(2**60), lit(2**60 + 1), '"1.152921504606847E18"^^' + V.DOUBLE, '"-0.0"^^' + V.DOUBLE, lit(0), '"NaN"^^' + V.DOUBLE, '"bad"^^' + V.DOUBLE,
        lit("2020-01-01T00:00:00", datatype=V.DATETIME), lit("2020-01-01", datatype=V.DATE), lit("2020-01-01T01:00:00+01:00", datatype=V.DATETIME),
        lit(True), '"1"^^' + V.BOOLEAN, lit("a"), lit("a", lang="en"), lit("1"), "http://a", "_:a", '"q"^^http://own', None,
    ]
    rows = [(f"k{i % 2}", str(i), v) for i, v in enumerate(terms)]
    left = Bindings(spark.createDataFrame(rows, "k string, i string, x string"), ["k", "i"])
    right = Bindings(spark.createDataFrame(rows, "k string, j string, y string"), ["k", "j"])
    plain = left.join(right).filter(t.eq(F.col("x"), F.col("y")))
    got = left.join_equal(right, ("x", "y"))
    assert got.variables == plain.variables and result(got) == result(plain) and len(result(got)) > len(terms)
    one = Bindings(left.df.drop("k"), ["i"])
    pairs = one.join_equal(Bindings(right.df.drop("k"), ["j"]), ("x", "y"))
    wide = one.join(Bindings(right.df.drop("k"), ["j"])).filter(t.eq(F.col("x"), F.col("y")))
    assert result(pairs) == result(wide)
    assert "NestedLoop" not in pairs.df._jdf.queryExecution().toString() and "Cartesian" not in pairs.df._jdf.queryExecution().toString()
