"""Values made what they should be."""

from decimal import Decimal

from sievewright.functions import values as V

ODD = ["12", " 7\n", "+3", "-0", "1_000", "1__0", "12.5", "1e3", "", " ", "x", None, "9223372036854775808", "9223372036854775807", ".5", "5.", "-.5E-2", "1d", "2f", "inf", "-Infinity", "nan", "1_0.2_5", "_1", "٣x"]


def _is(kind, text, default):
    try:
        return kind(text)
    except (TypeError, ValueError):
        return default


def test_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    rows = df.select("i", V.to_long(df.t, -5).alias("n"), V.to_double(df.t, -5).alias("x")).orderBy("i").collect()
    whole = [_is(int, t, -5) for t in ODD]
    assert [r.n for r in rows] == [n if -(2**63) <= n < 2**63 else -5 for n in whole]
    assert [str(r.x) for r in rows] == [str(_is(float, t, -5.0)) for t in ODD]


def test_choice_and_metadata(spark):
    df = spark.createDataFrame([("  report ", "Company"), ("Report", None), (None, " company ")], "f string, t string")
    assert [tuple(r) for r in df.select(V.choice(df.f, V.FORMATS), V.choice(df.t, V.TARGETS, lower=True)).collect()] == [("report", "company"), ("summary", "discovery"), ("summary", "company")]
    odd = spark.createDataFrame([(1, True, 1.5, Decimal("2.50"), " a  b ", ["x", None], None)], "`a.b` int, b boolean, c double, d decimal(5,2), `e` string, f array<string>, g string")
    assert [tuple(r) for r in V.clean_metadata(odd).collect()] == [(1, True, 1.5, "2.50", "a b", '["x",null]', "")]
    assert V.clean_metadata(odd).columns == odd.columns
    assert V.clean_metadata(odd.filter("false")).count() == 0


def test_override():
    stated = {"N": "7", "X": "0.5", "B": " Off ", "T": " a  b ", "BAD": "x", "EMPTY": " "}
    assert [V.override("N", 3, 3, stated), V.override("N", 4, 3, stated), V.override("BAD", 3, 3, stated), V.override("EMPTY", 3, 3, stated), V.override("GONE", 3, 3, stated)] == [7, 4, 3, 3, 3]
    assert [V.override("X", 1.0, 1.0, stated), V.override("BAD", 1.0, 1.0, stated), V.override("B", True, True, stated), V.override("N", False, False, stated), V.override("T", "d", "d", stated)] == [0.5, 1.0, False, True, "a b"]
