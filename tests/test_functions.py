from pyspark.sql import functions as F

from tabloom.functions import cells as C
from tabloom.functions import text as T
from tabloom.functions.formulas import equivalent, infer, remap_formula, shift_formula


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def test_text(spark):
    lit = F.lit
    assert one(spark, T.sqlite_integer(lit("12x")), T.sqlite_integer(lit("version-12")), T.sqlite_integer(lit(" -7")), T.sqlite_integer(lit(None).cast("string"))) == (12, 0, -7, 0)
    assert one(spark, T.sqlite_integer(lit("12345678901234567890x")), T.sqlite_integer(lit("-12345678901234567890")), T.sqlite_integer(lit("9223372036854775807"))) == (2**63 - 1, -(2**63), 2**63 - 1)
    assert one(spark, T.nocase(lit("ÁB")))[0] == "Áb"
    assert one(spark, T.redacted(lit("Token: abc; Authorization=Bearer xyz, bearer q")))[0] == "Token: [REDACTED]; Authorization=[REDACTED], Bearer [REDACTED]"
    assert one(spark, T.safe_stem(lit("dir/Ção 1.xlsx")), T.safe_stem(lit("??.xlsx"))) == ("Ção_1", "sheet")
    assert one(spark, T.clock(lit(59)), T.clock(lit(3661))) == ("00:59", "01:01:01")
    assert one(spark, T.scope_list(lit("a; b;;a")))[0] == ["a", "b"]
    assert one(spark, T.natural_key(lit("File 2")) < T.natural_key(lit("file 10")))[0]
    assert one(spark, T.size_of(lit("x"), lit("7")))[0] == 7


def test_envelopes(spark):
    for body in ('{"value":[1,2]}', '{"d":{"results":[1,2]}}', '{"d":[1,2]}'):
        assert one(spark, T.json_value(F.lit(body)))[0] == "[1,2]"
    assert one(spark, T.next_page(F.lit('{"d":{"__next":"u"}}')), T.next_page(F.lit('{"@odata.nextLink":"v"}'))) == ("u", "v")


def test_addresses_and_equality(spark):
    rows = spark.createDataFrame([("B2",), ("AA1",), ("a3",), ("bad",), ("B10",)], "a string")
    assert [r.a for r in rows.orderBy(*C.order_key(F.lit("s"), F.col("a"))).collect()] == ["AA1", "B2", "a3", "B10", "bad"]
    key = lambda k, t: C.equality_key(F.lit(k), F.lit(t))
    got = one(spark, key("num", "15"), key("num", "15.0"), key("str", "15"), key("bool", "False"), key("num", "0"), key("num", "-0.0"))
    assert got[0] == got[1] != got[2] and got[3] != got[4] == got[5]


def test_formulas():
    assert shift_formula('A1+$B2+C$3&"A1"', "A1", "B3") == 'B3+$B4+D$3&"A1"'
    assert shift_formula("A1", "B2", "A1") == "#REF!"
    assert remap_formula("=SUM(A5:A9)", {5: 6, 9: 10}, {}) == "=SUM(A6:A10)"
    assert equivalent("=A5 + b9", "=$A$6+B10", {5: 6, 9: 10}, {}) and not equivalent("=A5", "=A7", {5: 6}, {})
    assert [infer(p, {2: 3, 8: 9, 20: 25}) for p in (1, 5, 10, 30, 8)] == [2, 6, 10, 35, 9]
