import math

import pytest
from pyspark.sql import functions as F

from gridloom.errors import RasterAlgebraException
from gridloom.plans.formula import Value, compile_arrays, compile_formula, names_in, parse, register_function

E, PI = math.e, math.pi

# Formulas whose results must come out so.
CONSTANT = [
    ("9", 9), ("-9", -9), ("--9", 9), ("+9 - 8", 1), ("9 + 3 / 11", 9 + 3 / 11), ("(9 + 3) / 11", 12 / 11), ("9 - 12 - 6", -9), ("9 - (12 - 6)", 3),
    ("PI * PI / 10", PI * PI / 10), ("round(PI^2)", 10), ("6.02E23 * 8.048", 6.02e23 * 8.048), ("sin(PI / 2)", 1), ("-E", -E), ("int(-E)", -2), ("round(-E)", -3),
    ("E^PI", E**PI), ("2^3^2", 512), ("2^3^(2 + 1)", 2**27), ("-2^2", 4), ("sign(-2)", -1), ("exp(0)", 1), ("log(1)", 0), ("FALSE | TRUE", True), ("TRUE & FALSE", False),
    ("2 >= 1", True), ("1 != 2", True), ("!TRUE", False), ("!-1", False), ("(2 + 3 * 6) * ((2 + 3 * (3 * 4 + 1)) + 4 + 5)", 1000), ("INF > 0", True), ("-INF > 0", False),
    ("~300", 300), ("round(2.5)", 2), ("1 + 2 > 1", 2), ("nan == nan", False), ("nan != nan", True), ("nan > 1", False), ("1 < nan", False), ("1 / 0", math.inf),
    ("(1 > 0) + (2 > 0)", True), ("2 * (1 > 0)", 2), ("log(0)", -math.inf), ("median(3)", 3),
]


@pytest.mark.parametrize("formula, want", CONSTANT)
def test_constants(spark, formula, want):
    from pyspark.sql import Window

    got = spark.range(1).select(compile_formula(formula, {}, Window.partitionBy("id")).column.alias("v")).first()[0]
    assert got == pytest.approx(want, rel=1e-12) and (isinstance(got, bool) == isinstance(want, bool) or isinstance(want, (int, float)))


VARIABLES = {"x": [1.2, 0.0, -1.2], "y": [0.0, 1.0, 0.0], "z": [-5.0, 78.0, 912.0], "a": [2.0, 4.0, 6.0], "a_1_a": [1.0, 2.0, 3.0], "1b": [7.0, 8.0, 9.0]}
ROWS = [
    ("x == 0", lambda x, y, z, a: x == 0), ("(x >= 0) & (x <= 0)", lambda x, y, z, a: x == 0), ("x + y + z + a", lambda x, y, z, a: x + y + z + a),
    ("\n x \n + \r y", lambda x, y, z, a: x + y), ("x*(x>1) + 2*y + 3*z*(z==78)", lambda x, y, z, a: x * (x > 1) + 2 * y + 3 * z * (z == 78)), ("-a_1_a", lambda x, y, z, a: -a / 2),
    ("a + x > 0", lambda x, y, z, a: a + (x > 0)), ("((a * 2) + (x * 3)) * 6", lambda x, y, z, a: (a * 2 + x * 3) * 6), ("1b - 5", lambda x, y, z, a: a / 2 + 1),
    ("max(z) - min(a)", lambda x, y, z, a: 910), ("mean(y) * 3 + median(z)", lambda x, y, z, a: 79), ("sum(a) / std(a)", lambda x, y, z, a: 12 / math.sqrt(8 / 3)),
]


@pytest.mark.parametrize("formula, want", ROWS)
def test_variables_as_pixels_and_as_arrays(spark, formula, want):
    from pyspark.sql import Window

    columns = list(zip(*VARIABLES.values(), strict=True))
    expected = [float(want(*row[:4])) for row in columns]
    pixels = spark.createDataFrame([(1, i, *r) for i, r in enumerate(columns)], "tile int, pos int, " + ", ".join(f"`{n}` double" for n in VARIABLES))
    value = compile_formula(formula, {n: Value(F.col(f"`{n}`")) for n in VARIABLES}, Window.partitionBy("tile"))
    assert [r[0] for r in pixels.select(value.number, "pos").orderBy("pos").collect()] == pytest.approx(expected)
    tile = spark.createDataFrame([tuple(VARIABLES.values())], ", ".join(f"`{n}` array<double>" for n in VARIABLES))
    array, _ = compile_arrays(formula, {n: Value(F.col(f"`{n}`")) for n in VARIABLES})
    got = tile.select(F.transform(array, lambda v: v.cast("double"))).first()[0]
    assert (got * 3 if len(got) == 1 else got) == pytest.approx(expected)


def test_nodata_rules(spark):
    rows = spark.createDataFrame([(None, 1.0), (2.0, None), (3.0, 3.0)], "x double, y double")
    v = {"x": Value(F.col("x"), "double", True, 99.0), "y": Value(F.col("y"), "double", True, 100.0)}
    result = lambda f: [r[0] for r in rows.select(compile_formula(f, v).column).collect()]
    assert result("x + y") == [None, None, 6.0]
    assert result("~x + y") == [100.0, None, 6.0]
    assert result("~x + ~y") == [100.0, 102.0, 6.0]
    assert result("x == NULL") == [True, False, False] and result("NULL != x") == [False, True, True]
    assert result("(x > 5) & (y > 0)") == [None, None, False] and result("(x > 0) | (y > 0)") == [None, None, True]
    assert result("~x == NULL") == [False] * 3 and result("+x") == [99.0, 2.0, 3.0]
    assert result("log(x - 3)") == [None] * 3 and result("1 / (x - 3)") == [None, -1.0, None]


@pytest.mark.parametrize("formula, message", [
    ("", "no formula"), ("3 * not_a_var", "uses 'not_a_var'"), ("x >= NULL", "NULL stands"), ("(x", "Expected"), ("x)", "Unexpected"), ("x +", "too early"),
    ("x $ 2", "Cannot read"), ("foo(x)", "calls 'foo'"), ("-(x > 1)", "negated"), ("(x > 1) - (x > 2)", "subtracted"), ("max(x)", "needs the pixels"), ("NULL", "NULL stands"),
])
def test_errors(spark, formula, message):
    with pytest.raises(RasterAlgebraException, match=message):
        compile_formula(formula, {"x": Value(F.col("x"))})


def test_names_and_own_functions(spark):
    assert names_in(parse("a + PI * b_1 / sin(c) & TRUE")) == {"a", "b_1", "c"}
    register_function("half", lambda c: c / 2)
    assert spark.range(1).select(compile_formula("half(5)", {}).column).first()[0] == 2.5
    with pytest.raises(RasterAlgebraException):
        register_function("max", lambda c: c)
