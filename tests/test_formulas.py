import pytest

from tickframe.functions.formulas import equation, evaluated


def test_equations(spark):
    rows = spark.createDataFrame([(3.0, -4.0), (0.5, 2.0)], "x double, y double")
    got = evaluated(rows, {"a": "abs(x * y) + 1e1", "b": "case when a > 12 then power(x, 2) else -y end"}).collect()
    assert [(r.a, r.b) for r in got] == [(22.0, 9.0), (11.0, -2.0)]


@pytest.mark.parametrize("text", ["x + z", "reflect(x)", "x; drop", "java_method(x)", "'a'", "x + `y`"])
def test_unknown_names_are_told(spark, text):
    with pytest.raises(ValueError):
        equation(text, {"x", "y"})
