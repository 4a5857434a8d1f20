import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import calculator, exact, expressions


@pytest.mark.parametrize(("tree", "answer", "tolerance", "want"), [
    ({"op": "mul", "args": [84317, 9926]}, 836930542, 0, "ok"), ({"op": "mul", "args": [84317, 9926]}, 837042742, 0, "mismatch"),
    ({"op": "add", "args": [2, 2]}, "4", 0, "ok"), ({"op": "div", "args": [5, 6]}, "5/6", None, "ok"), ({"op": "div", "args": [1, 0]}, 1, 0, "error"),
    ({"op": "pow", "args": [0, -1]}, 1, 0, "error"), ({"op": "round", "args": ["2.675", 2]}, 2.68, 0, "ok"), ({"op": "sqrt", "args": [2, 3]}, "1.414", 0, "ok"),
    ({"op": "gt", "args": [3, 2]}, True, 0, "ok"), ({"op": "gt", "args": [3, 2]}, 1, 0, "mismatch"), ({"op": "add", "args": [True, 1]}, 2, 0, "error"),
    ({"op": "percent_of", "args": [15, 240]}, 36, 0, "ok"), ({"op": "nope", "args": [1]}, 1, 0, "error"), ({"op": "add", "args": []}, 0, 0, "error"),
    ({"op": "add", "args": [1], "x": 1}, 1, 0, "error"), ({"op": "add", "args": [1.1, 2.2]}, 3.3, 0, "ok"), ({"op": "sub", "args": [5, 2]}, 3.4, 0.5, "ok"), ({"op": "sub", "args": [5, 2]}, 3, -1, "error"),
    ({"op": "min", "args": [3, "1/2", 2]}, 0.5, 0, "ok"), ({"op": "neg", "args": [{"op": "abs", "args": [-3]}]}, -3, 0, "ok"),
])
def test_verified(spark, tree, answer, tolerance, want):
    df = spark.createDataFrame([(json.dumps(tree), json.dumps(answer), None if tolerance is None else float(tolerance))], "e string, a string, t double")
    assert df.select(exact.verified(F.col("e"), F.col("a"), F.col("t"))).first()[0] == want


def test_nulls_and_broken_json(spark):
    df = spark.createDataFrame([(None, "1", 0.0), ("{", "1", 0.0), ("1", None, 0.0), ("1", "1", None)], "e string, a string, t double")
    assert [r[0] for r in df.select(exact.verified(F.col("e"), F.col("a"), F.col("t"))).collect()] == ["error", "error", "error", "ok"]
    assert [r[0] for r in df.select(exact.expression_value(F.col("e"))).collect()] == [None, None, "1", "1"]


def test_frozen_operations(spark):
    df = spark.createDataFrame([('{"op":"max","args":[1,2]}', "2", 0.0)], "e string, a string, t double")
    assert df.select(exact.verified(F.col("e"), F.col("a"), F.col("t"), frozen=True)).first()[0] == "error"


def test_shortest_is_exact():
    r = random.Random(1)
    for _ in range(500):
        value = Fraction(r.randrange(-5000, 5000), r.choice([1, 2, 3, 4, 5, 8, 10, 40, 125, 7]))
        assert Fraction(exact.shortest(value)) == value
    assert exact.shortest(Fraction(1, 8)) == "0.125" and exact.shortest(Fraction(-3, 2)) == "-1.5" and exact.shortest(Fraction(1, 3)) == "1/3" and exact.shortest(Fraction(100)) == "100"


def call(tool, **arguments):
    return json.dumps({"protocol_version": "1.0.0", "tool": f"calculator.{tool}", "arguments": arguments})


@pytest.mark.parametrize(("expression", "want"), [
    ("377723*982", ("370923986", True)), ("7 % -3", ("-2", True)), ("7 // 2", ("3", True)), ("1/4", ("0.25", False)), ("2**10", ("1024", True)), ("2**-1", ("0.5", False)), ("cbrt(64)", ("3.9999999999999996", False)),
    ("factorial(20)", (str(2432902008176640000), True)), ("abs(-3)", ("3", True)), ("sqrt(2)", ("1.4142135623730951", False)), ("log(100)", ("2.0", False)),
    ("pi", ("3.141592653589793", False)), ("-(3)", ("-3", True)), ("reciprocal(4)", ("0.25", False)),
])
def test_evaluate(expression, want):
    r = calculator.executed(call("evaluate", expression=expression))
    assert r["status"] == "success" and (r["result"]["value"], r["result"]["exact"]) == want


@pytest.mark.parametrize(("expression", "code"), [
    ("1/0", "DIVISION_BY_ZERO"), ("1 % 0", "DIVISION_BY_ZERO"), ("0**-1", "DIVISION_BY_ZERO"), ("sqrt(-1)", "DOMAIN_ERROR"), ("ln(0)", "DOMAIN_ERROR"), ("factorial(1.5)", "DOMAIN_ERROR"), ("factorial(5001)", "RESOURCE_LIMIT"),
    ("9**9**9", "RESOURCE_LIMIT"), ("2**5000", "RESOURCE_LIMIT"), ("1" * 41, "RESOURCE_LIMIT"), ("1+" * 300 + "1", "RESOURCE_LIMIT"), ("__import__('os')", "INVALID_ARGUMENT_VALUE"), ("x+1", "INVALID_ARGUMENT_VALUE"),
    ("(lambda: 1)()", "INVALID_ARGUMENT_VALUE"), ("[1]", "INVALID_ARGUMENT_VALUE"), ("1 if 1 else 2", "INVALID_ARGUMENT_VALUE"), ("True", "INVALID_ARGUMENT_VALUE"), ("'a'", "INVALID_ARGUMENT_VALUE"), ("", "INVALID_ARGUMENT_VALUE"),
    ("abs(1, 2)", "INVALID_ARGUMENT_VALUE"), ("abs(x=1)", "INVALID_ARGUMENT_VALUE"), ("1e308*10", "NON_FINITE_RESULT"), ("(-8)**0.5", "DOMAIN_ERROR"), ("~1", "INVALID_ARGUMENT_VALUE"), ("1<2", "INVALID_ARGUMENT_VALUE"),
])
def test_refused_expressions(expression, code):
    assert calculator.executed(call("evaluate", expression=expression))["error"]["code"] == code


@pytest.mark.parametrize(("source", "target", "kind", "value", "want"), [
    ("inch", "meter", "length", 1, 0.0254), ("foot", "meter", "length", 1, 0.3048), ("mile", "meter", "length", 1, 1609.344), ("pound", "gram", "mass", 1, 453.59237), ("kibibyte", "byte", "data_storage", 1, 1024), ("kilobyte", "byte", "data_storage", 1, 1000),
    ("fahrenheit", "celsius", "temperature", 212, 100), ("celsius", "kelvin", "temperature", 0, 273.15), ("kilometers_per_hour", "meters_per_second", "speed", 36, 10),
])
def test_convert(source, target, kind, value, want):
    r = calculator.executed(call("convert", category=kind, from_unit=source, to_unit=target, value=value))
    assert abs(float(r["result"]["value"]) - want) < 1e-12


@pytest.mark.parametrize(("text", "code"), [
    ('{"a":1,"a":2}', "DUPLICATE_JSON_KEY"), ('{"a":NaN}', "MALFORMED_CALL"), (call("evaluate", expression="1") + " x", "MALFORMED_CALL"), ("[]", "MALFORMED_CALL"), ("null", "MALFORMED_CALL"), ('"s"', "MALFORMED_CALL"),
    ('{"protocol_version":"1.0.0","tool":"calculator.evaluate","arguments":{},"x":1}', "MALFORMED_CALL"), ("x" * 9000, "RESOURCE_LIMIT"), ('{"protocol_version":"2","tool":"calculator.evaluate","arguments":{}}', "UNSUPPORTED_PROTOCOL_VERSION"),
    (call("nope"), "UNKNOWN_TOOL"), (call("evaluate"), "MISSING_ARGUMENT"), (call("evaluate", expression="1", y=2), "UNKNOWN_ARGUMENT"), (call("evaluate", expression=1), "INVALID_ARGUMENT_TYPE"),
    (call("convert", category="length", from_unit="inch", to_unit="parsec", value=1), "UNSUPPORTED_UNIT"), (call("convert", category="love", from_unit="a", to_unit="b", value=1), "INVALID_ARGUMENT_VALUE"),
    (call("convert", category="length", from_unit="inch", to_unit="meter", value="1"), "INVALID_ARGUMENT_TYPE"), ("[" * 2000, "MALFORMED_CALL"),
])
def test_refused_calls(text, code):
    r = calculator.executed(text)
    assert r["error"]["code"] == code and r["result"] is None
    assert r["status"] == {"UNKNOWN_TOOL": "unsupported"}.get(code, "error")


def test_unavailable_tool():
    assert calculator.executed(call("evaluate", expression="1"), frozenset())["status"] == "unavailable"


@pytest.mark.parametrize(("operation", "arguments", "want"), [
    ("percentage_of", {"number": 240, "percent": 15}, "36.000000"), ("percentage_difference", {"old_value": -50, "new_value": 50}, "200.000000"), ("split_bill", {"bill_total": 100, "num_people": 3}, "33.33"),
    ("compound_interest", {"principal": 1000, "annual_rate_percent": 5, "years": 2}, "1102.50"), ("tip", {"bill_total": 0.125, "tip_percent": 100}, "0.13"), ("simple_interest", {"principal": 100, "annual_rate_percent": 5, "years": 3}, "15.00"),
])
def test_formulas(operation, arguments, want):
    assert calculator.executed(call("finance", operation=operation, **arguments))["result"]["value"] == want


def test_calls_in_a_frame(spark):
    df = spark.createDataFrame([(call("evaluate", expression="1+1"),), (None,), ("x",)], "c string")
    rows = df.select(calculator.run_call(F.col("c")).alias("r")).select("r.status", "r.value", "r.exact", "r.code").collect()
    assert [tuple(r) for r in rows] == [("success", "2", True, None), (None, None, None, None), ("error", None, None, "MALFORMED_CALL")]
    texts = spark.createDataFrame([('{"b": 1.50, "a": [1e3, "é"]}',), ("{",), (None,)], "c string")
    assert [r[0] for r in texts.select(calculator.canonical_json(F.col("c"))).collect()] == ['{"a":[1000.0,"é"],"b":1.5}', None, None]


@pytest.mark.parametrize(("expression", "want"), [("2**-(1+1)", 0.25), ("(2**12)**341", 2**4092), ("1.5**2", 2.25), ("(-8)**3", -512), ("0**0", 1), ("1**99999", 1), ("-2**2", -4), ("10**40 // 10**38", 100), ("reciprocal(-0.5)", -2.0), ("7.5 // 2", 3.0)])
def test_more_expressions(expression, want):
    value, exact_ = expressions.computed(expression)
    assert value == want and exact_ == isinstance(want, int)


@pytest.mark.parametrize(("expression", "code"), [
    ("2**4097", "RESOURCE_LIMIT"), ("3**2585", "RESOURCE_LIMIT"), ("1.0001**20000", "RESOURCE_LIMIT"), ("10.5**400", "OVERFLOW"), ("0.0**-2", "DIVISION_BY_ZERO"), ("9999999999999999999999999999999999999999 + 1", None),
    ("10000000000000000000000000000000000000000", "RESOURCE_LIMIT"), ("0.1000000000000000000000000000000000000000000001", None), ("(" * 39 + "1" + ")" * 39, None), ("-" * 39 + "1", None), ("-" * 40 + "1", "RESOURCE_LIMIT"), ("1j", "INVALID_ARGUMENT_VALUE"),
    ("factorial(3)(4)", "INVALID_ARGUMENT_VALUE"), ("a.b", "INVALID_ARGUMENT_VALUE"), ("1;2", "INVALID_ARGUMENT_VALUE"), ("1 and 2", "INVALID_ARGUMENT_VALUE"), ("1@2", "INVALID_ARGUMENT_VALUE"), ("1<<2", "INVALID_ARGUMENT_VALUE"),
])
def test_limits_of_expressions(expression, code):
    result = calculator.executed(call("evaluate", expression=expression))
    assert (result["error"] or {}).get("code") == code


def test_power_limit_is_exact():
    """The greatest power allowed has 4,096 bits times its exponent's logarithm, told by whole numbers."""
    for base in (2, 3, 7, 10, 12345, 2**40 - 1):
        most = max(k for k in range(1, 4100) if base**k <= 2**4096)
        assert expressions.computed(f"{base}**{most}")[0] == base**most
        with pytest.raises(expressions.Refused):
            expressions.computed(f"{base}**{most + 1}")


def test_trees_equal_plain_recursion():
    """Random trees against a direct recursion over Python's own operators."""
    r = random.Random(4)
    own = {"add": sum, "mul": lambda x: x[0] * x[1] * x[2] if len(x) == 3 else x[0] * x[1], "sub": lambda x: x[0] - x[1], "min": min, "max": max, "neg": lambda x: -x[0]}

    def grow(depth):
        if depth == 0 or r.random() < 0.2:
            n = r.randrange(-9, 10)
            return n, Fraction(n)
        name = r.choice(list(own))
        args = [grow(depth - 1) for _ in range(1 if name == "neg" else 2 if name == "sub" else r.choice([2, 3]))]
        return {"op": name, "args": [a for a, _ in args]}, own[name]([v for _, v in args])

    for _ in range(200):
        tree, value = grow(4)
        assert exact.evaluate(tree) == value


def test_deep_trees_do_not_end_the_worker():
    tree = 1
    for _ in range(5000):
        tree = {"op": "neg", "args": [tree]}
    assert exact.evaluate(tree) == 1


def test_results_round_trip():
    result = calculator.executed(call("evaluate", expression="2+2"))
    assert calculator.parsed_result(calculator.canonical(result)) == result
    failed = calculator.executed(call("evaluate", expression="1/0"))
    assert calculator.parsed_result(calculator.canonical(failed)) == failed and calculator.wired("tool_result", failed).startswith('<tool_result>{"error":{"code":"DIVISION_BY_ZERO"')
    for text in ('{"protocol_version":"1.0.0"}', "[]", "{", calculator.canonical(result | {"error": {"code": "X"}}), calculator.canonical(result | {"result": 4})):
        with pytest.raises(calculator.Refused):
            calculator.parsed_result(text)


def test_registry_is_closed():
    registry = calculator.Registry()
    text = call("evaluate", expression="1+1")
    assert registry.execute(text)["status"] == "success" and registry.known("calculator.convert") and not registry.known("shell")
    registry.set_available("calculator.evaluate", False)
    assert registry.execute(text)["status"] == "unavailable"
    registry.register("calculator.evaluate", lambda arguments: {"value": "own"})
    assert registry.execute(text)["result"] == {"value": "own"} and registry.get("calculator.nope") is None
    with pytest.raises(ValueError):
        registry.register("shell", dict)
    with pytest.raises(KeyError):
        registry.set_available("shell", True)
    assert calculator.Registry({}).execute(text)["status"] == "unsupported"


def test_schemas_name_every_argument():
    made = calculator.schemas()
    assert list(made) == ["call", "result", "evaluate_arguments", "convert_arguments", "finance_arguments"]
    assert made["call"]["properties"]["tool"]["enum"] == calculator.TOOLS and len(made["finance_arguments"]["oneOf"]) == len(calculator.FORMULAS)
    assert all(f["required"][0] == "operation" for f in made["finance_arguments"]["oneOf"]) and json.dumps(made)
