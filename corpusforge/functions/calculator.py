"""The deterministic calculator: strict calls in, canonical results out, in Arrow batches.

A call is JSON ``{"protocol_version", "tool", "arguments"}``; a result is canonical JSON with ``status`` success,
error, unavailable or unsupported.  Nothing in a call can raise: every refusal is a result with a code.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal, DecimalException, localcontext
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.expressions import CONSTANTS, FUNCTION_NAMES, SYMBOLS, Refused, computed
from corpusforge.functions.expressions import LIMITS as EXPRESSION_LIMITS

# Protocol version, tools, limits and conversion factors to each kind's base unit.
VERSION = "1.0.0"
TOOLS = ["calculator.evaluate", "calculator.convert", "calculator.finance"]
LIMITS = {"call_bytes": 8192, "string": 512, "depth": 16, "members": 64, "result_bytes": 8192}
STATUSES = ["success", "error", "unavailable", "unsupported"]
CODES = [
    "MALFORMED_CALL", "DUPLICATE_JSON_KEY", "UNSUPPORTED_PROTOCOL_VERSION", "UNKNOWN_TOOL", "TOOL_UNAVAILABLE", "MISSING_ARGUMENT", "UNKNOWN_ARGUMENT",
    "INVALID_ARGUMENT_TYPE", "INVALID_ARGUMENT_VALUE", "UNSUPPORTED_UNIT", "UNSUPPORTED_OPERATION", "DIVISION_BY_ZERO", "DOMAIN_ERROR", "OVERFLOW",
    "NON_FINITE_RESULT", "RESOURCE_LIMIT", "INTERNAL_ERROR",
]
UNITS = {
    "length": {"millimeter": "0.001", "centimeter": "0.01", "meter": "1", "kilometer": "1000", "inch": "0.0254", "foot": "0.3048", "yard": "0.9144", "mile": "1609.344"},
    "mass": {"milligram": "0.001", "gram": "1", "kilogram": "1000", "ounce": "28.349523125", "pound": "453.59237"},
    "area": {"square_meter": "1", "square_kilometer": "1000000", "square_foot": "0.09290304", "acre": "4046.8564224", "hectare": "10000"},
    "volume": {"milliliter": "0.001", "liter": "1", "cubic_meter": "1000", "gallon_us": "3.785411784", "quart_us": "0.946352946", "cup_us": "0.2365882365"},
    "speed": {"meters_per_second": "1", "kilometers_per_hour": "1000/3600", "miles_per_hour": "1609.344/3600"},
    "time": {"second": "1", "minute": "60", "hour": "3600", "day": "86400", "week": "604800"},
    "data_storage": {"byte": "1", "kilobyte": "1000", "megabyte": "1000000", "gigabyte": "1000000000", "terabyte": "1000000000000", "kibibyte": "1024", "mebibyte": "1048576", "gibibyte": "1073741824", "tebibyte": "1099511627776"},
}
DECIMALS = Context(prec=28, rounding=ROUND_HALF_UP)


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces, no escapes beyond the necessary, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


# --- units and decimal formulas --------------------------------------------------------------------------------------


def decimal(value: Any) -> Decimal:
    """A JSON number by its digits."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise Refused("INVALID_ARGUMENT_TYPE")
    if isinstance(value, float) and not math.isfinite(value):
        raise Refused("INVALID_ARGUMENT_VALUE")
    return Decimal(str(value))


def factor(kind: str, unit: str) -> Decimal:
    """Base units in one ``unit``."""
    over, _, under = UNITS[kind][unit].partition("/")
    return Decimal(over) / Decimal(under or 1)


TEMPERATURE = {  # to degrees Celsius and back
    "celsius": (lambda x: x, lambda x: x),
    "fahrenheit": (lambda x: (x - 32) * 5 / Decimal(9), lambda x: x * 9 / Decimal(5) + 32),
    "kelvin": (lambda x: x - Decimal("273.15"), lambda x: x + Decimal("273.15")),
}


def converted(kind: str, source: str, target: str, value: Decimal) -> Decimal:
    units = TEMPERATURE if kind == "temperature" else UNITS[kind]
    if source not in units or target not in units:
        raise Refused("UNSUPPORTED_UNIT")
    with localcontext(DECIMALS):
        try:
            if kind == "temperature":
                return TEMPERATURE[target][1](TEMPERATURE[source][0](value))
            return value * factor(kind, source) / factor(kind, target)
        except DecimalException as e:
            raise Refused("RESOURCE_LIMIT") from e


def _nonzero(x: Decimal, code: str) -> Decimal:
    if x == 0:
        raise Refused(code)
    return x


def _positive(x: Decimal) -> Decimal:
    if x <= 0:
        raise Refused("INVALID_ARGUMENT_VALUE")
    return x


def _growth(p: Decimal, r: Decimal, y: Decimal, n: Decimal) -> Decimal:
    try:
        return p * (1 + r / 100 / _positive(n)) ** (n * y)
    except (DecimalException, OverflowError) as e:
        raise Refused("OVERFLOW") from e


# operation: required arguments, optional ones with defaults, decimal places, formula in that order of arguments
FORMULAS: dict[str, tuple[list[str], dict[str, int], int, Callable[..., Decimal]]] = {
    "percentage_of": (["number", "percent"], {}, 6, lambda n, p: n * p / 100),
    "percentage_increase": (["number", "percent"], {}, 6, lambda n, p: n * (1 + p / 100)),
    "percentage_decrease": (["number", "percent"], {}, 6, lambda n, p: n * (1 - p / 100)),
    "percentage_difference": (["old_value", "new_value"], {}, 6, lambda a, b: (b - a) / abs(_nonzero(a, "DIVISION_BY_ZERO")) * 100),
    "discount": (["price", "percent"], {}, 2, lambda x, p: x * (1 - p / 100)),
    "sales_tax": (["price", "tax_rate_percent"], {}, 2, lambda x, p: x * p / 100),
    "final_price": (["price"], {"discount_percent": 0, "tax_rate_percent": 0}, 2, lambda x, d, t: x * (1 - d / 100) * (1 + t / 100)),
    "tip": (["bill_total", "tip_percent"], {}, 2, lambda x, p: x * p / 100),
    "split_bill": (["bill_total", "num_people"], {"tip_percent": 0}, 2, lambda x, n, p: x * (1 + p / 100) / _positive(n)),
    "simple_interest": (["principal", "annual_rate_percent", "years"], {}, 2, lambda p, r, y: p * r / 100 * y),
    "compound_interest": (["principal", "annual_rate_percent", "years"], {"compounds_per_year": 1}, 2, _growth),
}


def formula(operation: str, values: dict[str, Decimal]) -> Decimal:
    required, optional, places, function = FORMULAS[operation]
    with localcontext(DECIMALS):
        try:
            value = function(*[values[k] for k in required], *[values.get(k, Decimal(d)) for k, d in optional.items()])
            return value.quantize(Decimal(1).scaleb(-places))
        except DecimalException as e:
            raise Refused("RESOURCE_LIMIT") from e


# --- calls -----------------------------------------------------------------------------------------------------------


def _named(arguments: dict, required: list[str], optional: list[str] = []) -> None:  # noqa: B006
    if set(arguments) - {*required, *optional}:
        raise Refused("UNKNOWN_ARGUMENT")
    if set(required) - set(arguments):
        raise Refused("MISSING_ARGUMENT")


def _typed(value: Any) -> str:
    if not isinstance(value, str):
        raise Refused("INVALID_ARGUMENT_TYPE")
    return value


def _evaluate(arguments: dict) -> dict:
    _named(arguments, ["expression"])
    value, exact = computed(_typed(arguments["expression"]))
    return {"value": str(value) if isinstance(value, int) else repr(value), "exact": exact}


def _convert(arguments: dict) -> dict:
    names = ["category", "from_unit", "to_unit"]
    _named(arguments, [*names, "value"])
    kind, source, target = (_typed(arguments[n]) for n in names)
    if kind not in UNITS and kind != "temperature":
        raise Refused("INVALID_ARGUMENT_VALUE")
    return {"value": format(converted(kind, source, target, decimal(arguments["value"])), "f")}


def _finance(arguments: dict) -> dict:
    if "operation" not in arguments:
        raise Refused("MISSING_ARGUMENT")
    operation = _typed(arguments["operation"])
    if operation not in FORMULAS:
        raise Refused("UNSUPPORTED_OPERATION")
    required, optional, *_ = FORMULAS[operation]
    _named(arguments, ["operation", *required], list(optional))
    return {"value": format(formula(operation, {k: decimal(v) for k, v in arguments.items() if k != "operation"}), "f")}


HANDLERS = dict(zip(TOOLS, [_evaluate, _convert, _finance]))


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Refused("DUPLICATE_JSON_KEY")
    return found


def _no_constant(name: str) -> None:
    raise Refused("MALFORMED_CALL", f"{name} is not a number")


def _sized(value: Any, depth: int = 0) -> None:
    if depth > LIMITS["depth"] or isinstance(value, (dict, list)) and len(value) > LIMITS["members"] or isinstance(value, str) and len(value) > LIMITS["string"]:
        raise Refused("RESOURCE_LIMIT")
    for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _sized(inner, depth + 1)


def _object_of(text: str) -> dict:
    try:
        if len(text.encode()) > LIMITS["call_bytes"]:
            raise Refused("RESOURCE_LIMIT")
        found = json.loads(text, object_pairs_hook=_once, parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        raise Refused("MALFORMED_CALL") from e
    if not isinstance(found, dict):
        raise Refused("MALFORMED_CALL")
    _sized(found)
    return found


def parsed(text: str) -> tuple[str, str, dict]:
    """Version, tool and arguments of a call; everything else is refused."""
    call = _object_of(text)
    kinds = {"protocol_version": str, "tool": str, "arguments": dict}
    if set(call) != set(kinds) or not all(isinstance(call[k], kind) for k, kind in kinds.items()):
        raise Refused("MALFORMED_CALL")
    return call["protocol_version"], call["tool"], call["arguments"]


def executed(text: str, available: frozenset[str] = frozenset(TOOLS), handlers: dict[str, Callable[[dict], dict]] | None = None) -> dict:
    """The result of a call's text."""
    handlers = HANDLERS if handlers is None else handlers
    tool = ""
    try:
        version, tool, arguments = parsed(text)
        if version != VERSION:
            raise Refused("UNSUPPORTED_PROTOCOL_VERSION")
        if tool not in handlers:
            raise Refused("UNKNOWN_TOOL")
        if tool not in available:
            raise Refused("TOOL_UNAVAILABLE")
        try:
            result = {"protocol_version": VERSION, "tool": tool, "status": "success", "result": handlers[tool](arguments), "error": None}
        except (ArithmeticError, ValueError) as e:
            raise Refused("INTERNAL_ERROR") from e
        if len(canonical(result).encode()) > LIMITS["result_bytes"]:
            raise Refused("RESOURCE_LIMIT")
        return result
    except Refused as e:
        status = {"UNKNOWN_TOOL": "unsupported", "TOOL_UNAVAILABLE": "unavailable"}.get(e.code, "error")
        return {"protocol_version": VERSION, "tool": tool, "status": status, "result": None, "error": {"code": e.code, "message": str(e)}}


def parsed_result(text: str) -> dict:
    """A result's text as what it says, for round trips only: what a model writes is never taken for a result.

    Refused as a call's text would be, and where the fields aren't exactly those of a result.
    """
    found = _object_of(text)
    if set(found) != {"protocol_version", "tool", "status", "result", "error"}:
        raise Refused("MALFORMED_CALL")
    error = found["error"]
    if not isinstance(found["result"], dict | None) or error is not None and (not isinstance(error, dict) or set(error) != {"code", "message"}):
        raise Refused("MALFORMED_CALL")
    return found


def wired(tag: str, value: dict) -> str:
    """A call or result as a model sees it: its tag and canonical JSON, no closing tag."""
    return f"<{tag}>{canonical(value)}"


class Registry:
    """The tools a session may call: a closed set of names, each with a handler and whether it is available now."""

    def __init__(self, handlers: dict[str, Callable[[dict], dict]] | None = None) -> None:
        self._handlers: dict[str, Callable[[dict], dict]] = {}
        self.available: set[str] = set()
        for name, handler in (HANDLERS if handlers is None else handlers).items():
            self.register(name, handler)

    def register(self, name: str, handler: Callable[[dict], dict], available: bool = True) -> None:
        if not self.known(name):
            raise ValueError(f"{name} is no tool of this protocol")
        self._handlers[name] = handler
        self.set_available(name, available)

    def set_available(self, name: str, available: bool) -> None:
        if name not in self._handlers:
            raise KeyError(name)
        (self.available.add if available else self.available.discard)(name)

    @staticmethod
    def known(name: str) -> bool:
        return name in TOOLS

    def get(self, name: str) -> Callable[[dict], dict] | None:
        return self._handlers.get(name)

    def execute(self, text: str) -> dict:
        return executed(text, frozenset(self.available), self._handlers)


def schemas() -> dict[str, dict]:
    """JSON schemas of calls, results and each tool's arguments."""

    def of(title: str, required: dict[str, dict], optional: dict[str, dict] = {}, **more: Any) -> dict:  # noqa: B006
        return {"title": title, "type": "object", "additionalProperties": False, "required": list(required), "properties": required | optional} | more

    draft = {"$schema": "https://json-schema.org/draft/2020-12/schema"}
    text, number, version = {"type": "string"}, {"type": "number"}, {"type": "string", "const": VERSION}
    operators = sorted({s.removeprefix("u") for s in SYMBOLS.values()})
    told = f"Operators {' '.join(operators)}; functions {', '.join(FUNCTION_NAMES)}, angles in radians; constants {', '.join(CONSTANTS)}."
    error = of("error", {"code": {"type": "string", "enum": CODES}, "message": text}) | {"type": ["object", "null"]}
    formulas = [
        of(name, {"operation": {"const": name}} | {k: number for k in required}, {k: number for k in optional})
        for name, (required, optional, *_) in sorted(FORMULAS.items())
    ]
    kinds = {"type": "string", "enum": sorted([*UNITS, "temperature"])}
    return {
        "call": of("tool call", {"protocol_version": version, "tool": {"type": "string", "enum": TOOLS}, "arguments": {"type": "object"}}, **draft),
        "result": of(
            "tool result",
            {"protocol_version": version, "tool": text, "status": {"type": "string", "enum": STATUSES}, "result": {"type": ["object", "null"]}, "error": error},
            **draft,
        ),
        "evaluate_arguments": of("expression", {"expression": text | {"maxLength": EXPRESSION_LIMITS["expression"], "description": told}}, **draft),
        "convert_arguments": of("conversion", {"category": kinds, "from_unit": text, "to_unit": text, "value": number}, **draft),
        "finance_arguments": {"title": "formula", "oneOf": formulas} | draft,
    }


RESULT = T.StructType([T.StructField(n, T.BooleanType() if n == "exact" else T.StringType()) for n in ("protocol_version", "tool", "status", "value", "exact", "code")])


@F.pandas_udf(RESULT)
def _run(calls: pd.Series) -> pd.DataFrame:
    def of(text: str | None) -> tuple:
        if text is None:
            return (None,) * 6
        r = executed(text)
        return (r["protocol_version"], r["tool"], r["status"], (r["result"] or {}).get("value"), (r["result"] or {}).get("exact"), (r["error"] or {}).get("code"))

    return pd.DataFrame([of(c) for c in calls], columns=["protocol_version", "tool", "status", "value", "exact", "code"]).astype(object)


def run_call(call: Column) -> Column:
    """Result of a tool call's text as a struct (``RESULT``); all fields null for a null."""
    return _run(call)


@F.pandas_udf(T.StringType())
def _result(calls: pd.Series) -> pd.Series:
    return calls.map(lambda text: None if text is None else canonical(executed(text)))


def result_json(call: Column) -> Column:
    """The whole result of a tool call's text as canonical JSON; null for a null."""
    return _result(call)


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    def of(text: str | None) -> str | None:
        try:
            return None if text is None else canonical(json.loads(text))
        except ValueError:
            return None

    return texts.map(of)


def canonical_json(c: Column) -> Column:
    """JSON with sorted keys and no spaces, digits as Python writes them; null for null or broken JSON."""
    return _canonical(c)


@F.pandas_udf(T.StringType())
def _refusal(texts: pd.Series) -> pd.Series:
    def of(text: str | None) -> str | None:
        try:
            return None if text is None else "" if parsed(text) else ""
        except Refused as e:
            return e.code

    return texts.map(of)


def call_refusal(c: Column) -> Column:
    """Why a text is no well-formed call, without running it: a code, or an empty string if it is one; null for null."""
    return _refusal(c)
