"""Exact arithmetic: expression trees over rationals, and answers checked against them."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from math import prod
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Undefined(ValueError):
    """The expression has no value."""


def rational(value: Any) -> Fraction:
    """A JSON number or a string such as ``5/6`` as a rational; floats by their decimal digits, booleans refused."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise Undefined(f"not a number: {value!r}")
    try:
        return Fraction(str(value) if isinstance(value, float) else value)
    except (ValueError, ZeroDivisionError) as e:
        raise Undefined(f"not a number: {value!r}") from e


def _whole(value: Fraction, least: int | None = None) -> int:
    if value.denominator != 1 or least is not None and value < least:
        raise Undefined(f"not a whole number in range: {value}")
    return int(value)


def _quotient(a: Fraction, b: Fraction) -> Fraction:
    if not b:
        raise Undefined("division by zero")
    return a / b


def _power(a: Fraction, b: Fraction) -> Fraction:
    if not a and b < 0:
        raise Undefined("zero to a negative power")
    return a ** _whole(b)


def _half_up(value: Decimal, places: Fraction) -> Fraction:
    return Fraction(value.quantize(Decimal(1).scaleb(-_whole(places, 0)), rounding=ROUND_HALF_UP))


def _root(value: Fraction, places: Fraction) -> Fraction:
    if value < 0:
        raise Undefined("root of a negative number")
    return _half_up((Decimal(value.numerator) / Decimal(value.denominator)).sqrt(), places)


def _places(value: Fraction) -> Decimal:
    return Decimal(value.numerator) / Decimal(value.denominator)


class Operations:
    """The operations on rationals, each by its name; the parameters say how many operands one takes."""

    def add(*x): return sum(x, Fraction(0))
    def sub(a, b): return a - b
    def mul(*x): return prod(x, start=Fraction(1))
    def div(a, b): return _quotient(a, b)
    def ratio(a, b): return _quotient(a, b)
    def percent_of(percent, whole): return percent * whole / 100
    def pow(a, b): return _power(a, b)
    def neg(a): return -a
    def abs(a): return abs(a)
    def max(*x): return max(x)
    def min(*x): return min(x)
    def round(a, places): return _half_up(_places(a), places)
    def sqrt(a, places): return _root(a, places)
    def lt(a, b): return a < b
    def le(a, b): return a <= b
    def gt(a, b): return a > b
    def ge(a, b): return a >= b
    def equals(a, b): return a == b
    # fmt: skip


# The operations that recorded suites are checked with.
FROZEN = ["add", "sub", "mul", "div", "neg", "pow", "percent_of", "equals"]
FULL = [name for name in vars(Operations) if not name.startswith("_")]


def _operands(name: str) -> int | None:
    """How many operands an operation takes; None for any number."""
    code = vars(Operations)[name].__code__
    return None if code.co_flags & 0x04 else code.co_argcount


def postfix(tree: Any, allowed: list[str] = FULL) -> list[Fraction | tuple[str, int]]:
    """An expression tree as a list of numbers and of operations with their number of operands, operands first.

    A tree is a number, or ``{"op": name, "args": [trees]}`` with nothing else in it.
    """
    out: list[Fraction | tuple[str, int]] = []
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        if not isinstance(node, dict):
            out.append(rational(node))
            continue
        name, args = node.get("op"), node.get("args")
        if len(node) != 2 or not isinstance(name, str) or name not in allowed or not isinstance(args, list):
            raise Undefined("not an operation with operands")
        if len(args) != (_operands(name) or max(1, len(args))):
            raise Undefined(f"{name} of {len(args)} operands")
        out.append((name, len(args)))
        waiting += args
    return out[::-1]


def evaluate(tree: Any, allowed: list[str] = FULL) -> Fraction | bool:
    """Value of an expression tree, folded over its postfix form; a truth value is no operand."""
    stack: list[Fraction | bool] = []
    for step in postfix(tree, allowed):
        if isinstance(step, Fraction):
            stack.append(step)
            continue
        name, count = step
        operands = stack[-count:]
        del stack[-count:]
        if bool in map(type, operands):
            raise Undefined("a truth value is no operand")
        try:
            stack.append(vars(Operations)[name](*operands))
        except ArithmeticError as e:
            raise Undefined(str(e)) from e
    (value,) = stack
    return value


def agrees(expression: Any, answer: Any, tolerance: Any, allowed: list[str] = FULL) -> bool:
    """Whether the expression's value is the answer, within an absolute tolerance (null: 0); truth values only match themselves."""
    value = evaluate(expression, allowed)
    if isinstance(value, bool) or isinstance(answer, bool):
        return isinstance(value, bool) and isinstance(answer, bool) and value == answer
    allowed = Fraction(0) if tolerance is None else rational(tolerance)
    if allowed < 0:
        raise Undefined("negative tolerance")
    return abs(value - rational(answer)) <= allowed


def shortest(value: Fraction) -> str:
    """A rational as a finite decimal without trailing zeros if it is one, else as ``n/d``."""
    rest, twos, fives = value.denominator, 0, 0
    while rest % 2 == 0:
        rest, twos = rest // 2, twos + 1
    while rest % 5 == 0:
        rest, fives = rest // 5, fives + 1
    if rest != 1:
        return f"{value.numerator}/{value.denominator}"
    places = max(twos, fives)
    digits = str(abs(value.numerator) * 10**places // value.denominator).rjust(places + 1, "0")
    return "-" * (value < 0) + (f"{digits[:-places]}.{digits[-places:]}" if places else digits)


@F.pandas_udf(T.StringType())
def _value(trees: pd.Series) -> pd.Series:
    def of(tree: str | None) -> str | None:
        try:
            value = evaluate(json.loads(tree))
            return str(value).lower() if isinstance(value, bool) else shortest(value)
        except (ValueError, TypeError, RecursionError):
            return None

    return trees.map(of)


def expression_value(tree: Column) -> Column:
    """The value of a JSON expression tree as text; null where it has none or the JSON is null or broken."""
    return _value(tree)


def _verdict(allowed: list[str]):
    @F.pandas_udf(T.StringType())
    def verdict(trees: pd.Series, answers: pd.Series, tolerances: pd.Series) -> pd.Series:
        def of(tree: str | None, answer: str | None, tolerance: float | None) -> str:
            if tree is None or answer is None:
                return "error"
            try:
                return "ok" if agrees(json.loads(tree), json.loads(answer), None if pd.isna(tolerance) else tolerance, allowed) else "mismatch"
            except (ValueError, TypeError, RecursionError):
                return "error"

        return pd.Series([of(*row) for row in zip(trees, answers, tolerances)])

    return verdict


def verified(tree: Column, answer_json: Column, tolerance: Column, frozen: bool = False) -> Column:
    """``ok``, ``mismatch``, or ``error`` where expression or answer are null, broken or without a value."""
    return _verdict(FROZEN if frozen else FULL)(tree, answer_json, tolerance)


@F.pandas_udf(T.BooleanType())
def _same_number(texts: pd.Series, answers: pd.Series, tolerances: pd.Series) -> pd.Series:
    def of(text: str | None, answer: str | None, tolerance: float | None) -> bool | None:
        if text is None or answer is None:
            return None
        try:
            return abs(rational(text.strip()) - rational(json.loads(answer))) <= (0 if pd.isna(tolerance) else rational(tolerance))
        except (ValueError, TypeError):
            return False

    return pd.Series([of(*row) for row in zip(texts, answers, tolerances)], dtype=object)


def number_matches(text: Column, answer_json: Column, tolerance: Column) -> Column:
    """Whether the whole text is the answer's number within the tolerance; false if it is no number, null for nulls."""
    return _same_number(text, answer_json, tolerance)
