"""Arithmetic expressions of the calculator: checked and turned into a postfix program first, computed on a stack then.

A value is exact if and only if it is an integer: integers stay integers under + - * // % and powers that aren't
negative, and factorials; whatever else is computed is a float.
"""

from __future__ import annotations

import ast
import math
import operator

# Limits, names and operators of the language.
LIMITS = {"expression": 512, "nodes": 200, "node_depth": 40, "digits": 40, "exponent": 10000, "power_bits": 4096, "factorial": 5000, "result_bytes": 8192}
CONSTANTS = {"pi": math.pi, "e": math.e}
FUNCTION_NAMES = ["factorial", "abs", "reciprocal", "sqrt", "cbrt", "log", "ln", "sin", "cos", "tan"]
SYMBOLS = {"Add": "+", "Sub": "-", "Mult": "*", "Div": "/", "Mod": "%", "FloorDiv": "//", "Pow": "**", "UAdd": "u+", "USub": "u-"}


class Refused(Exception):
    """A call or expression that has no success result; ``code`` says why."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code.lower().replace("_", " "))
        self.code = code


class _Compiler(ast.NodeVisitor):
    """Postfix program of a syntax tree: numbers, or names of operators and functions.

    Size and depth are those of the whole tree, in which an operator and a constant's context are nodes too.
    """

    def __init__(self) -> None:
        self.program: list[int | float | str] = []
        self.size, self.depth = 1, 0

    def visit(self, node: ast.AST) -> None:
        leaf = isinstance(node, ast.Name)
        self.size += 1 + (leaf or isinstance(node, (ast.BinOp, ast.UnaryOp)))
        self.depth += 1
        if self.size > LIMITS["nodes"] or self.depth + leaf > LIMITS["node_depth"]:
            raise Refused("RESOURCE_LIMIT")
        super().visit(node)
        self.depth -= 1

    def generic_visit(self, node: ast.AST) -> None:
        raise Refused("INVALID_ARGUMENT_VALUE")

    def visit_Constant(self, node: ast.Constant) -> None:
        if type(node.value) not in (int, float):
            self.generic_visit(node)
        if isinstance(node.value, int) and node.value >= 10 ** LIMITS["digits"]:  # floats never print as many digits
            raise Refused("RESOURCE_LIMIT")
        self.program.append(node.value)

    def visit_Name(self, node: ast.Name) -> None:
        if node.id not in CONSTANTS:
            self.generic_visit(node)
        self.program.append(CONSTANTS[node.id])

    def _operands(self, op: ast.AST, *operands: ast.AST) -> None:
        symbol = SYMBOLS.get(type(op).__name__)
        if symbol is None:
            self.generic_visit(op)
        for operand in operands:
            self.visit(operand)
        self.program.append(symbol)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> None:
        self._operands(node.op, node.operand)

    def visit_BinOp(self, node: ast.BinOp) -> None:
        self._operands(node.op, node.left, node.right)

    def visit_Call(self, node: ast.Call) -> None:
        name = getattr(node.func, "id", None)
        if name not in FUNCTION_NAMES or node.keywords or len(node.args) != 1:
            self.generic_visit(node)
        self.visit(node.args[0])
        self.program.append(name)


def compiled(expression: str) -> list[int | float | str]:
    """The postfix program of an expression's text; refused if it is too long, too large or anything but arithmetic."""
    if len(expression) > LIMITS["expression"]:
        raise Refused("RESOURCE_LIMIT")
    try:
        tree = ast.parse(expression, mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise Refused("INVALID_ARGUMENT_VALUE") from e
    compiler = _Compiler()
    compiler.visit(tree.body)
    return compiler.program


def _by(divide):
    def of(a, b):
        if not b:
            raise Refused("DIVISION_BY_ZERO")
        return divide(a, b)

    return of


def _exceeds(base: int | float, exponent: int) -> bool:
    """Whether ``abs(base) ** exponent`` has more bits than allowed, for a base beyond 1 and a positive exponent.

    Integers are settled by their bit lengths: n bits to the k-th have more than (n - 1) k and at most n k.
    """
    most = LIMITS["power_bits"]
    if isinstance(base, float):
        return math.log2(abs(base)) > most / exponent
    bits = abs(base).bit_length()
    if bits * exponent <= most:
        return False
    return (bits - 1) * exponent > most or abs(base) ** exponent > 1 << most


def _power(base: int | float, exponent: int | float) -> int | float:
    whole = exponent == int(exponent) if math.isfinite(exponent) else False
    if whole:
        exponent = int(exponent) if isinstance(base, int) and exponent < 0 else exponent
        if abs(base) > 1 and (abs(exponent) > LIMITS["exponent"] or exponent > 0 and _exceeds(base, int(exponent))):
            raise Refused("RESOURCE_LIMIT")
        if not base and exponent < 0:
            raise Refused("DIVISION_BY_ZERO")
    elif base < 0:
        raise Refused("DOMAIN_ERROR")
    try:
        return operator.pow(base, exponent)
    except OverflowError as e:
        raise Refused("OVERFLOW") from e


def _within(domain, function):
    """A function of real numbers on a domain; what is too large for it overflows."""

    def of(x):
        if not domain(x):
            raise Refused("DOMAIN_ERROR")
        try:
            return function(x)
        except (OverflowError, ValueError) as e:
            raise Refused("OVERFLOW") from e

    return of


def _product_to(n: int | float) -> int:
    if isinstance(n, float) or n < 0:
        raise Refused("DOMAIN_ERROR")
    if n > LIMITS["factorial"]:
        raise Refused("RESOURCE_LIMIT")
    return math.factorial(n)


_REALS = lambda x: True
_POSITIVE = lambda x: x > 0
ONE = {
    "u+": operator.pos,
    "u-": operator.neg,
    "abs": abs,
    "factorial": _product_to,
    "reciprocal": lambda x: _by(operator.truediv)(1.0, x),
    "sqrt": _within(lambda x: x >= 0, math.sqrt),
    "cbrt": _within(_REALS, lambda x: math.copysign(math.pow(abs(x), 1 / 3), x)),
    "log": _within(_POSITIVE, math.log10),
    "ln": _within(_POSITIVE, math.log),
    **{name: _within(_REALS, getattr(math, name)) for name in ("sin", "cos", "tan")},
}
TWO = {"+": operator.add, "-": operator.sub, "*": operator.mul, "**": _power}
TWO |= {symbol: _by(divide) for symbol, divide in (("/", operator.truediv), ("//", operator.floordiv), ("%", operator.mod))}


def computed(expression: str) -> tuple[int | float, bool]:
    """Value of an arithmetic expression of literals, ``pi``, ``e``, + - * / // % ** and the one-argument functions, and whether it is exact."""
    stack: list[int | float] = []
    for step in compiled(expression):
        if not isinstance(step, str):
            stack.append(step)
        elif step in ONE:
            stack.append(ONE[step](stack.pop()))
        else:
            right = stack.pop()
            stack.append(TWO[step](stack.pop(), right))
    (value,) = stack
    if isinstance(value, float):
        if not math.isfinite(value):
            raise Refused("NON_FINITE_RESULT")
        return value, False
    if abs(value) >> 4 * LIMITS["result_bytes"]:  # its digits can't fit into a result
        raise Refused("RESOURCE_LIMIT")
    return value, True
