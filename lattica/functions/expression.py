"""Elementwise expressions over the arrays of one location, compiled to columns.

Numbers, names (back-quoted where they hold other signs), ``+ - * /``, unary
signs, parentheses, and abs, sqrt, min, max and norm. A k-component array meets
another of as many components or a scalar; the result is double.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import divided, greatest_nan, least_nan

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|`([^`]+)`|([A-Za-z_][\w.:]*)|(.))")
FUNCTIONS = {"abs": 1, "sqrt": 1, "min": 2, "max": 2, "norm": 1}
MAX_DEPTH, MAX_COMPONENTS = 64, 16

Value = list[Column]


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        kinds = ("number", "quoted", "name", "sign")
        kind, value = next((k, v) for k, v in zip(kinds, m.groups(), strict=True) if v is not None)
        if kind == "sign" and value not in "+-*/(),":
            raise ValueError(f"unexpected {value!r} at {m.start(4)} of {text!r}")
        out.append(("name" if kind == "quoted" else kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, arrays: dict[str, Value]):
        self.left, self.arrays, self.depth = tokens(text), arrays, 0

    def next(self, sign: str | None = None) -> tuple[str, str]:
        if not self.left:
            raise ValueError("the expression ends too early")
        token = self.left.pop(0)
        if sign and token != ("sign", sign):
            raise ValueError(f"{sign!r} expected, not {token[1]!r}")
        return token

    def sees(self, signs: str) -> bool:
        return bool(self.left) and self.left[0][0] == "sign" and self.left[0][1] in signs

    def whole(self) -> Value:
        out = self.total()
        if self.left:
            raise ValueError(f"unexpected {self.left[0][1]!r}")
        return out

    def total(self) -> Value:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ValueError(f"nested deeper than {MAX_DEPTH}")
        out = self.product()
        while self.sees("+-"):
            out = both(self.next()[1], out, self.product())
        self.depth -= 1
        return out

    def product(self) -> Value:
        out = self.factor()
        while self.sees("*/"):
            out = both(self.next()[1], out, self.factor())
        return out

    def factor(self) -> Value:
        if self.sees("+-"):
            minus = self.next()[1] == "-"
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise ValueError(f"nested deeper than {MAX_DEPTH}")
            out = self.factor()
            self.depth -= 1
            return [-c for c in out] if minus else out
        kind, value = self.next()
        if kind == "number":
            return [F.lit(float(value))]
        if (kind, value) == ("sign", "("):
            out = self.total()
            self.next(")")
            return out
        if kind == "name" and self.sees("(") and value in FUNCTIONS:
            self.next("(")
            args = [self.total()]
            while self.sees(","):
                self.next()
                args.append(self.total())
            self.next(")")
            if len(args) != FUNCTIONS[value]:
                raise ValueError(f"{value} takes {FUNCTIONS[value]}, not {len(args)}")
            return called(value, args)
        if kind == "name":
            if value not in self.arrays:
                raise KeyError(f"no array {value!r}; there are {', '.join(sorted(self.arrays))}")
            return self.arrays[value]
        raise ValueError(f"unexpected {value!r}")


def _matched(a: Value, b: Value) -> list[tuple[Column, Column]]:
    if len(a) != len(b) and 1 not in (len(a), len(b)):
        raise ValueError(f"{len(a)} and {len(b)} components")
    n = max(len(a), len(b))
    return list(zip(a * (n if len(a) == 1 else 1), b * (n if len(b) == 1 else 1), strict=True))


def both(sign: str, a: Value, b: Value) -> Value:
    op = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": divided}[sign]
    return [op(x, y) for x, y in _matched(a, b)]


def called(name: str, args: list[Value]) -> Value:
    if name == "abs":
        return [F.abs(c) for c in args[0]]
    if name == "sqrt":
        return [F.when(c < 0, F.lit(float("nan"))).otherwise(F.sqrt(F.greatest(c, F.lit(0.0)))) for c in args[0]]
    if name == "norm":
        total = F.lit(0.0)
        for c in args[0]:
            total = total + c * c
        return [F.sqrt(total)]
    op = least_nan if name == "min" else greatest_nan
    return [op(x, y) for x, y in _matched(*args)]


def compiled(text: str, df: DataFrame, components: dict[str, int] | None = None) -> Column:
    """The expression over the numeric columns of ``df``; arrays need their number of ``components``."""
    arrays: dict[str, Value] = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            n = (components or {}).get(name)
            if n and n <= MAX_COMPONENTS:
                arrays[name] = [c.getItem(i).cast("double") for i in range(n)]
        elif kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
            arrays[name] = [c.cast("double")]
    out = _Parser(text, arrays).whole()
    return out[0] if len(out) == 1 else F.array(*out)
