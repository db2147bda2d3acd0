"""The band-math formula language, compiled to one SQL expression.

``B{nm}`` is the band nearest to a wavelength, ``B[n]`` the n-th band (from 1, clamped); ``PI`` and ``E``; ``+ - * / % ^`` with the usual
precedence, ``^`` from the right and above a sign; functions of one and two arguments, in any case; comparisons ``= <> < <= > >=``, ``NOT``, ``AND`` and ``OR`` (in this order of
binding, below arithmetic) and ``IIF(condition, then, else)``. Numbers and conditions are told apart while compiling; a formula that is a condition gives 1 or 0.

Bands are resolved while compiling; an invalid cell counts as 0. Arithmetic, functions and comparisons follow IEEE (NaN and infinities instead of errors; NaN equals nothing), ``%`` has the sign of its
first operand, and the result's NaN and infinities become 0. An expression stays within code generation and can be used as a column or, by ``register``, as a function in SQL.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(B\{[^}]*\}|B\[[^\]]*\])|(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(<=|>=|<>|!=|==|.))")

#: Named expressions.
PRESETS = {
    "ndvi": "(B{800} - B{680}) / (B{800} + B{680})",
    "evi": "2.5 * (B{800} - B{680}) / (B{800} + 6*B{680} - 7.5*B{450} + 1)",
    "ratio": "B{680} / B{550}",
    "first_derivative": "(B[10] - B[8]) / 2",
    "second_derivative": "B[11] - 2*B[10] + B[9]",
    "sum": "B[1] + B[2]",
    "geometric_mean": "sqrt(B[1] * B[2])",
    "log": "log(B[1] + 1)",
    "square": "pow(B[1], 2)",
    "root": "sqrt(B[1])",
}


class FormulaError(ValueError):
    pass


NUMBER, CONDITION = "number", "condition"
_NAN, _INF = "double('NaN')", "double('Infinity')"
#: Longer operands are bound to a name where they are mentioned more than once, so that an expression grows in proportion to its formula.
_SHORT = 3000
_names = itertools.count()


def _bound(x: str, use: Callable[[str], str]) -> str:
    """``use(x)``, with a long ``x`` worked out once."""
    if len(x) <= _SHORT:
        return use(x)
    name = f"v{next(_names)}"
    return f"element_at(transform(array({x}), {name} -> {use(name)}), 1)"


def _divide(a: str, b: str) -> str:
    """IEEE division; by zero it is an infinity, or NaN for zero."""
    return _bound(a, lambda x: f"coalesce(try_divide({x}, {b}), {x} * {_INF})")


def _log(x: str, value: Callable[[str], str]) -> str:
    return _bound(x, lambda x: f"coalesce({value(x)}, CASE WHEN {x} = 0D THEN -{_INF} ELSE {_NAN} END)")


def _whole(f: str) -> Callable[[str], str]:
    return lambda x: _bound(x, lambda x: f"CASE WHEN abs({x}) < 1e15D THEN double({f}({x})) ELSE {x} END")


def _finite(x: str, otherwise: str) -> str:
    """``x``, or ``otherwise`` where it is null, NaN or an infinity (whose difference from itself is NaN)."""
    return _bound(x, lambda x: f"coalesce(nanvl({x} + ({x} - {x}), {otherwise}), {otherwise})")


_ONE: dict[str, Callable[[str], str]] = {
    "sqrt": "sqrt({})".format,
    "log": lambda x: _log(x, "ln({})".format),
    "log2": lambda x: _log(x, lambda x: f"ln({x}) / {math.log(2.0)!r}D"),
    "log10": lambda x: _log(x, "log10({})".format),
    **{f: (f + "({})").format for f in ("exp", "abs", "sin", "cos", "tan", "asin", "acos", "atan")},
    "round": "rint({})".format, "floor": _whole("floor"), "ceil": _whole("ceil"),
}
_TWO: dict[str, Callable[[str, str], str]] = {
    "min": lambda a, b: _bound(a, lambda a: _bound(b, lambda b: f"CASE WHEN isnan({a}) OR isnan({b}) THEN {_NAN} ELSE least({a}, {b}) END")),
    "max": "greatest({}, {})".format,  # NaN is the greatest
    "pow": "pow({}, {})".format,
    "atan2": "atan2({}, {})".format,
}


def _compared(op: str, a: str, b: str) -> str:
    """A comparison that is false for NaN (true for ``<>``), which Spark sorts above all numbers."""
    if op in ("<", "<="):
        return _bound(b, lambda b: f"({a} {op} {b} AND NOT isnan({b}))")
    plain = _bound(a, lambda a: f"({a} {'=' if op in ('<>', '!=', '==') else op} {b} AND NOT isnan({a}))")
    return f"(NOT {plain})" if op in ("<>", "!=") else plain


class _Parser:
    """Recursive descent; each part is its SQL text and its type."""

    def __init__(self, text: str, wavelengths: list[float], excluded: list[tuple[float, float]], spectrum: str):
        self.tokens = [m.groups() for m in _TOKEN.finditer(text) if m.group(0).strip()]
        self.at, self.wavelengths, self.excluded, self.spectrum = 0, wavelengths, excluded, spectrum

    def peek(self) -> str | None:
        return next(t for t in self.tokens[self.at] if t is not None) if self.at < len(self.tokens) else None

    def word(self) -> str | None:
        """The next token in upper case, if it is a name."""
        return self.tokens[self.at][2].upper() if self.at < len(self.tokens) and self.tokens[self.at][2] else None

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if token is None or wanted is not None and token != wanted:
            raise FormulaError(f"expected {wanted or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def of(self, part: tuple[str, str], kind: str, what: str) -> str:
        if part[1] != kind:
            raise FormulaError(f"{what} takes a {kind}, not a {part[1]}")
        return part[0]

    def any(self) -> tuple[str, str]:
        return self.joined("OR", lambda: self.joined("AND", self.negated))

    def joined(self, word: str, part: Callable) -> tuple[str, str]:
        out = part()
        while self.word() == word:
            self.take()
            out = f"({self.of(out, CONDITION, word)} {word} {self.of(part(), CONDITION, word)})", CONDITION
        return out

    def negated(self) -> tuple[str, str]:
        if self.word() == "NOT":
            self.take()
            return f"(NOT {self.of(self.negated(), CONDITION, 'NOT')})", CONDITION
        out = self.sum()
        if self.peek() in ("=", "==", "<>", "!=", "<", "<=", ">", ">="):
            op = self.take()
            return _compared(op, self.of(out, NUMBER, op), self.of(self.sum(), NUMBER, op)), CONDITION
        return out

    def sum(self) -> tuple[str, str]:
        out = self.product()
        while self.peek() in ("+", "-"):
            op = self.take()
            out = f"({self.of(out, NUMBER, op)} {op} {self.of(self.product(), NUMBER, op)})", NUMBER
        return out

    def product(self) -> tuple[str, str]:
        out = self.signed()
        while self.peek() in ("*", "/", "%"):
            op = self.take()
            a, b = self.of(out, NUMBER, op), self.of(self.signed(), NUMBER, op)
            out = f"({a} * {b})" if op == "*" else _divide(a, b) if op == "/" else f"coalesce(try_mod({a}, {b}), {_NAN})", NUMBER
        return out

    def signed(self) -> tuple[str, str]:
        if self.peek() in ("+", "-"):
            op = self.take()
            x = self.of(self.signed(), NUMBER, op)
            return f"(- {x})" if op == "-" else x, NUMBER
        base = self.atom()
        if self.peek() == "^":
            self.take()
            return f"pow({self.of(base, NUMBER, '^')}, {self.of(self.signed(), NUMBER, '^')})", NUMBER
        return base

    def atom(self) -> tuple[str, str]:
        if self.peek() is None:
            raise FormulaError("the formula ends too early")
        band, number, name, _ = self.tokens[self.at]
        if band:
            return self.band(self.take()), NUMBER
        if number:
            return f"{float(self.take())!r}D", NUMBER
        if name:
            self.take()
            if name in ("PI", "E"):
                return f"{math.pi if name == 'PI' else math.e!r}D", NUMBER
            return self.call(name.lower())
        self.take("(")
        out = self.any()
        self.take(")")
        return out

    def arguments(self, n: int) -> list[tuple[str, str]]:
        self.take("(")
        out = [self.any()]
        for _ in range(n - 1):
            self.take(",")
            out.append(self.any())
        self.take(")")
        return out

    def call(self, name: str) -> tuple[str, str]:
        if name == "iif":
            condition, yes, no = self.arguments(3)
            if yes[1] != no[1]:
                raise FormulaError("both results of IIF are of one type")
            return f"CASE WHEN {self.of(condition, CONDITION, 'IIF')} THEN {yes[0]} ELSE {no[0]} END", yes[1]
        if name in _ONE:
            return _ONE[name](*(self.of(x, NUMBER, name) for x in self.arguments(1))), NUMBER
        if name in _TWO:
            return _TWO[name](*(self.of(x, NUMBER, name) for x in self.arguments(2))), NUMBER
        raise FormulaError(f"unknown name {name}")

    def band(self, token: str) -> str:
        try:
            value = float(token[2:-1])
        except ValueError:
            raise FormulaError(f"not a band: {token}") from None
        n = len(self.wavelengths)
        k = min(range(n), key=lambda i: (abs(self.wavelengths[i] - value), i)) if token[1] == "{" else min(max(int(value) - 1, 0), n - 1)
        if any(a <= self.wavelengths[k] <= b for a, b in self.excluded):
            return "0D"
        return _finite(f"double(`{self.spectrum}`[{k}])", "0D")


def formula_sql(text: str, wavelengths: list[float], excluded: list[tuple[float, float]] | None = None, spectrum: str = "spectrum", strict: bool = False) -> str:
    """A formula over an array column ``spectrum`` as SQL text; FormulaError says what is wrong with it.

    A result that is no finite number is 0, or with ``strict`` an error that ends the job.
    """
    parser = _Parser(text, wavelengths, excluded or [], spectrum)
    out, kind = parser.any()
    if parser.peek() is not None:
        raise FormulaError(f"unexpected {parser.peek()}")
    if kind == CONDITION:
        return f"CASE WHEN {out} THEN 1D ELSE 0D END"
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    return _finite(out, f"double(raise_error('no finite result: {quoted}'))" if strict else "0D")


def compile_formula(text: str, wavelengths: list[float], excluded: list[tuple[float, float]] | None = None, spectrum: str = "spectrum", strict: bool = False) -> Column:
    """``formula_sql`` as a column."""
    return F.expr(formula_sql(text, wavelengths, excluded, spectrum, strict))


def register(spark: SparkSession, name: str, text: str, wavelengths: list[float], excluded: list[tuple[float, float]] | None = None) -> None:
    """Makes a formula a function of a spectrum in the session's SQL; it is inlined like any other expression."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise FormulaError(f"not a name: {name}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(spectrum ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {formula_sql(text, wavelengths, excluded)}")


def preview(pixels: DataFrame, text: str, wavelengths: list[float], lines: int, samples: int, mask: DataFrame | None = None) -> DataFrame:
    """``sample, line, value`` of a formula at one pixel: the first one (by line, then sample) of the first region, or else the image's centre."""
    value = compile_formula(text, wavelengths).alias("value")
    if mask is None:
        return pixels.where((F.col("line") == lines // 2) & (F.col("sample") == samples // 2)).select("sample", "line", value)
    first = mask.agg(F.min(F.struct("roi_id", "line", "sample")).alias("at")).select("at.line", "at.sample")  # one row
    return pixels.join(F.broadcast(first), ["line", "sample"]).select("sample", "line", value)
