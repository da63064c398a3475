"""Map-algebra formulas, read once and compiled to Spark Columns.

A formula is turned into nested tuples by a short recursive reader and then into
one Column expression, so that Catalyst plans and compiles it. Nodata is SQL
NULL; the compiler also carries whether a value is boolean, whether it can hold
nodata at all (masked) and the number that stands for nodata where it is filled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from gridloom.errors import RasterAlgebraException

TOKEN = re.compile(r"(?P<number>\d+(?:\.\d*)?(?:[Ee][+-]?\d+)?)|(?P<name>[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*)|(?P<op>==|!=|>=|<=|[-+*/^<>|&!~()])")
NAME = re.compile(r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*")
CONSTANTS = {"E": math.e, "PI": math.pi, "INF": math.inf}
LEVEL = ("*", "/", "==", "!=", ">=", "<=", ">", "<", "&", "|")
REDUCERS = ("min", "max", "mean", "median", "std", "sum")


def tokens(formula: str) -> list[str]:
    """Tokens of a formula; white space means nothing, even inside names."""
    text = re.sub(r"\s+", "", formula or "")
    if not text:
        raise RasterAlgebraException("There is no formula.")
    found, at = [], 0
    while at < len(text):
        match = TOKEN.match(text, at)
        if match is None:
            raise RasterAlgebraException(f"Cannot read formula at {text[at:]!r}.")
        # A name may begin with digits; the longer reading wins.
        name = NAME.match(text, at)
        end = match.end()
        if match["number"] and name and name.end() > end and not re.fullmatch(r"\d+[Ee]\d+", name[0]):
            end = name.end()
        found.append(text[at:end])
        at = end
    return found


def parse(formula: str) -> tuple:
    """Nested tuples of a formula.

    One level holds ``* / == != >= <= > < & |``, left to right, and binds
    tighter than ``+ -``; ``^`` groups from the right and unary signs bind
    tighter still.
    """
    rest = tokens(formula)[::-1]

    def take(*wanted: str) -> str | None:
        return rest.pop() if rest and rest[-1] in wanted else None

    def expect(what: str) -> None:
        if not take(what):
            raise RasterAlgebraException(f"Expected {what!r} in formula.")

    def sum_() -> tuple:
        left = term()
        while op := take("+", "-"):
            left = ("binary", op, left, term())
        return left

    def term() -> tuple:
        left = factor()
        while op := take(*LEVEL):
            left = ("binary", op, left, factor())
        return left

    def factor() -> tuple:
        left = unary()
        return ("binary", "^", left, factor()) if take("^") else left

    def unary() -> tuple:
        if op := take("+", "-", "!", "~"):
            return ("unary", op, unary())
        return atom()

    def atom() -> tuple:
        if take("("):
            inner = sum_()
            expect(")")
            return inner
        if not rest:
            raise RasterAlgebraException("Formula ends too early.")
        token = rest.pop()
        if re.fullmatch(r"\d+(\.\d*)?([Ee][+-]?\d+)?", token):
            return ("number", float(token))
        if not NAME.fullmatch(token):
            raise RasterAlgebraException(f"Unexpected {token!r} in formula.")
        if take("("):
            inner = sum_()
            expect(")")
            return ("call", token, inner)
        return ("name", token)

    tree = sum_()
    if rest:
        raise RasterAlgebraException(f"Unexpected {rest[-1]!r} in formula.")
    return tree


def names_in(tree: tuple) -> set[str]:
    """Variables of a parsed formula."""
    if tree[0] == "name":
        return set() if tree[1] in (*CONSTANTS, "TRUE", "FALSE", "NULL") else {tree[1]}
    return set().union(*(names_in(part) for part in tree if isinstance(part, tuple)), set())


@dataclass(frozen=True)
class Value:
    """A compiled expression: kind is double, long or bool; fill stands for nodata where filled."""

    column: Column
    kind: str = "double"
    masked: bool = False
    fill: float | None = None

    @property
    def number(self) -> Column:
        return self.column.cast("double") if self.kind != "double" else self.column

    @property
    def truth(self) -> Column:
        return self.column if self.kind == "bool" else self.column != 0


def strictly(a: Value, b: Value, column: Column) -> Column:
    """Nodata on either side gives nodata, whatever SQL logic would say."""
    return F.when(a.column.isNull() | b.column.isNull(), F.lit(None)).otherwise(column) if a.masked or b.masked else column


def _divide(a: Value, b: Value) -> Column:
    if a.masked or b.masked:
        return F.when(b.number != 0, a.number / b.number)
    at_zero = F.when((a.number == 0) | F.isnan(a.number), math.nan).when(a.number > 0, math.inf).otherwise(-math.inf)
    return F.when(b.number == 0, at_zero).otherwise(F.try_divide(a.number, b.number))


def _compare(op: str, a: Column, b: Column) -> Column:
    """Comparisons where nan equals nothing and is in no order."""
    nan_a, nan_b = F.isnan(a), F.isnan(b)
    return {
        "==": lambda: (a == b) & ~nan_a,
        "!=": lambda: (a != b) | (nan_a & nan_b),
        ">": lambda: (a > b) & ~nan_a,
        ">=": lambda: (a >= b) & ~nan_a,
        "<": lambda: (a < b) & ~nan_b,
        "<=": lambda: (a <= b) & ~nan_b,
    }[op]()


def binary(op: str, a: Value, b: Value) -> Value:
    masked, fill = a.masked or b.masked, a.fill if a.masked else b.fill
    done = lambda column, kind="double": Value(column, kind, masked, fill)
    bools = a.kind == b.kind == "bool"
    if op in ("==", "!=", ">", ">=", "<", "<="):
        return done(strictly(a, b, _compare(op, a.number, b.number)), "bool")
    if op in ("&", "|"):
        return done(strictly(a, b, a.truth & b.truth if op == "&" else a.truth | b.truth), "bool")
    if op == "/":
        return done(_divide(a, b))
    if op == "^":
        return done(F.pow(a.number, b.number))
    if bools and op == "-":
        raise RasterAlgebraException("Booleans cannot be subtracted.")
    if bools:
        return done(strictly(a, b, a.truth | b.truth if op == "+" else a.truth & b.truth), "bool")
    return done({"+": a.number + b.number, "-": a.number - b.number, "*": a.number * b.number}[op])


def filled(value: Value) -> Value:
    if not value.masked:
        return value
    if value.fill is None:
        raise RasterAlgebraException("A value without a nodata number cannot be filled.")
    column = F.coalesce(value.number, F.lit(float(value.fill)))
    return Value(column, "double", False, None)


def unary(op: str, value: Value) -> Value:
    if op in ("~", "+"):
        return filled(value)
    if op == "!":
        return replace(value, column=~value.truth, kind="bool")
    if value.kind == "bool":
        raise RasterAlgebraException("A boolean cannot be negated with '-'.")
    return replace(value, column=-value.number, kind="double")


def _log(value: Value) -> Value:
    a = value.number
    plain = F.when(a == 0, -math.inf).when(a < 0, math.nan).otherwise(F.ln(a))
    return replace(value, column=F.when(a > 0, F.ln(a)) if value.masked else plain, kind="double")


def _on_numbers(function: Callable[[Column], Column], kind: str = "double") -> Callable[[Value], Value]:
    return lambda value: replace(value, column=function(value.number), kind=kind)


FUNCTIONS: dict[str, Callable[[Value], Value]] = {
    "sin": _on_numbers(F.sin), "cos": _on_numbers(F.cos), "tan": _on_numbers(F.tan), "exp": _on_numbers(F.exp), "abs": _on_numbers(F.abs),
    "int": _on_numbers(lambda a: a.try_cast("bigint"), "long"), "round": _on_numbers(F.rint), "sign": _on_numbers(F.signum), "log": _log,
}


def register_function(name: str, function: Callable[[Column], Column]) -> None:
    """Make a Column function of one number callable in formulas."""
    if not NAME.fullmatch(name) or name in REDUCERS:
        raise RasterAlgebraException(f"{name!r} cannot name a function.")
    FUNCTIONS[name] = _on_numbers(function)


class PixelScope:
    """Variables are columns of pixel rows; reducers are windows over the pixels of a tile."""

    def __init__(self, variables: dict[str, Value], tile: WindowSpec | None = None):
        self.variables, self.tile = variables, tile

    def variable(self, name: str) -> Value:
        if name in self.variables:
            return self.variables[name]
        try:
            return Value(F.lit(float(name)))
        except ValueError:
            raise RasterAlgebraException(f"The formula uses {name!r}, but no layer has that name.") from None

    def reduce(self, name: str, tree: tuple) -> Value:
        if self.tile is None:
            raise RasterAlgebraException(f"{name}() needs the pixels of a tile.")
        value = compile_tree(tree, self)
        a = value.number
        nan = F.max(F.isnan(a)).over(self.tile)
        total = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "std": F.stddev_pop, "sum": F.sum}[name](a).over(self.tile)
        # The smallest of values with a nan is nan, as for the other reducers.
        return Value(F.when(nan, math.nan).otherwise(total) if name in ("min", "median") else total, "double", value.masked, value.fill)


class ArrayScope(PixelScope):
    """Variables are arrays of a tile; an element is what a transform over their zip passes."""

    def __init__(self, arrays: dict[str, Value]):
        self.arrays, self.variables, self.tile = arrays, {}, None

    def each(self, tree: tuple) -> tuple[Column, Value]:
        """The array of the tree's values, and a Value that tells its kind."""
        used = sorted(names_in(tree) & set(self.arrays))
        seen: list[Value] = []

        def one(row: Column) -> Column:
            inner = ArrayScope(self.arrays)
            inner.variables = {n: replace(self.arrays[n], column=row[n]) for n in used}
            seen.append(compile_tree(tree, inner))
            return seen[-1].column

        if not used:
            return F.array(compile_tree(tree, self).column), compile_tree(tree, self)
        array = F.transform(F.arrays_zip(*[self.arrays[n].column.alias(n) for n in used]), one)
        return array, seen[-1]

    def reduce(self, name: str, tree: tuple) -> Value:
        array, value = self.each(tree)
        valid = F.transform(F.filter(array, lambda x: x.isNotNull()), lambda x: x.cast("double"))
        return Value(once(valid, lambda there: _reduced(name, there)), "double", value.masked, value.fill)


def once(column: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column that is evaluated a single time, however often it occurs there."""
    return F.element_at(F.transform(F.array(column), use), 1)


def _reduced(name: str, there: Column) -> Column:
    """One number for the values of a tile; NULL without any."""
    n = F.size(there)
    total = F.aggregate(there, F.lit(0.0), lambda s, x: s + x)
    nan = F.exists(there, lambda x: F.isnan(x))
    middle = lambda v: (F.element_at(v, F.floor((n - 1) / 2).cast("int") + 1) + F.element_at(v, F.floor(n / 2).cast("int") + 1)) / 2
    spread = lambda mean: F.sqrt(F.aggregate(there, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    column = {
        "min": lambda: F.when(nan, math.nan).otherwise(F.array_min(there)),
        "max": lambda: F.array_max(there),
        "sum": lambda: total,
        "mean": lambda: total / n,
        "median": lambda: F.when(nan, math.nan).otherwise(once(F.sort_array(there), middle)),
        "std": lambda: once(total / n, spread),
    }[name]()
    return F.when(n > 0, column)


def compile_tree(tree: tuple, scope: PixelScope) -> Value:
    kind = tree[0]
    if kind == "number":
        return Value(F.lit(tree[1]))
    if kind == "name":
        if tree[1] in ("TRUE", "FALSE"):
            return Value(F.lit(tree[1] == "TRUE"), "bool")
        if tree[1] == "NULL":
            raise RasterAlgebraException("NULL stands beside == and != only.")
        return Value(F.lit(CONSTANTS[tree[1]])) if tree[1] in CONSTANTS else scope.variable(tree[1])
    if kind == "call":
        name, inner = tree[1:]
        if name in REDUCERS:
            return scope.reduce(name, inner)
        if name not in FUNCTIONS:
            raise RasterAlgebraException(f"The formula calls {name!r}, which is no function.")
        return FUNCTIONS[name](compile_tree(inner, scope))
    if kind == "unary":
        return unary(tree[1], compile_tree(tree[2], scope))
    op, left, right = tree[1:]
    null = ("name", "NULL")
    if null in (left, right):
        if op not in ("==", "!="):
            raise RasterAlgebraException("NULL stands beside == and != only.")
        if left == right:
            raise RasterAlgebraException("NULL is compared with itself.")
        value = compile_tree(left if right == null else right, scope)
        return Value(value.column.isNull() if op == "==" else value.column.isNotNull(), "bool")
    return binary(op, compile_tree(left, scope), compile_tree(right, scope))


def compile_formula(formula: str, variables: dict[str, Value], tile: WindowSpec | None = None) -> Value:
    """The Value of a formula over pixel rows."""
    return compile_tree(parse(formula), PixelScope(variables, tile))


def compile_arrays(formula: str, arrays: dict[str, Value]) -> tuple[Column, Value]:
    """The array of a formula's values over the arrays of a tile."""
    return ArrayScope(arrays).each(parse(formula))
