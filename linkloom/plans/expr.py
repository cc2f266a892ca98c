"""The expression language of Query, DfEval and RowEval, compiled to Columns.

Comparisons are two-valued: a missing operand makes them false, `!=` true.
Division by zero gives infinities, `//` floors, `%` takes the divisor's sign.
NaN counts as missing.
"""

from __future__ import annotations

import ast
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import ROW_ID, c


class ExpressionError(ValueError):
    """An expression that the language does not have, or whose types do not fit."""


_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")
_INF = float("inf")
# Functions of one number, by name.
_MATH = {
    "sin": F.sin, "cos": F.cos, "exp": F.exp, "expm1": F.expm1, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arctan": F.atan, "arcsinh": F.asinh,
}


def _masked(text: str) -> tuple[str, dict[str, str]]:
    """Operators and quoted names as Python's own grammar has them."""
    names: dict[str, str] = {}
    strings: list[str] = []

    def string(m: re.Match) -> str:
        strings.append(m[0])
        return f"\x00{len(strings) - 1}\x00"

    def name(m: re.Match) -> str:
        key = f"__quoted{len(names)}__"
        names[key] = m[1]
        return key

    text = _QUOTED.sub(string, text)
    if "@" in text:
        raise ExpressionError("local variables (@) are not supported")
    text = re.sub(r"`([^`]+)`", name, text)
    text = re.sub(r"&&?", " and ", re.sub(r"\|\|?", " or ", text))
    return re.sub("\x00(\\d+)\x00", lambda m: strings[int(m[1])], text), names


class Value:
    """A Column and its kind: num (int or float), str, bool, list or other.

    raw: a float column as it is stored, where col has NaN as null.
    loose: a condition that may be null where it is false; it is for filters,
    which then reach the scan."""

    def __init__(self, col: Column | None, kind: str, whole: bool = False, items: list | None = None, raw: Column | None = None, loose: Column | None = None):
        self.col, self.kind, self.whole, self.items, self.raw = col, kind, whole, items, raw
        self.loose = col if loose is None else loose


def _kind(t: T.DataType) -> tuple[str, bool]:
    if isinstance(t, T.BooleanType):
        return "bool", False
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "num", True
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "num", False
    return ("str" if isinstance(t, T.StringType) else "other"), False


class Compiler:
    def __init__(self, df: DataFrame, row: bool = False):
        self.types = {f.name: f.dataType for f in df.schema}
        self.row, self.names = row, {}
        self.made: dict[str, Value] = {}
        #: conditions under which a row fails (row mode)
        self.fails: list[Column] = []
        self.reads: set[str] = set()

    def value(self, text: str) -> Value:
        text, self.names = _masked(text.strip())
        try:
            node = ast.parse(text, mode="eval").body
        except SyntaxError as e:
            raise ExpressionError(f"{text!r}: {e.msg}") from None
        return self._go(node)

    def assignments(self, text: str) -> list[tuple[str, Value]]:
        text, self.names = _masked(text)
        try:
            body = ast.parse("\n".join(x.strip() for x in text.strip().split("\n"))).body
        except SyntaxError as e:
            raise ExpressionError(f"{text!r}: {e.msg}") from None
        out = []
        for node in body:
            if not isinstance(node, ast.Assign) or len(node.targets) != 1 or not isinstance(node.targets[0], ast.Name):
                raise ExpressionError("without out_column each line must assign to a column")
            name = self.names.get(node.targets[0].id, node.targets[0].id)
            self.made[name] = v = self._go(node.value)
            out.append((name, v))
        return out

    def _column(self, name: str) -> Value:
        name = self.names.get(name, name)
        if name in self.made:
            return self.made[name]
        if name not in self.types:
            if name == "index" and ROW_ID in self.types:
                name = ROW_ID
            else:
                raise ExpressionError(f"no column {name!r}")
        self.reads.add(name)
        kind, whole = _kind(self.types[name])
        col, raw = c(name), None
        if isinstance(self.types[name], (T.FloatType, T.DoubleType)):
            raw = col
            col = F.nanvl(col.cast("double"), F.lit(None).cast("double"))
        elif isinstance(self.types[name], T.DecimalType):
            col = col.cast("double")
        elif whole:
            col = col.cast("long")
        return Value(col, kind, whole, raw=raw)

    def _go(self, n: ast.AST) -> Value:
        handler = getattr(self, f"_{type(n).__name__.lower()}", None)
        if handler is None:
            raise ExpressionError(f"{type(n).__name__} is not supported")
        return handler(n)

    def _name(self, n: ast.Name) -> Value:
        if n.id in ("True", "False"):
            return Value(F.lit(n.id == "True"), "bool")
        if self.row:
            raise ExpressionError(f"columns are written row.{n.id} here")
        return self._column(n.id)

    def _constant(self, n: ast.Constant) -> Value:
        v = n.value
        if isinstance(v, bool):
            return Value(F.lit(v), "bool")
        if isinstance(v, int):
            return Value(F.lit(v).cast("long"), "num", True)
        if isinstance(v, float):
            return Value(F.lit(v).cast("double"), "num")
        if isinstance(v, str):
            return Value(F.lit(v), "str")
        raise ExpressionError(f"literal {v!r} is not supported")

    def _list(self, n: ast.List) -> Value:
        return Value(None, "list", items=[self._go(x) for x in n.elts])

    _tuple = _list

    def _attribute(self, n: ast.Attribute) -> Value:
        if self.row and isinstance(n.value, ast.Name) and n.value.id == "row":
            return self._column(n.attr)
        raise ExpressionError(f"attribute {n.attr!r} is not supported")

    # -- logic

    def _truth(self, v: Value) -> Column:
        if v.kind != "bool":
            raise ExpressionError("a condition is needed")
        return F.coalesce(v.col, F.lit(False))

    def _boolop(self, n: ast.BoolOp) -> Value:
        parts = [self._go(x) for x in n.values]
        join = lambda cols: reduce(lambda a, b: a & b if isinstance(n.op, ast.And) else a | b, cols)
        return Value(join([self._truth(p) for p in parts]), "bool", loose=join([p.loose for p in parts]))

    def _unaryop(self, n: ast.UnaryOp) -> Value:
        v = self._go(n.operand)
        if isinstance(n.op, (ast.Not, ast.Invert)):
            return Value(~self._truth(v), "bool")
        if v.kind != "num":
            raise ExpressionError("a number is needed")
        return v if isinstance(n.op, ast.UAdd) else Value(F.try_subtract(F.lit(0).cast("long"), v.col) if v.whole else -v.col, "num", v.whole)

    def _compare(self, n: ast.Compare) -> Value:
        sides = [self._go(x) for x in (n.left, *n.comparators)]
        parts = [self._pair(op, a, b) for op, a, b in zip(n.ops, sides, sides[1:])]
        both = lambda cols: reduce(lambda a, b: a & b, cols)
        return Value(both([F.coalesce(p, F.lit(False)) for p in parts]), "bool", loose=both(parts))

    def _pair(self, op: ast.cmpop, a: Value, b: Value) -> Column:
        """True or not; null counts as false."""
        if isinstance(op, (ast.In, ast.NotIn)) or b.kind == "list" and isinstance(op, (ast.Eq, ast.NotEq)):
            if b.kind != "list":
                raise ExpressionError("in needs a list")
            fit = [x.col for x in b.items if x.kind == a.kind]
            one = a.col if a.raw is None else a.raw
            found = one.isin(*fit) if fit else F.lit(False)
            return found if isinstance(op, (ast.In, ast.Eq)) else ~F.coalesce(found, F.lit(False))
        if a.kind != b.kind:
            if isinstance(op, (ast.Eq, ast.NotEq)):
                return F.lit(isinstance(op, ast.NotEq))
            raise ExpressionError(f"{a.kind} and {b.kind} have no order")
        if isinstance(op, ast.NotEq):
            return F.coalesce(a.col != b.col, F.lit(True))
        x, y = a.col if a.raw is None else a.raw, b.col if b.raw is None else b.raw
        # NaN is above all numbers and equal to itself in Spark: only where that matters is it looked for
        upper = {ast.Lt: b, ast.LtE: b, ast.Gt: a, ast.GtE: a, ast.Eq: a if b.raw is not None else None}.get(type(op))
        made = {ast.Eq: lambda: x == y, ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y}.get(type(op))
        if made is None:
            raise ExpressionError(f"{type(op).__name__} is not supported")
        guarded = upper is not None and upper.raw is not None
        return made() & ~F.isnan(upper.raw) if guarded else made()

    # -- arithmetic

    def _binop(self, n: ast.BinOp) -> Value:
        a, b = self._go(n.left), self._go(n.right)
        if isinstance(n.op, ast.Add) and a.kind == b.kind == "str":
            if not self.row:
                raise ExpressionError("strings can be added in row expressions only")
            self.fails.append(a.col.isNull() | b.col.isNull())
            return Value(F.concat(a.col, b.col), "str")
        if a.kind != "num" or b.kind != "num":
            raise ExpressionError(f"{type(n.op).__name__} of {a.kind} and {b.kind}")
        both = a.whole and b.whole
        x, y = (a.col, b.col) if both else (a.col.cast("double"), b.col.cast("double"))
        if isinstance(n.op, ast.Add):
            return Value(F.try_add(x, y), "num", both)
        if isinstance(n.op, ast.Sub):
            return Value(F.try_subtract(x, y), "num", both)
        if isinstance(n.op, ast.Mult):
            return Value(F.try_multiply(x, y), "num", both)
        x, y = a.col.cast("double"), b.col.cast("double")
        quotient = F.when(y == 0, F.when(x > 0, F.lit(_INF)).when(x < 0, F.lit(-_INF))).otherwise(x / y)
        if isinstance(n.op, ast.Div):
            return Value(quotient, "num")
        if isinstance(n.op, ast.FloorDiv):
            return Value(F.when(y == 0, quotient).otherwise(F.floor(x / y).cast("double")), "num")
        if isinstance(n.op, ast.Mod):
            return Value(F.when(y != 0, x - y * F.floor(x / y)), "num")
        if isinstance(n.op, ast.Pow):
            whole = both and isinstance(n.right, ast.Constant) and n.right.value >= 0
            power = F.pow(x, y)
            return Value(F.when(F.abs(power) < 2.0**63, power).try_cast("long") if whole else power, "num", whole)
        raise ExpressionError(f"{type(n.op).__name__} is not supported")

    # -- functions

    def _call(self, n: ast.Call) -> Value:
        if n.keywords and not isinstance(n.func, ast.Attribute):
            raise ExpressionError("keyword arguments are not supported")
        if isinstance(n.func, ast.Name):
            return self._function(n.func.id, [self._go(x) for x in n.args])
        if isinstance(n.func, ast.Attribute):
            f = n.func
            if isinstance(f.value, ast.Attribute) and f.value.attr == "str":
                return self._string(f.attr, self._go(f.value.value), n)
            if f.attr in ("isnull", "isna", "notnull", "notna") and not n.args:
                v = self._go(f.value)
                return Value(v.col.isNull() if f.attr in ("isnull", "isna") else v.col.isNotNull(), "bool")
        raise ExpressionError("this call is not supported")

    def _function(self, name: str, args: list[Value]) -> Value:
        if any(a.kind != "num" for a in args):
            raise ExpressionError(f"{name} of something that is no number")
        x = args[0].col.cast("double") if args else None
        if name == "arctan2" and len(args) == 2:
            return Value(F.atan2(x, args[1].col.cast("double")), "num")
        if len(args) != 1:
            raise ExpressionError(f"{name} does not take {len(args)} arguments")
        if name == "abs":
            return Value(F.abs(args[0].col), "num", args[0].whole)
        if name in ("floor", "ceil"):
            return Value((F.floor if name == "floor" else F.ceil)(x).cast("double"), "num")
        if name in ("log", "log10", "log1p"):
            edge, f = {"log": (0.0, F.ln), "log10": (0.0, F.log10), "log1p": (-1.0, F.log1p)}[name]
            return Value(F.when(x == edge, F.lit(-_INF)).when(x > edge, f(x)), "num")
        if name == "sqrt":
            return Value(F.when(x >= 0, F.sqrt(x)), "num")
        if name in ("arcsin", "arccos"):
            return Value(F.when(F.abs(x) <= 1, (F.asin if name == "arcsin" else F.acos)(x)), "num")
        if name == "arccosh":
            return Value(F.when(x >= 1, F.acosh(x)), "num")
        if name == "arctanh":
            return Value(F.when(F.abs(x) < 1, F.atanh(x)).when(F.abs(x) == 1, F.signum(x) * F.lit(_INF)), "num")
        if name in _MATH:
            return Value(_MATH[name](x), "num")
        raise ExpressionError(f"no function {name!r}")

    def _string(self, name: str, v: Value, n: ast.Call) -> Value:
        if v.kind != "str":
            raise ExpressionError(".str needs a string column")
        if not all(isinstance(x, ast.Constant) for x in (*n.args, *(k.value for k in n.keywords))):
            raise ExpressionError(f".str.{name} takes literals only")
        args = [x.value for x in n.args]
        options = {k.arg: k.value.value for k in n.keywords}
        least = {"contains": 1, "startswith": 1, "endswith": 1, "replace": 2}.get(name, 0)
        if len(args) != least or not all(isinstance(x, str) for x in args):
            raise ExpressionError(f".str.{name} takes {least} strings")
        if name == "contains":
            found = F.contains(v.col, F.lit(args[0])) if options.get("regex") is False else F.rlike(v.col, F.lit(args[0] if options.get("case", True) else f"(?i){args[0]}"))
            return Value(found, "bool")
        simple = {"lower": F.lower, "upper": F.upper, "strip": lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")}
        if name in simple:
            return Value(simple[name](v.col), "str")
        if name == "len":
            return Value(F.length(v.col).cast("long"), "num", True)
        if name in ("startswith", "endswith"):
            return Value((F.startswith if name == "startswith" else F.endswith)(v.col, F.lit(args[0])), "bool")
        if name == "replace":
            if options.get("regex"):
                return Value(F.regexp_replace(v.col, F.lit(args[0]), F.lit(args[1])), "str")
            return Value(F.replace(v.col, F.lit(args[0]), F.lit(args[1])), "str")
        raise ExpressionError(f"no string method {name!r}")


def condition(df: DataFrame, text: str) -> tuple[Column, Column]:
    """A condition that is true or false, and one for filters, which may be null for false."""
    v = Compiler(df).value(text)
    if v.kind != "bool":
        raise ExpressionError(f"{text!r} is no condition")
    return F.coalesce(v.col, F.lit(False)), v.loose
