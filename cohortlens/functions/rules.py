"""Selection rules: text compiled to Columns with Python's truth and null logic.

Comparisons with a null are false, equality is null-safe, `not null` is true,
division by zero is null, modulo floors, and percentile() is exact over the
whole manifest.  Anything beyond the language is rejected when a rule is compiled.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.ranks import exact_percentiles


class RuleError(ValueError):
    """A rule is not in the language."""


@dataclass
class Value:
    """A compiled expression and what is known of its type: num, str, bool, null or other."""

    column: Column
    kind: str
    floating: bool = False


def _kind(t: T.DataType) -> tuple[str, bool]:
    if isinstance(t, T.BooleanType):
        return "bool", False
    if isinstance(t, T.StringType):
        return "str", False
    if isinstance(t, T.NumericType):
        return "num", isinstance(t, (T.FloatType, T.DoubleType))
    return "other", False


def truthy(v: Value) -> Column:
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "bool":
        return F.coalesce(v.column, F.lit(False))
    if v.kind == "num":
        return F.coalesce(v.column != 0, F.lit(False))
    if v.kind == "str":
        return F.coalesce(F.length(v.column) > 0, F.lit(False))
    return v.column.isNotNull()


def _number(v: Value) -> Column:
    return v.column.cast("double")


class Compiler:
    def __init__(self, df: DataFrame):
        self.df, self.fields = df, {f.name: f.dataType for f in df.schema.fields}
        self.percentiles: dict[tuple[str, float], float | None] = {}

    def compile(self, text: str) -> Column:
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as e:
            raise RuleError(f"not an expression: {text!r}") from e
        self._measure(tree)
        return truthy(self.of(tree.body))

    def _measure(self, tree: ast.AST) -> None:
        """All percentiles of a rule together."""
        calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "percentile"]
        wanted = sorted({x for x in map(self._percentile_of, calls) if x})
        self.percentiles = exact_percentiles(self.df, wanted)

    def of(self, node: ast.AST) -> Value:
        method = getattr(self, f"_{type(node).__name__.lower()}", None)
        if method is None:
            raise RuleError(f"{type(node).__name__} is not allowed in a rule")
        return method(node)

    def _constant(self, node: ast.Constant) -> Value:
        x = node.value
        if x is None:
            return Value(F.lit(None), "null")
        if isinstance(x, bool):
            return Value(F.lit(x), "bool")
        if isinstance(x, (int, float)):
            return Value(F.lit(x), "num", isinstance(x, float))
        if isinstance(x, str):
            return Value(F.lit(x), "str")
        raise RuleError(f"constant {x!r}")

    def _name(self, node: ast.Name) -> Value:
        if node.id not in self.fields:
            return Value(F.lit(None), "null")
        return Value(F.col(f"`{node.id}`"), *_kind(self.fields[node.id]))

    def _boolop(self, node: ast.BoolOp) -> Value:
        out = truthy(self.of(node.values[0]))
        for x in node.values[1:]:
            y = truthy(self.of(x))
            out = out & y if isinstance(node.op, ast.And) else out | y
        return Value(out, "bool")

    def _unaryop(self, node: ast.UnaryOp) -> Value:
        v = self.of(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~truthy(v), "bool")
        if isinstance(node.op, ast.USub) and v.kind in ("num", "null"):
            return Value(-v.column, v.kind, v.floating)
        if isinstance(node.op, ast.UAdd) and v.kind in ("num", "null"):
            return v
        raise RuleError("unary operator")

    def _binop(self, node: ast.BinOp) -> Value:
        a, b = self.of(node.left), self.of(node.right)
        if isinstance(node.op, ast.Add) and a.kind == b.kind == "str":
            return Value(F.concat(a.column, b.column), "str")
        if "null" in (a.kind, b.kind):
            return Value(F.lit(None), "null")
        if not {a.kind, b.kind} <= {"num", "bool"}:
            raise RuleError("arithmetic on what is no number")
        x, y = _number(a), _number(b)
        some = F.nullif(y, F.lit(0.0))
        table = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: x / some, ast.Mod: lambda: x - some * F.floor(x / some)}
        if type(node.op) not in table:
            raise RuleError(f"operator {type(node.op).__name__}")
        return Value(table[type(node.op)](), "num", True)

    def _ifexp(self, node: ast.IfExp) -> Value:
        a, b = self.of(node.body), self.of(node.orelse)
        kind = b.kind if a.kind == "null" else a.kind
        return Value(F.when(truthy(self.of(node.test)), a.column).otherwise(b.column), kind, a.floating or b.floating)

    def _equal(self, a: Value, b: Value) -> Column:
        comparable = a.kind == b.kind or "null" in (a.kind, b.kind) or {a.kind, b.kind} <= {"num", "bool"}
        if not comparable:
            return F.lit(False)
        x, y = (_number(a), _number(b)) if {a.kind, b.kind} == {"num", "bool"} else (a.column, b.column)
        same = x.eqNullSafe(y)
        return same & ~F.coalesce(F.isnan(x), F.lit(False)) if a.floating else same

    def _ordered(self, op: ast.cmpop, a: Value, b: Value) -> Column:
        if a.kind == b.kind == "str":
            x, y = a.column, b.column
        elif {a.kind, b.kind} <= {"num", "bool"}:
            x, y = _number(a), _number(b)
        else:
            return F.lit(False)
        out = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]
        for v, c in ((a, x), (b, y)):
            if v.floating:  # no order with NaN
                out = out & ~F.isnan(c)
        return F.coalesce(out, F.lit(False))

    #: What may stand on the right of `in` beside text.
    LITERALS = (ast.List, ast.Tuple, ast.Set)

    def _collection(self, node: ast.AST) -> Value:
        """A list, tuple or set by itself is true if it has members, and equal to nothing that a manifest holds."""
        for x in node.elts:
            self.of(x)
        return Value(F.lit(True) if node.elts else F.lit(None), "other")

    _list = _tuple = _set = _collection

    def _member(self, a: Value, node: ast.AST) -> Column:
        if isinstance(node, self.LITERALS):
            out = F.lit(False)
            for x in node.elts:
                out = out | self._equal(a, self.of(x))
            return out
        b = self.of(node)
        if a.kind == b.kind == "str":
            return F.coalesce(F.contains(b.column, a.column), F.lit(False))
        return F.lit(False)

    def _compare(self, node: ast.Compare) -> Value:
        out, left = F.lit(True), self.of(node.left)
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                found = self._member(left, right)
                if isinstance(op, ast.NotIn):
                    null = not isinstance(right, self.LITERALS) and self.of(right).kind == "null"
                    found = F.lit(False) if null else ~found
                # The chain goes on with what stands on the right, as in Python.
                out, left = out & found, self.of(right)
                continue
            b = self.of(right)
            if isinstance(op, ast.Eq):
                one = self._equal(left, b)
            elif isinstance(op, ast.NotEq):
                one = ~self._equal(left, b)
            elif type(op) in (ast.Lt, ast.LtE, ast.Gt, ast.GtE):
                one = self._ordered(op, left, b)
            else:
                raise RuleError(f"comparison {type(op).__name__}")
            out, left = out & one, b
        return Value(out, "bool")

    def _call(self, node: ast.Call) -> Value:
        if not isinstance(node.func, ast.Name):
            raise RuleError("only is_null, lower and percentile can be called")
        name = node.func.id
        if name == "is_null" and len(node.args) == 1 and not node.keywords:
            return Value(self.of(node.args[0]).column.isNull(), "bool")
        if name == "lower" and len(node.args) == 1 and not node.keywords:
            v = self.of(node.args[0])
            return Value(F.lower(v.column), "str") if v.kind == "str" else v
        if name == "percentile":
            return self._percentile(node)
        raise RuleError(f"function {name}")

    def _percentile_of(self, node: ast.Call) -> tuple[str, float] | None:
        """(field, q) of a call, null where the field has no numbers."""
        given = dict(zip(("field", "q"), node.args, strict=False)) | {k.arg: k.value for k in node.keywords}
        try:
            field, q = ast.literal_eval(given["field"]), float(ast.literal_eval(given.get("q", ast.Constant(50))))
        except (KeyError, ValueError) as e:
            raise RuleError("percentile takes a field's name and a number") from e
        return (field, min(100.0, max(0.0, q))) if _kind(self.fields.get(field, T.NullType()))[0] == "num" else None

    def _percentile(self, node: ast.Call) -> Value:
        wanted = self._percentile_of(node)
        value = self.percentiles.get(wanted) if wanted else None
        return Value(F.lit(value), "null" if value is None else "num", True)


def compile_rule(df: DataFrame, text: str | None) -> Column:
    """The rule as a boolean Column over df; an empty rule keeps every row."""
    return F.lit(True) if not (text or "").strip() else Compiler(df).compile(text)


def thresholds_to_rule(**limits: float) -> str:
    """field=value as `field >= value`, by name, joined by `and`."""
    return " and ".join(f"{k} >= {limits[k]!r}" for k in sorted(limits))
