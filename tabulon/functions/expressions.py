"""The expression language, compiled to Catalyst columns.

Grammar, loosest first: OR ||, AND &&, comparison (left to right), + -, * / %, NOT ! - +, then literals, paths, function
calls and parentheses. NOT binds tighter than a comparison. Logic is two-valued: null, 0, NaN and '' are false, equality is
strict and null-safe, an ordering comparison with null is false. Nothing here needs a UDF.

In a WHERE, comparisons under AND and OR alone are emitted bare (null filters like false there), so they reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import SchemaMismatchError

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_][A-Za-z0-9_.$]*)"""
    r"""|(?P<op>===|!==|==|!=|<>|>=|<=|&&|\|\||[=<>+\-*/%!(),]))""",
    re.DOTALL,
)
FUNCTIONS = {"LEN": (1, 1), "UPPER": (1, 1), "LOWER": (1, 1), "COALESCE": (1, None), "ISNULL": (2, 2), "IIF": (3, 3), "ABS": (1, 1), "ROUND": (1, 2)}
EQUAL, UNEQUAL, ORDER = ("=", "==", "==="), ("!=", "!==", "<>"), (">", ">=", "<", "<=")


@dataclass(frozen=True)
class Node:
    kind: str  # literal, path, call, unary, binary
    value: object
    args: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Typed:
    """A column with what is statically known of its type: number, string, boolean, date, null or other."""

    column: Column
    kind: str
    certain: bool = False  # a boolean that is never null


Resolver = Callable[[str], Typed]


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "null" if isinstance(data_type, T.NullType) else "other"


def tokenize(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SchemaMismatchError(f"unexpected character {text[at:].lstrip()[:1]!r} in expression {text!r}")
        found.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    return found


class _Parser:
    LEVELS = (("OR", "||"), ("AND", "&&"), (*EQUAL, *UNEQUAL, *ORDER), ("+", "-"), ("*", "/", "%"))

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokenize(text), 0

    def _peek(self) -> str:
        if self.at >= len(self.tokens):
            return ""
        kind, value = self.tokens[self.at]
        return value.upper() if kind == "name" and value.upper() in ("AND", "OR", "NOT") else value if kind == "op" else ""

    def parse(self) -> Node:
        node = self._level(0)
        if self.at < len(self.tokens):
            raise SchemaMismatchError(f"unexpected {self.tokens[self.at][1]!r} in expression {self.text!r}")
        return node

    def _level(self, level: int) -> Node:
        if level == len(self.LEVELS):
            return self._unary()
        node = self._level(level + 1)
        while (op := self._peek()) in self.LEVELS[level]:
            self.at += 1
            node = Node("binary", {"||": "OR", "&&": "AND"}.get(op, op), (node, self._level(level + 1)))
        return node

    def _unary(self) -> Node:
        op = self._peek()
        if op in ("NOT", "!", "-", "+"):
            self.at += 1
            return Node("unary", "NOT" if op == "!" else op, (self._unary(),))
        return self._primary()

    def _primary(self) -> Node:
        if self.at >= len(self.tokens):
            raise SchemaMismatchError(f"expression {self.text!r} ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Node("literal", float(value) if "." in value else int(value))
        if kind == "string":
            return Node("literal", re.sub(r"\\(.)", r"\1", value[1:-1], flags=re.DOTALL))
        if kind == "name":
            upper = value.upper()
            if upper in ("TRUE", "FALSE", "NULL"):
                return Node("literal", {"TRUE": True, "FALSE": False, "NULL": None}[upper])
            if self._peek() == "(":
                self.at += 1
                args = []
                while self._peek() != ")":
                    args.append(self._level(0))
                    if self._peek() == ",":
                        self.at += 1
                    elif self._peek() != ")":
                        raise SchemaMismatchError(f"missing ) in expression {self.text!r}")
                self.at += 1
                if upper not in FUNCTIONS:
                    raise SchemaMismatchError(f"unknown function {value}")
                least, most = FUNCTIONS[upper]
                if len(args) < least or most is not None and len(args) > most:
                    raise SchemaMismatchError(f"{upper} takes {least}{'' if most == least else f' to {most or "any number of"}'} arguments")
                return Node("call", upper, tuple(args))
            return Node("path", value)
        if value == "(":
            node = self._level(0)
            if self._peek() != ")":
                raise SchemaMismatchError(f"missing ) in expression {self.text!r}")
            self.at += 1
            return node
        raise SchemaMismatchError(f"unexpected {value!r} in expression {self.text!r}")


def parse(text: str) -> Node:
    return _Parser(text).parse()


def paths(node: Node) -> set[str]:
    return ({str(node.value)} if node.kind == "path" else set()).union(*(paths(a) for a in node.args))


# -- values ------------------------------------------------------------------------------------------------------------


def truthy(x: Typed) -> Column:
    if x.kind == "boolean":
        return x.column if x.certain else F.coalesce(x.column, F.lit(False))
    if x.kind == "number":
        return F.coalesce((x.column != 0) & ~F.isnan(x.column.cast("double")), F.lit(False))
    if x.kind == "string":
        return F.coalesce(x.column != "", F.lit(False))
    return F.lit(False) if x.kind == "null" else x.column.isNotNull()


def as_number(x: Typed) -> Column:
    """A double; null is 0, text that is no number is NaN."""
    zero = F.lit(0.0)
    if x.kind == "number" or x.kind == "boolean":
        return F.coalesce(x.column.cast("int").cast("double") if x.kind == "boolean" else x.column.cast("double"), zero)
    if x.kind == "date":
        return F.coalesce((F.unix_micros(x.column.cast("timestamp")) / 1000).cast("double"), zero)
    if x.kind == "string":
        trimmed = F.trim(x.column)
        return F.when(x.column.isNull() | (trimmed == ""), zero).otherwise(F.coalesce(trimmed.try_cast("double"), F.lit(float("nan"))))
    return zero if x.kind == "null" else F.lit(float("nan"))


def as_text(x: Typed) -> Column:
    """Text; whole numbers without a fraction, null is ''."""
    if x.kind == "string":
        return F.coalesce(x.column, F.lit(""))
    if x.kind == "null":
        return F.lit("")
    if x.kind == "number":
        value = x.column.cast("double")
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.coalesce(F.when(whole, value.cast("bigint").cast("string")).otherwise(x.column.cast("string")), F.lit(""))
    if x.kind == "date":
        return F.coalesce(F.date_format(x.column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    return F.coalesce(x.column.cast("string"), F.lit(""))


def equal(a: Typed, b: Typed) -> Column:
    if a.kind == b.kind or "null" in (a.kind, b.kind) or "other" in (a.kind, b.kind):
        return a.column.eqNullSafe(b.column)
    return a.column.isNull() & b.column.isNull()


def ordered(a: Typed, op: str, b: Typed) -> Column:
    """Null if either is null."""
    x, y = a.column, b.column
    if a.kind != b.kind or a.kind not in ("number", "date"):
        if {a.kind, b.kind} == {"date", "string"}:  # an instant against a text literal: by time
            x, y = (c if t.kind == "date" else c.try_cast("timestamp") for c, t in ((x, a), (y, b)))
        else:  # dictionary order
            x, y = (F.collate(F.when(c.isNotNull(), as_text(t)), "UNICODE") for c, t in ((x, a), (y, b)))
    return {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]


def _same_kind(found: list[Typed]) -> tuple[list[Column], str]:
    kinds = {x.kind for x in found} - {"null"}
    if len(kinds) <= 1:
        return [x.column for x in found], kinds.pop() if kinds else "null"
    return [F.when(x.column.isNotNull(), as_text(x)) for x in found], "string"


class Compiler:
    def __init__(self, resolve: Resolver):
        self.resolve = resolve

    def value(self, node: Node) -> Typed:
        if node.kind == "literal":
            v = node.value
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
            return Typed(F.lit(v), kind, kind == "boolean")
        if node.kind == "path":
            return self.resolve(str(node.value))
        args = [self.value(a) for a in node.args] if node.value not in ("AND", "OR", "NOT") else []
        if node.kind == "unary":
            if node.value == "NOT":
                return Typed(~truthy(self.value(node.args[0])), "boolean", True)
            number = as_number(args[0])
            return Typed(-number if node.value == "-" else number, "number")
        if node.kind == "call":
            return self._call(str(node.value), args)
        return self._binary(str(node.value), node, args)

    def _call(self, name: str, args: list[Typed]) -> Typed:
        first = args[0]
        if name == "LEN":
            return Typed(F.length(as_text(first)).cast("bigint"), "number")
        if name in ("UPPER", "LOWER"):
            return Typed((F.upper if name == "UPPER" else F.lower)(as_text(first)), "string")
        if name in ("COALESCE", "ISNULL"):
            columns, kind = _same_kind(args)
            return Typed(F.coalesce(*columns), kind)
        if name == "IIF":
            columns, kind = _same_kind(args[1:])
            return Typed(F.when(truthy(first), columns[0]).otherwise(columns[1]), kind)
        if name == "ABS":
            return Typed(F.abs(as_number(first)), "number")
        if len(args) == 1:  # half goes up, also below zero
            return Typed(F.floor(as_number(first) + 0.5).cast("double"), "number")
        return Typed(F.round(as_number(first), as_number(args[1]).cast("int")), "number")

    def _binary(self, op: str, node: Node, args: list[Typed]) -> Typed:
        if op in ("AND", "OR"):
            a, b = (truthy(self.value(x)) for x in node.args)
            return Typed(a & b if op == "AND" else a | b, "boolean", True)
        a, b = args
        if op in EQUAL:
            return Typed(equal(a, b), "boolean", True)
        if op in UNEQUAL:
            return Typed(~equal(a, b), "boolean", True)
        if op in ORDER:
            return Typed(ordered(a, op, b), "boolean")
        if op == "+":
            if {a.kind, b.kind} <= {"number", "null"}:
                return Typed(as_number(a) + as_number(b), "number")
            return Typed(F.concat(as_text(a), as_text(b)), "string")
        x, y = as_number(a), as_number(b)
        if op == "-":
            return Typed(x - y, "number")
        if op == "*":
            return Typed(x * y, "number")
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        if op == "/":
            by_zero = F.when(x > 0, inf).when(x < 0, -inf).otherwise(nan)
            return Typed(F.when(y == 0, by_zero).otherwise(F.try_divide(x, y)), "number")
        return Typed(F.when(y == 0, nan).otherwise(F.try_mod(x, y)), "number")

    def condition(self, node: Node) -> Column:
        """For a WHERE: ordering comparisons are bare where null filters like false."""
        if node.kind == "binary" and node.value in ("AND", "OR"):
            a, b = (self.condition(x) for x in node.args)
            return a & b if node.value == "AND" else a | b
        found = self.value(node)
        return found.column if found.kind == "boolean" else truthy(found)


def compile_value(text: str, resolve: Resolver) -> Typed:
    return Compiler(resolve).value(parse(text))


def compile_condition(text: str, resolve: Resolver) -> Column:
    return Compiler(resolve).condition(parse(text))
