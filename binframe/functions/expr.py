"""The expression language of projections, lowered to columns.

Expressions read fields of the row (``_``), its parents and root, states by name and positions; they give null instead of
failing, and every mistake that can be seen beforehand is an ``ExpressionError`` with a code. Grammar: C-like operators with
``and or not``, ``c ? a : b``, ``a.b``, calls with one argument; numbers decimal or hexadecimal; strings in either quotes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binframe.functions.types import wrap
from binframe.operators.dissect import ip4_str, ip6_str


class ExpressionError(ValueError):
    def __init__(self, code: str, message: str, at: int = 0) -> None:
        super().__init__(f"{code} at {at}: {message}")
        self.code, self.at = code, at


_TOKEN = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+|\d+\.\d+|\d+)|([A-Za-z_]\w*)|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(===|!==|>>>|==|!=|<=|>=|<<|>>|&&|\|\||[-+*/%<>!~&|^?:().]))")
#: Strength of the binary operators, weakest first.
BINARY = {"or": 1, "||": 1, "and": 2, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
FUNCTIONS = ("enum_str", "to_i", "len", "u24be", "ip4_str", "ip6_str", "dos_dttm", "_index")

Node = tuple[Any, ...]


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, Any, int]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError("EXPRESSION_SYNTAX", f"unexpected {text[at:].strip()[0]!r}", at)
            number, name, string, op = m.groups()
            if number:
                self.tokens.append(("number", int(number, 0) if "." not in number and not re.fullmatch(r"0\d+", number) else float(number) if "." in number else int(number), m.start(1)))
            elif string:
                self.tokens.append(("string", re.sub(r"\\(.)", r"\1", string[1:-1]), m.start(3)))
            else:
                self.tokens.append(("op" if op or name in ("and", "or", "not") else "name", op or name, m.start(4 if op else 2)))
            at = m.end()
        self.k = 0

    def peek(self) -> tuple[str, Any, int]:
        return self.tokens[self.k] if self.k < len(self.tokens) else ("end", None, self.tokens[-1][2] + 1 if self.tokens else 0)

    def next(self) -> tuple[str, Any, int]:
        t = self.peek()
        self.k += 1
        return t

    def expect(self, op: str) -> None:
        kind, value, at = self.next()
        if (kind, value) != ("op", op):
            raise ExpressionError("EXPRESSION_SYNTAX", f"{op!r} expected", at)

    def ternary(self) -> Node:
        test = self.binary(1)
        if self.peek()[:2] != ("op", "?"):
            return test
        self.next()
        yes = self.ternary()
        self.expect(":")
        return ("?", test, yes, self.ternary())

    def binary(self, least: int) -> Node:
        left = self.unary()
        while self.peek()[0] == "op" and BINARY.get(self.peek()[1], 0) >= least:
            op = self.next()[1]
            left = (op, left, self.binary(BINARY[op] + 1))
        return left

    def unary(self) -> Node:
        kind, value, _ = self.peek()
        if kind == "op" and value in ("-", "+", "~", "!", "not"):
            self.next()
            return ("unary", "!" if value == "not" else value, self.unary())
        return self.postfix()

    def postfix(self) -> Node:
        kind, value, at = self.next()
        if kind in ("number", "string"):
            node: Node = ("lit", value)
        elif kind == "name":
            if self.peek()[:2] == ("op", "("):
                if value not in FUNCTIONS:
                    raise ExpressionError("EXPRESSION_UNKNOWN_FUNCTION", value, at)
                self.next()
                arg = self.ternary()
                if self.peek()[:2] != ("op", ")"):
                    raise ExpressionError("EXPRESSION_ARITY", f"{value} takes one argument", at)
                self.next()
                node = ("call", value, arg)
            else:
                node = ("lit", {"true": True, "false": False, "null": None}[value]) if value in ("true", "false", "null") else ("name", value, at)
        elif (kind, value) == ("op", "("):
            node = self.ternary()
            self.expect(")")
        else:
            raise ExpressionError("EXPRESSION_SYNTAX", "a value expected", at)
        while self.peek()[:2] == ("op", "."):
            self.next()
            kind, value, at = self.next()
            if kind != "name":
                raise ExpressionError("EXPRESSION_SYNTAX", "a field name expected", at)
            node = ("get", node, value)
        return node


def parse(text: str) -> Node:
    p = _Parser(text)
    node = p.ternary()
    kind, value, at = p.peek()
    if kind != "end":
        raise ExpressionError("EXPRESSION_SYNTAX", f"unexpected {value!r}", at)
    return node


@dataclass
class Value:
    """A column and its kind: long, double, bool, string, binary, array, struct or null."""

    column: Column
    kind: str
    type: T.DataType | None = None


def kind_of(t: T.DataType) -> str:
    for kinds, name in (((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "long"), ((T.FloatType, T.DoubleType, T.DecimalType), "double"), (T.BooleanType, "bool"), (T.StringType, "string"), (T.BinaryType, "binary"), (T.ArrayType, "array"), (T.StructType, "struct"), (T.NullType, "null")):
        if isinstance(t, kinds):
            return name
    return "other"


def value_of(column: Column, t: T.DataType) -> Value:
    kind = kind_of(t)
    return Value(column.cast("long") if kind == "long" else column.cast("double") if kind == "double" else column, kind, t)


def _null() -> Value:
    return Value(F.lit(None), "null")


def truthy(v: Value) -> Column:
    """As in a condition: null, 0, not-a-number, false and the empty string are false."""
    c = v.column
    test = {"bool": lambda: c, "long": lambda: c != 0, "double": lambda: (c != 0) & ~F.isnan(c), "string": lambda: c != "", "null": lambda: F.lit(False)}.get(v.kind, lambda: c.isNotNull())()
    return F.coalesce(test, F.lit(False))


def _string(v: Value) -> Column:
    return F.when(v.column == F.floor(v.column), F.floor(v.column).cast("string")).otherwise(v.column.cast("string")) if v.kind == "double" else v.column.cast("string")


def _int32(v: Value) -> Column:
    return wrap(v.column, 32, True).cast("int")


class Lowering:
    """Lowers trees against names bound to values; ``indexes`` are the positions of the anchor's iterations."""

    def __init__(self, names: dict[str, Value], indexes: list[Column] | None = None, strict: bool = False) -> None:
        self.names, self.indexes, self.strict = names, indexes or [], strict

    def __call__(self, text: str) -> Value:
        return self.lower(parse(text))

    def lower(self, n: Node) -> Value:
        op = n[0]
        if op == "lit":
            v = n[1]
            kind = "null" if v is None else "bool" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
            return Value(F.lit(v).cast("long") if kind == "long" else F.lit(v), kind)
        if op == "name":
            if n[1] not in self.names:
                raise ExpressionError("EXPRESSION_UNKNOWN_IDENTIFIER", n[1], n[2])
            return self.names[n[1]]
        if op == "get":
            return self._field(self.lower(n[1]), n[2])
        if op == "unary":
            return self._unary(n[1], self.lower(n[2]))
        if op == "?":
            test, yes, no = self.lower(n[1]), self.lower(n[2]), self.lower(n[3])
            yes, no, kind = self._alike(yes, no)
            return Value(F.when(truthy(test), yes.column).otherwise(no.column), kind)
        if op == "call":
            return self._call(n[1], n[2])
        return self._binary(op, self.lower(n[1]), self.lower(n[2]))

    def _field(self, v: Value, name: str) -> Value:
        if v.kind != "struct":
            return _null()
        parts = name.split("_")
        fields = {f.name: f.dataType for f in v.type.fields}
        for have in (name, parts[0] + "".join(p.title() for p in parts[1:])):
            if have in fields:
                return value_of(v.column.getField(have), fields[have])
        if self.strict:
            raise ExpressionError("PROJECTION_FIELD_MISSING", name)
        return _null()

    @staticmethod
    def _alike(a: Value, b: Value) -> tuple[Value, Value, str]:
        if a.kind == b.kind or b.kind == "null":
            return a, b, a.kind
        if a.kind == "null":
            return a, b, b.kind
        if {a.kind, b.kind} == {"long", "double"}:
            return Value(a.column.cast("double"), "double"), Value(b.column.cast("double"), "double"), "double"
        return Value(_string(a), "string"), Value(_string(b), "string"), "string"

    def _unary(self, op: str, v: Value) -> Value:
        if op == "!":
            return Value(~truthy(v), "bool")
        if v.kind not in ("long", "double"):
            return _null()
        if op == "~":
            return Value(F.bitwise_not(_int32(v)).cast("long"), "long")
        return Value(F.try_subtract(F.lit(0), v.column) if op == "-" else v.column, v.kind)

    def _binary(self, op: str, a: Value, b: Value) -> Value:
        if op in ("and", "&&", "or", "||"):
            test = truthy(a)
            if {a.kind, b.kind} == {"long", "double"}:
                a, b, _ = self._alike(a, b)
            if a.kind != b.kind and "null" not in (a.kind, b.kind):
                return Value(test & truthy(b) if op in ("and", "&&") else test | truthy(b), "bool")
            kind = b.kind if a.kind == "null" else a.kind
            yes, no = (b, a) if op in ("and", "&&") else (a, b)
            return Value(F.when(test, yes.column).otherwise(no.column), kind)
        if op in ("==", "!=", "===", "!=="):
            same = a.kind == b.kind or {a.kind, b.kind} == {"long", "double"}
            if a.kind == "null" or b.kind == "null":
                return Value(F.lit(None).cast("boolean"), "bool")
            equal = a.column == b.column if same else F.when(a.column.isNotNull() & b.column.isNotNull(), F.lit(False))
            return Value(~equal if op[0] == "!" else equal, "bool")
        if "null" in (a.kind, b.kind):
            return _null()
        if op in ("<", ">", "<=", ">="):
            if a.kind != b.kind and {a.kind, b.kind} != {"long", "double"}:
                return Value(F.lit(None).cast("boolean"), "bool")
            return Value({"<": a.column < b.column, ">": a.column > b.column, "<=": a.column <= b.column, ">=": a.column >= b.column}[op], "bool")
        if op == "+" and "string" in (a.kind, b.kind):
            return Value(F.concat(_string(a), _string(b)), "string")
        if not {a.kind, b.kind} <= {"long", "double"}:
            return _null()
        if op in ("&", "|", "^"):
            x, y = _int32(a), _int32(b)
            return Value({"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op].cast("long"), "long")
        if op in ("<<", ">>", ">>>"):
            name = {"<<": "shiftleft", ">>": "shiftright", ">>>": "shiftrightunsigned"}[op]
            out = F.call_function(name, _int32(a), _int32(b).bitwiseAND(F.lit(31))).cast("long")
            return Value(out.bitwiseAND(F.lit(0xFFFFFFFF)) if op == ">>>" else out, "long")
        whole = a.kind == b.kind == "long"
        x, y = (a.column, b.column) if whole else (a.column.cast("double"), b.column.cast("double"))
        if op == "/":
            out = F.try_divide(x.cast("double"), y.cast("double"))
            return Value(F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out), "double")
        if op == "%":
            return Value(F.when(y != 0, F.try_mod(x, y)), "long" if whole else "double")
        return Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), "long" if whole else "double")

    def _call(self, name: str, arg: Node) -> Value:
        if name == "_index":
            if arg[0] != "lit" or not isinstance(arg[1], int):
                raise ExpressionError("EXPRESSION_ARITY", "_index takes a number")
            return Value(self.indexes[arg[1]].cast("long"), "long") if arg[1] < len(self.indexes) else _null()
        v = self.lower(arg)
        c = v.column
        if v.kind == "null":
            return _null()
        if name == "enum_str":
            return Value(_string(v), "string")
        if name == "to_i":
            return v if v.kind in ("long", "double") else Value(c.cast("long"), "long") if v.kind == "bool" else Value(c.try_cast("double"), "double") if v.kind == "string" else _null()
        if name == "len":
            size = {"string": lambda: F.length(c) + F.regexp_count(c, F.lit("[\\x{10000}-\\x{10FFFF}]")), "binary": lambda: F.length(c), "array": lambda: F.when(c.isNotNull(), F.size(c))}.get(v.kind)
            return Value(size().cast("long"), "long") if size else self._field(v, "length")
        if name == "u24be":
            return Value(F.when(F.length(c) == 3, F.conv(F.hex(c), 16, 10).cast("long")), "long") if v.kind == "binary" else _null()
        if name == "ip4_str":
            return Value(ip4_str(c), "string") if v.kind == "binary" else _null()
        if name == "ip6_str":
            return Value(ip6_str(c), "string") if v.kind == "binary" else _null()
        return Value(dos_dttm(c), "long") if v.kind == "long" else _null()


def dos_dttm(c: Column) -> Column:
    """Microseconds since 1970 of a DOS date (high half) and time; days past the month's end roll over."""
    part = lambda shift, bits: F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << bits) - 1))
    year, month, day = part(25, 7) + 1980, part(21, 4), part(16, 5)
    ok = (month >= 1) & (month <= 12) & (day >= 1)
    days = F.unix_date(F.make_date(year.cast("int"), F.when(ok, month).otherwise(1).cast("int"), F.lit(1))).cast("long") + day - 1
    seconds = days * 86400 + part(11, 5) * 3600 + part(5, 6) * 60 + part(0, 5) * 2
    return F.when(ok, seconds * 1_000_000)
