"""Condition language compiled to a column when the plan is made: predicates push down, nothing is evaluated row by row in Python.

Grammar: or := and ("||" and)*; and := not ("&&" not)*; not := "!" not | cmp;
cmp := atom (op atom)?; atom := number | string | name | name(args) | (or).
A name that is no field is null; comparing null is false, but for !=.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("==", "!=", "<=", ">=", "<", ">")
ARITY = {"contains": 2, "starts_with": 2, "ends_with": 2, "matches": 2, "upper": 1, "lower": 1, "len": 1, "words": 1, "lines": 1}


class ConditionError(ValueError):
    """The text is no condition."""


def lex(text: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in " \t":
            i += 1
        elif text[i : i + 2] in ("||", "&&", "==", "!=", "<=", ">="):
            out.append(("op", text[i : i + 2]))
            i += 2
        elif c in "<>!(),":
            out.append(("op", c))
            i += 1
        elif c in "\"'":
            j = text.find(c, i + 1)
            if j < 0:
                raise ConditionError("unterminated string")
            out.append(("str", text[i + 1 : j]))
            i = j + 1
        elif c.isascii() and c.isdigit():
            j = i
            while j < n and (text[j].isdigit() or text[j] == "."):
                j += 1
            try:
                out.append(("num", float(text[i:j])))
            except ValueError:
                raise ConditionError(f"bad number {text[i:j]}") from None
            i = j
        elif c.isalpha() or c in "_.":
            j = i
            while j < n and (text[j].isalnum() or text[j] in "_."):
                j += 1
            out.append(("name", text[i:j]))
            i = j
        else:
            raise ConditionError(f"unexpected {c!r}")
    return out


@dataclass
class Value:
    """A typed column: kind is null, bool, number, string, array or object; literal where it is one."""

    kind: str
    col: Column
    literal: object = None
    loose: bool = False


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    return "string" if not isinstance(t, T.NullType) else "null"


class _Compiler:
    def __init__(self, tokens, schema: T.StructType, loose: bool = False):
        # loose: null may stand for false, which a filter takes alike; never under a negation or in an argument
        self.t, self.i, self.schema, self.loose = tokens, 0, schema, loose

    def peek(self):
        return self.t[self.i] if self.i < len(self.t) else (None, None)

    def take(self, op: str) -> bool:
        if self.peek() == ("op", op):
            self.i += 1
            return True
        return False

    def whole(self) -> Column:
        if not self.t:
            raise ConditionError("empty condition")
        v = self.either()
        if self.i < len(self.t):
            raise ConditionError("trailing tokens")
        return truth(v)

    def either(self) -> Value:
        v = self.both()
        while self.take("||"):
            v = Value("bool", truth(v) | truth(self.both()), loose=self.loose)
        return v

    def both(self) -> Value:
        v = self.negated()
        while self.take("&&"):
            v = Value("bool", truth(v) & truth(self.negated()), loose=self.loose)
        return v

    def negated(self) -> Value:
        if self.take("!"):
            loose, self.loose = self.loose, False
            v = Value("bool", ~truth(self.negated()))
            self.loose = loose
            return v
        return self.compared()

    def compared(self) -> Value:
        a = self.atom()
        for op in OPS:
            if self.take(op):
                return Value("bool", compare(op, a, self.atom(), self.loose), loose=self.loose)
        return a

    def atom(self) -> Value:
        kind, v = self.peek()
        if kind is None:
            raise ConditionError("unexpected end")
        self.i += 1
        if kind == "num":
            return Value("number", F.lit(v), v)
        if kind == "str":
            return Value("string", F.lit(v), v)
        if (kind, v) == ("op", "("):
            out = self.either()
            if not self.take(")"):
                raise ConditionError("missing )")
            return out
        if kind == "name":
            if self.take("("):
                args = []
                loose, self.loose = self.loose, False
                if not self.take(")"):
                    while True:
                        args.append(self.either())
                        if self.take(")"):
                            break
                        if not self.take(","):
                            raise ConditionError("missing , or )")
                self.loose = loose
                return call(v, args)
            if v in ("true", "false"):
                return Value("bool", F.lit(v == "true"), v == "true")
            if v == "null":
                return Value("null", F.lit(None).cast("string"))
            return self.field(v)
        raise ConditionError(f"unexpected {v}")

    def field(self, name: str) -> Value:
        t: T.DataType = self.schema
        c = None
        for part in name.split("."):
            if isinstance(t, T.StructType) and part in t.names:
                c = F.col(f"`{part}`") if c is None else c[part]
                t = t[part].dataType
            elif isinstance(t, T.MapType):
                c, t = F.try_element_at(c, F.lit(part)), t.valueType
            else:
                return Value("null", F.lit(None).cast("string"))
        return Value(_kind(t), c)


def string(v: Value) -> Column:
    if v.kind == "null":
        return F.lit("")
    if v.kind == "number":
        whole = v.col.cast("double")
        return F.coalesce(F.when((whole == F.floor(whole)) & (F.abs(whole) < 1e15), whole.cast("long").cast("string")).otherwise(v.col.cast("string")), F.lit(""))
    if v.kind in ("array", "object"):
        return F.coalesce(F.to_json(v.col), F.lit(""))
    return F.coalesce(v.col.cast("string"), F.lit(""))


def truth(v: Value) -> Column:
    """null, 0, "" and [] are false, objects true."""
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "bool":
        return v.col if v.loose else F.coalesce(v.col, F.lit(False))
    if v.kind == "number":
        return F.coalesce(v.col != 0, F.lit(False))
    if v.kind == "string":
        return F.coalesce(v.col != "", F.lit(False))
    if v.kind == "array":
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def _number(v: Value) -> Column:
    """Whole literals stay whole, so that a comparison with a field needs no cast and reaches the scan."""
    return F.lit(int(v.literal)) if isinstance(v.literal, float) and v.literal.is_integer() and abs(v.literal) < 2**31 else v.col


def compare(op: str, a: Value, b: Value, loose: bool = False) -> Column:
    if a.kind == b.kind and a.kind in ("number", "string", "bool"):
        x, y = (_number(a), _number(b)) if a.kind == "number" else (a.col, b.col)
        if op == "==":
            return x == y if loose and (a.literal is not None or b.literal is not None) else x.eqNullSafe(y)
        if op == "!=":
            return ~x.eqNullSafe(y)
        test = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        return test if loose else F.coalesce(test, F.lit(False))
    both_null = (a.col.isNull() & b.col.isNull()) if "null" in (a.kind, b.kind) else F.lit(False)
    return both_null if op == "==" else ~both_null if op == "!=" else F.lit(False)


def call(name: str, args: list[Value]) -> Value:
    import re

    if name not in ARITY:
        raise ConditionError(f"unknown function {name}")
    if len(args) < ARITY[name]:
        raise ConditionError(f"{name}: missing argument")
    a = args[0]
    if name == "contains":
        return Value("bool", string(a).contains(string(args[1])))
    if name == "starts_with":
        return Value("bool", string(a).startswith(string(args[1])))
    if name == "ends_with":
        return Value("bool", string(a).endswith(string(args[1])))
    if name == "matches":
        tests = []
        for p, s in ((a, args[1]), (args[1], a)):
            if p.literal is not None:
                try:
                    re.compile(str(p.literal))
                    tests.append(string(s).rlike(str(p.literal) if p.kind == "string" else f"{p.literal:g}"))
                except re.error:
                    pass
        if a.literal is None and args[1].literal is None:
            tests = [F.regexp(string(a), string(args[1])), F.regexp(string(args[1]), string(a))]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return Value("bool", out)
    if name in ("upper", "lower"):
        return Value("string", getattr(F, name)(string(a)))
    if name == "len":
        if a.kind == "string":
            return Value("number", F.coalesce(F.octet_length(a.col), F.lit(0)))
        if a.kind in ("array", "object"):
            return Value("number", F.coalesce(F.size(a.col), F.lit(0)) if a.kind == "array" else F.lit(0))
        return Value("number", F.lit(0))
    from .extract import lines, words

    return Value("number", words(string(a)) if name == "words" else lines(string(a)))


def compile_condition(text: str, schema: T.StructType) -> Column:
    """The condition as a boolean column over rows of the schema; ConditionError if the text is none."""
    return _Compiler(lex(text), schema).whole()


def compile_filter(text: str, schema: T.StructType) -> Column:
    """The condition for where(): the same rows, but comparisons are left plain, so that they reach the scan."""
    return _Compiler(lex(text), schema, loose=True).whole()
