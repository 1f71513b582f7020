"""Selections and labels in dataframe-query style, compiled to Spark SQL; and composition predicates.

Both are parsed here and never evaluated as Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(`[^`]+`)|(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|('[^']*'|\"[^\"]*\")|(\*\*|//|==|!=|<=|>=|&&|\|\||[-+*/%<>=()\[\],!&|~#.])|([A-Za-z_][A-Za-z_0-9]*))")
# Fixed value: how calculated count columns are named.
COUNT_COLUMN = re.compile(r"\bn_atoms\b|\bn_[A-Z][a-z]?\b")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        at = m.end()
        kind = ("quoted", "number", "string", "op", "name")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
    return out


def select_mode(select: str | None) -> str:
    """What a selection needs: nothing, stored columns, or counts that are calculated from geometries."""
    if not select or not select.strip():
        return "none"
    return "calculated" if COUNT_COLUMN.search(select) else "native"


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.text = _tokens(text), 0, text

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *values: str) -> str | None:
        now = self.peek()
        if now is not None and (now in values or now.lower() in values):
            self.at += 1
            return now.lower()
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ValueError(f"expected {value!r} at {self.at} of {self.text!r}")


class _Table(_Parser):
    """Query and arithmetic expressions over columns; gives SQL text."""

    def parse(self) -> str:
        out = self.disjunction()
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()!r} in {self.text!r}")
        return out

    def disjunction(self) -> str:
        out = self.conjunction()
        while self.take("or", "|", "||"):
            out = f"({out} OR {self.conjunction()})"
        return out

    def conjunction(self) -> str:
        out = self.negation()
        while self.take("and", "&", "&&"):
            out = f"({out} AND {self.negation()})"
        return out

    def negation(self) -> str:
        return f"(NOT {self.negation()})" if self.take("not", "~", "!") else self.comparison()

    def comparison(self) -> str:
        left, parts = self.sum(), []
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">", "="):
                right = self.sum()
                sql = {"==": "=", "!=": "<>"}.get(op, op)
                # a missing or not-a-number side compares as false, but as different
                missing = "true" if sql == "<>" else "false"
                parts.append(f"coalesce(nullif({left}, double('NaN')) {sql} nullif({right}, double('NaN')), {missing})" if not self._text(left, right) else f"coalesce({left} {sql} {right}, {missing})")
                left = right
            elif self.peek() in ("in", "not") and (negated := self.take("in", "not")):
                if negated == "not":
                    self.need("in")
                self.need("[")
                values = [self.sum()]
                while self.take(","):
                    values.append(self.sum())
                self.need("]")
                parts.append(f"coalesce({left} {'NOT IN' if negated == 'not' else 'IN'} ({', '.join(values)}), {'true' if negated == 'not' else 'false'})")
            else:
                break
        return left if not parts else parts[0] if len(parts) == 1 else "(" + " AND ".join(parts) + ")"

    @staticmethod
    def _text(*sides: str) -> bool:
        return any(side.startswith("'") for side in sides)

    def sum(self) -> str:
        out = self.product()
        while op := self.take("+", "-"):
            out = f"({out} {op} {self.product()})"
        return out

    def product(self) -> str:
        out = self.sign()
        while op := self.take("*", "/", "//", "%"):
            right = self.sign()
            out = {"/": f"try_divide({out}, {right})", "//": f"floor(try_divide({out}, {right}))", "%": f"pmod({out}, {right})"}.get(op, f"({out} {op} {right})")
        return out

    def sign(self) -> str:
        if op := self.take("-", "+"):
            return f"({op}{self.sign()})"
        return self.power()

    def power(self) -> str:
        base = self.atom()
        return f"power({base}, {self.sign()})" if self.take("**") else base

    def atom(self) -> str:
        if self.take("("):
            out = self.disjunction()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise ValueError(f"{self.text!r} ends too early")
        kind, value = self.tokens[self.at]
        if kind == "op" or value.lower() in ("and", "or", "not", "in"):
            raise ValueError(f"unexpected {value!r} in {self.text!r}")
        self.at += 1
        if kind == "name":
            if value in ("True", "False"):
                return value.lower()
            return f"`{value}`"
        if kind == "string":
            return "'" + value[1:-1].replace("\\", "\\\\").replace("'", "\\'") + "'"
        return value if kind == "quoted" else f"{value}D"


def to_sql(text: str) -> str:
    """A selection or label as Spark SQL.

    Comparisons with null or NaN are false, != is true, as in a dataframe query; division by zero gives null.
    """
    return _Table(text).parse()


def select_column(text: str) -> Column:
    """A selection or label as a column."""
    return F.expr(to_sql(text))


# --- composition predicates -------------------------------------------------------------------------------------


class _Composition(_Parser):
    """Predicates over element counts: + and -, comparisons, not / and / or; # is the number of atoms."""

    def parse(self):
        if not self.tokens:
            return None
        out = self.disjunction()
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()!r} in {self.text!r}")
        return out

    def disjunction(self):
        out = self.conjunction()
        while self.take("or", "|"):
            out = ("or", out, self.conjunction())
        return out

    def conjunction(self):
        out = self.negation()
        while self.take("and", "&"):
            out = ("and", out, self.negation())
        return out

    def negation(self):
        if self.take("not", "!"):
            return ("not", self.negation())
        mark = self.at
        if self.take("("):  # a group of conditions, or of a sum
            try:
                out = self.disjunction()
                self.need(")")
                if self.peek() not in ("+", "-", "<", ">", "=", "<=", ">=", "!="):
                    return out
            except ValueError:
                pass
            self.at = mark
        return self.comparison()

    def comparison(self):
        left = self.sum()
        op = self.take("<=", ">=", "!=", "<", ">", "=")
        if not op:
            raise ValueError(f"{self.text!r} needs a comparison")
        return ("compare", op, left, self.sum())

    def sum(self):
        out = self.term()
        while op := self.take("+", "-"):
            out = (op, out, self.term())
        return out

    def term(self):
        if self.take("("):
            out = self.sum()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise ValueError(f"{self.text!r} ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number" and value.isdigit():
            return ("number", int(value))
        if value == "#":
            return ("atoms",)
        if kind == "name" and value.isalpha() and value.lower() not in ("and", "or", "not"):
            return ("element", value)
        raise ValueError(f"unexpected {value!r} in {self.text!r}")


class Composition:
    """A predicate over the element counts of a molecule, e.g. ``C + N < 3 & H > 0 | # = 7``. Empty selects everything."""

    def __init__(self, text: str = ""):
        self.tree = _Composition(text).parse()

    def column(self, counts: Column, atoms: Column | None = None) -> Column:
        """As a column over a map of element counts; elements that are not in it count 0."""
        atoms = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x) if atoms is None else atoms

        def build(node):
            kind = node[0]
            if kind == "number":
                return F.lit(node[1])
            if kind == "atoms":
                return atoms
            if kind == "element":
                return F.coalesce(F.try_element_at(counts, F.lit(node[1])), F.lit(0))
            if kind == "not":
                return ~build(node[1])
            if kind == "compare":
                a, b = build(node[2]), build(node[3])
                return {"<": a < b, ">": a > b, "=": a == b, "<=": a <= b, ">=": a >= b, "!=": a != b}[node[1]]
            a, b = build(node[1]), build(node[2])
            return {"+": lambda: a + b, "-": lambda: a - b, "and": lambda: a & b, "or": lambda: a | b}[kind]()

        return F.lit(True) if self.tree is None else build(self.tree)


def all_of(conditions) -> Column:
    """The conjunction of columns; true if there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
