"""Formulas: one tree with a parser, a printer, a few rewrites, and compilers to Column and numpy."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import safe

CONSTANTS = {"pi": math.pi, "e": math.e}
FUNCTIONS = ("sin", "cos", "tan", "exp", "log", "ln", "sqrt", "abs", "sinh", "cosh", "tanh", "asin", "acos", "atan", "sign")
#: Spellings that mean the same.
SPELLINGS = {"−": "-", "–": "-", "·": "*", "×": "*", "÷": "/", "π": "pi", "√": "sqrt", "²": "^2", "³": "^3", "⁴": "^4", "ω": "omega", "φ": "phi", "**": "^", "arcsin": "asin", "arccos": "acos", "arctan": "atan"}
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(.))")


@dataclass(frozen=True)
class Node:
    """op: 'num', 'var', '+', '*', '/', '^', 'neg', or a function's name."""

    op: str
    args: tuple = ()
    value: float | str | None = None

    def __str__(self) -> str:
        return show(self)


def num(v: float) -> Node:
    return Node("num", value=float(v))


def var(name: str) -> Node:
    return Node("var", value=name)


def normalised(text: str) -> str:
    for a, b in SPELLINGS.items():
        text = text.replace(a, b)
    return text.strip()


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        for m in TOKEN.finditer(normalised(text)):
            kind = "num" if m[1] else "name" if m[2] else "op"
            if (t := m[1] or m[2] or m[3]).strip():
                self.tokens.append((kind, t))
        self.i = 0
        self.bars = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, what: str | None = None) -> str:
        kind, t = self.peek()
        if kind == "end" or what is not None and t != what:
            raise ValueError(f"expected {what or 'more'} at token {self.i}")
        self.i += 1
        return t

    def sum(self) -> Node:
        out = self.product()
        while self.peek()[1] in ("+", "-") and self.peek()[0] == "op":
            sign = self.take()
            right = self.product()
            out = Node("+", (out, right if sign == "+" else Node("neg", (right,))))
        return out

    def product(self) -> Node:
        out = self.unary()
        while True:
            kind, t = self.peek()
            if kind == "op" and t in "*/":
                self.take()
                out = Node(t, (out, self.unary()))
            elif kind in ("num", "name") or kind == "op" and (t == "(" or t == "|" and not self.bars):
                out = Node("*", (out, self.power()))  # implicit product
            else:
                return out

    def unary(self) -> Node:
        if self.peek() == ("op", "-"):
            self.take()
            return Node("neg", (self.unary(),))
        if self.peek() == ("op", "+"):
            self.take()
            return self.unary()
        return self.power()

    def power(self) -> Node:
        base = self.atom()
        if self.peek() == ("op", "^"):
            self.take()
            return Node("^", (base, self.unary()))
        return base

    def atom(self) -> Node:
        kind, t = self.peek()
        if kind == "num":
            return num(float(self.take()))
        if kind == "name":
            self.take()
            if t in FUNCTIONS and self.peek() == ("op", "("):
                self.take("(")
                held, self.bars = self.bars, 0
                arg = self.sum()
                self.bars = held
                self.take(")")
                return Node("log" if t == "ln" else t, (arg,))
            return num(CONSTANTS[t]) if t in CONSTANTS else var(t)
        if t == "(":
            self.take()
            held, self.bars = self.bars, 0
            out = self.sum()
            self.bars = held
            self.take(")")
            return out
        if t == "|":
            self.take()
            self.bars += 1
            out = self.sum()
            self.bars -= 1
            self.take("|")
            return Node("abs", (out,))
        raise ValueError(f"unexpected {t or 'end'}")


def parse(text: str) -> Node:
    """The tree of a formula; ValueError if it isn't one. Text is never evaluated as code."""
    p = _Parser(text)
    out = p.sum()
    if p.peek()[0] != "end":
        raise ValueError(f"unexpected {p.peek()[1]}")
    return out


def show(n: Node, digits: int = 6) -> str:
    level = {"+": 1, "neg": 1, "*": 2, "/": 2, "^": 3}

    def of(x: Node, above: int) -> str:
        if x.op == "num":
            v = x.value
            text = f"{v:.0f}" if v == int(v) and abs(v) < 1e15 else f"{v:.{digits}g}"
            return f"({text})" if v < 0 and above > 1 else text
        if x.op == "var":
            return x.value
        if x.op not in level:
            return f"{x.op}({of(x.args[0], 0)})"
        k = level[x.op]
        if x.op == "neg":
            text = "-" + of(x.args[0], 2)
        elif x.op == "+":
            a, b = x.args
            text = f"{of(a, 1)} - {of(b.args[0], 2)}" if b.op == "neg" else f"{of(a, 1)} + {of(b, 1)}"
        elif x.op == "^":
            text = f"{of(x.args[0], 4)}^{of(x.args[1], 4)}"
        else:
            text = f"{of(x.args[0], 2)}{x.op}{of(x.args[1], 3)}"
        return f"({text})" if k < above else text

    return of(n, 0)


def to_column(n: Node, columns: dict[str, Column], strict: bool = False) -> Column:
    """strict: null where the value, or a logarithm or quotient on the way to it, is undefined or not finite; otherwise
    guarded steps, and 0 for what stays undefined. Steps use each argument once (a check of each would copy it, and
    nested copies multiply); the one check stands at the top."""
    v = _column(n, columns, strict)
    ok = safe.is_finite(v)
    return F.when(ok, v) if strict else F.when(ok, v).otherwise(F.lit(0.0))


def _column(n: Node, columns: dict[str, Column], strict: bool) -> Column:
    if n.op == "num":
        return F.lit(n.value)
    if n.op == "var":
        return columns[n.value].cast("double")
    a = [_column(x, columns, strict) for x in n.args]
    steps = {
        "+": lambda x, y: x + y, "*": lambda x, y: x * y, "neg": lambda x: -x, "sin": F.sin, "cos": F.cos, "tan": F.tan, "abs": F.abs,
        "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sign": F.signum,
        "exp": lambda x: F.exp(x if strict else F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))),
        "log": lambda x: F.ln(x) if strict else F.ln(F.abs(x) + F.lit(1e-300)),
        "sqrt": lambda x: F.sqrt(x if strict else F.greatest(x, F.lit(0.0))),
        "/": F.try_divide, "^": F.pow,
    }
    return steps[n.op](*a)


def to_numpy(n: Node, columns: dict[str, np.ndarray]) -> np.ndarray:
    """Values with NaN where undefined."""
    if n.op == "num":
        return np.float64(n.value)
    if n.op == "var":
        return columns[n.value]
    a = [to_numpy(x, columns) for x in n.args]
    with np.errstate(all="ignore"):
        f = {"+": np.add, "*": np.multiply, "/": np.divide, "^": np.power, "neg": np.negative, "log": np.log, "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan, "abs": np.abs}.get(n.op) or getattr(np, n.op)
        v = f(*a)
    return np.where(np.isfinite(v), v, np.nan)


def size(n: Node) -> int:
    return 1 + sum(map(size, n.args))


def snapped(n: Node, tol: float = 0.05, zero: float = 1e-4) -> Node:
    """Numbers near whole ones (or 0) become them."""
    if n.op == "num":
        v = n.value
        return num(0.0) if abs(v) <= zero else num(float(np.rint(v))) if abs(v - np.rint(v)) <= tol and np.rint(v) else n
    return Node(n.op, tuple(snapped(a, tol, zero) for a in n.args), n.value)


def _terms(n: Node) -> list[tuple[float, Node]]:
    """A sum as (factor, rest); rest is 1 for plain numbers."""
    if n.op == "+":
        return _terms(n.args[0]) + _terms(n.args[1])
    if n.op == "neg":
        return [(-c, r) for c, r in _terms(n.args[0])]
    c, f = _factors(n)
    return [(c, _product(f))]


def _factors(n: Node) -> tuple[float, list[Node]]:
    if n.op == "num":
        return n.value, []
    if n.op == "neg":
        c, f = _factors(n.args[0])
        return -c, f
    if n.op == "*":
        a, b = _factors(n.args[0]), _factors(n.args[1])
        return a[0] * b[0], a[1] + b[1]
    if n.op == "/" and n.args[1].op == "num" and n.args[1].value:
        c, f = _factors(n.args[0])
        return c / n.args[1].value, f
    return 1.0, [n]


def _product(f: list[Node]) -> Node:
    powers: dict[Node, float] = {}
    other: list[Node] = []
    for x in f:
        base, p = (x.args[0], x.args[1].value) if x.op == "^" and x.args[1].op == "num" else (x, 1.0)
        if base.op == "num":
            other.append(x)
        else:
            powers[base] = powers.get(base, 0.0) + p
    parts = [b if p == 1 else Node("^", (b, num(p))) for b, p in sorted(powers.items(), key=lambda i: show(i[0])) if p] + other
    out = None
    for x in parts:
        out = x if out is None else Node("*", (out, x))
    return out if out is not None else num(1)


def simplified(n: Node) -> Node:
    """Folded constants, gathered like terms and powers, sin^2 + cos^2 = 1, and the angle-sum and double-angle rules, until
    nothing changes."""
    for _ in range(20):
        m = _once(n)
        if m == n:
            break
        n = m
    return n


def _once(n: Node) -> Node:
    a = tuple(_once(x) for x in n.args)
    n = Node(n.op, a, n.value)
    if a and all(x.op == "num" for x in a):
        v = float(to_numpy(n, {}))
        if np.isfinite(v):
            return num(v)
    if n.op == "^" and a[1].op == "num":
        if a[1].value == 1:
            return a[0]
        if a[1].value == 0:
            return num(1)
    if n.op == "/":
        if a[1].op == "num" and a[1].value:
            return Node("*", (num(1 / a[1].value), a[0]))
        if a[0] == a[1]:
            return num(1)
    if n.op not in ("+", "*", "neg"):
        return n
    terms: dict[Node, float] = {}
    for c, r in _terms(n):
        terms[r] = terms.get(r, 0.0) + c
    two = num(2)
    for r in list(terms):  # c*sin(u)^2 + c*cos(u)^2
        if r.op == "^" and r.args[1] == two and r.args[0].op == "sin":
            other = Node("^", (Node("cos", r.args[0].args), two))
            if other in terms and terms.get(r) and abs(terms[other] - terms[r]) < 1e-12:
                c = terms.pop(r)
                terms.pop(other)
                terms[num(1)] = terms.get(num(1), 0.0) + c
    for r in list(terms):  # sin(u)cos(v) + cos(u)sin(v), and 2 sin(u)cos(u)
        _, f = _factors(r)
        if r in terms and len(f) == 2 and {f[0].op, f[1].op} == {"sin", "cos"}:
            s, c = (f[0], f[1]) if f[0].op == "sin" else (f[1], f[0])
            u, v = s.args[0], c.args[0]
            k = terms[r]
            if u == v:
                del terms[r]
                w = Node("sin", (_once(Node("*", (two, u))),))
                terms[w] = terms.get(w, 0.0) + k / 2
            else:
                other = _product([Node("sin", (v,)), Node("cos", (u,))])
                if other in terms and abs(terms[other] - k) < 1e-12:
                    del terms[r], terms[other]
                    w = Node("sin", (_once(Node("+", tuple(sorted((u, v), key=show)))),))
                    terms[w] = terms.get(w, 0.0) + k
    out = None
    for r, c in sorted(terms.items(), key=lambda i: (i[0].op == "num", -size(i[0]), show(i[0]))):
        if abs(c) < 1e-12:
            continue
        sign, c = c < 0, abs(c)
        t = num(c * r.value) if r.op == "num" else r if c == 1 else Node("*", (num(c), r))
        if out is None:
            out = Node("neg", (t,)) if sign and t.op != "num" else num(-t.value) if sign else t
        else:
            out = Node("+", (out, Node("neg", (t,)) if sign else t))
    return out if out is not None else num(0)


def variables(n: Node) -> set[str]:
    return {n.value} if n.op == "var" else set().union(*map(variables, n.args)) if n.args else set()


def linear(n: Node) -> float | None:
    """The slope of a * x + b over one variable, if n is of that form."""
    slope = 0.0
    for c, rest in _terms(n):
        if rest.op == "var":
            slope += c
        elif variables(rest):
            return None
    return slope


def one_tone(n: Node, least: float = 0.9, most: float = 0.08) -> Node:
    """A sum over one variable with only its strongest frequency of sines and cosines, if that has `least` of all their
    amplitudes and the others `most` of its own; else n itself. Terms of other kinds stay."""
    if len(variables(n)) != 1:
        return n
    tones: dict[float, list[tuple[float, Node]]] = {}
    others = []
    for c, rest in _terms(n):
        w = abs(linear(rest.args[0]) or 0.0) if rest.op in ("sin", "cos") else 0.0
        if w > 1e-12 and np.isfinite(c) and c:
            tones.setdefault(round(w, 4), []).append((c, rest))
        else:
            others.append((c, rest))
    if not tones:
        return n
    power = {w: sum(abs(c) for c, _ in t) for w, t in tones.items()}
    top = max(power, key=power.get)
    left = sum(power.values()) - power[top]
    if power[top] < least * (power[top] + left) or left > max(most * power[top], 1e-12):
        return n
    out = None
    for c, rest in others + tones[top]:
        t = Node("*", (num(c), rest))
        out = t if out is None else Node("+", (out, t))
    return simplified(out)


#: The classes of a formula's operators, in order.
CLASSES = ("identity", "sin", "cos", "power", "exp", "log", "addition", "multiplication", "rational", "const_pi", "const_e", "const_1", "const_2", "const_half")
#: Functions and what they are made of.
MADE_OF = {"sin": {"sin"}, "cos": {"cos"}, "exp": {"exp"}, "log": {"log"}, "ln": {"log"}, "sqrt": {"power"}, "sinh": {"exp", "addition"}, "cosh": {"exp", "addition"}, "tanh": {"exp", "rational"}, "+": {"addition"}, "*": {"multiplication"}, "^": {"power"}}


def classes(n: Node) -> set[str]:
    """Classes of the operators in a formula. A quotient is rational if its denominator holds a variable; one by a
    constant is a multiplication."""
    out = {"identity"} if n.op == "var" else set(MADE_OF.get(n.op, ()))
    if n.op == "/":
        out.add("rational" if variables(n.args[1]) else "multiplication")
    return out.union(*map(classes, n.args)) if n.args else out


def canonical(text: str) -> str | None:
    """One spelling for formulas that simplify to the same; null for what does not parse."""
    try:
        return show(simplified(parse(text)))
    except (ValueError, ZeroDivisionError, OverflowError):
        return None
