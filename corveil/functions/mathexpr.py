"""Mathematical equality of answers: LaTeX or plain expressions parsed by precedence climbing into trees, compared by value.

Rational values are exact. Everything else is compared numerically, expressions with variables at fixed points. Lists
without brackets and sets have no order; tuples and intervals have, and their brackets count.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from corveil.functions import text as T

#: Numbers that are no rationals, or are written as decimals, are equal if they agree in so many decimals.
DECIMALS = 6
#: Powers and factorials are exact up to about so many bits; beyond, values are floating-point numbers.
BITS = 100_000
#: Where expressions with variables are compared: variable k takes every point in turn, shifted by k.
POINTS = (0.8142, 1.7321, -0.6137, 2.4183, -1.9154, 3.3719, 0.2741)
#: Commands and signs with one meaning.
SIGNS = {"−": "-", "–": "-", "×": "*", "·": "*", "⋅": "*", "÷": "/", "π": "\\pi ", "∞": "\\infty ", "√": "\\sqrt ", "≤": "\\le ", "≥": "\\ge ", "≠": "\\ne ", "∪": "\\cup ", "±": "\\pm ", "°": "", "²": "^2", "³": "^3", "½": "\\frac{1}{2}"}
PLAIN = {"\\cdot": "*", "\\times": "*", "\\ast": "*", "\\div": "/", "\\leq": "\\le", "\\leqslant": "\\le", "\\geq": "\\ge", "\\geqslant": "\\ge", "\\neq": "\\ne", "\\lt": "<", "\\gt": ">", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cfrac": "\\frac", "\\lbrace": "\\{", "\\rbrace": "\\}", "\\vert": "|", "\\mid": "|", "\\lvert": "|", "\\rvert": "|", "**": "^"}
DROPPED = ("\\left", "\\right", "\\bigl", "\\bigr", "\\Bigl", "\\Bigr", "\\big", "\\Big", "\\displaystyle", "\\limits", "\\!", "\\,", "\\;", "\\:", "\\ ", "\\quad", "\\qquad", "$", "\\$", "\\(", "\\)", "\\[", "\\]", "~")
DROP = [(d, re.compile(re.escape(d) + ("(?![A-Za-z])" if d[-1].isalpha() else ""))) for d in DROPPED]
FUNCTIONS: dict[str, Callable[[complex], complex]] = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x),
    "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "asin": cmath.asin, "acos": cmath.acos, "atan": cmath.atan,
    "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "exp": cmath.exp, "ln": cmath.log, "log": cmath.log, "lg": cmath.log10, "sqrt": cmath.sqrt, "abs": abs,
    "floor": lambda x: math.floor(x.real), "ceil": lambda x: math.ceil(x.real),
}
INVERSE = {"sin": "arcsin", "cos": "arccos", "tan": "arctan"}
RELATIONS = {"=": "=", "<": "<", ">": ">", "\\le": "<=", "\\ge": ">=", "\\ne": "!="}
GREEK = "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Sigma Phi Psi Omega".split()

TOKEN = re.compile(r"\s*(?:(\d{1,3}(?:\{?,\}?\d{3})+(?![\d])(?:\.\d+)?|\d+\.?\d*|\.\d+)|(\\[A-Za-z]+|\\[{}%|])|([A-Za-z]+)|(<=|>=|!=|\*\*|.))", re.S)


class Unread(ValueError):
    """A text that is no expression."""


class Node(NamedTuple):
    """A tree: its kind and its parts. num: a Fraction and whether it is written as a decimal; var, const: a name; call: a function and an argument; list: brackets and members."""
    kind: str
    parts: tuple


def num(x: int | Fraction, decimal: bool = False) -> Node:
    return Node("num", (Fraction(x), decimal))


def call(name: str, *args: Node) -> Node:
    return Node(name, args)


def plain(text: str) -> str:
    """Without what has no meaning for the value: signs of size and space, mode switches, units and degrees."""
    if not text.isascii():
        for a, b in SIGNS.items():
            text = text.replace(a, b)
    for d, pattern in DROP:
        if d in text:
            text = pattern.sub(" ", text)
    if "\\" not in text:
        return text.strip().rstrip(".,;:").strip()
    text = re.sub(r"\^\s*\{?\s*\\(circ|degree)\s*\}?|\\(circ|degree)(?![A-Za-z])", "", text)
    text = re.sub(r"\\(?:text|mathrm|textbf|mathbf|textit|operatorname|mbox|mathit)\s*\{\s*(sin|cos|tan|log|ln|exp|or|and)\s*\}", lambda m: ", " if m[1] in ("or", "and") else f"\\{m[1]} ", text)
    if not re.search(r"\d", text):
        text = re.sub(r"\\(?:text|mathrm|textbf|mathbf|textit|mbox)\s*\{\s*([A-Za-z])\s*\}", r" \1 ", text)
    else:  # a unit behind a value
        text = re.sub(r"\\(?:text|mathrm|textbf|mathbf|textit|mbox)\s*\{[^{}]*\}(?:\s*\^\s*\{?\d\}?)?", " ", text)
    return text.strip().rstrip(".,;:").strip()


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, token): number, command, name (one letter or a function's name) or sign."""
    out, end, text = [], 0, plain(text)
    worded = not re.search(r"[\d\\^_=+*/<>|-]", text)
    while end < len(text):
        m = TOKEN.match(text, end)
        if not m or m.end() == end:
            break
        end = m.end()
        number, command, letters, sign = m.groups()
        if number:
            # 1,000 in brackets or in a list of other numbers is no thousand.
            parts = number.replace("{", "").replace("}", "").split(",")
            listed = len(parts) > 1 and "{" not in number and (re.search(r"[(\[{]", text[: m.start()]) or re.search(r"\d\s*,\s*(?!\d{3}(?!\d))\S|,\s*\d{3}(?!\d)\s*,\s+", text))
            for k, part in enumerate(parts if listed else ["".join(parts)]):
                out += [("sign", ",")] * (k > 0) + [("number", part)]
        elif command:
            out.append(("sign", c) if (c := PLAIN.get(command, command)) in ("*", "/", "<", ">", "|") else ("command", c))
        elif letters:
            if letters in FUNCTIONS:
                out.append(("command", f"\\{letters}"))
            elif letters in ("pi", "infty", "inf", "infinity", "oo"):
                out.append(("command", "\\pi" if letters == "pi" else "\\infty"))
            elif len(letters) > 1 and (worded or len(letters) > 3):
                raise Unread("words")
            else:
                out += [("name", c) for c in letters]
        elif sign.strip():
            out.append({"<=": ("command", "\\le"), ">=": ("command", "\\ge"), "!=": ("command", "\\ne"), "**": ("sign", "^")}.get(sign, ("sign", sign)))
    return out


class Parser:
    """Precedence climbing over tokens: lists, relations, unions, sums, products, powers."""

    def __init__(self, found: list[tuple[str, str]]):
        self.found, self.at, self.bars = found, 0, 0

    def peek(self) -> tuple[str, str]:
        return self.found[self.at] if self.at < len(self.found) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if kind == "end" or value is not None and got != value:
            raise Unread(f"{value!r} expected, not {got!r}")
        self.at += 1
        return got

    def whole(self) -> Node:
        tree = self.members("")
        if self.peek()[0] != "end":
            raise Unread(f"{self.peek()[1]!r} is left")
        return tree

    def members(self, opened: str) -> Node:
        """One expression, or a list of them between commas."""
        first = self.relation()
        if self.peek()[1] not in (",", ";"):
            return first if not opened else Node("list", (opened, first))
        parts = [first]
        while self.peek()[1] in (",", ";"):
            self.take()
            if self.peek()[0] == "end":
                break
            parts.append(self.relation())
        return Node("list", (opened or "{", *parts))

    def relation(self) -> Node:
        parts, kinds = [self.union()], []
        while self.peek()[1] in RELATIONS:
            kinds.append(RELATIONS[self.take()])
            parts.append(self.union())
        if not kinds:
            return parts[0]
        return Node("relation", (tuple(kinds), *parts))

    def union(self) -> Node:
        parts = [self.expression(0)]
        while self.peek()[1] == "\\cup":
            self.take()
            parts.append(self.expression(0))
        return parts[0] if len(parts) == 1 else Node("union", tuple(parts))

    #: Binary signs with their strength; implicit products bind as strongly as explicit ones.
    STRENGTH = {"+": 1, "-": 1, "\\pm": 1, "*": 2, "/": 2}

    def expression(self, least: int) -> Node:
        if self.peek()[1] in ("+", "-", "\\pm"):
            sign = self.take()
            left = self.expression(2)
            left = left if sign == "+" else call("neg", left) if sign == "-" else call("pm", num(0), left)
        else:
            left = self.power()
        while True:
            kind, got = self.peek()
            strength = self.STRENGTH.get(got, 2 if self.factor_next() else 0)
            if not strength or strength < max(least, 1):
                return left
            if got in self.STRENGTH:
                self.take()
                right = self.expression(strength + 1)
                left = call({"+": "add", "-": "sub", "*": "mul", "/": "div", "\\pm": "pm"}[got], left, right)
            else:
                left = self.beside(left)

    def factor_next(self) -> bool:
        kind, got = self.peek()
        return kind in ("number", "name") or kind == "command" and (got[1:] in FUNCTIONS or got[1:] in GREEK or got in ("\\frac", "\\pi", "\\infty", "\\binom", "\\{", "\\lfloor", "\\lceil")) or got in ("(", "{") or got == "|" and not self.bars

    def beside(self, left: Node) -> Node:
        """A factor without a sign: a mixed number if a whole number stands before a fraction of numbers, else a product."""
        if left.kind == "num" and left.parts[0].denominator == 1 and not left.parts[1]:
            at = self.at
            if self.peek()[1] == "\\frac" or self.peek()[0] == "number":
                right = self.power()
                if right.kind == "num" and self.peek()[1] == "/":
                    self.take()
                    right = call("div", right, self.power())
                if right.kind == "div" and all(p.kind == "num" for p in right.parts):
                    return call("add", left, right)
                if right.kind == "num":
                    raise Unread("two numbers side by side")
                self.at = at
        return call("mul", left, self.power())

    def power(self) -> Node:
        base = self.after(self.atom())
        if self.peek()[1] == "^":
            self.take()
            exponent = call("neg", self.power()) if self.peek()[1] == "-" and self.take() else self.power()
            return self.after(call("pow", base, exponent))
        return base

    def after(self, x: Node) -> Node:
        """Signs behind a value: factorial and per cent."""
        while self.peek()[1] in ("!", "%", "\\%"):
            x = call("factorial" if self.take() == "!" else "percent", x)
        return x

    def group(self) -> Node:
        """The content of braces, or the one token that a command takes."""
        if self.peek()[1] == "{":
            self.take()
            x = self.members("")
            self.take("}")
            return x
        kind, got = self.peek()
        if kind == "number" and len(got) > 1 and "." not in got:
            # \frac12: one digit each.
            self.found[self.at] = ("number", got[1:])
            return num(int(got[0]))
        return self.atom()

    def atom(self) -> Node:
        kind, got = self.peek()
        if kind == "number":
            self.take()
            return num(int(got)) if got.isdecimal() else num(Fraction(got.rstrip(".") or "0"), "." in got.rstrip("."))
        if kind == "name":
            self.take()
            if self.peek()[1] == "_":
                self.take()
                return Node("var", (f"{got}_{self.group()}",))
            return Node("const", (got,)) if got in ("e", "i") else Node("var", (got,))
        if got in ("(", "["):
            self.take()
            inside = self.members(got)
            closed = self.take()
            if closed not in (")", "]"):
                raise Unread(f"{closed!r} closes {got!r}")
            if len(inside.parts) == 2 and got + closed in ("()", "[]"):
                return inside.parts[1]
            return Node("list", (got + closed, *inside.parts[1:]))
        if got == "{":
            return self.group()
        if got == "|":
            self.take()
            self.bars += 1
            inside = self.expression(0)
            self.bars -= 1
            self.take("|")
            return call("call", Node("abs", ()), inside)
        if kind == "command":
            return self.command()
        raise Unread(f"{got!r} begins no expression")

    def command(self) -> Node:
        got = self.take()
        name = got[1:]
        if got == "\\{":
            if self.peek()[1] == "\\}":
                self.take()
                return Node("list", ("{",))
            inside = self.members("{")
            self.take("\\}")
            return inside
        if got in ("\\frac", "\\binom"):
            return call("div" if got == "\\frac" else "binom", self.group(), self.group())
        if got in ("\\pi", "\\infty"):
            return Node("const", (name,))
        if got in ("\\lfloor", "\\lceil"):
            inside = self.expression(0)
            self.take("\\rfloor" if got == "\\lfloor" else "\\rceil")
            return call("call", Node("floor" if got == "\\lfloor" else "ceil", ()), inside)
        if got in ("\\emptyset", "\\varnothing"):
            return Node("list", ("{",))
        if name in GREEK:
            return Node("var", (name,))
        if got == "\\sqrt":
            if self.peek()[1] == "[":
                self.take()
                degree = self.expression(0)
                self.take("]")
                return call("pow", self.group(), call("div", num(1), degree))
            return call("pow", self.group(), num(Fraction(1, 2)))
        if name in FUNCTIONS:
            power = base = None
            while self.peek()[1] in ("^", "_"):
                if self.take() == "^":
                    power = call("neg", self.atom()) if self.peek()[1] == "-" and self.take() else self.group()
                else:
                    base = self.group()
            if power == call("neg", num(1)) and name in INVERSE:
                name, power = INVERSE[name], None
            x = call("call", Node(name, ()), self.argument())
            x = call("div", x, call("call", Node("ln", ()), base)) if base is not None and name == "log" else x
            return x if power is None else call("pow", x, power)
        raise Unread(f"{got} is unknown")

    def argument(self) -> Node:
        """What a function without brackets takes: the factors up to the next sign or function."""
        if self.peek()[1] in ("(", "{", "["):
            return self.atom()
        if self.peek()[1] == "-":
            self.take()
            return call("neg", self.argument())
        x = self.power()
        while self.factor_next() and self.peek()[1][1:] not in FUNCTIONS and self.peek()[1] not in ("(", "|"):
            x = call("mul", x, self.power())
        return x


def matrix(text: str) -> Node | None:
    """A matrix environment as a list of its rows."""
    m = re.fullmatch(r"\s*\\begin\{([pbvBV]?matrix|array)\}(?:\{[^}]*\})?(.*)\\end\{\1\}\s*", text, re.S)
    if not m:
        return None
    rows = [r for r in re.split(r"\\\\|\\cr", m[2]) if r.strip()]
    return Node("list", ("matrix", *[Node("list", ("row", *[tree_of(c) for c in r.split("&")])) for r in rows]))


def tree_of(text: str) -> Node:
    return matrix(text.replace("$", "")) or Parser(tokens(text)).whole()


#: More than the texts of both sides of an Arrow batch, so that a text that several columns compare is read once.
@lru_cache(1 << 15)
def parsed(text: str) -> Node | None:
    """The tree of an answer: its last formula between dollars, the whole text, or its last number; null if there is none."""
    formula = r"\$+([^$]+)\$+|\\\((.+?)\\\)|\\\[(.+?)\\\]"
    spans = [a or b or c for a, b, c in re.findall(formula, text, re.S)]
    prose = spans and re.search("[A-Za-z]{2}", re.sub(formula, "", text, flags=re.S))
    numbers = re.findall(r"(?<![\w.])-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*/\s*\d+(?![\w.]))?%?", text) if re.search(r"[A-Za-z]{2}", text) and "\\" not in text else []
    for candidate in (*spans[-1:], *([] if prose else [text]), *numbers[-1:]):
        try:
            return tree_of(candidate)
        except (ValueError, RecursionError, IndexError):
            continue
    return None


def exact(x: Node) -> Fraction | None:
    """The value of a tree that is rational."""
    if x.kind == "num":
        return x.parts[0]
    if x.kind not in ("neg", "add", "sub", "mul", "div", "pow", "factorial", "percent", "binom"):
        return None
    args = []
    for p in x.parts:
        found = exact(p)
        if found is None:
            return None
        args.append(found)
    a, b = args[0], args[-1]
    match x.kind:
        case "neg":
            return -a
        case "add":
            return a + b
        case "sub":
            return a - b
        case "mul":
            return a * b
        case "div":
            return a / b if b else None
        case "percent":
            return a / 100
        case "factorial":
            return Fraction(math.factorial(int(a))) if a.denominator == 1 and 0 <= a and a * max(1, int(a).bit_length()) <= BITS else None
        case "binom":
            return Fraction(math.comb(int(a), int(b))) if a.denominator == b.denominator == 1 and a >= 0 and b >= 0 and a <= BITS else None
    size = max(abs(a.numerator), a.denominator).bit_length()
    if b.denominator == 1:
        return a ** int(b) if abs(b) * size <= BITS and (a or b >= 0) else None
    # Roots of powers stay rational.
    if a < 0 or abs(b) * size > BITS or b.denominator > 64:
        return None
    roots = [round(math.exp(math.log(n) / b.denominator)) if n.bit_length() <= 900 and n else 0 for n in (a.numerator, a.denominator)]
    if [r**b.denominator for r in roots] != [a.numerator, a.denominator] or not roots[0] and b < 0:
        return None
    return Fraction(*roots) ** b.numerator


def value(x: Node, at: dict[str, float]) -> complex:
    """The value of a tree with its variables at a point."""
    rational = exact(x)
    if rational is not None:
        return complex(rational.numerator / rational.denominator)
    match x.kind:
        case "var":
            return at[x.parts[0]]
        case "const":
            return {"pi": math.pi, "e": math.e, "i": 1j, "infty": math.inf}[x.parts[0]]
        case "call":
            return complex(FUNCTIONS[x.parts[0].kind](complex(value(x.parts[1], at))))
        case "list" | "relation" | "union" | "pm":
            raise Unread("no number")
    args = [value(p, at) for p in x.parts]
    a, b = args[0], args[-1]
    match x.kind:
        case "neg":
            return -a
        case "add":
            return a + b
        case "sub":
            return a - b
        case "mul":
            return a * b
        case "div":
            return a / b
        case "pow":
            return complex(a) ** b
        case "percent":
            return a / 100
        case "factorial":
            return complex(math.gamma(complex(a).real + 1))
        case "binom":
            n, k = complex(a).real, complex(b).real
            return complex(math.gamma(n + 1) / math.gamma(k + 1) / math.gamma(n - k + 1))
    raise Unread(x.kind)


def names(x: Node) -> set[str]:
    """A tree's variables."""
    if x.kind == "var":
        return set(x.parts)
    return set().union(*(names(p) for p in x.parts if isinstance(p, Node))) if x.parts else set()


def decimal(x: Node) -> bool:
    return x.kind == "num" and x.parts[1] or any(decimal(p) for p in x.parts if isinstance(p, Node))


def same_number(a: Node, b: Node, digits: int) -> bool:
    """Whether two trees have one value, at every point if they have variables."""
    x, y = exact(a), exact(b)
    if x is not None and y is not None:
        return x == y or (decimal(a) or decimal(b)) and round(x, digits) == round(y, digits)
    free = sorted(names(a) | names(b))
    agreed = 0
    for k in range(len(POINTS) if free else 1):
        at = {v: POINTS[(k + n) % len(POINTS)] + n // len(POINTS) for n, v in enumerate(free)}
        try:
            p, q = complex(value(a, at)), complex(value(b, at))
        except (ArithmeticError, ValueError):
            continue
        if p == q:
            agreed += 1
            continue
        if not (cmath.isfinite(p) and cmath.isfinite(q)):
            if free:
                continue
            return False
        if abs(p - q) > (1e-9 if free or not (decimal(a) or decimal(b)) else 0.5 * 10.0**-digits) * max(1.0, abs(p) if free else 1.0):
            rounded = [(round(z.real, digits), round(z.imag, digits)) for z in (p, q)]
            if free or rounded[0] != rounded[1]:
                return False
        agreed += 1
    return agreed > 0


def spread(x: Node) -> Node:
    """Signs of plus or minus as a set of both values."""
    if x.kind == "pm":
        return Node("list", ("{", call("add", *x.parts), call("sub", *x.parts)))
    if x.kind in ("neg", "add", "sub", "mul", "div"):
        parts = [spread(p) for p in x.parts]
        for k, p in enumerate(parts):
            if p.kind == "list":
                return Node("list", ("{", *[call(x.kind, *parts[:k], own, *parts[k + 1 :]) for own in p.parts[1:]]))
    return x


def same_members(a: list[Node], b: list[Node], digits: int) -> bool:
    """Whether two sets have the same members, whatever their order and repeats."""
    return all(any(same(x, y, digits) for y in b) for x in a) and all(any(same(x, y, digits) for x in a) for y in b)


def directed(x: Node) -> list[tuple[str, Node]]:
    """A chain of relations as (kind, left - right), all of the kinds =, <, <= and !=."""
    kinds, sides = x.parts[0], x.parts[1:]
    turned = {">": "<", ">=": "<="}
    return [(turned.get(k, k), call("sub", b, a) if k in turned else call("sub", a, b)) for k, a, b in zip(kinds, sides, sides[1:])]


def same_relation(a: tuple[str, Node], b: tuple[str, Node], digits: int) -> bool:
    return a[0] == b[0] and (same(a[1], b[1], digits) or a[0] in ("=", "!=") and same(call("neg", a[1]), b[1], digits))


def same(a: Node, b: Node, digits: int = DECIMALS) -> bool:
    """Whether two trees are equal: numbers by value, tuples and intervals by members in order and brackets, sets without order, relations by what they state."""
    a, b = spread(a), spread(b)
    # x = 5 answers as 5 does.
    assigned = lambda x: x.kind == "relation" and x.parts[0] == ("=",) and x.parts[1].kind == "var"
    if assigned(a) != assigned(b) and "relation" not in (a.kind if not assigned(a) else "", b.kind if not assigned(b) else ""):
        a, b = (x.parts[2] if assigned(x) else x for x in (a, b))
        a, b = spread(a), spread(b)
    if "relation" in (a.kind, b.kind):
        if a.kind != b.kind:
            return False
        x, y = directed(a), directed(b)
        return len(x) == len(y) and all(any(same_relation(p, q, digits) for q in y) for p in x) and all(any(same_relation(p, q, digits) for p in x) for q in y)
    if "union" in (a.kind, b.kind):
        return same_members(*[list(x.parts) if x.kind == "union" else [x] for x in (a, b)], digits)
    if "list" in (a.kind, b.kind):
        if a.kind != b.kind or a.parts[0] != b.parts[0]:
            single = [x.parts[1] if x.kind == "list" and x.parts[0] == "{" and len(x.parts) == 2 else x for x in (a, b)]
            return single != [a, b] and same(*single, digits)
        x, y = list(a.parts[1:]), list(b.parts[1:])
        if a.parts[0] == "{":
            return same_members(x, y, digits)
        return len(x) == len(y) and all(same(p, q, digits) for p, q in zip(x, y, strict=True))
    if same_number(a, b, digits):
        return True
    # 50% answers both 50 and 1/2.
    bare = [x.parts[0] if x.kind == "percent" else x for x in (a, b)]
    return bare != [a, b] and (a.kind == "percent") != (b.kind == "percent") and same_number(*bare, digits)


def equal(pred: str | None, gold: str | None, digits: int = DECIMALS) -> bool:
    """Whether two answers are equal as texts without outer space and case, or as mathematics."""
    if pred is None or gold is None:
        return False
    if pred.strip().lower() == gold.strip().lower():
        return True
    try:
        a, b = parsed(pred.strip()), parsed(gold.strip())
        return a is not None and b is not None and same(a, b, digits)
    except (Unread, RecursionError, OverflowError):
        return False


def rounded_equal(pred: str | None, gold: str | None, digits: int = 2) -> bool:
    """Whether two answers without variables are the same text in lower case, or agree in their first decimals, tuples and lists by member; empty ones are equal to none."""
    if not (pred or "").strip() or not (gold or "").strip():
        return False
    pred, gold = pred.strip().lower(), gold.strip().lower()
    if pred == gold:
        return True

    def close(a: Node, b: Node) -> bool:
        if "list" in (a.kind, b.kind):
            return a.kind == b.kind and a.parts[0] == b.parts[0] and len(a.parts) == len(b.parts) and all(close(x, y) for x, y in zip(a.parts[1:], b.parts[1:], strict=True))
        if names(a) or names(b):
            return a == b
        x, y = exact(a), exact(b)
        if x is not None and y is not None:
            return round(x, digits) == round(y, digits)
        p, q = complex(value(a, {})), complex(value(b, {}))
        return p == q or cmath.isfinite(p) and cmath.isfinite(q) and abs(p.imag - q.imag) < 1e-9 and round(p.real, digits) == round(q.real, digits)

    try:
        a, b = tree_of(pred), tree_of(gold)
        return close(a, b)
    except (ValueError, ArithmeticError, RecursionError, IndexError):
        return False


def ratio(text: str | None) -> str | None:
    """The exact value of an answer as p/q in lowest terms; null if it is no rational number."""
    tree = parsed(text.strip()) if text else None
    found = exact(tree.parts[2] if tree.kind == "relation" and tree.parts[0] == ("=",) else tree) if tree is not None else None
    return None if found is None else f"{found.numerator}/{found.denominator}"


def _compared(f: Callable[[str | None, str | None], bool]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(BooleanType())
    def compare(pairs: pd.DataFrame) -> pd.Series:
        return pd.Series([True if a else f(p, g) if p is not None else False for a, p, g in zip(pairs["alike"], pairs["pred"], pairs["gold"], strict=True)], dtype=bool)

    def pair(pred: Column, gold: Column) -> Column:
        alike = F.coalesce((F.lower(F.trim(pred)) == F.lower(F.trim(gold))) & (F.trim(gold) != ""), F.lit(False))
        # Only pairs whose texts differ, and that both hold something to read, are worth parsing.
        readable = ~alike & F.regexp_like(pred, F.lit(r"[0-9A-Za-z\\]")) & F.regexp_like(gold, F.lit(r"[0-9A-Za-z\\]"))
        return F.struct(alike.alias("alike"), F.when(readable, pred).alias("pred"), F.when(readable, gold).alias("gold"))

    return lambda pred, gold: compare(T.let(pair, pred, gold))


#: (pred, gold) -> boolean Columns. A null is equal to nothing.
math_equal = _compared(equal)
math_equal_in_two_decimals = _compared(rounded_equal)


def math_ratio(x: Column) -> Column:
    """The exact value of an answer as p/q in lowest terms; null if it is no rational number."""
    @F.pandas_udf(StringType())
    def read(text: pd.Series) -> pd.Series:
        return text.map(lambda t: ratio(t) if t is not None else None)

    return read(F.when(F.regexp_like(x, F.lit("[0-9]")), x))
