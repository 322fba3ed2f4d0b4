"""Sign expressions: `A.B`, `A×(B.C)@t`: parse, compose, normalize and match, and their splitting.

A tree is (operator, operands): a name without operands, a modifier with one, an operator with two.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

# Binding of operators (a higher one binds tighter), modifiers, and what names look like.
BINDING = {".": 0, "+": 1, "×": 2, "&": 3, "%": 4, "@": 4}
MODIFIER = re.compile(r"@(45|90|180|[tgšnkzicdfvabx4])")
COMPONENT = re.compile(r"[A-ZŠĜŘḪṬṢŚ’]+[x0-9]*(?:[a-c]|bis|ter)?|(?<![@0-9])[0-9]+")

Tree = tuple  # (str, tuple of Trees)


def parse(text: str) -> Tree:
    """Operators of one binding associate to the left."""
    at = 0

    def operand() -> Tree:
        nonlocal at
        if at < len(text) and text[at] == "(":
            at += 1
            out = chain(0)
            at += at < len(text) and text[at] == ")"
        else:
            begin = at
            while at < len(text) and text[at] not in "()" and text[at] not in BINDING:
                at += 1
            out = (text[begin:at], ())
        while m := MODIFIER.match(text, at):
            out, at = (m[1], (out,)), m.end()
        return out

    def chain(least: int) -> Tree:
        nonlocal at
        left = operand()
        while at < len(text) and text[at] != ")" and text[at] in BINDING and BINDING[text[at]] >= least:
            op = text[at]
            at += 1
            left = (op, (left, chain(BINDING[op] + 1)))
        return left

    return chain(0)


def compose(tree: Tree) -> str:
    """Back to text with no more parentheses than needed."""
    op, parts = tree
    if len(parts) == 2:
        left, right = ((f"({compose(p)})" if len(p[1]) == 2 and BINDING[p[0]] < BINDING[op] + k else compose(p)) for k, p in enumerate(parts))
        return left + op + right
    if len(parts) == 1:
        inner = compose(parts[0])
        return f"({inner})@{op}" if len(parts[0][1]) == 2 else f"{inner}@{op}"
    return op


def normalize(tree: Tree) -> Tree:
    """Chains of `.` and of `+` lean left; `.` or `+` of two `&` is the `&` of their parts."""
    op, parts = tree
    if len(parts) < 2:
        return (op, tuple(map(normalize, parts)))
    if op not in ".+":
        return (op, tuple(map(normalize, parts)))

    def flat(t: Tree) -> list[Tree]:
        return [x for p in t[1] for x in flat(p)] if t[0] == op and len(t[1]) == 2 else [normalize(t)]

    items = flat(tree)
    out = items[0]
    for item in items[1:]:
        out = _joined(op, out, item)
    return out


def _joined(op: str, a: Tree, b: Tree) -> Tree:
    if a[0] == b[0] == "&" and len(a[1]) == len(b[1]) == 2:
        return ("&", tuple(normalize((op, (x, y))) for x, y in zip(a[1], b[1], strict=True)))
    return (op, (a, b))


def matches(tree: Tree, pattern: Tree) -> bool:
    """Whether a tree has a pattern's shape; X stands for any part, and for several at the right end of a chain."""
    if pattern[0] == "X" and not pattern[1]:
        return True
    if len(tree[1]) != len(pattern[1]):
        return False
    if len(pattern[1]) == 2 and pattern[1][1][0] == "X" and BINDING[tree[0]] == BINDING[pattern[0]] and matches(tree[1][0], pattern):
        return True
    return tree[0] == pattern[0] and all(map(matches, tree[1], pattern[1]))


def to_json(tree: Tree) -> str:
    def node(t: Tree) -> dict:
        return {"op": t[0], "vals": [node(p) for p in t[1]]}

    return json.dumps(node(tree), ensure_ascii=False)


def _at_top(text: str) -> list[tuple[int, str]]:
    level, out = 0, []
    for i, c in enumerate(text):
        level -= c == ")"
        if not level:
            out.append((i, c))
        level += c == "("
    return out


def split_glyphs(text: str) -> list[str]:
    """Parts between dots outside of parentheses."""
    cuts = [-1, *(i for i, c in _at_top(text) if c == "."), len(text)]
    return [text[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]


def split_sign(text: str) -> list[tuple[str, str | None]]:
    """(operators before it, component) of each component, and what is left behind the last one with None."""
    out, at = [], 0
    for m in COMPONENT.finditer(text):
        out.append((text[at : m.start()], m[0]))
        at = m.end()
    return [*out, (text[at:], None)]


def number_specs(text: str) -> list[tuple[str, str | None]]:
    """`a(b)c` -> (a, b), (c, None): parts with what stands in parentheses behind them."""
    out, begin, opened = [], 0, None
    for i, c in _at_top(text):
        if c == "(":
            opened = i
        elif c == ")" and opened is not None:
            out.append((text[begin:opened], text[opened + 1 : i]))
            begin, opened = i + 1, None
    if begin < len(text):
        out.append((text[begin:], None))
    return out


def normalized(text: str) -> str:
    return compose(normalize(parse(text)))


def _each(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        known: dict = {}
        return s.map(lambda x: None if x is None else known[x] if x in known else known.setdefault(x, f(x)))

    return run


def normalize_column(text):
    return _each(normalized, "string")(text)


def tree_column(text):
    return _each(lambda x: to_json(parse(x)), "string")(text)


def glyphs_column(text):
    return _each(split_glyphs, "array<string>")(text)


def components_column(text):
    """array<struct<op, component>> of a sign."""
    return _each(lambda x: [{"op": o, "component": c} for o, c in split_sign(x)], "array<struct<op:string,component:string>>")(text)


def matches_column(text, pattern: str):
    wanted = parse(pattern)
    return _each(lambda x: matches(parse(x), wanted), "boolean")(text)


# Names of modifiers in print.
MODIFIER_NAMES = {"g": "gunû", "š": "šeššig", "t": "tenû", "n": "nutillû", "k": "kabatenû", "z": "zidatenû", "i": "inversum", "v": "var", "c": "○︎", "4": "quad", "d": "doubled"}
# Sign lists; a name of one of them and three digits is a number in that list.
LISTS = ("BAU", "LAK", "KWU", "RSP", "REC", "ZATU", "ELLES", "UKN")
#: Operators that are printed between their operands; those of other operators stand above each other.
INFIX = (".", "+", "×")


def _span(kind: str, inner: str) -> str:
    return f'<span class="{kind}">{inner}</span>'


def _name(name: str) -> str:
    """A name with the number at its end apart."""
    word = name.rstrip("0123456789x")
    number = name[len(word) :]
    if not word or not number:
        return name
    return word + _span("slindex" if word in LISTS and len(number) == 3 and "x" not in number else "index", number)


def _operand(tree: Tree, least: int) -> str:
    """HTML of an operand, in parentheses if it is a chain that binds less than it must."""
    chain = len(tree[1]) == 2 and tree[0] in INFIX and BINDING[tree[0]] < least
    return f"({html(tree)})" if chain else html(tree)


def html(tree: Tree) -> str:
    """A sign as HTML: signs above each other as stacks, turned signs and indices in spans, modifiers by name."""
    op, parts = tree
    match len(parts), op:
        case 0, _:
            return _name(op)
        case 1, "45" | "90" | "180":
            return _span(f"rot{op}", html(parts[0]))
        case 1, _:
            return _operand(parts[0], max(BINDING.values()) + 1) + _span("modifier", MODIFIER_NAMES.get(op, op))
        case 2, _ if op in INFIX:
            return op.join(_operand(p, BINDING[op] + k) for k, p in enumerate(parts))
    above, below = map(html, parts)
    stack = _span("stack", "<br/>".join([_span("rot180", above) if op == "@" else above, below]))
    return _span("cross", stack) if op == "%" else stack


def html_column(text):
    return _each(lambda x: html(parse(x)), "string")(text)


def number_html(text: str) -> str:
    """A number as HTML: marks and signs in parentheses in spans."""
    part = lambda p: re.sub(r"[!?*]+", lambda m: f"<span class='critics'>{m[0]}</span>", p)
    return "".join(part(p) + (f"<span class='signspec'>{html(parse(s))}</span>" if s else "") for p, s in number_specs(text))


def number_html_column(text):
    return _each(number_html, "string")(text)


def number_specs_column(text):
    """array<struct<value, spec>> of a number."""
    return _each(lambda x: [{"value": v, "spec": s} for v, s in number_specs(x)], "array<struct<value:string,spec:string>>")(text)
