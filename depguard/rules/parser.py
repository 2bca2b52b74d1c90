"""One tokenizer for all rule dialects.

Identifiers may be quoted with backticks; literals are signed integers, decimals or quoted strings. Operand order is
kept: a literal or B-side operand on the left is mirrored, never silently swapped.
"""

from __future__ import annotations

import re

from depguard.rules.model import DC, DD, FD, MFD, MIRROR, POD, Dist, FDSet, Lit, Pred, Ref


class RuleError(ValueError):
    """The text isn't a rule of the family asked for."""


_TOKEN = re.compile(
    r"""\s*(?:(?P<arrow>->)|(?P<op>!=|<>|>=|<=|==|=|>|<)|(?P<quoted>`[^`]+`)|(?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")"""
    r"""|(?P<number>[+-]?\d+(?:\.\d+)?(?![\w.]))|(?P<name>[^\W\d]\w*)|(?P<mark>[@,;\[\]_.]))""",
    re.UNICODE,
)
_OPS = {"<>": "!=", "==": "="}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise RuleError(f"unexpected {text[at:at + 12]!r} in rule {text!r}")
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "quoted":
            kind, value = "name", value[1:-1]
        elif kind == "op":
            value = _OPS.get(value, value)
        out.append((kind, value))
        at = m.end()
    return out


def _split(tokens: list, *marks: str) -> list[list]:
    parts: list[list] = [[]]
    for t in tokens:
        if t[0] in ("mark", "arrow") and t[1] in marks:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def _name(tokens: list, text: str) -> str:
    if len(tokens) != 1 or tokens[0][0] != "name":
        raise RuleError(f"a column name is expected in rule {text!r}, not {''.join(v for _, v in tokens)!r}")
    return tokens[0][1]


def _literal(kind: str, value: str) -> Lit:
    if kind == "number":
        return Lit(float(value) if "." in value else int(value))
    return Lit(value[1:-1].replace(value[0] * 2, value[0]))


def _fds(text: str) -> list[FD]:
    """`a,b->c,d;e->f`: several right sides become several rules. `zip_city` is the short form of one rule."""
    if "->" not in text:
        parts = text.split("_")
        if len(parts) != 2 or not all(re.fullmatch(r"[^\W\d]\w*", p.strip()) for p in parts):
            raise RuleError(f"not a functional dependency: {text!r}")
        return [FD((parts[0].strip(),), parts[1].strip())]
    rules = []
    for one in _split(_tokens(text), ";"):
        if not one:
            continue
        sides = _split(one, "->")
        if len(sides) != 2:
            raise RuleError(f"exactly one -> is expected in {text!r}")
        lhs, rhs = ([_name(x, text) for x in _split(s, ",")] for s in sides)
        rules += [FD(tuple(lhs), r) for r in rhs]
    if not rules:
        raise RuleError("no rule given")
    return rules


def _dc(text: str) -> DC:
    preds = []
    for part in _split(_tokens(text), "@"):
        ops = [i for i, t in enumerate(part) if t[0] == "op"]
        if len(ops) != 1:
            raise RuleError(f"one comparison is expected between @ signs in {text!r}")

        def side(tokens: list) -> Ref | Lit:
            if len(tokens) == 1 and tokens[0][0] in ("number", "string"):
                return _literal(*tokens[0])
            if len(tokens) == 3 and tokens[0][1] in ("A", "B") and tokens[1][1] == "." and tokens[2][0] == "name":
                return Ref(tokens[0][1], tokens[2][1])
            raise RuleError(f"A.column, B.column or a literal is expected in {text!r}")

        p = Pred(side(part[: ops[0]]), part[ops[0]][1], side(part[ops[0] + 1 :]))
        if not p.aliases:
            raise RuleError(f"a predicate without a column in {text!r}")
        if isinstance(p.left, Lit) or (isinstance(p.right, Ref) and p.left.alias == "B" and p.right.alias == "A"):
            p = p.mirrored()
        preds.append(p)
    return DC(tuple(preds), text)


def _dd(text: str) -> DD:
    sides = _split(_tokens(text), "@")
    if len(sides) != 2:
        raise RuleError(f"exactly one @ is expected in {text!r}")

    def dists(tokens: list) -> tuple[Dist, ...]:
        out = []
        for part in _split(tokens, ","):
            kinds = [k for k, _ in part]
            if kinds == ["name", "op", "number"]:
                out.append(Dist(part[0][1], part[1][1], float(part[2][1])))
            elif kinds == ["number", "op", "name"]:
                out.append(Dist(part[2][1], MIRROR[part[1][1]], float(part[0][1])))
            else:
                raise RuleError(f"column op number is expected in {text!r}")
        return tuple(out)

    return DD(dists(sides[0]), dists(sides[1]), text)


def _pod(text: str) -> POD:
    sides = _split(_tokens(text), "->")
    if len(sides) != 2:
        raise RuleError(f"exactly one -> is expected in {text!r}")

    def terms(tokens: list) -> list[tuple[str, str]]:
        out = []
        for part in _split(tokens, "["):
            part = [t for t in part if t[1] != "]"]
            if part:
                if [k for k, _ in part] not in (["name", "op"], ["number", "op"]):
                    raise RuleError(f"[column op] is expected in {text!r}")
                out.append((part[0][1], part[1][1]))
        return out

    lhs, rhs = terms(sides[0]), terms(sides[1])
    if not lhs or len(rhs) != 1:
        raise RuleError(f"an order dependency has some left terms and one right term: {text!r}")
    return POD(tuple(lhs), rhs[0])


def parse_rule(text: str, family: str):
    """family: fd, mfd, fdset, dc, dd or pod. Raises RuleError with what is wrong."""
    if family == "fd":
        rules = _fds(text)
        if len(rules) != 1:
            raise RuleError(f"one dependency is expected, {len(rules)} given; use fdset")
        return rules[0]
    if family == "fdset":
        return FDSet(tuple(_fds(text)))
    if family == "mfd":
        sides = _split(_tokens(text), "@")
        if len(sides) != 2:
            raise RuleError(f"exactly one @ is expected in {text!r}")
        return MFD(tuple(_name(x, text) for x in _split(sides[0], ",")), _name(sides[1], text))
    parsers = {"dc": _dc, "dd": _dd, "pod": _pod}
    if family not in parsers:
        raise RuleError(f"unknown rule family {family!r}")
    return parsers[family](text)
