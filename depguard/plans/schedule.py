"""Order in which the rules of a set are repaired."""

from __future__ import annotations

from depguard.rules import FD


def schedule(rules: list[FD]) -> tuple[list[tuple[str, list[FD]]], list[str]]:
    """Right sides in an order in which every left side is final first, each with its rules; and the right sides on or
    behind a cycle, which can't be ordered."""
    by_rhs: dict[str, list[FD]] = {}
    for r in rules:
        if r not in by_rhs.setdefault(r.rhs, []):
            by_rhs[r.rhs].append(r)
    waiting, order = dict(by_rhs), []
    while ready := [y for y, rs in waiting.items() if not any(x in waiting for r in rs for x in r.lhs)]:
        for y in ready:
            order.append((y, waiting.pop(y)))
    return order, list(waiting)
