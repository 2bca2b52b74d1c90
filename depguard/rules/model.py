"""Parsed rules. Each family keeps exactly what its planner needs; no SQL text is built from them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

#: Operator -> the operator that holds when the operands change sides.
MIRROR = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
#: Operator -> its negation.
NEGATE = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


@dataclass(frozen=True)
class Ref:
    """A column of tuple A or B."""

    alias: str
    column: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Pred:
    left: Ref | Lit
    op: str
    right: Ref | Lit

    @property
    def aliases(self) -> set[str]:
        return {x.alias for x in (self.left, self.right) if isinstance(x, Ref)}

    def mirrored(self) -> Pred:
        return Pred(self.right, MIRROR[self.op], self.left)


@dataclass(frozen=True)
class Dist:
    """|A.column - B.column| op bound."""

    column: str
    op: str
    bound: float


@dataclass(frozen=True)
class FD:
    lhs: tuple[str, ...]
    rhs: str

    def __str__(self) -> str:
        return f"{','.join(self.lhs)}->{self.rhs}"


@dataclass(frozen=True)
class FDSet:
    rules: tuple[FD, ...]

    def __str__(self) -> str:
        return ";".join(map(str, self.rules))


@dataclass(frozen=True)
class MFD:
    """Pairs that agree on every lhs column and differ on rhs."""

    lhs: tuple[str, ...]
    rhs: str

    def __str__(self) -> str:
        return f"{','.join(self.lhs)}@{self.rhs}"


@dataclass(frozen=True)
class DC:
    preds: tuple[Pred, ...]
    text: str = ""

    @property
    def pairwise(self) -> bool:
        return any(len(p.aliases) == 2 for p in self.preds) or len(set().union(*(p.aliases for p in self.preds))) == 2

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class DD:
    lhs: tuple[Dist, ...]
    rhs: tuple[Dist, ...]
    text: str = ""

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class POD:
    """Order dependency: lhs and rhs are (column, op) with op one of < <= > >= =."""

    lhs: tuple[tuple[str, str], ...]
    rhs: tuple[str, str]

    def __str__(self) -> str:
        return "".join(f"[{c}{o}]" for c, o in self.lhs) + f"->[{self.rhs[0]}{self.rhs[1]}]"
