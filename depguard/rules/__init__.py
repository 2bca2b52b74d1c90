"""Rules as data: the dataclasses and the parser for every rule dialect."""

from depguard.rules.model import DC, DD, FD, MFD, POD, Dist, FDSet, Lit, Pred, Ref
from depguard.rules.parser import RuleError, parse_rule

__all__ = ["DC", "DD", "FD", "MFD", "POD", "Dist", "FDSet", "Lit", "Pred", "Ref", "RuleError", "parse_rule"]
