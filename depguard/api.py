"""The calls most users need, in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depguard.operators import dc, dd, fd
from depguard.operators.fd import rollup_counts
from depguard.operators.heavy import per_key_report
from depguard.operators.impute import chained_imputation
from depguard.operators.malformed import LineSchema, check_lines, load_lines
from depguard.operators.pod import pod_incremental
from depguard.operators.repair import equivalence_classes, repair, value_classes, vote
from depguard.rules import DC, DD, FD, MFD, POD, parse_rule
from depguard.sources import read_text_with_header, write_repaired, write_report

__all__ = [
    "LineSchema", "chained_imputation", "check_lines", "detect", "equivalence_classes", "load_lines", "parse_rule", "per_key_report", "pod_incremental", "read_text_with_header",
    "repair", "rollup_counts", "value_classes", "vote", "write_repaired", "write_report",
]


def detect(df: DataFrame, rule, key: str | None = None, output: str = "report", base: DataFrame | None = None, **options) -> DataFrame:
    """output: report, rows, groups or pairs, as far as the rule's family has it. Pairs need a unique key column.

    options go to the operator, as `numeric` (columns of text compared as numbers), `clamp` or `exact`. An order
    dependency checks df against `base`, or against itself if there is none: its pairs, or with `report` their number.
    """
    name = (type(rule), output)
    if name == (FD, "report"):
        return fd.fd_report(df, rule)
    if name == (FD, "rows"):
        return fd.rows(df, rule, **options)
    if name == (FD, "groups"):
        return fd.groups(df, rule)
    if name == (MFD, "report"):
        return fd.mfd_report(df, rule, **options)
    if key is None and (output != "report" or isinstance(rule, POD)) and not (isinstance(rule, DC) and not rule.pairwise):
        raise ValueError("pairs of rows need a key column")
    if name == (MFD, "pairs"):
        return fd.mfd_pairs(df, rule, key, **options)
    if name == (DC, "report"):
        return dc.dc_report(df, rule, key, **options)
    if name == (DC, "rows"):
        return dc.pair_members(df, rule, key, **options) if rule.pairwise else dc.rows(df, rule, **options)
    if name == (DC, "pairs"):
        return dc.pairs(df, rule, key, **options)
    if name == (DD, "report"):
        return dd.dd_report(df, rule, key, **options)
    if name == (DD, "pairs"):
        return dd.dd_pairs(df, rule, key, **options)
    if isinstance(rule, POD) and output in ("report", "pairs"):
        met = pod_incremental(df.limit(0), df, rule, key, within_add=True, **options) if base is None else pod_incremental(base, df, rule, key, **options)
        if output == "pairs":
            return met
        return met.agg(F.count("*").alias("dirty")).join(F.broadcast(df.agg(F.count("*").alias("total")))).withColumn("rule", F.lit(str(rule)))
    raise ValueError(f"{type(rule).__name__} has no output {output!r}")
