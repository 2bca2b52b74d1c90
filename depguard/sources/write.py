from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame


def logical_name(*parts: str) -> str:
    """Parts joined by _, everything that isn't a letter or digit made _."""
    return re.sub(r"[^0-9A-Za-z]", "_", "_".join(map(str, parts)))


def _write(df: DataFrame, target: str, mode: str) -> str:
    if "/" in target:
        df.write.mode(mode).parquet(target)
    else:
        df.write.mode(mode).format("parquet").saveAsTable(target)
    return target


def write_report(df: DataFrame, target: str, stamp: bool = False, mode: str = "ignore") -> str:
    """A report to a path or a catalog table; an existing one is left as it is unless mode says otherwise."""
    return _write(df, f"{target}_{int(time.time() * 1000)}" if stamp else target, mode)


def write_repaired(df: DataFrame, target: str, mode: str = "errorifexists") -> str:
    """A repaired table, helper columns (with a leading underscore) dropped."""
    return _write(df.select(*(c for c in df.columns if not c.startswith("_"))), target, mode)
