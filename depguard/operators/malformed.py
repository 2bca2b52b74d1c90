"""Lines of a delimited source: the valid rows as a table, the others apart with their reason.

All matching is done by patterns made from the schema, in the JVM. Java's regex recurses once for each turn of a
repeated group, so the patterns repeat only character classes: doubled quotes become one marker character first, and
lines of any length and with any number of quotes are matched in constant stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Stands for a doubled quote, and the escape that keeps both apart from the same code points in a line.
_PAIR, _ESCAPE = "\uffff", "\ufffe"
_BARE = f'[^",{_PAIR}]*+'
_ANY = f'(?:{_BARE}|{_PAIR}*+"[^"]*+"|{_PAIR}++)'


def int_pattern(low: int, high: int) -> str:
    """The decimal integers from low to high (low < 0 < high), leading zeros allowed."""

    def upto(n: int) -> str:
        digits, parts = str(n), []
        if len(digits) > 1:
            parts.append(f"[0-9]{{1,{len(digits) - 1}}}")
        for i, d in enumerate(digits):
            if int(d) > (i == 0):
                parts.append(f"{digits[:i]}[{1 if i == 0 else 0}-{int(d) - 1}][0-9]{{{len(digits) - i - 1}}}")
        return "|".join([*parts, digits])

    return f"(?:0*(?:{upto(high)})|-0*(?:{upto(-low)}))"


@dataclass(frozen=True)
class Field:
    """kind: any, name (holds a letter and no U+FFFD) or int (32 bits, blanks and tabs around it, or empty)."""

    name: str
    kind: str = "any"

    def pattern(self) -> str:
        if self.kind == "name":
            bare = f'(?=[^",{_PAIR}]*?\\p{{L}})[^",{_PAIR}�]*+'
            return f'(?:{bare}|(?={_PAIR}*+"[^"]*?\\p{{L}}){_PAIR}*+"[^"�]*+")'
        if self.kind == "int":
            value = f"[ \\t]*+(?:{int_pattern(-(2**31), 2**31 - 1)})?[ \\t]*+"
            return f'(?:{value}|"{value}"|{_PAIR})'
        return _ANY


class LineSchema:
    """The patterns of a schema: `row` for a whole valid row; for its first i+1 fields, `shapes[i]` if they are quoted as
    they must be, `prefixes[i]` if their values fit too, `ends[i]` if the line also ends there."""

    def __init__(self, fields: list[Field]):
        self.fields = fields
        each = [f"({f.pattern()})" for f in fields]
        self.row = "^" + ",".join(each) + "\\z"
        self.prefixes = ["^" + ",".join(p.pattern() for p in fields[: i + 1]) + "(?=,|\\z)" for i in range(len(fields))]
        self.shapes = ["^" + ",".join([_ANY] * (i + 1)) + "(?=,|\\z)" for i in range(len(fields))]
        self.ends = ["^" + ",".join([_ANY] * (i + 1)) + "\\z" for i in range(len(fields))]


def _coded(line: str) -> Column:
    escaped = F.replace(F.replace(F.col(line), F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_PAIR), F.lit(_ESCAPE + "1"))
    return F.replace(escaped, F.lit('""'), F.lit(_PAIR))


def _value(c: Column, kind: str) -> Column:
    """A field's text without its quotes, doubled quotes single again."""
    plain = F.regexp_replace(c, f'^({_PAIR}*+)"([^"]*+)"\\z', "$1$2")
    pairs_only = F.regexp_like(c, F.lit(f"^{_PAIR}++\\z"))
    text = F.when(pairs_only, F.regexp_replace(c, f"^{_PAIR}", "")).otherwise(plain)
    text = F.replace(F.replace(F.replace(text, F.lit(_PAIR), F.lit('"')), F.lit(_ESCAPE + "1"), F.lit(_PAIR)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))
    if kind == "int":
        return F.when(F.regexp_replace(text, "[ \\t]+", "") == "", None).otherwise(F.regexp_replace(text, "[ \\t]+", "")).try_cast("int")
    return text


def _walk(c: Column, schema: LineSchema) -> Column:
    """(reason, field) of a line that isn't a whole valid row: the first step of the walk over growing prefixes that fails.

    First the shapes: a prefix of i fields that fails after one of i-1 fits is a misquoted field i, or a line that ended
    before it. What follows the last field can only be surplus, misquoted or not. Then the values, likewise.
    """
    like = lambda p: F.regexp_like(c, F.lit(p))
    found = lambda reason, at: F.struct(F.lit(reason).alias("reason"), F.lit(at).alias("field"))
    k = len(schema.fields)
    walk = F.when(c.isNull(), found("columns", 1)).when(~like(schema.shapes[0]), found("quoting", 1))
    for i in range(1, k):
        walk = walk.when(~like(schema.shapes[i]), F.when(like(schema.ends[i - 1]), found("columns", i + 1)).otherwise(found("quoting", i + 1)))
    # The schema's fields are taken off; \G goes on from one surplus field to the next in constant stack.
    rest = F.regexp_replace(F.regexp_replace(c, schema.shapes[-1], ""), f"\\G,{_ANY}(?=,|\\z)", "")
    walk = walk.when(~like(schema.ends[-1]), F.when(rest != "", found("quoting", k + 1)).otherwise(found("columns", k + 1)))
    for i, p in enumerate(schema.prefixes):
        walk = walk.when(~like(p), found("value", i + 1))
    return walk


def check_lines(df: DataFrame, line: str, schema: LineSchema) -> DataFrame:
    """All columns of df, with reason (null if valid) and broken_field, the field at which the reason was found (1.. , one
    more than the schema has for what is surplus; null if valid).

    A line is tried against the whole-row pattern; only failures go through the prefix patterns, which give both marks.
    Reasons, the first that applies: quoting, columns, value. A null line has no field: reason columns, broken_field 1.
    An empty line has one field. A column of df that is called reason or broken_field is replaced.
    """
    c = F.col("_coded")
    out = df.withColumn("_coded", _coded(line))
    out = out.withColumn("_walk", F.when(~F.coalesce(F.regexp_like(c, F.lit(schema.row)), F.lit(False)), _walk(c, schema)))
    return out.withColumns({"reason": F.col("_walk.reason"), "broken_field": F.col("_walk.field")}).drop("_walk")


def load_lines(df: DataFrame, line: str, schema: LineSchema) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). valid: df's other columns and the schema's, text without quotes, empty integers null; columns
    of df that a field's name hides are dropped. rejected: df's columns, reason, broken_field."""
    checked = check_lines(df, line, schema)
    names = {f.name for f in schema.fields}
    keep = [c for c in df.columns if c not in {line, "reason", "broken_field", "_coded", "_walk", *names}]
    values = [_value(F.regexp_extract("_coded", schema.row, i + 1), f.kind).alias(f.name) for i, f in enumerate(schema.fields)]
    return checked.filter("reason is null").select(*keep, *values), checked.filter("reason is not null").drop("_coded")
