from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def word_count(df: DataFrame, col: str, sep: str = " ") -> DataFrame:
    """word, count: the text split on the separator as it stands, empty words included; null texts have none."""
    words = df.select(F.explode(F.split(col, f"\\Q{sep}\\E")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("count"))


def letters_digits(c: Column) -> Column:
    """Only letters and digits, in lower case; accents stay, those written as marks of their own too."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{M}\p{Nd}]+", ""))
