"""Duplicates hidden by formatting: one record a set of copies, with the number of its copies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from depguard.functions.text import letters_digits
from depguard.plans.skew import hot_keys
from depguard.session import Scratch


#: Rows of the hash table that a join builds in one task, about.
HASH_ROWS = 500_000


@dataclass(frozen=True)
class CopyRule:
    """exact: fields that must be equal as they are. loose: fields compared by letters and digits in lower case.
    swappable: loose fields whose values may stand in each other's field, if none of them is null."""

    exact: tuple[str, ...]
    loose: tuple[str, ...]
    swappable: tuple[str, ...] = ()


def canonical(df: DataFrame, key: str, rule: CopyRule) -> DataFrame:
    """key and one column c0.. a field: the exact fields, then the loose ones normalised, the swappable last."""
    out = [F.col(f) for f in rule.exact] + [letters_digits(F.col(f)) for f in _loose(rule)]
    return df.select(F.col(key).alias("_id"), *(c.alias(f"c{i}") for i, c in enumerate(out)))


def _loose(rule: CopyRule) -> list[str]:
    return [*(f for f in rule.loose if f not in rule.swappable), *rule.swappable]


def in_one_form(rows: DataFrame, rule: CopyRule) -> DataFrame:
    """The rows with swappable values, if none is null, put in one order, so that copies are equal column by column. Only
    rows whose fingerprint was seen twice come here."""
    first = len(rule.exact) + len(rule.loose) - len(rule.swappable)
    names = [f"c{first + i}" for i in range(len(rule.swappable))]
    if not names:
        return rows
    full = F.lit(True)
    for c in names:
        full = full & F.col(c).isNotNull()
    if len(names) == 2:
        ordered = [F.least(*names), F.greatest(*names)]
    else:
        ordered = [F.array_sort(F.array(*names))[i] for i in range(len(names))]
    return rows.withColumns({c: F.when(full, o).otherwise(F.col(c)) for c, o in zip(names, ordered)})


def fingerprint(rule: CopyRule) -> list[Column]:
    """Two 64-bit commutative multiset hashes over the canonical columns, which are in no order: the sum of the hashes of
    (field name, value) pairs. Swappable fields that are all present share one name, so their order can't matter; a null has the name of its
    own field. Each hash is cut to the bits that keep the sum within 64."""
    names = [*rule.exact, *_loose(rule)]
    first = len(names) - len(rule.swappable)
    cut = max(1, (len(names) - 1).bit_length())
    shared = F.lit(True)
    for i in range(first, len(names)):
        shared = shared & F.col(f"c{i}").isNotNull()
    label = lambda i: F.when(shared, "|".join(rule.swappable)).otherwise(names[i]) if i >= first else F.lit(names[i])
    out = []
    for seed in ("a", "b"):
        terms = [F.shiftright(F.xxhash64(F.lit(seed), label(i), F.col(f"c{i}").isNull(), F.col(f"c{i}")), cut) for i in range(len(names))]
        total = terms[0]
        for x in terms[1:]:
            total = total + x
        out.append(total.alias(f"_{seed}"))
    return out


def copies(df: DataFrame, key: str, rule: CopyRule, scratch: Scratch) -> DataFrame:
    """rep_id, id, copies for every record of a set of two or more, its representative (the smallest key) included.

    1. Rows become a fingerprint of 16 bytes; smallest key and count of each are combined before the only shuffle that
       all rows take part in, of three numbers a row.
    2. Rows of a fingerprint seen twice or more are verified: grouped by fingerprint and all fields, swappable ones in one
       form, by a hash aggregate, so rows that merely collide part again. No step sorts: joins build hash tables of at
       most about HASH_ROWS rows a task, as the number of tasks follows the fingerprints counted.
    3. Each verified row meets its group's smallest key. Fingerprints that hold 1/200 of all rows or more (at most 200)
       don't move: their groups are broadcast. The others are joined by fingerprint.

    The key must be unique. A null equals only a null in the same field; an empty value and one without letters and
    digits are equal, and differ from null. Rows with a null key are left out.
    """
    rows = canonical(df.filter(F.col(key).isNotNull()), key, rule)
    fields = [c for c in rows.columns if c != "_id"]
    rows = rows.select("_id", *fields, *fingerprint(rule))
    seen = rows.groupBy("_a", "_b").agg(F.count("*").alias("n")).filter("n > 1")
    seen = scratch.write(seen, "seen")
    total = df.count()
    hot = hot_keys(seen, ["_a", "_b"], "n", total)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seen.count() // HASH_ROWS))
    apart = lambda x, *by: x.repartition(tasks, *by)
    seen = seen.select("_a", "_b")

    def verified(part: DataFrame, small: bool) -> DataFrame:
        part = in_one_form(part, rule)
        exact = part.groupBy("_a", "_b", *fields).agg(F.min("_id").alias("rep_id"), F.count("*").alias("copies")).filter("copies > 1")
        mark = F.struct(*fields)
        exact = exact.select(F.col("_a").alias("_x"), F.col("_b").alias("_y"), mark.alias("_f"), "rep_id", "copies")
        # Equality of the fields as one value of both sides: Spark can't turn it into join keys, so rows are placed by
        # fingerprint and compared by field. Nulls equal nulls here.
        on = (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y")) & (F.size(F.array_distinct(F.array(mark, F.col("_f")))) == 1)
        if not small:
            part, exact = apart(part, "_a", "_b"), apart(exact, "_x", "_y").hint("shuffle_hash")
        return part.join(F.broadcast(exact) if small else exact, on).select("rep_id", F.col("_id").alias("id"), "copies")

    def cold(part: DataFrame, own: DataFrame) -> DataFrame:
        # Written: read twice from here, where the shuffle of all rows behind it would be read twice else.
        return verified(scratch.write(apart(part, "_a", "_b").join(apart(own, "_a", "_b").hint("shuffle_hash"), ["_a", "_b"], "left_semi"), "candidates"), False)

    if hot is None:
        return cold(rows, seen)
    hot = F.broadcast(hot)
    rest = cold(rows.join(hot, ["_a", "_b"], "left_anti"), seen.join(hot, ["_a", "_b"], "left_anti"))
    return rest.unionByName(verified(rows.join(hot, ["_a", "_b"], "left_semi"), True))


def collapse(df: DataFrame, key: str, rule: CopyRule, scratch: Scratch) -> DataFrame:
    """One record a set of copies (the one with the smallest key), all columns, with the column copies (1 if alone); it
    gets leading underscores if df has one of that name. Rows with a null key stay, alone."""
    name = "copies"
    while name in df.columns:
        name = f"_{name}"
    c = scratch.write(copies(df, key, rule, scratch), "copies")
    dropped = c.filter("id <> rep_id").select(F.col("id").alias(key))
    counts = c.filter("id = rep_id").select(F.col("id").alias(key), F.col("copies").alias(name))
    return df.join(dropped, key, "left_anti").join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(1)))
