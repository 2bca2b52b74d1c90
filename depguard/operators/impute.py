"""Missing values filled by chained equations, each filled value marked.

Each incomplete field has one equation that predicts it from the others: a classifier (conditional frequencies, backing
off from one set of predictors to the next) or a regression (normal equations over group means and numbers). Equations
are fitted by distributed aggregates on rows whose own value is observed, and applied in turn for some rounds; later
equations and rounds see what earlier ones filled.

What complete records say is counted once. Only the rows with a gap in a field in use go through the rounds, so a round
costs what the gaps cost, not what the table does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from depguard.plans.skew import hot_keys, spread_join
from depguard.session import Scratch

#: Words written in place of a value. Fixed values.
STAND_INS = (
    "n/a", "na", "n.a", "n a", "none", "null", "nil", "nan", "unknown", "unk", "not available", "not given", "not known",
    "not applicable", "not specified", "not provided", "not stated", "not recorded", "not entered", "unspecified",
    "undefined", "missing", "tbd", "tba", "tbc", "to be determined", "to be announced", "blank", "empty", "no data",
    "no value", "no entry", "no city", "no information", "no answer", "nothing", "pending", "void", "default", "dummy",
    "test", "same", "ditto", "various", "other", "city", "error", "#n/a", "#ref", "not sure", "do not know", "dont know",
)


def real_name(c: Column) -> Column:
    """Not null, holds letters, isn't one letter repeated, and isn't a stand-in (case and outer signs don't matter)."""
    bare = F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}#]+|[^\p{L}\p{N}]+\z", ""))
    letters = F.regexp_like(bare, F.lit(r"\p{L}")) & ~F.regexp_like(bare, F.lit(r"^(\p{L})\1+\z"))
    return F.coalesce(letters & ~bare.isin(*STAND_INS), F.lit(False))


def real_code(c: Column, digits: int = 6) -> Column:
    """Exactly so many digits 0-9, not all the same."""
    return F.coalesce(F.regexp_like(c, F.lit(f"^[0-9]{{{digits}}}\\z")) & ~F.regexp_like(c, F.lit(r"^([0-9])\1*\z")), F.lit(False))


@dataclass(frozen=True)
class Category:
    """field from sets of other fields, the one that decides first: ("zip",), or (("zip",), ("hname",)).

    draw: the numbers of the sets (True: all) for which a value is drawn by its share among similar records, which keeps
    how varied the field is; for the others the most frequent value is taken (the smallest on a tie).
    """

    field: str
    by: tuple
    draw: bool | tuple[int, ...] = False

    @property
    def sets(self) -> list[tuple[str, ...]]:
        return [self.by] if isinstance(self.by[0], str) else list(self.by)

    def draws(self, i: int) -> bool:
        return self.draw is True or (self.draw is not False and i in self.draw)

    @property
    def predictors(self) -> list[str]:
        return [c for s in self.sets for c in s]


@dataclass(frozen=True)
class Number:
    """field by a linear regression on the field's means by each of `by` and on the numeric columns `on`; noise of the
    size of the residuals is added, seeded by the key."""

    field: str
    by: tuple[str, ...] = ()
    on: tuple[str, ...] = ()
    noise: bool = True

    @property
    def sets(self) -> list[tuple[str, ...]]:
        return [(*self.by, *self.on)]

    @property
    def predictors(self) -> list[str]:
        return [*self.by, *self.on]


def _uniform(key: str, tag: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(tag), F.col(key).cast("string")), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


class _Chain:
    """The state of a run. Fields have numbers: v3 is the value of field 3, m3 says that it was missing at first, r3 how
    it was filled (the number of the set of predictors, plus the number of sets if filled values took part); k is the key."""

    def __init__(self, base: DataFrame, used: list[str], equations: list, scratch: Scratch):
        self.at, self.scratch = {f: i for i, f in enumerate(used)}, scratch
        n = range(len(used))
        self.base, self.rows = base, base.count()
        self.whole = _all([F.col(f"v{i}").isNotNull() for i in n])
        self.open = scratch.write(base.filter(~self.whole).select("k", *(f"v{i}" for i in n), *(F.col(f"v{i}").isNull().alias(f"m{i}") for i in n), *(F.lit(None).cast("int").alias(f"r{i}") for i in n)), "open")
        self.fits: dict = {}
        self.sets = [(e, i) for e in equations if isinstance(e, Category) for i in range(len(e.sets))]
        self.counts = self.counted() if self.sets else None
        self.done: set[str] = set()

    def v(self, fields) -> list[str]:
        return [f"v{self.at[f]}" for f in fields]

    def filled(self, fields) -> Column:
        return _any([F.col(f"m{self.at[f]}") for f in fields])

    def known(self, fields) -> Column:
        return _all([F.col(c).isNotNull() for c in self.v(fields)])

    def advance(self, following: DataFrame) -> None:
        before, self.open = self.open, self.scratch.write(following.select(*self.open.columns), "open")
        self.scratch.drop(before)

    # -- classifiers ---------------------------------------------------------------------------------------------------

    def predictions(self, counts: DataFrame, by: list[str], v: str, draw: bool) -> DataFrame:
        """by.., fill, n (and _lo, _hi, _step of a draw) from counts (by.., v, n); n is of all records, null values never
        fill."""
        if not draw:
            best = F.min(F.when(F.col(v).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(v).alias("v"))))
            return counts.groupBy(*by).agg(best["v"].alias("fill"), F.sum("n").alias("n"))
        # Each value owns an interval of [0, 1); intervals are cut at 64 steps, so a row meets only the values of its step.
        w = Window.partitionBy(*by)
        upto, n = F.sum("n").over(w.orderBy(F.desc("n"), v).rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(w)
        shares = counts.filter(F.col(v).isNotNull()).select(*by, F.col(v).alias("fill"), "n", ((upto - F.col("n")) / n).alias("_lo"), (upto / n).alias("_hi"))
        steps = F.sequence(F.floor(F.col("_lo") * 64).cast("int"), F.least(F.lit(63), F.floor(F.col("_hi") * 64)).cast("int"))
        return shares.withColumn("_step", F.explode(steps))

    def counted(self) -> DataFrame:
        """s, k0.., v, n: for each set of predictors (by its number) the records by value of the predictors, all known, and of
        the field. One scan counts for all sets; values are kept as text there."""
        width = max(len(e.sets[i]) for e, i in self.sets)
        text = lambda c: F.col(c).cast("string")
        each = []
        for s, (e, i) in enumerate(self.sets):
            by = self.v(e.sets[i])
            row = [F.lit(s).alias("s"), *((text(by[j]) if j < len(by) else F.lit(None).cast("string")).alias(f"k{j}") for j in range(width)), text(f"v{self.at[e.field]}").alias("v")]
            each.append(F.when(self.known(e.sets[i]), F.struct(*row)))
        rows = self.base.select(F.inline(F.array_compact(F.array(*each))))
        return self.scratch.write(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "counts")

    def fit(self, e: Category, i: int) -> tuple[DataFrame, DataFrame | None]:
        """Predictions from the records whose value and predictors are all observed, and the hot combinations of predictors
        (see plans.skew), of all records that have one; both are the same in every round."""
        if (e, i) not in self.fits:
            by, v = self.v(e.sets[i]), f"v{self.at[e.field]}"
            kind, own = dict(self.base.dtypes), self.counts.filter(F.col("s") == self.sets.index((e, i)))
            counts = own.select(*(F.col(f"k{j}").cast(kind[c]).alias(c) for j, c in enumerate(by)), F.col("v").cast(kind[v]).alias(v), "n")
            table = self.scratch.write(self.predictions(counts, by, v, e.draws(i)), "fit")
            # A draw is met by combination and step: a hot combination is spread over its steps as it is.
            hot = None if e.draws(i) else hot_keys(table, by, "n", self.rows)
            self.fits[e, i] = table.drop("n").filter(F.col("fill").isNotNull()), hot
        return self.fits[e, i]

    def fill_category(self, e: Category, key_tag: str) -> None:
        """The missing values of a field, predicted by the first set of predictors that has an answer: first the sets that
        are observed and met by observed records, then those with filled values. A record with filled predictors is asked
        only for combinations that no observed one has. Only rows to be filled are joined."""
        f, sets = self.at[e.field], e.sets
        need = self.open.filter(F.col(f"m{f}"))
        ranks = []
        for i, cols in enumerate(sets):
            by = self.v(cols)
            table, hot = self.fit(e, i)
            both = table.withColumn("sure", F.lit(True))
            if self.done.intersection(cols):  # else no record has a filled predictor yet
                own = self.open.filter(~F.col(f"m{f}") & self.known(cols) & self.filled(cols)).groupBy(*by, f"v{f}").agg(F.count("*").alias("n"))
                own = self.predictions(own, by, f"v{f}", e.draws(i)).drop("n").join(table.select(*by).distinct() if e.draws(i) else table.select(*by), by, "left_anti")
                both = both.unionByName(own.withColumn("sure", F.lit(False)))
            both = both.withColumnsRenamed({"fill": f"f{i}", "sure": f"s{i}"})
            if e.draws(i):
                u = _uniform("k", f"{key_tag} {e.field} {i}")
                both = both.withColumnsRenamed({c: f"_{c}" for c in by})
                on = (F.floor(u * 64).cast("int") == F.col("_step")) & (u >= F.col("_lo")) & (u < F.col("_hi")) & _all([F.col(c) == F.col(f"_{c}") for c in by])
                need = need.join(both, on, "left").drop("_step", "_lo", "_hi", *(f"_{c}" for c in by))
            else:
                need = spread_join(need, both, by, hot)
            ranks.append(F.when(F.col(f"f{i}").isNotNull(), F.when(F.col(f"s{i}") & ~self.filled(cols), i).otherwise(len(sets) + i)))
        best = F.array_min(F.array_compact(F.array(*ranks)))
        value = F.coalesce(*(F.when(best == r, F.col(f"f{i}")) for i, r in enumerate(ranks)))
        self.advance(need.withColumns({f"r{f}": best, f"v{f}": value}).select(*self.open.columns).unionByName(self.open.filter(~F.col(f"m{f}"))))

    # -- regressions ---------------------------------------------------------------------------------------------------

    def cells(self, rows: DataFrame, e: Number) -> DataFrame:
        """Sums of the observed values and of `on` by combination of `by`: all that a regression needs of the rows."""
        y, x = F.col(f"v{self.at[e.field]}"), [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.v(e.on)]
        sums = {"n": F.count("*"), "y": F.sum(y), "yy": F.sum(y * y)}
        sums |= {f"x{i}": F.sum(a) for i, a in enumerate(x)} | {f"xy{i}": F.sum(a * y) for i, a in enumerate(x)}
        sums |= {f"x{i}x{j}": F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))}
        return rows.groupBy(*self.v(e.by)).agg(*(c.alias(n) for n, c in sums.items()))

    def fill_number(self, e: Number, key_tag: str) -> None:
        """The missing values of a field by its regression. The driver gets the normal equations, a few dozen numbers."""
        f, by = self.at[e.field], self.v(e.by)
        if e not in self.fits:
            self.fits[e] = self.scratch.write(self.cells(self.base.filter(self.whole), e), "cells")
        cells = self.scratch.write(self.fits[e].unionByName(self.cells(self.open.filter(~F.col(f"m{f}")), e)), "cells")
        got = cells.agg(F.sum("y"), F.sum("n")).first()
        if not got[1]:
            return
        mean = got[0] / got[1]
        need, j, phi = self.open.filter(F.col(f"m{f}")), cells, []
        for i, g in enumerate(by):
            m = cells.filter(F.col(g).isNotNull()).groupBy(g).agg(F.sum("n").alias("_n"), ((F.sum("y") + mean * 5) / (F.sum("n") + 5) - mean).alias(f"_m{i}"))
            hot = hot_keys(m, [g], "_n", got[1])
            need, j = (spread_join(d, m.drop("_n"), [g], hot) for d in (need, j))
            phi.append(F.coalesce(F.col(f"_m{i}"), F.lit(0.0)))
        # Features: 1, the group means, the numbers. Sums of their products over rows come from the cells' sums.
        k, p = len(phi) + 1 + len(e.on), [F.lit(1.0), *phi]
        xx = {}
        for a in range(k):
            for b in range(a, k):
                if b < len(p):
                    xx[a, b] = p[a] * p[b] * F.col("n")
                elif a < len(p):
                    xx[a, b] = p[a] * F.col(f"x{b - len(p)}")
                else:
                    xx[a, b] = F.col(f"x{a - len(p)}x{b - len(p)}")
        xy = [c * F.col("y") for c in p] + [F.col(f"xy{i}") for i in range(len(e.on))]
        sums = j.agg(*(F.sum(c) for c in xx.values()), *(F.sum(c) for c in xy), F.sum("yy")).first()
        lhs = np.zeros((k, k))
        for (a, b), value in zip(xx, sums):
            lhs[a, b] = lhs[b, a] = value
        rhs, yy = np.array(sums[len(xx) : len(xx) + k]), sums[len(xx) + k]
        beta = np.linalg.lstsq(lhs + 1e-9 * np.eye(k), rhs, rcond=None)[0]
        sigma = float(np.sqrt(max(0.0, (yy - 2 * beta @ rhs + beta @ lhs @ beta) / max(1, got[1] - k))))
        x = [*p, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.v(e.on))]
        guess = reduce(lambda a, b: a + b, (c * float(w) for c, w in zip(x, beta)))
        if e.noise:
            u, v = _uniform("k", f"{key_tag} u {e.field}"), _uniform("k", f"{key_tag} v {e.field}")
            guess = guess + F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v) * sigma
        own = self.filled(e.predictors).cast("int")
        self.advance(need.withColumns({f"v{f}": guess, f"r{f}": own}).select(*self.open.columns).unionByName(self.open.filter(~F.col(f"m{f}"))))


def chained_imputation(df: DataFrame, key: str, equations: list, real: dict[str, Column], scratch: Scratch, rounds: int = 2) -> DataFrame:
    """df with filled fields and, for each field of an equation or of `real`, field_missing, field_filled and field_by.

    real: for a field, the test of what counts as a value (default: not null); what fails it is missing and null at first.
    Every round applies the equations in turn, and predicts each missing value anew from what its predictors hold by then;
    observed values never change. field_by names the predictors a value was filled by, as `zip` or `city,state`, with a
    leading ~ if a filled value took part (in the row's predictors or, where no observed record has them, in the
    records). A value from observed predictors comes before any other and is the same in every round. Rows that nothing
    resembles stay null with field_filled false. A column of df that has one of the marks' names is replaced.

    A field has one equation at most. key must be unique; a row with a null key is kept, its gaps marked and not filled.
    Regressed fields become doubles. Repeated rows count as often as they occur; an empty table gives an empty one.
    """
    targets = [e.field for e in equations]
    if len(set(targets)) < len(targets):
        raise ValueError("a field has one equation: name several sets of predictors in it")
    fields = list(dict.fromkeys([*real, *targets]))
    used = list(dict.fromkeys([*fields, *(c for e in equations for c in e.predictors)]))
    numbers = {e.field for e in equations if isinstance(e, Number)}
    ok = {f: F.coalesce(real[f], F.lit(False)) if f in real else F.col(f).isNotNull() for f in used}
    value = {f: F.when(ok[f], F.col(f).cast("double") if f in numbers else F.col(f)) for f in used}
    chain = _Chain(df.select(F.col(key).alias("k"), *(value[f].alias(f"v{i}") for i, f in enumerate(used))), used, equations, scratch)
    for _ in range(rounds):
        for e in equations:
            (chain.fill_number if isinstance(e, Number) else chain.fill_category)(e, "draw")
            chain.done.add(e.field)
    marks = [f"{f}_{m}" for f in fields for m in ("missing", "filled", "by")]
    out = chain.open.select(F.col("k").alias("__k"), *(F.col(f"{c}{chain.at[f]}").alias(f"__{c}{chain.at[f]}") for f in targets for c in "vr")).filter(F.col("__k").isNotNull())

    def marked(rows: DataFrame, whole: bool) -> DataFrame:
        cols = {}
        for f in fields:
            i = chain.at[f]
            new = F.lit(None) if whole or f not in targets else F.col(f"__v{i}")
            names = [",".join(s) for e in equations if e.field == f for s in e.sets]
            names = F.element_at(F.array(*map(F.lit, [*names, *("~" + n for n in names)])), F.col(f"__r{i}") + 1) if names and not whole else F.lit(None).cast("string")
            missing = F.lit(False) if whole else ~ok[f]
            cols[f] = value[f] if whole or f not in targets else F.coalesce(value[f], new)
            cols[f"{f}_missing"], cols[f"{f}_filled"] = missing, F.lit(False) if whole else missing & new.isNotNull()
            cols[f"{f}_by"] = F.when(cols[f"{f}_filled"], names)
        return rows.select(*(c for c in df.columns if c not in cols), *(c.alias(n) for n, c in cols.items())).select(*(c for c in df.columns if c not in marks), *marks)

    # Rows without a gap don't meet the others again.
    gap = ~_all([ok[f] for f in used])
    return marked(df.filter(~gap), True).unionByName(marked(df.filter(gap).join(out, F.col(key) == F.col("__k"), "left"), False))
