"""Texts, sized in tokens, assigned to containers of fixed capacity."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Where the public vocabulary files are, and the one in use.
TOKENIZER_DIR, TOKENIZER = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The split pattern the vocabulary was made with (public, of the byte-level BPE of 2019). Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows packed together by one task: large enough that a group's last, half-empty container hardly counts.
GROUP_ROWS = 20_000


def token_counter(path: str):
    """text -> number of tokens. Texts are encoded whole: the tokenizer's time stays in proportion to the length of a word."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        return len(enc.encode_ordinary(text))

    return count


def token_sizes(df: DataFrame, key: str, text: str, tokenizer: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """key, n_tokens; a null text has 0. Texts leave the scan once and only two numbers a row come back."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(tokenizer)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "n_tokens": [0 if x is None else count(x) for x in b["x"]]})

    schema = T.StructType([T.StructField("k", kind), T.StructField("n_tokens", T.LongType())])
    out = df.select(F.col(key).alias("k"), F.col(text).alias("x")).mapInPandas(run, schema)
    return out.withColumnRenamed("k", key)


#: What a bin costs beside the tokens it leaves unused, in tokens.
BIN_COST = 8


class BestFit:
    """Best fit over bins of several permitted capacities, for items whose sizes are all known.

    `free` has one bit for each remaining space that an open bin has, so the tightest bin that takes an item is the
    lowest set bit from the item's size on. If none fits, a bin is opened. Its capacity is the one that costs least for
    each token it will hold: the cost of a bin is the space it leaves unused, as far as the items still to come can fill
    it (largest first), and `bin_cost`.
    """

    def __init__(self, capacities: list[int], sizes: list[int], bin_cost: int = BIN_COST):
        self.capacities, self.bin_cost = sorted(capacities), bin_cost
        self.bins: list[int] = []
        self.opened: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(self.capacities[-1] + 1)]
        self.free = 0
        # How many items of each size are to come, and a bit for each size there is.
        self.to_come = [0] * (self.capacities[-1] + 1)
        for x in sizes:
            self.to_come[x] += 1
        self.have = sum(1 << x for x, n in enumerate(self.to_come) if n and x)

    def filled(self, space: int) -> int:
        """How much of a space the items to come can fill, the largest that fits first."""
        left, below = space, self.have
        while left and (below := below & (2 << left) - 1):
            x = below.bit_length() - 1
            left -= x * min(self.to_come[x], left // x)
            below ^= 1 << x
        return space - left

    def cheapest(self, size: int) -> int:
        def cost(c: int) -> tuple[float, int]:
            more = self.filled(c - size)
            return (c - size - more + self.bin_cost) / max(1, size + more), -c

        return min((c for c in self.capacities if c >= size), key=cost)

    def put(self, size: int) -> int:
        self.to_come[size] -= 1
        if not self.to_come[size]:
            self.have &= ~(1 << size)
        rest = self.free >> size
        if rest:
            space = size + (rest & -rest).bit_length() - 1
            b = self.at[space].pop()
            if not self.at[space]:
                self.free &= ~(1 << space)
        else:
            space = self.cheapest(size)
            b = len(self.bins)
            self.bins.append(0)
            self.opened.append(space)
        self.bins[b] += size
        space -= size
        self.at[space].append(b)
        self.free |= 1 << space
        return b

    def downsized(self, b: int) -> int:
        return next(c for c in self.capacities if c >= self.bins[b])


def pack(sizes: DataFrame, key: str, n: str = "n_tokens", capacities: tuple[int, ...] = (512, 1024, 2048, 4096), group_rows: int = GROUP_ROWS) -> DataFrame:
    """container_id, capacity, used, key, part, n_parts, first_token, n_tokens: one row for each part of each row.

    Rows with up to the largest capacity are never divided. A longer one is cut at each full capacity: those pieces fill
    containers of their own, what is left is packed as an item. Rows are spread by hash over groups of about
    `group_rows`, each packed by one task: largest item first, best fit, jointly over the permitted capacities, each bin opened at the least cost; in the
    end each container gets the smallest capacity that holds its contents. The number of groups follows the number of
    rows, so no task has more than about a group. Rows of size 0 or null go to the fullest container that is open, with
    n_tokens 0. Keys should be unique; repeated keys are packed as rows of their own. Empty table: no rows.
    """
    top = max(capacities)
    groups = max(1, -(-sizes.count() // group_rows))
    kind = sizes.schema[key].dataType
    g = sizes.select(F.col(key).alias("_k"), F.coalesce(F.col(n).cast("bigint"), F.lit(0)).alias("_n")).withColumn("_g", F.pmod(F.xxhash64("_k", "_n"), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_n", "_k"], kind="stable")
        number, out, items = int(pdf["_g"].iloc[0]) << 32, [], []
        fixed = 0
        for k, size in zip(pdf["_k"].tolist(), pdf["_n"].tolist()):
            whole, rest = divmod(size, top) if size > top else (0, size)
            parts = whole + (rest > 0 or whole == 0)
            for i in range(whole):
                out.append((number + fixed, top, top, k, i, parts, i * top, top))
                fixed += 1
            if parts > whole:
                items.append((rest, k, whole, parts))
        fit = BestFit(list(capacities), [x[0] for x in items])
        placed = [(fit.put(x[0]), x) for x in sorted(items, key=lambda x: -x[0])]
        for b, (size, k, i, parts) in placed:
            out.append((number + fixed + b, fit.downsized(b), fit.bins[b], k, i, parts, i * top, size))
        return pd.DataFrame(out, columns=["container_id", "capacity", "used", "_k", "part", "n_parts", "first_token", "n_tokens"])

    fields = [T.StructField(c, T.LongType()) for c in ("container_id", "capacity", "used")] + [T.StructField("_k", kind)]
    fields += [T.StructField(c, T.LongType()) for c in ("part", "n_parts", "first_token", "n_tokens")]
    return g.groupBy("_g").applyInPandas(run, T.StructType(fields)).withColumnRenamed("_k", key)
