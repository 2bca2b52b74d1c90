"""Test passages inside training texts: size-partitioned MinHash containment search, verified by exact passages."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from depguard.plans.skew import fragment_join, hot_cuts, hot_join, hot_keys
from depguard.session import Scratch

#: A passage of so many consecutive words of an item is a leak; shingles have so many words, so a passage has eight of them.
PASSAGE, SHINGLE = 12, 5
WITHIN = PASSAGE - SHINGLE + 1
#: The words of a window, the largest set that a passage is searched in, and the chance at most that a passage in one of
#: that size is missed by all hash functions.
WINDOW, MISS = 20, 1e-6
#: Texts are read in steps of so many characters and searched in lots of so many words, however long they are.
STEP, LOT = 1 << 20, 1 << 20
#: Bits of the filters that workers hold, at most: 16 MB for signatures, 2 MB for words.
SIGNATURE_BITS, WORD_BITS = 1 << 27, 1 << 24

_COMMAND, _WORD = re.compile(r"\\[^\W\d_]*\*?"), re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, after each backslash with the letters behind it (and a *) is dropped."""
    return _WORD.findall(_COMMAND.sub("", text).lower())


def word_steps(text: str) -> Iterator[list[str]]:
    """The words of a text, in steps that end between words and outside commands."""
    at = 0
    while at < len(text):
        end = min(len(text), at + STEP)
        while end < len(text) and not text[end].isspace():
            end += 1
        yield words(text[at:end])
        at = end


def functions_for(size: int) -> int:
    """Hash functions for windows of `size` shingles. A passage in one has a similarity of 8/size at least: that is the
    threshold of the size class, and so many functions, each a band of its own, miss it with a chance of MISS at most."""
    return 1 if size <= WITHIN else math.ceil(math.log(MISS) / math.log(1 - WITHIN / size))


_FUNCTIONS = functions_for(WINDOW - SHINGLE + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(ids: np.ndarray) -> np.ndarray:
    """The hash of each run of SHINGLE words."""
    h = np.zeros(max(0, len(ids) - SHINGLE + 1), dtype=np.uint64)
    for j in range(SHINGLE):
        h = _mix(h * np.uint64(3) + ids[j : len(ids) - SHINGLE + 1 + j])
    return h


def signatures(sets: np.ndarray, functions: int) -> np.ndarray:
    """sets: one row of shingle hashes each. The MinHash of each row by each function, the function's number mixed in.

    A shingle that occurs twice in a row counts as two different ones (with its number among its equals), so that a
    passage of repeated words is as similar to its window as any other.
    """
    order = np.sort(sets, axis=1)
    again = np.flatnonzero((order[:, 1:] == order[:, :-1]).any(axis=1))
    if len(again):
        rows = sets[again]
        nth = np.stack([(rows[:, :j] == rows[:, j : j + 1]).sum(axis=1) for j in range(rows.shape[1])], axis=1).astype(np.uint64)
        sets = sets.copy()
        sets[again] = np.where(nth > 0, _mix(rows + nth * np.uint64(0x9E3779B97F4A7C15)), rows)
    out = np.empty((len(sets), functions), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(functions):
            seed = np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            out[:, i] = _mix(_mix(sets ^ seed).min(axis=1) + seed)
    return out


def _id(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


class Filter:
    """A set of 64-bit hashes as bits, two for each: says yes to all its members and to a few others."""

    def __init__(self, table: DataFrame, h: str, most: int):
        """From the distinct column `h` of a table. The number of bits follows its rows up to `most`, so what is collected
        and broadcast has that bound; beyond it the filter lets more through, which costs time and no result."""
        n = table.count()
        self.bits = min(most, max(1 << 10, 1 << (16 * n).bit_length()))
        bits = table.selectExpr(f"explode(array({h} & {self.bits - 1}L, shiftrightunsigned({h}, 37) & {self.bits - 1}L)) AS i")
        lots = bits.selectExpr("shiftright(i, 6) AS w", "shiftleft(1L, CAST(i & 63L AS INT)) AS b")
        got = lots.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        self.lots = np.zeros(self.bits >> 6, dtype=np.uint64)
        self.lots[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64).view(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = self._bit(h & np.uint64(self.bits - 1)), self._bit(h >> np.uint64(37) & np.uint64(self.bits - 1))
        return (a & b).astype(bool)

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return self.lots[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)


class WordIds(dict):
    """word -> its hash, 0 if no item can have it."""

    def __init__(self, known: Filter):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = _id(word)
        self[word] = h = h if self.known.has(np.array([h], dtype=np.uint64))[0] else 0
        return h


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the windows of a sequence of word ids. A run without a 0 is cut so that every passage in it lies
    in exactly one window; the last window of a run is shorter, down to one passage, so windows have sizes of 8 to 16
    shingles."""
    gaps = np.flatnonzero(ids == 0)
    first, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(ids)]])
    starts = np.maximum(0, end - first - PASSAGE + 1)
    step = WINDOW - PASSAGE + 1
    n = -(-starts // step)
    run = np.repeat(np.arange(len(n)), n)
    at = first[run] + (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)) * step
    return at, np.minimum(WINDOW, end[run] - at)


def _passages(items: DataFrame, key: str, text: str) -> DataFrame:
    """item_id, p (the words of a passage), sig (its signature), w (hashes of words): one row for each different passage of
    each item; w has a passage's first word, and all of the last passage's, so all words occur."""
    kind = items.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x in zip(b["k"], b["x"]):
                ws = [] if x is None else words(x)
                if len(ws) < PASSAGE:
                    continue
                ids = np.array([_id(w) for w in ws], dtype=np.uint64)
                sig = signatures(np.lib.stride_tricks.sliding_window_view(shingles(ids), WITHIN), _FUNCTIONS).view(np.int64)
                own: dict[str, tuple] = {}
                for i in range(len(sig)):
                    last = i == len(sig) - 1
                    p = " ".join(ws[i : i + PASSAGE])
                    seen = own.get(p)
                    w = ids[i : i + (PASSAGE if last else 1)].view(np.int64).tolist()
                    own[p] = (k, p, sig[i].tolist(), w + (seen[3] if seen else []))
                rows += own.values()
            yield pd.DataFrame(rows, columns=["item_id", "p", "sig", "w"])

    fields = [T.StructField("item_id", kind), T.StructField("p", T.StringType()), T.StructField("sig", T.ArrayType(T.LongType())), T.StructField("w", T.ArrayType(T.LongType()))]
    return items.select(F.col(key).alias("k"), F.col(text).alias("x")).mapInPandas(run, T.StructType(fields))


def _candidates(docs: DataFrame, key: str, text: str, known: Filter, signed: Filter) -> DataFrame:
    """k, at, words, sig: the windows of the documents of which a signature may be an item's, with the signatures that may."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    shared = spark.sparkContext.broadcast((known, signed))

    def lot(keys: list, froms: list[int], texts: list[str], ids: list[int]) -> pd.DataFrame:
        """Windows of one lot: documents' words one after the other, with a 0 between; keys and starts of the documents."""
        every, parts = np.array(ids, dtype=np.uint64), []
        at, length = windows(every)
        hashes, signed = shingles(every), shared.value[1]
        for n in np.unique(length):
            own, size = at[length == n], n - SHINGLE + 1
            sig = signatures(hashes[own[:, None] + np.arange(size)], functions_for(int(size)))
            hit = signed.has(sig)
            for i in np.flatnonzero(hit.any(axis=1)):
                d = int(np.searchsorted(froms, own[i], "right")) - 1
                parts.append((keys[d][0], keys[d][1] + int(own[i]) - froms[d], " ".join(texts[own[i] : own[i] + n]), sig[i][hit[i]].view(np.int64).tolist()))
        return pd.DataFrame(parts, columns=["k", "at", "words", "sig"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = WordIds(shared.value[0])
        for b in batches:
            keys, froms, texts, ids = [], [], [], []
            for k, x in zip(b["k"], b["x"]):
                if x is None:
                    continue
                keys.append((k, 0))
                froms.append(len(ids))
                for ws in word_steps(x):
                    texts += ws
                    ids += [get[w] for w in ws]
                    if len(ids) > LOT:
                        yield lot(keys, froms, texts, ids)
                        # The last words of the text begin the next lot: passages that end there haven't been searched.
                        done = len(ids) - froms[-1]
                        tail = min(done, PASSAGE - 1)
                        keys, froms, texts, ids = [(k, keys[-1][1] + done - tail)], [0], texts[len(texts) - tail :], ids[len(ids) - tail :]
                texts.append("")
                ids.append(0)
            yield lot(keys, froms, texts, ids)

    fields = [T.StructField("k", kind), T.StructField("at", T.LongType()), T.StructField("words", T.StringType()), T.StructField("sig", T.ArrayType(T.LongType()))]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("x")).mapInPandas(run, T.StructType(fields))


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, scratch: Scratch | None = None) -> DataFrame:
    """key, item_id, passages, contained: documents that hold at least PASSAGE consecutive words of an item, the number
    of matching passages (as often as they occur) and the share of the item's different passages that are among them.

    A query is a passage of an item, a set of eight shingles. A domain is a window of a document: the runs of words that
    items have, cut to 20 words. Domains are partitioned by size; the size gives the similarity that a contained passage
    has at least, and that the number of hash functions (`functions_for`). Windows and passages that share the value of a
    function are joined by it; the passages of joined windows are then compared word by word, so nothing false is
    returned, and a passage is missed with a chance of MISS at most.

    Items are read by the workers like documents, and there is one pass over the documents however many there are. Only
    two filters of bounded size go through the driver: of the items' words and of their signatures. Hot values are
    broadcast or split (plans.skew). Null or short texts on either side leak nothing. Keys of documents and items should
    be unique. No items or documents: no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    own = scratch.write(_passages(items, item_key, item_text), "passages")
    sig = scratch.write(own.select(F.explode("sig").alias("h")).distinct(), "signatures")
    known = own.select(F.explode("w").alias("h")).distinct()
    found = scratch.write(_candidates(docs, key, text, Filter(known, "h", WORD_BITS), Filter(sig, "h", SIGNATURE_BITS)), "windows")
    bands = found.select("k", "at", F.explode("sig").alias("h"))
    loads = bands.groupBy("h").agg(F.count("*").alias("n"))
    met = hot_join(bands, sig, ["h"], hot_keys(loads, ["h"], "n", bands.count()), "left_semi").select("k", "at").distinct()
    ws = F.split("words", " ")
    grams = F.transform(F.sequence(F.lit(1), F.size(ws) - PASSAGE + 1), lambda i: F.array_join(F.slice(ws, i, PASSAGE), " "))
    held = found.join(met, ["k", "at"], "left_semi").select("k", F.explode(grams).alias("p")).groupBy("k", "p").agg(F.count("*").alias("n"))
    held = scratch.write(held, "held")
    cuts = hot_cuts(held.groupBy("p").agg(F.count("*").alias("n")), ["p"], "n", held.count())
    j = fragment_join(held, own.select("p", "item_id"), ["p"], cuts, F.xxhash64("k"))
    different = own.groupBy("item_id").agg(F.count("*").alias("all"))
    out = j.groupBy("k", "item_id").agg(F.sum("n").alias("passages"), F.count("*").alias("mine"))
    return out.join(different, "item_id").select(F.col("k").alias(key), "item_id", "passages", (F.col("mine") / F.col("all")).alias("contained"))
