"""Freely typed places mapped to a reference list by a BK-tree under a true edit metric."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from depguard.plans.skew import hot_join, hot_keys
from depguard.session import Scratch

#: Short forms of the first word of a name. Fixed values.
FIRST = {
    "n": ("north", "new"), "nth": ("north",), "no": ("north",), "nrth": ("north",), "s": ("south", "saint"), "sth": ("south",),
    "so": ("south",), "e": ("east",), "est": ("east",), "w": ("west",), "wst": ("west",), "st": ("saint",), "snt": ("saint",),
    "ste": ("saint",), "ft": ("fort",), "frt": ("fort",), "mt": ("mount",), "mnt": ("mount",), "lk": ("lake",), "l": ("lake", "lower"),
    "pt": ("port",), "prt": ("port",), "p": ("port",), "nw": ("new",), "up": ("upper",), "upr": ("upper",), "u": ("upper",),
    "lr": ("lower",), "lwr": ("lower",), "lo": ("lower",), "low": ("lower",), "gt": ("great",), "grt": ("great",), "gr": ("great",),
    "g": ("great",), "f": ("fort",), "m": ("mount",),
}
#: Short forms of the last word. Fixed values.
LAST = {"fls": "falls", "fl": "falls", "spr": "springs", "spgs": "springs", "sprs": "springs", "spg": "springs", "hth": "heath", "by": "bay", "bch": "beach"}
#: Words put around a name that aren't part of it, longest first. Fixed values.
BEFORE = ("the city of", "the town of", "city of", "town of", "village of", "near to", "close to", "greater", "near", "nr", "in", "at", "the", "downtown", "central", "metro")
AFTER = ("old quarter", "old town", "city centre", "city center", "town centre", "and surroundings", "metro area", "area", "centre", "center", "downtown", "city", "town", "village", "region", "suburb", "suburbs", "district", "metro", "central", "outskirts")
#: Words typed where no place is meant, spaces left out. Fixed values.
NOWHERE = frozenset("na none null nil nan unknown blank empty test testtest home abroad various tbd tba asdf qwerty x xx xxx other same sameasabove notsure mytown elsewhere nowhere pending missing".split())
_LOOKS = str.maketrans("0135", "olse")


def fold(text: str) -> list[str]:
    """Words in lower case without accents and signs; full-width forms and digits inside words become letters."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    s = "".join(c for c in s if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("đ", "d")
    s = re.sub(r"(?<=[a-z])['’`´](?=[a-z])", "", s)
    return [w.translate(_LOOKS) if re.search(r"[a-z]", w) else w for w in re.findall(r"[a-z0-9]+", s)]


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with free later edits: insert, delete, replace, exchange neighbours. A metric."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    inf, last = n + m, {}
    d = [[inf] * (m + 2), [inf, *range(m + 1)]]
    for i in range(1, n + 1):
        row, above, x, at = [inf, i] + [0] * m, d[i], a[i - 1], 0
        for j in range(1, m + 1):
            y = b[j - 1]
            k, l = last.get(y, 0), at
            cost = 1
            if x == y:
                cost, at = 0, j
            best = above[j] + cost
            if row[j] + 1 < best:
                best = row[j] + 1
            if above[j + 1] + 1 < best:
                best = above[j + 1] + 1
            t = d[k][l] + (i - k - 1) + 1 + (j - l - 1)
            row[j + 1] = t if t < best else best
        d.append(row)
        last[x] = i
    return d[n + 1][m + 1]


def _codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(words), width), dtype=np.uint32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out, np.array([len(w) for w in words], dtype=np.int64)


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """`distance` of many pairs at once: codes of the words (a row each, padded) and their lengths. The recurrence runs
    over positions, each step for all pairs."""
    out = np.empty(len(a), dtype=np.int64)
    order = np.argsort(la * 1024 + lb)
    for part in np.array_split(order, max(1, -(-len(a) // 4096))):
        if not len(part):
            continue
        n, m, every = int(la[part].max()), int(lb[part].max()), np.arange(len(part))
        x, y = a[part, :n].T.copy(), b[part, :m].T.copy()
        d = np.full((n + 2, m + 2, len(part)), n + m, dtype=np.int16)
        d[1:, 1] = np.arange(n + 1, dtype=np.int16)[:, None]
        d[1, 1:] = np.arange(m + 1, dtype=np.int16)[:, None]
        row = np.zeros((m + 1, len(part)), dtype=np.int16)  # for each letter of b: the last row of a that has it
        for i in range(1, n + 1):
            same, at = x[i - 1] == y, np.zeros(len(part), dtype=np.int16)
            some = same.any()
            for j in range(1, m + 1):
                best = np.minimum(d[i, j] + ~same[j - 1], np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
                if some:
                    if j > 1 and at.any():
                        k = row[j]
                        np.minimum(best, d[k, at, every] + (i + j - 1 - k - at), out=best)
                    at[same[j - 1]] = j
                d[i + 1, j + 1] = best
            if some:
                row[1:][same] = i
        out[part] = d[la[part] + 1, lb[part] + 1, every]
    return out


class BKForest:
    """BK-trees under `distance`, kept as arrays and searched for many words at once.

    In a tree, all words below an edge of number e have distance e to the node it starts from. `within` returns every
    word of a tree within a radius: a subtree whose edge differs from the query's distance by more than the radius can't
    hold one (triangle inequality).
    """

    def __init__(self, trees: dict):
        """trees: name -> words."""
        each = [(t, w) for t, ws in trees.items() for w in sorted(ws)]
        self.words = [w for _, w in each]
        self.width = max(map(len, self.words), default=0)
        self.code, self.length = _codes(self.words, self.width)
        self.child = np.full((len(each), self.width + 1), -1, dtype=np.int64)
        self.root: dict = {}
        for i, (t, _) in enumerate(each):
            self.root.setdefault(t, i)
        # All trees grow by one level a round: the first word of each group becomes its node, the others part by distance.
        left = np.arange(len(each))
        group = np.array([self.root[t] for t, _ in each], dtype=np.int64) * (self.width + 1)
        while len(left):
            names, first, of = np.unique(group, return_index=True, return_inverse=True)
            nodes = left[first]
            inner = nodes != names // (self.width + 1)
            self.child[names[inner] // (self.width + 1), names[inner] % (self.width + 1)] = nodes[inner]
            keep = np.ones(len(left), dtype=bool)
            keep[first] = False
            left, own = left[keep], nodes[of[keep]]
            group = own * (self.width + 1) + distances(self.code[left], self.length[left], self.code[own], self.length[own])

    def within(self, asked: list[tuple]) -> list[list[tuple[int, str]]]:
        """For each (tree, word, radius) the (distance, word) pairs."""
        found: list[list[tuple[int, str]]] = [[] for _ in asked]
        fits = [i for i, (t, w, r) in enumerate(asked) if t in self.root and len(w) <= self.width + r]
        if not fits:
            return found
        code, length = _codes([asked[i][1] for i in fits], max(len(asked[i][1]) for i in fits))
        reach = np.array([asked[i][2] for i in fits], dtype=np.int64)
        q, node = np.arange(len(fits)), np.array([self.root[asked[i][0]] for i in fits], dtype=np.int64)
        while len(q):
            d = distances(code[q], length[q], self.code[node], self.length[node])
            for i in np.flatnonzero(d <= reach[q]):
                found[fits[q[i]]].append((int(d[i]), self.words[node[i]]))
            more_q, more = [], []
            for off in range(-int(reach.max()), int(reach.max()) + 1):
                edge = d + off
                ok = (abs(off) <= reach[q]) & (edge > 0) & (edge <= self.width)
                c = np.where(ok, self.child[node, np.where(ok, edge, 0)], -1)
                more_q.append(q[c >= 0])
                more.append(c[c >= 0])
            q, node = np.concatenate(more_q), np.concatenate(more)
        return found


def radius(word: str) -> int:
    """Edits allowed: none up to 3 letters, one up to 5, two beyond."""
    return 0 if len(word) <= 3 else 1 if len(word) <= 5 else 2


class Places:
    """The reference list, searchable: one tree a region and one over all. rows: (ref_id, city, state, state_name)."""

    def __init__(self, rows, regions=()):
        self.by_state: dict[str, dict[str, list[int]]] = {}
        self.everywhere: dict[str, list[int]] = {}
        self.codes, names = {}, {}
        for ref, city, state, name in rows:
            if city is None or not (word := "".join(fold(city))):
                continue
            code = "".join(fold(state or ""))
            self.by_state.setdefault(code, {}).setdefault(word, []).append(ref)
            self.everywhere.setdefault(word, []).append(ref)
        for state, name in [(r[2], r[3]) for r in rows] + list(regions):
            code = "".join(fold(state or ""))
            self.codes[code] = code
            if name:
                names["".join(fold(name))] = code
        self.names = names
        # Trees are named by the region's code, by None for the tree of all regions and by an empty tuple for the names.
        self.forest = BKForest({**self.by_state, None: self.everywhere, (): names})
        self.memo: dict[tuple, list[tuple[int, str]]] = {}
        self.asked: set[tuple] = set()

    def near(self, tree, word: str) -> list[tuple[int, str]]:
        """The words of a tree within the word's radius; what isn't known yet is noted in `asked`, to be searched with all
        else that is wanted."""
        got = self.memo.get((tree, word))
        if got is None:
            self.asked.add((tree, word))
            self.wanting = True
            return []
        return got

    def state(self, words: list[str], fuzzy: bool = True) -> str | None:
        """The region that the words name, by code or by name."""
        w = "".join(words)
        if w in self.codes:
            return w or None
        if w in self.names:
            return self.names[w]
        if fuzzy and len(w) > 4:
            near = sorted(self.near((), w))
            if near and (len(near) == 1 or near[0][0] < near[1][0]):
                return self.names[near[0][1]]
        return None

    @staticmethod
    def forms(words: list[str]) -> list[str]:
        """The spellings to look up: as typed, without words around the name, short forms written out."""
        lists, text = [words], " ".join(words)
        for _ in range(2):
            for b in BEFORE:
                if text.startswith(b + " "):
                    text = text[len(b) + 1 :]
                    lists.append(text.split())
                    break
            for a in AFTER:
                if text.endswith(" " + a):
                    text = text[: -len(a) - 1]
                    lists.append(text.split())
                    break
        out = []
        for ws in lists:
            heads = [ws]
            if len(ws) > 1 and ws[0] in FIRST:
                heads += [[f, *ws[1:]] for f in FIRST[ws[0]]]
            if len(ws) > 1 and ws[-1] in LAST:
                heads += [[*h[:-1], LAST[ws[-1]]] for h in heads]
            out += ["".join(h) for h in heads]
        return list(dict.fromkeys(x for x in out if x))

    def best(self, words: list[str], state: str | None) -> tuple[int, list[int]]:
        """The least distance and the reference rows at it, within the region if it is known."""
        if state and state not in self.by_state:
            return 99, []
        tree, table = (state, self.by_state[state]) if state else (None, self.everywhere)
        least, refs = 99, set()
        for w in self.forms(words):
            hits = [(0, w)] if w in table else self.near(tree, w)
            for d, own in hits:
                if d < least:
                    least, refs = d, set()
                if d == least:
                    refs.update(table[own])
        return least, sorted(refs)

    def find(self, pairs: list[tuple[str | None, str | None]]) -> list[tuple[int, int, list[int]]]:
        """For each (city, state) the least distance, the number of the first reading at it and its reference rows; no rows
        if none is meant. Pairs that fold alike are read once. What the readings ask of the trees is searched together."""
        if len(self.memo) > 500_000:
            self.memo.clear()
        folded = [(tuple(fold(c or "")), tuple(fold(s or ""))) for c, s in pairs]
        found, todo = {}, list(dict.fromkeys(folded))
        while todo:
            later = []
            for c, s in todo:
                self.wanting = False
                got = self._find(list(c), list(s))
                if self.wanting:
                    later.append((c, s))
                else:
                    found[c, s] = got
            ask = list(self.asked)
            self.asked.clear()
            self.memo.update(zip(ask, self.forest.within([(t, w, radius(w)) for t, w in ask])))
            todo = later
        return [found[f] for f in folded]

    def _find(self, c: list[str], s: list[str]) -> tuple[int, int, list[int]]:
        if "".join(c) in NOWHERE:
            c = []
        tries = []
        named = self.state(s) if s else None
        if c:
            tries.append((c, named))
        if s and (other := self.state(c, fuzzy=False)):
            tries.append((s, other))  # the fields stand in each other's place
        if named is None:
            for k in range(1, min(3, len(c) - 1) + 1):
                if inner := self.state(c[-k:]):
                    tries.append((c[:-k], inner))
        best: tuple[int, int, list[int]] = (99, 0, [])
        for no, (words, where) in enumerate(tries):
            got = self.best(words, where)
            if got[1] and got[0] < best[0]:
                best = (got[0], no, got[1])
        return best


#: Most reference rows in one shard, and about how many typed pairs one task looks up.
SHARD_ROWS, SPLIT_ROWS = 100_000, 20_000
_built: list[tuple[tuple, Places]] = []


def _places(rows: list[tuple], regions: list[tuple]) -> Places:
    """The trees of a shard, built once a worker for as long as it is asked for the same one."""
    if not _built or _built[0][0] != (rows, regions):
        _built[:] = [((rows, regions), Places(rows, regions))]
    return _built[0][1]


def _look(typed: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
    """One task's typed pairs against one shard of the list, which comes along."""
    if not len(typed):  # a split that only the list has
        return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("_c", object), ("_s", object), ("d", "int32"), ("no", "int32"), ("refs", object))})
    none = lambda v: None if pd.isna(v) else v
    every = [(none(r), none(c), none(s), none(n)) for r, c, s, n in zip(listed["ref_id"], listed["city"], listed["state"], listed["state_name"])]
    rows = sorted((r for r in every if r[0] is not None), key=lambda r: r[0])
    regions = sorted({r[2:] for r in every if r[0] is None}, key=str)
    got = _places(rows, regions).find([(c[1:] if c else None, s[1:] if s else None) for c, s in zip(typed["_c"], typed["_s"])])
    return pd.DataFrame({"_c": typed["_c"], "_s": typed["_s"], "d": [d for d, _, _ in got], "no": [n for _, n, _ in got], "refs": pd.Series([r for _, _, r in got], dtype=object, index=typed.index)})


def map_to_list(entries: DataFrame, key: str, city: str, state: str, ref: DataFrame, shard_rows: int = SHARD_ROWS, scratch: Scratch | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """key, ref_id for each entry that isn't, character by character, a pair of the list; -1 if it means none of them,
    or several equally.

    Distinct typed pairs are looked up once and joined back; pairs that hold a large part of the entries don't move (see
    plans.skew). ref has ref_id (not null), city, state and state_name (extra columns don't matter). The list is cut into
    shards of about `shard_rows` rows by hash of the city, the typed pairs into splits; a task gets a split and a shard
    and builds a tree for each region and one over all. Nothing of the list passes the driver. Each shard returns its
    entries at the least distance; the winners of the shards merge by distance, then by reading (city and state as typed,
    exchanged, the state behind the city), as in one shard. All regions' codes and names go with every shard. Null or
    empty cities and states name nothing. Entries with a null key are kept. An empty list maps every entry to -1.
    """
    spark, scratch = entries.sparkSession, scratch or Scratch(entries.sparkSession)
    ref = ref.select("ref_id", "city", "state", "state_name").filter(F.col("ref_id").isNotNull())
    whole = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731 - null apart from empty
    e = entries.select(F.col(key).alias("_key"), whole(city).alias("_c"), whole(state).alias("_s"))
    typed = scratch.write(e.groupBy("_c", "_s").agg(F.count("*").alias("n")), "typed")
    size, total = typed.agg(F.count("*"), F.sum("n")).first()
    listed = ref.count()
    shards = 1 if listed <= shard_rows else -(-2 * listed // shard_rows)
    splits = max(3 * spark.sparkContext.defaultParallelism, -(-size // split_rows))
    exact = ref.select(whole("city").alias("_c"), whole("state").alias("_s")).filter("_c <> '' and _s <> ''").distinct()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = typed.join(exact, ["_c", "_s"], "left_anti").select("_c", "_s", F.pmod(F.xxhash64("_c", "_s"), F.lit(splits)).cast("int").alias("_split"))
    asked = asked.withColumn("_shard", every(shards))
    rows = ref.withColumn("_shard", F.pmod(F.xxhash64("city"), F.lit(shards)).cast("int"))
    regions = ref.select(F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast("string").alias("city"), "state", "state_name").distinct().withColumn("_shard", every(shards))
    rows = rows.withColumn("ref_id", F.col("ref_id").cast("bigint")).unionByName(regions).withColumn("_split", every(splits))
    # The split is the partition: as many tasks as splits, each with its own rows.
    asked, rows = (x.repartitionById(splits, "_split") for x in (asked, rows))
    found = asked.groupBy("_split", "_shard").cogroup(rows.groupBy("_split", "_shard")).applyInPandas(_look, "_c string, _s string, d int, no int, refs array<bigint>")
    if shards > 1:
        found = found.groupBy("_c", "_s", "d", "no").agg(F.flatten(F.collect_list("refs")).alias("refs"))
        found = found.groupBy("_c", "_s").agg(F.min(F.struct("d", "no", "refs")).alias("w")).select("_c", "_s", "w.d", "w.refs")
    one = F.when(F.size("refs") == 1, F.col("refs")[0]).otherwise(F.lit(-1)).cast("bigint")
    found = scratch.write(found.select("_c", "_s", one.alias("ref_id")), "places")
    return hot_join(e, found, ["_c", "_s"], hot_keys(typed, ["_c", "_s"], "n", total or 0)).select(F.col("_key").alias(key), "ref_id")
