import random

import numpy as np

import pytest

from depguard.llm import leakage
from depguard.plans import skew
from depguard.llm.leakage import PASSAGE, leaks, words
from depguard.llm.queries import QUERIES


def brute(docs, items):
    grams = {}
    for i, t in items:
        if t is not None:
            w = words(t)
            for j in range(len(w) - PASSAGE + 1):
                grams.setdefault(tuple(w[j : j + PASSAGE]), set()).add(i)
    out = set()
    for d, t in docs:
        if t is not None:
            w = words(t)
            for j in range(len(w) - PASSAGE + 1):
                out |= {(d, i) for i in grams.get(tuple(w[j : j + PASSAGE]), ())}
    return out


def test_words():
    assert words(r"A \emph{Big}\\ dog's \section*{Tür} x2-3_é \alpha\beta") == ["a", "big", "dog", "s", "tür", "x2", "3", "é"]


@pytest.mark.parametrize("step,lot,parts", [(1 << 20, 1 << 20, None), (64, 30, 3)])
def test_against_brute_force(spark, monkeypatch, step, lot, parts):
    monkeypatch.setattr(leakage, "STEP", step)
    monkeypatch.setattr(leakage, "LOT", lot)
    if parts:
        monkeypatch.setattr(skew, "hot_parts", lambda s: parts)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 50)))) for i in range(12)] + [(50, None), (51, ""), (52, "short text"), (53, " ".join(["again"] * 15))]
    items.append((60, items[0][1]))  # the same text under two ids
    docs = []
    for d in range(120):
        w = [rng.choice(vocab + ["other", "\\emph{x}"]) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            src = rng.choice(items[:12])[1].split()
            n, at = rng.randint(9, 16), rng.randint(0, max(0, len(src) - 16))
            piece = src[at : at + n]
            piece = [p.upper() if rng.random() < 0.3 else "\\textbf{" + p + "}" if rng.random() < 0.2 else p + ",\n%% " if rng.random() < 0.1 else p for p in piece]
            w[len(w) // 2 : len(w) // 2] = piece
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "again " * 40), (503, ("filler " * 30_000) + items[1][1] + " end"), (504, items[0][1])]
    dd = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    ii = spark.createDataFrame(items, "item_id bigint, text string")
    got = leaks(dd, "doc_id", "text", ii, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {r.contained for r in got if r.doc_id == 504 and r.item_id in (0, 60)} == {1.0}
    assert leaks(dd.limit(0), "doc_id", "text", ii, "item_id", "text").count() == 0 and leaks(dd, "doc_id", "text", ii.limit(0), "item_id", "text").count() == 0


def test_query_against_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/eval_items.parquet").select("item_id", "text").collect()]
    assert {(r.doc_id, r.item_id) for r in QUERIES["p8_found"](spark, small).collect()} == brute(docs, items)


@pytest.mark.parametrize("step", [1 << 20, 64])
def test_repeated_passages_count_once_for_the_share(spark, monkeypatch, step):
    monkeypatch.setattr(leakage, "STEP", step)
    w = [f"w{i}" for i in range(31)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(["again"] * 15))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " other ".join([" ".join(w[3:15])] * 30)), (2, " ".join(w)), (3, " ".join(w[:13] + ["other"] + w[1:14])), (4, "again " * 40)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.passages, r.contained) for r in leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 1): (30, 1 / 20), (2, 1): (20, 1.0), (3, 1): (4, 3 / 20), (4, 2): (29, 1.0)}


def test_windows_hold_every_passage_once():
    rng = random.Random(2)
    for _ in range(300):
        ids = np.array([rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) if rng.random() < 0.3 else 5 for _ in range(rng.randint(0, 90))], dtype=np.uint64)
        at, n = leakage.windows(ids)
        starts = [s for a, k in zip(at, n) for s in range(a, a + k - PASSAGE + 1)]
        assert sorted(starts) == [i for i in range(len(ids) - PASSAGE + 1) if (ids[i : i + PASSAGE] != 0).all()] and all(PASSAGE <= k <= leakage.WINDOW for k in n)


def test_signatures_miss_no_contained_passage():
    """Recall of the sketch alone, by size of the window, on words of which many repeat; brute force is that all are contained."""
    rng = np.random.default_rng(5)
    for size in range(12, 21):
        ids = rng.integers(1, 4, (4000, size)).astype(np.uint64) if size % 2 else rng.integers(1, 1 << 60, (4000, size)).astype(np.uint64)
        at = rng.integers(0, size - PASSAGE + 1, 4000)
        sets, k = np.stack([leakage.shingles(r) for r in ids]), leakage.functions_for(size - 4)
        inside = np.stack([leakage.shingles(r[a : a + PASSAGE]) for r, a in zip(ids, at)])
        a, b = leakage.signatures(sets, k), leakage.signatures(inside, leakage.functions_for(16))[:, :k]
        assert (a == b).any(axis=1).mean() >= 0.9995


def test_filter(spark):
    rng = np.random.default_rng(3)
    own, other = (rng.integers(-(1 << 63), (1 << 63) - 1, 3000) for _ in "ab")
    f = leakage.Filter(spark.createDataFrame([(int(x),) for x in own], "h bigint"), "h", leakage.SIGNATURE_BITS)
    assert f.has(own.view(np.uint64)).all() and f.has(other.view(np.uint64)).mean() < 0.02
    full = leakage.Filter(spark.createDataFrame([(int(x),) for x in own], "h bigint"), "h", 1 << 10)  # too small: it lets more through
    assert full.has(own.view(np.uint64)).all() and full.bits == 1 << 10
