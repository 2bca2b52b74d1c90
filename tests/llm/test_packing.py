import random

import pytest

from depguard.llm.packing import TOKENIZER, TOKENIZER_DIR, BestFit, pack, token_counter, token_sizes

CAPS = (512, 1024, 2048, 4096)


def check(rows, sizes, caps=CAPS):
    top = max(caps)
    by_key, bins = {}, {}
    for r in rows:
        by_key.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.container_id, []).append(r)
    assert set(by_key) == set(sizes)
    for k, parts in by_key.items():
        parts.sort(key=lambda r: r.part)
        assert [r.part for r in parts] == list(range(parts[0].n_parts)) and sum(r.n_tokens for r in parts) == (sizes[k] or 0)
        assert [r.first_token for r in parts] == [i * top for i in range(len(parts))]
        assert len(parts) == 1 or (sizes[k] > top and all(r.n_tokens == top for r in parts[:-1]))
    for b in bins.values():
        used = sum(r.n_tokens for r in b)
        assert {r.used for r in b} == {used} and {r.capacity for r in b} == {next(c for c in caps if c >= used)}
    return len(bins)


@pytest.mark.parametrize("group", [20_000, 150])
def test_pack(spark, group):
    rng = random.Random(3)
    sizes = {i: rng.choice([rng.randint(1, 900), rng.randint(1, 4096), rng.randint(4000, 20000)]) for i in range(800)} | {900: 0, 901: None, 902: 4096, 903: 8192, 904: 4097}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    n = check(pack(df, "doc_id", group_rows=group).collect(), sizes)
    total = sum(v or 0 for v in sizes.values())
    assert n <= total / 4096 * 1.06 + 8
    assert pack(df.limit(0), "doc_id").count() == 0


def test_best_fit_takes_the_tightest():
    fit = BestFit([10], [7, 6, 3, 4, 5])
    a, b = fit.put(7), fit.put(6)
    assert fit.put(3) == a and fit.put(4) == b and fit.put(5) not in (a, b)
    small = BestFit([4, 8, 16], [3, 2])
    assert small.put(3) == 0 and small.opened == [8] and small.put(2) == 0 and small.downsized(0) == 8


def packed(sizes, caps):
    fit = BestFit(list(caps), sizes)
    for x in sorted(sizes, reverse=True):
        fit.put(x)
    return fit, sum(map(fit.downsized, range(len(fit.bins)))) - sum(sizes)


def test_the_cheapest_capacity_is_opened():
    fit, unused = packed([2040, 1500, 1500, 1500], CAPS)  # 2,048 for the first: nothing to come fills 4,096 as well
    assert fit.opened[0] == 2048
    assert packed([3000, 1000, 1000], (1024, 4096))[0].opened == [4096, 1024]
    assert packed([100] * 200, CAPS)[0].opened[0] == 4096  # as full as any, and fewer


@pytest.mark.parametrize("low,high", [(1, 900), (900, 2100), (1300, 1500), (1, 4096), (450, 520), (1400, 4000)])
def test_joint_capacities_waste_less_than_one(low, high):
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(3000)]
    (joint, several), (_, single) = packed(sizes, CAPS), packed(sizes, (4096,))
    assert several <= single
    if low == 900:  # pairs of two thousand leave more of 4,096 than one leaves of 2,048
        assert len(set(joint.opened)) > 1 and several < 0.9 * single


def test_sizes_are_the_tokenizers(spark):
    import base64

    import tiktoken

    path = f"{TOKENIZER_DIR}/{TOKENIZER}"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("x", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    texts = ["", "Hello world, it's 2024.\r\n\\frac{a}{b}", "日本語のテキスト 🙂", " ".join(["word"] * 5000), None, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_sizes(df, "doc_id", "text").collect()}
    assert got == {i: 0 if t is None else len(own.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert token_counter(path)("x" * 300_000) > 1000  # a long word ends in good time


def test_texts_with_an_overlong_run_are_sized_whole():
    import base64

    import tiktoken

    from depguard.llm.packing import PATTERN

    path = f"{TOKENIZER_DIR}/{TOKENIZER}"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own, count, rng = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), token_counter(path), random.Random(8)
    run = "".join(rng.choice("etaoinshrdlu") for _ in range(9_001))
    for text in (run, "ordinary words before " * 900 + run + " and after" * 900, "data:image/png;base64," + "QUJD1/+x" * 2_000, "字" * 5_000):
        assert count(text) == len(own.encode_ordinary(text))
