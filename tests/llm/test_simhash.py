import random
import re

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_groups(values, radius=4):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    vs = sorted(parent)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in vs}


def test_masks_cover_every_pair():
    rng = random.Random(4)
    for turn in range(simhash.ROUNDS):
        every = simhash.masks(4, turn)
        assert len(every) == 31
        for _ in range(2000):
            differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
            assert any(not differ & m for m in every)


def test_buckets_of_the_last_round_are_bounded():
    free = min((a | b | c).bit_count() for a in simhash.masks(4, 0) for b in simhash.masks(4, 1) for c in simhash.masks(4, 2))
    assert 64 - free == 17  # a bucket has 2^17 distinct fingerprints at most: 1 MB


def test_fingerprints():
    for t in [None, "", " ", "A b", "a B c D", "É x Y z w", "a b c d e", "x " * 30_000]:
        assert simhash.fingerprint((t or "").encode()) == brute_print(t)


def groups(spark, values, split):
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp bigint").distinct()
    got = simhash.components(simhash.links(fps, 4, split)).collect()
    out = {v: v for v in values}
    by = {}
    for r in got:
        by.setdefault(r["root"], {r["root"]}).add(r["node"])
    for g in by.values():
        un = [x & (1 << 64) - 1 for x in g]
        for x in un:
            out[x] = min(un)
    return out


@pytest.mark.parametrize("split", [4096, 20])
def test_links_lose_nothing(spark, split):
    rng = random.Random(split)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60])):
            values.add(x)
            for b in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << b
    values |= {0, (1 << 64) - 1, 1, 0b1111, 0b11111 << 59}
    assert groups(spark, values, split) == brute_groups(values)


def test_documents(docs):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(50 - i, " ".join(base[: 400 - i])) for i in range(6)] + [(60, None), (7, ""), (61, "other words here now"), (3, "other words here now"), (3, "OTHER words\there now"), (None, "other words here now"), (62, "y " * 50_000)]
    got = simhash.near_dedup(docs(rows)).collect()
    prints = {simhash.signed(brute_print(t)) for _, t in rows}
    root = brute_groups([p & (1 << 64) - 1 for p in prints])
    least = {}
    for i, t in rows:
        k = root[brute_print(t)]
        if i is not None:
            least[k] = min(least.get(k, i), i)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(((i, least[root[brute_print(t)]]) for i, t in rows), key=str)
    assert simhash.near_dedup(docs([])).count() == 0 and simhash.keep(docs([])).count() == 0
    assert {r["doc_id"] for r in simhash.keep(docs(rows)).collect()} == set(least.values())


def test_a_large_group_is_one_component_of_few_links(spark):
    rng = random.Random(2)
    x = rng.getrandbits(64)
    values = {x ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(1500)}
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp bigint")
    edges = simhash.links(fps, 4, 300)
    assert edges.count() < 31 * 31 * len(values)
    assert len(set(groups(spark, values, 300).values())) == 1


def test_tree_spans():
    values = np.array([0, 1, 3, 7 << 40, (7 << 40) | 1], np.uint64)
    assert sum(len(a) for a, _ in simhash.tree(values, 1)) == 3
