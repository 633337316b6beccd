import random
import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from plumbline.llm import packing
from test_token_counts import library


@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(lengths):
    name, offset, count = packing.best_fit(np.array(lengths, np.int64), 64)
    rooms = {}
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    want = []
    for k in order:  # plain best fit: the tightest room that holds it
        fits = [r for r in want if r >= lengths[k]]
        if fits:
            r = min(fits)
            want.remove(r)
        else:
            r = 64
        want.append(r - lengths[k])
    for k in range(len(lengths)):
        rooms.setdefault(name[k], []).append((offset[k], lengths[k]))
    assert len(rooms) == count and sorted(64 - sum(n for _, n in v) for v in rooms.values()) == sorted(want)
    for v in rooms.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n


def check(df, rows, window, **more):
    _, encode = library()  # the library's ids, whatever the module makes of them
    got = packing.packed(df, window=window, **more).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows:
        ids = [*encode(t or ""), 0]
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    for v in seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return got


def test_round_trip(docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "é", "x\ny"]) for _ in range(rng.randrange(400)))) for i in range(60)] + [(100, None), (101, ""), (102, "long " * 20_000), (103, "a <|endoftext|> b"), (104, "x\n\n  y <|endoftext|>"), (None, "none")]
    for more in ({}, {"block": 7}):
        check(docs(rows).repartition(3), rows, 128, **more)
    assert packing.packed(docs([])).count() == 0


def test_repeated_rows_are_packed_each(docs):
    got = packing.packed(docs([(1, "a b"), (1, "a b")])).collect()
    assert len(got) == 2 and {r["length"] for r in got} == {3}


def test_little_padding(docs):
    rng = random.Random(6)
    rows = [(i, "word " * rng.choice([rng.randrange(1, 300), rng.randrange(1, 3000)])) for i in range(800)]
    got = check(docs(rows).coalesce(1), rows, 1024)
    windows = len({r["sequence_id"] for r in got})
    assert sum(r["length"] for r in got) / (windows * 1024) > 0.98
