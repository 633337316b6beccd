import hashlib
import os
import random
import re

import numpy as np
import pytest

from oracle import assert_same, connection

from plumbline.llm import wordhash
from plumbline.llm.substring_dedup import Repeats, sliding_argmin, sql


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    texts = {(i, t) for i, t in rows if i is not None}
    known = {x: re.findall(r"[^\x20\x09-\x0D]+", x[1] or "") for x in texts}

    def longest(i, w):
        """The longest of window, 2 window, 4 window, ... words of which another document has a window of this one."""
        best, n = 0, window
        while i is not None and n <= len(w):
            own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if not any(j != i and tuple(v[k : k + n]) in own for (j, _), v in known.items() for k in range(len(v) - n + 1)):
                break
            best, n = n, 2 * n
        return best

    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(w) - window + 1) for j in range(window) if i is not None and first.get(tuple(w[k : k + window]), i) < i}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), longest(i, w), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, window, **more):
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["longest_repeat"], r["kept_sha256"]) for r in Repeats(df, window, **more).result(longest=True).collect()], key=str)


@pytest.mark.parametrize("window", [2, 3, 8, 9])
def test_against_plain_python(docs, window):
    rng = random.Random(window)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 5))]
        rows.append((i * 3 % 61, "\n".join(parts)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, None), (73, ""), (74, " \t"), (3, rows[4][1]), (75, "a " * 3000), (76, "a " * 2990), (None, rows[0][1]), (80, rows[5][1]), (80, rows[5][1])]
    want = brute(rows, window)
    assert found(docs(rows), window) == want
    if window in (3, 8):
        assert found(docs(rows), window, few=0) == want  # all levels as jobs
        assert found(docs(rows), window, few=1000) == want


def test_production_window(docs):
    rng = random.Random(3)
    w = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = w(57)
    rows = [(1, w(30) + " " + passage + " " + w(9)), (2, passage), (3, w(80)), (4, w(10) + " " + " ".join(passage.split()[:49]) + " " + w(5)), (5, passage + " " + passage)]
    assert found(docs(rows), 50) == brute(rows, 50)


def test_empty_table(docs):
    assert found(docs([]), 50) == [] and Repeats(docs([]), 50).result().count() == 0


def test_removal_does_not_need_the_higher_levels(docs):
    rng = random.Random(6)
    w = [f"w{rng.randrange(900)}" for _ in range(300)]
    rows = [(i, " ".join(w[a : a + n])) for i, (a, n) in enumerate((rng.randrange(200), rng.randrange(100)) for _ in range(40))]
    got = Repeats(docs(rows), 9).result()
    assert "longest_repeat" not in got.columns
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()], key=str) == sorted([(*x[:3], x[4]) for x in brute(rows, 9)], key=str)


def test_levels_against_sql(spark):
    """Whole tables against SQL, all levels."""
    folder = "/root/testdata/sf0.001"
    got = Repeats(spark.read.parquet(f"{folder}/documents.parquet")).result(longest=True).drop("thash", "kept_text")
    assert_same(got, connection(folder), sql(9))


def test_doubling_until_none_survives(docs):
    rng = random.Random(4)
    w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:33])), (3, " ".join([*w[50:58], "x", *w[:15]])), (4, " ".join(w[100:107])), (5, "alone " * 100), (6, " ".join(w))]
    got = found(docs(rows), 8)
    assert got == brute(rows, 8)
    assert got == found(docs(rows), 8, few=0)
    assert {x[0]: x[3] for x in got} == {1: 256, 2: 32, 3: 8, 4: 0, 5: 0, 6: 256}


def test_a_repeat_in_pieces_of_several_documents_is_not_longer(docs):
    rng = random.Random(5)
    w = [f"w{rng.randrange(10**6)}" for _ in range(64)]
    rows = [(1, " ".join(w[:40])), (2, " ".join(w[20:])), (3, " ".join(w)), (4, " ".join(w[:8] + ["x"] + w[8:16]))]
    assert found(docs(rows), 8) == found(docs(rows), 8, few=0) == brute(rows, 8)


def thue_morse(n, a, b):
    return [b if k.bit_count() % 2 else a for k in range(n)]


def test_words_and_windows_made_to_collide(docs):
    """Thue-Morse strings agree under any polynomial modulo 2^64 with an odd base; here nothing is lost."""
    rng = random.Random(9)
    before, after = ([f"w{rng.randrange(10**6)}" for _ in range(30)] for _ in range(2))
    one, two = ("".join(thue_morse(1024, *x)) for x in ("ab", "ba"))
    rows = [(1, " ".join([*before, one, *after])), (2, " ".join([*before, two, *after]))]
    assert [x[2] for x in found(docs(rows), 50)] == [0, 0] and found(docs(rows), 50) == brute(rows, 50)
    rows = [(1, " ".join(thue_morse(1024, "p", "q"))), (2, " ".join(thue_morse(1024, "q", "p")))]
    assert [x[2] for x in found(docs(rows), 1024)] == [0, 0]


def test_sliding_minimum():
    rng = np.random.default_rng(1)
    for width in (1, 2, 7, 64, 65, 100, 333):
        for n in (width, width + 1, 3 * width - 1, 1000):
            if n >= width:
                values = rng.integers(0, 50, n)
                want = [k + int(np.argmin(values[k : k + width])) for k in range(n - width + 1)]
                assert sliding_argmin(values, width).tolist() == want


def test_sums_modulo_the_prime():
    rng = random.Random(2)
    values = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    base = wordhash.BASES[0]
    sums = wordhash.Sums(values, base)
    a, b = np.array([0, 5, 100, 7]), np.array([300, 6, 250, 7])
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        plain = sum(int(v) * pow(base, j, wordhash.PRIME) for j, v in enumerate(values[x:y])) % wordhash.PRIME
        want = wordhash.mix(np.array([plain ^ ((y - x) << 32)], np.uint64)).view(np.int64)[0]
        assert sums.spans(a, b)[k] == want
    big = np.array([wordhash.PRIME - 1, 1, 1 << 60], np.uint64)
    assert wordhash.product(big, big).tolist() == [int(x) ** 2 % wordhash.PRIME for x in big.tolist()]


def test_the_query_doubles_until_none_survives(spark, docs, tmp_path, monkeypatch):
    from plumbline.llm import substring_dedup

    rng = random.Random(11)
    w = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rows = [(1, " ".join(w)), (2, " ".join(["x", *w[:450]])), (3, " ".join([*w[700:760], "y"]))]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    seen, level = [], Repeats._level
    monkeypatch.setattr(Repeats, "_level", lambda self, seeds, texts, words: (seen.append(words), level(self, seeds, texts, words))[1])
    monkeypatch.setattr(Repeats.__init__, "__defaults__", (*Repeats.__init__.__defaults__[:-1], 0))  # no level in one task
    got = substring_dedup.query(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(*x[:3], x[4]) for x in brute(rows, 50)]
    assert seen == [50, 100, 200, 400]  # a window of 800 words has no candidate


def test_higher_levels_take_a_stretch_of_words_once(docs, monkeypatch):
    from plumbline.llm import common, substring_dedup

    rng = random.Random(12)
    w = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = w(120)
    rows = [(i, f"{w(60)} {passage} {w(60)}") for i in range(20)] + [(30, w(90)), (31, w(70)), (31, rng.choice(["x", "y"]))]
    seen, stage = {}, substring_dedup.stage

    def spy(df, name):
        out = stage(df, name)
        seen[name] = (out.count(), common._paths[-1])
        return out

    monkeypatch.setattr(substring_dedup, "stage", spy)
    assert found(docs(rows), 50, few=0) == brute(rows, 50)
    assert seen["pieces-100"][0] == 1  # not the texts of 20 documents
    assert not any(os.path.exists(seen[x][1]) for x in ("windows-scan", "seeds-50", "windows-texts", "windows-50", "extended-100"))


def test_a_piece_in_two_documents_still_meets_other_pieces(docs):
    rng = random.Random(13)
    w = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = [(1, " ".join(w[:40])), (2, " ".join(w[:40])), (3, " ".join([*w[4:40], "x", *w[:10]])), (4, " ".join(w[20:80])), (5, " ".join(["y", *w[36:80]])), (6, " ".join(w[:40] + ["z"] + w[:40])), (4, " ".join(w[20:80])), (0, " ".join(w[60:90]))]
    assert found(docs(rows), 4) == found(docs(rows), 4, few=0) == brute(rows, 4)
