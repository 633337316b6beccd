import hashlib
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        least = min((x for x in ids if x is not None), default=None)
        out.append((i, least, len(ids), i == least, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\t\nb"), (9, "a b "), (4, None), (8, ""), (6, " "), (2, "x" * 300_000), (1, "x" * 300_000), (7, "\x1c"), (7, "\x1c"), (None, "only"), (None, "a b"), (10, "é ")]


def found(df):
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()], key=str)


def test_against_plain_python(docs):
    assert found(exact_dedup.exact_dedup(docs(ROWS))) == brute(ROWS)


def test_empty_table(docs):
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    assert exact_dedup.keep(docs([])).count() == 0


def test_keep_returns_rows_once_with_their_columns(docs):
    df = docs(ROWS)
    got = exact_dedup.keep(df)
    assert got.columns == df.columns
    want = {(i, t) for i, t in ROWS if (i, t) not in {(5, "a  b"), (8, ""), (2, "x" * 300_000), (None, "a b")}}
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_unlike_bytes_of_one_digest_stay_apart(docs):
    df = docs(ROWS)
    weak = exact_dedup.ExactDedup(df.sparkSession, digest=lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 0))
    weak.add(df, "1")
    got = weak.verdicts(df).collect()
    assert sorted([(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got], key=str) == sorted([x[:4] for x in brute(ROWS)], key=str)


def test_state_goes_on_over_batches(docs):
    first, second = docs(ROWS[:6]), docs(ROWS[6:] + [(0, "a b")])
    stream = exact_dedup.ExactDedup(first.sparkSession)
    assert stream.add(first, "1")
    again = exact_dedup.ExactDedup(first.sparkSession, root=stream.root)  # as after a restart
    assert again.add(second, "2")
    got = again.verdicts(first.unionByName(second))
    assert sorted([(r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in got.collect()], key=str) == brute([*ROWS, (0, "a b")])


@pytest.mark.parametrize("n", [3000])
def test_one_group_of_a_third(docs, n):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(n)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(rows).repartition(5)).collect()}
    assert got[999]["keep_id"] == 0 and got[999]["group_size"] == n // 3 and sum(r["kept"] for r in got.values()) == n - n // 3 + 1


def verdicts(stream, content):
    return sorted([(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in stream.verdicts(content).collect()], key=str)


def test_a_batch_counts_once(docs):
    df = docs(ROWS)
    stream = exact_dedup.ExactDedup(df.sparkSession)
    want = sorted([x[:4] for x in brute(ROWS)], key=str)
    assert stream.add(df, "1") and verdicts(stream, df) == want
    assert not stream.add(df, "1") and verdicts(stream, df) == want
    assert not exact_dedup.ExactDedup(df.sparkSession, root=stream.root).add(df, "1") and verdicts(stream, df) == want


def test_half_a_batch_leaves_nothing(docs):
    df = docs(ROWS)
    stream = exact_dedup.ExactDedup(df.sparkSession)
    df.selectExpr("doc_id AS id", "'zz' AS digest", "'' AS place").write.parquet(f"{stream.root}/coming/1")  # the driver died before the rename
    assert stream.add(df, "1") and verdicts(stream, df) == sorted([x[:4] for x in brute(ROWS)], key=str)


def test_null_identifiers(docs):
    rows = [(None, "a"), (None, "a "), (None, "a"), (None, "b"), (1, "b"), (None, "c")]
    got = sorted((r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs(rows)).collect())
    assert got == [(-1, 1, True), (-1, 1, True), (-1, 2, True), (-1, 2, True), (1, 2, False), (1, 2, True)]
    assert sorted(((r["doc_id"], r["text"]) for r in exact_dedup.keep(docs(rows)).collect()), key=str) == [(1, "b"), (None, "a "), (None, "a"), (None, "c")]


def test_the_bitmap_lets_no_repeat_pass(docs, monkeypatch):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    for most in (exact_dedup.MOST_BITS, exact_dedup.ROW_BITS):  # the second: full of chance hits
        monkeypatch.setattr(exact_dedup, "MOST_BITS", most)
        monkeypatch.setattr(exact_dedup, "BITS_EACH", 16 if most == exact_dedup.ROW_BITS else 500)
        assert found(exact_dedup.exact_dedup(docs(rows))) == brute(rows)
        assert sorted(r["doc_id"] for r in exact_dedup.keep(docs(rows)).collect()) == list(range(700))
    groups = docs([]).sparkSession.range(1, 900).selectExpr("cast(id AS string) AS digest", "id % 3 + 1 AS group_size")
    stream = exact_dedup.ExactDedup(groups.sparkSession)
    seen = exact_dedup.marked(groups, "digest", stream.repeated(groups), "hit").collect()
    assert all(r["hit"] for r in seen if r["group_size"] > 1) and sum(r["hit"] for r in seen if r["group_size"] == 1) < 60


def test_unique_texts_are_not_shuffled(docs):
    rows = [(i, f"text {i} " + "x" * 50) for i in range(200)] + [(900, "twice"), (901, "twice")]
    plan = exact_dedup.keep(docs(rows))._jdf.queryExecution().toString()
    assert "Union" in plan and "__slot" in plan
