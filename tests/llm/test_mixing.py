import hashlib

import pytest
from oracle import assert_same, connection
from test_token_counts import library

from plumbline.llm import mixing
from plumbline.llm.mixing import Mix

ROWS = [(i, "w " * (1 + i % 9), ["en", "de", None][i % 3], f"src{i % 5}" if i % 11 else None) for i in range(400)] + [(500, None, "en", "src0"), (501, "", "fr", "x"), (7, "again again", "en", "src2"), (None, "no id", "de", "src1")]


def brute(rows, mix):
    weight = lambda d: {"group0": 0.4, "group1": 0.3}.get(d, 0.15)
    lang_weight = lambda x: {"en": 0.5, "de": 0.2, "fr": 0.2}.get(x, 0.1)
    leaf = lambda r: (f"group{int(''.join(filter(str.isdigit, r[3] or '')) or 0) % 4}", r[2] or "", r[3] or "")
    encode = library()[1]
    count = lambda r: len((r[1] or "").split()) if mix.tokens == "words" else len(encode(r[1] or ""))
    tokens = {}
    for r in rows:
        tokens[leaf(r)] = tokens.get(leaf(r), 0) + count(r)

    def share(caps, weights, given):
        out, left = {}, dict(caps)
        while left:
            total = sum(weights[k] for k in left)
            full = [k for k in left if left[k] <= given * weights[k] / total + 1e-9]
            if not full:
                return out | {k: given * weights[k] / total for k in left}
            for k in full:
                out[k] = left.pop(k)
            given -= sum(out[k] for k in full)
        return out

    cap = {k: v * mix.epochs for k, v in tokens.items()}
    d_caps = {}
    for k, v in cap.items():
        d_caps[k[0]] = d_caps.get(k[0], 0) + v
    goals = {}
    for d, b in share(d_caps, {d: weight(d) for d in d_caps}, sum(tokens.values()) * mix.share).items():
        l_caps = {}
        for k, v in cap.items():
            if k[0] == d:
                l_caps[k[1]] = l_caps.get(k[1], 0) + v
        for x, c in share(l_caps, {x: lang_weight(x) for x in l_caps}, b).items():
            s_caps = {k: v for k, v in cap.items() if k[:2] == (d, x)}
            goals |= share(s_caps, dict.fromkeys(s_caps, 1.0), c)
    out = []
    for k, goal in goals.items():
        own = [r for r in rows if leaf(r) == k]
        whole = int(goal + 1e-6) // tokens[k] if tokens[k] else mix.epochs
        rest = int(goal + 1e-6) - whole * tokens[k]
        name = lambda r: "" if r[0] is None else str(r[0])
        place = lambda r: (hashlib.md5(f"{mix.seed}:{whole}:{name(r)}".encode()).hexdigest(), name(r).rjust(20, "0"))  # noqa: E731, B023
        for r in own:
            before = sum(count(q) for q in own if place(q) < place(r))
            times = whole + (rest > 0 and before < rest)
            out += [(r[0], *k, count(r), e) for e in range(times)]
    return sorted(out, key=str)


@pytest.mark.parametrize("mix", [Mix(), Mix(share=0.3), Mix(share=1.9, epochs=2), Mix(share=0.9, epochs=1), Mix(tokens="words"), Mix(share=0.4, tokens="words")])
def test_against_plain_python(docs, mix):
    got = mixing.mixed(docs(ROWS), mix)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(ROWS, mix)


def test_take_returns_the_same_rows(docs):
    df = docs(ROWS)
    got = mixing.take(df, Mix(share=1.5))
    assert got.columns == df.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted((x[0] for x in brute(ROWS, Mix(share=1.5))), key=str)


def test_empty_table(docs):
    assert mixing.mixed(docs([])).count() == 0 and mixing.take(docs([])).count() == 0


@pytest.mark.parametrize("mix", [Mix(tokens="words"), Mix(share=0.5, epochs=1, tokens="words")])
def test_against_sql(spark, mix):
    """Whole tables against SQL, in words, which SQL can count."""
    folder = "/root/testdata/sf0.001"
    assert_same(mixing.mixed(spark.read.parquet(f"{folder}/documents.parquet"), mix), connection(folder), mixing.sql(mix))


def test_names_of_columns(docs):
    df = docs(ROWS)
    other = df.selectExpr("doc_id AS i", "text AS body", "lang AS `l.x`", "source AS s", "1 AS lang")
    got = mixing.take(other, Mix(share=0.5), id_col="i", text_col="body", lang_col="l.x", source_col="s")
    assert sorted((r["i"] for r in got.collect()), key=str) == sorted((r["doc_id"] for r in mixing.take(df, Mix(share=0.5)).collect()), key=str)
    assert got.columns == other.columns


def test_a_very_long_text_and_a_hot_leaf(docs):
    rows = [(i, "word " * (3 + i % 5), "en", "src0") for i in range(300)] + [(900, "long text, " * 60_000, "en", "src0"), (901, "b", "de", "src1")]
    got = mixing.mixed(docs(rows), Mix(share=0.7, epochs=1)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, Mix(share=0.7, epochs=1))
