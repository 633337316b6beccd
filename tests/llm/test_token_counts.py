import functools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import token_counts, tokens
from plumbline.llm.token_counts import Rollup, change, counted
from pyspark.sql import functions as F


def cells(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in df.collect()}


def test_signed_batches_commit_once(docs):
    df = docs([(1, "a b c", "en", "s"), (2, "d", "en", "s"), (3, None, None, None), (3, "", "de", "t")])
    rows = counted(df)
    roll = Rollup(df.sparkSession)
    assert roll.totals().count() == 0
    assert roll.commit("1", change(rows, 1, "words", F.col("words")))
    want = {("s", "en", "words"): (2, 4), (None, None, "words"): (1, 0), ("t", "de", "words"): (1, 0)}
    assert cells(roll.totals()) == want
    assert not roll.commit("1", change(rows, 1, "words", F.col("words")))
    assert cells(Rollup(df.sparkSession, roll.root).totals()) == want
    roll.commit("2", change(rows.where("words = 1"), -1, "words", F.col("words")))
    roll.commit("3", change(rows.where("words = 3"), -1, "words", F.col("words")).unionByName(change(rows.where("words = 3"), 1, "bpe", F.col("n"))))
    assert cells(roll.totals()) == {(None, None, "words"): (1, 0), ("t", "de", "words"): (1, 0), ("s", "en", "bpe"): (1, 3)}
    assert roll.commit("4", change(rows.limit(0), 1, "words", F.col("words"))) and len(cells(roll.totals())) == 3


def test_half_a_batch_is_written_over(docs):
    df = docs([(1, "a b", "en", "s")])
    roll = Rollup(df.sparkSession)
    changes = change(counted(df), 1, "words", F.col("words"))
    roll.commit("1", changes)
    token_counts.delete(df.sparkSession, f"{roll.root}/batch=1/_SUCCESS")  # as if the driver had died
    assert roll.totals().count() == 0
    assert roll.commit("1", changes)
    assert cells(roll.totals()) == {("s", "en", "words"): (1, 2)}


@functools.cache
def library(name="byte_bpe_50k.json"):
    """The library's own tokenizer, as it comes."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    return path, lambda t: whole.encode(t, add_special_tokens=False).ids


TEXTS = ["", " ", "a", " a b ", "a  b", "a \n b", "x\ty z", "don't we'll 12 3%", "é ñ ß q", "<|endoftext|> a", "hello <|endoftext|> world", "a <|endoftext|> b", "a<|endoftext|>", "<|endoftext", "word" * 500, "tab\t end", "\n\nA b", "a  b c", "w " * 999 + "w", "½ ² ٣ 中文 字", "\U0001f600 x", "\x85 a\x1c b", "\u2003 a \u3000 b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_those_of_the_library(name):
    path, encode = library(name)
    for t in TEXTS:
        assert tokens.ids(t, path) == encode(t), t[:30]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\t ", "the", "The.", "a,b", "'s", "12", "<|endoftext|>", "é", "..", "_", "\xa0"]), st.text(max_size=4)), max_size=12))
def test_any_text_has_the_ids_of_the_library(parts):
    path, encode = library()
    text = "".join(parts)
    assert tokens.ids(text, path) == encode(text)


def test_a_vocabulary_of_another_form_goes_to_the_library():
    import public_tokenizers

    assert tokens._encoder(public_tokenizers.path("word_bpe_49k.json"))[0] is None
    assert tokens._encoder(tokens.default_path())[0] is not None


def test_query_covers_every_row(docs, tmp_path):
    docs([(1, "a b", "en", "s"), (2, " \n", "en", "s"), (3, "", "de", "t"), (4, None, "fr", "u")]).write.parquet(f"{tmp_path}/documents.parquet")
    df = docs([(1, "x")])
    n = {t: len(tokens.ids(t, tokens.default_path())) for t in ("a b", " \n")}
    assert n[" \n"] > 0
    want = {("s", "en", "byte_bpe_50k"): (2, sum(n.values())), ("t", "de", "byte_bpe_50k"): (1, 0), ("u", "fr", "byte_bpe_50k"): (1, 0)}
    assert cells(token_counts.query(df.sparkSession, str(tmp_path))) == want


def test_compact_folds_batches_once(docs):
    df = docs([(1, "a b", "en", "s"), (2, "c", "de", "t")])
    roll, rows = Rollup(df.sparkSession), counted(df)
    add = change(rows, 1, "words", F.col("words"))
    assert not roll.compact()
    roll.commit("1", add)
    roll.commit("2", change(rows.where("lang = 'de'"), -1, "words", F.col("words")))
    want = {("s", "en", "words"): (1, 2)}
    assert roll.compact() and cells(roll.totals()) == want and roll._names() == ["fold=0000000000"]
    assert not roll.compact() and not roll.commit("1", add) and cells(roll.totals()) == want
    roll.commit("3", add)
    want = {("s", "en", "words"): (2, 4), ("t", "de", "words"): (1, 1)}
    assert cells(roll.totals()) == want
    assert roll.compact() and cells(Rollup(df.sparkSession, roll.root).totals()) == want
    assert roll.committed("1") and roll.committed("3") and roll._names() == ["fold=0000000001"]


def test_half_a_fold_is_written_over(docs, monkeypatch):
    df = docs([(1, "a b", "en", "s")])
    roll = Rollup(df.sparkSession)
    roll.commit("1", change(counted(df), 1, "words", F.col("words")))
    want = {("s", "en", "words"): (1, 2)}
    with monkeypatch.context() as m:
        m.setattr(token_counts, "delete", lambda *_: None)  # as if the driver had died before the batches went
        assert roll.compact()
    assert cells(roll.totals()) == want and len(roll._names()) == 2
    assert not roll.compact() and cells(roll.totals()) == want and roll._names() == ["fold=0000000000"]
    roll.commit("2", change(counted(df), 1, "words", F.col("words")))
    with monkeypatch.context() as m:
        m.setattr(token_counts, "delete", lambda *_: None)
        roll.compact()
    token_counts.delete(df.sparkSession, f"{roll.root}/fold=0000000001/batches/_SUCCESS")  # died before the names were whole
    want = {("s", "en", "words"): (2, 4)}
    assert cells(roll.totals()) == want
    assert roll.compact() and cells(roll.totals()) == want and roll._names() == ["fold=0000000001"]


def test_query_against_the_library(docs, tmp_path):
    """The registered query over a small table, against plain sums of the library's ids."""
    rng = random.Random(2)
    rows = [(i, rng.choice(TEXTS) + rng.choice([" and more", "", "\n"]), rng.choice(["en", "de", None]), rng.choice(["s", "t", None])) for i in range(120)]
    rows += [(3, "long text, with words " * 30_000, "en", "s"), (3, "again", "en", "s"), (3, "again", "en", "s"), (200, None, None, "only")]
    docs(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    _, encode = library()
    want = {}
    for _, t, lang, source in rows:
        n, total = want.get((source, lang, "byte_bpe_50k"), (0, 0))
        want[source, lang, "byte_bpe_50k"] = (n + 1, total + len(encode(t or "")))
    assert cells(token_counts.query(docs([]).sparkSession, str(tmp_path))) == want


def test_empty_table_and_other_names(docs):
    df = docs([(1, "a b", "en", "s")]).selectExpr("source AS `x.y`", "lang AS l", "text AS words", "1 AS n")
    assert [tuple(r) for r in counted(df, source_col="x.y", lang_col="l", text_col="words").collect()] == [("s", "en", 2, 2)]
    roll = Rollup(df.sparkSession)
    assert roll.commit("0", change(counted(docs([])), 1, "words", F.col("words"))) and roll.totals().count() == 0
