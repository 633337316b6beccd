import random

from test_language_id import WORDS
from test_mixing import brute as brute_mix
from test_simhash import brute_groups, brute_print

from plumbline.llm import exact_dedup, pipeline, simhash


def test_stages(spark, docs, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[g]) + str(rng.randrange(40)) for _ in range(80)), g, f"src{i % 4}") for i in range(80) for g in [("en", "de", "fr")[i % 3]]]
    rows += [(210, " ".join(rows[7][1].split()[:-1]), rows[7][2], rows[7][3])]  # perhaps near, by its fingerprint
    rows += [(200, rows[3][1], "en", "src1"), (201, rows[4][1].replace(" ", "  "), "en", "src1"), (202, "12 34", "en", "src0"), (203, None, "en", "src0"), (3, rows[3][1], rows[3][2], rows[3][3])]
    rows += [(205, "der die und das ist nicht mit dem auf für sich zu von " * 12, "en", "src2"), (206, " ".join(f"{rng.choice(WORDS['fr'])}{k}" for k in range(30_000)), None, "src9")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, step) in enumerate(pipeline.STAGES[:-1]):
        out = step(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(sorted(r["doc_id"] for r in frame.collect()))
        if k == 0:
            named = {r["doc_id"]: r["lang"] for r in frame.collect()}
    language, exact, near, mix = seen
    assert language == sorted(r[0] for r in rows if r[0] not in (202, 203))
    assert exact == sorted({r[0] for r in rows} - {200, 201, 202, 203})
    text = {r[0]: r for r in rows}  # of rows that repeat an identifier, the texts are equal
    prints = {i: brute_print(text[i][1]) for i in exact}
    root, least = brute_groups(prints.values()), {}
    for i in exact:
        least[root[prints[i]]] = min(i, least.get(root[prints[i]], i))
    assert near == sorted(least.values())
    assert named[210] == rows[7][2] and named[205] == "de"  # the language stage's decision, not the label 'en'
    assert mix == sorted(r[0] for r in brute_mix([(i, text[i][1], named[i], text[i][3]) for i in near], pipeline.MIX))
    piece = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in piece} == set(mix)
    assert sum(r["length"] for r in piece) == sum({r["doc_id"]: r["doc_tokens"] for r in piece}.values())


def test_stages_are_those_of_the_plan():
    assert [n for n, _ in pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]
    assert exact_dedup.SQL and simhash.RADIUS == 4


def test_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_ties_and_repeated_rows(spark, docs, tmp_path):
    """Clashing names come with every frame of ``docs``."""
    text = "the and of to in that is was for it with as his on be at by " * 3
    rows = [(1, text, "en", None), (1, text, "en", None), (2, text, None, "src1"), (None, text, "en", "src1"), (None, "der die und in den von zu", None, None), (3, None, None, None), (4, "", "en", "src1"), (5, "½ 7", "en", "src1"), (6, "le la les des en un du " + "une " * 40_000, "fr", "src2")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    whole = {}
    for r in pieces:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for (_, total), at in whole.items():
        assert sum(n for _, n in at) == total and len(at) == len(set(at))
    assert {i for i, _ in whole} <= {1, None, 6} and (6 in {i for i, _ in whole} or 1 in {i for i, _ in whole})


def test_the_root_module_is_the_same_pipeline():
    import corpus_pipeline

    assert corpus_pipeline.STAGES is pipeline.STAGES and corpus_pipeline.run is pipeline.run and corpus_pipeline.ORACLE_SQL is None
