"""Bootstrap queries beyond the bounds of a plan or cohort on the driver: every row by weights."""

import numpy as np
import pytest

from plumbline.operators import bootstrap, rank
from plumbline.plans import ranking
from plumbline.plans.catalog import queries
from plumbline.plans.domain import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def small_bounds(monkeypatch):
    monkeypatch.setattr(ranking, "MOST_QUESTIONS", 3)
    monkeypatch.setattr(ranking, "MOST_FIGURE_ROWS", 5)


@pytest.mark.parametrize(("name", "statistic", "replicates"), [("bst10", "means", 200), ("bst11", "areas", 200), ("bst12", "refit", 100)])
def test_weights_equal_physical_resampling(spark, small_bounds, name, statistic, replicates):
    rows = ranking._figures(Tables(spark, FOLDER))
    plan = bootstrap.hashed_draws(rows, "subject", "qid", replicates).toPandas()
    pdf = rows.toPandas()
    assert len(pdf) > 5
    members = {k: g for k, g in pdf.groupby(["subject", "qid"]).indices.items()}
    stat = getattr(ranking, statistic)
    wide = []
    for _, one in plan.groupby("replicate"):
        at = np.concatenate([np.tile(members[s, q], m) for s, q, m in zip(one["subject"], one["qid"], one["m"], strict=True)])
        wide.append(stat(pdf.iloc[at]))
    got = sorted(queries()[name](spark, FOLDER).collect())
    want = zip(stat(pdf), np.nanpercentile(wide, 2.5, axis=0), np.nanpercentile(wide, 97.5, axis=0), strict=True)
    assert [r["k"] for r in got] == list(range(len(got)))
    np.testing.assert_allclose([list(r)[1:] for r in got], list(want), rtol=0, atol=1e-9)


def test_plan_beyond_the_driver(spark, small_bounds):
    questions = Tables(spark, FOLDER).ev.select("subject", "qid").distinct().toPandas()
    rows = queries()["bst01"](spark, FOLDER).toPandas()
    assert len(questions) > 3 and len(rows) == 10 * len(questions)
    order = sorted(zip(questions["subject"], questions["qid"], strict=True))
    subject = {q: s for s, q in order}
    for _, one in rows.groupby("replicate"):
        assert sorted(one["position"]) == list(range(len(order)))
        assert all(subject[q] == order[p][0] for p, q in zip(one["position"], one["qid"], strict=True))
    drawn = rows.groupby(["replicate", "qid"]).size().to_dict()
    plan = bootstrap.hashed_draws(Tables(spark, FOLDER).ev, "subject", "qid", 10).toPandas()
    assert drawn == {(r, q): m for r, q, m in zip(plan["replicate"], plan["qid"], plan["m"], strict=True)}


@pytest.mark.parametrize("bound", ["questions", "rows"])
def test_shared_plan_beyond_the_bounds(spark, monkeypatch, bound):
    want = {r["fx"]: r for r in queries()["bst06_plan"](spark, FOLDER).collect()}
    if bound == "questions":
        monkeypatch.setattr(ranking, "MOST_QUESTIONS", 3)
    else:
        monkeypatch.setattr(bootstrap, "MOST_ROWS", 5)
        monkeypatch.setattr(bootstrap, "bootstrap_auroc", None)
    got = {r["fx"]: r for r in queries()["bst06_plan"](spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    for fx, r in got.items():  # other draws, the same statistic
        assert abs(r["valid"] - want[fx]["valid"]) < 50
        assert r["lo"] is None or want[fx]["lo"] is None or (abs(r["lo"] - want[fx]["lo"]) < 0.1 and abs(r["hi"] - want[fx]["hi"]) < 0.1)


def test_plan_of_one_generator_against_plain_draws(spark):
    """bst01: replicate by replicate, subject by subject, from one generator."""
    pools = {}
    for s, q in sorted({(r["subject"], r["qid"]) for r in Tables(spark, FOLDER).ev.select("subject", "qid").collect()}):
        pools.setdefault(s, []).append(q)
    rng, want = np.random.default_rng(42), set()
    for replicate in range(10):
        position = 0
        for pool in pools.values():
            for at in rng.integers(0, len(pool), len(pool)):
                want.add((replicate, position, pool[at]))
                position += 1
    assert {tuple(r) for r in queries()["bst01"](spark, FOLDER).collect()} == want


@pytest.mark.parametrize(("name", "statistic", "replicates"), [("bst10", "means", 200), ("bst11", "areas", 200), ("bst12", "refit", 100)])
def test_physical_resampling_against_plain_copies(spark, name, statistic, replicates):
    pdf = ranking._figure_rows(Tables(spark, FOLDER))
    first = list(dict.fromkeys(pdf["qid"]))
    stratum = dict(zip(pdf["qid"], pdf["subject"], strict=True))
    rng, stat, wide = np.random.default_rng(42), getattr(ranking, statistic), []
    for _ in range(replicates):
        drawn = []
        for s in sorted(set(stratum.values())):
            pool = [q for q in first if stratum[q] == s]
            drawn += [pool[k] for k in rng.integers(0, len(pool), len(pool))]
        wide.append(stat(pdf.iloc[[i for q in drawn for i in np.flatnonzero(pdf["qid"] == q)]]))
    got = sorted(queries()[name](spark, FOLDER).collect())
    want = zip(stat(pdf), np.nanpercentile(wide, 2.5, axis=0), np.nanpercentile(wide, 97.5, axis=0), strict=True)
    np.testing.assert_allclose([list(r)[1:] for r in got], list(want), rtol=0, atol=1e-9)


@pytest.mark.parametrize("name", ["bst10", "bst11"])
def test_no_row_of_a_large_cohort_comes_to_the_driver(spark, small_bounds, monkeypatch, name):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self, *args, **kwargs):
        raise AssertionError("rows were fetched")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    monkeypatch.setattr(bootstrap, "weighted_rows", refuse)  # a row a replicate
    got = queries()[name](spark, FOLDER).collect()
    assert sorted(r["k"] for r in got) == [0, 1, 2]


def test_areas_by_vectors_whatever_the_parts(spark, monkeypatch):
    """Ties across batches and ranges, missing, infinite and signed zero values, a column without any value."""
    rng = np.random.default_rng(8)
    rows = [(int(q % 3), int(q), bool(rng.integers(2)), float(rng.choice([-1.0, -0.0, 0.0, 0.5, 2.0, np.nan, np.inf])), float(rng.random()), None) for q in rng.integers(0, 40, 600)]
    rows += [(2, 99, True, None, None, None)]
    df = spark.createDataFrame(rows, "s int, q int, y boolean, a double, b double, c double")
    plan = {(r["replicate"], r["q"]): r["m"] for r in bootstrap.hashed_draws(df, "s", "q", 20).collect()}
    want = {}
    for k in range(3):
        used = sorted((r[3 + k], r[2], r[1]) for r in rows if r[3 + k] is not None and np.isfinite(r[3 + k]))
        x, y = np.array([u[0] for u in used]), np.array([u[1] for u in used], bool)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(x) != 0))) if used else []
        for i in range(-1, 20):
            w = np.array([1 if i < 0 else plan.get((i, u[2]), 0) for u in used], np.int64)
            want[k, i] = bootstrap.weighted_auroc(y, np.arange(len(x)), starts, w) if used else np.nan
    monkeypatch.setattr(bootstrap, "ROWS_AT_ONCE", 50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["k"], r["replicate"]): r["auroc"] for r in bootstrap.weighted_areas(df, "s", "q", "y", ["a", "b", "c"], 20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert (got[key] is None and np.isnan(v)) or abs(got[key] - v) < 1e-12


def test_places_of_questions_beyond_the_type_of_the_plan(spark, monkeypatch):
    """bst01: a subject's draws fit 8 bits, a place among all questions does not."""
    pools = {"a": list(range(200)), "b": list(range(1000, 1200))}
    monkeypatch.setattr(ranking, "_questions", lambda t: (pools, 0))
    plan = bootstrap.draw_plan(pools, 10)
    assert plan.dtype == np.uint8
    want = {(i, k, (pools["a"] if k < 200 else pools["b"])[int(plan[i, k])]) for i in range(10) for k in range(400)}
    got = queries()["bst01"](spark, FOLDER)
    assert [x[1] for x in got.dtypes] == ["int", "int", "bigint"]
    assert {tuple(r) for r in got.collect()} == want and got.count() == 4000


def test_every_draw_of_a_large_plan_is_written_out(spark, monkeypatch):
    """bst05: 120,000 draws, over ranges of questions."""
    sizes = {"a": 10_000, "b": 20_000}
    rows = spark.range(30_000).selectExpr("id as qid", "if(id < 10000, 'a', 'b') as subject")
    monkeypatch.setattr(Tables, "ev", rows)
    monkeypatch.setattr(rank, "WHOLE", 1000)
    want = []
    for one in bootstrap.hashed_draws(rows, "subject", "qid", 4).toPandas().sort_values("qid").groupby(["replicate", "subject"]):
        (replicate, subject), g = one
        names = np.repeat(g["qid"], g["m"])
        assert len(names) == sizes[subject]
        want += [(f"bootstrap-r{replicate:06d}-s{'ab'.index(subject):02d}-d{d:06d}", replicate, subject, q) for d, q in enumerate(names)]
    got = queries()["bst05"](spark, FOLDER).toPandas()
    assert len(got) == 120_000 and set(got.itertuples(index=False, name=None)) == set(want)
