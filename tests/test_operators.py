"""Operators on values worked out by hand, and against plain Python on random input."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import identity, scalars
from plumbline.operators import bootstrap, calibration, coverage, events, rank, stats, trajectory
from plumbline.sources import records


def area(spark, y, s, w=None, kind="double"):
    rows = [(a, b, c) for a, b, c in zip(y, s, w or [1] * len(y), strict=True)]
    return rank.auroc(spark.createDataFrame(rows, f"y boolean, s {kind}, w int"), [], "y", "s", "w").first()["auroc"]


def plain_area(pairs):
    """Share of (right, wrong) pairs that the score orders, ties a half."""
    pos, neg = [x for y, x in pairs if y], [x for y, x in pairs if not y]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.mark.parametrize("seed", range(6))
def test_area(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.random() < rng.choice([0.1, 0.5]), rng.choice([rng.random(), 0.25, -1.0])) for _ in range(rng.choice([2, 9, 80]))]
    got, want = area(spark, *map(list, zip(*pairs, strict=True))), plain_area(pairs)
    assert got is want is None or math.isclose(got, want, rel_tol=1e-12)
    assert area(spark, [True] * 3, [0.3, 0.1, 0.3]) is None


def test_area_keeps_large_integers_apart(spark):
    assert area(spark, [False, True], [2**53, 2**53 + 1], kind="bigint") == 1.0


def test_weighted_area(spark):
    assert area(spark, [False, True], [0.5, 0.5], [3, 2]) == 0.5
    assert area(spark, [False, True, True], [0.1, 0.2, 0.3], [0, 2, 1]) is None


@pytest.mark.parametrize("ranges", [None, 1, 5, 32])
def test_area_over_many_ranges(spark, monkeypatch, ranges):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.random() < 0.4, rng.choice([rng.random(), 0.5, 0.25])) for _ in range(2000)]
    if ranges == 5:
        monkeypatch.setattr(rank, "WHOLE", 10)  # the size asks for ranges
        monkeypatch.setattr(rank, "RANGES", 5)
        ranges = None
    got = {r["g"]: r["auroc"] for r in rank.auroc(spark.createDataFrame(rows, "g string, y boolean, s double"), ["g"], "y", "s", ranges=ranges).collect()}
    for g in ("a", "b", None):
        assert math.isclose(got[g], plain_area([(y, x) for k, y, x in rows if k == g]), rel_tol=1e-12)


@pytest.mark.parametrize("whole", [0, 10**6])
def test_areas_of_cohorts(spark, monkeypatch, whole):
    monkeypatch.setattr(rank, "WHOLE", whole)
    rng = random.Random(9)
    rows = [(rng.randrange(2), rng.choice("st"), rng.choice([True, False, None]), rng.choice([None, 0.5, rng.random()])) for _ in range(600)] + [(7, "s", True, None)]
    got = {(r["fx"], r["grouping"], r["grp"]): r for r in rank.cohort_areas(spark.createDataFrame(rows, "fx int, subject string, y boolean, x double"), ["fx"], "y", "x").collect()}
    want = {(fx, "pooled", None) for fx in (0, 1, 7)} | {(fx, "subject", g) for fx in (0, 1) for g in "st"} | {(7, "subject", "s")}
    assert got.keys() == want
    for (fx, _, g), r in got.items():
        own = [(y, x) for f, s, y, x in rows if f == fx and g in (None, s)]
        used = [(y, x) for y, x in own if y is not None and x is not None]
        counts = [len(own), sum(y is None for y, _ in own), sum(y is not None and x is None for y, x in own), len(used), sum(y for y, _ in used)]
        assert [r[c] for c in ("total", "target_missing", "predictor_missing", "eligible", "positive")] == counts
        area_ = plain_area(used)
        assert r["auroc"] is area_ is None or math.isclose(r["auroc"], area_, rel_tol=1e-12)


@pytest.mark.parametrize("whole", [0, 10**6])
def test_rank_correlation(spark, monkeypatch, whole):
    monkeypatch.setattr(rank, "WHOLE", whole)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(9) / 4, rng.random(), None]), rng.choice([rng.randrange(5), None])) for _ in range(500)] + [("two", 1.0, 2), ("two", 2.0, 1), ("flat", 1.0, 1), ("flat", 2.0, 1), ("flat", 3.0, 1)]
    got = {r["g"]: (r["n"], r["rho"]) for r in rank.spearman(spark.createDataFrame(rows, "g string, x double, y int"), ["g"], "x", "y").collect()}

    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    for g in ("a", "b", None, "two", "flat"):
        both = [(x, y) for k, x, y in rows if k == g and x is not None and y is not None]
        rx, ry = (ranks(list(v)) for v in zip(*both, strict=True))
        assert got[g][0] == len(both)
        if len(both) < 3 or len(set(ry)) == 1:
            assert got[g][1] is None
        else:
            assert math.isclose(got[g][1], np.corrcoef(rx, ry)[0, 1], rel_tol=1e-10)


def test_calibration_error(spark):
    rng = random.Random(2)
    rows = [(rng.random() < 0.6, rng.choice([0.0, 1.0, rng.random()])) for _ in range(300)]
    bins = calibration.reliability(spark.createDataFrame(rows, "y boolean, c double"), [], F.col("y"), F.col("c"))
    want = [[(y, c) for y, c in rows if min(9, int(c * 10)) == b] for b in range(10)]
    assert [r["n"] for r in bins.orderBy("bin").collect()] == [len(w) for w in want]
    error = sum(abs(sum(y for y, _ in w) - sum(c for _, c in w)) for w in want) / len(rows)
    assert math.isclose(calibration.ece(bins, []).first()["ece"], error, rel_tol=1e-9)


def test_weighted_calibration_error(spark):
    df = spark.createDataFrame([(False, 0.1, 3), (True, 0.9, 2), (True, 0.9, 0)], "y boolean, c double, w int")
    got = calibration.ece(calibration.reliability(df, [], F.col("y"), F.col("c"), F.col("w")), []).first()
    assert got["n"] == 5 and math.isclose(got["ece"], 0.1)


def test_binnings_differ_where_edges_are_inexact(spark):
    df = spark.range(101).select((F.col("id") / 100.0).alias("c"))
    apart = df.where(calibration.fixed_bin(F.col("c")) != calibration.edge_bin(F.col("c"))).collect()
    assert {r["c"] for r in apart} == {0.3, 0.6, 0.7}


def test_draw_plan():
    plan = bootstrap.draw_plan({"a": [0, 1, 2], "b": [0, 1, 2]}, 2)
    assert plan.tolist() == [[0, 2, 1, 1, 1, 2], [0, 2, 0, 0, 1, 2]] and plan.dtype == np.uint8
    with pytest.raises(ValueError, match="range"):
        bootstrap.explicit_plan({"a": [0, 1]}, [[0, 2]])


def test_interval(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(95)] + [(0, None)] * 5 + [(1, float(i)) for i in range(94)] + [(1, None)] * 6, "k int, x double")
    got = {r["k"]: r for r in bootstrap.interval(df, ["k"], "x", 100).collect()}
    assert math.isclose(got[0]["lo"], 2.35) and math.isclose(got[0]["hi"], 91.65) and got[0]["reason"] is None
    assert got[1]["lo"] is None and got[1]["reason"] == "insufficient_valid_replicates"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 4), st.integers(0, 5)), min_size=1, max_size=30), st.lists(st.integers(0, 3), min_size=6, max_size=6))
def test_weights_equal_copies(rows, m):
    y, x, q = (np.array(v) for v in zip(*rows, strict=True))
    order = np.argsort(x, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(x[order]) != 0)))
    w = np.array(m)[q]
    got = bootstrap.weighted_auroc(y, order, starts, w)
    pos, neg = np.repeat(x[y], w[y]), np.repeat(x[~y], w[~y])
    if not len(pos) or not len(neg):
        assert math.isnan(got)
    else:
        assert math.isclose(got, ((pos[:, None] > neg) + (pos[:, None] == neg) / 2).mean())


def plain_walk(slots):
    """Switches, transitions, where right was left, and whether it came back; one slot after the other."""
    before, switches, transitions, left, back = None, 0, 0, None, False
    for i, slot in enumerate(slots):
        if slot is not None and slot[1]:
            continue
        if slot is None or slot[0] is None:
            before = None
            continue
        back = back or (left is not None and slot[2])
        if before is not None:
            transitions += 1
            switches += before[0] != slot[0]
            if left is None and before[2] and not slot[2]:
                left = i
        before = slot
    return switches, transitions, left, back


def plain_stabilization(slots):
    """The least own slot from which every later one is there and is an alias or has the last answer."""
    end = slots[-1]
    if end is None or end[0] is None:
        return None
    good = [s is not None and (s[1] or s[0] == end[0]) for s in slots]
    starts = [i for i, s in enumerate(slots) if s is not None and not s[1] and s[0] == end[0] and all(good[i:])]
    return min(starts) / 10 if starts else None


def random_runs(n):
    rng = random.Random(n)
    for _ in range(n):
        letters = rng.choice(["AB", "ABCD", "A"])
        missing, invalid, alias = rng.choice([(0, 0, 0), (0.1, 0.1, 0.2), (0, 0.3, 0.5)])
        slots = []
        for _ in range(11):
            x = rng.choice(letters)
            slots.append(None if rng.random() < missing else (None, False, None) if rng.random() < invalid else (x, rng.random() < alias, x == "A"))
        yield slots


def test_trajectories(spark):
    cases = list(random_runs(400))
    df = spark.createDataFrame(list(enumerate(cases)), "k int, slots array<struct<ans: string, alias: boolean, correct: boolean>>")
    got = {r["k"]: r for r in df.select("k", trajectory.walk().alias("w"), trajectory.stabilization().alias("s")).collect()}
    for k, slots in enumerate(cases):
        w = got[k]["w"]
        assert (w["switches"], w["transitions"], w["left_at"], w["recovered"]) == plain_walk(slots), slots
        assert got[k]["s"] == plain_stabilization(slots), slots
    assert len({plain_walk(c)[:3] for c in cases}) > 30 and len({plain_stabilization(c) for c in cases}) > 8


def test_checkpoints_without_a_run_are_an_error(spark):
    runs = spark.createDataFrame([("r1", 5), ("r2", 6)], "record_id string, x int")
    own = [("r1", 0, "A"), ("r1", 10, "B")]
    got = {r["record_id"]: r["slots"] for r in trajectory.attached(runs, spark.createDataFrame(own, "parent string, idx int, ans string"), "record_id", "parent", "idx", ["ans"]).collect()}
    assert [s and s["ans"] for s in got["r1"]] == ["A", *[None] * 9, "B"] and got["r2"] == [None] * 11
    with pytest.raises(ValueError, match="2 checkpoints have no run, the first of r0"):
        trajectory.attached(runs, spark.createDataFrame([*own, ("r9", 1, "A"), ("r0", 1, "A")], "parent string, idx int, ans string"), "record_id", "parent", "idx", ["ans"])


def test_inheritance(spark):
    parents = spark.createDataFrame([("p1", "s", 1), ("p2", None, 2)], "pid string, a string, b int")
    children = spark.createDataFrame([("c1", "p1", "s", 1), ("c2", "p1", "t", 3), ("c3", "p2", None, 2), ("c4", "p9", "s", 1), ("c3", "p2", "x", 2)], "cid string, pid string, a string, b int")
    got = sorted((r["cid"], r["orphan"], tuple(r["wrong_fields"]), r["duplicate"]) for r in trajectory.inheritance(children, parents, "pid", ["a", "b"], "cid").collect())
    assert got == [("c1", False, (), False), ("c2", False, ("a", "b"), False), ("c3", False, (), True), ("c3", False, ("a",), True), ("c4", True, (), False)]


def test_audit_of_bins_finds_each_defect(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.random() < 0.5, rng.random()) for _ in range(400)]
    cohort = rank.with_groups(spark.createDataFrame(rows, "subject string, y boolean, c double"))
    keys = ["grouping", "grp"]
    good = calibration.reliability(cohort, keys, F.col("y"), F.col("c")).withColumn("source", F.lit("good"))
    at = (F.col("grp") == "a") & (F.col("bin") == 3)
    broken = {
        "cardinality": good.where(~F.coalesce(at, F.lit(False))),
        "counts": good.withColumn("n", F.col("n") + F.when(at, 1).otherwise(0)),
        "bounds": good.withColumn("accuracy", F.when(at, 1.5).otherwise(F.col("accuracy"))),
        "sums": good.withColumn("contribution", F.col("contribution") + F.when(at, 1e-6).otherwise(0.0)),
        "partition": good.withColumn("n", F.col("n") + F.when((F.col("grouping") == "pooled") & (F.col("bin") == 3), 1).otherwise(0)),
    }
    every = good
    for name, table in broken.items():
        every = every.unionByName(table.withColumn("source", F.lit(name)))
    got = {r["source"]: r for r in calibration.audit(every, cohort, keys, "y", "c").collect()}
    assert [got["good"][k] for k in broken] == [0] * 5
    for name in broken:
        assert got[name][name] == 1, name


def test_inventory_and_identity_do_not_depend_on_order(spark):
    lines = [("s1/a", "x"), ("s1/a", "yy"), ("s0/b", ""), ("s0/b", "é")]
    make = lambda rows: coverage.inventory(spark.createDataFrame(rows, "path string, line string"), ["path"], "line")
    a, b = make(lines), make(lines[::-1])
    assert sorted(a.collect()) == sorted(b.collect()) and {r["path"]: (r["lines"], r["bytes"]) for r in a.collect()} == {"s1/a": (2, 5), "s0/b": (2, 4)}
    ident = lambda files, names: coverage.report_identity(files.select("path", "bytes", "mark"), names).first()[0]
    assert ident(a, ["m"]) == ident(b, ["m"]) != ident(a, ["n"])
    assert ident(make([*lines[:3], ("s0/b", "e")]), ["m"]) != ident(a, ["m"])


def test_files_made_once_snapshots_and_reports(spark, tmp_path):
    records.create_once(spark, str(tmp_path / "one"), "first\n")
    with pytest.raises(FileExistsError):
        records.create_once(spark, str(tmp_path / "one"), "second\n")
    assert (tmp_path / "one").read_text() == "first\n"
    (tmp_path / "two").write_text("2")
    before = records.snapshot(spark, str(tmp_path / "*o*")).select("name", "bytes", "sha256")
    before = spark.createDataFrame(before.collect(), before.schema)
    (tmp_path / "two").write_text("3")
    (tmp_path / "oooh").write_text("new")
    now = records.snapshot(spark, str(tmp_path / "*o*")).select("name", "bytes", "sha256")
    assert {r["name"]: r["unchanged"] for r in records.unchanged(before, now, "name").collect()} == {"one": True, "two": False, "oooh": False}
    table = spark.createDataFrame([("a", 1), ("b", None)], "name string, n int").orderBy("name")
    want = {"markdown": ["| name | n |", "|---|---|", "| a | 1 |", "| b |  |"], "latex": ["\\begin{tabular}{lr}", "name & n \\\\", "a & 1 \\\\", "b &  \\\\", "\\end{tabular}"], "json": ['{"name":"a","n":1}', '{"name":"b"}']}
    for sink, lines in want.items():
        records.write_report(table, str(tmp_path / sink), sink)
        assert [r["value"] for r in spark.read.text(str(tmp_path / sink)).collect()] == lines


def test_joint_logistic_model(spark):
    from plumbline.plans import figures
    from plumbline.plans.domain import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    got = {r["statistic"]: r["estimate"] for r in figures.ana12_logit(t).collect()}
    e = figures._length_rows(t).toPandas()
    x = np.stack([np.ones(len(e)), e["h"], e["l"], *[(e["subject"] == s).astype(float) for s in scalars.SUBJECTS[1:]]], 1)
    y, beta, ridge = e["c"].to_numpy(), np.zeros(x.shape[1]), np.diag([0.0] + [1e-6] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
    assert np.allclose([v for k, v in got.items() if k != "area"], beta, atol=1e-6)
    assert math.isclose(got["area"], plain_area(list(zip(e["correct"], np.round(x @ beta, 8), strict=True))), abs_tol=1e-3)


def test_within_question(spark):
    rows = [("q0", True, 8.0), ("q0", True, 6.0), ("q0", False, 2.0), ("q1", True, 5.0), ("q1", False, 1.0), ("q2", True, 9.0)]
    got = {r["q"]: r["difference"] for r in stats.within_differences(spark.createDataFrame(rows, "q string, y boolean, x double"), ["q"], "y", "x").collect()}
    assert got == {"q0": 5.0, "q1": 4.0}


def test_macro_needs_all_subjects(spark):
    rows = [(1, "subject", f"s{i}", 10, None if i == 2 else 0.5) for i in range(5)] + [(2, "subject", f"s{i}", 10, i / 10) for i in range(5)]
    got = {r["k"]: r["v"] for r in rank.macro(spark.createDataFrame(rows, "k int, grouping string, grp string, n bigint, v double"), ["k"], "v", ["n"]).collect()}
    assert got[1] is None and math.isclose(got[2], 0.2)


def test_placement_rounds_halves_to_even(spark):
    df = spark.range(300).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"))
    for r in df.select("n", "i", scalars.placement(F.col("i"), F.col("n")).alias("k")).collect():
        assert r["k"] == min(max(int(round(r["i"] / 10 * r["n"])), 0), r["n"])


def test_logistic_and_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000)
    y = rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))
    df = spark.createDataFrame([(float(a), bool(b), float(3 - 2 * a)) for a, b in zip(x, y, strict=True)], "x double, y boolean, z double")
    beta = stats.logistic(df, [F.lit(1.0), F.col("x")], F.col("y").cast("double"))
    p = 1 / (1 + np.exp(-(beta[0] + beta[1] * x)))
    assert abs(((y - p) * x).sum() - 1e-6 * beta[1]) < 1e-6 and abs((y - p).sum()) < 1e-6
    fit, r2 = stats.ols(df, [F.lit(1.0), F.col("x")], F.col("z"))
    assert np.allclose(fit, [3, -2]) and math.isclose(r2, 1.0)


def test_dispositions(spark):
    cases = [(2, True, None, "complete", "duplicate"), (0, True, None, None, "retryable_incomplete"), (0, False, None, None, "missing"), (1, False, "schema_incompatible", "complete", "schema_incompatible"), (1, False, None, "odd", "schema_incompatible"), (1, False, None, "complete", "complete")]
    df = spark.createDataFrame(cases, "seen int, tried boolean, defect string, outcome string, want string")
    assert df.where(coverage.natural_disposition(F.col("seen"), F.col("tried"), F.col("defect"), F.col("outcome")) != F.col("want")).isEmpty()
    below = [(1, True, None, "complete", "terminal_infrastructure_failure", "ineligible"), (2, False, None, None, "missing", "duplicate"), (1, True, None, "complete", "missing", "retryable_incomplete"), (1, False, "x", "complete", "complete", "missing"), (1, False, None, "complete", "complete", "complete")]
    df = spark.createDataFrame(below, "seen int, tried boolean, defect string, outcome string, parent string, want string")
    assert df.where(coverage.checkpoint_disposition(F.col("seen"), F.col("tried"), F.col("defect"), F.col("outcome"), F.col("parent")) != F.col("want")).isEmpty()


def test_lifecycle_grammar(spark):
    S, F_, I, Cc, R = events.STARTED, events.FAILED, events.INTERRUPTED, events.COMPLETED, events.RECOVERED
    # attempt, closing events with record and decision, has a record, coherent
    cases = [
        ([], False, True), ([(F_, None, "retry")], False, True), ([(F_, None, "retry")], True, False), ([(Cc, 1, None)], True, True), ([(Cc, 9, None)], True, False),
        ([(R, 1, None), (Cc, 1, None)], True, True), ([(Cc, 9, None), (I, None, "retry")], False, True), ([(I, None, "exhausted"), (Cc, 1, None)], True, True),
        ([(I, None, "retry"), (Cc, 1, None)], True, False), ([(Cc, 1, None), (I, None, "exhausted"), (Cc, 1, None)], True, True), ([(F_, None, "retry"), (F_, None, "retry")], False, False),
    ]
    log, recs = [], []
    for k, (closing, record, _) in enumerate(cases):
        log.append((k, 1, k, 0, S, None, None))
        log += [(k, 1, k, i + 1, t, None if r is None else (k if r == 1 else 1000), d) for i, (t, r, d) in enumerate(closing)]
        if record:
            recs.append((k, k, k))
    ev = spark.createDataFrame(log, "key int, attempt int, attempt_id bigint, seq int, type string, record_id bigint, retry_decision string")
    got = events.attempts(ev, spark.createDataFrame(recs, "record_id bigint, key int, attempt_id bigint"), ["key"]).select("key", events.coherent().alias("ok")).collect()
    assert {r["key"]: r["ok"] for r in got} == {k: want for k, (_, _, want) in enumerate(cases)}


def test_malformed_middle_line_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": \n{"k": 3}\n')
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n{"k": 2}\n{"k"')
    good = records.strict(records.lines(spark, str(tmp_path / "b.jsonl")), "k INT")
    assert sorted(r["status"] for r in good.collect()) == ["record", "record", "tail"]
    with pytest.raises(Exception, match="malformed JSON"):
        records.reject_middle(records.strict(records.lines(spark, str(tmp_path / "a.jsonl")), "k INT")).collect()


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = records.lines(spark, str(tmp_path / "big.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 5000 and all(r["value"] == f"line {r['line_no']}" for r in got)


def test_typed_csv_rejects_what_breaks_the_contract(spark, tmp_path):
    for k, text in enumerate(["x\n01\n", "x\n+1\n", 'x\n""\n']):
        (tmp_path / f"{k}.csv").write_text(text)
        with pytest.raises(Exception, match="contract"):
            records.read_csv(spark, str(tmp_path / f"{k}.csv"), {"x": ("integer", False)}).collect()


def test_publish_never_replaces(spark, tmp_path):
    records.publish(spark.range(10), str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        records.publish(spark.range(5), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_canonical_json():
    assert identity.canonical({"b": 1e-7, "a": ["x\r\ny", None, True]}) == '{"serialization_version":"part1-canonical-json-v1","value":{"a":["x\\ny",null,true],"b":1e-07}}'
    with pytest.raises(ValueError, match="finite"):
        identity.canonical(float("nan"))
    with pytest.raises(ValueError, match="line ends"):
        identity.canonical({"a\r": 1, "a\n": 2})


def test_long_answer_texts(spark):
    text = "x" * 200_000 + "</think>\n" + "so " * 50_000 + "\nAnswer: C\r\nConfidence: 70"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(scalars.terminal_block(scalars.natural_region(F.col("t"))).alias("p")).collect()
    assert got[0]["p"]["answer"] == "C" and got[0]["p"]["confidence"] == 70
    assert got[1]["p"]["answer_status"] == "missing" and got[2]["p"]["answer_status"] == "missing"


def test_registered_metrics(spark):
    from plumbline.operators import metrics

    df = spark.createDataFrame([("a", True, 0.9), ("a", False, 0.2), ("b", True, 0.1), ("b", False, 0.1), ("b", None, 0.3)], "g string, y boolean, x double")
    if "spread" not in metrics._METRICS:
        metrics.register_metric("spread", metrics.from_values(lambda y, x: float(np.ptp(x))))
    got = {name: {r["g"]: r["value"] for r in metrics.evaluate(name, df, ["g"]).collect()} for name in ("auroc", "ece", "mean_difference", "spread")}
    assert got["auroc"] == {"a": 1.0, "b": 0.5} and math.isclose(got["spread"]["a"], 0.7) and got["spread"]["b"] == 0.0
    assert math.isclose(got["mean_difference"]["a"], 0.7) and math.isclose(got["ece"]["a"], 0.15)
    with pytest.raises(ValueError, match="already"):
        metrics.register_metric("auroc", lambda rows, groups: rows)


def test_percentiles(spark):
    from plumbline.operators.rank import percentiles

    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([rng.random(), 0.5])) for _ in range(500)] + [("c", 1.0), (None, 2.0), (None, 4.0)]
    got = {r["g"]: (r["lo"], r["hi"]) for r in percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"lo": 0.1, "hi": 0.75}).collect()}
    for g in ("a", "b", "c", None):
        want = np.percentile([x for k, x in rows if k == g], [10, 75])
        assert np.allclose(got[g], want, rtol=1e-12)


def test_repair_of_last_lines(spark, tmp_path, monkeypatch):
    log, journal = tmp_path / "log", str(tmp_path / "journal")
    log.mkdir()
    (log / "a.jsonl").write_text('{"k": 1}\n{"k": 2}\n{"k"')
    (log / "b.jsonl").write_text('{"k": 3}\n')
    again = lambda: records.recover_tails(spark, str(log / "*.jsonl"), "k INT", journal)
    with monkeypatch.context() as m:  # the writer dies with the repaired lines written, the old file still there
        m.setattr(records, "_finish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            again()
    assert (log / "a.jsonl").read_text().endswith('{"k"')
    (log / "a.jsonl").unlink()  # or gone already
    assert again() == [] and (log / "a.jsonl").read_text() == '{"k": 1}\n{"k": 2}\n'
    assert sorted(p.suffix for p in (tmp_path / "journal").iterdir() if not p.name.startswith(".")) == [".json", ".quarantine"]
    (log / "b.jsonl").write_text('{"k": 3}\nnonsense')
    got = again()
    assert [(f.rsplit("/", 1)[1], n) for f, n, _ in got] == [("b.jsonl", 8)] and (log / "b.jsonl").read_text() == '{"k": 3}\n' and again() == []
    (log / "c.jsonl").write_text('{"k": \n{"k": 3}\n')
    with pytest.raises(Exception, match="malformed JSON"):
        again()
