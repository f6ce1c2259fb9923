"""Elastic-net paths, concordance kernels and bootstrap draws against direct computation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortforge.operators import concordance, crossval, folds, net_path, pair_counts, resample
from tests.test_operators import CELL, frame, survival_rows

GRID = [(0, 0.2, 0.9), (1, 0.05, 0.9), (2, 0.01, 0.9), (3, 0.05, 0.2), (4, 0.005, 0.2)]


def _direct(t, e, z, beta):
    """Gradient of the Breslow log likelihood / n."""
    w, total = np.exp(z @ beta), np.zeros(z.shape[1])
    for i in np.flatnonzero(e == 1):
        risk = t >= t[i]
        total += z[i] - (w[risk, None] * z[risk]).sum(axis=0) / w[risk].sum()
    return total / len(t)


def _violation(beta, gradient, alpha, ratio):
    l1, l2 = alpha * ratio, alpha * (1 - ratio)
    free = np.maximum(np.abs(gradient) - l1, 0)
    return np.where(beta == 0, free, np.abs(gradient - l2 * beta - l1 * np.sign(beta))).max()


@pytest.fixture
def cohort(spark):
    t, e, z = survival_rows(21, n=120, p=4)
    t = np.round(t * 4) / 4 + 0.25  # ties
    z[:, 3] = 1.0  # a constant feature
    z[5, 1] = np.nan
    names = [f"s{i:03d}" for i in range(120)]
    people = frame(spark, [("c", s, float(a), int(b)) for s, a, b in zip(names, t, e)], "cohort_id string, sample_id string, time_months double, event int")
    cells = [("c", f"g{j}", s, float(z[i, j])) for i, s in enumerate(names) for j in range(4) if np.isfinite(z[i, j])]
    plan = folds.plan(people, 3, 2, 2)
    return (names, t, e, z), people, frame(spark, cells, CELL), plan


def test_every_candidate_meets_the_conditions(spark, cohort, monkeypatch):
    (names, t, e, z), people, matrix, plan = cohort
    genes = [f"g{j}" for j in range(4)]
    rows = net_path.member_rows(matrix, people, plan, genes, "cohort_id")
    states = net_path.fit_paths(rows, GRID, 2, "cohort_id").collect()
    assert len(states) == 2 * 3 * 3
    roles = {}
    for r in plan.collect():
        roles[r["repeat"], r["fold"], r["sample_id"]] = r["inner_fold"]
    betas = {}
    for s in states:
        inner = np.array([roles[s["repeat"], s["fold"], n] for n in names])
        train = (inner > 0) & (inner != s["inner_fold"])
        x = z[train]
        mean = np.nanmean(x, axis=0)
        sd = np.nanstd(x, axis=0, ddof=1)
        zz = np.nan_to_num((x - mean) / np.where(sd < 1e-8, 1, sd)) * (sd >= 1e-8)
        assert s["n"] == train.sum() and s["events"] == e[train].sum()
        assert np.allclose(s["mean"] + np.nanmean(z, axis=0), mean) and np.allclose(s["sd"], np.where(sd < 1e-8, 0, sd), atol=1e-9)
        for c, (_, alpha, ratio) in enumerate(GRID):
            beta = np.array(s["beta"]).reshape(len(GRID), -1)[c]
            assert s["done"][c] == 1 and s["residual"][c] <= net_path.TOLERANCE
            assert _violation(beta, _direct(t[train], e[train], zz, beta), alpha, ratio) < 1e-6
            betas[s["repeat"], s["fold"], s["inner_fold"], c] = beta
    assert any((b != 0).any() for b in betas.values())
    # Many small blocks give the same fits.
    monkeypatch.setattr(net_path, "BLOCK_ROWS", 25)
    rows = net_path.member_rows(matrix, people, plan, genes, "cohort_id")
    assert rows.select("_b").distinct().count() > 2
    for s in net_path.fit_paths(rows, GRID, 2, "cohort_id").collect():
        again = np.array(s["beta"]).reshape(len(GRID), -1)
        for c in range(len(GRID)):
            assert np.allclose(again[c], betas[s["repeat"], s["fold"], s["inner_fold"], c], atol=1e-6)


def test_search_has_a_row_for_every_fold_and_candidate(spark, cohort):
    (names, t, e, z), people, matrix, plan = cohort
    grid = frame(spark, GRID, "candidate int, alpha double, l1_ratio double")
    genes = [f"g{j}" for j in range(4)]
    out = crossval.penalised_cv(matrix, people, plan, genes, grid, 2)
    search = out["search"].collect()
    assert len(search) == 2 * 3 * 2 * len(GRID) and all(r["error"] is None and r["residual"] <= 1e-6 for r in search)
    assert out["folds"].count() == 6 and out["coefficients"].count() == 24
    # A bound on validation events that no fold meets leaves rows with reasons, not gaps.
    none = crossval.penalised_cv(matrix, people, plan, genes, grid, 2, min_validation_events=1000)
    assert {r["error"] for r in none["search"].collect()} == {"too_few_validation_events"}
    assert {r["error"] for r in none["folds"].collect()} == {"no_usable_candidate"}
    assert none["selected"].count() == 0


def test_fits_that_do_not_converge_are_told(spark, cohort, monkeypatch):
    _, people, matrix, plan = cohort
    monkeypatch.setattr(net_path, "MAX_ROUNDS", 1)
    grid = frame(spark, [(0, 0.01, 0.5)], "candidate int, alpha double, l1_ratio double")
    out = crossval.penalised_cv(matrix, people, plan, [f"g{j}" for j in range(4)], grid, 2)
    assert {r["error"] for r in out["search"].collect()} == {"not_converged"}


@pytest.mark.parametrize("kind", ["continuous", "tied", "near"])
def test_kernels_agree(kind, monkeypatch):
    random = np.random.default_rng(4)
    n = 300
    risk = {"continuous": random.normal(size=n), "tied": random.integers(0, 5, n) * 1.0, "near": random.integers(0, 9, n) * 6e-9}[kind]
    time, event = random.integers(1, 40, n) * 1.0, random.integers(0, 2, n)
    weight = random.integers(0, 4, (n, 7)).astype(float)
    want = np.zeros((2, 7))
    for i in np.flatnonzero(event == 1):
        for j in range(n):
            if time[j] > time[i] or (time[j] == time[i] and event[j] != 1):
                credit = 1.0 if risk[j] < risk[i] - 1e-8 else 0.5 if risk[j] <= risk[i] + 1e-8 else 0.0
                want += np.outer([1.0, credit], weight[i] * weight[j])
    direct = pair_counts.concordant(time, event, risk, weight)
    monkeypatch.setattr(pair_counts, "DIRECT_ROWS", 0)
    monkeypatch.setattr(pair_counts, "CELLS_AT_ONCE", 700)
    digits = pair_counts.concordant(time, event, risk, weight)
    assert np.array_equal(direct, want) and np.array_equal(digits, want)


def test_large_keys_are_counted_without_pairs(spark, monkeypatch):
    random = np.random.default_rng(6)
    rows = [(k, float(random.integers(1, 30)), int(random.integers(0, 2)), float(random.integers(0, 9))) for k in "ab" for _ in range(40 if k == "a" else 9)]
    rows.append(("none", 3.0, 0, 1.0))
    df = frame(spark, rows, "k string, time_months double, event int, risk double")
    whole = {r["k"]: tuple(r) for r in concordance.harrell(df, ["k"]).collect()}
    monkeypatch.setattr(concordance, "GROUP_ROWS", 12)
    split = {r["k"]: tuple(r) for r in concordance.harrell(df, ["k"]).collect()}
    assert whole == split and whole["none"][3] == "no_comparable_pairs"


def test_draws_equal_weights_one_by_one(spark, monkeypatch):
    random = np.random.default_rng(8)
    people = [(f"p{i:02d}", float(random.integers(1, 30)), int(random.integers(0, 2))) for i in range(40)]
    rows = [(m, 1, 1 + i % 2, s, t, e, float(random.integers(0, 12))) for m in "ab" for i, (s, t, e) in enumerate(people)]
    held = frame(spark, rows, "model string, repeat int, fold int, sample_id string, time_months double, event int, risk double")
    weight = {(r["draw"], r["sample_id"]): r["weight"] for r in resample.patient_weights(held, 7).collect()}
    monkeypatch.setattr(resample, "BLOCK_DRAWS", 3)
    got = {(r["draw"], r["model"]): r["c"] for r in resample.bootstrap_draws(held, 7).collect()}
    assert {d for d, _ in got} <= set(range(1, 8)) and len(got) >= 8
    for (draw, model), c in got.items():
        values = []
        for fold in (1, 2):
            part = [r for r in rows if r[0] == model and r[2] == fold]
            w = np.array([[weight.get((draw, r[3]), 0)] for r in part], float)
            time, event, risk = (np.array([r[k] for r in part]) for k in (4, 5, 6))
            comparable, credit = pair_counts.concordant(time, event, risk, w)
            values.append(credit[0] / comparable[0])
        assert c == pytest.approx(np.mean(values))
    monkeypatch.setattr(concordance, "GROUP_ROWS", 5)
    again = {(r["draw"], r["model"]): r["c"] for r in resample.bootstrap_draws(held, 7).collect()}
    assert again.keys() == got.keys() and all(again[k] == pytest.approx(v) for k, v in got.items())


def test_fold_scalers_by_subtraction(spark, cohort):
    from cohortforge.operators import scaler

    _, people, matrix, plan = cohort
    keys = ["cohort_id", "repeat", "fold"]
    tested = plan.filter("role = 'test'").select(*keys, "sample_id")
    got = {(r["repeat"], r["fold"], r["gene"]): r for r in crossval.fold_scalers(matrix, tested).collect()}
    train = matrix.join(plan.filter("role = 'train'").select(*keys, "sample_id"), ["cohort_id", "sample_id"])
    want = scaler.fit(train, keys).collect()
    assert len(want) == len(got) == 24
    for r in want:
        g = got[r["repeat"], r["fold"], r["gene"]]
        assert g["mean"] == pytest.approx(r["mean"], abs=1e-12) and (g["sd"] is None) == (r["sd"] is None)
        assert r["sd"] is None or g["sd"] == pytest.approx(r["sd"], rel=1e-10)
    # The constant gene refuses every fold; without it the scores are those of whole cells.
    assert crossval.fold_scores(matrix, plan)[1].count() == 6
    some = matrix.filter("gene != 'g3'")
    plain = {(r["repeat"], r["fold"], r["sample_id"]): r["score"] for r in crossval.partition_scores(some, plan.select(*keys, "sample_id", "role"), keys).collect()}
    fast = {(r["repeat"], r["fold"], r["sample_id"]): r["score"] for r in crossval.fold_scores(some, plan)[0].collect()}
    assert plain.keys() == fast.keys() and all(fast[k] == pytest.approx(v, abs=1e-9) for k, v in plain.items())


def test_cohorts_are_drawn_and_checked_apart(spark):
    random = np.random.default_rng(9)
    rows = [
        (c, m, 1, 1 + i % 2, f"p{i:02d}", float(random.integers(1, 30)) if c == "x" else float(i + 1), i % 2 if c == "x" else int(i % 3 > 0), float(random.integers(0, 12)))
        for c in "xy" for m in "ab" for i in range(30)
    ]
    times = {(r[0], r[4]): r[5] for r in rows}
    rows = [(*r[:5], times[r[0], r[4]], *r[6:]) for r in rows]
    schema = "cohort_id string, model string, repeat int, fold int, sample_id string, time_months double, event int, risk double"
    held = frame(spark, rows, schema)
    together = {(r["cohort_id"], r["draw"], r["model"]): r["c"] for r in resample.bootstrap_draws(held, 6, by=["cohort_id"]).collect()}
    alone = resample.bootstrap_draws(held.filter("cohort_id = 'y'").drop("cohort_id"), 6).collect()
    assert len(alone) >= 6 and all(together["y", r["draw"], r["model"]] == pytest.approx(r["c"]) for r in alone)
    assert resample.prediction_problems(held, ["cohort_id"]).count() == 0
    bad = held.filter("NOT (cohort_id = 'y' AND model = 'a' AND sample_id = 'p03')").selectExpr(
        *[c for c in held.columns if c != "risk"], "CASE WHEN cohort_id = 'x' AND sample_id = 'p05' THEN double('NaN') ELSE risk END AS risk"
    )
    found = {(r["cohort_id"], r["problem"], r["n"]) for r in resample.prediction_problems(bad, ["cohort_id"]).collect()}
    assert found == {("x", "risk_not_finite", 2), ("y", "unpaired_prediction", 1)}


def test_final_models(spark, cohort):
    """Choice by plain folds and a fit to everyone, against the direct conditions; cohorts that can't be fitted say why."""
    (names, t, e, z), people, matrix, _ = cohort
    genes = [f"g{j}" for j in range(4)]
    still = people.withColumn("cohort_id", F.lit("still")).withColumn("event", F.lit(0))
    tiny = people.filter("sample_id < 's002'").withColumn("cohort_id", F.lit("tiny"))
    people = people.unionByName(still).unionByName(tiny)
    matrix = matrix.unionByName(matrix.withColumn("cohort_id", F.lit("still"))).unionByName(matrix.withColumn("cohort_id", F.lit("tiny")))
    plan = folds.whole_plan(people, 3)
    sizes = {(r["cohort_id"], r["inner_fold"]): r["count"] for r in plan.groupBy("cohort_id", "inner_fold").count().collect()}
    assert [sizes["c", k] for k in (1, 2, 3)] == [40, 40, 40] and sizes["tiny", 1] == sizes["tiny", 2] == 1
    grid = frame(spark, GRID, "candidate int, alpha double, l1_ratio double")
    out = crossval.fit_final(matrix, people, plan, genes, grid, 3)
    model = {r["cohort_id"]: r for r in out["model"].collect()}
    assert set(model) == {"c", "still", "tiny"}
    assert model["still"]["error"] == model["tiny"]["error"] == "no_usable_candidate"
    own = model["c"]
    assert own["error"] is None and (own["n_train"], own["n_events"], own["n_scored"]) == (120, int(e.sum()), 3)
    means = {}
    for r in out["search"].filter("cohort_id = 'c' AND error IS NULL").collect():
        means.setdefault(r["candidate"], []).append(r["c_index"])
    best = min(means, key=lambda c: (-np.mean(means[c]), c))
    assert own["candidate"] == best and own["mean_c"] == pytest.approx(np.mean(means[best]))
    beta = {r["feature"]: r["coefficient"] for r in out["coefficients"].collect()}
    assert {r["cohort_id"] for r in out["coefficients"].collect()} == {"c"}
    mean, sd = np.nanmean(z, axis=0), np.nanstd(z, axis=0, ddof=1)
    zz = np.nan_to_num((z - mean) / np.where(sd < 1e-8, 1, sd)) * (sd >= 1e-8)
    direct = np.array([beta[g] for g in genes])
    _, alpha, ratio = GRID[best]
    assert (own["alpha"], own["l1_ratio"], own["n_selected"]) == (alpha, ratio, (direct != 0).sum())
    assert _violation(direct, _direct(t, e, zz, direct), alpha, ratio) < 1e-6
    frozen = {r["gene"]: r for r in out["scaler"].filter("cohort_id = 'c'").collect()}
    assert frozen["g0"]["mean"] == pytest.approx(mean[0]) and frozen["g0"]["n_fit"] == 120
    # The parts apply to samples as they are.
    risks = crossval.apply_model(matrix.filter("cohort_id = 'c'"), out["scaler"], out["coefficients"], ["cohort_id"])
    got = {r["sample_id"]: r["risk"] for r in risks.collect()}
    assert [got[s] for s in names] == pytest.approx((zz @ direct).tolist())
