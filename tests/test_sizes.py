"""Results that must not depend on how rows are dealt to tasks, and work that must grow with the rows."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from cohortforge.catalogue import record_queries
from cohortforge.functions import digests, staging
from cohortforge.operators import concordance, cox, crossval, fold_blocks, folds, net_path, pair_counts, provenance, quality, resample, scaler
from cohortforge.sources import series_matrix
from tests.test_operators import CELL, frame, survival_rows


def test_equal_values_are_flat_however_they_are_dealt(spark):
    # Partial sums of 49 ones merge to a mean under one: 1 / 49 * 49.
    ids = spark.range(0, 49 * 5, 1, 5).select(F.lit("c").alias("cohort_id"), F.col("id").cast("string").alias("sample_id"))
    one = ids.select("*", F.lit("one").alias("gene"), F.lit(0).alias("feature_pos"), F.lit(1.0).alias("value"))
    other = ids.select("*", F.lit("other").alias("gene"), F.lit(1).alias("feature_pos"), F.col("sample_id").cast("double").alias("value"))
    found = quality.findings(one.unionByName(other), min_samples=1).filter("code = 'zero_variance'").collect()
    assert [(r["n"], r["examples"]) for r in found] == [(1.0, ["one"])]


def test_files_are_digested_without_being_held_whole(spark, tmp_path):
    content = bytes(range(256)) * 40
    (tmp_path / "a b.bin").write_bytes(content)
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 1000)
    try:
        got = {r["name"]: (r["n_bytes"], r["checksum"]) for r in provenance.file_inventory(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(limit)
    whole = "sha256:" + hashlib.sha256(content).hexdigest()
    assert got == {"a b.bin": (len(content), whole)}


def test_a_time_shared_by_most_samples_is_several_blocks(spark, monkeypatch):
    t, e, z = survival_rows(5, n=120, p=3)
    cap = float(np.quantile(t, 0.5))
    t, e = np.minimum(np.round(t, 1) + 0.1, cap), np.where((t < cap) | (np.arange(120) % 7 == 0), e, 0)
    people = frame(spark, [("c", f"s{i}", float(t[i]), int(e[i])) for i in range(120)], "cohort_id string, sample_id string, time_months double, event int")
    matrix = frame(spark, [("c", f"g{j}", f"s{i}", float(z[i, j])) for i in range(120) for j in range(3)], CELL)
    plan = folds.plan(people, 2, 2, 1)
    grid, found = [(0, 0.05, 0.9), (1, 0.02, 0.5)], []
    for size in (1000, 15):
        monkeypatch.setattr(net_path, "BLOCK_ROWS", size)
        rows = net_path.member_rows(matrix, people, plan, ["g0", "g1", "g2"], "cohort_id")
        largest = rows.groupBy("_b", "_s").count().agg(F.max("count")).first()[0]
        assert largest <= 2 * size
        states = net_path.fit_paths(rows, grid, 2, "cohort_id").collect()
        assert all(d == 1 for s in states for d in s["done"])
        found.append({(s["fold"], s["inner_fold"]): np.array(s["beta"]) for s in states})
    assert any(b.any() for b in found[0].values())
    assert all(np.allclose(found[0][k], found[1][k], atol=1e-6) for k in found[0])


def test_cells_of_a_wide_line_do_not_split_it_again(spark):
    text = ["!Sample_title\t\"a\"\t\"b\"", "!series_matrix_table_begin", "\"ID_REF\"\t\"s1\"\t\"s2\"", "\"g\"\t1\t2", "!series_matrix_table_end"]
    lines = frame(spark, [("f", i, t) for i, t in enumerate(text)], "file string, line_no long, line string")
    for cells in (series_matrix._meta(lines), series_matrix.expression(lines)):
        # Top down: what stands above a Generate is evaluated for each of its rows.
        plan = cells._jdf.queryExecution().optimizedPlan().toString()
        above = plan.split("Generate posexplode")[0]
        assert "Generate" in plan and "split(" not in above and "header" not in above
    assert {(r["feature"], r["sample_id"], r["value"]) for r in series_matrix.expression(lines).collect()} == {("g", "s1", 1.0), ("g", "s2", 2.0)}


def test_permutations_of_a_fold_are_not_rows(spark, monkeypatch):
    t, e, z = survival_rows(9, n=60, p=2)
    cells = [(1 + i % 2, f"s{i}", f"g{j}", float(z[i, j])) for i in range(60) for j in range(2)]
    features = frame(spark, cells, "fold int, sample_id string, gene string, z double")
    # One sample has no outcome; its contribution is exchanged all the same.
    people = frame(spark, [(f"s{i}", float(t[i]), int(e[i])) for i in range(59)], "sample_id string, time_months double, event int")
    weights = frame(spark, [(f, g, w) for f in (1, 2) for g, w in (("g0", 1.0), ("g1", -0.5))], "fold int, gene string, coefficient double")

    def drops():
        rows = resample.permutation_drops(features, people, weights, ["fold"], 3).collect()
        return {(r["fold"], r["gene"], r["permutation"]): round(r["c_drop"], 9) for r in rows}

    monkeypatch.setattr(resample, "PERMUTED_ROWS", 10, raising=False)
    by_rows = drops()
    monkeypatch.setattr(resample, "PERMUTED_ROWS", 1000, raising=False)
    monkeypatch.setattr(resample, "hashed_position", None)
    assert len(by_rows) == 12 and any(by_rows.values()) and drops() == by_rows


def test_draws_are_dealt_by_slots_and_blocks(spark, monkeypatch):
    people = frame(spark, [(c, f"p{i}") for c in "xy" for i in range(50 if c == "x" else 23)], "cohort_id string, sample_id string")
    want = {
        (r["cohort_id"], r["draw"], r["sample_id"]): r["weight"]
        for r in resample.patient_weights(people, 7, by=["cohort_id"]).collect()
    }
    monkeypatch.setattr(resample, "SLOTS_AT_ONCE", 10, raising=False)
    monkeypatch.setattr(resample, "BIN_SLOTS", 8, raising=False)
    lists = resample.draw_lists(people, 7, block=3, by=["cohort_id"])
    # 5 and 3 ranges of slots in 3 blocks of draws.
    assert "Repartition 24, true" in lists._jdf.queryExecution().optimizedPlan().toString()
    got: dict = {}
    for r in lists.collect():
        for inner in r["_chosen"]:
            key = r["cohort_id"], r["_block"] * 3 + inner + 1, r["sample_id"]
            got[key] = got.get(key, 0) + 1
    assert got == want


def test_halves_of_tied_times_count_every_pair_once(monkeypatch):
    rng = np.random.default_rng(4)
    n = 700
    time = np.minimum(rng.integers(1, 90, n), 60).astype(float)
    event, risk = (rng.random(n) < 0.5).astype(int), np.round(rng.normal(size=n), 1)
    weight = rng.poisson(1, (n, 5)).astype(float)
    later = (time[:, None] < time) | ((time[:, None] == time) & (event == 0))
    pair = (event[:, None] == 1) & later
    share = pair * (np.where(risk[:, None] - risk > 1e-8, 1.0, 0.0) + 0.5 * (np.abs(risk[:, None] - risk) <= 1e-8))
    want = [np.einsum("ic,ij,jc->c", weight, m.astype(float), weight) for m in (pair, share)]
    for direct, pair_cost in ((10**6, 1.0), (0, 0.07), (0, 1e9)):
        monkeypatch.setattr(pair_counts, "DIRECT_ROWS", direct)
        monkeypatch.setattr(pair_counts, "PAIR_COST", pair_cost, raising=False)
        assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(want, pair_counts.concordant(time, event, risk, weight)))
    rows = rng.permutation(n)
    moved = pair_counts.concordant(time, event, risk, weight[np.argsort(rows)], rows)
    assert all(np.array_equal(a, b) for a, b in zip(pair_counts.concordant(time, event, risk, weight), moved))


def _cohorts(spark, n=90, p=3):
    t, e, z = survival_rows(7, n=n, p=p)
    names = [f"s{i:02d}" for i in range(n)]
    people = frame(spark, [(c, s, float(a), int(b)) for c in "xy" for s, a, b in zip(names, t, e)], "cohort_id string, sample_id string, time_months double, event int")
    shift = {"x": 0.0, "y": 5.0}
    # One cell of cohort y is absent, one gene of it doesn't vary.
    cells = [
        (c, f"g{j}", s, 2.0 if (c, j) == ("y", 2) else float(z[i, j]) * (1 + shift[c]) + shift[c])
        for c in "xy" for i, s in enumerate(names) for j in range(p) if (c, i, j) != ("y", 4, 0)
    ]
    return people, frame(spark, cells, CELL)


def test_inner_folds_are_scored_from_one_row_a_sample(spark, monkeypatch):
    people, matrix = _cohorts(spark)
    plan = folds.plan(people, 2, 3, 2)
    sets = {3: ["g0"], 8: ["g0", "g1"], 9: ["g2", "g1"]}
    keys = ["cohort_id", "repeat", "fold", "inner_fold"]
    cells = crossval.cells_of(matrix, crossval.inner_partitions(plan, 3))
    fitted = scaler.fit(cells.filter("role = 'train'"), keys)
    wide = frame(spark, [(c, g) for c, s in sets.items() for g in s], "candidate int, gene string")
    risks = (
        cells.filter("role = 'test'").join(fitted, [*keys, "gene"]).join(wide, "gene").groupBy(*keys, "candidate", "sample_id")
        .agg(F.avg((F.col("value") - F.col("mean")) / F.col("sd")).alias("risk")).join(people, ["cohort_id", "sample_id"])
    )
    order = [*keys, "candidate"]
    want = {tuple(r[k] for k in order): r for r in concordance.harrell(risks, order).collect()}
    monkeypatch.setattr(fold_blocks, "BLOCK_ROWS", 20)
    rows = crossval.composite_search(matrix, people, plan, sets)
    # A cell never meets its partitions as a row of its own.
    assert "inner_partitions" not in crossval.composite_search.__code__.co_names
    got = {tuple(r[k] for k in order): r for r in rows.collect()}
    assert len(want) == 2 * 2 * 2 * 3 * 3 and got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["comparable_pairs"] == r["comparable_pairs"] and abs(got[k]["c_index"] - r["c_index"]) < 1e-12


def test_fold_scores_carry_outcomes_and_refuse_constant_genes(spark, monkeypatch):
    people, matrix = _cohorts(spark)
    plan = folds.plan(people, 3, 2, 2)
    keys = ["cohort_id", "repeat", "fold"]
    lost = people.filter("NOT (cohort_id = 'x' AND sample_id = 's05')")
    plain = crossval.partition_scores(matrix, plan.select(*keys, "sample_id", "role"), keys).filter("NOT (cohort_id = 'x' AND sample_id = 's05')")
    monkeypatch.setattr(fold_blocks, "BLOCK_ROWS", 20)
    scored, constant = crossval.fold_scores(matrix, plan, outcomes=lost)
    raw = {tuple(r[c] for c in [*keys, "sample_id", "role"]): r["raw"] for r in plain.collect()}
    got = {tuple(r[c] for c in [*keys, "sample_id", "role"]): r for r in scored.collect()}
    assert {r["cohort_id"] for r in constant.collect()} == {"y"} and constant.count() == 6
    assert got.keys() == raw.keys() and all(abs(got[k]["raw"] - v) < 1e-9 for k, v in raw.items())
    times = {(r["cohort_id"], r["sample_id"]): (r["time_months"], r["event"]) for r in people.collect()}
    assert all((r["time_months"], r["event"]) == times[k[0], k[3]] for k, r in got.items())


def test_a_key_of_many_rows_and_few_times_has_no_buckets(spark, monkeypatch):
    t, e, z = survival_rows(13, n=400, p=1)
    rows = frame(spark, [(f"k{i % 2}", float(np.ceil(t[i])), int(e[i]), float(z[i, 0])) for i in range(400)], "k string, time_months double, event int, score double")
    want = {r["k"]: r["beta"][0] for r in cox.fit(rows, ["k"], ["score"]).collect()}
    monkeypatch.setattr(cox, "ROWS_PER_BUCKET", 150)
    monkeypatch.setattr(cox, "with_buckets", None)
    got = {r["k"]: r["beta"][0] for r in cox.fit(rows, ["k"], ["score"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_order_lines_are_dealt_in_proportion(spark, monkeypatch):
    rows = spark.range(100)
    assert "Repartition" not in staging.dealt(rows, 100, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert staging.dealt(rows, 40 * staging.TASK_ROWS, "id").rdd.getNumPartitions() == 40
    folder = "/root/testdata/sf0.001"
    want = {tuple(r) for r in record_queries.patient_matrix(spark, folder).collect()}
    monkeypatch.setattr(staging, "TASK_ROWS", 100)
    assert want and {tuple(r) for r in record_queries.patient_matrix(spark, folder).collect()} == want


def _broadcast(df) -> list[str]:
    """Operators of the plan whose rows go to the driver to be broadcast."""
    inside, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            inside.append(line)
        else:
            depth = at if "BroadcastExchange" in line else None
    return inside


def _held(spark, n=60):
    rng = np.random.default_rng(12)
    people = [(f"p{i}", float(rng.integers(1, 20)), int(rng.integers(0, 2))) for i in range(n)]
    rows = [(m, k, (i + k) % 2, s, t, e, float(rng.integers(0, 15))) for k in (1, 2) for m in "ab" for i, (s, t, e) in enumerate(people)]
    return frame(spark, rows, "model string, repeat int, fold int, sample_id string, time_months double, event int, risk double")


def test_draws_never_go_to_the_driver(spark):
    # A few rows of units make any number of draws, so the planner takes the draws for a small table.
    held = _held(spark)
    for df in (resample.draw_lists(held, 300), resample.bootstrap_draws(held, 300)):
        assert not [line for line in _broadcast(df) if "InArrow" in line]


def test_draws_are_the_same_in_any_pieces(spark, monkeypatch):
    held = _held(spark)
    whole = {(r["draw"], r["model"]): r["c"] for r in resample.bootstrap_draws(held, 130).collect()}
    for module, name, value in ((resample, "SLOTS_AT_ONCE", 25), (resample, "UNIT_DIGESTS", 100), (resample, "BIN_SLOTS", 16), (resample, "BLOCK_DRAWS", 40), (pair_counts, "WINDOW_CELLS", 64), (digests, "AT_ONCE", 7)):
        monkeypatch.setattr(module, name, value)
    assert len(whole) == 260
    # Pieces of 4 draws and 25 slots, 4 blocks.
    drawn = resample._drawn(resample._slots(held, []), 130, 902099, 40, [])
    assert "Repartition 99, true" in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["draw"], r["model"]): r["c"] for r in resample.bootstrap_draws(held, 130).collect()} == whole


def test_digests_side_by_side_are_those_of_md5(monkeypatch):
    monkeypatch.setattr(digests, "AT_ONCE", 13)
    prefixes = [b"902099|7|", b"902099|10|", b"902099|2000|", b"x" * 50, b"902099|8|"]
    for start, stop in ((0, 1), (0, 120), (9_990, 10_020), (123_456_789, 123_456_800)):
        want = [[int(hashlib.md5(p + b"%d" % i).hexdigest()[:16], 16) for i in range(start, stop)] for p in prefixes]
        assert np.array_equal(digests.md5_heads(prefixes, start, stop), np.array(want, np.uint64))


def test_packed_arrays_come_back():
    for values in (np.array([0, 3, 255, 256, 65_535], "<u2"), np.array([[0.1, -2.0], [np.inf, 1e-300]]), np.array([-1, 7], "<i4")):
        assert np.array_equal(pair_counts.unpacked(pair_counts.packed(values), values.dtype.str, values.size), values.ravel())


def test_columns_are_counted_alike_however_many_are_held(monkeypatch):
    rng = np.random.default_rng(21)
    n, columns = 900, 40
    time, event = rng.integers(1, 400, n).astype(float), rng.integers(0, 2, n)
    weight = rng.poisson(1, (n, columns)).astype(np.uint16)
    for risk in (rng.normal(size=n), rng.integers(0, 20, n) * 1.0):
        together = pair_counts.concordant(time, event, risk, weight)
        alone = [pair_counts.concordant(time, event, risk, weight[:, [k]].astype(float)) for k in range(columns)]
        monkeypatch.setattr(pair_counts, "CELLS_AT_ONCE", 1)
        few = pair_counts.concordant(time, event, risk, weight)
        monkeypatch.undo()
        for one, other, each in zip(together, few, zip(*alone)):
            assert np.array_equal(one, other) and np.array_equal(one, np.concatenate(each))
