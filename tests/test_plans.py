"""Chained plans, registries and bundle files."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortforge.functions.hashing import population_hash
from cohortforge.operators import cox, crossval, endpoints, inference, provenance, scaler
from cohortforge.plans import assembly, development
from cohortforge.sources import bundled, signature_specs, store


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


CELL = "cohort_id string, gene string, sample_id string, value double"


def test_assembly_chain(spark):
    cells = [
        ("c", "A", 1, "TCGA-AA-0001-01B", 5.0), ("c", "A", 2, "TCGA-AA-0001-01B", 9.0),
        ("c", "A", 1, "TCGA-AA-0001-01A", 1.0), ("c", "A", 2, "TCGA-AA-0001-01A", 2.0),
        ("c", "A", 1, "TCGA-AA-0002-11A", 7.0), ("c", "A", 1, "junk", 7.0), ("c", "A", 1, "tcga-aa-0003", 4.0),
    ]
    df = frame(spark, cells, "cohort_id string, gene string, feature_pos long, barcode string, value double")
    got = {r["sample_id"]: r["value"] for r in assembly.assemble(df, collapse="first").collect()}
    assert got == {"TCGA-AA-0001": 1.0, "TCGA-AA-0003": 4.0}
    best = {r["sample_id"]: r["value"] for r in assembly.assemble(df, aliquot_rule="mean").collect()}
    assert best["TCGA-AA-0001"] == pytest.approx(5.5)
    manifest = frame(spark, [(c[3],) for c in cells[1:]] + [("TCGA-AA-0009-01A",)], "barcode string").distinct()
    clinical = frame(spark, [("TCGA-AA-0001",)], "patient string")
    rows = {r["stage"]: (r["n_in"], r["n_out"]) for r in assembly.loss_counts(manifest, df, clinical).collect()}
    assert rows == {"landed_files": (6, 5), "primary_samples": (5, 3), "patients": (3, 2), "clinical_join": (2, 1)}
    with pytest.raises(ValueError):
        assembly.require_landed(manifest, df)
    assert assembly.require_landed(manifest, df, tolerate=1) is df


def test_filter_problems_and_alignment(spark):
    rows = [("c", "a", {"x": "1"}), ("c", "b", {"x": "2"})]
    clinical = frame(spark, rows, "cohort_id string, sample_id string, attrs map<string,string>")
    rules = [{"column": "nope", "drop": ["z"]}, {"column": "x", "keep": ["9"]}]
    got = sorted(tuple(r) for r in endpoints.filter_problems(clinical, rules).collect())
    assert got == [("c", 1, "unknown_column"), ("c", 2, "removed_every_sample")]
    left = frame(spark, [("c", "a"), ("c", "z")], "cohort_id string, sample_id string")
    bad = {r["problem"]: r["examples"] for r in endpoints.misaligned(left, clinical).collect()}
    assert bad == {"expression_only": ["z"], "clinical_only": ["b"]}


def test_feature_contract(spark):
    df = frame(spark, [("c", "g1", "a", 1.0), ("c", "g1", "b", float("nan")), ("c", "g2", "a", 1.0), ("c", "g2", "b", 2.0)], CELL)
    outcomes = frame(spark, [("c", "a"), ("c", "z")], "cohort_id string, sample_id string")
    got = sorted(tuple(r) for r in crossval.contract_problems(df, outcomes, ["g1", "g2", "g3"]).collect())
    assert got == [
        ("c", "missing_or_nonfinite_value", 1), ("c", "missing_required_genes", 1),
        ("c", "outcome_without_sample", 1), ("c", "sample_without_outcome", 1),
    ]


def test_reference_registry(spark, tmp_path):
    df = frame(spark, [("c", "ABCB6", s, v) for s, v in zip("abc", (1.0, 2.0, 4.0))], CELL)
    ref = scaler.build_reference(df, bundled.signatures(spark), population_hash(df, ["cohort_id"]))
    path = str(tmp_path / "refs")
    store.save_references(ref, path)
    assert store.load_references(spark, path, ["c/prostate20"]).count() == 1
    assert store.list_references(spark, path).first()["n_train"] == 3
    with pytest.raises(ValueError):
        store.load_references(spark, path, ["nope"])
    spark.read.parquet(path + "/rows").withColumn("mean", F.col("mean") + 1).write.parquet(path + "/other")
    changed = spark.read.parquet(path + "/other")
    changed.write.mode("overwrite").parquet(path + "/rows")
    with pytest.raises(ValueError):
        store.load_references(spark, path)


def test_bundle_files(spark, tmp_path):
    root = tmp_path / "bundle"
    root.mkdir()
    parts = {
        "model.json": {"model_id": "m", "version": "1", "coefficient": 0.5},
        "scaler.json": {"composite_mean": 0.0, "composite_sample_sd": 1.0, "genes": ["A"], "gene_means": {"A": 1.0}, "gene_sample_sds": {"A": 2.0}},
        "features.json": {"expression_type": "log"},
        "training.json": {"score_reference_sorted": [-1.0, 1.0]},
    }
    hashes = {}
    for name, body in parts.items():
        text = json.dumps(body, indent=1)
        (root / name).write_text(text)
        hashes[name] = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    hashes["training.json"] = "sha256:0"
    hashes["metrics.json"] = "sha256:1"
    (root / "manifest.json").write_text(json.dumps({"model_id": "m", "files": hashes}))
    status = {r["name"]: r["status"] for r in store.bundle_file_status(spark, str(tmp_path)).collect()}
    assert status == {"model.json": "ok", "scaler.json": "ok", "features.json": "ok", "training.json": "changed", "metrics.json": "missing"}
    model = store.read_bundles(spark, str(tmp_path))
    cells = frame(spark, [("s", "A", 3.0, "log"), ("t", "B", 3.0, "log")], "sample_id string, gene string, value double, expression_type string")
    got = {r["sample_id"]: (r["score"], r["training_percentile"], r["error_code"]) for r in inference.assess(cells, *model).collect()}
    assert got["s"] == (1.0, 100.0, "") and got["t"][2] == "MISSING_REQUIRED_GENES"
    store.write_predictions(inference.predictions(inference.assess(cells, *model)), str(tmp_path / "out"), "tsv")
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).columns == inference.PREDICTION_COLUMNS


def test_signature_spec_files(spark, tmp_path):
    specs = [
        {"name": "ok", "genes": ["B", "A"], "scoring": "rowmean", "checksum": "sha256:" + hashlib.sha256(b"A\nB").hexdigest()},
        {"name": "empty", "genes": [], "scoring": "rowmean"},
    ]
    for s in specs:
        (tmp_path / f"{s['name']}.json").write_text(json.dumps(s))
    read = signature_specs.read(spark, str(tmp_path))
    got = {r["signature"]: r["error_code"] for r in signature_specs.validate(read).collect()}
    assert got == {"ok": "", "empty": "empty_gene_list"}
    assert [r["gene"] for r in signature_specs.to_rows(read).orderBy("gene_pos").collect()] == ["B", "A"]


def test_provenance_rows(spark):
    named = frame(spark, [("c", "sha256:x")], "cohort_id string, content_checksum string")
    sigs = frame(spark, [("s", "sha256:y")], "signature string, checksum string")
    authority = frame(spark, [("a", "sha256:z")], "name string, checksum string")
    rows = provenance.record_inputs("r1", named, sigs, authority)
    assert {(r["kind"], r["name"]) for r in rows.collect()} == {("cohort", "c"), ("signature", "s"), ("symbol_authority", "a")}
    step = provenance.record_step(spark, "c", 1, "align", {"n": 3}).first()
    assert step["detail"] == {"n": "3"} and step["action"] == "align"
    counts = frame(spark, [("c", 4)], "cohort_id string, n long")
    assert provenance.steps_from_counts(counts, "qc", 2).first()["detail"] == {"n": "4"}


def test_locked_cohort_and_gathered_results(spark):
    clinical = frame(spark, [("a", 304.4, 10.0, 1, 1), ("b", 100.0, 9.9, 0, 0)], "sample_id string, time_days double, time_months double, event_uncapped int, event int")
    ledger = frame(spark, [("a", True, 304.4, 1, 1), ("b", True, 100.0, 0, 0)], "patient string, included boolean, time_days double, event_uncapped int, event int")
    pinned = frame(spark, [(2, 1, 0)], "n long, n_uncapped long, n_events long")
    got = sorted(tuple(r) for r in development.locked_problems(clinical, ledger, pinned).collect())
    assert got == [("month_derivation", 1), ("pinned_counts", 2)]
    joined = development.gather_results({("x", "b"): counts_of(spark, 1), ("x", "a"): counts_of(spark, 2)})
    assert [(r["cohort"], r["action"], r["n"]) for r in joined.collect()] == [("x", "a", 2), ("x", "b", 1)]


def counts_of(spark, n):
    return frame(spark, [(n,)], "n int")


def test_model_comparison_and_transfer(spark):
    rng = np.random.default_rng(4)
    n, genes = 96, ["g0", "g1"]
    z = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(scale=np.exp(-0.8 * z.sum(1))) * 20)
    e = (rng.random(n) < 0.6).astype(int)
    people = frame(spark, [("c", f"s{i:02d}", float(t[i]), int(e[i])) for i in range(n)], "cohort_id string, sample_id string, time_months double, event int")
    matrix = frame(spark, [("c", g, f"s{i:02d}", float(z[i, j])) for i in range(n) for j, g in enumerate(genes)], CELL)
    grid = frame(spark, [(0, 0.05, 0.5)], "candidate int, alpha double, l1_ratio double")
    out = development.compare_models(matrix, people, genes, grid, outer=2, inner=2, repeats=1, draws=20)
    rows = {r["model"]: r for r in out["comparison"].collect()}
    assert set(rows) == {"fixed_cox", "elastic_net"}
    for r in rows.values():
        assert r["mean_c"] > 0.6 and r["ci_low"] <= r["ci_high"] and not r["too_few_valid"]
    assert out["differences"].count() == 1
    fitted = scaler.fit(matrix, ["cohort_id"])
    weights = frame(spark, [("c", "g0", 1.0), ("c", "g1", -1.0)], "cohort_id string, feature string, coefficient double")
    risk = crossval.apply_model(matrix, fitted, weights, ["cohort_id"])
    assert risk.count() == n
    assert cox.invalid_requests(people, ["cohort_id"]).count() == 0


def test_an_append_does_not_vouch_for_stored_references(spark, tmp_path):
    df = frame(spark, [(c, "ABCB6", s, v) for c in "cd" for s, v in zip("abc", (1.0, 2.0, 4.0))], CELL)
    ref = scaler.build_reference(df, bundled.signatures(spark), population_hash(df, ["cohort_id"]))
    first, second = ref.filter("reference_cohort = 'c'"), ref.filter("reference_cohort = 'd'")
    path = str(tmp_path / "refs")
    store.save_references(first, path)
    with pytest.raises(ValueError, match="exists"):
        store.save_references(first, path)
    first.limit(1).withColumn("gene", F.lit("planted")).write.mode("append").parquet(path + "/rows")
    store.save_references(second, path)
    with pytest.raises(ValueError):
        store.load_references(spark, path)
    assert store.load_references(spark, path, ["d/prostate20"]).count() == 1


def test_percentiles_by_blocks_and_a_restarted_stream(spark, tmp_path):
    """Streamed percentiles equal the ranked ones, and a second run with the same folder takes new files only."""
    from cohortforge.streaming import frozen, sinks

    rng = np.random.default_rng(3)
    scores = [(m, float(v)) for m in ("a", "b") for v in np.round(rng.normal(size=150), 1)]
    ranks = inference.ranked_scores(frame(spark, scores, "model_id string, score double"), ["model_id"])
    model = frame(spark, [(m, "1", "log", 0.5, 0.0, 1.0) for m in "ab"], inference.MODEL_SCHEMA)
    constants = frame(spark, [(m, "g", 0.0, 1.0) for m in "ab"], "model_id string, gene string, mean double, sd double")
    asked = [(f"s{i}", "log", {"g": float(v)}, "abz"[i % 3]) for i, v in enumerate(np.round(rng.normal(size=60) * 2, 1))]
    schema = "sample_id string, expression_type string, expr map<string,double>, model_id string"
    landing, base = str(tmp_path / "landing"), str(tmp_path / "run")

    def run():
        return sinks.run_available(spark, landing, schema, lambda s: frozen.predict_stream(s, model, constants, ranks), base=base)

    frame(spark, asked[:40], schema).write.parquet(landing)
    assert run().count() == 40
    frame(spark, asked[40:], schema).write.mode("append").parquet(landing)
    got = {r["sample_id"]: r for r in run().collect()}
    assert len(got) == 60
    for name, _, expr, m in asked:
        if m == "z":
            assert got[name]["error_code"] == "MODEL_NOT_FOUND"
            continue
        own = [v for k, v in scores if k == m]
        assert got[name]["training_percentile"] == pytest.approx(100 * sum(v <= expr["g"] for v in own) / len(own))


@pytest.mark.parametrize(
    "change, problem",
    [
        ({}, None),
        ({"model.json": {"model_id": "m", "version": "1"}}, "coefficient_missing"),
        ({"scaler.json": {"composite_mean": 0.0, "composite_sample_sd": 1.0, "genes": ["A", "B"], "gene_means": {"A": 1.0}, "gene_sample_sds": {"A": 2.0}}}, "gene_without_constants"),
        ({"scaler.json": {"composite_mean": 0.0, "composite_sample_sd": 1.0, "genes": ["A"], "gene_means": {"A": 1.0}, "gene_sample_sds": {"A": 0.0}}}, "scaler_not_positive"),
        ({"scaler.json": {"composite_mean": 0.0, "composite_sample_sd": 0.0, "genes": ["A"], "gene_means": {"A": 1.0}, "gene_sample_sds": {"A": 2.0}}}, "composite_not_positive"),
        ({"training.json": {"score_reference_sorted": []}}, "scores_missing"),
        ({"training.json": {"score_reference_sorted": [2.0, 1.0]}}, "scores_not_sorted"),
    ],
)
def test_bundle_invariants(spark, tmp_path, change, problem):
    root = tmp_path / "bundle"
    root.mkdir()
    parts = {
        "model.json": {"model_id": "m", "version": "1", "coefficient": 0.5},
        "scaler.json": {"composite_mean": 0.0, "composite_sample_sd": 1.0, "genes": ["A"], "gene_means": {"A": 1.0}, "gene_sample_sds": {"A": 2.0}},
        "features.json": {"expression_type": "log"},
        "training.json": {"score_reference_sorted": [-1.0, 1.0]},
    } | change
    hashes = {}
    for name, body in parts.items():
        text = json.dumps(body)
        (root / name).write_text(text)
        hashes[name] = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    (root / "manifest.json").write_text(json.dumps({"model_id": "m", "files": hashes}))
    assert [r["problem"] for r in store.bundle_problems(spark, str(tmp_path)).collect()] == ([problem] if problem else [])
    (root / "features.json").write_text("{}")
    assert [r["problem"] for r in store.bundle_problems(spark, str(tmp_path)).collect()] == ["file_changed"]
