"""Operators against brute force and hand-made answers, large-key paths included."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortforge.functions.hashing import population_hash, signature_checksum
from cohortforge.operators import (
    adjudication,
    concordance,
    cox,
    crossval,
    endpoints,
    folds,
    harmonise,
    inference,
    ordering,
    provenance,
    resample,
    scaler,
    scoring,
)
from cohortforge.sources import bundled, store
from cohortforge.streaming import frozen


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Ordering ---------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [50, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_plain_order(spark, monkeypatch, limit, descending):
    rng = random.Random(3)
    data = [("hot", float(v), 1 + v % 3) for v in rng.sample(range(5000), 900)] + [("cold", 1.0, 4), ("cold", 2.0, 5)]
    df = frame(spark, data, "k string, v double, m long")
    got = ordering.spread_totals(df, ["k"], ["v"], ["m"], descending, rows_per_bucket=limit)
    have = {(r["k"], r["v"]): r["cum_m"] for r in got.collect()}
    for key in ("hot", "cold"):
        total = 0
        for k, v, m in sorted((d for d in data if d[0] == key), key=lambda d: d[1], reverse=descending):
            total += m
            assert have[(k, v)] == total


def test_large_keys_are_split(spark):
    df = frame(spark, [("hot", float(i)) for i in range(2000)] + [("cold", 1.0)], "k string, v double")
    placed = ordering.with_buckets(df, ["k"], "v", rows_per_bucket=100)
    sizes = {r["_bucket"]: r["count"] for r in placed.filter("k = 'hot'").groupBy("_bucket").count().collect()}
    assert len(sizes) > 10 and max(sizes.values()) < 600
    assert {r["_bucket"] for r in placed.filter("k = 'cold'").collect()} == {0}


@pytest.mark.parametrize("limit", [20, 10_000])
def test_hashed_position_is_digest_order(spark, limit):
    df = frame(spark, [(str(i),) for i in range(300)], "s string").withColumn("d", F.md5("s")).withColumn("k", F.lit(1))
    got = {r["s"]: r["position"] for r in ordering.hashed_position(df, ["k"], "d", "s", rows_per_bucket=limit).collect()}
    order = sorted(got, key=lambda s: hashlib.md5(s.encode()).hexdigest())
    assert [got[s] for s in order] == list(range(1, 301))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(size=501), "crowded": 10 + rng.normal(size=400) * 1e-6,
        "tied": np.repeat([1.0, 2.0, -3.0], 50), "one": np.array([7.5]),
    }
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None), ("normal", float("nan"))]
    out = ordering.exact_quantiles(frame(spark, data, "k string, v double"), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.975})
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in out.collect()}
    for k, vs in groups.items():
        assert got[k] == pytest.approx(tuple(np.quantile(vs, [0.25, 0.5, 0.975])), abs=1e-12)


# Hashes -----------------------------------------------------------------------------


def test_population_hash_recipe_and_tree(spark):
    ids = [f"s{i}" for i in range(40)]
    df = frame(spark, [("c", s) for s in ids + ids[:5]], "cohort_id string, sample_id string")
    want = "sha256:" + hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()
    assert population_hash(df, ["cohort_id"]).first()["population_hash"] == want
    tree = population_hash(df, ["cohort_id"], form="tree").first()
    assert tree["population_hash"].startswith("sha256-tree:") and tree["n_samples"] == 40
    fewer = population_hash(df.filter("sample_id <> 's7'"), ["cohort_id"], form="tree").first()
    assert fewer["population_hash"] != tree["population_hash"]


def test_published_signatures_match_their_pins(spark):
    got = {r["signature"]: r["checksum"] for r in signature_checksum(bundled.signatures(spark)).collect()}
    assert got == bundled.CHECKSUMS
    assert bundled.verified_signatures(spark).select("signature").distinct().count() == 4


# Harmonisation ------------------------------------------------------------------------


def test_collapse_rules_and_ties(spark):
    rows = [
        ("c", "A", 1, "s1", 1.0), ("c", "A", 1, "s2", 3.0), ("c", "A", 2, "s1", 2.0), ("c", "A", 2, "s2", 2.0),
        ("c", "B", 3, "s1", None), ("c", "B", 4, "s1", -5.0), ("c", "D", 5, "s1", 9.0),
    ]
    df = frame(spark, rows, "cohort_id string, gene string, feature_pos long, sample_id string, value double")
    best = {(r["gene"], r["sample_id"]): (r["value"], r["n_rows_collapsed"]) for r in harmonise.collapse_duplicates(df).collect()}
    assert best == {("A", "s1"): (1.0, 2), ("A", "s2"): (3.0, 2), ("B", "s1"): (-5.0, 2), ("D", "s1"): (9.0, 1)}
    first = {(r["gene"], r["sample_id"]): r["value"] for r in harmonise.collapse_duplicates(df, "first").collect()}
    assert first[("B", "s1")] is None
    mean = {(r["gene"], r["sample_id"]): r["value"] for r in harmonise.collapse_duplicates(df, "mean").collect()}
    assert mean[("A", "s1")] == 1.5


def test_renamed_gene_of_a_published_signature_is_reported(spark):
    out = harmonise.outdated_signature_genes(bundled.signatures(spark), bundled.aliases(spark))
    assert [tuple(r) for r in out.collect()] == [("yang28", "CYR61", "CCN1")]


# Scoring ------------------------------------------------------------------------------


def _cells(rng, n_samples=30, genes=("g1", "g2", "g3", "g4")):
    return [("c", g, f"s{i:02d}", float(rng.normal(8, 2))) for g in genes for i in range(n_samples)]


CELL = "cohort_id string, gene string, sample_id string, value double"
SIG = "signature string, gene string, gene_pos int, coefficient double, scoring string"


def test_score_is_population_relative_and_order_free(spark):
    rng = np.random.default_rng(1)
    cells = _cells(rng)
    sig = frame(spark, [("x", g, i, None, "rowmean") for i, g in enumerate(("g1", "g2", "g3", "g4"))], SIG)
    df = frame(spark, cells, CELL)
    one = {r["sample_id"]: r["score"] for r in scoring.score_rowmean(df, sig).collect()}
    two = {r["sample_id"]: r["score"] for r in scoring.score_rowmean(df.orderBy(F.desc("value")), sig).collect()}
    assert one == pytest.approx(two)
    wide = np.array([[c[3] for c in cells if c[1] == g] for g in ("g1", "g2", "g3", "g4")])
    z = (wide - wide.mean(1, keepdims=True)) / wide.std(1, ddof=1, keepdims=True)
    assert [one[f"s{i:02d}"] for i in range(30)] == pytest.approx(z.mean(0).tolist())
    kept = frame(spark, [("c", f"s{i:02d}") for i in range(20)], "cohort_id string, sample_id string")
    after = {r["sample_id"]: r["score"] for r in scoring.score_rowmean(endpoints.restrict(df, kept), sig).collect()}
    assert abs(after["s00"] - one["s00"]) > 1e-6


def test_score_null_rules(spark):
    cells = [("c", g, s, v) for g, vs in {"g1": (1.0, 2.0, 3.0), "g2": (5.0, 5.0, 5.0), "g3": (1.0, None, 4.0)}.items() for s, v in zip("abc", vs)]
    cells.append(("c", "other", "d", 1.0))
    sig = frame(spark, [("x", g, i, 0.5, "weighted") for i, g in enumerate(("g1", "g2", "g3"))], SIG)
    df = frame(spark, cells, CELL)
    mean = {r["sample_id"]: r["score"] for r in scoring.score_rowmean(df, sig).collect()}
    assert mean["b"] == pytest.approx(0.0) and mean["d"] is None
    weighted = {r["sample_id"]: r["score"] for r in scoring.score_weighted(df, sig).collect()}
    assert weighted["d"] == 0.0
    with pytest.raises(ValueError):
        scoring.score_rowmean(spark.readStream.format("rate").load(), sig)


# Endpoints ----------------------------------------------------------------------------


def test_endpoint_rules(spark):
    rows = [
        ("c", "a", {"t": "12 months", "e": "Yes"}), ("c", "b", {"t": None, "e": "no", "f": "20"}),
        ("c", "d", {"t": "70", "e": "1"}), ("c", "g", {"t": "70", "e": "maybe"}),
        ("c", "h", {"t": "5", "e": "maybe"}), ("c", "i", {"t": "x", "e": None}),
    ]
    clinical = frame(spark, rows, "cohort_id string, sample_id string, attrs map<string,string>")
    spec = frame(spark, [("c", "t", "e", "f", "months", None, None, 60.0)], endpoints.SPEC_SCHEMA)
    derived = endpoints.derive(clinical, spec)
    got = {r["sample_id"]: (r["time_months"], r["event"]) for r in derived.collect()}
    assert got == {"a": (12.0, 1), "b": (20.0, 0), "d": (60.0, 0), "g": (60.0, 0), "h": (5.0, None), "i": (None, None)}
    rep = endpoints.report(derived).first()
    assert (rep["n_usable"], rep["n_events"], rep["n_unparsed_event"], rep["n_dropped_missing"]) == (4, 1, 2, 1)
    assert rep["unrecognised"] == ["maybe"]
    assert endpoints.missing_spec_columns(clinical, spec).count() == 0
    with pytest.raises(ValueError):
        endpoints.apply_filters(clinical, [{"column": "e", "keep": ["a"], "drop": ["b"]}])


@pytest.mark.parametrize(
    ("records", "want"),
    [
        ([("e", "YES", "1826.4", None)], (1, 1, 1826.4, "earliest_valid_first_bcr")),
        ([("e", "YES", "1827", None)], (1, 0, 1827.0, "earliest_valid_first_bcr")),
        ([("e", "NO", None, "300"), ("f", "YES", "200", "400"), ("g", "YES", "100", None)], (1, 1, 100.0, "earliest_valid_first_bcr")),
        ([("e", "NO", None, "300"), ("f", "YES", None, None)], (None, None, None, "explicit_bcr_without_valid_first_bcr_day")),
        ([("e", "NO", "bad", "300")], (None, None, None, "explicit_bcr_without_valid_first_bcr_day")),
        ([("e", "NO", None, "300"), ("f", None, None, "900")], (0, 0, 300.0, "latest_supported_negative_contact")),
        ([("e", "NO", None, "-5")], (None, None, None, "negative_without_valid_contact")),
        ([("e", None, None, "300")], (None, None, None, "unknown_bcr_status")),
        ([("e", "NO", None, "NaN"), ("f", "NO", None, "inf")], (None, None, None, "negative_without_valid_contact")),
    ],
)
def test_adjudication_table(spark, records, want):
    rows = [("p", r, [f] if f else [], [d] if d else [], [c] if c else []) for r, f, d, c in records]
    df = frame(
        spark, rows,
        "patient string, record string, biochemical_recurrence array<string>, "
        "days_to_first_biochemical_recurrence array<string>, days_to_last_followup array<string>",
    )
    v = adjudication.adjudicate(df).first()
    assert (v["event_uncapped"], v["event"], v["time_days"], v["reason"]) == want


# Frozen statistics and inference ---------------------------------------------------------


def test_scaler_and_reference_score(spark):
    cells = [("c", "g1", s, v) for s, v in zip("abcd", (1.0, 2.0, 3.0, 4.0))] + [("c", "g2", s, 5.0) for s in "abcd"]
    df = frame(spark, cells, CELL)
    sig = frame(spark, [("x", "g1", 0, None, "rowmean"), ("x", "g2", 1, None, "rowmean")], SIG)
    ref = scaler.build_reference(df, sig, population_hash(df, ["cohort_id"]))
    assert {r["gene"]: r["sd"] is None for r in ref.collect()} == {"g1": False, "g2": True}
    new = frame(spark, [("n", "g1", "z", 5.0), ("n", "g2", "z", 1.0)], CELL)
    got = scaler.score_reference(new, ref).first()["score"]
    assert got == pytest.approx((5.0 - 2.5) / np.std([1, 2, 3, 4], ddof=1) / 2)
    lacking = new.filter("gene = 'g1'")
    assert scaler.score_reference(lacking, ref).count() == 0
    assert scaler.reference_refusals(lacking, ref).first()["error_code"] == "missing_reference_genes"
    assert scaler.score_reference(lacking, ref, strict=False).count() == 1
    asked = ref.first()["reference_id"]
    rows = [("z", {"g1": 5.0, "g2": 1.0}, asked), ("y", {"g1": 5.0}, asked), ("x", {"g1": 5.0}, "other"), ("w", {"g1": 5.0}, None)]
    stream_like = frame(spark, rows, "sample_id string, expr map<string,double>, reference_id string")
    flow = {r["sample_id"]: (r["score"], r["error_code"]) for r in frozen.score_stream(stream_like, ref).collect()}
    assert flow["z"] == (pytest.approx(got), "") and flow["y"] == (None, "missing_reference_genes")
    assert flow["x"] == flow["w"] == (None, "unknown_reference")


# Published constants of a 20-gene model and one known sample's values.
KNOWN = """
ABCB6 0.5361340543379113 0.23859370201326482 0.5272705568773409
ALDOA 2.521551621836955 0.7108364826360288 2.791709901694227
AMH 1.205610060996833 1.0723117758958283 0.4890290638504373
ANKZF1 4.663460947357783 0.5282150601344721 4.562712559327654
ANLN 1.6769603864991558 0.8782123652223497 0.52697021440912
COL5A1 4.25570069390495 0.9996385527955792 3.2141869891437618
ESRP1 6.3258315259217905 0.6634632196014719 5.902625943729929
FAM216A 2.65659542389185 0.5242083006131211 2.211386061679429
GAL3ST1 0.8394282720023869 0.542749968390889 0.8555113765744018
HMMR 1.8493919959732954 0.8864285818232632 0.8732619953784867
IGFBP3 5.923830690014319 1.000424467364792 4.250923687136575
KDM3A 3.7588983313276585 0.6038336830060873 3.3576646008127002
LOXL2 3.006167206484054 0.7411054719971705 2.6925387883779552
PPFIA4 0.41533957020885054 0.41240997060935164 0.2810750492774744
PPP2R5B 4.33881937217399 0.4226741781741889 4.160161864286934
SLC16A1 5.243616640932314 1.0190213754735313 4.821057079359034
SLC6A8 5.558050137444342 0.3868064401057924 5.119381079500948
STC2 2.6522828347928136 0.9513264959262294 2.2471072220522763
WSB1 4.935984556460766 0.7337621044478898 6.1487206121532845
YEATS2 3.783363432292603 0.5840991261915518 3.0455128670835028
"""


def test_known_sample_prediction(spark):
    rows = [line.split() for line in KNOWN.strip().splitlines()]
    constants = frame(spark, [("m", g, float(m), float(s)) for g, m, s, _ in rows], "model_id string, gene string, mean double, sd double")
    # 74 of the 483 training scores lie at or below the known sample.
    ranks = frame(spark, [("m", -2.0, 74, 74, 483), ("m", 1.0, 409, 483, 483)], inference.RANKS_SCHEMA)
    model = frame(
        spark,
        [("m", "1", "log", 0.5806182816932, 4.1558658975616624e-16, 0.5262640282143533)],
        inference.MODEL_SCHEMA,
    )
    cells = [("s", g, float(v), "log") for g, _, _, v in rows]
    matrix = frame(spark, cells, "sample_id string, gene string, value double, expression_type string")
    got = inference.assess(matrix, model, constants, ranks).first()
    assert got["error_code"] == ""
    assert got["score"] == pytest.approx(-0.9994416998626602, abs=2e-9)
    assert got["linear_predictor"] == pytest.approx(-0.5802941224267887, abs=2e-9)
    assert got["relative_hazard"] == pytest.approx(0.5597337121145431, abs=2e-9)
    assert got["training_percentile"] == pytest.approx(15.320910973084887, abs=1e-12)


def test_model_store_detects_tampering(spark, tmp_path):
    constants = frame(spark, [("m", "g", 1.0, 2.0)], "model_id string, gene string, mean double, sd double")
    model = frame(spark, [("m", "1", "log", 0.5, 0.0, 1.0)], inference.MODEL_SCHEMA)
    ranks = frame(spark, [("m", 1.0, 2, 2, 3), ("m", 2.0, 1, 3, 3)], inference.RANKS_SCHEMA)
    store.save_models(model, constants, ranks, str(tmp_path / "m"))
    assert store.model_invariants(spark, str(tmp_path / "m")).first()["error_code"] == ""
    constants.withColumn("mean", F.lit(9.0)).write.mode("overwrite").parquet(str(tmp_path / "m" / "scaler"))
    assert store.model_invariants(spark, str(tmp_path / "m")).first()["error_code"] == "scaler_checksum_mismatch"
    with pytest.raises(ValueError):
        store.load_models(spark, str(tmp_path / "m"))


def test_cohort_store_round_trip_and_tampering(spark, tmp_path):
    df = frame(spark, [("c", "g1", "a", 1.0), ("c", "g2", "a", None), ("d", "g1", "b", 2.0)], CELL)
    clinical = frame(spark, [("c", "a", 1), ("d", "b", 0)], "cohort_id string, sample_id string, event int")
    path = str(tmp_path / "s")
    store.save_cohorts(df, clinical, path)
    matrix, _ = store.load_cohorts(spark, path)
    assert sorted(tuple(r) for r in matrix.filter("value is not null").collect()) == [("c", "g1", "a", 1.0), ("d", "g1", "b", 2.0)]
    frame(spark, [("g1", "b", 3.0)], "gene string, sample_id string, value double").write.mode("overwrite").parquet(path + "/expression/cohort_id=d")
    assert {r["cohort_id"]: r["status"] for r in store.verify_cohorts(spark, path).collect()} == {"c": "ok", "d": "changed"}
    with pytest.raises(ValueError):
        store.load_cohorts(spark, path)


def test_verify_outputs(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name)
    files = provenance.file_inventory(spark, str(tmp_path))
    good = "sha256:" + hashlib.sha256(b"a.txt").hexdigest()
    recorded = frame(spark, [("/elsewhere/a.txt", good), (str(tmp_path / "b.txt"), "sha256:0"), ("/x/c.txt", "sha256:1")], "name string, checksum string")
    got = {r["name"].split("/")[-1]: r["status"] for r in provenance.verify_outputs(recorded, files).collect()}
    assert got == {"a.txt": "ok", "b.txt": "changed", "c.txt": "missing"}


# Concordance, Cox, folds, resampling -------------------------------------------------------


def brute(rows):
    pairs = credit = 0
    for ti, ei, ri in rows:
        for tj, ej, rj in rows:
            if ei == 1 and (ti < tj or (ti == tj and ej == 0)):
                pairs += 1
                d = ri - rj
                credit += 1.0 if d > 1e-8 else (0.5 if abs(d) <= 1e-8 else 0.0)
    return pairs, credit


@pytest.mark.parametrize("kind", ["continuous", "tied", "constant", "near"])
def test_concordance_matches_enumeration(spark, monkeypatch, kind):
    rng = np.random.default_rng(11)
    n = 120
    risk = {
        "continuous": rng.normal(size=n), "tied": rng.integers(0, 4, n).astype(float),
        "constant": np.zeros(n), "near": rng.integers(0, 5, n) + rng.integers(0, 3, n) * 6e-9,
    }[kind]
    rows = [(float(rng.integers(1, 25)), int(rng.integers(0, 2)), float(r)) for r in risk]
    df = frame(spark, [("k", *r) for r in rows], "k string, time_months double, event int, risk double")
    got = concordance.harrell(df, ["k"]).first()
    pairs, credit = brute(rows)
    assert got["comparable_pairs"] == pairs
    assert got["c_index"] == pytest.approx(credit / pairs, abs=1e-12)
    monkeypatch.setattr(ordering, "has_large_key", lambda *a: True)
    monkeypatch.setattr(ordering.with_buckets, "__defaults__", ("_bucket", 30))
    split = concordance.harrell(df, ["k"]).first()
    assert (split["comparable_pairs"], split["c_index"]) == (got["comparable_pairs"], pytest.approx(got["c_index"], abs=1e-12))


def efron_fit(t, e, z, rounds=30):
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        w = np.exp(z @ b)
        grad, info = np.zeros_like(b), np.zeros((len(b), len(b)))
        for time in np.unique(t[e == 1]):
            risk, dead = t >= time, (t == time) & (e == 1)
            d = dead.sum()
            grad += z[dead].sum(0)
            for l in range(d):
                a = w * risk - l / d * w * dead
                s0, s1 = a.sum(), a @ z
                m = s1 / s0
                grad -= m
                info += (z.T * a) @ z / s0 - np.outer(m, m)
        step = np.linalg.solve(info, grad)
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    return b, np.sqrt(np.diag(np.linalg.inv(info)))


def survival_rows(seed, n=150, p=2):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, p))
    t = np.ceil(rng.exponential(scale=np.exp(-0.6 * z[:, 0])) * 20)
    e = (rng.random(n) < 0.6).astype(int)
    return t, e, z


def test_cox_matches_direct_fit_with_ties(spark):
    data, want = [], {}
    for key in ("a", "b"):
        t, e, z = survival_rows(ord(key))
        data += [(key, float(x), int(y), *map(float, v)) for x, y, v in zip(t, e, z)]
        want[key] = efron_fit(t, e, z)
    df = frame(spark, data, "k string, time_months double, event int, x double, y double")
    got = {r["k"]: r for r in cox.fit(df, ["k"], ["x", "y"]).collect()}
    for key, (b, _) in want.items():
        assert got[key]["converged"]
        assert list(got[key]["beta"]) == pytest.approx(b.tolist(), abs=1e-8)
    table = {(r["k"], r["term"]): r for r in cox.multivariable(df, ["k"], ["x", "y"]).collect()}
    assert table[("a", "x")]["p"] < 0.01 and table[("a", "x")]["ci_low"] < table[("a", "x")]["hr"]


def test_cox_refuses_unfit_requests(spark):
    rows = [("few", 1.0 + i, 1, float(i)) for i in range(5)] + [("flat", 1.0 + i, i % 2, float(i % 3)) for i in range(20)]
    rows += [("bad", -1.0 + i, 1, float(i)) for i in range(20)]
    df = frame(spark, rows, "k string, time_months double, event int, score double")
    got = {r["k"]: r["error"] for r in cox.per_sd(df, ["k"]).collect()}
    assert got == {"few": "too_few_observations", "flat": "few_distinct_values", "bad": "time_not_positive"}


def test_wald_p_of_a_published_coefficient(spark):
    from cohortforge.functions.numeric import two_sided_normal_p

    z = 0.5806182816932 / 0.106819697355
    got = frame(spark, [(z,)], "z double").select(two_sided_normal_p("z").alias("p")).first()["p"]
    assert got == pytest.approx(5.46e-08, rel=2e-3)
    assert got == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_elastic_net_meets_its_optimality_conditions(spark):
    t, e, z = survival_rows(9, n=200, p=3)
    rows = [("k", float(x), int(y), *map(float, v)) for x, y, v in zip(t, e, z)]
    df = frame(spark, rows, "k string, time_months double, event int, a double, b double, c double")
    alpha, l1 = 0.05, 0.5
    penalty = frame(spark, [("k", alpha, l1)], "k string, alpha double, l1_ratio double")
    got = cox.fit(df, ["k"], ["a", "b", "c"], ties="breslow", penalty=penalty).first()
    b = np.array(got["beta"])
    w = np.exp(z @ b)
    grad = np.zeros(3)
    for i in np.flatnonzero(e):
        risk = t >= t[i]
        grad += z[i] - (w * risk) @ z / (w * risk).sum()
    grad /= len(t)
    for j in range(3):
        slope = grad[j] - alpha * (1 - l1) * b[j]
        if b[j] != 0:
            assert slope == pytest.approx(alpha * l1 * np.sign(b[j]), abs=1e-7)
        else:
            assert abs(slope) <= alpha * l1 + 1e-9


def test_fold_plan_is_stratified_and_complete(spark):
    people = [("c", f"p{i:03d}", int(i % 4 == 0)) for i in range(80)] + [("tiny", "q1", 1), ("tiny", "q2", 0)]
    df = frame(spark, people, "cohort_id string, sample_id string, event int")
    plan = folds.plan(df, 4, 3, 2).cache()
    assert folds.plan_violations(plan).count() == 0
    assert {r["cohort_id"] for r in plan.select("cohort_id").distinct().collect()} == {"c"}
    assert folds.plan_problems(df, 4, 3).first()["problem"] == "too_few_for_outer_folds"
    test = plan.filter("role = 'test'").groupBy("repeat", "fold").agg(F.sum("event").alias("e"), F.count("*").alias("n"))
    assert {(r["e"], r["n"]) for r in test.collect()} == {(5, 20)}
    assert plan.filter("role = 'train' and inner_fold not between 1 and 3").count() == 0


def test_candidate_ties_and_missing_folds(spark):
    rows = [(1, 0, 1, 0.6), (1, 0, 2, 0.6), (1, 1, 1, 0.7), (1, 1, 2, 0.5), (1, 2, 1, 0.9)]
    df = frame(spark, rows, "fold int, candidate int, inner_fold int, c_index double")
    strict = crossval.select_candidates(df, ["fold"], 2).first()
    assert (strict["candidate"], strict["mean_c"]) == (0, pytest.approx(0.6))
    assert crossval.select_candidates(df, ["fold"], 2, require_all=False).first()["candidate"] == 2


def test_bootstrap_weights_sum_to_population(spark):
    people = frame(spark, [(f"p{i}",) for i in range(60)], "sample_id string")
    sums = resample.patient_weights(people, 5).groupBy("draw").agg(F.sum("weight").alias("w")).collect()
    assert {r["w"] for r in sums} == {60} and len(sums) == 5


def test_snapshot_checksum_recipe(spark):
    digests = ["sha256:b", "sha256:a"]
    records = frame(spark, [("p1", digests[0]), ("p1", digests[0]), ("p2", digests[1])], "source string, checksum string")
    want = "sha256:" + hashlib.sha256("\n".join(sorted(digests)).encode()).hexdigest()
    assert adjudication.snapshot_checksum(records).first()["snapshot_checksum"] == want


def test_rank_percentiles_match_the_array_form(spark):
    ref = inference.ranked_scores(frame(spark, [("m", float(v)) for v in (1, 2, 2, 5)], "model_id string, score double"), ["model_id"])
    asked = frame(spark, [("m", "a", 2.0), ("m", "b", 0.5), ("m", "c", 9.0)], "model_id string, sample_id string, score double")
    got = {r["sample_id"]: r["training_percentile"] for r in inference.rank_percentiles(asked, ref, ["model_id"]).collect()}
    assert got == {"a": 75.0, "b": 0.0, "c": 100.0}


def test_elastic_net_grid_picks_a_candidate_per_fold(spark):
    t, e, z = survival_rows(21, n=90, p=3)
    names = [f"s{i:02d}" for i in range(90)]
    people = frame(spark, [("c", s, float(a), int(b)) for s, a, b in zip(names, t, e)], "cohort_id string, sample_id string, time_months double, event int")
    matrix = frame(spark, [("c", f"g{j}", s, float(z[i, j])) for i, s in enumerate(names) for j in range(3)], CELL)
    plan = folds.plan(people, 2, 2, 1)
    grid = frame(spark, [(0, 5.0, 0.9), (1, 0.02, 0.5)], "candidate int, alpha double, l1_ratio double")
    out = crossval.penalised_cv(matrix, people, plan, ["g0", "g1", "g2"], grid, 2)
    assert out["search"].count() == 8
    assert {r["candidate"] for r in out["selected"].collect()} == {1}
    held = {r["fold"]: r["c_index"] for r in out["folds"].collect()}
    assert set(held) == {1, 2} and min(held.values()) > 0.55


# Keys that tell equal ids apart ---------------------------------------------------------


def test_equal_sample_ids_of_two_cohorts_stay_apart(spark):
    from cohortforge.operators import crossval

    cells = [(c, g, f"s{i}", base + i % 5 + (i if g == "g1" else 0)) for c, base in (("a", 0.0), ("b", 100.0)) for g in ("g1", "g2") for i in range(12)]
    roles = [(c, 1, f"s{i}", "test" if i % 4 == 0 else "train") for c in "ab" for i in range(12)]
    matrix, plan = frame(spark, cells, CELL), frame(spark, roles, "cohort_id string, fold int, sample_id string, role string")
    both = {(r["cohort_id"], r["sample_id"]): r["score"] for r in crossval.partition_scores(matrix, plan, ["cohort_id", "fold"]).collect()}
    alone = crossval.partition_scores(matrix.filter("cohort_id = 'b'"), plan.filter("cohort_id = 'b'"), ["cohort_id", "fold"])
    for r in alone.collect():
        assert both["b", r["sample_id"]] == pytest.approx(r["score"]) == pytest.approx(both["a", r["sample_id"]])
    checked = crossval.leakage(matrix, plan, ["cohort_id", "fold"]).collect()
    control = crossval.leakage(matrix, plan, ["cohort_id", "fold"], fit_on=("train", "test")).collect()
    assert all(r["unchanged"] for r in checked) and not any(r["unchanged"] for r in control)


def test_first_aliquot_of_each_cohort_and_probe_of_each_platform(spark):
    from cohortforge.operators import harmonise

    cells = frame(spark, [("a", "p", "b1", 1.0), ("b", "p", "b2", 2.0), ("b", "p", "b3", 3.0)], "cohort_id string, patient string, barcode string, value double")
    assert sorted((r["cohort_id"], r["barcode"]) for r in harmonise.to_patients(cells).collect()) == [("a", "b1"), ("b", "b2")]
    notes = frame(spark, [("x", "p1", "G1"), ("y", "p1", "G2"), ("y", "p1", "G2")], "platform string, probe string, symbol string")
    cells = frame(spark, [("x", "p1"), ("y", "p1"), ("z", "p1")], "platform string, feature string")
    got = harmonise.label_probes(cells, harmonise.probe_map(notes, by=["platform"])).collect()
    assert sorted((r["platform"], r["gene"] or "", r["status"]) for r in got) == [("x", "G1", "mapped"), ("y", "G2", "mapped"), ("z", "", "unmapped")]


def test_quantiles_and_quartiles_with_an_infinite_score(spark):
    data = [("k", float(i % 40) if i else float("inf"), 1.0 + i, i % 2) for i in range(80)]
    data += [("good", float(i % 40), 1.0 + i, i % 2) for i in range(80)]
    rows = frame(spark, data, "k string, score double, time_months double, event int")
    assert ordering.exact_quantiles(rows, ["k"], "score", {"q": 1.0}).filter("k = 'k'").first()["q"] == 39.0
    got = {r["k"]: r["error"] for r in cox.quartile(rows, ["k"]).collect()}
    assert got == {"k": "score_not_finite", "good": None}
    terms = {r["k"]: r["error"] for r in cox.multivariable(rows.withColumn("one", F.lit(1.0)), ["k"], ["score", "one"]).collect()}
    assert terms == {"k": "score_not_finite", "good": "constant_score"}
