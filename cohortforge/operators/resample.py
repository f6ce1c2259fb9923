"""Summaries of held-out performance, paired bootstrap and permutation importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from cohortforge.functions.numeric import finite, ratio
from cohortforge.functions.staging import written
from cohortforge.operators import concordance
from cohortforge.operators.concordance import harrell, pair_totals, with_ranks
from cohortforge.operators.ordering import exact_quantiles, hashed_position
from cohortforge.operators.pair_counts import draw_totals, drawn_slots, fold_counts, permuted_totals, slot_lists

FOLD = ["model", "repeat", "fold"]
MIN_VALID_SHARE = 0.8
#: Draws whose weights travel as one list a patient; 256 at most.
BLOCK_DRAWS = 250
#: Weights of a fold and block: patients times draws.
BLOCK_CELLS = 50_000_000
#: Slots that are drawn together, digests that a task makes at once, and slots whose counts travel as one row.
SLOTS_AT_ONCE = 4_194_304
UNIT_DIGESTS = 8_000_000
BIN_SLOTS = 4096
_HASH_DIGITS = 15
#: Contributions of one gene in one fold that a task permutes by itself.
PERMUTED_ROWS = 1_000_000


def prediction_problems(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Reasons a paired comparison would be invalid, with how many rows each affects, per ``by`` (cohorts, say) if given.

    Duplicate predictions within a repeat, patients absent from a repeat, patients whose fold, time or
    event differs between models, and risks that are no finite number.
    """
    by = by or []
    once = predictions.groupBy(*by, "model", "repeat", "sample_id").agg(F.count(F.lit(1)).alias("_n"))
    duplicated = once.filter(F.col("_n") > 1).select(*by, F.lit("duplicate_prediction").alias("problem"))
    outcome = F.struct("fold", "time_months", "event")
    sizes = predictions.withColumn("_all", F.lit(1)).groupBy("_all", *by).agg(
        F.countDistinct("model").alias("_models"), F.countDistinct("repeat").alias("_repeats")
    )
    sizes = written(sizes, "prediction-sizes")
    keys = ["_all", *by]
    differing = (
        predictions.groupBy(*by, "repeat", "sample_id")
        .agg(F.min(outcome).alias("_a"), F.max(outcome).alias("_b"), F.countDistinct("model").alias("_m"))
        .withColumn("_all", F.lit(1)).join(sizes, keys)
        .filter((F.col("_a") != F.col("_b")) | (F.col("_m") != F.col("_models")))
        .select(*by, F.lit("unpaired_prediction").alias("problem"))
    )
    uncovered = (
        predictions.groupBy(*by, "sample_id").agg(F.countDistinct("repeat").alias("_r"))
        .withColumn("_all", F.lit(1)).join(sizes, keys)
        .filter(F.col("_r") != F.col("_repeats"))
        .select(*by, F.lit("patient_missing_from_repeat").alias("problem"))
    )
    broken = predictions.filter(~F.coalesce(finite(F.col("risk")), F.lit(False))).select(*by, F.lit("risk_not_finite").alias("problem"))
    every = duplicated.union(differing).union(uncovered).union(broken)
    return every.groupBy(*by, "problem").agg(F.count(F.lit(1)).alias("n"))


def fold_concordance(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """C per (by, model, repeat, fold); risks of different fits are never ranked together."""
    return harrell(predictions, [*(by or []), *FOLD])


def cv_summary(folds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, spread and pair-weighted mean of fold C per model (a group is one model's folds)."""
    c, w = F.col("c_index"), F.col("comparable_pairs")
    return folds.groupBy(*(keys or ["model"])).agg(
        F.count("c_index").alias("n_fits"),
        F.avg("c_index").alias("mean_c"),
        F.stddev_samp("c_index").alias("sd_c"),
        F.median("c_index").alias("median_c"),
        F.min("c_index").alias("min_c"),
        F.max("c_index").alias("max_c"),
        ratio(F.sum(c * w), F.sum(w)).alias("pair_weighted_c"),
    )


def paired_differences(folds: DataFrame) -> DataFrame:
    """Fold-by-fold differences of every pair of models, later name minus earlier."""
    a = folds.select("repeat", "fold", F.col("model").alias("_a"), F.col("c_index").alias("_ca"))
    b = folds.select("repeat", "fold", F.col("model").alias("_b"), F.col("c_index").alias("_cb"))
    pairs = a.join(b, ["repeat", "fold"]).filter(F.col("_b") > F.col("_a"))
    d = F.col("_cb") - F.col("_ca")
    return pairs.groupBy(F.concat("_b", F.lit(" minus "), F.col("_a")).alias("comparison")).agg(
        F.avg(d).alias("mean_difference"),
        F.stddev_samp(d).alias("sd_difference"),
        F.median(d).alias("median_difference"),
        F.count_if(d > 0).alias("folds_positive"),
        F.count(F.lit(1)).alias("n_outer_fits"),
    )


def _slots(patients: DataFrame, by: list[str]) -> DataFrame:
    """Patients numbered from 0 in the order of their digests: by, ``_slot, sample_id`` and their number ``_n``."""
    key = patients.select(*by, "sample_id").distinct().withColumn("_one", F.lit(1))
    numbered = hashed_position(
        key.withColumn("_d", F.md5("sample_id")), [*by, "_one"], "_d", "sample_id", "_slot"
    ).select(*by, "_one", (F.col("_slot") - 1).alias("_slot"), "sample_id")
    numbered = written(numbered, "slots")
    sizes = written(numbered.groupBy(*by, "_one").agg(F.count(F.lit(1)).alias("_n")), "slot-sizes")
    return numbered.join(sizes, [*by, "_one"]).drop("_one")


def _chosen(seed: int) -> Column:
    """The slot that slot ``_slot`` of draw ``draw`` selects."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw"), F.col("_slot")))
    return F.conv(F.substring(digest, 1, _HASH_DIGITS), 16, 10).cast("long") % F.col("_n")


def patient_weights(patients: DataFrame, draws: int, seed: int = 902099, by: list[str] | None = None) -> DataFrame:
    """Multinomial patient weights per draw as (by, draw, sample_id, weight); zero weights absent.

    Each patient is also one slot of every draw, and the slot's digest names the
    patient it selects, so the weights of a draw sum to the number of patients, of each ``by`` if given.
    """
    by = by or []
    numbered = _slots(patients, by)
    hits = (
        numbered.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        .groupBy(*by, "draw", _chosen(seed).alias("_slot"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return hits.join(numbered, [*by, "_slot"]).select(*by, "draw", "sample_id", "weight")


def _bin() -> Column:
    return F.floor(F.col("_slot") / BIN_SLOTS).cast("long").alias("_bin")


def _drawn(numbered: DataFrame, draws: int, seed: int, block: int, by: list[str]) -> DataFrame:
    """How often the draws select the slots of ``_slots``, a row per bin of slots and some draws of one block.

    A task draws for some slots and draws, so the work is dealt to as many tasks as there are such pieces.
    """
    last = F.least(F.lit(draws), (F.col("_block") + 1) * block)
    step = F.floor(F.lit(UNIT_DIGESTS) / F.least(F.col("_n"), F.lit(SLOTS_AT_ONCE)))
    step = F.least(F.lit(block), F.greatest(F.lit(1), step)).cast("int")
    units = (
        numbered.select(*by, "_n").distinct()
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block))))
        .withColumn("_first", F.explode(F.sequence(F.col("_block") * block, last - 1, step)))
        .withColumn("_last", F.least(F.col("_first") + step, last))
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(SLOTS_AT_ONCE).cast("long"))))
    )
    units = written(units, "draw-units")
    schema = StructType([*numbered.select(*by).schema.fields]).add("_bin", "long").add("_first", "integer").add("_draws", "integer")
    return units.repartition(max(1, min(units.count(), 10_000))).mapInArrow(
        drawn_slots(by, seed, SLOTS_AT_ONCE, BIN_SLOTS), schema.add("_slots", "integer").add("_counts", "binary")
    )


def draw_lists(
    patients: DataFrame, draws: int, seed: int = 902099, block: int = BLOCK_DRAWS, by: list[str] | None = None
) -> DataFrame:
    """The same weights with a row per patient and block of draws: by, ``sample_id, _block, _chosen``.

    ``_chosen`` has a byte for each draw of the block, numbered from 0, that selects the patient, as often as it does.
    """
    if block > 256:
        raise ValueError("a block has 256 draws at most")
    by = by or []
    numbered = _slots(patients, by).withColumn("_bin", _bin())
    schema = StructType([*numbered.select(*by, "sample_id").schema.fields]).add("_block", "integer").add("_chosen", "binary")
    drawn = _drawn(numbered, draws, seed, block, by).groupBy(*by, "_bin")
    return drawn.cogroup(numbered.groupBy(*by, "_bin")).applyInArrow(slot_lists(by, block, BIN_SLOTS), schema)


def bootstrap_draws(predictions: DataFrame, draws: int, seed: int = 902099, by: list[str] | None = None) -> DataFrame:
    """Mean-over-folds C per (by, draw, model), keeping draws with pairs in every fold.

    Weights are shared by all models, folds and repeats of a patient. A fold's pairs are ranked once per
    block of draws, whose weights are the columns of one matrix; the patients of a fold and bin of slots, with their
    predictions by all models, travel packed, once a block. Folds over ``GROUP_ROWS`` rows are counted draw by draw.
    """
    by = by or []
    keys = [*by, *FOLD]
    cases = written(
        predictions.select(
            *keys,
            "sample_id",
            F.col("time_months").cast("double").alias("_t"),
            F.col("event").cast("int").alias("_e"),
            F.col("risk").cast("double").alias("_r"),
        ).filter(F.col("_t").isNotNull() & F.col("_e").isNotNull() & F.col("_r").isNotNull()),
        "draw-cases",
    )
    block, most = min(draws, BLOCK_DRAWS), 0
    if cases.count() * block > BLOCK_CELLS:
        most = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= concordance.GROUP_ROWS).agg(F.max("_n")).first()[0] or 0
    block = max(1, min(block, BLOCK_CELLS // max(most, 1)))
    small, large = concordance.split_keys(cases, keys, concordance.GROUP_ROWS)
    numbered = _slots(predictions, by)
    placed = small.join(numbered.select(*by, "sample_id", "_slot", _bin()), [*by, "sample_id"]).drop("sample_id")
    fold = [*by, "repeat", "fold"]
    kinds = StructType([cases.schema["model"]]).add("n", "integer")
    for name in ("at", "t", "e", "r"):
        kinds = kinds.add(name, "binary")
    pieces = StructType([*cases.select(*fold).schema.fields]).add("_block", "integer").add("_size", "integer")
    pieces = pieces.add("_counts", "binary").add("_cases", ArrayType(kinds))
    # The planner knows the few units, not the draws they make: a join would take these for a small side and broadcast them.
    drawn = _drawn(numbered, draws, seed, block, by).groupBy(*by, "_bin")
    counts = drawn.cogroup(placed.groupBy(*by, "_bin")).applyInArrow(fold_counts(by, block, BIN_SLOTS), pieces)
    schema = cases.select(*keys).schema.add("draw", "integer").add("comparable", "double").add("credit", "double")
    totals = counts.groupBy(*fold, "_block").applyInArrow(draw_totals(keys, block), schema)
    totals = totals.filter(F.col("draw") <= draws)
    if large is not None:
        weighted = (
            written(with_ranks(large, keys), "ranked").join(patient_weights(predictions, draws, seed, by), [*by, "sample_id"])
            .groupBy(*keys, "draw", "_t", "_e", "pos", "lo", "hi", "_bits")
            .agg(F.sum("weight").cast("double").alias("_w"))
        )
        totals = totals.unionByName(pair_totals(written(weighted, "weighted"), [*keys, "draw"]))
    folds = predictions.select(*by, "repeat", "fold").distinct().withColumn("_all", F.lit(1))
    folds = written(folds.groupBy("_all", *by).agg(F.count(F.lit(1)).alias("_planned")), "draw-folds")
    per_draw = totals.groupBy(*by, "draw", "model").agg(
        F.avg(ratio(F.col("credit"), F.col("comparable"))).alias("c"),
        F.count_if(F.col("comparable") > 0).alias("_folds"),
    )
    # A draw counts only if every model has pairs in every fold.
    complete = per_draw.withColumn(
        "_least", F.min("_folds").over(Window.partitionBy(*by, "draw"))
    ).withColumn("_all", F.lit(1)).join(folds, ["_all", *by]).filter(F.col("_least") == F.col("_planned"))
    return complete.select(*by, "draw", "model", "c")


def _interval(draw_values: DataFrame, key: str, value: str) -> DataFrame:
    limits = exact_quantiles(draw_values, [key], value, {"ci_low": 0.025, "ci_high": 0.975})
    sizes = draw_values.groupBy(key).agg(F.count(F.lit(1)).alias("n_valid"))
    return limits.join(sizes, key)


def paired_bootstrap(
    predictions: DataFrame, draws: int = 2000, seed: int = 902099
) -> tuple[DataFrame, DataFrame]:
    """Percentile intervals of each model's mean C and of every paired difference.

    ``too_few_valid`` marks results resting on under 80 percent of the draws.
    """
    folds = written(fold_concordance(predictions), "fold-c")
    values = written(bootstrap_draws(predictions, draws, seed), "draws")
    flag = F.col("n_valid") < draws * MIN_VALID_SHARE
    models = (
        cv_summary(folds).join(_interval(values, "model", "c"), "model").withColumn("too_few_valid", flag)
    )
    a = values.select("draw", F.col("model").alias("_a"), F.col("c").alias("_ca"))
    b = values.select("draw", F.col("model").alias("_b"), F.col("c").alias("_cb"))
    diffs = a.join(b, "draw").filter(F.col("_b") > F.col("_a")).select(
        F.concat("_b", F.lit(" minus "), F.col("_a")).alias("comparison"),
        (F.col("_cb") - F.col("_ca")).alias("d"),
    )
    pairs = paired_differences(folds).join(_interval(diffs, "comparison", "d"), "comparison")
    return models, pairs.withColumn("too_few_valid", flag)


# Permutation importance ---------------------------------------------------------


def permutation_drops(
    features: DataFrame,
    outcomes: DataFrame,
    weights: DataFrame,
    keys: list[str],
    repeats: int,
    seed: int = 932001,
) -> DataFrame:
    """Drop in held-out C when one gene is permuted within its test fold.

    ``features`` has (keys, sample_id, gene, z); ``weights`` (keys, gene,
    coefficient) is the frozen linear model; ``outcomes`` has (sample_id,
    time_months, event) and those of the keys, such as the cohort, that tell equal
    sample ids apart.  Only the permuted gene's contribution is exchanged.
    """
    parts = features.join(weights, [*keys, "gene"]).select(
        *keys, "sample_id", "gene", (F.col("z") * F.col("coefficient")).alias("part")
    )
    parts = written(parts, "parts")
    risks = written(parts.groupBy(*keys, "sample_id").agg(F.sum("part").alias("risk")), "part-risks")
    person = [*[k for k in keys if k in outcomes.columns], "sample_id"]
    outcome = outcomes.select(*person, "time_months", "event")
    whole = harrell(risks.join(outcome, person), keys).select(
        *keys, F.col("c_index").alias("_whole")
    )
    group = [*keys, "gene", "permutation"]
    small, large = concordance.split_keys(parts, [*keys, "gene"], PERMUTED_ROWS)
    # Contributions are exchanged inside a fold before those without an outcome drop out.
    rows = small.join(risks.join(outcome, person, "left"), [*keys, "sample_id"]).select(
        *keys, "gene", "sample_id", "part", "risk", F.col("time_months").cast("double").alias("_t"), F.col("event").cast("double").alias("_e"),
        F.concat_ws("|", F.lit(str(seed)), *keys, "gene").alias("_prefix"),
    )
    schema = parts.select(*keys, "gene").schema.add("permutation", "integer").add("c_index", "double")
    permuted = rows.groupBy(*keys, "gene").applyInArrow(permuted_totals([*keys, "gene"], repeats), schema)
    if large is not None:
        permuted = permuted.unionByName(_permuted_by_rows(large, risks, outcome, person, keys, repeats, seed))
    return permuted.join(whole, keys).select(*group, (F.col("_whole") - F.col("c_index")).alias("c_drop"))


def _permuted_by_rows(
    parts: DataFrame, risks: DataFrame, outcome: DataFrame, person: list[str], keys: list[str], repeats: int, seed: int
) -> DataFrame:
    """C of every permutation with a row for each contribution and permutation, for folds of any size."""
    group = [*keys, "gene", "permutation"]
    many = parts.withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    giver = hashed_position(
        many.withColumn(
            "_d", F.md5(F.concat_ws("|", F.lit(str(seed)), *keys, "gene", "permutation", "sample_id"))
        ),
        group, "_d", "sample_id", "_slot",
    ).select(*group, "_slot", F.col("part").alias("_given"))
    taker = hashed_position(
        many.withColumn("_d", F.md5("sample_id")), group, "_d", "sample_id", "_slot"
    ).select(*group, "_slot", "sample_id", "part")
    changed = (
        taker.join(giver, [*group, "_slot"])
        .join(risks, [*keys, "sample_id"])
        .withColumn("risk", F.col("risk") - F.col("part") + F.col("_given"))
        .join(outcome, person)
    )
    return harrell(changed, group).select(*group, "c_index")


def importance_by_fold(drops: DataFrame) -> DataFrame:
    return drops.groupBy("repeat", "fold", "gene").agg(F.avg("c_drop").alias("c_drop"))


def importance_rollup(drops: DataFrame) -> DataFrame:
    """Per gene over fold means: a mean of means, not a pooled mean; rank 1 has the highest mean.

    The rank window holds one row per gene.
    """
    means = importance_by_fold(drops).groupBy("gene").agg(
        F.avg("c_drop").alias("mean"),
        F.stddev_samp("c_drop").alias("sd"),
        F.median("c_drop").alias("median"),
        F.min("c_drop").alias("min"),
        F.max("c_drop").alias("max"),
        F.avg((F.col("c_drop") > 0).cast("double")).alias("fraction_folds_positive"),
    )
    order = Window.orderBy(F.round("mean", 9).desc(), "gene")
    return means.withColumn("rank", F.row_number().over(order))


def importance_rank_correlation(drops: DataFrame) -> DataFrame:
    """Spearman correlation of gene importance between every two repeats (average ties).

    Each rank window holds one repeat's genes.
    """
    repeats = importance_by_fold(drops).groupBy("repeat", "gene").agg(F.avg("c_drop").alias("c_drop"))
    order = Window.partitionBy("repeat").orderBy("c_drop")
    peers = Window.partitionBy("repeat", "c_drop")
    ranked = repeats.select(
        "repeat", "gene", (F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2).alias("rank")
    )
    a = ranked.select(F.col("repeat").alias("repeat_a"), "gene", F.col("rank").alias("_ra"))
    b = ranked.select(F.col("repeat").alias("repeat_b"), "gene", F.col("rank").alias("_rb"))
    x, y, n = F.col("_ra"), F.col("_rb"), F.count(F.lit(1))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return a.join(b, "gene").groupBy("repeat_a", "repeat_b").agg(
        ratio(F.covar_pop(x, y), spread).alias("spearman"), n.alias("n_genes")
    )


def coefficient_stability(coefficients: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How consistently each feature is selected and signed over many fits.

    A group is one feature's fits: folds times repeats.
    """
    v = F.col("coefficient")

    def quantile(p: float) -> Column:
        return F.percentile("coefficient", F.lit(p))

    return coefficients.groupBy(*(keys or ["feature"])).agg(
        F.count("coefficient").alias("n_fits"),
        F.count_if(v != 0).alias("n_nonzero"),
        F.avg((v != 0).cast("double")).alias("selection_frequency"),
        F.count_if(v > 0).alias("positive_fits"),
        F.count_if(v < 0).alias("negative_fits"),
        ratio(F.greatest(F.count_if(v > 0), F.count_if(v < 0)), F.count_if(v != 0)).alias("sign_consistency"),
        F.avg("coefficient").alias("mean"),
        F.stddev_samp("coefficient").alias("sd"),
        F.median("coefficient").alias("median"),
        quantile(0.25).alias("q25"),
        quantile(0.75).alias("q75"),
        F.min("coefficient").alias("min"),
        F.max("coefficient").alias("max"),
    )
