"""Cox proportional hazards for many keys at once.

Each Newton round is one job over all keys: rows are reduced to risk-set moments
per distinct time, running totals over time give the risk sets, and one row per
key carries the score, the information and the next coefficients.  Only those
key rows move from round to round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortforge.functions.numeric import finite, ratio, two_sided_normal_p
from cohortforge.functions.staging import written
from cohortforge.operators.concordance import harrell
from cohortforge.operators.ordering import (
    ROWS_PER_BUCKET,
    exact_quantiles,
    has_large_key,
    running_totals,
    with_buckets,
)

MAX_ROUNDS = 25
STEP_TOLERANCE = 1e-9
TIE_BLOCK = 4096
MIN_ROWS = 10
MIN_DISTINCT = 5
NORMAL_95 = 1.959963984540054


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(p) for b in range(a, p)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _newton_step(gradient: pd.Series, information: pd.Series) -> pd.Series:
    """Solve the p by p system of each key row."""

    def solve(g, h):
        if g is None or h is None:
            return None
        p = len(g)
        try:
            return np.linalg.solve(np.asarray(h, float).reshape(p, p), np.asarray(g, float))
        except np.linalg.LinAlgError:
            return None

    return pd.Series([solve(g, h) for g, h in zip(gradient, information)], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _inverse_diagonal(information: pd.Series) -> pd.Series:
    def diagonal(h):
        if h is None:
            return None
        p = int(round(len(h) ** 0.5))
        try:
            return np.diag(np.linalg.inv(np.asarray(h, float).reshape(p, p))).copy()
        except np.linalg.LinAlgError:
            return None

    return pd.Series([diagonal(h) for h in information], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _penalised_step(
    beta: pd.Series, gradient: pd.Series, information: pd.Series, n: pd.Series, alpha: pd.Series, l1: pd.Series
) -> pd.Series:
    """Coordinate descent on each key's penalised quadratic model; returns the step."""

    def solve(b0, g, h, size, a, ratio_):
        if g is None or h is None:
            return None
        b0, g = np.asarray(b0, float), np.asarray(g, float) / size
        p = len(b0)
        h = np.asarray(h, float).reshape(p, p) / size
        b = b0.copy()
        for _ in range(500):
            biggest = 0.0
            for j in range(p):
                curve = h[j, j]
                pull = g[j] - h[j] @ (b - b0) + curve * b[j]
                new = np.sign(pull) * max(abs(pull) - a * ratio_, 0.0) / max(curve + a * (1.0 - ratio_), 1e-12)
                biggest = max(biggest, abs(new - b[j]))
                b[j] = new
            if biggest < 1e-11:
                break
        return b - b0

    return pd.Series(
        [solve(*row) for row in zip(beta, gradient, information, n, alpha, l1)], dtype=object
    )


def _moments(base: DataFrame, state: DataFrame, keys: list[str], p: int, ties: str, spread: bool = False) -> DataFrame:
    """Log partial likelihood, gradient and information of every unfinished key.

    With ``spread`` the times of a key are dealt to tasks before tied events are numbered. Expressions are SQL text: with many covariates there are many of them.
    """
    terms, pairs = range(p), _pairs(p)
    active = state.filter("NOT done").selectExpr(
        *[f"`{k}`" for k in keys], *[f"beta[{a}] AS _b{a}" for a in terms], "z_low", "z_high"
    )
    # An upper bound of the linear predictor, so exp() cannot overflow.
    bound = " + ".join(f"greatest(_b{a} * z_low[{a}], _b{a} * z_high[{a}])" for a in terms)
    lp = " + ".join(f"_b{a} * _z{a}" for a in terms)
    bucket = "_tb" if "_tb" in base.columns else None
    parts = [*keys, "_tb"] if bucket else keys
    rows = (
        base.join(active, keys)
        .withColumn("_lp", F.expr(f"({lp}) - ({bound})"))
        .withColumn("_w", F.exp("_lp"))
    )
    risk = {"s0": "_w"}
    risk.update({f"s1_{a}": f"_w * _z{a}" for a in terms})
    risk.update({f"s2_{a}_{b}": f"_w * _z{a} * _z{b}" for a, b in pairs})
    sums = {"_d": "_e", "_elp": "_e * _lp", **{f"_ez{a}": f"_e * _z{a}" for a in terms}, **risk}
    if ties == "efron":
        sums.update({f"e{name[1:]}": f"{text} * _e" for name, text in risk.items()})
    cells = rows.groupBy(*parts, "_t").agg(
        *[F.expr(f"sum({text}) AS {name}") for name, text in sums.items()]
    )
    sets = running_totals(cells, keys, ["_t"], list(risk), descending=True, bucket=bucket).filter("_d > 0")
    if spread and ties == "efron":
        sets = sets.repartition(*keys, "_t")
    if ties == "efron":
        # Tied events are numbered in blocks, so no array grows with the tie size.
        sets = sets.withColumn(
            "_blk", F.expr(f"explode(sequence(0L, CAST(floor((_d - 1) / {TIE_BLOCK}) AS BIGINT)))")
        ).withColumn(
            "_i",
            F.expr(
                f"explode(sequence(_blk * {TIE_BLOCK}, least(_d - 1, _blk * {TIE_BLOCK} + {TIE_BLOCK - 1})))"
            ),
        )
        once, times = "CASE WHEN _i = 0 THEN 1D ELSE 0D END", "1D"
        at_risk = {name: f"(cum_{name} - _i / _d * e{name[1:]})" for name in risk}
    else:
        once, times = "1D", "CAST(_d AS DOUBLE)"
        at_risk = {name: f"cum_{name}" for name in risk}
    s0 = at_risk["s0"]
    per_time = sets.selectExpr(
        *[f"`{k}`" for k in keys],
        f"{once} * _elp - {times} * ln({s0}) AS _ll",
        f"{times} AS _n",
        *[f"{once} * _ez{a} AS _g{a}" for a in terms],
        *[f"{at_risk[f's1_{a}']} / {s0} AS _m{a}" for a in terms],
        *[f"{at_risk[f's2_{a}_{b}']} / {s0} AS _v{a}_{b}" for a, b in pairs],
    )
    gradient = ", ".join(f"sum(_g{a} - _n * _m{a})" for a in terms)
    information = ", ".join(
        f"sum(_n * (_v{min(a, b)}_{max(a, b)} - _m{a} * _m{b}))" for a in terms for b in terms
    )
    return per_time.groupBy(*keys).agg(
        F.expr("sum(_ll) AS loglik_now"),
        F.expr(f"array({gradient}) AS gradient_now"),
        F.expr(f"array({information}) AS information_now"),
    )


def _advance(state: DataFrame, moments: DataFrame, keys: list[str], p: int, penalised: bool) -> DataFrame:
    """Next coefficients: a Newton step, or half of the last one where it made things worse."""
    joined = state.join(moments, keys, "left")
    if penalised:
        penalty = (
            "alpha * (l1_ratio * aggregate(beta, 0D, (s, b) -> s + abs(b))"
            " + (1 - l1_ratio) / 2 * aggregate(beta, 0D, (s, b) -> s + b * b))"
        )
        value = F.expr(f"loglik_now / n - {penalty}")
        step = _penalised_step("beta", "gradient_now", "information_now", "n", "alpha", "l1_ratio")
    else:
        value = F.col("loglik_now")
        step = (
            F.expr("array(try_divide(gradient_now[0], information_now[0]))")
            if p == 1
            else _newton_step("gradient_now", "information_now")
        )
    judged = (
        joined.withColumn("_value", value)
        .withColumn("_step", step)
        .withColumn("_size", F.expr("array_max(transform(_step, s -> abs(s)))"))
        .withColumn(
            "_worse", F.expr("NOT done AND coalesce(_value < objective - 1e-10 * (abs(objective) + 1), false)")
        )
        # No finite step: a singular or monotone likelihood, not a fit.
        .withColumn("_broken", F.expr("_size IS NULL OR isnan(_size) OR _size = double('Infinity')"))
        .withColumn("_moved", F.expr("NOT done AND NOT _worse"))
    )
    return judged.selectExpr(
        *[f"`{c}`" for c in state.columns if c not in _STATE],
        "CASE WHEN _worse THEN zip_with(beta, last_beta, (u, v) -> (u + v) / 2)"
        " WHEN _moved AND NOT _broken THEN zip_with(beta, _step, (u, v) -> u + v) ELSE beta END AS beta",
        "CASE WHEN _moved THEN beta ELSE last_beta END AS last_beta",
        "CASE WHEN _moved THEN _value ELSE objective END AS objective",
        "CASE WHEN _moved THEN loglik_now ELSE loglik END AS loglik",
        "CASE WHEN _moved THEN information_now ELSE information END AS information",
        f"done OR (_moved AND (_broken OR _size < {STEP_TOLERANCE!r}D)) AS done",
        f"converged OR (_moved AND NOT _broken AND _size < {STEP_TOLERANCE!r}D) AS converged",
        "rounds + CASE WHEN done THEN 0 ELSE 1 END AS rounds",
    )


_STATE = ["beta", "last_beta", "objective", "loglik", "information", "done", "converged", "rounds"]


def fit(
    rows: DataFrame,
    keys: list[str],
    covariates: list[str],
    time: str = "time_months",
    event: str = "event",
    ties: str = "efron",
    penalty: DataFrame | None = None,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Fit one Cox model per key; one result row per key.

    ``ties`` is ``efron`` or ``breslow``.  ``penalty`` (keys, alpha, l1_ratio)
    turns the fit into an elastic net maximising loglik / n minus the penalty.
    Rows with a missing value in any column are left out of the fit.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError(f"unknown tie method {ties!r}")
    p = len(covariates)
    complete = rows.select(
        *keys,
        F.col(time).cast("double").alias("_t"),
        F.col(event).cast("int").alias("_e"),
        *[F.col(c).cast("double").alias(f"_z{a}") for a, c in enumerate(covariates)],
    )
    for c in complete.columns[len(keys):]:
        complete = complete.filter(F.col(c).isNotNull() & ~F.isnan(c))
    base = written(complete, "cox-rows")
    spread = has_large_key(base, keys, ROWS_PER_BUCKET)
    if spread:
        # Only distinct times are ordered, so only a key with many of those needs buckets of them.
        times = written(base.select(*keys, "_t").distinct(), "cox-times")
        if has_large_key(times, keys, ROWS_PER_BUCKET):
            base = written(with_buckets(base, keys, "_t", "_tb"), "cox-buckets")
    zero = F.array(*[F.lit(0.0)] * p)
    state = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_e").alias("n_events"),
        F.array(*[F.min(f"_z{a}") for a in range(p)]).alias("z_low"),
        F.array(*[F.max(f"_z{a}") for a in range(p)]).alias("z_high"),
    )
    if penalty is not None:
        state = state.join(penalty.select(*keys, "alpha", "l1_ratio"), keys)
    state = state.select(
        "*",
        zero.alias("beta"),
        zero.alias("last_beta"),
        F.lit(float("-inf")).alias("objective"),
        F.lit(None).cast("double").alias("loglik"),
        F.lit(None).cast("array<double>").alias("information"),
        (F.col("n_events") == 0).alias("done"),
        F.lit(False).alias("converged"),
        F.lit(0).alias("rounds"),
    )
    state = written(state, "cox-state")
    for _ in range(max_rounds):
        moments = _moments(base, state, keys, p, ties, spread)
        state = written(_advance(state, moments, keys, p, penalty is not None), "cox-state")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.drop("z_low", "z_high", "last_beta", "done")


def invalid_requests(rows: DataFrame, keys: list[str], time: str = "time_months", event: str = "event") -> DataFrame:
    """Keys that must not be fitted, with the reason."""
    t, e = F.col(time), F.col(event)
    checks = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(e.isin(0, 1), F.lit(False))).alias("_bad_event"),
        F.count_if(~F.coalesce(finite(t.cast("double")) & (t > 0), F.lit(False))).alias("_bad_time"),
    )
    code = (
        F.when(F.col("n") < MIN_ROWS, "too_few_observations")
        .when(F.col("_bad_event") > 0, "event_not_0_1")
        .when(F.col("_bad_time") > 0, "time_not_positive")
    )
    return checks.withColumn("error", code).filter(F.col("error").isNotNull()).select(*keys, "n", "error")


def too_uniform(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose score takes fewer than five distinct values."""
    distinct = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)))
    return (
        distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < MIN_DISTINCT)
        .select(*keys, F.lit("few_distinct_values").alias("error"))
    )


def standardise(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Scale columns to mean 0 and sample sd 1 per key."""
    stats = rows.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    )
    stats = written(stats, "cox-scale")
    out = rows.join(stats, keys)
    for c in columns:
        out = out.withColumn(c, ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
    return out.drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def tidy(fitted: DataFrame, keys: list[str], model: str, a: int = 0) -> DataFrame:
    """Coefficient, standard error, hazard ratio, interval and Wald p of one covariate."""
    if a == 0:
        one = F.when(F.size("information") == 1, F.array(ratio(F.lit(1.0), F.col("information")[0])))
        variance = F.coalesce(one, _inverse_diagonal("information"))
    else:
        variance = _inverse_diagonal("information")
    b, se = F.col("coefficient"), F.col("se")
    return (
        fitted.withColumn("coefficient", F.col("beta")[a])
        .withColumn("se", F.sqrt(variance[a]))
        .select(
            *keys,
            F.lit(model).alias("model"),
            "n",
            "n_events",
            "coefficient",
            "se",
            F.exp(b).alias("hr"),
            F.exp(b - NORMAL_95 * se).alias("ci_low"),
            F.exp(b + NORMAL_95 * se).alias("ci_high"),
            two_sided_normal_p(ratio(b, se)).alias("p"),
            "converged",
            "rounds",
        )
    )


def unusable_scores(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose score cannot be fitted at all, with the reason."""
    v = F.col(value).cast("double")
    checks = rows.groupBy(*keys).agg(
        F.count(v).alias("_some"),
        F.count_if(F.abs(v) == float("inf")).alias("_infinite"),
        F.min(F.when(~F.isnan(v), v)).alias("_lo"),
        F.max(F.when(~F.isnan(v), v)).alias("_hi"),
    )
    code = (
        F.when(F.col("_infinite") > 0, "score_not_finite")
        .when(F.col("_lo").isNull(), "score_missing")
        .when(F.col("_lo") == F.col("_hi"), "constant_score")
    )
    return checks.withColumn("error", code).filter(F.col("error").isNotNull()).select(*keys, "error")


def _refusals(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One error per key: that of the first table that names it."""
    out = None
    for n, part in enumerate(parts):
        ranked = part.select(*keys, F.struct(F.lit(n).alias("n"), "error").alias("_e"))
        out = ranked if out is None else out.unionByName(ranked)
    return written(out.groupBy(*keys).agg(F.min("_e")["error"].alias("error")), "cox-refused")


def _univariable(rows: DataFrame, keys: list[str], value: str, model: str, scaled: bool = False) -> DataFrame:
    """Fit, tidy and concordance of one covariate; every key of ``rows`` has a row.

    Keys that are refused, and keys whose fit does not converge, are error rows.
    ``scaled`` standardises the covariate over the rows that are fitted.
    """
    narrow = rows.select(*keys, "time_months", "event", F.col(value).alias("_x"))
    complete = narrow.filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    parts = [unusable_scores(narrow, keys, "_x"), invalid_requests(complete, keys).select(*keys, "error")]
    if model != "quartile":
        parts.append(too_uniform(complete, keys, "_x"))
    refused = _refusals(parts, keys)
    usable = complete.join(refused.select(*keys), keys, "left_anti")
    if scaled:
        usable = standardise(usable, keys, ["_x"])
    usable = written(usable, "cox-usable")
    fitted = fit(usable, keys, ["_x"])
    table = tidy(fitted, keys, model)
    risk = usable.join(table.select(*keys, "coefficient"), keys).withColumn(
        "risk", F.col("coefficient") * F.col("_x")
    )
    table = table.join(harrell(risk, keys).select(*keys, "c_index"), keys, "left").withColumn(
        "error", F.when(~F.col("converged"), "not_converged")
    )
    table = table.unionByName(refused.withColumn("model", F.lit(model)), allowMissingColumns=True)
    return _every_key(table, rows, keys, model)


def _every_key(table: DataFrame, rows: DataFrame, keys: list[str], model: str) -> DataFrame:
    """Add an error row for each key of ``rows`` that has none yet."""
    lost = rows.select(*keys).distinct().join(table.select(*keys), keys, "left_anti")
    lost = lost.withColumn("model", F.lit(model)).withColumn("error", F.lit("not_fitted"))
    return table.unionByName(lost, allowMissingColumns=True)


def per_sd(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Hazard ratio per standard deviation of the score, per key."""
    return _univariable(rows, keys, score, "per_sd", scaled=True)


def frozen(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """The same fit on a score that already carries its frozen standardisation."""
    return _univariable(rows, keys, score, "frozen")


def quartile(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Top against bottom quartile; the middle half is left out.

    A key with an infinite, missing or constant score is an error row.
    """
    bad = written(unusable_scores(rows, keys, score), "cox-unusable")
    asked, rows = rows, rows.join(bad.select(*keys), keys, "left_anti")
    cuts = exact_quantiles(rows, keys, score, {"_q1": 0.25, "_q3": 0.75})
    group = F.when(F.col(score) <= F.col("_q1"), 0.0).when(F.col(score) >= F.col("_q3"), 1.0)
    grouped = rows.join(cuts, keys).withColumn("_top", group).filter(F.col("_top").isNotNull())
    grouped = written(grouped.select(*keys, "time_months", "event", "_top"), "cox-quartiles")
    sizes = grouped.groupBy(*keys).agg(
        F.count_if(F.col("_top") == 0).alias("n_q1"),
        F.count_if(F.col("_top") == 1).alias("n_q4"),
        F.count_if((F.col("_top") == 0) & (F.col("event") == 1)).alias("events_q1"),
        F.count_if((F.col("_top") == 1) & (F.col("event") == 1)).alias("events_q4"),
    )
    single = sizes.filter((F.col("n_q1") == 0) | (F.col("n_q4") == 0)).select(
        *keys, F.lit("single_quartile_group").alias("error")
    )
    fits = _univariable(grouped.join(single, keys, "left_anti"), keys, "_top", "quartile")
    refused = single.unionByName(bad).withColumn("model", F.lit("quartile"))
    every = _every_key(fits.unionByName(refused, allowMissingColumns=True), asked, keys, "quartile")
    return every.join(sizes, keys, "left")


def multivariable(rows: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """All terms in one scaled model, complete cases only; one row per key and term.

    A key with an infinite, missing or constant term, or too few complete cases, is one
    error row; a fit that does not converge keeps its rows, marked.
    """
    complete = rows.select(*keys, "time_months", "event", *terms)
    for term in terms:
        complete = complete.filter(F.col(term).isNotNull() & ~F.isnan(term))
    parts = [unusable_scores(rows, keys, term) for term in terms]
    parts += [invalid_requests(complete, keys).select(*keys, "error")]
    refused = _refusals([*parts, *[unusable_scores(complete, keys, term) for term in terms]], keys)
    usable = complete.join(refused.select(*keys), keys, "left_anti")
    usable = written(standardise(usable, keys, terms), "cox-usable")
    fitted = written(fit(usable, keys, terms), "cox-fitted")
    risk = usable.join(fitted.select(*keys, "beta"), keys)
    total = F.lit(0.0)
    for a, term in enumerate(terms):
        total = total + F.col("beta")[a] * F.col(term)
    c = harrell(risk.withColumn("risk", total), keys).select(*keys, "c_index")
    out = None
    for a, term in enumerate(terms):
        part = tidy(fitted, keys, "multivariable", a).withColumn("term", F.lit(term))
        out = part if out is None else out.unionByName(part)
    out = out.join(c, keys, "left").withColumn(
        "few_events_per_term", F.col("n_events") < 5 * len(terms)
    )
    out = out.withColumn("error", F.when(~F.col("converged"), "not_converged"))
    out = out.unionByName(refused.withColumn("model", F.lit("multivariable")), allowMissingColumns=True)
    return _every_key(out, rows, keys, "multivariable")
