"""Elastic-net Cox paths of all folds at once.

A sample's features are held once per repeat, with the fold it tests and the inner folds it validates; partitions are
masks over them, and their scalers are totals less the sums of the part left out. The state has one row
per partition whose arrays hold all candidates. A round is one job: blocks of samples, in order of time, give the
risk-set moments of every unfinished candidate, and each partition takes a penalised Newton step. A time with more
samples than a block holds, such as that of a cap, has several blocks of its own.

A candidate starts from the solution that its neighbour with the next larger penalty has reached, steps over the features
that the sequential strong rule leaves in, and is done once the exact optimality conditions of the
penalised likelihood hold at its coefficients: the largest violation is its certificate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortforge.functions.staging import written
from cohortforge.operators import concordance
from cohortforge.operators.ordering import spread_totals
from cohortforge.operators.pair_counts import concordant
from cohortforge.operators.scaler import MIN_SD

BLOCK_ROWS = 20_000
MAX_ROUNDS = 60
TOLERANCE = 1e-7
#: Linear predictors are cut here, far beyond any fit that converges.
LARGEST = 300.0
PART = ["repeat", "fold", "inner_fold"]
PLACE = ["_b", "_s"]


def _doubles(*names: str) -> str:
    return ", ".join(f"{n} array<double>" for n in names)


def time_blocks(rows: DataFrame, by: str, size: int) -> DataFrame:
    """Blocks ``_b`` in order of time, of up to twice ``size`` rows, and parts ``_s`` of a time with over ``size`` rows.

    Such a time is a block of its own, whose parts are dealt by a hash of the sample; other blocks have one part. ``rows`` are written.
    """
    counts = rows.groupBy(by, "_t").agg(F.count(F.lit(1)).alias("_n"))
    hot = F.col("_n") > size
    number = 2 * F.floor((F.col("cum__n") - F.col("_n")) / size) + hot.cast("long")
    times = spread_totals(counts, [by], ["_t"], ["_n"]).select(
        by, "_t", number.cast("int").alias("_b"), F.when(hot, F.ceil(F.col("_n") / size)).otherwise(1).alias("_parts")
    )
    part = F.pmod(F.xxhash64("sample_id"), F.col("_parts")).cast("int")
    return rows.join(written(times, "path-times"), [by, "_t"]).withColumn("_s", part).drop("_parts")


def member_rows(matrix: DataFrame, outcomes: DataFrame, plan: DataFrame, genes: list[str], by: str) -> DataFrame:
    """A row per sample and repeat: ``_b, _s`` (of ``time_blocks``), ``_t, _e, x``, ``folds`` and ``inners``.

    ``x`` are the features less their cohort mean, null where missing; ``inners`` has the inner fold in which the sample
    validates for each of ``folds``, 0 where it is tested. A list is as long as the plan has folds.
    """
    wide = matrix.filter(F.col("gene").isin(genes)).groupBy(by, "sample_id").agg(
        *[F.max(F.when(F.col("gene") == g, F.col("value"))).alias(f"_x{a}") for a, g in enumerate(genes)]
    )
    rows = wide.join(
        outcomes.select(by, "sample_id", F.col("time_months").cast("double").alias("_t"), F.col("event").cast("int").alias("_e")),
        [by, "sample_id"],
    )
    rows = written(rows.filter(F.col("_t").isNotNull() & F.col("_e").isNotNull()), "path-samples")
    centre = rows.groupBy(by).agg(*[F.avg(f"_x{a}").alias(f"_c{a}") for a in range(len(genes))])
    x = F.array(*[F.col(f"_x{a}") - F.col(f"_c{a}") for a in range(len(genes))])
    rows = time_blocks(rows, by, BLOCK_ROWS).join(centre, by).select(by, "sample_id", "_b", "_s", "_t", "_e", x.alias("x"))
    roles = plan.groupBy(by, "sample_id", "repeat").agg(F.array_sort(F.collect_list(F.struct("fold", "inner_fold"))).alias("_m"))
    roles = roles.select(by, "sample_id", "repeat", F.col("_m.fold").alias("folds"), F.col("_m.inner_fold").alias("inners"))
    return written(rows.join(roles, [by, "sample_id"]), "path-rows")


class _Block:
    """The samples of one block and repeat, latest first."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("_t", "descending"), ("sample_id", "ascending")]).combine_chunks()
        self.table = table
        self.event = table["_e"].to_numpy() == 1
        #: Where each distinct time begins, and the number of each sample's time.
        _, self.starts, self.moment = np.unique(-table["_t"].to_numpy(), return_index=True, return_inverse=True)
        lists = table["x"].combine_chunks()
        self.x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)
        self.complete = not np.isnan(self.x).any()
        self._products = None
        folds, inners = (table[c].combine_chunks() for c in ("folds", "inners"))
        at = np.repeat(np.arange(len(table)), np.diff(folds.offsets.to_numpy()))
        known, column = np.unique(folds.flatten().to_numpy(), return_inverse=True)
        self.folds = known.tolist()
        #: Inner fold of each sample by fold; -1 where the plan leaves the sample out.
        self.inner = np.full((len(table), len(known)), -1)
        self.inner[at, column] = inners.flatten().to_numpy()

    def train(self, fold: int, inner: int) -> np.ndarray:
        own = self.inner[:, self.folds.index(fold)]
        return (own > 0) & (own != inner)

    def held(self, fold: int, inner: int) -> np.ndarray:
        return self.inner[:, self.folds.index(fold)] == inner

    def z(self, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
        """Frozen z; a missing value and a constant feature are 0."""
        use = sd >= MIN_SD
        return np.nan_to_num((self.x - mean) / np.where(use, sd, 1.0)) * use


    def features(self, mean: np.ndarray, sd: np.ndarray):
        """Features ``f``, their products by ``np.triu_indices``, ``c`` and ``v``, such that z = (f - c) v.

        Without missing values they are the same for all partitions.
        """
        if not self.complete:
            z = self.z(mean, sd)
            return z, _products(z), np.zeros(len(mean)), np.ones(len(mean))
        if self._products is None:
            self._products = _products(self.x)
        use = sd >= MIN_SD
        return self.x, self._products, mean, use / np.where(use, sd, 1.0)


def _products(x: np.ndarray) -> np.ndarray:
    a, b = np.triu_indices(x.shape[1])
    return x[:, a] * x[:, b]


def _rows(records: list[dict], names: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([r[n] for r in records], t) for n, t in names.items()})


_LIST, _LONG, _INT = pa.list_(pa.float64()), pa.int64(), pa.int32()


def _sums(by: str, by_type: pa.DataType):
    """Sums of every (fold, inner fold) of one block: the parts of which scalers are made."""

    def run(table: pa.Table) -> pa.Table:
        block, out = _Block(table), []
        known = ~np.isnan(block.x)
        x = np.where(known, block.x, 0.0)
        for column, fold in enumerate(block.folds):
            for inner in np.unique(block.inner[:, column]).tolist():
                if inner >= 0:
                    own = block.inner[:, column] == inner
                    out.append(
                        {by: table[by][0].as_py(), "repeat": table["repeat"][0].as_py(), "fold": fold, "inner_fold": inner,
                         "n": int(own.sum()), "events": int((own & block.event).sum()),
                         "count": known[own].sum(axis=0).astype(float), "s1": x[own].sum(axis=0), "s2": (x[own] ** 2).sum(axis=0)}
                    )
        types = {by: by_type, "repeat": _INT, "fold": _INT, "inner_fold": _INT, "n": _LONG, "events": _LONG, "count": _LIST, "s1": _LIST, "s2": _LIST}
        return _rows(out, types)

    return run


def _initial(by: str, by_type: pa.DataType, n_inner: int, candidates: int):
    """First state of one repeat's partitions: scalers by subtraction, coefficients of zero.

    Inner fold 0 is the outer training set; inner fold k leaves the samples out that validate in k.
    """

    def run(table: pa.Table) -> pa.Table:
        records: dict[tuple, dict] = {}
        for row in table.to_pylist():
            part = records.setdefault((row["fold"], row["inner_fold"]), {"n": 0, "events": 0, "m": 0.0})
            part["n"] += row["n"]
            part["events"] += row["events"]
            part["m"] = part["m"] + np.array([row["count"], row["s1"], row["s2"]])
        out = []
        for fold in sorted({f for f, _ in records}):
            parts = [records[f, k] for f, k in records if f == fold and k > 0]
            if not parts:
                continue
            whole, n, events = sum(p["m"] for p in parts), sum(p["n"] for p in parts), sum(p["events"] for p in parts)
            for inner in range(n_inner + 1):
                left = records.get((fold, inner), {"n": 0, "events": 0, "m": 0.0}) if inner else {"n": 0, "events": 0, "m": 0.0}
                count, s1, s2 = whole - left["m"]
                mean = s1 / np.maximum(count, 1)
                sd = np.sqrt(np.maximum(s2 - count * mean**2, 0.0) / np.maximum(count - 1, 1))
                sd[count < 2] = 0.0
                here = events - left["events"]
                out.append(
                    {by: table[by][0].as_py(), "repeat": table["repeat"][0].as_py(), "fold": fold, "inner_fold": inner,
                     "n": n - left["n"], "events": here, "mean": mean, "sd": sd,
                     "beta": np.zeros(candidates * len(mean)), "before": np.zeros(candidates * len(mean)),
                     "objective": np.full(candidates, -np.inf), "residual": np.full(candidates, np.inf),
                     "rounds": np.zeros(candidates), "done": np.full(candidates, float(here == 0))}
                )
        return _rows(out, _state_types(by, by_type))

    return run


def _state_types(by: str, by_type: pa.DataType) -> dict[str, pa.DataType]:
    lists = ("mean", "sd", "beta", "before", "objective", "residual", "rounds", "done")
    return {by: by_type, "repeat": _INT, "fold": _INT, "inner_fold": _INT, "n": _LONG, "events": _LONG} | dict.fromkeys(lists, _LIST)


_STATE = "n bigint, events bigint, " + _doubles("mean", "sd", "beta", "before", "objective", "residual", "rounds", "done")
_MOMENTS = _doubles("loglik", "gradient", "curve", "base", "hazard")


def _per_partition(by: str, by_type: pa.DataType, names: list[str], work: Callable):
    """For a cogroup of one block's samples and its partitions' states: ``work``'s arrays for each unfinished partition."""

    def run(rows: pa.Table, states: pa.Table) -> pa.Table:
        types = {by: by_type, "_b": _INT, "_s": _INT, "repeat": _INT, "fold": _INT, "inner_fold": _INT} | dict.fromkeys(names, _LIST)
        if not len(rows) or not len(states):
            return _rows([], types)
        block, out = _Block(rows), []
        for state in states.to_pylist():
            open_ = np.array(state["done"]) == 0
            if open_.any() and state["fold"] in block.folds:
                found = work(block, state, open_)
                out.append({n: state[n] for n in (by, *PLACE, *PART)} | dict(zip(names, found, strict=True)))
        return _rows(out, types)

    return run


def _weights(block: _Block, state: dict, open_: np.ndarray):
    """Features of the block's samples (see ``features``), who trains, and linear predictors and risk weights of the open candidates."""
    f, ff, c, v = block.features(np.array(state["mean"]), np.array(state["sd"]))
    beta = np.array(state["beta"]).reshape(len(open_), -1)[open_] * v
    train = block.train(state["fold"], state["inner_fold"])
    lp = np.clip(f @ beta.T - beta @ c, -LARGEST, LARGEST)
    return f, ff, c, v, train, lp, np.exp(lp) * train[:, None]


def _block_totals(block: _Block, state: dict, open_: np.ndarray):
    """Risk weights and weighted features of a whole block, which earlier blocks add to their risk sets."""
    f, _, c, v, _, _, weight = _weights(block, state, open_)
    s0, s1 = np.zeros(len(open_)), np.zeros((len(open_), f.shape[1]))
    s0[open_] = weight.sum(axis=0)
    s1[open_] = (weight.T @ f - s0[open_, None] * c) * v
    return s0, s1.ravel()


def _second_moments(weight, f, ff, c, v) -> np.ndarray:
    """Sums of z z' under each column of ``weight``."""
    p = f.shape[1]
    a, b = np.triu_indices(p)
    out = np.empty((weight.shape[1], p, p))
    out[:, a, b] = out[:, b, a] = weight.T @ ff
    s0, cross = weight.sum(axis=0)[:, None, None], (weight.T @ f)[:, :, None] * c
    return (out - cross - cross.transpose(0, 2, 1) + s0 * np.outer(c, c)) * np.outer(v, v)


def _moments(block: _Block, state: dict, open_: np.ndarray):
    """Log likelihood, gradient and curvature of every unfinished candidate from one block.

    ``curve`` lacks the hazard of earlier times, which adds ``base`` times the ``hazard`` of the blocks before.
    Risk sets and hazards are held by distinct time.
    """
    f, ff, c, v, train, lp, weight = _weights(block, state, open_)
    p, many, k = f.shape[1], len(open_), int(open_.sum())
    later0 = np.array(state["later0"])[open_] if state.get("later0") else np.zeros(k)
    later1 = np.array(state["later1"]).reshape(many, p)[open_] if state.get("later1") else np.zeros((k, p))
    event = train & block.event
    deaths = np.add.reduceat(event.astype(float), block.starts)
    own0 = np.cumsum(np.add.reduceat(weight, block.starts, axis=0), axis=0)
    ends = [*block.starts[1:].tolist(), len(weight)]
    own1 = np.cumsum([weight[i:j].T @ f[i:j] for i, j in zip(block.starts.tolist(), ends)], axis=0)
    some = deaths > 0
    s0 = (later0 + own0)[some]
    mean = ((own1[some] - own0[some][:, :, None] * c) * v + later1) / s0[:, :, None]
    step = np.zeros_like(own0)
    step[some] = deaths[some, None] / s0
    passed = np.cumsum(step[::-1], axis=0)[::-1][block.moment]
    loglik, hazard, gradient = np.zeros(many), np.zeros(many), np.zeros((many, p))
    curve, base = np.zeros((many, p, p)), np.zeros((many, p, p))
    loglik[open_] = lp[event].sum(axis=0) - deaths[some] @ np.log(s0)
    hazard[open_] = step.sum(axis=0)
    gradient[open_] = (f[event].sum(axis=0) - event.sum() * c) * v - np.einsum("t,tkp->kp", deaths[some], mean)
    base[open_] = _second_moments(weight, f, ff, c, v)
    tied = mean.transpose(1, 0, 2) * np.sqrt(deaths[some])[:, None]
    curve[open_] = _second_moments(weight * passed, f, ff, c, v) - tied.transpose(0, 2, 1) @ tied
    return loglik, gradient.ravel(), curve.ravel(), base.ravel(), hazard


def _later(by: str, by_type: pa.DataType):
    """What the blocks later in time, and the other parts of the same one, add to each block's risk sets, for one partition."""

    def run(table: pa.Table) -> pa.Table:
        number = table["_b"].to_numpy()
        known, place = np.unique(number, return_inverse=True)
        lists = {}
        for name in ("s0", "s1"):
            own = _matrix(table, name)
            total = np.zeros((len(known), own.shape[1]))
            np.add.at(total, place, own)
            after = np.cumsum(total[::-1], axis=0)[::-1] - total
            # A block of one part has no others, to the last digit.
            lists[name] = after[place] + np.where((np.bincount(place) > 1)[place][:, None], total[place] - own, 0.0)
        types = {by: by_type, "_b": _INT, "_s": _INT, "repeat": _INT, "fold": _INT, "inner_fold": _INT}
        listed = {n: pa.array(list(lists[o]), _LIST) for n, o in (("later0", "s0"), ("later1", "s1"))}
        return pa.table({**{n: table[n].cast(t) for n, t in types.items()}, **listed})

    return run


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    """A column of lists of equal length as rows of a matrix."""
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def penalised_step(beta, gradient, curve, l1, l2, start) -> np.ndarray:
    """Maximise each penalised quadratic model by coordinate descent over its active features.

    Arrays have a row per problem. The strong rule leaves a feature out whose gradient is under ``start``; one that turns out to
    violate the conditions joins, until none does.
    """
    active = (beta != 0) | (np.abs(gradient) >= start[:, None])
    new = beta.copy()
    diagonal = np.maximum(np.einsum("kii->ki", curve), 0.0)
    for _ in range(beta.shape[1] + 1):
        for _ in range(300):
            moved = 0.0
            for j in np.flatnonzero(active.any(axis=0)).tolist():
                slope = gradient[:, j] - np.einsum("ki,ki->k", curve[:, j], new - beta)
                pull = slope + diagonal[:, j] * new[:, j]
                value = np.sign(pull) * np.maximum(np.abs(pull) - l1, 0.0) / np.maximum(diagonal[:, j] + l2, 1e-12)
                value = np.where(active[:, j], value, new[:, j])
                moved = max(moved, float(np.abs(value - new[:, j]).max()))
                new[:, j] = value
            if moved < 1e-10:
                break
        slope = gradient - np.einsum("kij,kj->ki", curve, new - beta)
        wrong = ~active & (np.abs(slope) > l1[:, None] + 1e-12)
        if not wrong.any():
            break
        active |= wrong
    return new


def optimality_residual(beta, gradient, l1, l2) -> np.ndarray:
    """Largest violation of the optimality conditions of each problem."""
    free = np.maximum(np.abs(gradient) - l1[:, None], 0.0)
    held = np.abs(gradient - l2[:, None] * beta - l1[:, None] * np.sign(beta))
    return np.where(beta == 0, free, held).max(axis=1)


def _advance(by: str, by_type: pa.DataType, grid: list[tuple[int, float, float]]):
    """Next state of one partition from the moments of all blocks."""
    alpha, ratio = np.array([g[1] for g in grid]), np.array([g[2] for g in grid])
    # Each candidate's neighbour with the next larger penalty of its kind, and its place on the path.
    order = sorted(range(len(grid)), key=lambda c: (ratio[c], -alpha[c], c))
    before = {c: o for o, c in zip(order, order[1:]) if ratio[o] == ratio[c]}
    depth: dict[int, int] = {}
    for c in order:
        depth[c] = depth[before[c]] + 1 if c in before else 0
    source = np.array([before.get(c, c) for c in range(len(grid))])
    wait = np.array([depth[c] for c in range(len(grid))])

    def run(moments: pa.Table, states: pa.Table) -> pa.Table:
        sums: dict[tuple, list] = {}
        if len(moments):
            number = moments["_b"].to_numpy()
            hazard, curve = _matrix(moments, "hazard"), _matrix(moments, "curve").sum(axis=0)
            base = _matrix(moments, "base").reshape(len(moments), len(grid), -1)
            for i in range(len(moments)):
                # Events of blocks before, and of the other parts of the same one.
                passed = number <= number[i]
                passed[i] = False
                curve = curve + (hazard[passed].sum(axis=0)[:, None] * base[i]).ravel()
            key = (moments["fold"][0].as_py(), moments["inner_fold"][0].as_py())
            sums[key] = [_matrix(moments, "loglik").sum(axis=0), _matrix(moments, "gradient").sum(axis=0), curve]
        records = states.to_pylist()
        for state in records:
            key = (state["fold"], state["inner_fold"])
            if key not in sums:
                continue
            many, n = len(grid), max(state["n"], 1)
            beta, last = (np.array(state[c]).reshape(many, -1) for c in ("beta", "before"))
            p = beta.shape[1]
            gradient, curve = sums[key][1].reshape(many, p) / n, sums[key][2].reshape(many, p, p) / n
            l1, l2 = alpha * ratio, alpha * (1 - ratio)
            done, rounds = np.array(state["done"]) > 0, np.array(state["rounds"])
            value = sums[key][0] / n - l1 * np.abs(beta).sum(axis=1) - l2 / 2 * (beta**2).sum(axis=1)
            residual = np.where(done, state["residual"], optimality_residual(beta, gradient, l1, l2))
            worse = ~done & (value < np.array(state["objective"]) - 1e-10 * (1 + np.abs(value)))
            met = ~done & (residual <= TOLERANCE)
            # The strong rule from the neighbour's penalty; the first of a path starts with what the largest one leaves in.
            largest = np.abs(gradient).max(axis=1)
            start = np.where(source == np.arange(many), 2 * l1 - np.maximum(largest, l1), 2 * l1 - alpha[source] * ratio[source])
            stepped = penalised_step(beta, gradient, curve, l1, l2, np.maximum(start, 0.0))
            new = np.where((done | met)[:, None], beta, np.where(worse[:, None], (beta + last) / 2, stepped))
            now = np.where((done | met | worse)[:, None], last, beta)
            best = np.where(worse | done, state["objective"], value)
            # A candidate that waits for its turn follows its neighbour.
            for c in order:
                if not done[c] and not met[c] and rounds[c] < wait[c]:
                    new[c], now[c], best[c] = new[source[c]], new[source[c]], -np.inf
            state |= {
                "beta": new.ravel(), "before": now.ravel(), "objective": best, "residual": residual,
                "rounds": rounds + ~done, "done": (done | met).astype(float),
            }
        return _rows(records, _state_types(by, by_type))

    return run


def fit_paths(rows: DataFrame, grid: list[tuple[int, float, float]], n_inner: int, by: str) -> DataFrame:
    """States of all partitions (by, repeat, fold, inner_fold), fitted for every candidate of ``grid``.

    ``rows`` is what ``member_rows`` returns; inner fold 0 is the outer training set. ``done`` and ``residual``
    tell which candidates are certified; the others haven't converged within ``MAX_ROUNDS``.
    """
    kind = rows.select(by).schema[0].dataType
    by_type = pa.string() if isinstance(kind, T.StringType) else pa.int64()
    by_ddl = f"`{by}` {kind.simpleString()}"
    names = f"{by_ddl}, repeat int, fold int, inner_fold int"
    block = [by, *PLACE, "repeat"]
    sums = rows.groupBy(*block).applyInArrow(
        _sums(by, by_type), f"{names}, n bigint, events bigint, {_doubles('count', 's1', 's2')}"
    )
    state = written(
        written(sums, "path-sums").groupBy(by, "repeat").applyInArrow(_initial(by, by_type, n_inner, len(grid)), f"{names}, {_STATE}"),
        "path-state",
    )
    blocks = written(rows.select(by, *PLACE).distinct(), "path-blocks")
    several = not blocks.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()
    where = f"{by_ddl}, _b int, _s int, repeat int, fold int, inner_fold int"
    grouped = rows.groupBy(*block)
    for _ in range(MAX_ROUNDS):
        asked = state.join(blocks, by)
        if several:
            totals = grouped.cogroup(asked.groupBy(*block)).applyInArrow(
                _per_partition(by, by_type, ["s0", "s1"], _block_totals), f"{where}, {_doubles('s0', 's1')}"
            )
            later = totals.groupBy(by, *PART).applyInArrow(_later(by, by_type), f"{where}, {_doubles('later0', 'later1')}")
            asked = asked.join(written(later, "path-later"), [by, *PLACE, *PART], "left")
        moments = grouped.cogroup(asked.groupBy(*block)).applyInArrow(
            _per_partition(by, by_type, ["loglik", "gradient", "curve", "base", "hazard"], _moments), f"{where}, {_MOMENTS}"
        )
        moved = written(moments, "path-moments").groupBy(by, *PART).cogroup(state.groupBy(by, *PART))
        state = written(moved.applyInArrow(_advance(by, by_type, grid), f"{names}, {_STATE}"), "path-state")
        if state.filter(F.exists("done", lambda d: d == 0)).isEmpty():
            break
    return state


def held_risks(rows: DataFrame, state: DataFrame, by: str, candidates: int) -> DataFrame:
    """Linear predictors of the samples that each partition holds out: ``risks`` has one per candidate."""
    kind = rows.select(by).schema[0].dataType
    by_type = pa.string() if isinstance(kind, T.StringType) else pa.int64()
    block = [by, *PLACE, "repeat"]

    def run(samples: pa.Table, states: pa.Table) -> pa.Table:
        out = []
        if len(samples):
            whole = _Block(samples)
            for one in states.to_pylist():
                if one["fold"] not in whole.folds:
                    continue
                own = np.flatnonzero(whole.held(one["fold"], one["inner_fold"]))
                beta = np.array(one["beta"]).reshape(candidates, -1)
                risks = whole.z(np.array(one["mean"]), np.array(one["sd"]))[own] @ beta.T
                picked = whole.table.take(pa.array(own))
                size = len(own)
                out.append(
                    pa.table(
                        {by: picked[by].cast(by_type), **{n: pa.array(np.full(size, one[n]), _INT) for n in PART},
                         "sample_id": picked["sample_id"], "_t": picked["_t"], "_e": picked["_e"],
                         "risks": pa.ListArray.from_arrays(pa.array(np.arange(0, size * candidates + 1, candidates), pa.int32()), pa.array(risks.ravel()))}
                    )
                )
        types = {by: by_type, **dict.fromkeys(PART, _INT), "sample_id": samples.schema.field("sample_id").type, "_t": pa.float64(), "_e": _INT, "risks": _LIST}
        return pa.concat_tables([pa.table({n: pa.array([], t) for n, t in types.items()}), *[t.cast(pa.schema(types)) for t in out]])

    blocks = written(rows.select(by, *PLACE).distinct(), "path-held-blocks")
    sample = rows.select("sample_id").schema[0].dataType.simpleString()
    schema = f"`{by}` {kind.simpleString()}, repeat int, fold int, inner_fold int, sample_id {sample}, _t double, _e int, risks array<double>"
    return rows.groupBy(*block).cogroup(state.join(blocks, by).groupBy(*block)).applyInArrow(run, schema)


def risk_concordance(held: DataFrame, by: str, candidates: int) -> DataFrame:
    """``comparable, c_index`` and validation ``events`` of every candidate: (by, repeat, fold, inner_fold, candidate index)."""
    keys = [by, *PART]
    held = written(held, "path-held")
    small, large = concordance.split_keys(held, keys, concordance.GROUP_ROWS)

    def run(table: pa.Table) -> pa.Table:
        time, event = table["_t"].to_numpy(), table["_e"].to_numpy()
        risks = table["risks"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), candidates)
        found = []
        for c in range(candidates):
            # A row without a risk takes no part.
            own = np.flatnonzero(~np.isnan(risks[:, c]))
            found.append([float(v[0]) for v in concordant(time[own], event[own], risks[own, c], np.ones((len(own), 1)))])
        found = np.array(found)
        once = np.zeros(candidates, np.int64)
        return pa.table({**{k: table[k].take(once) for k in keys}, "place": pa.array(np.arange(candidates), _INT), "comparable": found[:, 0], "credit": found[:, 1]})

    schema = held.select(*keys).schema.add("place", "integer").add("comparable", "double").add("credit", "double")
    totals = small.groupBy(*keys).applyInArrow(run, schema)
    if large is not None:
        each = large.select(*keys, "_t", "_e", F.posexplode("risks").alias("place", "_r")).filter("_r IS NOT NULL")
        cases = each.groupBy(*keys, "place", "_t", "_e", "_r").agg(F.count(F.lit(1)).cast("double").alias("_w"))
        totals = totals.unionByName(concordance.weighted_totals(written(cases, "path-cases"), [*keys, "place"]))
    events = held.groupBy(*keys).agg(F.sum("_e").alias("held_events"))
    c_index: Column = F.when(F.col("comparable") > 0, F.col("credit") / F.col("comparable"))
    return totals.join(events, keys).select(*keys, "place", "held_events", "comparable", c_index.alias("c_index"))
