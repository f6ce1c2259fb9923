"""Harrell's C for many keys at once.

A key of up to ``GROUP_ROWS`` rows is counted by itself from one shuffle of its rows (``pair_counts``).
Larger ones are counted without enumerating pairs: the credit of an event is the number of comparable partners with a lower risk
(plus half of the tied ones).  Counting partners that are both later in time and
lower in risk is a two-dimensional count.  It is done with a binary
decomposition of the risk ranks: "rank below T" is a disjoint union of at most
log2(n) rank blocks, and within one block the later partners are a running
total over time.  Everything is sums per (key, block, time), so work is
n log n, map-side combinable, and ties or hot keys do not pile up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.numeric import ratio
from cohortforge.functions.staging import written
from cohortforge.operators.ordering import has_large_key, spread_totals
from cohortforge.operators.pair_counts import RISK_TIE, key_totals

GROUP_ROWS = 1_000_000


def rank_positions(cases: DataFrame, keys: list[str], risk: str = "_r") -> DataFrame:
    """Per distinct risk: its rank, and how many distinct risks count as lower / not higher.

    ``lo`` counts risks below ``risk - RISK_TIE``, ``hi`` those up to
    ``risk + RISK_TIE``; the band between them is tied.
    """
    r = F.col(risk)
    marks = F.array(
        F.struct((r - RISK_TIE).alias("_v"), F.lit(0).alias("_k"), F.lit(0).alias("_c")),
        F.struct(r.alias("_v"), F.lit(1).alias("_k"), F.lit(1).alias("_c")),
        F.struct((r + RISK_TIE).alias("_v"), F.lit(2).alias("_k"), F.lit(0).alias("_c")),
    )
    rows = cases.select(*keys, risk).distinct().select(*keys, risk, F.inline(marks))
    placed = spread_totals(rows, keys, ["_v", "_k"], ["_c"])

    def at(kind: int) -> Column:
        return F.max(F.when(F.col("_k") == kind, F.col("cum__c")))

    return placed.groupBy(*keys, risk).agg(
        (at(1) - 1).alias("pos"), at(0).alias("lo"), at(2).alias("hi")
    )


def with_ranks(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Attach rank positions and the number of rank bits to (keys, _t, _e, _r, ...) rows."""
    cases = written(cases, "cases")
    ranks = written(rank_positions(cases, keys), "ranks")
    bits = ranks.groupBy(*keys).agg(F.length(F.bin(F.max("hi"))).alias("_bits"))
    bits = written(bits, "rank-bits")
    return cases.join(ranks, [*keys, "_r"]).join(bits, keys)


def pair_totals(ranked: DataFrame, keys: list[str], weight: str = "_w") -> DataFrame:
    """Weighted comparable pairs and credit per key.

    ``ranked`` has (keys, _t, _e, weight, pos, lo, hi, _bits).  A pair weighs the
    product of its two weights.
    """
    w = F.col(weight)
    event = F.col("_e") == 1
    level = F.col("_l")

    def bit(c: str) -> Column:
        return F.getbit(F.col(c).cast("long"), level)

    def block(c: str) -> Column:
        return F.call_function("shiftright", F.col(c).cast("long"), level + 1)

    def ask(c: str) -> Column:
        use = event & (bit(c) == 1)
        return F.struct(
            block(c).alias("_node"), F.lit(0.0).alias("_p"), F.when(use, w * 0.5).otherwise(0.0).alias("_q")
        )

    offer = F.struct(
        block("pos").alias("_node"), F.when(bit("pos") == 0, w).otherwise(0.0).alias("_p"), F.lit(0.0).alias("_q")
    )
    phase = F.when(event, 0).otherwise(1).alias("_ph")
    blocks = (
        ranked.withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
        .select(*keys, "_t", phase, "_l", F.inline(F.array(offer, ask("lo"), ask("hi"))))
        .filter((F.col("_p") != 0) | (F.col("_q") != 0))
    )
    # Block -1 holds everyone, its total is the number of comparable pairs.
    whole = ranked.select(
        *keys, "_t", phase, F.lit(-1).alias("_l"), F.lit(0).cast("long").alias("_node"),
        w.alias("_p"), F.when(event, w).otherwise(0.0).alias("_q"),
    )
    cells = (
        blocks.unionByName(whole)
        .groupBy(*keys, "_l", "_node", "_t", "_ph")
        .agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    )
    # Later in time, or censored at the same time: strictly after (time, phase 0).
    later = spread_totals(cells, [*keys, "_l", "_node"], ["_t", "_ph"], ["_p"], descending=True)
    count = F.col("_q") * (F.col("cum__p") - F.col("_p"))
    whole_block = F.col("_l") == -1
    return later.groupBy(*keys).agg(
        F.sum(F.when(whole_block, count).otherwise(0.0)).alias("comparable"),
        F.sum(F.when(~whole_block, count).otherwise(0.0)).alias("credit"),
    )


def cases_of(
    predictions: DataFrame, keys: list[str], time: str, event: str, risk: str, weight: str | None = None
) -> DataFrame:
    """Predictions collapsed to distinct (time, event, risk) with their total weight."""
    w = F.col(weight) if weight else F.lit(1.0)
    return (
        predictions.groupBy(
            *keys,
            F.col(time).cast("double").alias("_t"),
            F.col(event).cast("int").alias("_e"),
            F.col(risk).cast("double").alias("_r"),
        )
        .agg(F.sum(w.cast("double")).alias("_w"))
        .filter(F.col("_t").isNotNull() & F.col("_e").isNotNull() & F.col("_r").isNotNull())
    )


def split_keys(cases: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of a written table by the size of their key: up to ``limit`` rows, and over it (None if there are none)."""
    if not has_large_key(cases, keys, limit):
        return cases, None
    sizes = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    large = written(sizes.select(*keys), "large-keys")
    return cases.join(large, keys, "left_anti"), cases.join(large, keys)


def weighted_totals(cases: DataFrame, keys: list[str]) -> DataFrame:
    """``comparable`` and ``credit`` per key of written rows (keys, _t, _e, _r, _w)."""
    small, large = split_keys(cases, keys, GROUP_ROWS)
    schema = cases.select(*keys).schema.add("comparable", "double").add("credit", "double")
    totals = small.groupBy(*keys).applyInArrow(key_totals(keys), schema)
    if large is None:
        return totals
    return totals.unionByName(pair_totals(written(with_ranks(large, keys), "ranked"), keys))


def harrell(
    predictions: DataFrame,
    keys: list[str],
    time: str = "time_months",
    event: str = "event",
    risk: str = "risk",
) -> DataFrame:
    """(keys, comparable_pairs, c_index, error); C is NULL where no pair is comparable."""
    cases = written(cases_of(predictions, keys, time, event, risk), "cases")
    return weighted_totals(cases, keys).select(
        *keys,
        F.col("comparable").cast("long").alias("comparable_pairs"),
        ratio(F.col("credit"), F.col("comparable")).alias("c_index"),
        F.when(F.col("comparable") == 0, "no_comparable_pairs").alias("error"),
    )
