"""Order statistics that never sort one key's rows in one task.

A window ordered over a whole key puts that key into a single task.  The verbs
here look for keys too large for that and split their value range into ordered
buckets first: a running total is then a within-bucket window plus the totals
of the buckets before it, and a hot key spreads over as many tasks as it has
buckets.  Inputs are written out before they are read several times, so plans
stay small and nothing is computed twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortforge.functions.staging import written

ROWS_PER_BUCKET = 200_000
SAMPLES_PER_BUCKET = 32
_HASH_SPACE = 1 << 31


def has_large_key(table: DataFrame, keys: list[str], limit: int) -> bool:
    """Whether any key of a written table has more than ``limit`` rows.

    The total comes from file metadata, so small tables cost no pass at all.
    """
    if table.count() <= limit:
        return False
    sizes = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not sizes.filter(F.col("_n") > limit).isEmpty()


def with_buckets(
    table: DataFrame,
    keys: list[str],
    value: str,
    bucket: str = "_bucket",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add an ordered bucket number per key to a written table, monotone in ``value``.

    Keys of up to ``rows_per_bucket`` rows get one bucket.  For larger keys the
    cut points come from a hash-chosen subset of their values: the hash decides,
    not a random draw, so every evaluation (and every task retry) agrees.  The
    subset only places the cuts; no row is left out of the result.
    """
    large = (
        table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_bucket)
        .withColumn("_k", F.ceil(F.col("_n") / rows_per_bucket))
    )
    position = F.pmod(F.xxhash64(value), F.lit(_HASH_SPACE))
    chosen = (
        table.select(*keys, value)
        .join(large, keys)
        .filter(
            position.cast("double") * F.col("_n")
            < F.lit(float(_HASH_SPACE * SAMPLES_PER_BUCKET)) * F.col("_k")
        )
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_set(value)).alias("_s"),
            F.max("_k").cast("int").alias("_k"),
        )
    )
    step = F.greatest(F.floor(F.size("_s") / F.col("_k")).cast("int"), F.lit(1))
    cuts = chosen.select(
        *keys, F.filter("_s", lambda _, i: (i + 1) % step == 0).alias("_cuts")
    )
    # The number of cuts grows with the key, so a value is placed among every w-th cut
    # first and then among the next w, w being about the root of their number.
    width = F.ceil(F.sqrt(F.size("_cuts"))).cast("int")
    cuts = cuts.select(*keys, "_cuts", F.filter("_cuts", lambda _, i: i % width == 0).alias("_ahead"), width.alias("_w"))
    ahead = F.size(F.filter("_ahead", lambda c: c <= F.col(value)))
    near = F.slice("_cuts", (ahead - 1) * F.col("_w") + 1, F.greatest(F.col("_w"), F.lit(1)))
    below = (ahead - 1) * F.col("_w") + F.size(F.filter(near, lambda c: c <= F.col(value)))
    placed = F.when(F.col("_cuts").isNull() | (ahead == 0), 0).otherwise(below)
    return table.join(cuts, keys, "left").withColumn(bucket, placed.cast("int")).drop("_cuts", "_ahead", "_w")


def running_totals(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    measures: list[str],
    descending: bool = False,
    bucket: str | None = None,
) -> DataFrame:
    """Inclusive running sums of ``measures`` as ``cum_<measure>``.

    ``rows`` must hold one row per ``keys + order`` (pre-aggregate first).  With
    a ``bucket`` column, monotone in ``order[0]``, each bucket is its own window
    and the totals of earlier buckets are added.
    """

    def sort(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    parts = [*keys, bucket] if bucket else keys
    within = (
        Window.partitionBy(*parts)
        .orderBy(*[sort(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if not bucket:
        return rows.select("*", *[F.sum(m).over(within).alias(f"cum_{m}") for m in measures])
    before = (
        Window.partitionBy(*keys).orderBy(sort(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.groupBy(*parts)
        .agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
        .select(
            *parts,
            *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        )
    )
    inner = rows.select("*", *[F.sum(m).over(within).alias(f"_w_{m}") for m in measures])
    return inner.join(offsets, parts).select(
        *rows.columns, *[(F.col(f"_w_{m}") + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures]
    )


def spread_totals(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    measures: list[str],
    descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``running_totals`` over rows of any key size; large keys are split into buckets."""
    table = written(rows, "running")
    if not has_large_key(table, keys, rows_per_bucket):
        return running_totals(table, keys, order, measures, descending)
    placed = written(with_buckets(table, keys, order[0], "_bucket", rows_per_bucket), "buckets")
    return running_totals(placed, keys, order, measures, descending, "_bucket").drop("_bucket")


def hashed_position(
    rows: DataFrame,
    keys: list[str],
    digest: str,
    tie: str,
    out: str = "position",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """1-based position of each row within its key when ordered by a hex digest.

    Digests are uniform, so for large keys their first characters are even buckets:
    as many characters as the largest key needs.
    """
    table = written(rows, "positions")
    if not has_large_key(table, keys, rows_per_bucket):
        order = Window.partitionBy(*keys).orderBy(digest, tie)
        return table.withColumn(out, F.row_number().over(order).cast("long"))
    largest = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    characters = max(2, math.ceil(math.log(largest / rows_per_bucket, 16)))
    placed = table.withColumn("_bucket", F.substring(digest, 1, characters))
    before = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        placed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(digest, tie)
    return (
        placed.withColumn("_rn", F.row_number().over(within))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_bucket", "_rn", "_off")
    )


BINS_PER_OCTAVE = 1024
SUB_BINS = 1024


def _coarse_bin(v: Column) -> Column:
    """Monotone integer bin: linear near zero, logarithmic beyond, both signs."""
    return (F.signum(v) * F.floor(F.log2(1.0 + F.abs(v) * 1024.0) * BINS_PER_OCTAVE)).cast("int")


def exact_quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
) -> DataFrame:
    """Exact linear-interpolation (type 7) quantiles per key, of the finite values.

    A map-side-combined histogram finds the bins that hold the wanted ranks.
    Only values of those bins are shuffled: they are counted per distinct value,
    split into equal-width sub-bins and ranked there, so neither a hot key nor a
    crowded bin is ordered in one task.
    """
    finite = F.abs(F.col(value).cast("double")) < float("inf")
    v = rows.filter(F.col(value).isNotNull() & ~F.isnan(value) & finite).select(
        *keys, F.col(value).alias("_v"), _coarse_bin(F.col(value)).alias("_bin")
    )
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = F.array(
        *[
            F.struct(
                F.lit(name).alias("q"),
                F.lit(side).alias("s"),
                rank(F.lit(float(p)) * (F.col("_n") - 1)).alias("r"),
                (F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1))).alias("f"),
            )
            for name, p in probs.items()
            for side, rank in ((0, F.floor), (1, F.ceil))
        ]
    )
    needed = (
        v.groupBy(*keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .select("*", F.sum("_c").over(per_key).alias("_n"), F.sum("_c").over(upto).alias("_end"))
        .select(
            *keys,
            "_bin",
            "_lo",
            "_hi",
            F.filter(sides, lambda w: (w["r"] >= F.col("_end") - F.col("_c")) & (w["r"] < F.col("_end"))).alias("_want"),
            (F.col("_end") - F.col("_c")).alias("_start"),
        )
        .filter(F.size("_want") > 0)
    )
    # At most two rows per key and quantile.
    needed = written(needed, "quantile-bins")
    width = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    sub = F.when(F.col("_hi") > F.col("_lo"), F.floor(width * SUB_BINS)).otherwise(0).cast("int")
    cells = (
        v.join(needed.select(*keys, "_bin", "_lo", "_hi"), [*keys, "_bin"])
        .groupBy(*keys, "_bin", sub.alias("_sub"), "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    cells = written(cells, "quantile-cells")
    placed = running_totals(cells, [*keys, "_bin"], ["_v"], ["_c"], bucket="_sub")
    local = F.transform(
        "_want", lambda w: F.struct(w["q"].alias("q"), w["s"].alias("s"), w["f"].alias("f"), (w["r"] - F.col("_start")).alias("r"))
    )
    hit = F.filter(local, lambda w: (w["r"] < F.col("cum__c")) & (w["r"] >= F.col("cum__c") - F.col("_c")))
    picked = (
        placed.join(needed.select(*keys, "_bin", "_start", "_want"), [*keys, "_bin"])
        .select(*keys, "_v", F.explode(hit).alias("_h"))
    )

    def end(name: str, side: int) -> Column:
        return F.max(F.when((F.col("_h.q") == name) & (F.col("_h.s") == side), F.col("_v")))

    def quantile(name: str) -> Column:
        frac = F.max(F.when(F.col("_h.q") == name, F.col("_h.f")))
        return end(name, 0) + (end(name, 1) - end(name, 0)) * frac

    return picked.groupBy(*keys).agg(*[quantile(name).alias(name) for name in probs])
