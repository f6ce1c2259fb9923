"""Samples with all their features and the folds that hold them out, in blocks that a task reduces or scores by numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from cohortforge.functions.staging import written

#: Samples of a block, on average.
BLOCK_ROWS = 20_000


def _group(group: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in group])


def held_rows(matrix: DataFrame, held: DataFrame, genes: list[str], group: list[str], part: str, by: str) -> DataFrame:
    """A written row per sample: by, ``_block, sample_id, _x`` and ``_own``.

    ``_x`` has the values of ``genes`` less their cohort means, null where absent; ``_own`` a ``_g, _p`` for each row of
    ``held`` (by, group, part, sample_id): the part of a group that holds the sample out.
    """
    centre = matrix.groupBy(by, "gene").agg(F.avg("value").alias("_c"))
    centred = matrix.join(centre, [by, "gene"]).select(by, "sample_id", "gene", (F.col("value") - F.col("_c")).alias("_v"))
    wide = centred.groupBy(by, "sample_id").agg(F.array(*[F.max(F.when(F.col("gene") == g, F.col("_v"))) for g in genes]).alias("_x"))
    own = F.struct(_group(group).alias("_g"), F.col(part).alias("_p"))
    rows = held.groupBy(by, "sample_id").agg(F.collect_list(own).alias("_own")).join(wide, [by, "sample_id"])
    rows = written(rows, "fold-rows")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    return rows.withColumn("_block", F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int"))


def _features(table: pa.Table) -> np.ndarray:
    flat = table["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), -1).astype(float)


def _owned(table: pa.Table) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of every ``_own``: its row, the groups' names, its group's number and its part."""
    own = table["_own"].combine_chunks()
    row = np.repeat(np.arange(len(table)), np.diff(own.offsets.to_numpy()))
    flat = own.flatten()
    group = flat.field("_g").dictionary_encode()
    return row, group.dictionary.to_pylist(), group.indices.to_numpy(), flat.field("_p").to_numpy(zero_copy_only=False)


def part_moments(rows: DataFrame, held: DataFrame, genes: list[str], group: list[str], part: str, by: str) -> DataFrame:
    """``n, s1, s2`` of the centred values of every part and gene: (by, group, part, gene)."""
    kind = held.schema[part].dataType

    def run(table: pa.Table) -> pa.Table:
        x = _features(table)
        known = ~np.isnan(x)
        x = np.where(known, x, 0.0)
        row, names, number, parts = _owned(table)
        held_by, place = np.unique(np.stack([number, parts]), axis=1, return_inverse=True)
        place, width = place.ravel(), held_by.shape[1]
        sums = [
            np.concatenate([np.bincount(place, v[row, a], width) for a in range(len(genes))])
            for v in (known.astype(float), x, x * x)
        ]
        once = np.zeros(width * len(genes), np.int64)
        return pa.table({
            by: table[by].take(once),
            "_g": pa.array(np.array(names, object)[np.tile(held_by[0], len(genes))], pa.string()),
            "_p": np.tile(held_by[1], len(genes)).astype(np.int32),
            "_a": np.repeat(np.arange(len(genes), dtype=np.int32), width),
            "n": sums[0].astype(np.int64), "s1": sums[1], "s2": sums[2],
        })

    schema = StructType([rows.schema[by]]).add("_g", "string").add("_p", "integer").add("_a", "integer")
    schema = schema.add("n", "long").add("s1", "double").add("s2", "double")
    found = rows.select(by, "_block", "_x", "_own").groupBy(by, "_block").applyInArrow(run, schema)
    found = found.groupBy(by, "_g", "_p", "_a").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    names = held.select(by, *group).distinct().withColumn("_g", _group(group))
    gene = F.array(*[F.lit(g) for g in genes])[F.col("_a")]
    return written(
        found.join(names, [by, "_g"]).select(by, *group, F.col("_p").cast(kind).alias(part), gene.alias("gene"), "n", "s1", "s2"), "fold-moments"
    )


def part_scores(
    rows: DataFrame, fitted: DataFrame, genes: list[str], sets: list[list[str]], group: list[str], part: str, by: str, only_held: bool
) -> DataFrame:
    """Mean z of every set of genes for the samples of each part's group: by, group, part, sample_id, outcome, ``_held, _r``.

    ``fitted`` has (by, group, part, gene, mean, sd), means less the cohort's. ``_r`` has a value per set, null where none of
    its genes has a z. ``only_held`` leaves out the samples that the part trains on.
    """
    pick = [F.col("gene") == g for g in genes]
    weights = fitted.groupBy(by, *group, part).agg(
        F.array(*[F.max(F.when(p, F.col("mean"))) for p in pick]).alias("_m"),
        F.array(*[F.max(F.when(p, F.col("sd"))) for p in pick]).alias("_s"),
    )
    blocks = written(rows.select(by, "_block").distinct(), "fold-blocks")
    weights = weights.join(blocks, by).withColumn("_g", _group(group))
    member = np.array([[float(g in s) for s in sets] for g in genes])
    outcome = [c for c in ("time_months", "event") if c in rows.columns]
    schema = StructType([rows.schema[by], *[weights.schema[c] for c in [*group, part]], rows.schema["sample_id"], *[rows.schema[c] for c in outcome]])
    schema = schema.add("_held", "boolean").add("_r", ArrayType(DoubleType()))
    keep = [*group, part]

    def run(samples: pa.Table, states: pa.Table) -> pa.Table:
        x = _features(samples) if len(samples) else None
        row, names, number, parts = _owned(samples)
        numbers, out = {g: i for i, g in enumerate(names)}, []
        for at, one in enumerate(states.select(["_g", part, "_m", "_s"]).to_pylist()):
            mine = np.flatnonzero(number == numbers.get(one["_g"], -1))
            held = parts[mine] == one[part]
            if only_held:
                mine, held = mine[held], held[held]
            if not len(mine):
                continue
            z = (x[row[mine]] - np.array(one["_m"], float)) / np.array(one["_s"], float)
            known = ~np.isnan(z)
            total, count = np.where(known, z, 0.0) @ member, known @ member
            risk = np.divide(total, count, out=np.zeros_like(total), where=count > 0)
            flat = pa.array(risk.ravel(), mask=(count == 0).ravel())
            ends = pa.array(np.arange(0, risk.size + 1, len(sets)), pa.int32())
            taken, once = pa.array(row[mine]), np.full(len(mine), at)
            out.append(pa.table({
                by: samples[by].take(taken), **{c: states[c].take(once) for c in keep}, "sample_id": samples["sample_id"].take(taken),
                **{c: samples[c].take(taken) for c in outcome}, "_held": held, "_r": pa.ListArray.from_arrays(ends, flat),
            }))
        kinds = {by: samples.schema.field(by).type, **{c: states.schema.field(c).type for c in keep}}
        kinds |= {c: samples.schema.field(c).type for c in ["sample_id", *outcome]} | {"_held": pa.bool_(), "_r": pa.list_(pa.float64())}
        return pa.concat_tables([pa.table({c: pa.array([], t) for c, t in kinds.items()}), *[t.cast(pa.schema(kinds)) for t in out]])

    return rows.groupBy(by, "_block").cogroup(weights.groupBy(by, "_block")).applyInArrow(run, schema)
