"""Provenance rows and verification of files by content hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.hashing import tagged_sha
from cohortforge.sources.byte_ranges import BLOCK, opened

ARTEFACT_COLUMNS = ["run_id", "role", "kind", "name", "checksum", "at"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Listed files with the tagged SHA-256 of their content, read block by block."""
    for batch in batches:
        sums = []
        for path in batch["path"].to_pylist():
            digest = hashlib.sha256()
            system, place = opened(path)
            with system.open_input_file(place) as source:
                while block := source.read(BLOCK):
                    digest.update(block)
            sums.append(f"sha256:{digest.hexdigest()}")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=[*batch.schema.names, "checksum"])


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, n_bytes, modified, checksum) of every file below a folder.

    A task reads its files block by block, so they may have any size. Only where pyarrow can't open the path does
    Spark read them, each as one value of under 2 GB.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    )
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        pass
    else:
        listed = files.select("path", "length", "modificationTime")
        summed = listed.mapInArrow(_digests, "path string, length bigint, modificationTime timestamp, checksum string")
        return summed.select(
            F.regexp_replace("path", "^file:/+", "/").alias("path"),
            F.element_at(F.split("path", "/"), -1).alias("name"),
            F.col("length").alias("n_bytes"),
            F.col("modificationTime").alias("modified"),
            "checksum",
        )
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("n_bytes"),
        F.col("modificationTime").alias("modified"),
        tagged_sha(F.col("content")).alias("checksum"),
    )


def artefacts(run_id: str, role: str, kind: str, rows: DataFrame) -> DataFrame:
    """(name, checksum) rows as artefact records of a run."""
    return rows.select(
        F.lit(run_id).alias("run_id"),
        F.lit(role).alias("role"),
        F.lit(kind).alias("kind"),
        "name",
        "checksum",
        F.current_timestamp().alias("at"),
    )


def record_inputs(
    run_id: str, cohorts: DataFrame, signatures: DataFrame, authority: DataFrame
) -> DataFrame:
    """Inputs of a run by hash: cohorts, signatures and the symbol authority."""
    return (
        artefacts(run_id, "input", "cohort", cohorts.select(F.col("cohort_id").alias("name"), F.col("content_checksum").alias("checksum")))
        .unionByName(artefacts(run_id, "input", "signature", signatures.select(F.col("signature").alias("name"), "checksum")))
        .unionByName(artefacts(run_id, "input", "symbol_authority", authority.select("name", "checksum")))
    )


def record_step(spark: SparkSession, cohort_id: str, seq: int, action: str, detail: dict) -> DataFrame:
    """One provenance row: (cohort_id, seq, action, detail, at)."""
    entries = [x for k, v in detail.items() for x in (F.lit(k), F.lit(None if v is None else str(v)))]
    return spark.range(1).select(
        F.lit(cohort_id).alias("cohort_id"),
        F.lit(seq).alias("seq"),
        F.lit(action).alias("action"),
        F.create_map(*entries).cast("map<string,string>").alias("detail"),
        F.current_timestamp().alias("at"),
    )


def steps_from_counts(counts: DataFrame, action: str, seq: int, by: str = "cohort_id") -> DataFrame:
    """One provenance row per cohort from a table of per-cohort counts."""
    entries = [x for c in counts.columns if c != by for x in (F.lit(c), F.col(c).cast("string"))]
    return counts.select(
        by,
        F.lit(seq).alias("seq"),
        F.lit(action).alias("action"),
        F.create_map(*entries).alias("detail"),
        F.current_timestamp().alias("at"),
    )


def verify_outputs(recorded: DataFrame, inventory: DataFrame) -> DataFrame:
    """(name, status) of recorded outputs: ok, changed or missing.

    A file that is not at its recorded path is looked up by its file name, so a
    relocated result still verifies.
    """
    wanted = recorded.select("name", F.col("checksum").alias("_want")).withColumn(
        "_file", F.element_at(F.split("name", "/"), -1)
    )
    at_path = inventory.select(F.col("path").alias("name"), F.col("checksum").alias("_there"))
    by_name = inventory.groupBy(F.col("name").alias("_file")).agg(
        F.min_by("checksum", "path").alias("_moved")
    )
    seen = F.coalesce("_there", "_moved")
    status = F.when(seen.isNull(), "missing").when(seen == F.col("_want"), "ok").otherwise("changed")
    return wanted.join(at_path, "name", "left").join(by_name, "_file", "left").select(
        "name", status.alias("status")
    )
