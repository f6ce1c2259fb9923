"""Tables that grow by appends: files first, then one commit row; readers see committed files only.

Below a folder lie ``data/batch=<id>/`` (Parquet files), ``files/`` (rows, size, time and
content sums of every file by key) and ``commits/`` (one row a batch, in a file of its
own, so a commit becomes visible by a single rename). An append that stops anywhere
before its commit row leaves files that no reader takes; running it again is safe.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.hashing import content_sums, merged_sums, sums_text


def _file(path: Column) -> Column:
    """``batch=<id>/<name>`` of a data file, wherever the table lies."""
    return F.regexp_extract(path, r"/data/(batch=[^/]+/[^/]+)$", 1)


def _summed(data: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    named = data.select(
        *by,
        *[c for c in columns if c not in by],
        _file(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.file_size").alias("_bytes"),
        F.col("_metadata.file_modification_time").alias("_modified"),
    )
    return content_sums(named, ["_file", "_bytes", "_modified", *by], columns)


def stage(df: DataFrame, path: str, by: list[str]) -> str:
    """Write rows as a new batch and sum its files; nothing is visible until ``commit``.

    ``by`` names the key columns whose checksums ``checksums`` reports; rows are sorted by
    them within files. Rows are summed from the written files. Returns the batch's id.
    """
    spark = df.sparkSession
    batch = f"b{uuid.uuid4().hex}"
    _commit_rows(spark, batch).limit(0).write.mode("append").parquet(f"{path}/commits")
    df.sortWithinPartitions(*by).write.parquet(f"{path}/data/batch={batch}")
    stored = spark.read.schema(df.schema).parquet(f"{path}/data/batch={batch}")
    _summed(stored, by, df.columns).write.parquet(f"{path}/files/batch={batch}")
    return batch


def _commit_rows(spark: SparkSession, batch: str) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("at"))


def commit(spark: SparkSession, path: str, batch: str) -> None:
    """Make a staged batch visible; a batch committed twice counts once."""
    _commit_rows(spark, batch).write.mode("append").parquet(f"{path}/commits")


def append(df: DataFrame, path: str, by: list[str]) -> str:
    """Stage and commit; an append of no rows is a commit without files."""
    batch = stage(df, path, by)
    commit(df.sparkSession, path, batch)
    return batch


def _batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("batch string, at timestamp").parquet(f"{path}/commits").select("batch").distinct()


def committed_files(spark: SparkSession, path: str) -> DataFrame:
    """Recorded file rows of committed batches: file, size, time, keys, rows and content sums."""
    return spark.read.parquet(f"{path}/files").join(_batches(spark, path), "batch", "left_semi").drop("batch")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of committed files; torn appends and stray files stay out.

    Batches are pruned as partitions; of a committed batch, only recorded files are taken.
    """
    data = spark.read.parquet(f"{path}/data").withColumn("_file", _file(F.col("_metadata.file_path")))
    known = committed_files(spark, path).select("_file").distinct()
    kept = data.join(_batches(spark, path), "batch", "left_semi").join(known, "_file", "left_semi")
    return kept.drop("batch", "_file")


def checksums(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Content checksum per key of all committed rows, added up from those of files without reading data."""
    return sums_text(merged_sums(committed_files(spark, path), by), by)


def verify(spark: SparkSession, path: str, by: list[str], every_file: bool = False) -> DataFrame:
    """(file, status) of committed files: ok, changed or missing.

    A file of the recorded size and time keeps its sums unread; any other is summed anew,
    so a touched or copied file of the same content is ok. ``every_file`` reads them all.
    The names of the files to be read go through the driver, as those of any scan do.
    """
    recorded = committed_files(spark, path)
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        .load(f"{path}/data").select(_file(F.col("path")).alias("_file"), "length", "modificationTime")
    )
    files = recorded.select("_file", "_bytes", "_modified").distinct().join(listed, "_file", "left")
    same = (F.col("length") == F.col("_bytes")) & (F.col("modificationTime") == F.col("_modified")) & F.lit(not every_file)
    state = F.when(F.col("length").isNull(), "missing").when(same, "ok").otherwise("read")
    files = files.select("_file", state.alias("_state"))
    again = [f"{path}/data/{r['_file']}" for r in files.where("_state = 'read'").select("_file").collect()]
    if not again:
        return files.select(F.col("_file").alias("file"), F.col("_state").alias("status"))
    columns = [c for c in spark.read.parquet(f"{path}/data").columns if c != "batch"]
    now = _summed(spark.read.parquet(*again), by, columns).select(
        "_file", *by, *[F.col(c).alias(f"_{c}_now") for c in ("n_rows", "high", "low")]
    )
    was = recorded.join(files.where("_state = 'read'"), "_file", "left_semi")
    both = was.join(now.withColumnsRenamed({b: f"_now_{b}" for b in by}).withColumnRenamed("_file", "_now_file"), _same_part(by), "full")
    unlike = ~(F.col("n_rows").eqNullSafe(F.col("_n_rows_now")) & F.col("high").eqNullSafe(F.col("_high_now")) & F.col("low").eqNullSafe(F.col("_low_now")))
    changed = both.where(unlike).select(F.coalesce("_file", "_now_file").alias("_file")).distinct().withColumn("_changed", F.lit(True))
    status = F.when(F.col("_changed"), "changed").when(F.col("_state") == "read", "ok").otherwise(F.col("_state"))
    return files.join(changed, "_file", "left").select(F.col("_file").alias("file"), status.alias("status"))


def _same_part(by: list[str]) -> Column:
    out = F.col("_file") == F.col("_now_file")
    for key in by:
        out = out & F.col(key).eqNullSafe(F.col(f"_now_{key}"))
    return out
