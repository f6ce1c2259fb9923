"""Running a stream over landed files once and reading its output back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortforge.functions.staging import shared_folder


def run_available(
    spark: SparkSession,
    landing: str,
    schema: str,
    verb: Callable[[DataFrame], DataFrame],
    file_format: str = "parquet",
    files_per_trigger: int = 4,
    base: str | None = None,
) -> DataFrame:
    """Apply a stream verb to the files of a folder until none is left.

    ``base`` is the caller's folder for progress and output: a query that is started again with it carries on
    where it stopped and takes only files it hasn't seen. Without one, a new folder in the shared one serves this run.
    """
    base = base or f"{shared_folder(spark)}/cohortforge/stream-{uuid.uuid4().hex}"
    source = (
        spark.readStream.format(file_format).schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger).load(landing)
    )
    out = verb(source)
    query = (
        out.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True).start(f"{base}/out")
    )
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
