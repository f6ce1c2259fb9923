"""Cutting lineage with tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
#: Rows of a task in a table that ``dealt`` deals.
TASK_ROWS = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="cohortforge-")
    return _LOCAL_FOLDERS[context.applicationId]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Unlike a cached DataFrame the result survives lost executors, carries exact
    size statistics for join planning, and has no lineage to recompute.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cohortforge/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal a DataFrame of about ``rows`` rows by its keys, so that a task's share doesn't grow with the table.

    A share has ``TASK_ROWS`` rows; what would be fewer than two tasks for each slot is left to the planner.
    """
    wanted = -(-rows // TASK_ROWS)
    if wanted < 2 * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(wanted, *keys)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small constant table as a local relation, so its exact size is known to the planner."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = [pa.array([r[i] for r in rows], type=arrow.field(i).type) for i in range(len(arrow))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=fields)
