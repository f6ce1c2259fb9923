"""Cut points, row keys and small shared plan helpers of the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.staging import shared_folder

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/cohortforge/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    The rows survive lost executors. The shuffle files of the write are removed when
    it ends, so a chain of cut points holds one shuffle at a time on the disks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later read needs."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_words(text: Column) -> Column:
    """Words between ASCII white space, in order; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of keys in which null equals null."""
    out = F.lit(True)
    for key in keys:
        out = out & left[key].eqNullSafe(right[key])
    return out


def numbered(docs: DataFrame, names: Sequence[str], **extra: Column) -> DataFrame:
    """Columns ``names`` as ``_0, _1, ...`` and then ``extra``, so that no caller's name clashes with an internal one."""
    own = [docs[c].alias(f"_{n}") for n, c in enumerate(names)]
    return docs.select(*own, *[value.alias(name) for name, value in extra.items()])
