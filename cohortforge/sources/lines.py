"""Line-wise scans that keep the order of lines within each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.staging import written
from cohortforge.functions.text import unquote

_ROW_MASK = (1 << 33) - 1


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(file, line_no, line) of text files, plain or gzipped.

    ``line_no`` grows along each file without any shuffle: the byte offset of
    the split plus the row's position within its task.  A row takes at least one
    byte, so positions never run into the offset of the next split.  Numbers are
    ordinals, not consecutive.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    position = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK))
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") + position).alias("line_no"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )


def fields(line: Column, sep: str = "\t") -> Column:
    return F.split(line, sep)


def between_markers(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """Non-blank lines between two marker lines of each file, markers excluded."""
    marks = lines.groupBy("file").agg(
        F.min(F.when(F.col("line").startswith(begin), F.col("line_no"))).alias("_begin"),
        F.min(F.when(F.col("line").startswith(end), F.col("line_no"))).alias("_end"),
    )
    # One row per file, of known size: the lines of a large file are not shuffled.
    marks = written(marks, "markers")
    return (
        lines.join(marks, "file")
        .filter(
            (F.col("line_no") > F.col("_begin"))
            & (F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
            & (F.trim("line") != "")
        )
        .drop("_begin", "_end")
    )


def split_header(table_lines: DataFrame, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(file, header fields) and the body lines, of tables whose first line is a header."""
    first = table_lines.groupBy("file").agg(
        F.min("line_no").alias("_first"), F.min_by("line", "line_no").alias("_header")
    )
    first = written(first, "headers")
    header = first.select("file", fields(F.col("_header"), sep).alias("header"))
    body = table_lines.join(first.select("file", "_first"), "file").filter(
        F.col("line_no") > F.col("_first")
    ).drop("_first")
    return header, body


def melt(header: DataFrame, body: DataFrame, sep: str = "\t") -> DataFrame:
    """Body cells as (file, line_no, row_label, pos, column, raw), first column = row label."""
    parts = fields(F.col("line"), sep)
    labelled = body.select("file", "line_no", unquote(parts[0]).alias("row_label"), parts.alias("_parts"))
    cells = labelled.select("file", "line_no", "row_label", F.posexplode("_parts").alias("pos", "raw")).filter(F.col("pos") > 0)
    # A name meets its cells by position: no cell carries the whole header.
    names = header.select("file", F.posexplode("header").alias("pos", "_name"))
    return cells.join(header.select("file"), "file").join(names, ["file", "pos"], "left").select(
        "file",
        "line_no",
        "row_label",
        "pos",
        unquote(F.col("_name")).alias("column"),
        unquote(F.col("raw")).alias("raw"),
    )
