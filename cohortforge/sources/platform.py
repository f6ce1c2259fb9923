"""Platform annotation tables: probe to symbol text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.staging import written
from cohortforge.functions.text import unquote
from cohortforge.sources.lines import fields, melt, numbered_lines, split_header

# Candidate symbol columns in order of preference, and markers.
SYMBOL_COLUMNS = [
    "Gene symbol",
    "Gene Symbol",
    "GENE_SYMBOL",
    "gene_symbol",
    "Symbol",
    "SYMBOL",
    "ILMN_Gene",
]
BEGIN, END = "!platform_table_begin", "!platform_table_end"


def table_lines(lines: DataFrame) -> DataFrame:
    """Annotation table lines: between the markers, or the bare non-metadata lines."""
    marks = lines.groupBy("file").agg(
        F.min(F.when(F.col("line").startswith(BEGIN), F.col("line_no"))).alias("_b"),
        F.min(F.when(F.col("line").startswith(END), F.col("line_no"))).alias("_e"),
    )
    marks = written(marks, "markers")
    inside = (F.col("line_no") > F.col("_b")) & (F.col("_e").isNull() | (F.col("line_no") < F.col("_e")))
    bare = F.col("_b").isNull() & ~F.col("line").rlike(r"^[\^!#]")
    return lines.join(marks, "file").filter(
        (F.trim("line") != "") & (F.coalesce(inside, F.lit(False)) | bare)
    ).select("file", "line_no", "line")


def platform_ids(lines: DataFrame) -> DataFrame:
    """Platform accession of each file, ``unknown`` where none is named."""
    named = F.col("line").startswith("^PLATFORM") | F.col("line").startswith("!Platform_geo_accession")
    value = unquote(F.regexp_extract("line", r"^[^=]*=(.*)$", 1))
    return lines.groupBy("file").agg(
        F.coalesce(
            F.min_by(F.when(named, value), F.when(named, F.col("line_no"))), F.lit("unknown")
        ).alias("platform")
    )


def read_annotation(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(platform, probe, symbol) of annotation files; ready for ``harmonise.probe_map``."""
    lines = numbered_lines(spark, path)
    header, body = split_header(table_lines(lines))
    preference = F.array(*[F.lit(c) for c in SYMBOL_COLUMNS])
    names = F.transform("header", lambda h: unquote(h))
    chosen = F.get(F.filter(preference, lambda c: F.array_contains(names, c)), F.lit(0))
    symbol = header.select("file", chosen.alias("_symbol"))
    cells = melt(header, body).join(symbol, "file").filter(F.col("column") == F.col("_symbol"))
    probes = body.select("file", "line_no", unquote(fields(F.col("line"))[0]).alias("probe"))
    return (
        probes.join(cells.select("file", "line_no", F.col("raw").alias("symbol")), ["file", "line_no"], "left")
        .join(platform_ids(lines), "file")
        .select("platform", "probe", "symbol")
    )


def unreadable_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Annotation files without a table or without any known symbol column."""
    lines = numbered_lines(spark, path)
    header, _ = split_header(table_lines(lines))
    preference = F.array(*[F.lit(c) for c in SYMBOL_COLUMNS])
    names = F.transform("header", lambda h: unquote(h))
    known = header.select("file", F.arrays_overlap(names, preference).alias("_ok"))
    return (
        lines.select("file").distinct().join(known, "file", "left")
        .withColumn("problem", F.when(F.col("_ok").isNull(), "no_table").when(~F.col("_ok"), "no_symbol_column"))
        .filter(F.col("problem").isNotNull()).select("file", "problem")
    )
