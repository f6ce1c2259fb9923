"""Series-matrix files: metadata lines, sample characteristics, expression table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.numeric import tidy_double
from cohortforge.functions.text import key_part, unquote, value_part
from cohortforge.sources.lines import between_markers, fields, melt, numbered_lines, split_header

# Line prefixes of the format.
BEGIN, END = "!series_matrix_table_begin", "!series_matrix_table_end"
CHARACTERISTICS = "!Sample_characteristics_ch"
ACCESSION = "!Sample_geo_accession"
EXTRA_COLUMNS = {"!Sample_title": "title", "!Sample_source_name_ch1": "source_name_ch1"}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return numbered_lines(spark, path)


def _meta(lines: DataFrame) -> DataFrame:
    """Metadata cells as (file, line_no, tag, pos, value), pos counted from 1."""
    parts = fields(F.col("line"))
    # The tag is taken before the cells are listed, so that no cell carries its line.
    return (
        lines.filter(F.col("line").startswith("!"))
        .select("file", "line_no", F.trim(parts[0]).alias("tag"), parts.alias("_parts"))
        .select("file", "line_no", "tag", F.posexplode("_parts").alias("pos", "raw"))
        .filter(F.col("pos") > 0)
        .select("file", "line_no", "tag", "pos", unquote(F.col("raw")).alias("value"))
    )


def sample_ids(lines: DataFrame) -> DataFrame:
    """(file, pos, sample_id) in declared order; the table header where none is declared."""
    declared = _meta(lines).filter(F.col("tag") == ACCESSION).select("file", "pos", F.col("value").alias("sample_id"))
    header, _ = split_header(between_markers(lines, BEGIN, END))
    from_table = header.select("file", F.posexplode("header").alias("pos", "raw")).filter(F.col("pos") > 0).select(
        "file", "pos", unquote(F.col("raw")).alias("sample_id")
    )
    return declared.unionByName(
        from_table.join(declared.select("file").distinct(), "file", "left_anti")
    )


def expression(lines: DataFrame) -> DataFrame:
    """(file, feature, feature_pos, sample_id, value).

    Where the header ids differ from the declared ones but their number agrees,
    columns take the declared ids by position.
    """
    header, body = split_header(between_markers(lines, BEGIN, END))
    cells = melt(header, body)
    ids = sample_ids(lines)
    width = header.select("file", (F.size("header") - 1).alias("_w"))
    declared = ids.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    agree = width.join(declared, "file").filter(F.col("_w") == F.col("_n")).select("file")
    renamed = ids.join(agree, "file", "left_semi").withColumnRenamed("sample_id", "_declared")
    return cells.join(renamed, ["file", "pos"], "left").select(
        "file",
        F.col("row_label").alias("feature"),
        F.col("line_no").alias("feature_pos"),
        F.coalesce("_declared", "column").alias("sample_id"),
        tidy_double(F.col("raw")).alias("value"),
    )


def _characteristic_cells(lines: DataFrame) -> DataFrame:
    """Cells of usable characteristics lines with their line's modal key.

    A line is used when it has one cell per sample and at least one key.  Ties
    between keys go to the smallest.
    """
    ids = sample_ids(lines)
    n = ids.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    cells = _meta(lines).filter(F.col("tag").startswith(CHARACTERISTICS))
    sized = cells.groupBy("file", "line_no").agg(F.count(F.lit(1)).alias("_cells"))
    usable = sized.join(n, "file").filter(F.col("_cells") == F.col("_n")).select("file", "line_no")
    keyed = cells.join(usable, ["file", "line_no"], "left_semi").withColumn("_key", key_part(F.col("value")))
    counts = keyed.filter(F.col("_key").isNotNull()).groupBy("file", "line_no", "_key").agg(
        F.count(F.lit(1)).alias("_c")
    )
    modal = counts.groupBy("file", "line_no").agg(
        F.min(F.struct((-F.col("_c")).alias("c"), "_key"))["_key"].alias("key")
    )
    return keyed.join(modal, ["file", "line_no"])


def _column_names(cells: DataFrame) -> DataFrame:
    """Final column name of each characteristics line.

    A repeated key is suffixed with the number of columns seen so far.  The
    window covers one file's characteristics lines, a few dozen.
    """
    from pyspark.sql import Window

    lines = cells.select("file", "line_no", "key").distinct()
    order = Window.partitionBy("file").orderBy("line_no")
    repeat = Window.partitionBy("file", "key").orderBy("line_no")
    return lines.select(
        "file",
        "line_no",
        F.when(F.row_number().over(repeat) == 1, F.col("key")).otherwise(
            F.concat_ws("_", "key", (F.row_number().over(order) - 1).cast("string"))
        ).alias("column"),
    )


def clinical(lines: DataFrame) -> DataFrame:
    """(file, sample_id, attrs) with one map entry per clinical column.

    A cell's value belongs to its line's modal key even where the cell names
    another key (see ``disagreeing_cells``).
    """
    cells = _characteristic_cells(lines)
    named = cells.join(_column_names(cells), ["file", "line_no"]).select(
        "file", "pos", "column", value_part(F.col("value")).alias("v"), F.struct(F.lit(0).alias("k"), "line_no").alias("_o")
    )
    ids = sample_ids(lines)
    n = ids.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    tags = list(EXTRA_COLUMNS)
    extra = _meta(lines).filter(F.col("tag").isin(tags))
    full = extra.groupBy("file", "tag").agg(F.count(F.lit(1)).alias("_cells"), F.max("line_no").alias("line_no"))
    full = full.join(n, "file").filter(F.col("_cells") == F.col("_n")).select("file", "tag", "line_no")
    label = F.lit(None).cast("string")
    for tag, name in EXTRA_COLUMNS.items():
        label = F.when(F.col("tag") == tag, F.lit(name)).otherwise(label)
    extra = extra.join(full, ["file", "tag", "line_no"], "left_semi").select(
        "file", "pos", label.alias("column"), F.col("value").alias("v"), F.struct(F.lit(1).alias("k"), "line_no").alias("_o")
    )
    # A column named twice has its last value; title and source name come last.
    single = named.unionByName(extra).groupBy("file", "pos", "column").agg(F.max(F.struct("_o", "v"))["v"].alias("v"))
    entries = single.groupBy("file", "pos").agg(
        F.map_from_entries(F.collect_list(F.struct("column", "v"))).alias("attrs")
    )
    empty = F.create_map().cast("map<string,string>")
    return ids.join(entries, ["file", "pos"], "left").select(
        "file", "sample_id", F.coalesce("attrs", empty).alias("attrs")
    )


def disagreeing_cells(lines: DataFrame) -> DataFrame:
    """Cells whose own key differs from the key of their line."""
    cells = _characteristic_cells(lines)
    ids = sample_ids(lines)
    return cells.filter(F.col("_key").isNotNull() & (F.col("_key") != F.col("key"))).join(
        ids, ["file", "pos"]
    ).select("file", "sample_id", "key", F.col("_key").alias("own_key"), "value")


def headline(lines: DataFrame) -> DataFrame:
    """(file, platform, title, n_table_lines); a file without a table is listed with zero."""
    meta = _meta(lines).filter(F.col("pos") == 1)
    pick = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("value")))
    table = between_markers(lines, BEGIN, END).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return (
        meta.groupBy("file")
        .agg(
            F.coalesce(pick("!Series_platform_id"), pick("!Sample_platform_id")).alias("platform"),
            pick("!Series_title").alias("title"),
        )
        .join(table, "file", "left")
        .select("file", "platform", "title", F.coalesce("n", F.lit(0)).alias("n_table_lines"))
    )
