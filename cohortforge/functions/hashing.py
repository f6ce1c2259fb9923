"""Content hashes computed as Spark aggregates.

Hashes that must reproduce a published value (population, signature, text
table) follow that value's byte recipe.  Checksums of our own tables are
order-independent sums, so no row order is ever needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets of the tree form of a population hash.
POPULATION_BUCKETS = 4096


def tagged_sha(col: Column) -> Column:
    """``sha256:<hex>`` of a string or binary column."""
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


def population_hash(
    samples: DataFrame,
    by: list[str],
    sample: str = "sample_id",
    form: str = "list",
    out: str = "population_hash",
) -> DataFrame:
    """Hash of the set of sample ids per group, in the form its caller names.

    ``list``: SHA-256 of the newline-joined sorted ids, as published; the ids of a
    group are then one value.  ``tree``: ids are spread over hash buckets, each bucket
    is hashed on its own, and the group hash covers the ordered bucket digests, tagged
    ``sha256-tree:``; for populations too large for one value.  The form never
    depends on the size, so an identity keeps its scheme as samples join.
    """
    distinct = samples.select(*by, F.col(sample).cast("string").alias("_id")).distinct()
    if form == "list":
        return (
            distinct.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_samples"), F.array_sort(F.collect_list("_id")).alias("_ids"))
            .select(*by, "n_samples", tagged_sha(F.array_join("_ids", "\n")).alias(out))
        )
    if form != "tree":
        raise ValueError(f"unknown form {form!r}, choose list or tree")
    bucket = F.pmod(F.xxhash64("_id"), F.lit(POPULATION_BUCKETS)).cast("int")
    parts = (
        distinct.groupBy(*by, bucket.alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_id")), "\n"), 256).alias("_digest"))
        .groupBy(*by)
        .agg(F.sum("_n").alias("n_samples"), F.array_sort(F.collect_list(F.struct("_bucket", "_digest"))).alias("_tree"))
    )
    digest = F.sha2(F.array_join(F.col("_tree._digest"), "\n"), 256)
    return parts.select(*by, "n_samples", F.concat(F.lit("sha256-tree:"), digest).alias(out))


def signature_checksum(signatures: DataFrame, by: str = "signature") -> DataFrame:
    """Checksum of a gene list and, where present, its coefficients.

    Sorted genes, then sorted ``gene=coefficient`` lines with nine decimals,
    newline-joined.  A group is one signature, bounded by the gene universe.
    """
    gene = F.trim("gene")
    line = F.when(
        F.col("coefficient").isNotNull(),
        F.struct(gene.alias("g"), F.format_string("%s=%.9f", gene, F.col("coefficient")).alias("l")),
    )
    return (
        signatures.groupBy(by)
        .agg(
            F.array_sort(F.collect_list(gene)).alias("_genes"),
            F.array_sort(F.collect_list(line)).alias("_coef"),
        )
        .select(
            by,
            tagged_sha(
                F.array_join(F.concat("_genes", F.col("_coef.l")), "\n")
            ).alias("checksum"),
        )
    )


def canonical_text(value: Column, kind: str) -> Column:
    """A value as text that any engine can render alike: ``-`` for null, else its length, a colon and itself.

    A double is its exact binary form, signed 53-bit integer and power of two, so no
    engine's way of printing fractions matters; both zeros are ``0``. Other types are
    cast to string: meant for strings, integers, decimals, booleans and dates.
    """
    if kind not in ("double", "float"):
        body = value.cast("string")
    else:
        number = value.cast("double")
        size = F.abs(number)
        # The logarithm may be off by one next to a power of two; the division is exact and tells.
        guess = F.greatest(F.floor(F.log2(size)), F.lit(-1074))
        scaled = size / F.pow(F.lit(2.0), guess)
        power = guess + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
        digits = (size / F.pow(F.lit(2.0), power) * float(1 << 52)).cast("long")
        sign = F.when(number < 0, "-").otherwise("")
        body = (
            F.when(F.isnan(number), "nan")
            .when(size == float("inf"), F.concat(sign, F.lit("inf")))
            .when(size == 0, "0")
            .otherwise(F.concat(sign, digits.cast("string"), F.lit("p"), power.cast("string")))
        )
    return F.when(value.isNull(), "-").otherwise(F.concat(F.length(body).cast("string"), F.lit(":"), body))


def _wrapped(total: Column) -> Column:
    """A sum of digest halves modulo 2**64."""
    return (total % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(28,0)")


def content_sums(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows and both halves of the sum of row digests per group.

    Sums of disjoint parts add up to those of their union (``merged_sums``), whatever the
    order; every copy of a repeated row counts.
    """
    kinds = dict(df.select(*columns).dtypes)
    row = F.md5(F.concat(*[canonical_text(F.col(c), kinds[c]) for c in columns]))
    half = lambda start: F.conv(F.substring(row, start, 16), 16, 10).cast("decimal(28,0)")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _wrapped(F.sum(half(1))).alias("high"),
        _wrapped(F.sum(half(17))).alias("low"),
    )


def merged_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """Sums of parts as sums of the whole."""
    return sums.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"),
        _wrapped(F.sum("high")).alias("high"),
        _wrapped(F.sum("low")).alias("low"),
    )


def sums_text(sums: DataFrame, by: list[str]) -> DataFrame:
    """Sums as ``rows128:<rows>:<high>:<low>`` in ``content_checksum``."""
    text = F.concat_ws(":", F.lit("rows128"), *[F.col(c).cast("string") for c in ("n_rows", "high", "low")])
    return sums.select(*by, "n_rows", text.alias("content_checksum"))


def content_checksum(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Order-independent content checksum per group, fully map-side combinable and the same in any engine."""
    return sums_text(content_sums(df, by, columns), by)


def rows_checksum(df: DataFrame, by: list[str], ordinal: str, columns: list[str], out: str) -> DataFrame:
    """SHA-256 over the ordered rows of a small artefact (a scaler, a model).

    Doubles are rounded to ten decimals first; a group is one artefact, whose
    length is the number of genes it covers.
    """
    rendered = F.concat_ws(
        "|",
        *[
            F.coalesce(
                F.format_string("%.10f", F.col(c)) if t == "double" else F.col(c).cast("string"),
                F.lit("null"),
            )
            for c, t in df.select(*columns).dtypes
        ],
    )
    return (
        df.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal), rendered.alias("_r")))).alias("_rows"))
        .select(*by, tagged_sha(F.array_join(F.col("_rows._r"), "\n")).alias(out))
    )


def text_checksum(lines: DataFrame, by: list[str], ordinal: str = "line_no", line: str = "line") -> DataFrame:
    """Checksum of a text table, ignoring comment and blank lines."""
    body = lines.filter((F.trim(line) != "") & ~F.col(line).startswith("#"))
    return (
        body.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal), F.rtrim(F.col(line)).alias("_l")))).alias("_rows"))
        .select(*by, tagged_sha(F.array_join(F.col("_rows._l"), "\n")).alias("checksum"))
    )
