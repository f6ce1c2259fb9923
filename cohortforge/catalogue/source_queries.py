"""Registered queries: given tables are landed in a file format and read back through its scan."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.catalogue.base_sql import X1, r
from cohortforge.functions.hashing import population_hash, tagged_sha
from cohortforge.functions.numeric import round_at
from cohortforge.functions.staging import shared_folder, written
from cohortforge.operators import harmonise, inference, provenance
from cohortforge.plans import standins
from cohortforge.sources import platform, repository_json, series_matrix, star, store, tables
from cohortforge.sources.lines import numbered_lines


#: Orders of a manifest page, on average.
PAGE_ROWS = 10_000


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/cohortforge/landing-{label}-{uuid.uuid4().hex}"


def _land_lines(spark: SparkSession, rows: DataFrame, label: str) -> str:
    """Write ``(file, n, line)`` rows as one text file for each value of ``file``, in order."""
    path = _path(spark, label)
    ordered = rows.repartition("file").sortWithinPartitions("file", "n")
    ordered.select("file", "line").write.partitionBy("file").text(path)
    return path


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws("\t", *[F.col(p) if isinstance(p, str) else p for p in parts])


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of every segment by brand and customer."""
    lines = standins.revenue_lines(spark, sf_dir)
    return lines.groupBy(
        F.col("c_mktsegment").alias("cohort_id"), F.col("p_brand").alias("gene"), F.col("o_custkey").alias("sample")
    ).agg(F.count(F.lit(1)).alias("n"))


COUNTS = """counts AS (
  SELECT c_mktsegment AS cohort_id, p_brand AS gene, o_custkey AS sample, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def star_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count files: comment, header, summary rows, versioned ids and a value that is no number."""
    cells = _counts(spark, sf_dir).groupBy("cohort_id", "gene").agg(F.sum("n").alias("n"))
    number = F.regexp_extract("gene", r"(\d+)$", 1).cast("long")
    value = F.when(number == 13, "n/a").otherwise(F.col("n").cast("string"))
    zero = F.lit("0")
    body = cells.select(
        F.col("cohort_id").alias("file"),
        (number + 10).alias("n"),
        _joined(F.concat(F.lit("ENSG"), number.cast("string"), F.lit(".7")), "gene", F.lit("coding"), zero, zero, zero, value, zero, zero).alias("line"),
    )
    head = "\t".join(["gene_id", "gene_name", "gene_type", *star.VALUE_COLUMNS])
    fixed = F.array(
        F.struct(F.lit(0).cast("long").alias("n"), F.lit("# gene-model: none").alias("line")),
        F.struct(F.lit(1).cast("long").alias("n"), F.lit(head).alias("line")),
        F.struct(F.lit(2).cast("long").alias("n"), F.lit("N_unmapped\t\t\t5\t5\t5\t\t\t").alias("line")),
    )
    files = cells.select(F.col("cohort_id").alias("file")).distinct().select("file", F.inline(fixed))
    path = _land_lines(spark, files.unionByName(body), "star")
    return star.read_counts(spark, path).groupBy("gene_id", "gene").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("value").alias("total")
    )


def _series_files(spark: SparkSession, sf_dir: str) -> str:
    """One series matrix per segment: customers as columns, brands as rows."""
    counts = written(_counts(spark, sf_dir), "series-counts")
    people = counts.select("cohort_id", "sample").distinct()
    nation = standins.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), "c_nationkey")
    people = people.join(nation, "sample")
    # The format has one line per row of the matrix, so a line is as wide as its cohort.
    listed = people.groupBy("cohort_id").agg(
        F.array_sort(F.collect_list(F.struct("sample", F.col("c_nationkey").cast("string").alias("nation")))).alias("s")
    )
    tab = lambda column, first: F.concat_ws("\t", F.lit(first), F.array_join(column, "\t"))
    named = lambda text: F.transform("s", text)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    lines = [
        F.lit('!Series_title\t"counts"'),
        tab(named(lambda x: quoted(x["sample"].cast("string"))), series_matrix.ACCESSION),
        tab(named(lambda x: quoted(F.concat(F.lit("customer "), x["sample"].cast("string")))), "!Sample_title"),
        tab(named(lambda x: quoted(F.concat(F.lit("Nation Key: "), x["nation"]))), "!Sample_characteristics_ch1"),
        tab(named(lambda x: quoted(F.concat(F.lit("title: clash "), x["nation"]))), "!Sample_characteristics_ch1"),
        F.lit(series_matrix.BEGIN),
        tab(named(lambda x: quoted(x["sample"].cast("string"))), '"ID_REF"'),
    ]
    head = listed.select(
        F.col("cohort_id").alias("file"), F.posexplode(F.array(*lines)).alias("n", "line")
    ).withColumn("n", F.col("n").cast("long"))
    # Every sample has a cell on each line, so a line is a sorted list and no cell is looked up in it.
    genes = counts.select("cohort_id", "gene").distinct()
    every = people.select("cohort_id", "sample").join(genes, "cohort_id").join(counts, ["cohort_id", "gene", "sample"], "left")
    value = F.coalesce(F.col("n").cast("string"), F.lit("null"))
    cells = every.groupBy("cohort_id", "gene").agg(F.array_sort(F.collect_list(F.struct("sample", value.alias("v")))).alias("s"))
    row = cells.select(
        F.col("cohort_id").alias("file"),
        (F.lit(100) + F.regexp_extract("gene", r"(\d+)$", 1).cast("long")).alias("n"),
        F.concat_ws("\t", quoted(F.col("gene")), F.array_join(F.col("s.v"), "\t")).alias("line"),
    )
    end = listed.select(F.col("cohort_id").alias("file"), F.lit(10_000).cast("long").alias("n"), F.lit(series_matrix.END).alias("line"))
    return _land_lines(spark, head.unionByName(row).unionByName(end), "series")


def series_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression cells of series-matrix files, missing values included."""
    lines = written(series_matrix.read_lines(spark, _series_files(spark, sf_dir)), "series-lines")
    return series_matrix.expression(lines).select("feature", "sample_id", "value")


def series_clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample characteristics, with a key that clashes with the sample title."""
    lines = written(series_matrix.read_lines(spark, _series_files(spark, sf_dir)), "series-lines")
    out = series_matrix.clinical(lines)
    return out.select("sample_id", F.col("attrs")["nation_key"].alias("nation"), F.col("attrs")["title"].alias("title"))


def platform_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five platforms, whose annotation tables list the parts between them; probes by status."""
    number = (F.col("p_partkey") % 5).cast("string").alias("p_platform")
    parts = standins.table(spark, sf_dir, "part").select("p_partkey", number, "p_brand", "p_size")
    symbol = (
        F.when(F.col("p_size") % 17 == 0, "").when(F.col("p_size") % 10 == 0, F.concat("p_brand", F.lit(" /// Brand#1"))).otherwise(F.col("p_brand"))
    )
    body = parts.select(
        F.col("p_platform").alias("file"), (F.col("p_partkey") + 10).alias("n"),
        _joined(F.col("p_partkey").cast("string"), F.lit("text"), symbol, F.lit("more")).alias("line"),
    )
    fixed = F.array(
        F.concat(F.lit("^PLATFORM = "), F.col("p_platform")),
        F.lit("!platform_table_begin"),
        F.lit("ID\tGene title\tGene symbol\tother"),
    )
    head = parts.select("p_platform").distinct().select(
        F.col("p_platform").alias("file"), F.posexplode(fixed).alias("n", "line")
    ).withColumn("n", F.col("n").cast("long"))
    end = parts.select("p_platform").distinct().select(
        F.col("p_platform").alias("file"), F.lit(1 << 60).alias("n"), F.lit("!platform_table_end").alias("line")
    )
    path = _land_lines(spark, head.unionByName(body).unionByName(end), "platform")
    probes = harmonise.probe_map(platform.read_annotation(spark, path), by=["platform"])
    return probes.groupBy("platform", "status").agg(
        F.count(F.lit(1)).alias("n_probes"), F.countDistinct("gene").alias("n_genes")
    )


def probe_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two platforms that give the same probe ids to different genes."""
    cells = standins.probe_expression(spark, sf_dir).withColumn(
        "platform", F.when(F.col("cohort_id") < "F", "one").otherwise("two")
    )
    notes = standins.table(spark, sf_dir, "part").select(
        F.explode(F.array(F.lit("one"), F.lit("two"))).alias("platform"),
        F.col("p_partkey").cast("string").alias("probe"),
        "p_brand",
    ).withColumn("symbol", F.when(F.col("platform") == "two", F.concat("p_brand", F.lit("b"))).otherwise(F.col("p_brand")))
    probes = harmonise.probe_map(notes.unionByName(notes), by=["platform"])
    labelled = harmonise.label_probes(cells, probes)
    return labelled.groupBy("cohort_id", "gene").agg(F.count(F.lit(1)).alias("n_cells"))


def patient_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with aliquots in two cohorts, resolved in each of them."""
    parsed = harmonise.primary_samples(harmonise.parse_barcodes(standins.aliquots(spark, sf_dir).select("barcode").distinct()))
    odd = F.conv(F.substring(F.md5("barcode"), 1, 1), 16, 10).cast("int") % 2
    cells = parsed.withColumn("cohort_id", F.concat(F.lit("c"), odd.cast("string"))).withColumn("value", F.lit(1.0))
    return harmonise.to_patients(cells, "first").select("cohort_id", "patient", "barcode")


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository manifests, a file per page of orders: barcodes and files without a case."""
    orders = standins.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    key = F.lpad((F.col("o_custkey") % 10_000).cast("string"), 4, "0")
    barcode = F.concat(F.lit("TCGA-01-"), key, F.when(F.col("o_orderstatus") == "P", "-11A-").otherwise("-01A-"), F.col("o_orderkey").cast("string"))
    aliquot = F.array(F.struct(barcode.alias("submitter_id")))
    sample = F.struct(
        F.lit("Primary Tumor").alias("sample_type"),
        F.array(F.struct(F.array(F.struct(aliquot.alias("aliquots"))).alias("analytes"))).alias("portions"),
    )
    case = F.struct(F.array(sample).alias("samples"))
    hit = F.struct(
        F.col("o_orderkey").cast("string").alias("file_id"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_name"),
        F.col("o_orderkey").alias("file_size"),
        F.when(F.col("o_orderkey") % 9 != 0, F.array(case)).alias("cases"),
    )
    n_pages = max(1, -(-orders.count() // PAGE_ROWS))
    page = F.pmod(F.xxhash64("o_orderkey"), F.lit(n_pages)).alias("page")
    pages = orders.groupBy(page).agg(F.collect_list(hit).alias("hits"))
    path = _path(spark, "manifest")
    # A file is read as one record, so each page has a folder of its own.
    pages.select("page", F.struct("hits").alias("data")).write.partitionBy("page").json(path)
    read = repository_json.read_manifest(spark, path)
    return read.groupBy("patient", "error_code").agg(F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("n_bytes"))


def endpoint_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An endpoint table as TSV, kept in file order."""
    rows = standins.table(spark, sf_dir, "customer").select(
        F.format_string("TCGA-%02d-%04d", "c_nationkey", F.col("c_custkey") % 10_000).alias("bcr_patient_barcode"),
        F.col("c_mktsegment").alias("type"),
        F.round("c_acctbal").cast("long").cast("string").alias("PFI.time"),
    )
    path = _path(spark, "endpoints") + ".tsv"
    rows.write.csv(path, sep="\t", header=True)
    read = tables.read_endpoint_table(spark, path)
    days = F.col("`PFI.time`").cast("long")
    return read.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("bcr_patient_barcode").alias("n_patients"), F.sum(days).alias("days")
    )


def local_matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A genes-by-samples file of brands by nation of the customer."""
    lines = standins.revenue_lines(spark, sf_dir)
    cells = lines.groupBy("p_brand").pivot("c_nationkey", list(range(25))).count()
    numbers = [F.coalesce(F.col(f"`{i}`").cast("string"), F.lit("")) for i in range(25)]
    body = cells.select(
        F.lit("m").alias("file"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("n"), _joined("p_brand", *numbers).alias("line")
    )
    head = spark.range(1).select(
        F.lit("m").alias("file"), F.lit(-1).cast("long").alias("n"), F.lit("\t".join(["gene", *[f"n{i}" for i in range(25)]])).alias("line")
    )
    path = _land_lines(spark, body.unionByName(head), "matrix")
    return tables.read_local_matrix(spark, path).select("feature", "sample_id", "value").where(F.col("value").isNotNull())


def cohort_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments saved, verified and loaded; then verified again after one of them was changed."""
    matrix = standins.expression(spark, sf_dir)
    people = matrix.select("cohort_id", "sample_id").distinct()
    path = _path(spark, "store")
    store.save_cohorts(matrix, people, path)
    loaded, clinical = store.load_cohorts(spark, path)
    shape = loaded.groupBy("cohort_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.countDistinct("gene").alias("n_genes"), round_at(F.sum("value")).alias("total")
    )
    members = clinical.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("n_samples"))
    before = store.verify_cohorts(spark, path).withColumnRenamed("status", "before")
    extra = matrix.where(F.col("cohort_id") == "BUILDING").orderBy("gene", "sample_id").limit(1)
    extra.select("cohort_id", "gene", "sample_id", "value").write.mode("append").partitionBy("cohort_id").parquet(f"{path}/expression")
    after = written(store.verify_cohorts(spark, path).withColumnRenamed("status", "after"), "store-after")
    shape = shape.where(F.col("cohort_id") != "BUILDING")
    return after.join(before.select("cohort_id"), "cohort_id").join(members, "cohort_id").join(shape, "cohort_id", "left")


def reference_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References appended in two steps; a changed constant stays refused after a later append."""
    from cohortforge.catalogue.survival_queries import _references

    every = written(_references(spark, sf_dir), "references")
    path = _path(spark, "references")
    early = F.col("reference_cohort") < "F"
    store.save_references(every.where(early), path)
    listed = written(store.list_references(spark, path).select("reference_id", "checksum"), "listed")
    # Tampering: one more row of a stored reference.
    every.where(early).limit(1).withColumn("gene", F.lit("planted")).write.mode("append").parquet(f"{path}/rows")
    victim = every.where(early).limit(1).select("reference_id").first()[0]
    store.save_references(every.where(~early), path)
    refused = []
    for row in every.select("reference_id").distinct().collect():
        try:
            store.load_references(spark, path, [row[0]])
        except ValueError:
            refused.append(row[0])
    again = 0
    try:
        store.save_references(every.where(~early), path)
    except ValueError:
        again = 1
    sizes = every.groupBy("reference_id").agg(F.count(F.lit(1)).alias("n_genes"))
    kept = store.list_references(spark, path).join(listed.withColumnRenamed("checksum", "_first"), "reference_id", "left")
    same = F.coalesce(F.col("checksum") == F.col("_first"), F.lit(True)).cast("int")
    return kept.select("reference_id", same.alias("same_checksum")).join(sizes, "reference_id").select(
        "n_genes",
        "same_checksum",
        (F.col("reference_id").isin(refused) == (F.col("reference_id") == victim)).cast("int").alias("refused_if_changed"),
        F.lit(again).alias("second_save_refused"),
    )


def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models saved, checked and loaded; their predictions written as TSV and read back."""
    from cohortforge.catalogue.survival_queries import _model, _requests

    path = _path(spark, "model")
    store.save_models(*_model(spark, sf_dir), path)
    out = inference.predictions(inference.assess(_requests(spark, sf_dir), *store.load_models(spark, path)))
    store.write_predictions(out, f"{path}/predictions", "tsv")
    read = spark.read.csv(f"{path}/predictions", sep="\t", header=True, inferSchema=False)
    return read.groupBy("model_id", "model_version").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("n_samples"),
        F.count_if(F.col("relative_hazard").cast("double") > 0).alias("n_positive"),
    )


def output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a written table by content hash: as recorded, then one gone and one changed."""
    path = _path(spark, "outputs")
    standins.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(4, "o_orderkey").write.csv(path)
    files = written(provenance.file_inventory(spark, path, "*.csv"), "inventory")
    recorded = files.select(F.col("path").alias("name"), "checksum")
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    later = files.where(number != 1).withColumn("checksum", F.when(number == 2, tagged_sha(F.lit("x"))).otherwise(F.col("checksum")))
    status = provenance.verify_outputs(recorded, later)
    lines = numbered_lines(spark, path).groupBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("part")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return status.withColumn("part", F.regexp_extract("name", r"part-(\d+)", 1).cast("int")).join(lines, "part").groupBy("part", "status").agg(
        F.max(F.col("n") > 0).cast("int").alias("has_rows")
    )


def population_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree form of population hashes: equal sets agree, a set less one member differs."""
    parsed = harmonise.parse_barcodes(standins.aliquots(spark, sf_dir))
    cells = written(parsed.select(F.col("patient").alias("cohort_id"), F.col("barcode").alias("sample_id")), "aliquots")
    hashed = population_hash(cells, ["cohort_id"], form="tree").withColumnRenamed("population_hash", "a")
    doubled = population_hash(cells.unionAll(cells), ["cohort_id"], form="tree").select("cohort_id", F.col("population_hash").alias("b"))
    last = cells.groupBy("cohort_id").agg(F.max("sample_id").alias("sample_id"))
    fewer = population_hash(cells.join(last, ["cohort_id", "sample_id"], "left_anti"), ["cohort_id"], form="tree")
    fewer = fewer.select("cohort_id", F.col("population_hash").alias("c"))
    return hashed.join(doubled, "cohort_id").join(fewer, "cohort_id", "left").select(
        "cohort_id", "n_samples", (F.col("a") == F.col("b")).cast("int").alias("same"), F.coalesce(F.col("a") != F.col("c"), F.lit(True)).cast("int").alias("differs")
    )


_SERIES_SQL = f"""WITH {COUNTS},
people AS (SELECT DISTINCT cohort_id, sample FROM counts), genes AS (SELECT DISTINCT cohort_id, gene FROM counts)
SELECT genes.gene AS feature, CAST(people.sample AS VARCHAR) AS sample_id, CAST(n AS DOUBLE) AS value
FROM people JOIN genes USING (cohort_id) LEFT JOIN counts ON counts.cohort_id = people.cohort_id AND counts.gene = genes.gene AND counts.sample = people.sample"""

QUERIES = {
    "star_scan": (
        star_scan,
        f"""WITH {COUNTS}, b AS (SELECT cohort_id, gene, sum(n) AS n FROM counts GROUP BY ALL)
SELECT 'ENSG' || regexp_extract(gene, '([0-9]+)$', 1) AS gene_id, gene, count(*) AS n_files,
  CAST(sum(CASE WHEN gene <> 'Brand#13' THEN n END) AS DOUBLE) AS total FROM b GROUP BY ALL""",
    ),
    "series_expression": (series_expression, _SERIES_SQL),
    "series_clinical": (
        series_clinical,
        f"""WITH {COUNTS} SELECT DISTINCT CAST(sample AS VARCHAR) AS sample_id, CAST(c_nationkey AS VARCHAR) AS nation,
  'customer ' || sample AS title FROM counts JOIN customer ON c_custkey = sample""",
    ),
    "platform_scan": (
        platform_scan,
        """WITH p AS (SELECT CAST(p_partkey % 5 AS VARCHAR) AS platform, p_brand,
  CASE WHEN p_size % 17 = 0 THEN 'unmapped' WHEN p_size % 10 = 0 THEN 'multi' ELSE 'mapped' END AS status FROM part)
SELECT platform, status, count(*) AS n_probes, count(DISTINCT CASE WHEN status = 'mapped' THEN p_brand END) AS n_genes FROM p GROUP BY ALL""",
    ),
    "probe_platforms": (
        probe_platforms,
        """WITH c AS (SELECT DISTINCT c_mktsegment AS cohort_id, l_partkey, o_custkey, p_brand FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT cohort_id, p_brand || CASE WHEN cohort_id < 'F' THEN '' ELSE 'b' END AS gene, count(*) AS n_cells FROM c GROUP BY ALL""",
    ),
    "patient_cohorts": (
        patient_cohorts,
        """WITH a AS (SELECT DISTINCT 'TCGA-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS patient,
  o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'),
b AS (SELECT patient, patient || '-01A-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS barcode FROM a),
c AS (SELECT *, 'c' || (('0x' || md5(barcode)[1:1])::INTEGER % 2) AS cohort_id FROM b)
SELECT cohort_id, patient, min(barcode) AS barcode FROM c GROUP BY ALL""",
    ),
    "manifest_scan": (
        manifest_scan,
        """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN 'TCGA-01-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') END AS patient FROM orders)
SELECT patient, CASE WHEN patient IS NULL THEN 'no_case' END AS error_code, count(*) AS n_files, CAST(sum(o_orderkey) AS BIGINT) AS n_bytes FROM m GROUP BY ALL""",
    ),
    "endpoint_table_scan": (
        endpoint_table_scan,
        """SELECT c_mktsegment AS type, count(*) AS n, count(DISTINCT c_nationkey * 10000 + c_custkey % 10000) AS n_patients,
  CAST(sum(CAST(round(c_acctbal) AS BIGINT)) AS BIGINT) AS days FROM customer GROUP BY ALL""",
    ),
    "local_matrix_scan": (
        local_matrix_scan,
        """SELECT p_brand AS feature, 'n' || c_nationkey AS sample_id, CAST(count(*) AS DOUBLE) AS value FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    ),
    "cohort_store": (
        cohort_store,
        f"""WITH {X1} SELECT cohort_id, CASE WHEN cohort_id = 'BUILDING' THEN 'changed' ELSE 'ok' END AS after, count(DISTINCT sample_id) AS n_samples,
  CASE WHEN cohort_id <> 'BUILDING' THEN count(*) END AS n_cells, CASE WHEN cohort_id <> 'BUILDING' THEN count(DISTINCT gene) END AS n_genes,
  CASE WHEN cohort_id <> 'BUILDING' THEN {r('sum(value)')} END AS total FROM x1 GROUP BY cohort_id""",
    ),
    "reference_store": (
        reference_store,
        f"""WITH {X1}, h AS (SELECT * FROM x1 WHERE ('0x' || md5(sample_id)[1:1])::INTEGER % 2 = 0 AND regexp_extract(gene, '([0-9]+)$', 1)::INT <= 20)
SELECT count(DISTINCT gene) AS n_genes, 1 AS same_checksum, 1 AS refused_if_changed, 1 AS second_save_refused FROM h GROUP BY cohort_id""",
    ),
    "prediction_files": (
        prediction_files,
        """SELECT 'dense20' AS model_id, '1.0.0' AS model_version, count(*) AS n, count(DISTINCT vec_id) AS n_samples, count(*) AS n_positive
FROM embeddings WHERE vec_id % 11 NOT IN (3, 4, 5, 6)""",
    ),
    "output_files": (
        output_files,
        """SELECT CAST(p AS INT) AS part, CASE p WHEN 1 THEN 'missing' WHEN 2 THEN 'changed' ELSE 'ok' END AS status, CAST(max(o_orderkey IS NOT NULL)::INT AS INT) AS has_rows
FROM orders, (SELECT unnest(range(4)) AS p) GROUP BY p""",
    ),
    "population_tree": (
        population_tree,
        """SELECT 'TCGA-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS cohort_id,
  count(DISTINCT o_orderkey) AS n_samples, 1 AS same, 1 AS differs FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    ),
}
