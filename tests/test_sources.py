"""File scans over small files written by the tests."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from cohortforge.operators import adjudication, harmonise
from cohortforge.sources import clinical_xml, platform, repository_json, series_matrix, star, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture
def series_file(tmp_path):
    text = "\n".join(
        [
            '!Series_title\t"demo"',
            '!Series_platform_id\t"GPL1"',
            '!Sample_title\t"a"\t"b"\t"c"',
            '!Sample_geo_accession\t"S1"\t"S2"\t"S3"',
            '!Sample_characteristics_ch1\t"bcr status: 1"\t"bcr status: 0"\t"other: 7"',
            '!Sample_characteristics_ch1\t"bcr free time: 12"\t"bcr free time: 14"\t"bcr free time: 16"',
            '!Sample_characteristics_ch1\t"bcr status: x"\t"bcr status: y"\t"bcr status: z"',
            '!Sample_characteristics_ch1\t"short: 1"\t"short: 2"',
            '!Sample_characteristics_ch1\t"title: k"\t"title: l"\t"title: m"',
            "!series_matrix_table_begin",
            '"ID_REF"\t"X1"\t"X2"\t"X3"',
            '"p1"\t1.5\t2.5\t3.5',
            '"p2"\tnull\t5\t6',
            "!series_matrix_table_end",
        ]
    )
    path = tmp_path / "demo_series_matrix.txt.gz"
    with gzip.open(path, "wt") as stream:
        stream.write(text + "\n")
    return str(path)


def test_series_matrix(spark, series_file):
    lines = series_matrix.read_lines(spark, series_file)
    cells = series_matrix.expression(lines)
    assert rows(cells.select("feature", "sample_id", "value"), "feature", "sample_id") == [
        ("p1", "S1", 1.5), ("p1", "S2", 2.5), ("p1", "S3", 3.5),
        ("p2", "S1", None), ("p2", "S2", 5.0), ("p2", "S3", 6.0),
    ]
    attrs = {r["sample_id"]: r["attrs"] for r in series_matrix.clinical(lines).collect()}
    assert attrs["S3"] == {
        "bcr_status": "7", "bcr_free_time": "16", "bcr_status_2": "z", "title": "c",
    }
    assert rows(series_matrix.disagreeing_cells(lines).select("sample_id", "own_key"), "sample_id") == [("S3", "other")]
    head = series_matrix.headline(lines).first()
    assert (head["platform"], head["title"], head["n_table_lines"]) == ("GPL1", "demo", 3)


def test_line_numbers_keep_file_order_across_splits(spark, tmp_path):
    from cohortforge.sources.lines import numbered_lines

    for name, n in (("a.txt", 4000), ("b.txt", 900)):
        (tmp_path / name).write_text("".join(f"{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        got = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, n in (("a.txt", 4000), ("b.txt", 900)):
        mine = sorted((r["line_no"], int(r["line"])) for r in got if r["file"].endswith(name))
        assert [v for _, v in mine] == list(range(n))
        assert len({k for k, _ in mine}) == n


def test_platform_annotation_and_probe_map(spark, tmp_path):
    (tmp_path / "gpl.txt").write_text(
        "^PLATFORM = GPL9\n#ID = probe\n!platform_table_begin\nID\tGene title\tGene symbol\n"
        "p1\tx\tALDOA\np2\tx\tALDOA\np3\tx\tBNIP3 /// BNIP3P1\np4\tx\t\np5\tx\t---\n!platform_table_end\n"
    )
    notes = platform.read_annotation(spark, str(tmp_path / "gpl.txt"))
    assert {r["platform"] for r in notes.collect()} == {"GPL9"}
    got = rows(harmonise.probe_map(notes).select("probe", "gene", "status"), "probe")
    assert got == [
        ("p1", "ALDOA", "mapped"), ("p2", "ALDOA", "mapped"), ("p3", None, "multi"),
        ("p4", None, "unmapped"), ("p5", None, "unmapped"),
    ]
    first = harmonise.probe_map(notes, multi="first").filter(F.col("probe") == "p3").first()
    assert first["gene"] == "BNIP3"
    assert platform.unreadable_files(spark, str(tmp_path / "gpl.txt")).count() == 0


def test_star_counts(spark, tmp_path):
    head = "gene_id\tgene_name\tgene_type\tunstranded\tstranded_first\tstranded_second\ttpm_unstranded\tfpkm_unstranded\tfpkm_uq_unstranded\n"
    body = "N_unmapped\t\t\t9\t9\t9\t\t\t\nENSG1.17\tALDOA\tpc\t5\t2\t3\t120.5\t1\t1\nENSG2.2\tALDOA\tpc\t1\t1\t0\tbad\t1\t1\n"
    for name in ("a.tsv", "b.tsv"):
        (tmp_path / name).write_text("# gene-model\n" + head + body)
    out = star.read_counts(spark, str(tmp_path))
    assert rows(out, "file_name", "gene_id") == [
        ("a.tsv", "ENSG1", "ALDOA", 120.5), ("a.tsv", "ENSG2", "ALDOA", None),
        ("b.tsv", "ENSG1", "ALDOA", 120.5), ("b.tsv", "ENSG2", "ALDOA", None),
    ]
    with pytest.raises(ValueError):
        star.read_counts(spark, str(tmp_path), "nope")


def test_manifest_and_clinical_json(spark, tmp_path):
    def hit(i, barcodes, cases=True):
        analytes = [{"aliquots": [{"submitter_id": b}, {"submitter_id": "ignored"}]} for b in barcodes]
        return {
            "file_id": f"f{i}", "file_name": f"{i}.tsv", "file_size": 3, "md5sum": "m",
            "analysis": {"workflow_type": "w"},
            "cases": [{"samples": [{"sample_type": "Primary", "portions": [{"analytes": analytes}]}]}] if cases else [],
        }

    hits = [hit(1, ["TCGA-AA-0001-01A", "TCGA-AA-0001-01B"]), hit(2, []), hit(3, ["x"]), hit(4, [], False)]
    (tmp_path / "m.json").write_text(json.dumps({"data": {"hits": hits}}))
    got = rows(repository_json.read_manifest(spark, str(tmp_path / "m.json")).select("file_id", "barcode", "patient", "error_code"), "file_id")
    assert got == [
        ("f1", "TCGA-AA-0001-01B", "TCGA-AA-0001", None), ("f2", None, None, "no_barcode"),
        ("f3", "x", None, "malformed_barcode"), ("f4", None, None, "no_case"),
    ]
    cases = [
        {"submitter_id": "P1", "demographic": {"vital_status": "Dead", "days_to_death": 10}, "diagnoses": [{"days_to_last_follow_up": 5}, {"days_to_last_follow_up": 9}]},
        {"submitter_id": "P1", "demographic": {"vital_status": "Alive"}},
        {"submitter_id": "P2"},
    ]
    (tmp_path / "c.json").write_text(json.dumps({"hits": cases}))
    got = rows(repository_json.read_clinical(spark, str(tmp_path / "c.json")).select("patient", "vital_status", "days_to_last_follow_up"), "patient")
    assert got == [("P1", "Dead", 5.0), ("P2", None, None)]


def test_clinical_xml(spark, tmp_path):
    def doc(pid, follow="", extra=""):
        return f"""<?xml version="1.0"?><a:bcr xmlns:a="urn:a" xmlns:b="urn:b">{extra}<a:patient>
<b:bcr_patient_barcode>{pid}</b:bcr_patient_barcode>
<b:biochemical_recurrence procurement_status="Completed">NO</b:biochemical_recurrence>
<b:days_to_first_biochemical_recurrence procurement_status="Not Applicable"/>
<b:days_to_last_followup>300</b:days_to_last_followup>
<b:follow_ups>{follow}</b:follow_ups></a:patient></a:bcr>"""

    follow = """<b:follow_up><b:bcr_followup_barcode>F1</b:bcr_followup_barcode>
<b:biochemical_recurrence>YES</b:biochemical_recurrence>
<b:days_to_first_biochemical_recurrence>120</b:days_to_first_biochemical_recurrence>
<b:days_to_last_followup>400</b:days_to_last_followup></b:follow_up>"""
    good = tmp_path / "good"
    good.mkdir()
    (good / "p1.xml").write_text(doc("P1", follow))
    (good / "p2.xml").write_text(doc("P2"))
    records = clinical_xml.read_records(spark, str(good))
    got = rows(records.select("patient", "record", "biochemical_recurrence", "days_to_first_biochemical_recurrence"), "patient", "record")
    assert got == [
        ("P1", "F1", ["YES"], ["120"]), ("P1", "enrollment", ["NO"], [None]), ("P2", "enrollment", ["NO"], [None]),
    ]
    assert records.filter("patient = 'P2'").first()["biochemical_recurrence__status"] == ["Completed"]
    verdicts = rows(adjudication.adjudicate(records).select("patient", "event_uncapped", "time_days"), "patient")
    assert verdicts == [("P1", 1, 120.0), ("P2", 0, 300.0)]
    assert adjudication.record_problems(records).count() == 0
    assert clinical_xml.file_problems(spark, str(good)).count() == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.xml").write_text(doc("P1"))
    (bad / "b.xml").write_text(doc("P1"))
    (bad / "c.xml").write_text('<!DOCTYPE x>' + doc("P3").split("?>", 1)[1])
    (bad / "d.xml").write_text(doc("P4").replace("days_to_last_followup", "other"))
    problems = sorted((r["source"][-5:], r["problem"]) for r in clinical_xml.file_problems(spark, str(bad)).collect())
    assert problems == [
        ("a.xml", "duplicate_patient"), ("b.xml", "duplicate_patient"),
        ("c.xml", "declaration"), ("d.xml", "missing_required_field"),
    ]


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "cdr.tsv").write_text("bcr_patient_barcode\ttype\tPFI\tPFI.time\nP1\tPRAD\t1\t400\nP1\tPRAD\t0\t9\nP2\tprad\t1\t4000\nP3\tLGG\t1\t5\n")
    from cohortforge.operators import endpoints

    cdr = tables.read_endpoint_table(spark, str(tmp_path / "cdr.tsv"))
    got = rows(endpoints.cdr_endpoint(cdr, "TCGA-PRAD").select("sample_id", "event", F.round("time_months", 3)), "sample_id")
    assert got == [("P1", 1, round(400 / 30.4375, 3)), ("P2", 0, 60.0)]
    with pytest.raises(ValueError):
        endpoints.check_cdr_endpoint("TCGA-PRAD", "OS")
    (tmp_path / "expr.tsv").write_text("gene\ts1\ts2\nG2\t1\t2\nG1\tx\t4\n")
    cells = tables.read_local_matrix(spark, str(tmp_path / "expr.tsv"))
    assert rows(cells.select("feature", "sample_id", "value"), "feature_pos", "sample_id") == [
        ("G2", "s1", 1.0), ("G2", "s2", 2.0), ("G1", "s1", None), ("G1", "s2", 4.0),
    ]
    (tmp_path / "clin.tsv").write_text("id\ttime\tstatus\ns1\t12 months\tyes\ns2\t\tno\n")
    attrs = {r["sample_id"]: r["attrs"] for r in tables.read_local_clinical(spark, str(tmp_path / "clin.tsv")).collect()}
    assert attrs == {"s1": {"time": "12 months", "status": "yes"}, "s2": {"time": None, "status": "no"}}
    (tmp_path / "alias.tsv").write_text("# note\nalias\tapproved\tkind\tnote\nCyr61\tCCN1\tp\t\nX\tB\tp\t\nx\tA\tp\t\nX\tB\tp\t\n")
    assert rows(tables.read_aliases(spark, str(tmp_path / "alias.tsv")), "alias") == [("CYR61", ["CCN1"]), ("X", ["B", "A"])]
    (tmp_path / "auth.tsv").write_text("symbol\tstatus\tprev_symbol\talias_symbol\nAK4\tApproved\tAK3L1|ak4\tAK3\nOLD\tWithdrawn\tZ\t\nB\tApproved\t\tAK3\n")
    authority = tables.build_authority(spark, str(tmp_path / "auth.tsv"))
    assert rows(authority, "alias", "approved") == [("AK3", "AK4", "alias"), ("AK3", "B", "alias"), ("AK3L1", "AK4", "previous")]
    assert rows(tables.ambiguous_aliases(authority), "alias") == [("AK3", 2)]


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ("gene\n", "no_sample_columns"),
        ("gene\ta\t\nG1\t1\t2\n", "blank_sample"),
        ("gene\ta\ta\nG1\t1\t2\n", "duplicate_sample"),
        ("sample\ta\tb\nG1\t1\t2\n", "samples_as_rows"),
        ("gene\tG1\tb\nx\t1\t2\n", "samples_as_rows"),
        ("gene\ta\tb\n\t1\t2\n", "blank_gene"),
    ],
)
def test_strict_matrix_refusals(spark, tmp_path, text, problem):
    path = tmp_path / "m.tsv"
    path.write_text(text)
    got = [r["problem"] for r in tables.strict_matrix_problems(spark, str(path), ["G1"]).collect()]
    assert got == [problem]
    with pytest.raises(ValueError):
        tables.read_strict_matrix(spark, str(path), ["G1"])


def test_strict_matrix_accepts(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("gene,a,b\nG1,1,NA\nG2,3,4\n")
    assert rows(tables.read_strict_matrix(spark, str(path), ["G1"]), "gene", "sample_id") == [
        ("a", "G1", 1.0), ("b", "G1", None), ("a", "G2", 3.0), ("b", "G2", 4.0),
    ]
