"""Portable checksums, commit logs, byte-range digests, clinical variants and the clinical join."""

from __future__ import annotations

import hashlib
import json
import math
import os
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortforge.catalogue.base_sql import checksum_sql
from cohortforge.functions.hashing import canonical_text, content_checksum, content_sums, merged_sums, sums_text
from cohortforge.plans import assembly
from cohortforge.sources import byte_ranges, commits, repository_json

DOUBLES = [0.0, -0.0, 1.0, -1.5, 0.1, 1 / 3, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -2.0**-30,
           math.nextafter(8.0, 0), math.nextafter(8.0, 9), 1e22, None]


def exact(value: float | None) -> str:
    if value is None:
        return "-"
    if value == 0:
        return "1:0"
    mantissa, exponent = math.frexp(abs(value))
    body = f"{'-' if value < 0 else ''}{int(mantissa * 2**53)}p{exponent - 1}"
    return f"{len(body)}:{body}"


def test_doubles_in_exact_form(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(DOUBLES)], "i int, v double")
    got = {r[0]: r[1] for r in df.select("i", canonical_text(F.col("v"), "double")).collect()}
    assert [got[i] for i in range(len(DOUBLES))] == [exact(v) for v in DOUBLES]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [r[0] for r in odd.select(canonical_text(F.col("v"), "double")).collect()] == ["3:nan", "3:inf", "4:-inf"]


def test_checksum_is_that_of_the_other_engine(spark):
    cells = [("a", "x", v) for v in DOUBLES] + [("a", "x", 0.1), ("b", None, 2.0), ("b", "", None), ("b", "é\U0001f600:", 3.5)]
    df = spark.createDataFrame(cells, "k string, t string, v double")
    got = {r[0]: r[2] for r in content_checksum(df, ["k"], ["t", "v"]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE c (k VARCHAR, t VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO c VALUES (?, ?, ?)", cells)
    want = dict(con.execute(f"SELECT k, {checksum_sql([('t', 'text'), ('v', 'double')])} FROM c GROUP BY k").fetchall())
    assert got == want
    assert got["a"].startswith(f"rows128:{len(DOUBLES) + 1}:")


def test_sums_add_up_and_count_copies(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    whole = sums_text(content_sums(df, ["k"], ["id"]), ["k"]).collect()
    parts = [content_sums(df.where(f"id % 7 {op} 2"), ["k"], ["id"]) for op in ("<", ">=")]
    assert sorted(sums_text(merged_sums(parts[0].unionByName(parts[1]), ["k"]), ["k"]).collect()) == sorted(whole)
    twice = sums_text(content_sums(df.unionAll(df), ["k"], ["id"]), ["k"]).collect()
    assert not set(r["content_checksum"] for r in twice) & set(r["content_checksum"] for r in whole)


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40).select((F.col("id") % 2).alias("k"), "id", F.lit("x").alias("t")).repartition(3, "id")
    return rows, path


def test_torn_append_stays_invisible(spark, table):
    rows, path = table
    commits.stage(rows.where("id < 5"), path, ["k"])
    first = commits.append(rows.where("id >= 10 AND id < 20"), path, ["k"])
    assert {r.id for r in commits.committed(spark, path).collect()} == set(range(10, 20))
    # Files of a batch without their record: a writer that died between data and sums.
    rows.where("id >= 30").write.parquet(f"{path}/data/batch=bdead")
    rows.where("id >= 30").write.mode("append").parquet(f"{path}/data/batch={first}")
    later = commits.stage(rows.where("id >= 20 AND id < 30"), path, ["k"])
    assert commits.committed(spark, path).count() == 10
    commits.commit(spark, path, later)
    commits.commit(spark, path, later)
    seen = commits.committed(spark, path)
    assert sorted(r.id for r in seen.collect()) == list(range(10, 30))
    assert seen.columns == rows.columns
    want = content_checksum(rows.where("id >= 10 AND id < 30"), ["k"], rows.columns).collect()
    assert sorted(commits.checksums(spark, path, ["k"]).collect()) == sorted(want)


def test_verify_reads_changed_files_only(spark, table, tmp_path):
    rows, path = table
    batch = commits.append(rows, path, ["k"])
    statuses = lambda **how: {r.file.split("/")[1]: r.status for r in commits.verify(spark, path, ["k"], **how).collect()}
    names = sorted(statuses())
    assert len(names) == 3 and set(statuses().values()) == {"ok"} == set(statuses(every_file=True).values())
    folder = f"{path}/data/batch={batch}"
    os.utime(f"{folder}/{names[0]}", (1, 1))
    other = str(tmp_path / "other")
    rows.coalesce(1).withColumn("t", F.lit("y")).write.parquet(other)
    part = next(f for f in os.listdir(other) if f.endswith(".parquet"))
    for crc in (f"{folder}/.{names[1]}.crc", f"{folder}/.{names[0]}.crc"):
        if os.path.exists(crc):
            os.rename(crc, crc + ".old")
    with open(f"{other}/{part}", "rb") as source, open(f"{folder}/{names[1]}", "wb") as target:
        target.write(source.read())
    os.rename(f"{folder}/{names[2]}", f"{folder}/{names[2]}.gone")
    assert statuses() == {names[0]: "ok", names[1]: "changed", names[2]: "missing"}


def test_empty_append(spark, table):
    rows, path = table
    commits.append(rows.limit(0), path, ["k"])
    assert commits.committed(spark, path).count() == 0
    assert commits.checksums(spark, path, ["k"]).count() == 0


def digest_of(content: bytes, step: int) -> str:
    leaves = [hashlib.sha256(content[i : i + step]).hexdigest() for i in range(0, max(len(content), 1), step)]
    return f"sha256-ranges-{step}:" + hashlib.sha256("\n".join(leaves).encode()).hexdigest()


def test_range_digests(spark, tmp_path):
    contents = {"a.bin": bytes(range(256)) * 40, "empty.bin": b"", "sub/exact.bin": b"z" * 2000, "other.txt": b"no"}
    (tmp_path / "sub").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: r for r in byte_ranges.range_inventory(spark, str(tmp_path), "*.bin", 1000).collect()}
    assert {n: r["checksum"] for n, r in got.items()} == {n.split("/")[-1]: digest_of(c, 1000) for n, c in contents.items() if n.endswith("bin")}
    assert {n: r["n_ranges"] for n, r in got.items()} == {"a.bin": 11, "empty.bin": 1, "exact.bin": 2}
    assert got["a.bin"]["n_bytes"] == 10240


def test_file_over_two_gigabytes(spark, tmp_path):
    path = tmp_path / "large.bin"
    step = 64 << 20
    with open(path, "wb") as f:  # sparse: zeros take no disk
        f.truncate((2 << 30) + 5000)
        f.seek((2 << 30) + 100)
        f.write(struct.pack("<q", 12345))
    row = byte_ranges.range_inventory(spark, str(tmp_path), "large.bin", step).first()
    zeros = hashlib.sha256(bytes(step)).hexdigest()
    tail = bytearray(5000)
    tail[100:108] = struct.pack("<q", 12345)
    leaves = [zeros] * 32 + [hashlib.sha256(tail).hexdigest()]
    assert (row["n_ranges"], row["n_bytes"]) == (33, (2 << 30) + 5000)
    assert row["checksum"].split(":")[1] == hashlib.sha256("\n".join(leaves).encode()).hexdigest()


def test_clinical_variants(spark, tmp_path):
    cases = [
        {"submitter_id": "P1", "demographic": {"vital_status": "Dead", "days_to_death": "12", "age_at_index": {"years": 3}}, "diagnoses": []},
        {"submitter_id": "P1", "demographic": {"vital_status": "Alive"}},
        {"demographic": None},
        {"submitter_id": "P2", "demographic": "gone", "diagnoses": [{"ajcc_pathologic_t": "T2", "stage": 1}, {"ajcc_pathologic_t": "T3"}]},
        7,
    ]
    (tmp_path / "c.json").write_text(json.dumps({"hits": cases}))
    read = {r["patient"]: r for r in repository_json.read_clinical(spark, str(tmp_path / "c.json")).collect()}
    assert set(read) == {"P1", "P2", None}
    assert (read["P1"]["vital_status"], read["P1"]["days_to_death"], read["P1"]["age_at_index"]) == ("Dead", 12.0, None)
    assert (read["P2"]["ajcc_t"], read["P2"]["vital_status"]) == ("T2", None)
    found = repository_json.clinical_problems(spark, str(tmp_path / "c.json"))
    got = {(r["pos"], r["field"], r["problem"], r["found"]) for r in found.collect()}
    assert found.count() == len(got)
    assert got == {
        (0, "age_at_index", "mistyped", '{"years":3}'),
        (1, "submitter_id", "duplicate_patient", "P1"),
        (2, "submitter_id", "missing_patient", None),
        (3, "demographic", "mistyped", '"gone"'),
        (3, "diagnoses[0].stage", "unknown_field", "1"),
        (4, "case", "mistyped", "7"),
        (4, "submitter_id", "missing_patient", None),
    }


def test_no_overlap_is_an_error(spark):
    cells = spark.createDataFrame([("c", "g", "p1", 1.0)], "cohort_id string, gene string, sample_id string, value double")
    clinical = spark.createDataFrame([("p1",), ("p1",)], "patient string")
    assert assembly.join_clinical(cells, clinical).count() == 1
    with pytest.raises(ValueError, match="no patient"):
        assembly.join_clinical(cells, clinical.where("patient = 'p2'"))
