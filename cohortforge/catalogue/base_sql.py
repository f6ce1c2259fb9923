"""DuckDB text of the stand-in relations, shared by the oracle queries."""

from __future__ import annotations

from cohortforge.plans import standins


def r(expr: str) -> str:
    """Rounded double with negative zero folded away."""
    return f"(round({expr}, 6) + 0e0)"


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def signature_values() -> str:
    rows = ", ".join(
        f"({_text(s)}, {_text(g)}, {p}, {'NULL' if c is None else repr(c) + '::DOUBLE'}, {_text(m)})"
        for s, g, p, c, m in standins.SIGNATURE_ROWS
    )
    return (
        f"sig(signature, gene, gene_pos, coefficient, scoring) AS (SELECT * FROM (VALUES {rows}))"
    )


def alias_values() -> str:
    rows = ", ".join(f"({_text(a)}, {_text(b)})" for a, b in standins.ALIAS_ROWS)
    return f"alias(alias, approved) AS (SELECT * FROM (VALUES {rows}))"


LINEAR = """
linear AS (
  SELECT c_mktsegment AS cohort_id, p_brand AS gene, CAST(o_custkey AS VARCHAR) AS sample_id,
         sum(l_extendedprice * (1 - l_discount)) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3)"""

X1 = LINEAR + """,
x1 AS (SELECT cohort_id, gene, sample_id, log2(1 + value) AS value FROM linear)"""

X2 = """
x2 AS (
  SELECT 'emb' AS cohort_id, printf('d%02d', pos) AS gene, pos, CAST(vec_id AS VARCHAR) AS sample_id,
         CAST(value AS DOUBLE) AS value
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS value FROM embeddings))"""

X4 = """
x4 AS (
  SELECT c_mktsegment AS cohort_id, CAST(l_partkey AS VARCHAR) AS feature, l_partkey AS feature_pos,
         CAST(o_custkey AS VARCHAR) AS sample_id,
         log2(1 + sum(l_extendedprice * (1 - l_discount))) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3, 4),
mapped AS (
  SELECT cohort_id, p_brand AS gene, feature_pos, sample_id, value
  FROM x4 JOIN part ON feature_pos = p_partkey
  WHERE p_size % 17 <> 0 AND p_size % 10 <> 0)"""

# The clinical relation already decoded: span in days, last status.
X6 = """
x6 AS (
  SELECT c_mktsegment AS cohort_id, CAST(o_custkey AS VARCHAR) AS sample_id, c_acctbal, c_nationkey,
         span, status
  FROM (SELECT o_custkey,
               date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS span,
               arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status
        FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey),
ep0 AS (
  SELECT *, CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS ev,
         CASE WHEN status = 'F' THEN span * (1.0e0 / 30.4375) END AS t0,
         CASE WHEN status <> 'F' THEN span * (1.0e0 / 30.4375) END AS t1
  FROM x6),
ep1 AS (
  SELECT *, CASE WHEN ev = 0 AND t0 IS NULL THEN t1 ELSE t0 END AS t,
         (ev = 0 AND t0 IS NULL AND t1 IS NOT NULL) AS from_followup FROM ep0),
ep AS (
  SELECT cohort_id, sample_id, c_acctbal, c_nationkey, status, from_followup, ev AS event_uncapped, t AS time_uncapped,
         CASE WHEN t > 60 THEN 60e0 ELSE t END AS time_months, CASE WHEN t > 60 THEN 0 ELSE ev END AS event
  FROM ep1),
aset AS (
  SELECT * FROM ep WHERE time_months IS NOT NULL AND event IN (0, 1) AND time_months > 0)"""

X7 = """
x7 AS (
  SELECT CAST(event_id // 4 AS VARCHAR) AS patient, lpad(CAST(event_id AS VARCHAR), 12, '0') AS record,
         CASE event_type WHEN 'error' THEN 'YES' WHEN 'purchase' THEN 'NO' END AS flag,
         CASE WHEN event_type = 'error' THEN
           CASE WHEN value < 20 THEN 'bad' ELSE printf('%.2f', value * 20) END END AS first_day,
         40 * CAST(json_extract_string(props, '$.k') AS DOUBLE) - 200 AS contact_day
  FROM events)"""

X8 = """
x8 AS (
  SELECT 'TCGA-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-'
           || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS patient,
         CASE WHEN o_orderstatus = 'P' THEN '11' ELSE '01' END AS kind,
         o_orderkey, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey),
aliq AS (
  SELECT patient, kind, value, o_orderkey,
         patient || '-' || kind || 'A-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS barcode FROM x8)"""


def canonical_sql(expr: str, kind: str = "text") -> str:
    """Canonical text of a value, as in ``functions.hashing.canonical_text``."""
    body = f"CAST({expr} AS VARCHAR)"
    if kind == "double":
        size = f"abs({expr})"
        guess = f"greatest(floor(log2({size})), -1074)"
        scaled = f"({size} / pow(2e0, {guess}))"
        power = f"({guess} + CASE WHEN {scaled} >= 2 THEN 1 WHEN {scaled} < 1 THEN -1 ELSE 0 END)"
        digits = f"CAST({size} / pow(2e0, {power}) * 4503599627370496e0 AS BIGINT)"
        sign = f"CASE WHEN {expr} < 0 THEN '-' ELSE '' END"
        body = f"(CASE WHEN {expr} = 0 THEN '0' ELSE {sign} || {digits} || 'p' || CAST({power} AS BIGINT) END)"
    return f"CASE WHEN {expr} IS NULL THEN '-' ELSE length({body}) || ':' || {body} END"


def checksum_sql(columns: list[tuple[str, str]]) -> str:
    """``content_checksum`` of a group over (expression, text or double) columns."""
    row = "md5(" + " || ".join(canonical_sql(e, k) for e, k in columns) + ")"
    half = lambda part: f"(sum(('0x' || {row}[{part}])::UBIGINT) % 18446744073709551616::HUGEINT)::VARCHAR"
    return f"'rows128:' || count(*) || ':' || {half('1:16')} || ':' || {half('17:32')}"
