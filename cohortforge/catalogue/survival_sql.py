"""DuckDB text of the survival oracles: fold plans, concordance and Newton rounds."""

from __future__ import annotations

from cohortforge.catalogue.base_sql import X1, X6

SEED = 902001
ROUNDS = 9

SCORES = f"""{X1}, {X6},
kept AS (SELECT x1.* FROM x1 JOIN aset USING (cohort_id, sample_id))"""


def z_scores(by: str, source: str, genes: str, out: str) -> str:
    """Rowmean score CTEs ``out`` over ``source`` cells of the listed genes."""
    return f"""
{out}_st AS (SELECT {by}, gene, avg(value) AS m, stddev_samp(value) AS s FROM {source} WHERE gene IN ({genes}) GROUP BY {by}, gene),
{out} AS (SELECT {by}, sample_id, avg(CASE WHEN s <> 0 THEN (value - m) / s END) AS score
          FROM {source} JOIN {out}_st USING ({by}, gene) GROUP BY {by}, sample_id)"""


def brands(n: int) -> str:
    return ", ".join(f"'Brand#{i}'" for i in range(1, n + 1))


def tested(outer: int, repeats: int, source: str = "pop") -> str:
    """CTE ``tested``: the fold that holds each sample out, per repeat."""
    return f"""
tested AS (SELECT repeat, sample_id, event, time_months,
                  CAST((row_number() OVER (PARTITION BY repeat, event ORDER BY md5(concat_ws('|', '{SEED}', repeat, sample_id)), sample_id) - 1) % {outer} + 1 AS INTEGER) AS fold
           FROM {source}, (SELECT CAST(unnest(range(1, {repeats + 1})) AS INTEGER) AS repeat))"""


def roles(outer: int, inner: int) -> str:
    """CTE ``roles``: train and test rows of every fold, training rows with an inner fold."""
    return f"""
tr AS (SELECT t.repeat, f.fold, t.sample_id, t.event, t.time_months
       FROM tested t, (SELECT CAST(unnest(range(1, {outer + 1})) AS INTEGER) AS fold) f WHERE f.fold <> t.fold),
roles AS (
  SELECT repeat, fold, CAST((row_number() OVER (PARTITION BY repeat, fold, event ORDER BY md5(concat_ws('|', '{SEED}', repeat, fold, sample_id)), sample_id) - 1) % {inner} + 1 AS INTEGER) AS inner_fold,
         sample_id, event, time_months, 'train' AS role FROM tr
  UNION ALL SELECT repeat, fold, 0, sample_id, event, time_months, 'test' FROM tested)"""


def concordance(source: str, keys: str, out: str = "conc") -> str:
    """CTE ``out`` with comparable pairs and C of (keys, time_months, event, risk) rows."""
    on = " AND ".join(f"i.{k.strip()} = j.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"i.{k.strip()}" for k in keys.split(","))
    return f"""
{out} AS (
  SELECT {ks}, count(*) AS comparable_pairs,
         sum(CASE WHEN i.risk - j.risk > 1e-8 THEN 1e0 WHEN abs(i.risk - j.risk) <= 1e-8 THEN 0.5e0 ELSE 0e0 END) / count(*) AS c_index
  FROM {source} i JOIN {source} j ON {on} AND i.event = 1
   AND (i.time_months < j.time_months OR (i.time_months = j.time_months AND j.event = 0))
  GROUP BY {ks})"""


def newton(source: str, keys: str, prefix: str = "cx", rounds: int = ROUNDS) -> str:
    """CTE ``prefix_fit``: univariable Efron fits of (keys, time_months, event, z) rows."""
    parts = [f"{prefix}_b0 AS MATERIALIZED (SELECT DISTINCT {keys}, 0e0 AS b, 1e0 AS info FROM {source})"]
    for i in range(rounds):
        parts.append(f"""
{prefix}_w{i} AS MATERIALIZED (
  SELECT {keys}, time_months AS t, sum(event) AS d, sum(w) AS s0, sum(w * z) AS s1, sum(w * z * z) AS s2,
         sum(w * event) AS e0, sum(w * z * event) AS e1, sum(w * z * z * event) AS e2, sum(z * event) AS ez
  FROM (SELECT *, exp(b * z) AS w FROM {source} JOIN {prefix}_b{i} USING ({keys})) GROUP BY {keys}, time_months),
{prefix}_q{i} AS MATERIALIZED (
  SELECT {keys}, t, d, e0, e1, e2, ez,
         sum(s0) OVER win AS s0, sum(s1) OVER win AS s1, sum(s2) OVER win AS s2
  FROM {prefix}_w{i} WINDOW win AS (PARTITION BY {keys} ORDER BY t DESC ROWS UNBOUNDED PRECEDING)),
{prefix}_x{i} AS (SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM {prefix}_q{i} WHERE d > 0),
{prefix}_g{i} AS (
  SELECT {keys}, sum(CASE WHEN l = 0 THEN ez ELSE 0 END) - sum((s1 - l / d * e1) / (s0 - l / d * e0)) AS score,
         sum((s2 - l / d * e2) / (s0 - l / d * e0) - ((s1 - l / d * e1) / (s0 - l / d * e0)) ** 2) AS info
  FROM {prefix}_x{i} GROUP BY {keys}),
{prefix}_b{i + 1} AS MATERIALIZED (
  SELECT {keys}, b + score / g.info AS b, g.info FROM {prefix}_b{i} JOIN {prefix}_g{i} g USING ({keys}))""")
    parts.append(f"{prefix}_fit AS (SELECT {keys}, b AS coefficient, 1 / sqrt(info) AS se FROM {prefix}_b{rounds})")
    return ",\n".join(parts)
