"""The jobs as registered queries, with their SQL: each runs twice into one new folder under spark.checkpoint.dir."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from circlet.sources.staging import shared_root
from jobs import clip_panel, sample_amplification


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder, which stays."""
    return f"{shared_root(spark).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


def _config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def job1_clip_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, config = _folder(spark, "clip-panel"), _config(clip_panel.CONFIG)
    for _ in range(2):
        out = clip_panel.run(spark, f"{sf_dir}/documents.parquet", at, config)
    return out


JOB1_SQL = r"""
WITH lines AS (
  SELECT nullif(source, '') AS sample, row, unnest(string_split(text, chr(10))) AS line FROM (SELECT *, row_number() OVER () AS row FROM documents) d),
pieces AS (
  SELECT sample, row, unnest(regexp_extract_all(translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '(?s).{1,60}')) AS piece FROM lines),
turned AS (
  SELECT sample, row, CASE WHEN regexp_full_match(piece, '[ACGTN]+') THEN least(piece, reverse(translate(piece, 'ACGT', 'TGCA'))) ELSE piece END AS sequence
  FROM pieces WHERE length(piece) >= 20),
own AS (
  SELECT sample, sequence, count(*) AS n_rows, cast(sum(k) AS bigint) AS n_pieces
  FROM (SELECT sample, sequence, row, count(*) AS k FROM turned GROUP BY ALL) r GROUP BY ALL)
SELECT * FROM (
  SELECT sequence, n_rows, n_pieces, count(*) OVER (PARTITION BY sequence) AS samples, cast(sum(n_rows) OVER (PARTITION BY sequence) AS bigint) AS all_rows, sample FROM own) s
WHERE all_rows >= 5
"""


def job2_sample_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, config = _folder(spark, "sample-amplification"), _config(sample_amplification.CONFIG)
    for _ in range(2):
        out = sample_amplification.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet", at, config)
    return out.selectExpr("sample", "chrom", "start", "stop", "bins", "round(cn, 6) as cn", "genes")


JOB2_SQL = """
WITH counts AS (
  SELECT 's' || cast(l_partkey % 5 AS varchar) AS sample, 'chr' || cast(l_suppkey % 24 + 1 AS varchar) AS chrom,
    cast(floor(cast(round(l_extendedprice * 100) AS bigint) / 50000.0) AS bigint) * 50000 AS coord, count(*) AS n
  FROM lineitem WHERE cast(l_quantity AS int) >= 20 AND l_linenumber - 1 <= 3 AND l_returnflag <> 'R' GROUP BY ALL),
high AS (
  SELECT * FROM (SELECT *, 2.0 * n / avg(n) OVER (PARTITION BY sample) AS cn FROM counts) c WHERE cn > 3.0),
marked AS (
  SELECT *, CASE WHEN coord - lag(coord) OVER (PARTITION BY sample, chrom ORDER BY coord) <= 100000 THEN 0 ELSE 1 END AS fresh FROM high),
runs AS (
  SELECT sample, chrom, min(coord) AS start, max(coord) + 50000 AS stop, count(*) AS bins, avg(cn) AS cn
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY sample, chrom ORDER BY coord) AS run FROM marked) m GROUP BY sample, chrom, run),
genes AS (
  SELECT 'chr' || cast(p_partkey % 24 + 1 AS varchar) AS chrom, (p_partkey * 50000) % 10500000 AS start,
    (p_partkey * 50000) % 10500000 + p_size * 1000 AS stop, 'g' || cast(p_partkey AS varchar) AS name FROM part)
SELECT r.sample, r.chrom, r.start, r.stop, r.bins, round(r.cn, 6) AS cn, coalesce(string_agg(DISTINCT g.name, '; ' ORDER BY g.name), '') AS genes
FROM runs r LEFT JOIN genes g ON g.chrom = r.chrom AND g.start < r.stop AND r.start < g.stop AND g.start < g.stop
GROUP BY ALL
"""

QUERIES = {"job1_clip_panel": job1_clip_panel, "job2_sample_amplification": job2_sample_amplification}
ORACLE_SQL = {"job1_clip_panel": JOB1_SQL, "job2_sample_amplification": JOB2_SQL}
