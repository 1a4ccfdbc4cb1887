"""Queries p2_* and p5_*: references and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import split_deliveries
from ..operators.orphans import archive_references, find_orphans, orphan_report


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_orphans(*archive_references(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct orphans: references without a target that was live at the time of the referring row."""
    period = F.date_format("at", "yyyy-MM").alias("period")
    return _orphans(spark, sf_dir).where("status = 'direct'").select("ref_field", "record_key", "ref_value", period).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and referring records by field, month and status (direct, inherited, sound)."""
    return orphan_report(_orphans(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus deliveries."""
    path = f"{sf_dir}/job_messages.parquet"
    return split_deliveries(spark, path).where("delivery_state = 'surplus'").select("delivery_id").distinct()


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery for each message, whole rows."""
    path = f"{sf_dir}/job_messages.parquet"
    return split_deliveries(spark, path).where("delivery_state = 'kept'").drop("delivery_state")


_P2 = r"""
WITH RECURSIVE refs AS (
  SELECT 'files.content_hash' AS ref_field, file_path AS record_key, content_hash AS ref_value, archived_at AS at, 'blobs' AS tab, lower(content_hash) AS k, 'files' AS ctab,
         regexp_replace(replace(regexp_replace(file_path, '#.*$', ''), '\', '/'), '^(\./|/)+', '') AS ck FROM files
  UNION ALL SELECT 'chunks.owned_files', chunk_id, v, indexed_at, 'files', regexp_replace(replace(regexp_replace(v, '#.*$', ''), '\', '/'), '^(\./|/)+', ''), 'chunks', chunk_id
  FROM (SELECT chunk_id, indexed_at, unnest(owned_files) AS v FROM chunks)
  UNION ALL SELECT 'chunks.related_doc_paths', chunk_id, v, indexed_at, 'ledger', regexp_replace(replace(regexp_replace(v, '#.*$', ''), '\', '/'), '^(\./|/)+', ''), 'chunks', chunk_id
  FROM (SELECT chunk_id, indexed_at, unnest(related_doc_paths) AS v FROM chunks)
), targets AS (
  SELECT 'blobs' AS tab, lower(content_hash) AS k, stored_at AS since, deleted_at AS until FROM blobs
  UNION ALL SELECT 'files', regexp_replace(replace(regexp_replace(file_path, '#.*$', ''), '\', '/'), '^(\./|/)+', ''), archived_at, deleted_at FROM files
  UNION ALL SELECT 'ledger', regexp_replace(replace(regexp_replace(doc_path, '#.*$', ''), '\', '/'), '^(\./|/)+', ''),
    CASE WHEN length(substr(trim(generated_at), 20)) >= 6 AND regexp_matches(trim(generated_at), '[+-]\d\d:\d\d$')
      THEN CAST(replace(substr(trim(generated_at), 1, 19), 'T', ' ') AS TIMESTAMP)
        - (CASE WHEN substr(right(trim(generated_at), 6), 1, 1) = '-' THEN -1 ELSE 1 END)
          * to_minutes(CAST(substr(right(trim(generated_at), 6), 2, 2) AS INT) * 60 + CAST(right(trim(generated_at), 2) AS INT))
      ELSE CAST(replace(substr(trim(generated_at), 1, 19), 'T', ' ') AS TIMESTAMP) END, retired_at
  FROM ledger WHERE generated_at IS NOT NULL AND trim(generated_at) <> ''
), hits AS (
  SELECT DISTINCT r.tab, r.k, r.at FROM refs r JOIN targets t ON r.tab = t.tab AND r.k = t.k AND t.since <= r.at AND (t.until IS NULL OR t.until > r.at)
), judged AS (
  SELECT r.*, h.k IS NOT NULL AS live FROM refs r LEFT JOIN hits h ON h.tab = r.tab AND h.k = r.k AND h.at = r.at WHERE trim(r.ref_value) <> ''
), dead0(ctab, ck) AS (SELECT ctab, ck FROM judged WHERE NOT live UNION SELECT j.ctab, j.ck FROM dead0 d JOIN judged j ON j.tab = d.ctab AND j.k = d.ck AND j.live), dead AS (SELECT DISTINCT ctab, ck FROM dead0)
"""

ORACLES = {
    "p2_found": _P2 + "SELECT DISTINCT ref_field, record_key, ref_value, strftime(j.at, '%Y-%m') AS period FROM judged j WHERE NOT j.live",
    "p2_report": _P2
    + """SELECT j.ref_field, strftime(j.at, '%Y-%m') AS period, CASE WHEN NOT j.live THEN 'direct' WHEN d.ck IS NOT NULL THEN 'inherited' ELSE 'sound' END AS status,
  count(*) AS n_refs, count(DISTINCT j.record_key) AS n_records
FROM judged j LEFT JOIN dead d ON d.ctab = j.tab AND d.ck = j.k GROUP BY 1, 2, 3""",
    "p5_found": """
WITH m AS (SELECT delivery_id, received_at, lower(regexp_replace(job_id, '^\\s+|\\s+$', '', 'g')) AS a, lower(regexp_replace(owner, '^\\s+|\\s+$', '', 'g')) AS b,
  lower(regexp_replace(repo, '^\\s+|\\s+$', '', 'g')) AS c FROM job_messages)
SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY a, b, c ORDER BY received_at NULLS LAST, delivery_id) AS rn
  FROM m WHERE a <> '' AND b <> '' AND c <> '') WHERE rn > 1""",
    "p5_kept": """
WITH m AS (SELECT *, lower(regexp_replace(job_id, '^\\s+|\\s+$', '', 'g')) AS ka, lower(regexp_replace(owner, '^\\s+|\\s+$', '', 'g')) AS kb,
  lower(regexp_replace(repo, '^\\s+|\\s+$', '', 'g')) AS kc FROM job_messages)
SELECT delivery_id, batch_id, job_id, owner, repo, visibility, dequeue_count, enqueued_at, received_at
FROM (SELECT *, row_number() OVER (PARTITION BY ka, kb, kc ORDER BY received_at NULLS LAST, delivery_id) AS rn
  FROM m WHERE ka <> '' AND kb <> '' AND kc <> '') WHERE rn = 1""",
}

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found, "p5_kept": p5_kept}
