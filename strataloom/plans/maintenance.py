"""Queries that compare, merge and score: snapshots, the ledger, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, quality
from ..operators.orphans import iso_time
from ..session import table
from ..sources.archive import name_status

_CUT = "timestamp_ntz'2025-08-01'"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue in August, and now without what was deleted; of several contents of a path the last."""
    f = table(spark, d, "files")
    last = F.max_by("content_hash", F.struct("archived_at", "content_hash")).alias("content_hash")
    old = f.where(f"archived_at < {_CUT}").groupBy(F.col("file_path").alias("path")).agg(last)
    new = f.where("deleted_at is null").groupBy(F.col("file_path").alias("path")).agg(last)
    return old, new


def snapshot_diff(spark, d):
    return name_status(*_snapshots(spark, d))


def change_strategy(spark, d):
    """One row: what the difference of the snapshots calls for."""
    n = name_status(*_snapshots(spark, d)).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in "AMD"])
    return n.withColumn("strategy", incremental.strategy(F.col("n_a"), F.col("n_m"), F.col("n_d"), F.col("n_d") > F.col("n_a")))


def _pages(spark, d):
    """The last good generation of each page, else the last."""
    p = table(spark, d, "ledger").select("slug", "success", "word_count", "elapsed_seconds", "doc_path", F.coalesce(F.date_format(iso_time(F.col("generated_at")), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("at"), "file_hashes")
    return p.withColumn("n_files", F.size("file_hashes")).drop("file_hashes").distinct()


def ledger_last_good(spark, d):
    return incremental.keep_last_good(_pages(spark, d), ["slug"], ["at", "word_count", "elapsed_seconds"], F.col("success")).select("slug", "success", "word_count", "at")


def stale_pages(spark, d):
    """Pages whose last generation failed or whose files have changed or gone since."""
    pages = incremental.keep_last_good(_pages(spark, d), ["slug"], ["at", "word_count", "elapsed_seconds"], F.lit(True)).select("slug", "success")
    tracked = table(spark, d, "ledger").select("slug", F.explode("file_hashes").alias("path", "hash")).distinct()
    _, now = _snapshots(spark, d)
    return incremental.stale_pages(pages, tracked, now.select("path", F.substring(F.lower("content_hash"), 1, 16).alias("hash")))


def _chunk_versions(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "source_key", "chunk_hash", "indexed_at").distinct()
    return c.where(f"indexed_at < {_CUT}").drop("indexed_at").distinct(), c.where(f"indexed_at >= {_CUT}").drop("indexed_at").distinct()


def incremental_merge(spark, d):
    """The index of August with the sources indexed since in their new state; sources of deleted files go."""
    old, fresh = _chunk_versions(spark, d)
    gone = table(spark, d, "files").where("deleted_at is not null").select(F.col("file_path").alias("source_key"))
    return incremental.merge_records(old, fresh, gone, "source_key")


def replace_slice(spark, d):
    """The index of August with that of today for the source files of pages' repositories under src."""
    old, fresh = _chunk_versions(spark, d)
    scope = fresh.where(F.col("source_key").rlike("/src/")).select("source_key")
    return incremental.replace_slice(old, fresh, scope, "source_key")


def manifest_upsert(spark, d):
    """Files with their hash and pages: those the ledger tracked in August, taken together with those it tracks since."""
    rows = table(spark, d, "ledger").select(iso_time(F.col("generated_at")).alias("at"), "doc_path", F.explode("file_hashes").alias("path", "hash")).where("at is not null")
    one = lambda r: r.groupBy("path").agg(F.max("hash").alias("hash"), F.collect_set("doc_path").alias("doc_paths"))
    return incremental.upsert_manifest(one(rows.where(f"at < {_CUT}")), one(rows.where(f"at >= {_CUT}")))


def owners_set_once(spark, d):
    """Jobs with the owner of their first deliveries and the visibility of their last ones."""
    j = table(spark, d, "job_messages").where("job_id is not null and trim(job_id) <> ''").withColumn("job", F.lower(F.trim("job_id")))
    side = lambda r, pick: r.groupBy("job").agg(pick(F.struct("received_at", "delivery_id", "owner", "visibility")).alias("r")).select("job", F.col("r.owner").alias("owner"), F.col("r.visibility").alias("visibility"))
    return incremental.set_once(side(j.where(f"received_at < {_CUT}"), F.min), side(j.where(f"received_at >= {_CUT}"), F.max), ["job"], ["owner"])


def semantic_changes(spark, d):
    """Sources whose chunks differ between August and since."""
    old, fresh = _chunk_versions(spark, d)
    return incremental.semantic_changes(old, fresh, ["source_key"], ["chunk_hash"])


def ledger_summary(spark, d):
    p = table(spark, d, "ledger").drop("file_hashes").distinct()
    return p.groupBy("bucket_type").agg(
        F.count("*").alias("n_pages"), F.count_if("success").alias("n_good"), F.sum("word_count").alias("words"), F.sum("mermaid_block_count").alias("diagrams"), F.round(F.avg("elapsed_seconds"), 6).alias("mean_seconds"), F.sum("retries").alias("retries")
    )


def score_pass_rates(spark, d):
    """Confidence of shown evidence as scores: means and rates at 50 and 90 by role."""
    e = table(spark, d, "evidence_items").select("answer_id", "id", "role", "confidence").distinct()
    return quality.pass_rates(e.withColumn("score", F.col("confidence") * 100), "score", [50, 90], ["role"])


def detail_averages(spark, d):
    """Mean of each month's words per page, pages without the month counting 0."""
    p = table(spark, d, "ledger").select("slug", iso_time(F.col("generated_at")).alias("at"), "word_count").distinct()
    m = p.select("slug", F.when(F.col("at").isNull(), F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.date_format("at", "yyyy-MM"), F.col("word_count").cast("double"))).alias("details"))
    return quality.detail_averages(m, "details")


def quality_gates(spark, d):
    """Shares of good pages, sound evidence and pages with diagrams against thresholds."""
    p = table(spark, d, "ledger").agg(F.avg(F.coalesce(F.col("success"), F.lit(False)).cast("double")).alias("good"), F.avg((F.col("mermaid_block_count") > 0).cast("double")).alias("diagrams"))
    e = table(spark, d, "evidence_items").agg(F.avg("confidence").alias("confidence"))
    g = quality.gates(p.join(e), {"good": 0.9, "diagrams": 0.5, "confidence": 0.95})
    return g.select("gate", F.round("value", 6).alias("value"), "threshold", "passed")


def telemetry_spans(spark, d):
    e = table(spark, d, "events")
    return quality.span_rollup(e, ["event_type"], "value", F.col("value") > 90)


def telemetry_delta(spark, d):
    """Events and their value by day against the day before."""
    day = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.round(F.sum("value"), 4).alias("value"))
    return quality.versus_previous(day, ["event_type"], "day", "value").select("day", "event_type", "value", "previous", "delta_pct")


def rolling_rate(spark, d):
    """Of each event the number and value of its user's events in the hour up to it."""
    return quality.rolling_rate(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", 3600, "value").select("event_id", "n_recent", "sum_recent")


def unknown_files(spark, d):
    """Evidence that names files which the archive doesn't have."""
    claims = table(spark, d, "evidence_items").where("file_path <> ''").select("answer_id", "id", "file_path").distinct()
    return quality.unknown_claims(claims, table(spark, d, "files").select("file_path"), ["file_path"], "known_file").select("answer_id", "id", "file_path", "check", "severity")


def evidence_ranges(spark, d):
    """Whether the lines that evidence shows exist in their file."""
    e = table(spark, d, "evidence_items").where("file_path <> ''").select("answer_id", "id", "file_path", "start_line", "end_line").distinct()
    cat = table(spark, d, "files").groupBy("file_path").agg(F.max("total_lines").alias("total_lines"))
    return quality.line_range_check(e, cat).select("answer_id", "id", "file_path", "verdict")


_OLD = "old AS (SELECT path, content_hash FROM (SELECT file_path AS path, content_hash, row_number() OVER (PARTITION BY file_path ORDER BY archived_at DESC, content_hash DESC) AS rn FROM files WHERE archived_at < TIMESTAMP '2025-08-01') WHERE rn = 1)"
_NEW = "new AS (SELECT path, content_hash FROM (SELECT file_path AS path, content_hash, row_number() OVER (PARTITION BY file_path ORDER BY archived_at DESC, content_hash DESC) AS rn FROM files WHERE deleted_at IS NULL) WHERE rn = 1)"
_DIFF = f"""{_OLD}, {_NEW}, diff AS (SELECT * FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' WHEN o.content_hash <> n.content_hash THEN 'M' END AS status
  FROM old o FULL JOIN new n ON o.path = n.path) WHERE status IS NOT NULL)"""
_AT = """CASE WHEN generated_at IS NULL OR trim(generated_at) = '' THEN NULL WHEN regexp_matches(trim(generated_at), '[+-]\\d\\d:\\d\\d$') THEN CAST(replace(substr(trim(generated_at), 1, 19), 'T', ' ') AS TIMESTAMP)
  - (CASE WHEN substr(right(trim(generated_at), 6), 1, 1) = '-' THEN -1 ELSE 1 END) * to_minutes(CAST(substr(right(trim(generated_at), 6), 2, 2) AS INT) * 60 + CAST(right(trim(generated_at), 2) AS INT))
  ELSE CAST(replace(substr(trim(generated_at), 1, 19), 'T', ' ') AS TIMESTAMP) END"""
_P = f"p AS (SELECT DISTINCT slug, success, word_count, elapsed_seconds, coalesce(strftime({_AT}, '%Y-%m-%d %H:%M:%S'), '') AS at_ FROM ledger)"
_V = "o AS (SELECT DISTINCT chunk_id, source_key, chunk_hash FROM chunks WHERE indexed_at < TIMESTAMP '2025-08-01'), n AS (SELECT DISTINCT chunk_id, source_key, chunk_hash FROM chunks WHERE indexed_at >= TIMESTAMP '2025-08-01')"
ORACLES = {
    "snapshot_diff": f"WITH {_DIFF} SELECT path, status FROM diff",
    "change_strategy": f"""WITH {_DIFF}, c AS (SELECT count(*) FILTER (status = 'A') AS n_a, count(*) FILTER (status = 'M') AS n_m, count(*) FILTER (status = 'D') AS n_d FROM diff)
SELECT n_a, n_m, n_d, CASE WHEN n_a + n_m + n_d = 0 THEN 'noop' WHEN n_d > n_a THEN 'targeted_replan' ELSE 'incremental' END AS strategy FROM c""",
    "ledger_last_good": f"WITH {_P} SELECT slug, success, word_count, at_ AS at FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY coalesce(success, false) DESC, at_ DESC, word_count DESC, elapsed_seconds DESC) AS rn FROM p) WHERE rn = 1".replace("at_ AS at FROM", 'at_ AS "at" FROM'),
    "stale_pages": f"""WITH {_OLD}, {_NEW}, {_P}, last AS (SELECT slug, success FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY at_ DESC, word_count DESC, elapsed_seconds DESC) AS rn FROM p) WHERE rn = 1),
t AS (SELECT DISTINCT slug, unnest(map_keys(file_hashes)) AS path, unnest(map_values(file_hashes)) AS hash FROM ledger),
s AS (SELECT slug, bool_or(n.path IS NULL) AS deleted, bool_or(substr(lower(n.content_hash), 1, 16) <> hash) AS changed FROM t LEFT JOIN new n ON n.path = t.path GROUP BY 1)
SELECT * FROM (SELECT l.slug, CASE WHEN NOT coalesce(success, false) THEN 'failed' WHEN deleted THEN 'deleted' WHEN changed THEN 'changed' END AS reason FROM last l LEFT JOIN s ON s.slug = l.slug) WHERE reason IS NOT NULL""",
    "incremental_merge": f"""WITH {_V}, g AS (SELECT source_key FROM n UNION SELECT file_path FROM files WHERE deleted_at IS NOT NULL)
SELECT chunk_id, source_key, chunk_hash, true AS reused FROM o WHERE source_key NOT IN (SELECT source_key FROM g) UNION ALL SELECT chunk_id, source_key, chunk_hash, false FROM n""",
    "replace_slice": f"""WITH {_V}, s AS (SELECT DISTINCT source_key FROM n WHERE regexp_matches(source_key, '/src/'))
SELECT chunk_id, source_key, chunk_hash FROM o WHERE source_key NOT IN (SELECT source_key FROM s) UNION ALL SELECT chunk_id, source_key, chunk_hash FROM n WHERE source_key IN (SELECT source_key FROM s)""",
    "manifest_upsert": f"""WITH r AS (SELECT {_AT} AS at_, doc_path, unnest(map_keys(file_hashes)) AS path, unnest(map_values(file_hashes)) AS hash FROM ledger),
o AS (SELECT path, max(hash) AS hash, list_distinct(list(doc_path)) AS docs FROM r WHERE at_ < TIMESTAMP '2025-08-01' GROUP BY 1), n AS (SELECT path, max(hash) AS hash, list_distinct(list(doc_path)) AS docs FROM r WHERE at_ >= TIMESTAMP '2025-08-01' GROUP BY 1)
SELECT coalesce(n.path, o.path) AS path, coalesce(n.hash, o.hash) AS hash, list_sort(CASE WHEN n.path IS NULL THEN o.docs WHEN n.hash = o.hash THEN list_distinct(list_concat(o.docs, n.docs)) ELSE n.docs END) AS doc_paths FROM o FULL JOIN n ON n.path = o.path""",
    "owners_set_once": """WITH j AS (SELECT lower(trim(job_id)) AS job, owner, visibility, received_at, delivery_id FROM job_messages WHERE job_id IS NOT NULL AND trim(job_id) <> ''),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY received_at NULLS FIRST, delivery_id) AS rn FROM j WHERE received_at < TIMESTAMP '2025-08-01') WHERE rn = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY received_at DESC, delivery_id DESC) AS rn FROM j WHERE received_at >= TIMESTAMP '2025-08-01') WHERE rn = 1)
SELECT coalesce(o.job, n.job) AS job, coalesce(o.owner, n.owner) AS owner, CASE WHEN n.job IS NOT NULL THEN n.visibility ELSE o.visibility END AS visibility FROM o FULL JOIN n ON n.job = o.job""",
    "semantic_changes": f"""WITH {_V}, a AS (SELECT source_key, list_sort(list_distinct(list(chunk_hash))) AS p FROM o GROUP BY 1), b AS (SELECT source_key, list_sort(list_distinct(list(chunk_hash))) AS p FROM n GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.source_key, b.source_key) AS source_key, CASE WHEN a.source_key IS NULL THEN 'added' WHEN b.source_key IS NULL THEN 'removed' WHEN a.p <> b.p THEN 'changed' END AS change FROM a FULL JOIN b ON a.source_key = b.source_key) WHERE change IS NOT NULL""",
    "ledger_summary": """WITH l AS (SELECT DISTINCT slug, title, bucket_type, section, doc_path, success, error, generated_at, elapsed_seconds, retries, word_count, mermaid_block_count, retired_at FROM ledger)
SELECT bucket_type, count(*) AS n_pages, count(*) FILTER (success) AS n_good, sum(word_count)::BIGINT AS words, sum(mermaid_block_count)::BIGINT AS diagrams, round(avg(elapsed_seconds), 6) AS mean_seconds, sum(retries)::BIGINT AS retries FROM l GROUP BY 1""",
    "score_pass_rates": """WITH e AS (SELECT DISTINCT answer_id, id, role, confidence * 100 AS score FROM evidence_items)
SELECT role, count(*) AS n, round(avg(score), 6) AS mean, round(avg(CASE WHEN score >= 50 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate_50, round(avg(CASE WHEN score >= 90 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate_90 FROM e GROUP BY 1""",
    "detail_averages": f"""WITH p AS (SELECT DISTINCT slug, {_AT} AS at_, word_count FROM ledger)
SELECT strftime(at_, '%Y-%m') AS metric, round(sum(coalesce(word_count, 0)) / (SELECT count(*) FROM p)::DOUBLE, 6) AS average FROM p WHERE at_ IS NOT NULL GROUP BY 1""",
    "quality_gates": """WITH m AS (SELECT (SELECT avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) FROM ledger)::DOUBLE AS good, (SELECT avg(CASE WHEN mermaid_block_count > 0 THEN 1.0 WHEN mermaid_block_count IS NOT NULL THEN 0.0 END) FROM ledger)::DOUBLE AS diagrams, (SELECT avg(confidence) FROM evidence_items) AS confidence),
g AS (SELECT 'good' AS gate, good AS value, 0.9::DOUBLE AS threshold FROM m UNION ALL SELECT 'diagrams', diagrams, 0.5 FROM m UNION ALL SELECT 'confidence', confidence, 0.95 FROM m)
SELECT gate, round(value, 6) AS value, threshold, value >= threshold AS passed FROM g UNION ALL SELECT 'all', NULL, NULL, bool_and(value >= threshold) FROM g""",
    "telemetry_spans": "SELECT event_type, round(sum(value), 4) AS total, count(*) AS n, count(*) FILTER (value > 90) AS n_failed, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY 1",
    "telemetry_delta": """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value), 4) AS value FROM events GROUP BY 1, 2), p AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY day) AS previous FROM d)
SELECT day, event_type, value, previous, round(CASE WHEN previous = 0 THEN NULL ELSE (value - previous) * 100.0 / previous END, 4) AS delta_pct FROM p""",
    "rolling_rate": """SELECT event_id, count(*) OVER w AS n_recent, round(sum(value) OVER w, 4) AS sum_recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""",
    "unknown_files": "SELECT DISTINCT answer_id, id, file_path, 'known_file' AS check, 'error' AS severity FROM evidence_items WHERE file_path <> '' AND file_path NOT IN (SELECT file_path FROM files)".replace("AS check", 'AS "check"'),
    "evidence_ranges": """WITH c AS (SELECT file_path, max(total_lines) AS n FROM files GROUP BY 1)
SELECT DISTINCT answer_id, id, e.file_path, CASE WHEN n IS NULL THEN 'missing' WHEN start_line >= 1 AND end_line >= start_line AND end_line <= n THEN 'accepted' ELSE 'out of range' END AS verdict FROM (SELECT DISTINCT answer_id, id, file_path, start_line, end_line FROM evidence_items WHERE file_path <> '') e LEFT JOIN c ON c.file_path = e.file_path""",
}
QUERIES = {
    f.__name__: f
    for f in (
        snapshot_diff, change_strategy, ledger_last_good, stale_pages, incremental_merge, replace_slice, manifest_upsert, owners_set_once, semantic_changes, ledger_summary, score_pass_rates, detail_averages, quality_gates,
        telemetry_spans, telemetry_delta, rolling_rate, unknown_files, evidence_ranges,
    )
}
