"""Queries over written pages and shown evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import language_of
from ..operators import evidence, validation
from ..sources import archive, parsers
from ..session import table


def _pages(spark, d):
    return table(spark, d, "documents").where("text is not null and doc_kind in ('page', 'readme', 'runbook')").select("doc_id", "text")


def page_violations(spark, d):
    """Pages that are too short, hold placeholders, leave fences open or name unknown files."""
    p = _pages(spark, d)
    known = table(spark, d, "files").select("file_path").distinct()
    checks = [validation.too_short(p, "doc_id", "text"), validation.placeholders(p, "doc_id", "text"), validation.unclosed_fences(p, "doc_id", "text"), validation.unknown_paths(p, "doc_id", "text", known, "file_path", 1)]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def workspace_files(spark, d):
    """Of each answer its files by confidence: 4 primary, 6 supporting."""
    e = table(spark, d, "evidence_items").where("file_path <> ''").select("answer_id", "id", "file_path", "confidence").distinct()
    return evidence.primary_and_supporting(e, "answer_id", "file_path", "confidence").select("answer_id", "file_path", "score", "n", "rank", "role")


def evidence_cards(spark, d):
    """Of each file the names of up to 3 sources and 2 configurations that answers showed of it."""
    e = table(spark, d, "evidence_items").where("file_path <> ''").select("file_path", "kind", "title").distinct()
    return evidence.capped_lists(e, ["file_path"], "kind", "title", [F.col("title")], {"source": 3, "config": 2})


def page_links(spark, d):
    """The first 5 links of each page's chunks with their titles."""
    c = table(spark, d, "chunks").select("chunk_id", "related_doc_urls", "related_doc_titles").distinct()
    return evidence.first_links(c, "chunk_id", "related_doc_urls", "related_doc_titles")


def _texts(spark, d):
    f = table(spark, d, "files").select("file_path", "content_hash").groupBy("file_path").agg(F.max("content_hash").alias("content_hash"))
    return archive.read_texts(f, table(spark, d, "blobs")).withColumn("language", language_of("file_path"))


def content_signals(spark, d):
    """Environment variables, log calls, locks, events, schedules and statements in contents: how many files, and the first three."""
    return evidence.signal_files(evidence.signals(_texts(spark, d).select("file_path", "text"), "file_path", "text"), "file_path")


def import_chains(spark, d):
    """Files whose names other files import."""
    t = _texts(spark, d)
    return evidence.chain_files(parsers.imports(t, ["file_path"]).select(F.col("file_path").alias("file"), "module"), t.select(F.col("file_path").alias("file")))


def recent_public_jobs(spark, d):
    """The 60 repositories with the latest public jobs, with their archived files."""
    j = table(spark, d, "job_messages").where("lower(trim(visibility)) = 'public' and repo is not null and owner is not null").select(F.concat_ws("/", F.lower(F.trim("owner")), F.lower(F.trim("repo"))).alias("repo"), "received_at")
    n = table(spark, d, "files").select(F.lower("repo").alias("repo"), "file_path").distinct().groupBy("repo").agg(F.count("*").alias("n_files"))
    return j.groupBy("repo").agg(F.max("received_at").alias("last_job")).join(n, "repo").orderBy(F.desc("last_job"), "repo").limit(60)


ORACLES = {
    "page_violations": """WITH p AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_kind IN ('page', 'readme', 'runbook')),
w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS n FROM p),
f AS (SELECT doc_id, len(regexp_extract_all(text, '(?m)^\\s{0,3}(```|~~~)', 1)) AS n FROM p),
h AS (SELECT doc_id, lower(regexp_extract(text, '(?i)\\b(todo|tbd|coming soon|lorem ipsum|to be written|placeholder)\\b', 1)) AS hit FROM p),
r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '`([\\w./\\-]+\\.[A-Za-z0-9]+)(?::\\d+)?`', 1)) AS x FROM p),
k AS (SELECT DISTINCT array_to_string(list_slice(parts, i, len(parts)), '/') AS x FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT string_split(file_path, '/') AS parts FROM files))),
u AS (SELECT doc_id, count(*) AS n FROM r WHERE x NOT IN (SELECT x FROM k) GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id AS page, 'word_count' AS "check", 'error' AS severity, n::VARCHAR AS detail FROM w WHERE n < 100 UNION ALL SELECT doc_id, 'unclosed_fence', 'warning', n::VARCHAR FROM f WHERE n % 2 = 1
UNION ALL SELECT doc_id, 'placeholder', 'error', hit FROM h WHERE hit <> '' UNION ALL SELECT doc_id, 'unknown_paths', 'error', n::VARCHAR FROM u""",
    "workspace_files": """WITH e AS (SELECT DISTINCT answer_id, id, file_path, confidence FROM evidence_items WHERE file_path <> ''), b AS (SELECT answer_id, file_path, max(confidence) AS score, count(*) AS n FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY score DESC, n DESC, file_path) AS rank FROM b) SELECT answer_id, file_path, score, n, rank, CASE WHEN rank <= 4 THEN 'primary' ELSE 'supporting' END AS role FROM r WHERE rank <= 10""",
    "evidence_cards": """WITH e AS (SELECT DISTINCT file_path, kind, title FROM evidence_items WHERE file_path <> '' AND kind IN ('source', 'config')), r AS (SELECT *, row_number() OVER (PARTITION BY file_path, kind ORDER BY title) AS n FROM e),
k AS (SELECT * FROM r WHERE n <= CASE kind WHEN 'source' THEN 3 ELSE 2 END) SELECT file_path, coalesce(list(title ORDER BY n) FILTER (kind = 'source'), []) AS source, coalesce(list(title ORDER BY n) FILTER (kind = 'config'), []) AS config FROM k GROUP BY 1""",
    "page_links": """WITH c AS (SELECT DISTINCT chunk_id, related_doc_urls AS u, related_doc_titles AS t FROM chunks), x AS (SELECT chunk_id, unnest(u) AS url, unnest(range(1, len(u) + 1)) AS pos, t FROM c),
y AS (SELECT chunk_id, url, pos, coalesce(t[pos], '') AS title FROM x WHERE url IS NOT NULL AND url <> ''), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, url ORDER BY pos, title) AS rn FROM y) WHERE rn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos, url) AS rank FROM f) SELECT chunk_id, url, title, rank FROM r WHERE rank <= 5""",
    "recent_public_jobs": """WITH j AS (SELECT concat_ws('/', lower(trim(owner)), lower(trim(repo))) AS repo, max(received_at) AS last_job FROM job_messages WHERE lower(trim(visibility)) = 'public' AND repo IS NOT NULL AND owner IS NOT NULL GROUP BY 1),
n AS (SELECT lower(repo) AS repo, count(DISTINCT file_path) AS n_files FROM files GROUP BY 1) SELECT j.repo, last_job, n_files FROM j JOIN n ON n.repo = j.repo ORDER BY last_job DESC, j.repo LIMIT 60""",
}
QUERIES = {f.__name__: f for f in (page_violations, workspace_files, evidence_cards, page_links, content_signals, import_chains, recent_public_jobs)}
