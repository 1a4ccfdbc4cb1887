"""Queries over the source archive: catalogue, contents, symbols, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import LANGUAGES, language_of
from ..sources import archive, parsers
from ..session import cut, table


def _files(spark: SparkSession, d: str) -> DataFrame:
    """One row for each path: the last archived."""
    f = table(spark, d, "files")
    return f.groupBy("file_path").agg(F.max_by(F.struct("content_hash", "source_kind", "language", "total_lines", "size_bytes", "archived_at"), F.struct("archived_at", "content_hash")).alias("r")).select("file_path", "r.*")


def _texts(spark, d):
    f = archive.read_texts(_files(spark, d).select("file_path", "content_hash"), table(spark, d, "blobs"))
    return f.withColumn("language", language_of("file_path"))


def source_catalog(spark, d):
    return _files(spark, d).select("file_path", "content_hash", "source_kind", "language", "total_lines", "size_bytes")


def language_counts(spark, d):
    """Files, sizes and distinct contents by language named by the path."""
    f = _files(spark, d).withColumn("lang", language_of("file_path"))
    return f.groupBy("lang").agg(F.count("*").alias("n_files"), F.countDistinct(F.lower("content_hash")).alias("n_contents"), F.sum(F.greatest("size_bytes", F.lit(0))).alias("size_bytes"))


def archive_integrity(spark, d):
    """Paths whose content isn't stored at all."""
    return archive.missing_blobs(_files(spark, d), table(spark, d, "blobs")).select("file_path", "content_hash")


def archive_garbage(spark, d):
    """Contents that no path uses."""
    return archive.orphan_blobs(table(spark, d, "files"), table(spark, d, "blobs")).select("content_hash").distinct()


def archive_build(spark, d):
    """Documents as an archive: contents stored once, with the number of paths of each."""
    docs = table(spark, d, "documents").where("text is not null").select(F.concat_ws("/", "path", F.col("doc_id").cast("string")).alias("path"), "text")
    files, blobs = archive.build_archive(docs)
    return files.groupBy("content_hash").agg(F.count("*").alias("n_paths"), F.max("total_lines").alias("total_lines")).join(blobs.select("content_hash", F.char_length("text").alias("n_chars")), "content_hash")


def archive_upsert(spark, d):
    """The catalogue after the files archived since October are taken as changes and the deleted ones as deletions."""
    f = _files(spark, d).select("file_path", "content_hash", "archived_at")
    old, new = f.where("archived_at < timestamp_ntz'2025-10-01'"), f.where("archived_at >= timestamp_ntz'2025-10-01'")
    gone = table(spark, d, "files").where("deleted_at is not null").select("file_path").distinct()
    return archive.apply_changes(old, new, gone).select("file_path", "content_hash")


def archive_contents(spark, d):
    """Paths with the size and hash of their readable contents."""
    return _texts(spark, d).select("file_path", F.char_length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


def index_manifest(spark, d):
    c = table(spark, d, "chunks").select("corpus", "chunk_id", "chunk_hash").distinct()
    return archive.index_manifest(c, "corpus", "chunk_id", "chunk_hash")


def code_symbols(spark, d):
    return parsers.symbols(_texts(spark, d), ["file_path"])


def code_imports(spark, d):
    return parsers.imports(_texts(spark, d), ["file_path"])


def call_edges(spark, d):
    t = cut(_texts(spark, d))  # read twice below
    links = parsers.resolve_imports(parsers.imports(t, ["file_path"]), t.select("file_path"), "file_path")
    return parsers.resolve_calls(parsers.calls(t, ["file_path"]), parsers.symbols(t, ["file_path"]), "file_path", links)


_F = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY archived_at DESC, content_hash DESC) AS rn FROM files) WHERE rn = 1)"
_LANG = (
    "CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) "
    + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in LANGUAGES.items())
    + " ELSE '' END"
)
ORACLES = {
    "source_catalog": f"WITH {_F} SELECT file_path, content_hash, source_kind, language, total_lines, size_bytes FROM f",
    "language_counts": f"WITH {_F} SELECT {_LANG} AS lang, count(*) AS n_files, count(DISTINCT lower(content_hash)) AS n_contents, sum(greatest(size_bytes, 0))::BIGINT AS size_bytes FROM f GROUP BY 1",
    "archive_integrity": f"WITH {_F} SELECT file_path, content_hash FROM f WHERE NOT EXISTS (SELECT 1 FROM blobs b WHERE lower(b.content_hash) = lower(f.content_hash))",
    "archive_garbage": "SELECT DISTINCT content_hash FROM blobs b WHERE NOT EXISTS (SELECT 1 FROM files f WHERE lower(f.content_hash) = lower(b.content_hash))",
    "archive_build": """SELECT sha256(text) AS content_hash, count(*) AS n_paths, max(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END)::INT AS total_lines,
  max(length(text)) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "archive_upsert": f"""WITH {_F}, gone AS (SELECT file_path FROM files WHERE deleted_at IS NOT NULL)
SELECT file_path, content_hash FROM f WHERE archived_at >= TIMESTAMP '2025-10-01' OR file_path NOT IN (SELECT file_path FROM gone)""",
    "index_manifest": """SELECT corpus, count(*) AS record_count, sum(('0x' || substr(sha256(chunk_id || chr(0) || chunk_hash), 1, 15))::HUGEINT)::VARCHAR AS checksum
FROM (SELECT DISTINCT corpus, chunk_id, chunk_hash FROM chunks) GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (source_catalog, language_counts, archive_integrity, archive_garbage, archive_build, archive_upsert, archive_contents, index_manifest, code_symbols, code_imports, call_edges)}
