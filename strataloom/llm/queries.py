"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .handmade import classify_files, made_report
from .leak import find_leaks, leak_report
from .mixing import Mix, interleaved, mix_sources
from .secrets import archive_records, content_paths, extract, find_secrets, redact, train, with_paths
from .split import split_oversized
from .subjects import composition, tag_subjects, train_subjects


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_records(*(table(spark, sf_dir, t) for t in ("blobs", "chunks", "evidence_items")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a credential starts."""
    return find_secrets(_records(spark, sf_dir), content_paths(table(spark, sf_dir, "files"))).select("src_table", "record_key", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that held credentials, without them."""
    records, paths = _records(spark, sf_dir), content_paths(table(spark, sf_dir, "files"))
    model = train(cut(extract(records, paths)))
    clean = redact(with_paths(records, paths), model).where("n_redacted > 0")
    return clean.withColumn("h", F.sha2("redacted", 256)).dropDuplicates(["src_table", "record_key", "h"]).drop("h")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of oversized chunks on which a unit starts."""
    return split_oversized(table(spark, sf_dir, "chunks")).select("chunk_id", F.explode("unit_lines").alias("line_no")).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of oversized chunks."""
    return split_oversized(table(spark, sf_dir, "chunks"))


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each oversized chunk the hash of its pieces put together without overlaps, and whether all are under the limit."""
    p = split_oversized(table(spark, sf_dir, "chunks")).select("chunk_id", "piece_no", "text", "overlap_chars").distinct()
    new = F.struct("piece_no", F.substring("text", F.col("overlap_chars") + 1, F.char_length("text")).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(new)), lambda x: x["t"]), "")
    return p.groupBy("chunk_id").agg(F.sha2(whole, 256).alias("text_hash"), (F.max(F.char_length("text")) <= 4000).alias("within_limit"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of generated, minified, vendored and bulk-data source files."""
    return classify_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "blobs")).where("made is not null").select("file_path").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files by language family and how they were made."""
    return made_report(classify_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "blobs")))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and item with at least 12 consecutive words in common."""
    return _leaks(spark, sf_dir).where("distance = 0").select("doc_id", "item_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near leaks of each item."""
    return leak_report(_leaks(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of uses of each document."""
    return _mix(spark, sf_dir).uses.select("doc_id", "source", "tokens", "uses")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and reached."""
    return _mix(spark, sf_dir).shares


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target source whether its cap is kept and its share met, where it has documents; the targets of those that have none are shared out."""
    m = _mix(spark, sf_dir)
    live = F.col("tokens_available") > 0
    whole = sum(r["target_share"] for r in m.plan if r["available"])
    near = ~live | (F.abs(F.col("share_reached") - F.col("target_share") / F.lit(whole)) < 0.01)
    most = m.uses.groupBy("source").agg(F.max("uses").alias("most"))
    return m.shares.join(most, "source", "left").select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"), near.alias("share_met"))


def p7_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All uses at their slots."""
    return interleaved(_mix(spark, sf_dir))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tag_subjects(docs, train_subjects(docs, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of each document."""
    return _tags(spark, sf_dir).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject."""
    return composition(_tags(spark, sf_dir), table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(regexp_split_to_array(lower(regexp_replace(text, '[\x{00AD}\x{034F}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

ORACLES = {
    "p3_checks": "SELECT DISTINCT chunk_id, sha256(text) AS text_hash, true AS within_limit FROM chunks WHERE length(text) > 4000",
    "p7_checks": "SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') AS source, true AS cap_kept, true AS share_met FROM mix_targets WHERE source IS NOT NULL",
    "p6_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
bg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM b))
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)""",
}

QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_checks": p3_checks, "p4_found": p4_found, "p4_report": p4_report, "p6_found": p6_found, "p6_report": p6_report, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_checks": p7_checks, "p7_interleaved": p7_interleaved, "p8_found": p8_found, "p8_composition": p8_composition}
