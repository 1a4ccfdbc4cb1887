"""Checks of written pages against what is known; each gives (page, check, severity, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_references, terms

#: Phrases that stand where a section was to be written.
PLACEHOLDERS = r"(?i)\b(todo|tbd|coming soon|lorem ipsum|to be written|placeholder)\b"


def _violation(df: DataFrame, page: str, check: str, severity: str, detail: Column) -> DataFrame:
    return df.select(F.col(page).alias("page"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))


def too_short(pages: DataFrame, page: str, text: str, least: int = 100) -> DataFrame:
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return _violation(pages.where(F.col(text).isNotNull() & (n < least)), page, "word_count", "error", n.cast("string"))


def placeholders(pages: DataFrame, page: str, text: str) -> DataFrame:
    hit = F.regexp_extract(text, PLACEHOLDERS, 1)
    return _violation(pages.where(hit != ""), page, "placeholder", "error", F.lower(hit))


def unclosed_fences(pages: DataFrame, page: str, text: str) -> DataFrame:
    n = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s{0,3}(```|~~~)"), 1))
    return _violation(pages.where(n % 2 == 1), page, "unclosed_fence", "warning", n.cast("string"))


def unknown_paths(pages: DataFrame, page: str, text: str, known: DataFrame, path: str, most: int = 1) -> DataFrame:
    """Pages that name over `most` files nobody knows: an error, with their number. `known` paths count by any of their endings."""
    named = pages.select(page, F.explode(file_references(text)).alias("_p")).distinct()
    parts = F.split(path, "/")
    ends = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("_p")).distinct()
    bad = named.join(ends, "_p", "left_anti").groupBy(page).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return _violation(bad, page, "unknown_paths", "error", F.col("_n").cast("string"))


def missing_sections(pages: DataFrame, page: str, text: str, required: DataFrame) -> DataFrame:
    """required (page, section) without a heading that shares at least half of its words."""
    heads = pages.select(F.col(page).alias("page"), F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6} +(.+?)\s*#*$"), 1)).alias("_h"))
    want = required.select("page", "section", F.explode(F.array_distinct(terms("section"))).alias("_w"))
    total = required.select("page", "section", F.size(F.array_distinct(terms("section"))).alias("_t"))
    have = heads.select("page", "_h", F.explode(F.array_distinct(terms("_h"))).alias("_w"))
    shared = want.join(have, ["page", "_w"]).groupBy("page", "section", "_h").agg(F.count("*").alias("_n")).groupBy("page", "section").agg(F.max("_n").alias("_n"))
    lost = total.join(shared, ["page", "section"], "left").where(F.coalesce("_n", F.lit(0)) * 2 < F.col("_t"))
    return _violation(lost, "page", "missing_section", "warning", F.col("section"))


def citation_rate(pages: DataFrame, page: str, text: str, within: int = 300) -> DataFrame:
    """Of each page the number of `name()` mentions and of those with a file reference within `within` characters after."""
    call = r"`\w+(?:\(\))`"
    n = F.size(F.regexp_extract_all(text, F.lit(f"({call})"), 1))
    near = F.size(F.regexp_extract_all(text, F.lit(rf"({call})(?=[\s\S]{{0,{within}}}?`[\w./\-]+\.\w+(?::\d+)?`)"), 1))
    return pages.select(page, n.alias("n_mentions"), near.alias("n_cited"))
