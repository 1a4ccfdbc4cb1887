"""Generated, minified, vendored and bulk-data source files (problem 4).

Layout statistics of each content (line lengths, white space, alphanumeric share, numeric literals, long encoded runs) are held against thresholds of the file's
language, which are the valleys of that language's own distribution over all files; notices in the leading comments and the path tell generated and vendored files. Contents are measured once,
wherever they are used.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, hot_keys, salted_join

#: Source languages by file ending. Anything else is configuration, documentation or data and never a case.
FAMILIES = {
    "py": "py pyi pyx",
    "script": "js jsx mjs cjs ts tsx vue css",
    "go": "go",
    "java": "java kt scala cs",
    "php": "php",
    "c": "c h cc cpp hpp m rs swift",
    "loose": "rb pl lua r jl dart ex",
}
#: Of each statistic the range in which its threshold is sought, and whether the range is logarithmic.
RANGES = {
    "mean_line": (110.0, 500.0, True), "max_line": (300.0, 1500.0, True), "white": (0.036, 0.076, False), "numeric": (0.17, 0.45, False), "encoded": (0.55, 0.85, False), "alnum": (0.92, 0.975, False),
}
#: Steps of each range.
STEPS = 32

GENERATED = re.compile(
    r"(?i)@generated\b|<auto-?generated|\b(?:code|file|source) (?:was |is |has been )?(?:automatically |auto-?)?generated\b|\bauto(?:matically)?[- ]?generated\b|\bmanual changes will be (?:lost|overwritten)\b|\bgenerated (?:by|from|with|using) \S"
    r"|\bdo not (?:edit|modify)\b|\bproduced by \S+ from\b|\bchanges (?:are|will be) lost\b|généré\w* (?:par|automatiquement)|ne pas (?:modifier|éditer)|automatisch (?:erzeugt|generiert)"
    r"|nicht (?:von hand|manuell) (?:ändern|bearbeiten)|generado (?:por|automáticamente)|no (?:editar|modificar)\b|generato (?:da|automaticamente)|gerado (?:por|automaticamente)"
)
VENDORED = re.compile(
    r"(?i)\bvendored (?:from|copy)\b|\bthird[- ]party (?:component|code|library|copy)\b|\bcopy of \S+ \S+ is bundled\b|\bcopied (?:verbatim )?from upstream\b|\bfrom upstream \S+, (?:release|version)\b"
    r"|^[^\w\n]*+[a-z][\w.-]* v?\d+\.\d+(?:\.\d+)?(?:[+-]\w[\w.]*)?\s*(?:\||-|$)|@license\b|@version\b|\(c\) [\w .-]+ contributors\b|^[^\w\n]*+[a-z][\w.-]* - https?://\S+\s*$",
    re.M,
)
_NUMBER = re.compile(rb"(?<![\w.])(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?)(?![\w.])")
_WORD = re.compile(rb"[A-Za-z_$][\w$]*")
_RUN = re.compile(rb"[A-Za-z0-9+/=]{60,}|(?:\\x[0-9a-fA-F]{2}){15,}|[0-9a-fA-F]{60,}")
_BLANKS = b" \t\r\n\f\v"
_NOT_ALNUM = bytes(i for i in range(128) if not chr(i).isalnum())
_COMMENT = re.compile(r"\s*(?://|#|/?\*|--|;|<\?php|<!--|\"\"\"|'''|$)")
_CLOSE = {"/*": "*/", "<!--": "-->"}

#: A dir or name that says it without a look at the content.
VENDOR_PATH = r"(?i)(^|/)(vendor|vendors|third[-_]?party|node_modules|bower_components|external|externals|libs|site-packages)/"
GENERATED_PATH = r"(?i)(^|/)(__generated__|generated|gen|autogen)/|\.(gen|generated|pb|g|designer)\.[a-z]+$|_pb2(_grpc)?\.[a-z]+$|\.pb\.[a-z]+$"
MINIFIED_PATH = r"(?i)\.min\.(js|css)$|[-.](bundle|chunk)\.(js|css)$|(^|/)dist/.*\.(js|css)$|(^|/)assets/[^/]+\.[0-9a-f]{8,}\.(js|css)$"


def inflate(data: bytes | None) -> bytes | None:
    """The content of a gzip stream; of a damaged one what comes before the damage; None if that is nothing."""
    if not data:
        return None
    try:
        return zlib.decompress(data, 31)
    except zlib.error:
        pass
    out, z = b"", zlib.decompressobj(31)
    try:
        for a in range(0, len(data), 256):
            out += z.decompress(data[a : a + 256])
    except zlib.error:
        pass
    return out or None


def leading_comment(text: str) -> str:
    """The comment lines at the top, blocks that have no mark on each line among them."""
    text = text.lstrip("\ufeff")
    out, at, close = [], 0, ""
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line, after = text[at:end], 0
        if not close:
            if not (m := _COMMENT.match(line)):
                break
            close, after = _CLOSE.get(m[0].strip(), ""), m.end()
        if close and line.find(close, after) >= 0:
            close = ""
        out.append(line.rstrip("\r"))
        at = end + 1
    return "\n".join(out)


def layout(raw: bytes) -> tuple:
    """Size, mean and longest line, shares of white space, alphanumerics, numeric literals and encoded runs, notices."""
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    n = len(raw)
    lines = [len(x) for x in raw.split(b"\n") if x.strip()]
    numbers, words = len(_NUMBER.findall(raw)), len(_WORD.findall(raw))
    solid = len(raw.translate(None, _BLANKS))
    encoded = sum(len(x) for x in _RUN.findall(raw))
    alnum = len(raw.translate(None, _NOT_ALNUM))
    head = leading_comment(raw.decode("utf-8", "replace"))
    # Shares of little text are drawn towards those of ordinary code, so that short files need no rule of their own.
    return (
        n, sum(lines) / max(1, len(lines)), max(lines, default=0), (n - solid + 20) / (n + 100), (alnum + 16) / (solid + 20),
        numbers / (numbers + words + 20), encoded / (n + 60), bool(GENERATED.search(head)), bool(VENDORED.search(head)),
    )


STATS = "k string, size bigint, mean_line double, max_line bigint, white double, alnum double, numeric double, encoded double, says_generated boolean, says_vendored boolean"


def content_layout(blobs: DataFrame, key: Column) -> DataFrame:
    """One row of statistics for each content; contents that can't be read have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STATS.split(", ")]
        for pdf in batches:
            rows = [(k, *layout(raw)) for k, c in zip(pdf["k"], pdf["c"]) if (raw := inflate(c)) is not None]
            yield pd.DataFrame(rows, columns=names)

    found = blobs.select(key.alias("k"), F.col("compressed_content").alias("c")).where("k is not null and c is not null").mapInPandas(run, STATS)
    # Of repeated rows, of which one may be damaged, the longest content counts.
    rest = [x.split()[0] for x in STATS.split(", ")][2:]
    return found.groupBy("k").agg(F.max(F.struct("size", *rest)).alias("s")).select("k", "s.*")


def valleys(rows: DataFrame) -> dict[str, dict[str, float]]:
    """Of each family and statistic the threshold: the middle of the longest run of the emptiest steps within its range. rows: fam and the statistics, one row for each file. All files count; what
    comes to the driver is a histogram of fixed size for each family."""
    def step(c: str) -> Column:
        low, high, by_log = RANGES[c]
        x = (F.log(F.greatest(F.col(c), F.lit(1e-9))) - math.log(low)) / (math.log(high) - math.log(low)) if by_log else (F.col(c) - low) / (high - low)
        return F.floor(x * STEPS).cast("int")

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), step(c).alias("step")) for c in RANGES])).alias("e")
    counts = rows.where("size is not null").select("fam", each).select("fam", "e.*").where(F.col("step").between(0, STEPS - 1)).groupBy("fam", "stat", "step").count().collect()
    hist = {(f, c): [0] * STEPS for f in FAMILIES for c in RANGES}
    for r in counts:
        hist[r["fam"], r["stat"]][r["step"]] = r["count"]
    out: dict[str, dict[str, float]] = {f: {} for f in FAMILIES}
    for (f, c), n in hist.items():
        least, best, at = min(n), (0, 0), 0
        while at < STEPS:
            end = at
            while end < STEPS and n[end] == least:
                end += 1
            best = max(best, (end - at, at), key=lambda x: x[0])
            at = max(end, at + 1)
        low, high, by_log = RANGES[c]
        x = (best[1] + best[0] / 2) / STEPS
        out[f][c] = low * (high / low) ** x if by_log else low + (high - low) * x
    return out


def classify_files(files: DataFrame, blobs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(file_path, content_hash, fam, made, reason): made is 'generated', 'vendored', 'minified' or 'data', null for hand-written files and those that are no source; reason says
    what told: 'layout', 'notice' or 'path'.

    source_kind and language aren't trusted: the file ending names the language. Files without readable content are judged by path. Null
    paths give no row; repeated rows are kept once. A content that more than `most` files share is spread by a salt.
    """
    ends = {e: f for f, es in FAMILIES.items() for e in es.split()}
    fam_of = F.create_map(*[F.lit(x) for kv in ends.items() for x in kv])
    path = F.regexp_replace(F.col("file_path"), r"\\", "/")
    f = (
        files.where("file_path is not null").select("file_path", "content_hash").distinct()
        .withColumn("fam", F.try_element_at(fam_of, F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))))
        .withColumn("k", F.lower("content_hash"))
    )
    rows = cut(salted_join(f, content_layout(blobs, F.lower("content_hash")), ["k"], "left", ["file_path"], hot_keys(files.select(F.lower("content_hash").alias("k")), ["k"], most)))
    tuned = valleys(rows.where("fam is not null"))
    limit = lambda c: F.element_at(F.create_map(*[x for k, v in tuned.items() for x in (F.lit(k), F.lit(float(v[c])))]), F.col("fam"))
    dense = ((F.col("mean_line") > limit("mean_line")) & (F.col("max_line") > limit("max_line"))) | ((F.col("white") < limit("white")) & (F.col("mean_line") > 60))
    data = (F.col("numeric") > limit("numeric")) | (F.col("encoded") > limit("encoded")) | (F.col("alnum") > limit("alnum"))
    says = lambda made, reason: F.struct(F.lit(made).alias("made"), F.lit(reason).alias("reason"))
    no = F.lit(False)
    told = (
        F.when(F.col("fam").isNull(), None)
        .when(F.coalesce(data, no), says("data", "layout"))
        .when(F.coalesce(dense, no), says("minified", "layout"))
        .when(F.coalesce(F.col("says_generated"), no), says("generated", "notice"))
        .when(F.coalesce(F.col("says_vendored"), no), says("vendored", "notice"))
        .when(path.rlike(VENDOR_PATH), says("vendored", "path"))
        .when(path.rlike(GENERATED_PATH), says("generated", "path"))
        .when(F.col("size").isNull() & path.rlike(MINIFIED_PATH), says("minified", "path"))
    )
    return rows.withColumn("told", told).select("file_path", "content_hash", "fam", "told.made", "told.reason")


def made_report(classified: DataFrame) -> DataFrame:
    """Source files by language family, how they were made, and what told it ('' for hand-written ones)."""
    by = ["fam", F.coalesce("made", F.lit("hand-written")).alias("made"), F.coalesce("reason", F.lit("")).alias("reason")]
    return classified.where("fam is not null").groupBy(*by).agg(F.countDistinct("file_path").alias("n_files"))
