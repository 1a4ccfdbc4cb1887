"""Content-addressed archive: building, reading, checking, changing; directory, JSON-lines and JSON-state sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.paths import language_of, matches_any, source_kind
from ..functions.text import line_count
from ..session import hot_keys, salted_join

SIZE_CAP = 250_000


def scan_directory(spark: SparkSession, root: str, exclude: list[str] | None = None, allow: list[str] | None = None) -> DataFrame:
    """(path, size_bytes, modified_at, content) of the files under `root`, paths relative to it. Excludes are shell patterns over paths, names and directories; allow, a list of path prefixes. Nothing is sorted."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + _quoted(root.rstrip("/")) + "/", "")
    out = raw.select(rel.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    out = out.where(~matches_any("path", exclude or []))
    if allow:
        out = out.where(F.exists(F.array(*[F.lit(a) for a in allow]), lambda a: F.startswith(F.col("path"), a)))
    return out


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in s)


def archiveable(files: DataFrame, exclude: list[str] | None = None, cap: int = SIZE_CAP) -> DataFrame:
    """Files worth archiving: not excluded, not over `cap` bytes, no NUL in the first 2 KiB, not blank. `text` has bad bytes replaced."""
    head = F.substring("content", 1, 2048)
    return (
        files.where(~matches_any("path", exclude or []) & (F.length("content") <= cap) & ~F.hex(head).rlike("^(?:..)*?00"))
        .withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
        .where(F.col("text").rlike(r"(?U)\S"))
    )


def build_archive(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, blobs) of (path, text): a content is stored once under the SHA-256 of its bytes."""
    h = texts.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    files = h.select(
        F.col("path").alias("file_path"), "content_hash", source_kind("path").alias("source_kind"), language_of("path").alias("language"), line_count("text").alias("total_lines"), F.octet_length("text").alias("size_bytes")
    )
    blobs = h.groupBy("content_hash").agg(F.any_value("text").alias("text"))
    return files, blobs


def _text(data: bytes | None) -> str | None:
    import gzip
    import zlib

    try:
        return gzip.decompress(data).decode("utf-8", "replace") if data is not None else None
    except (OSError, EOFError, ValueError, zlib.error):
        return None


def sound_blobs(blobs: DataFrame) -> DataFrame:
    """(content_hash in lower case, compressed_content): one readable stream for each content. Damaged streams are left out where they are read, so only sound ones, compressed, are shuffled."""

    @F.pandas_udf("boolean")
    def readable(c: pd.Series) -> pd.Series:
        return pd.Series([_text(x) is not None for x in c])

    some = blobs.where("content_hash is not null and compressed_content is not null").select(F.lower("content_hash").alias("content_hash"), "compressed_content")
    return some.where(readable("compressed_content")).groupBy("content_hash").agg(F.any_value("compressed_content").alias("compressed_content"))


def _inflated(df: DataFrame) -> DataFrame:
    """df with `text` in the place of compressed_content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=[_text(c) for c in pdf["compressed_content"]]).drop(columns="compressed_content")

    return df.mapInPandas(run, StructType([f for f in df.schema if f.name != "compressed_content"]).add("text", "string"))


def inflate(blobs: DataFrame) -> DataFrame:
    """(content_hash, text) of gzip contents, repeated rows once; contents that can't be read are left out."""
    return _inflated(sound_blobs(blobs))


def read_archive(files: DataFrame, contents: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Every path with its text; a content many paths share is joined to each, one that more than `most` share by salts."""
    f = files.withColumn("_h", F.lower("content_hash"))
    key = [c for c in files.columns if c != "content_hash"] or ["content_hash"]
    return salted_join(f, contents.withColumnRenamed("content_hash", "_h"), ["_h"], "inner", key, hot_keys(f.select("_h"), ["_h"], most)).drop("_h")


def read_texts(files: DataFrame, blobs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Every path with its text, as read_archive of inflated contents gives, but the contents are met compressed and inflated after the join, so that no inflated text is shuffled."""
    return _inflated(read_archive(files, sound_blobs(blobs), most))


def missing_blobs(files: DataFrame, blobs: DataFrame) -> DataFrame:
    have = blobs.select(F.lower("content_hash").alias("_h")).distinct()
    return files.withColumn("_h", F.lower("content_hash")).join(have, "_h", "left_anti").drop("_h")


def orphan_blobs(files: DataFrame, blobs: DataFrame) -> DataFrame:
    used = files.select(F.lower("content_hash").alias("_h")).distinct()
    return blobs.withColumn("_h", F.lower("content_hash")).join(used, "_h", "left_anti").drop("_h")


def apply_changes(files: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """files without the changed and deleted paths, and the changed rows in their new state."""
    gone = changed.select("file_path").unionByName(deleted.select("file_path")).distinct()
    return files.join(gone, "file_path", "left_anti").unionByName(changed)


def index_manifest(rows: DataFrame, part: str, key: str, text: str) -> DataFrame:
    """Of each part the number of records and a checksum that doesn't depend on their order: the sum of 60 bits of each record's SHA-256, as decimal."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\0", key, text).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(part).agg(F.count("*").alias("record_count"), F.sum(digest).cast("string").alias("checksum"))


def write_swapped(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write beside `path`, then put it in its place: readers see the old table or the new one."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(new)
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(conf)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    if fs.exists(p(old)):
        fs.delete(p(old), True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; lines that aren't JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    cols = sorted(df.columns)
    w = df.select(*cols).write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(partition_by) if partition_by else w).json(path)


def openapi_endpoints(specs: DataFrame, text: str = "text") -> DataFrame:
    """(method, path, summary, operation_id) of OpenAPI documents in JSON: the map of paths times the map of methods."""
    op = "struct<summary:string,operationId:string>"
    methods = F.explode(F.from_json(F.get_json_object(text, "$.paths"), f"map<string,map<string,{op}>>")).alias("path", "ops")
    return (
        specs.select(*[c for c in specs.columns if c != text], methods)
        .select("*", F.explode("ops").alias("m", "op"))
        .where(F.lower("m").isin("get", "post", "put", "patch", "delete", "head", "options"))
        .withColumns({"method": F.upper("m"), "summary": F.coalesce("op.summary", F.lit("")), "operation_id": F.coalesce("op.operationId", F.lit(""))})
        .drop("ops", "m", "op")
    )


def name_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status A, M or D) between two snapshots of (path, content_hash)."""
    a, b = old.select("path", F.col("content_hash").alias("_o")), new.select("path", F.col("content_hash").alias("_n"))
    status = F.when(F.col("_o").isNull(), "A").when(F.col("_n").isNull(), "D").when(F.col("_o") != F.col("_n"), "M")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def expand_renames(changes: DataFrame) -> DataFrame:
    """git's name-status rows (status, path, new_path, pos): a rename is a deletion and an addition, a copy an addition; the last entry of a path wins."""
    s = F.substring("status", 1, 1)
    rows = F.when(s == "R", F.array(F.struct(F.col("path"), F.lit("D").alias("st")), F.struct(F.col("new_path").alias("path"), F.lit("A").alias("st")))).when(s == "C", F.array(F.struct(F.col("new_path").alias("path"), F.lit("A").alias("st")))).otherwise(
        F.array(F.struct(F.col("path"), s.alias("st")))
    )
    return changes.select("pos", F.posexplode(rows).alias("sub", "r")).groupBy(F.col("r.path").alias("path")).agg(F.max_by("r.st", F.struct("pos", "sub")).alias("status"))


def json_cases(texts: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """Rows of JSON documents that are a list, or an object with the list under cases or results; other documents have none."""
    kind = f"array<struct<{schema}>>"
    whole = F.from_json(text, kind)
    rows = F.coalesce(F.from_json(F.get_json_object(text, "$.cases"), kind), F.from_json(F.get_json_object(text, "$.results"), kind), F.when(F.ltrim(F.col(text)).startswith("["), whole))
    return texts.select(*[c for c in texts.columns if c != text], F.explode(rows).alias("_r")).select("*", "_r.*").drop("_r")
