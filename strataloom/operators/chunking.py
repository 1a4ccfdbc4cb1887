"""Texts to overlapping windows, sections, context lines and slices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..functions.text import line_array


def _starts(n: Column, size: int, overlap: int) -> Column:
    """Offsets of windows over n lines: the last is the first that reaches the end."""
    step = max(size - overlap, 1)
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)


def line_windows(df: DataFrame, text: str, keys: list[str], size: int = 120, overlap: int = 20, strategy: str = "window") -> DataFrame:
    """keys, strategy, start_line, end_line (from 1) and text of each window of `size` lines that overlaps the one before by `overlap`. Null and empty texts have none."""
    lines = df.select(*keys, line_array(text).alias("_l")).where(F.size("_l") > 0)
    out = lines.select(*keys, F.size("_l").alias("_n"), "_l", F.explode(_starts(F.size("_l"), size, overlap)).alias("_s"))
    end = F.least(F.col("_s") + size, F.col("_n"))
    return out.select(*keys, F.lit(strategy).alias("strategy"), (F.col("_s") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_l", F.col("_s") + 1, end - F.col("_s")), "\n").alias("text"))


def range_windows(df: DataFrame, text: str, keys: list[str], ranges: str, size: int = 120, overlap: int = 20) -> DataFrame:
    """Windows inside each of the line ranges array<struct<start_line,end_line,name>>; ranges that are empty or outside the text are dropped, long ones split."""
    lines = df.select(*keys, line_array(text).alias("_l"), F.explode(ranges).alias("_r"))
    a, b = F.greatest(F.col("_r.start_line"), F.lit(1)), F.least(F.col("_r.end_line"), F.size("_l"))
    cut_ = lines.select(*keys, F.col("_r.name").alias("name"), a.alias("_a"), b.alias("_b"), "_l").where("_a <= _b")
    out = cut_.select("*", F.explode(_starts(F.col("_b") - F.col("_a") + 1, size, overlap)).alias("_s"))
    s = F.col("_a") + F.col("_s")
    e = F.least(s + size - 1, F.col("_b"))
    return out.select(*keys, "name", s.alias("start_line"), e.alias("end_line"), F.array_join(F.slice("_l", s, e - s + 1), "\n").alias("text"))


def drop_overlaps(df: DataFrame, keys: list[str], most: float = 0.5, weight: str | None = None) -> DataFrame:
    """Of each key the ranges that remain when, in order of start, a range that shares over `most` of the shorter one with the last kept range is dropped; if its `weight`
    (say, the number of its symbols) is greater, it takes that range's place. The comparison is with the last *kept* range, hence a fold and not a window."""
    w = F.col(weight).cast("int") if weight else F.lit(0)
    one = df.select(*keys, F.struct(F.col("start_line").cast("int").alias("a"), F.col("end_line").cast("int").alias("b"), w.alias("w")).alias("x"))
    # Where a range starts behind all before it, the scan starts anew: islands are folded apart, so no array holds more than ranges that hang together.
    order = Window.partitionBy(*keys).orderBy("x")
    reach = F.max("x.b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = one.withColumn("_new", F.coalesce((F.col("x.a") > reach).cast("int"), F.lit(1)))
    islands = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = islands.groupBy(*keys, "_i").agg(F.array_sort(F.collect_list("x")).alias("r"))

    def keep(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        shared = F.least(last["b"], x["b"]) - F.greatest(last["a"], x["a"]) + 1
        shorter = F.least(last["b"] - last["a"], x["b"] - x["a"]) + 1
        clash = (F.size(acc) > 0) & (shared > shorter * F.lit(most))
        swapped = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))
        return F.when(~clash, F.concat(acc, F.array(x))).when(x["w"] > last["w"], swapped).otherwise(acc)

    start = F.array().cast("array<struct<a:int,b:int,w:int>>")
    folded = rows.withColumn("r", F.when(F.size("r") == 0, start).otherwise(F.aggregate(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 1, 1), keep)))
    return folded.select(*keys, F.explode("r").alias("x")).select(*keys, F.col("x.a").alias("start_line"), F.col("x.b").alias("end_line"), F.col("x.w").alias("weight"))


def numbered_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(line_array(text)).alias("_p", "line")).withColumn("line_no", F.col("_p") + 1).drop("_p")


def grep(df: DataFrame, text: str, keys: list[str], pattern: str, most: int | None = None) -> DataFrame:
    """keys, line_no and line of the lines that match, without regard to letter case; with `most`, the first of all by key and line."""
    hits = numbered_lines(df.where(F.col(text).rlike(f"(?i){pattern}")), text, keys).where(F.col("line").rlike(f"(?i){pattern}"))
    return hits.orderBy(*keys, "line_no").limit(most) if most else hits


def context_windows(df: DataFrame, text: str, keys: list[str], pattern: str, context: int = 12, per_key: int = 3) -> DataFrame:
    """Around the first `per_key` matching lines of each text, `context` lines on either side."""
    lines = df.select(*keys, line_array(text).alias("_l")).where(F.size("_l") > 0)
    at = F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: F.element_at("_l", i).rlike(f"(?i){pattern}"))
    hits = lines.select(*keys, "_l", F.explode(F.slice(at, 1, per_key)).alias("line_no"))
    a, b = F.greatest(F.col("line_no") - context, F.lit(1)), F.least(F.col("line_no") + context, F.size("_l"))
    return hits.select(*keys, "line_no", a.alias("start_line"), b.alias("end_line"), F.array_join(F.slice("_l", a, b - a + 1), "\n").alias("text"))


def read_slice(df: DataFrame, text: str, keys: list[str], start: str, end: str) -> DataFrame:
    """Lines start..end of each text, cut to what there is; '' if nothing."""
    lines = line_array(text)
    a, b = F.greatest(F.col(start), F.lit(1)), F.least(F.col(end), F.size(lines))
    return df.select(*keys, F.when(a <= b, F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n")).otherwise("").alias("text"))


_FENCE, _HEAD, _TITLE = re.compile(r"\s{0,3}(```|~~~)"), re.compile(r"#{1,6} +\S"), re.compile(r"^#+\s*|\s*#*\s*$")


def sections_of(text: str) -> list[tuple]:
    """(section_no, level, title, body, start_line, end_line) of a Markdown text."""
    lines = text[:-1].split("\n") if text.endswith("\n") else text.split("\n") if text else []
    out, fenced, start, head, body, no = [], False, 1, "", [], 0

    def close(end: int) -> None:
        if end >= start:
            out.append((no, len(head) - len(head.lstrip("#")), _TITLE.sub("", head), "\n".join(body).strip(" "), start, end))

    for i, line in enumerate(lines, 1):
        if _FENCE.match(line):
            fenced = not fenced
        if not fenced and _HEAD.match(line):
            close(i - 1)
            no, start, head, body = no + 1, i, line, []
        else:
            body.append(line)
    close(len(lines))
    return out


def markdown_sections(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Sections of Markdown texts: section_no (0 before the first heading), level, title and body. Headings inside fenced blocks are no headings. A text is read in its row, without a shuffle."""
    cols = ["section_no", "level", "title", "body", "start_line", "end_line"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [sections_of(t) if t is not None else [] for t in pdf["_t"]]
            rows = pdf[keys].loc[pdf.index.repeat([len(x) for x in found])].reset_index(drop=True)
            yield pd.concat([rows, pd.DataFrame([y for x in found for y in x], columns=cols)], axis=1)

    some = df.select(*keys, F.col(text).alias("_t"))
    schema = StructType([some.schema[k] for k in keys])
    for c in cols:
        schema = schema.add(c, StringType() if c in ("title", "body") else IntegerType())
    return some.mapInPandas(run, schema)


def symbol_ends(symbols: DataFrame, keys: list[str], total: str) -> DataFrame:
    """end_line of symbols that have none (0): the line before the next symbol of the file, the last line for the last."""
    w = Window.partitionBy(*keys).orderBy("start_line", "name")
    nxt = F.lead("start_line").over(w)
    return symbols.withColumn("end_line", F.when(F.col("end_line") > 0, F.col("end_line")).otherwise(F.greatest(F.coalesce(nxt - 1, F.col(total)), F.col("start_line"))))


def split_sections(df: DataFrame, text: str, keys: list[str], limit: int) -> DataFrame:
    """(keys, part, n_parts, text): texts cut at paragraphs, else lines, else characters, and packed in order into parts of at most `limit` characters. Put together without white space
    between paragraphs, the parts are the text."""
    hard = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(x) / limit) - 1, F.lit(0)).cast("int")), lambda i: F.substring(x, i * limit + 1, F.lit(limit)))
    lines = lambda p: F.when(F.char_length(p) <= limit, F.array(p)).otherwise(F.flatten(F.transform(F.split(p, "\n"), hard)))
    bits = F.filter(F.flatten(F.transform(F.split(F.col(text), r"\n\s*\n"), lines)), lambda x: F.trim(x) != "")

    def pack(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last, F.lit("\n\n"), x)
        fits = (F.size(acc) > 0) & (F.char_length(joined) <= limit)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    some = df.select(*keys, bits.alias("_b")).where(F.size("_b") > 0)
    parts = some.select(*keys, F.aggregate(F.slice("_b", 2, F.greatest(F.size("_b") - 1, F.lit(1))), F.slice("_b", 1, 1), pack).alias("_p"))
    return parts.select(*keys, F.size("_p").alias("n_parts"), F.posexplode("_p").alias("_i", "text")).select(*keys, (F.col("_i") + 1).alias("part"), "n_parts", "text")
