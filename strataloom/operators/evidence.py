"""Roll-ups of evidence, signals in contents, and repairing plans after changes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Signals in source text by rule.
SIGNALS = {
    "environment": r"(?:os\.environ(?:\.get)?[\[(]\s*['\"]|os\.getenv\(\s*['\"]|process\.env\.|getenv\(\s*['\"]|os\.Getenv\(\s*\"|\$\{)([A-Z][A-Z0-9_]{2,})",
    "logger": r"\b(log(?:ger)?\.(?:debug|info|warn|error)|log\.Printf|Log::(?:info|error))",
    "lock": r"\bwith\s+(\w+)\.lock\(",
    "event": r"\.(?:on|emit)\(\s*['\"](\w+)['\"]",
    "schedule": r"\b(cron|crontab|setInterval|schedule\.every)\b",
    "database": r"\b(SELECT|INSERT INTO|UPDATE|DELETE FROM)\s",
}


def signals(texts: DataFrame, key: str, text: str, rules: dict[str, str] = SIGNALS) -> DataFrame:
    """(key, signal, value, n) of every rule's first group, counted. A cheap test for the rule comes before the extraction."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.when(F.col(text).rlike(p), F.regexp_extract_all(text, F.lit(p), 1)).otherwise(F.array().cast("array<string>")).alias("v")) for s, p in rules.items()])).alias("s")
    return texts.select(key, each).select(key, "s.signal", F.explode("s.v").alias("value")).groupBy(key, "signal", "value").agg(F.count("*").alias("n"))


def signal_files(found: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Of each signal value the number of files and the first `most` of them. Only `most` names per group are kept while grouping."""
    n = found.groupBy("signal", "value").agg(F.count("*").alias("n_files"))
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("signal", "value").orderBy(key))).where(F.col("_n") <= most)
    return n.join(ranked.groupBy("signal", "value").agg(F.array_sort(F.collect_list(key)).alias("files")), ["signal", "value"])


def capped_lists(rows: DataFrame, group: list[str], kind: str, value: str, order: list[Column], caps: dict[str, int]) -> DataFrame:
    """A row for each group with one list for each kind, its first values up to the kind's cap."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    r = rows.where(F.col(kind).isin(*caps)).withColumn("_n", F.row_number().over(Window.partitionBy(*group, kind).orderBy(*order)))
    kept = r.where(F.col("_n") <= F.element_at(cap, F.col(kind)))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.struct("_n", value)))), lambda x: x[value]).alias(k) for k in caps]
    return kept.groupBy(*group).agg(*lists)


def primary_and_supporting(hits: DataFrame, group: str, file: str, score: str, n_primary: int = 4, n_supporting: int = 6) -> DataFrame:
    """Of each group its best files: the first n_primary are 'primary', the next n_supporting 'supporting'."""
    best = hits.groupBy(group, file).agg(F.max(score).alias("score"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), F.desc("n"), file))
    r = best.withColumn("rank", rank).where(F.col("rank") <= n_primary + n_supporting)
    return r.withColumn("role", F.when(F.col("rank") <= n_primary, "primary").otherwise("supporting"))


def first_links(rows: DataFrame, group: str, urls: str, titles: str, most: int = 5) -> DataFrame:
    """Of each group the first `most` distinct links with the first title of each."""
    pairs = rows.select(group, F.posexplode(F.arrays_zip(F.col(urls).alias("url"), F.col(titles).alias("title"))).alias("pos", "z")).select(group, "pos", "z.url", "z.title").where("url is not null and url <> ''")
    one = pairs.groupBy(group, "url").agg(F.min(F.struct("pos", F.coalesce("title", F.lit("")).alias("title"))).alias("m")).select(group, "url", "m.title", F.col("m.pos").alias("pos"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("pos", "url"))).where(F.col("rank") <= most).drop("pos")


def chain_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, target): files whose name without ending is one of the words of an imported module (file, module). By equality of words, not by substring test of all pairs."""
    words = imports.select("file", F.explode(F.split("module", r"[^A-Za-z0-9_]+")).alias("_w")).where("_w <> ''").distinct()
    stems = files.select(F.col("file").alias("target"), F.regexp_extract("file", r"([^/]+?)(?:\.\w+)?$", 1).alias("_w"))
    return words.join(stems, "_w").where("file <> target").select("file", "target").distinct()


def compose_prefixes(mounts: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(node, prefix) of every router: the prefixes of its parents, each with its own mount path appended, through mounts of any depth, or at most `most` where that is given; a way that comes back to a router it has passed ends there.
    mounts: parent, node, path; roots: node, prefix."""
    front = cut(roots.select("node", "prefix").distinct().withColumn("passed", F.array("node")))
    out = []
    while not front.isEmpty():
        out.append(front.select("node", "prefix"))
        if most is not None and len(out) > most:
            break
        joined = F.regexp_replace(F.concat("prefix", F.lit("/"), "path"), r"/{2,}", "/")
        met = front.withColumnRenamed("node", "parent").join(mounts.select("parent", "node", "path"), "parent").where(~F.array_contains("passed", F.col("node")))
        front = cut(met.select("node", joined.alias("prefix"), F.array_append("passed", F.col("node")).alias("passed")).distinct())
    return reduce(DataFrame.unionAll, out).distinct() if out else roots.select("node", "prefix").limit(0)


def resolve_constants(values: DataFrame) -> DataFrame:
    """(name, value): names that refer to other names (value '@other') followed to a literal, however far; null for cycles and dead ends. Each round doubles the way that is known, until no reference is left
    that leads on to another one than before."""
    cur = cut(values.select("name", "value").dropDuplicates(["name"]))
    before = -1
    while True:
        jump = cur.select(F.concat(F.lit("@"), "name").alias("value"), F.col("value").alias("_v"), F.lit(True).alias("_met"))
        is_ref = F.coalesce(F.col("value").startswith("@"), F.lit(False))
        # A name that leads to itself, or to nothing, has no literal.
        nxt = F.when(~is_ref, F.col("value")).when(F.col("_met") & (F.coalesce("_v", F.lit("")) != F.concat(F.lit("@"), "name")), F.col("_v"))
        cur = cut(cur.join(jump, "value", "left").select("name", nxt.alias("value")))
        left = cur.where(F.col("value").startswith("@"))
        n = left.count()
        # References that only cycles hold stay as many for ever: after as many doublings as the number of names has binary digits none else is left.
        before += 1
        if n == 0 or 2**before > cur.count():
            return cur.select("name", F.when(~F.col("value").startswith("@"), F.col("value")).alias("value"))


def remove_files(plans: DataFrame, owned: str, gone: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): plans without the gone files, and those left without any. Row by row through an exploded bridge; no list of all gone files is sent anywhere."""
    key = [c for c in plans.columns if c != owned]
    bridge = plans.select(*key, F.posexplode_outer(owned).alias("_i", file)).join(gone.select(file).distinct().withColumn("_g", F.lit(True)), file, "left")
    left = F.transform(F.array_sort(F.collect_list(F.when(F.col("_g").isNull() & F.col(file).isNotNull(), F.struct("_i", file)))), lambda x: x[file])
    out = bridge.groupBy(*key).agg(left.alias(owned), F.max("_g").alias("_touched"))
    lost = F.col("_touched").isNotNull() & (F.size(owned) == 0)
    return out.where(~lost).drop("_touched"), out.where(lost).drop("_touched")


def repair_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, json): the first JSON value in each text, without code fences, comments and trailing commas; null where there is none."""

    def first(s: str | None) -> str | None:
        import json
        import re

        if not s:
            return None
        dec = json.JSONDecoder()
        t = re.sub(r",\s*([}\]])", r"\1", re.sub(r"(?m)^\s*//.*$", "", s))
        for m in re.finditer(r"[\[{]", t):
            try:
                return json.dumps(dec.raw_decode(t, m.start())[0], sort_keys=True, ensure_ascii=False)
            except ValueError:
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "json": [first(x) for x in pdf[text]]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, json string")


def split_arguments(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, argument): the arguments of the first call in each text, split at top-level commas; strings and brackets are kept whole."""

    def parts(s: str | None) -> list[str]:
        a = (s or "").find("(")
        if a < 0:
            return []
        out, cur, depth, quote = [], "", 0, ""
        i = a + 1
        while i < len(s):
            c = s[i]
            if quote:
                cur += c
                if c == "\\":
                    cur += s[i + 1 : i + 2]
                    i += 1
                elif c == quote:
                    quote = ""
            elif c in "'\"`":
                quote, cur = c, cur + c
            elif c in "([{":
                depth, cur = depth + 1, cur + c
            elif c in ")]}":
                if depth == 0:
                    break
                depth, cur = depth - 1, cur + c
            elif c == "," and depth == 0:
                out.append(cur.strip())
                cur = ""
            else:
                cur += c
            i += 1
        return [x for x in [*out, cur.strip()] if x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, i, a) for k, s in zip(pdf[key], pdf[text]) for i, a in enumerate(parts(s), 1)], columns=[key, "pos", "argument"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, pos int, argument string")


def close_fences(c: str) -> Column:
    """Markdown whose last code fence is closed, with a language where a fence has none, and no space between ] and (."""
    x = F.regexp_replace(F.col(c), r"\]\s+\((https?:[^)\s]+)\)", "]($1)")
    odd = F.size(F.regexp_extract_all(x, F.lit(r"(?m)^(```)"), 1)) % 2 == 1
    return F.when(odd, F.concat(F.regexp_replace(x, r"\n\z", ""), F.lit("\n```\n"))).otherwise(x)


def notebook_cells(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cell_no, cell_type, source) of Jupyter notebooks; rows that are none have no cells."""
    cells = F.from_json(F.get_json_object(text, "$.cells"), "array<struct<cell_type:string,source:array<string>>>")
    return rows.select(key, F.posexplode(cells).alias("_i", "c")).select(key, (F.col("_i") + 1).alias("cell_no"), "c.cell_type", F.array_join("c.source", "").alias("source"))
