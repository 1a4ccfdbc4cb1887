"""Merging, widening and cutting ranked hits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_hits(hits: DataFrame, query: str, key: list[str], score: str, tie: list[str]) -> DataFrame:
    """One row for each query and key, that with the best score (ties: first by `tie`)."""
    best = F.max_by(F.struct(*[c for c in hits.columns if c not in (query, *key)]), F.struct(F.col(score), *[-F.col(t) for t in tie]))
    return hits.groupBy(query, *key).agg(best.alias("_b")).select(query, *key, "_b.*")


def top_per_group(hits: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def reserve_and_fill(hits: DataFrame, query: str, order: list[Column], reserved: Column, n_reserved: int, k: int) -> DataFrame:
    """Up to n_reserved rows that meet `reserved` come first, the best of the others fill up to k."""
    by = Window.partitionBy(query, "_r").orderBy(*order)
    a = hits.withColumn("_r", F.coalesce(reserved, F.lit(False))).withColumn("_n", F.row_number().over(by))
    first = F.col("_r") & (F.col("_n") <= n_reserved)
    out = a.withColumn("is_reserved", first).withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("is_reserved"), *order)))
    return out.where(F.col("rank") <= k).drop("_r", "_n")


def balanced(hits: DataFrame, query: str, kind: str, kinds: list[str], order: list[Column], per_kind: int, k: int) -> DataFrame:
    """The first per_kind of each kind, kind by kind, then the rest in turns, up to k."""
    at = F.array_position(F.array(*[F.lit(x) for x in kinds]), F.col(kind))
    n = F.row_number().over(Window.partitionBy(query, kind).orderBy(*order))
    a = hits.where(F.col(kind).isin(kinds)).withColumn("_n", n).withColumn("_k", at)
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.when(F.col("_n") <= per_kind, 0).otherwise(1), F.when(F.col("_n") <= per_kind, F.col("_k")).otherwise(F.col("_n")), F.when(F.col("_n") <= per_kind, F.col("_n")).otherwise(F.col("_k"))))
    return a.withColumn("rank", rank).where(F.col("rank") <= k).drop("_n", "_k")


def expand_neighbours(hits: DataFrame, query: str, links: str, rows: DataFrame, file: str, per_file: int, order: list[str], damp: float = 0.05) -> DataFrame:
    """Rows of the files that hits link to, at most per_file of each file and query, scored a little under the best hit that links there."""
    wanted = hits.select(query, "score", F.explode(links).alias(file)).where(F.col(file) != "").groupBy(query, file).agg(F.max("score").alias("score"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(*order))).where(F.col("_n") <= per_file).drop("_n")
    return wanted.join(ranked, file).withColumn("score", F.greatest(F.lit(0.1), F.col("score") - damp))


def stitch(rows: DataFrame, group: list[str], order: list[str], hit: Column, reach: int = 1) -> DataFrame:
    """Rows within `reach` places of a hit in their group's order, with `distance` to the nearest hit. Two windows; no self-join."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    a = rows.withColumn("_n", n).withColumn("_h", F.when(hit, F.col("_n")))
    back = F.max("_h").over(Window.partitionBy(*group).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min("_h").over(Window.partitionBy(*group).orderBy("_n").rowsBetween(0, Window.unboundedFollowing))
    far = F.lit(1 << 30)
    d = F.least(F.coalesce(F.col("_n") - back, far), F.coalesce(ahead - F.col("_n"), far))
    return a.withColumn("distance", d).where(F.col("distance") <= reach).drop("_n", "_h")


def confidence_band(best: Column, mean: Column) -> Column:
    return F.when((best >= 0.7) & (mean >= 0.5), "high").when((best >= 0.5) & (mean >= 0.35), "medium").otherwise("low")


def out_of_domain(hits: DataFrame, query: str, cosine: str, strong: Column, least: float = 0.35) -> DataFrame:
    """Of each query its best score and whether it is out of domain: nothing near enough, and no strong hit."""
    return hits.groupBy(query).agg(F.max(cosine).alias("best"), F.avg(cosine).alias("mean"), F.bool_or(F.coalesce(strong, F.lit(False))).alias("strong")).withColumn("out_of_domain", (F.col("best") < least) & ~F.col("strong"))


def fits_budget(items: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Greedy in order: an item that doesn't fit into what is left is skipped, later smaller ones may still fit. Null sizes count 0. The items of a group come sorted and are taken one by
    one, so that a task holds a batch and one number, however long the group is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, left = None, budget
        for pdf in batches:
            take = []
            for k, n in zip(zip(*(pdf[g] for g in group)), pdf[size]):
                if k != key:
                    key, left = k, budget
                take.append(n <= left)
                left -= n if n <= left else 0
            yield pdf[take]

    rows = items.select(*group, *order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size)).where(F.col(size) <= budget)
    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, rows.schema)


def trim_budget(items: DataFrame, group: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Items in order until `budget` characters are used; the one that overflows is trimmed, the rest left out."""
    before = F.coalesce(F.sum(F.char_length(text)).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.where(F.col(text).isNotNull()).withColumn("_u", before).where(F.col("_u") < budget).withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("_u")).cast("int"))).drop("_u")


def first_seen_terms(hits: DataFrame, query: str, terms: str, order: list[Column], most_hits: int = 10, k: int = 3) -> DataFrame:
    """Follow-up terms of a query: the first k distinct ones of its best hits' arrays."""
    top = top_per_group(hits, [query], order, most_hits)
    each = top.select(query, "rank", F.posexplode(terms).alias("pos", "term")).where("term <> ''").groupBy(query, "term").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return each.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy("at", "term"))).where(F.col("n") <= k).select(query, "n", "term")
