"""Ownership by token overlap, coverage, grouping and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_assign(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(item, grp, overlap): the group with the most tokens in common, ties to the smaller; items without any have none. items, groups: (id, tokens array). Joined on tokens: a
    token that many items and groups share costs the product of both, as the exact count needs, combined before the shuffle; drop such tokens before, where they say nothing."""
    i = items.select(F.col("id").alias("item"), F.explode(F.array_distinct("tokens")).alias("token"))
    g = groups.select(F.col("id").alias("grp"), F.explode(F.array_distinct("tokens")).alias("token"))
    n = i.join(g, "token").groupBy("item", "grp").agg(F.count("*").alias("overlap"))
    return n.groupBy("item").agg(F.min_by(F.struct("grp", "overlap"), F.struct(-F.col("overlap"), "grp")).alias("_b")).select("item", "_b.*")


def coverage(source: DataFrame, owned: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """source keys that are neither owned nor skipped."""
    return source.select(key).distinct().join(owned.select(key), key, "left_anti").join(skipped.select(key), key, "left_anti")


def coverage_rate(total: Column, covered: Column) -> Column:
    """Percent, 100 where there is nothing to cover."""
    return F.when(total == 0, F.lit(100.0)).otherwise(F.round(covered * 100.0 / total, 2))


def fold_small_groups(rows: DataFrame, group: str, least: int, rest: str = "misc") -> DataFrame:
    """rows with groups of under `least` rows renamed to `rest`."""
    small = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") < least).select(group, F.lit(True).alias("_s"))
    return rows.join(small, group, "left").withColumn(group, F.when(F.col("_s"), F.lit(rest)).otherwise(F.col(group))).drop("_s")


def merge_groups(rows: DataFrame, key: list[str], lists: list[str], scalars: list[str], order: list[str]) -> DataFrame:
    """One row for each key: lists united and sorted, of scalars the first that isn't empty."""
    agg = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists]
    agg += [F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.struct(*order))), F.lit("")).alias(c) for c in scalars]
    return rows.groupBy(*key).agg(*agg)


def duplicate_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(name, key, n) of every key that occurs more than once."""
    out = None
    for name, (df, key) in tables.items():
        one = df.groupBy(F.concat_ws("|", *key).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("name"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str, root: str, name: str) -> DataFrame:
    """Each path with the name of its longest root; '' if none. Every directory of a path is looked up by equality, so there is no join by prefix test."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = paths.select(path, F.explode(prefixes).alias(root))
    best = each.join(roots.select(root, name).dropDuplicates([root]), root).groupBy(path).agg(F.max_by(name, F.char_length(root)).alias(name))
    return paths.join(best, path, "left").withColumn(name, F.coalesce(name, F.lit("")))


def shared_owners(bridge: DataFrame, item: str, owner: str, most: int = 3) -> DataFrame:
    """(owner, item, n_owners, others): of each item an owner shares, how many own it, and the first `most` of the others. No pairs of owners are made."""
    b = bridge.select(item, owner).distinct()
    n = b.groupBy(item).agg(F.count("*").alias("n_owners")).where("n_owners > 1")
    ranked = b.withColumn("_n", F.row_number().over(Window.partitionBy(item).orderBy(owner))).where(F.col("_n") <= most + 1)
    first = ranked.groupBy(item).agg(F.array_sort(F.collect_list(owner)).alias("_o"))
    j = b.join(n, item).join(first, item)
    return j.select(owner, item, "n_owners", F.slice(F.filter("_o", lambda x: x != F.col(owner)), 1, most).alias("others"))
