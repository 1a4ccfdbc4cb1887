"""Keeping derived tables up to date: what is stale, and merging what is fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stale_pages(pages: DataFrame, tracked: DataFrame, current: DataFrame) -> DataFrame:
    """(slug, reason) of pages to build anew: 'failed', or 'changed' or 'deleted' for a tracked file (slug, path, hash) whose hash isn't the current (path, hash) one."""
    t = tracked.join(current.select("path", F.col("hash").alias("_now")), "path", "left")
    state = t.groupBy("slug").agg(F.bool_or(F.col("_now").isNull()).alias("deleted"), F.bool_or(F.col("_now") != F.col("hash")).alias("changed"))
    reason = F.when(~F.coalesce("success", F.lit(False)), "failed").when(F.col("deleted"), "deleted").when(F.col("changed"), "changed")
    return pages.select("slug", "success").join(state, "slug", "left").select("slug", reason.alias("reason")).where("reason is not null")


def merge_records(old: DataFrame, fresh: DataFrame, gone: DataFrame, source_key: str) -> DataFrame:
    """old rows whose source neither changed nor went, and the fresh ones. `reused` says which were kept, with whatever was computed for them."""
    touched = fresh.select(source_key).unionByName(gone.select(source_key)).distinct()
    return old.join(touched, source_key, "left_anti").withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))


def replace_slice(old: DataFrame, fresh: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """fresh rows inside the scope of keys, old rows outside it."""
    return old.join(scope.select(key).distinct(), key, "left_anti").unionByName(fresh.join(scope.select(key).distinct(), key, "left_semi"))


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, hash, doc_paths): the same hash unites the lists, another one starts anew."""
    j = old.select("path", F.col("hash").alias("_h"), F.col("doc_paths").alias("_d")).join(new, "path", "full_outer")
    docs = F.when(F.col("hash").isNull(), F.array_sort("_d")).when(F.col("hash") == F.col("_h"), F.array_sort(F.array_union("_d", "doc_paths"))).otherwise(F.array_sort(F.array_distinct("doc_paths")))
    return j.select("path", F.coalesce("hash", "_h").alias("hash"), docs.alias("doc_paths"))


def keep_last_good(runs: DataFrame, key: list[str], order: list[str], ok: Column) -> DataFrame:
    """One row for each key: the last good one, else the last. A maximum, so nothing is sorted."""
    rest = [c for c in runs.columns if c not in key]
    return runs.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(ok, F.lit(False)), *order)).alias("_r")).select(*key, "_r.*")


def set_once(old: DataFrame, new: DataFrame, key: list[str], once: list[str]) -> DataFrame:
    """Upsert in which the columns of `once` keep their first value and the others take the newest."""
    rest = [c for c in old.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_old"))
    n = new.select(*key, *rest, F.lit(True).alias("_new"))
    pick = [(F.coalesce(f"_{c}", c) if c in once else F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_{c}"))).alias(c) for c in rest]
    return o.join(n, key, "full_outer").select(*key, *pick)


def semantic_changes(old: DataFrame, new: DataFrame, key: list[str], fingerprint: list[str]) -> DataFrame:
    """(key, change): added, removed or changed rows, compared by the sorted set of their fingerprints."""
    def prints(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.array_sort(F.collect_set(F.concat_ws("\0", *fingerprint))).alias(name))

    j = prints(old, "_o").join(prints(new, "_n"), key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
    return j.select(*key, change.alias("change")).where("change is not null")


def strategy(n_added: Column, n_modified: Column, n_deleted: Column, structural: Column) -> Column:
    """What to do about a change set: nothing, build what is stale, or plan anew."""
    return F.when(n_added + n_modified + n_deleted == 0, "noop").when(structural, "targeted_replan").otherwise("incremental")


def prune(rows: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    return rows.join(planned.select(key).distinct(), key, "left_semi")
