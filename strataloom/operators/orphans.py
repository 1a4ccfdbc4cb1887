"""References without a live target, and what hangs below them (problem 2).

A reference lives if its target has a version that began at or before the time of the referring row and hasn't
ended by then. References and target versions meet in one window over (key, day) in time order: no pairs are made, and a
key that holds a third of all rows is spread over its days. What earlier days left alive enters each day as one carried row.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, hot_keys, salted_join, table

FOREVER = "9999-12-31 00:00:00"
ZONE = r"([zZ]|[+-]\d{2}(:?\d{2})?)$"


def path_key(c: Column) -> Column:
    """A path without '#…', with '/' for '\\', without leading './' and '/'."""
    return F.regexp_replace(F.translate(F.regexp_replace(c, r"(?s)#.*$", ""), "\\", "/"), r"^(\./|/)+", "")


def hash_key(c: Column) -> Column:
    return F.lower(c)


def iso_time(c: Column) -> Column:
    """ISO-8601 with or without a zone (then UTC) as UTC wall clock without zone; null if blank or unreadable."""
    x = F.trim(c)
    clock = F.substring_index(x, "T", -1)
    x = F.when(clock.rlike(ZONE), x).otherwise(F.concat(x, F.lit("Z")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), x.try_cast("timestamp").cast("timestamp_ntz"))


def resolve(refs: DataFrame, targets: DataFrame, bin: str = "day") -> DataFrame:
    """refs (key, at, …) with the column `live`.

    targets: key, since, until (null: for ever). A target without key or since never counts; a reference without key or
    time is never live. Repeated references stay repeated, repeated targets count once; either side may be empty. Other columns of refs pass through
    whatever their names, but for one named live, which is replaced.
    """
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    bin_of = lambda c: F.date_trunc(bin, F.col(c)).cast("timestamp_ntz")
    known = targets.where("key is not null and since is not null").select(
        "key", ts("since").alias("since"), F.coalesce(ts("until"), F.lit(FOREVER).cast("timestamp_ntz")).alias("until")
    )
    # Of versions that end together only the earliest matters.
    known = known.groupBy("key", "until").agg(F.min("since").alias("since"))
    others = [F.col(f"`{c}`") for c in refs.columns if c not in ("key", "at", "live")]
    asked = refs.select("key", ts("at").alias("at"), F.struct(*others, F.lit(0).alias("__pad")).alias("p"))
    empty = F.lit(None).cast(asked.schema["p"].dataType).alias("p")
    bins = (
        known.select("key", bin_of("since").alias("bin"), "until")
        .unionByName(asked.where("key is not null and at is not null").select("key", bin_of("at").alias("bin"), none.alias("until")))
        .groupBy("key", "bin")
        .agg(F.max("until").alias("until"))
    )
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select("key", "bin", F.max("until").over(before).alias("until")).where("until > bin")
    rows = (
        asked.select("key", bin_of("at").alias("bin"), "at", F.lit(1).alias("kind"), none.alias("until"), "p")
        .unionByName(known.select("key", bin_of("since").alias("bin"), F.col("since").alias("at"), F.lit(0).alias("kind"), "until", empty))
        .unionByName(carried.select("key", "bin", F.col("bin").alias("at"), F.lit(0).alias("kind"), "until", empty))
    )
    so_far = Window.partitionBy("key", "bin").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alive = (F.max("until").over(so_far) > F.col("at")) & F.col("key").isNotNull()
    return rows.withColumn("live", F.coalesce(alive, F.lit(False))).where("kind = 1").select("key", "at", "p.*", "live").drop("__pad")


def cascade(links: DataFrame, dead: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(tab, key, depth) of every orphaned record: depth 0 for `dead` (tab, key), n for those whose nearest dead ancestor is n links up.

    links: child_table, child_key, parent_table, parent_key, for live references. Each round semi-joins the links with the records that
    the round before found and drops what is known, until nothing new comes; cycles end so too. What is known is one table, written together every 16 rounds, so that neither plans nor the files they read
    grow with the depth. A parent with over `most` children is salted.
    """
    links = cut(links.select("child_table", "child_key", "parent_table", "parent_key").distinct())
    hot = hot_keys(links, ["parent_table", "parent_key"], most)
    fresh = cut(dead.select("tab", "key").distinct().withColumn("depth", F.lit(0)))
    known, recent = fresh, []
    for depth in count(1):
        parents = fresh.select(F.col("tab").alias("parent_table"), F.col("key").alias("parent_key"))
        reached = salted_join(links, parents, ["parent_table", "parent_key"], "left_semi", ["child_table", "child_key"], hot)
        seen = reduce(DataFrame.unionByName, [known, *recent]).select("tab", "key")
        fresh = cut(
            reached.select(F.col("child_table").alias("tab"), F.col("child_key").alias("key"))
            .distinct()
            .join(seen, ["tab", "key"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        if fresh.isEmpty():
            break
        recent.append(fresh)
        if len(recent) >= 16:
            known, recent = cut(reduce(DataFrame.unionByName, [known, *recent])), []
    return reduce(DataFrame.unionByName, [known, *recent])


def find_orphans(refs: DataFrame, targets: DataFrame, most: int = 1_000_000) -> DataFrame:
    """refs with `status`: 'direct' (no live target), 'inherited' (its target lives but is itself an orphan, directly or not) or 'sound',
    and `depth`, the target's distance from the dead reference (null unless inherited).

    refs: child_table, child_key, parent_table, parent_key, at, …; targets: tab, key, since, until. Other columns pass through, but for those named as the
    ones added here. Null parents, keys and times are direct orphans; without references the result is empty, without targets all are direct.
    """
    refs = refs.drop("status", "depth", "live", "key", "_salt", "_salts")
    named = targets.select(F.struct("tab", "key").alias("key"), "since", "until")
    keyed = F.when(F.col("parent_key").isNotNull(), F.struct(F.col("parent_table").alias("tab"), F.col("parent_key").alias("key")))
    seen = cut(resolve(refs.withColumn("key", keyed), named.where("key.key is not null")).drop("key"))
    chain = ["child_table", "child_key", "parent_table", "parent_key"]
    dead = seen.where("not live").select(F.col("child_table").alias("tab"), F.col("child_key").alias("key"))
    # Only parents that hold references themselves can pass a death on.
    parents = refs.select(F.col("child_table").alias("parent_table")).distinct()
    links = seen.where("live").select(*chain).join(F.broadcast(parents), "parent_table", "left_semi")
    orphans = cascade(links, dead, most).select(F.col("tab").alias("parent_table"), F.col("key").alias("parent_key"), "depth")
    status = F.when(~F.col("live"), "direct").when(F.col("depth").isNotNull(), "inherited").otherwise("sound")
    hot = hot_keys(seen, ["parent_table", "parent_key"], most)
    joined = salted_join(seen, orphans, ["parent_table", "parent_key"], "left", ["child_key", "at"], hot)
    return joined.withColumn("status", status).withColumn("depth", F.when(F.col("live"), F.col("depth"))).drop("live")


def archive_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The references of files and chunks, and the records they may mean."""
    files, blobs, chunks, pages = (table(spark, sf_dir, t) for t in ("files", "blobs", "chunks", "ledger"))

    def of_chunks(field: str, target: str) -> DataFrame:
        return chunks.select("chunk_id", "indexed_at", F.explode(field).alias("ref_value")).select(
            F.lit(f"chunks.{field}").alias("ref_field"), F.col("chunk_id").alias("record_key"), "ref_value",
            F.lit("chunks").alias("child_table"), F.col("chunk_id").alias("child_key"),
            F.lit(target).alias("parent_table"), path_key(F.col("ref_value")).alias("parent_key"), F.col("indexed_at").alias("at"),
        )

    of_files = files.select(
        F.lit("files.content_hash").alias("ref_field"), F.col("file_path").alias("record_key"), F.col("content_hash").alias("ref_value"),
        F.lit("files").alias("child_table"), path_key(F.col("file_path")).alias("child_key"),
        F.lit("blobs").alias("parent_table"), hash_key(F.col("content_hash")).alias("parent_key"), F.col("archived_at").alias("at"),
    )
    refs = of_files.unionByName(of_chunks("owned_files", "files")).unionByName(of_chunks("related_doc_paths", "ledger"))
    targets = (
        blobs.select(F.lit("blobs").alias("tab"), hash_key(F.col("content_hash")).alias("key"), F.col("stored_at").alias("since"), F.col("deleted_at").alias("until"))
        .unionByName(files.select(F.lit("files").alias("tab"), path_key(F.col("file_path")).alias("key"), F.col("archived_at").alias("since"), F.col("deleted_at").alias("until")))
        .unionByName(pages.select(F.lit("ledger").alias("tab"), path_key(F.col("doc_path")).alias("key"), iso_time(F.col("generated_at")).alias("since"), F.col("retired_at").alias("until")))
    )
    return refs.where(F.col("ref_value").rlike(r"(?U)\S")), targets


def orphan_report(orphans: DataFrame) -> DataFrame:
    """References by field, month and status."""
    return orphans.groupBy("ref_field", F.date_format("at", "yyyy-MM").alias("period"), "status").agg(
        F.count("*").alias("n_refs"), F.countDistinct("record_key").alias("n_records")
    )
