"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strataloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, in local mode (as in tests) a temporary folder is made and removed at exit; a
    cluster uses a folder in its warehouse, if that lies in a shared store, and is refused if it doesn't."""
    jsc = spark.sparkContext._jsc.sc()
    have = jsc.getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            named = tempfile.mkdtemp(prefix="strataloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        else:
            home = spark.conf.get("spark.sql.warehouse.dir")
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share: its warehouse lies on a single one")
            named = home.rstrip("/") + "/_strataloom"
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder and go on from there; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hashes of their keys. All but about that many are filtered out where they are, so that no task and no driver gathers `most`
    rows of every partition."""
    n = df.count()
    space = 1 << 30
    h = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(space))
    some = df.where(h < int(space * most / n)) if n > most else df
    return some.orderBy(h, *keys).limit(most)


def parted(df: DataFrame, h: Column, hashes: DataFrame, most: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """df's rows whose 64-bit hash h is in the single column of `hashes`, and the other rows; nothing of df is shuffled. As the hashes are broadcast, with over `most` of them all rows are in the first
    part. Hashes may meet, so an exact join or grouping of the first part has to follow."""
    held = cut(hashes.toDF("_h").distinct())
    if held.count() > most:
        return df, df.where(F.lit(False))
    a = df.withColumn("_h", h)
    return tuple(a.join(F.broadcast(held), "_h", how).drop("_h") for how in ("left_semi", "left_anti"))


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the first row by `order`. Rows whose key occurs once stay where they are; only those that may have another (see parted) are shuffled."""
    h, rest = F.xxhash64(key), [c for c in df.columns if c != key]
    again, once = parted(df, h, df.groupBy(h.alias("_h")).count().where("count > 1").select("_h"))
    first = again.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
    return once.select(first.columns).unionByName(first)


def hot_keys(df: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame | None:
    """(keys, _salts) of the keys with over `most` rows, None if there are none. The count is combined before the shuffle; at most rows / most keys can be hot."""
    hot = cut(df.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("_salts")))
    return None if hot.isEmpty() else hot


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: list[str], hot: DataFrame | None) -> DataFrame:
    """left join right (how: inner, left, left_semi or left_anti) where one key may hold a great part of left's rows: a key of `hot` (see hot_keys) is spread over its salts by a
    hash of the columns `spread`, and right's rows of that key are repeated for each; only the hot keys are broadcast. Rows with a null key are spread as well. Without hot keys it is a plain join."""
    if hot is None:
        return left.join(right, keys, how)
    n = F.coalesce("_salts", F.lit(1))
    null = F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True)
    salt = F.pmod(F.xxhash64(*spread), F.when(null, F.lit(256)).otherwise(n)).cast("int")
    a = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    b = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
