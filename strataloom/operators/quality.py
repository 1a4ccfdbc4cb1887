"""Scorecards, ledger and telemetry roll-ups, claims against known sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detail_averages(rows: DataFrame, details: str) -> DataFrame:
    """(metric, average) of a map column; a row without a metric counts 0 for it."""
    n = rows.agg(F.count("*").alias("_n"))
    return rows.select(F.explode(details).alias("metric", "value")).groupBy("metric").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("_s")).join(F.broadcast(n)).select("metric", F.round(F.col("_s") / F.col("_n"), 6).alias("average"))


def pass_rates(rows: DataFrame, score: str, marks: list[float], by: list[str] | None = None) -> DataFrame:
    rates = [F.round(F.avg((F.col(score) >= m).cast("double")), 6).alias(f"rate_{int(m)}") for m in marks]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), *rates)


def weighted_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """Sum of weight times part; a missing part counts 0."""
    return sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0))


def gates(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """(gate, value, threshold, passed) for each threshold, and 'all'."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("threshold")) for k, v in least.items()])).alias("g")
    rows = metrics.select(each).select("g.*").withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))
    total = rows.agg(F.lit("all").alias("gate"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), F.bool_and("passed").alias("passed"))
    return rows.unionByName(total)


def span_rollup(spans: DataFrame, by: list[str], duration: str, failed: Column) -> DataFrame:
    """Sum, count, failures and share of the whole of each span. The whole is one aggregated row, not a window over all."""
    s = spans.groupBy(*by).agg(F.sum(duration).alias("_d"), F.count("*").alias("n"), F.count_if(failed).alias("n_failed"))
    whole = spans.agg(F.sum(duration).alias("_t"))
    return s.join(F.broadcast(whole)).select(*by, F.round("_d", 4).alias("total"), "n", "n_failed", F.round(F.col("_d") / F.col("_t"), 6).alias("share"))


def versus_previous(runs: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """Each run with the change in percent from the one before; null for the first and after a zero."""
    prev = F.lag(value).over(Window.partitionBy(*part).orderBy(order))
    return runs.withColumn("previous", prev).withColumn("delta_pct", F.round(F.try_divide((F.col(value) - F.col("previous")) * 100.0, F.col("previous")), 4))


def rolling_rate(events: DataFrame, part: list[str], ts: str, seconds: int, value: str) -> DataFrame:
    """Count and sum of the rows of the `seconds` up to each row, itself included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*part).orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("_t", micros).withColumn("n_recent", F.count("*").over(w)).withColumn("sum_recent", F.round(F.sum(value).over(w), 4)).drop("_t")


def unknown_claims(claims: DataFrame, known: DataFrame, key: list[str], check: str, severity: str = "error") -> DataFrame:
    """Claims about things that aren't known, as violations of `check`."""
    return claims.join(known.select(*key).distinct(), key, "left_anti").withColumn("check", F.lit(check)).withColumn("severity", F.lit(severity))


def line_range_check(evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """Evidence (file_path, start_line, end_line) with its verdict: 'missing' file, 'out of range' lines, or 'accepted'."""
    j = evidence.join(catalog.select("file_path", "total_lines"), "file_path", "left")
    ok = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.col("total_lines"))
    return j.withColumn("verdict", F.when(F.col("total_lines").isNull(), "missing").when(F.coalesce(ok, F.lit(False)), "accepted").otherwise("out of range")).drop("total_lines")
