"""Exact vector search by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l2_normalise(c: str) -> Column:
    """The vector over its length; a zero vector stays."""
    v = F.transform(F.col(c), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def vector_topk(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest rows (vec_id, embedding) by cosine for each query (query_id, embedding), itself excluded where ids are equal.

    Queries are sent to the tasks in blocks of a fixed number; each task keeps its k best for each query of a block, and one window ranks those. Scores have 6 decimals, ties go to the
    lower id. Null vectors are left out.
    """
    spark = rows.sparkSession
    data = rows.where("embedding is not null").select("vec_id", "embedding")
    out, part = None, []

    def search(part: list[tuple[int, list[float]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([q for q, _ in part]), _unit(np.array([v for _, v in part], np.float64))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for pdf in batches:
                if not len(pdf):
                    continue
                own = pdf["vec_id"].to_numpy()
                s = np.round(q @ _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64)).T, 6)
                s[ids[:, None] == own[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, axis=1)
                yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "vec_id": own[order.ravel()], "score": best.ravel()})[np.isfinite(best.ravel())]

        return data.mapInPandas(run, "query_id bigint, vec_id bigint, score double")

    for r in queries.where("embedding is not null").select("query_id", "embedding").toLocalIterator():
        part.append((r.query_id, r.embedding))
        if len(part) == block:
            out = search(part) if out is None else out.unionAll(search(part))
            part = []
    if part or out is None:
        one = search(part) if part else spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
        out = one if out is None else out.unionAll(one)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
