"""Lexical retrieval: postings, BM25 over weighted fields, additive term scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import terms
from ..session import cut

#: Weight of each field of a row; a term in several fields counts the sum.
FIELDS = {"file_path": 5.0, "title": 3.0, "symbols": 2.0, "text": 1.0}
K1, B = 1.2, 0.75


#: Least weight of a term, that of one which half of the rows have.
LEAST_IDF = 1e-6


def fts_terms(c: Column, most: int | None = None) -> Column:
    """The distinct terms of a question in alphabetical order; with `most` the first of them only."""
    all_terms = F.array_sort(F.array_distinct(terms(c)))
    return all_terms if most is None else F.slice(all_terms, 1, most)


def spans(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each first to before its end, one after the other."""
    n = end - first
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def bags(rows: DataFrame, key: list[str], fields: dict[str, float] = FIELDS) -> DataFrame:
    """(key, n_tokens, bag): every token of every field of a row, with its field's weight."""

    def weighted(field: str, w: float) -> Column:
        return F.transform(terms(F.coalesce(F.col(field).cast("string"), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w")))

    return rows.select(*key, reduce(F.concat, [weighted(f, w) for f, w in fields.items()]).alias("bag")).withColumn("n_tokens", F.size("bag"))


def postings(bag: DataFrame, key: list[str], asked: pa.Array, exact: bool = False) -> DataFrame:
    """(key, n_tokens, terms, tf): for each row the places in `asked` of the terms that it has, and their summed weights (`exact`: these are whole numbers, so half the bytes hold them). Made where the row is; nothing is shuffled."""
    sent = bag.sparkSession.sparkContext.broadcast(asked)
    schema = StructType([*bag.select(*key, "n_tokens").schema, *StructType.fromDDL(f"terms array<int>, tf array<{'float' if exact else 'double'}>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms = max(1, len(sent.value))
        for b in batches:
            col = b.column("bag")
            flat = col.flatten()
            term = pc.index_in(pc.struct_field(flat, "term"), value_set=sent.value).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), col.value_lengths().to_numpy(zero_copy_only=False))
            at = np.flatnonzero(term >= 0)
            cell, back = np.unique(row[at] * n_terms + term[at], return_inverse=True)
            tf = np.bincount(back, weights=pc.struct_field(flat, "w").to_numpy(zero_copy_only=False)[at], minlength=len(cell))
            ends = pa.array(np.searchsorted(cell, np.arange(b.num_rows + 1) * n_terms), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((cell % n_terms).astype(np.int32), tf.astype(np.float32 if exact else np.float64))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*key, "n_tokens")), *lists], names=schema.names)

    return bag.select(*key, "n_tokens", "bag").mapInArrow(run, schema)


def best_rows(post: DataFrame, key: list[str], asked: pa.Table, by: list[str], ids: StructType, idf: np.ndarray, avg_len: float, k: int, block: int) -> DataFrame:
    """(by, key, score) of the k best rows of each query in each partition of post, which is in order of key. asked: by, and the places of the query's terms.

    A task scores all queries against a block of rows at a time (`block` rows, or fewer with some 2 million postings) and keeps of each query the k best rows so far, so neither the pairs of
    queries and rows nor the postings of more than a block are ever held, written or sent. A query has as hits the rows with one of its terms at least; ties go to the row that comes first.
    Sums over common terms are first made in single precision and without the terms of the least weight, which move a score by a few millionths; the rows that can be among the best by these,
    given all that the sums may be off, are summed exactly.
    """
    sent = post.sparkSession.sparkContext.broadcast((asked, idf))
    schema = StructType([*ids, *post.select(*key).schema, *StructType.fromDDL("score double")])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n, size = [], 0, 0
        for b in batches:
            held.append(b)
            n, size = n + b.num_rows, size + len(b.column("terms").flatten())
            if n >= block or size >= 2_000_000:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, size = [], 0, 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = sent.value
        places = queries.column("terms").combine_chunks()
        wanted = np.split(places.flatten().to_numpy(), np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(places) else []
        best = np.zeros((len(wanted), k))
        place = np.zeros((len(wanted), k), np.int64)
        have = np.zeros(len(wanted), np.int64)
        keys, begin = [], 0
        for t in blocks(batches):
            n = t.num_rows
            keys.append(t.select(key))
            lists, tf = t.column("terms").combine_chunks(), t.column("tf").combine_chunks().flatten().to_numpy().astype(np.float64)
            term = lists.flatten().to_numpy()
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            part = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * t.column("n_tokens").to_numpy()[row] / avg_len))
            order = np.argsort(term, kind="stable")
            row, part = row[order], part[order]
            ends = np.searchsorted(term[order], np.arange(len(weight) + 1))
            common = np.flatnonzero(np.diff(ends) > n // 8)  # such a term has a number for every row
            common = common[np.argsort(weight[common] <= LEAST_IDF, kind="stable")]
            least = np.count_nonzero(weight[common] > LEAST_IDF)  # from here on they are of the least weight
            full = np.zeros((len(common), n))
            for i, x in enumerate(common.tolist()):
                full[i, row[ends[x] : ends[x + 1]]] = part[ends[x] : ends[x + 1]]
            where = np.full(len(weight), -1)
            where[common] = np.arange(len(common))
            about, some = full[:least].astype(np.float32), np.zeros((min(128, len(wanted)), least), np.float32)
            for q, own in enumerate(wanted):
                if q % 128 == 0:
                    some.fill(0)
                    for i, x in enumerate(wanted[q : q + 128]):
                        x = where[x]
                        some[i, x[(x >= 0) & (x < least)]] = 1
                    near = some @ about
                x = where[own]
                rare, x = own[x < 0], x[x >= 0]
                at = spans(ends[rare], ends[rare + 1])
                total = np.bincount(row[at], part[at], n).astype(np.float64, copy=False)  # of no postings it makes integers
                close = total + near[q % 128]
                h, width = int(have[q]), n // (8 * k)
                # What single precision, the terms of the least weight and rounding can make of a difference; below the bound less that no row can be among the best.
                slack = (len(own) + 8) * 2.4e-7 * close.max() + np.count_nonzero(x >= least) * LEAST_IDF * (K1 + 1) + 2e-6
                bound = best[q, k - 1] if h == k else 0
                if h < k and width:  # k groups of rows have a row at least as good
                    bound = np.partition(close[: width * 8 * k].reshape(width, -1).max(axis=0), -k)[-k]
                at = np.flatnonzero(close >= bound - slack)
                total = total[at] + full[np.ix_(x, at)].sum(axis=0)
                at, total = at[total > 0], total[total > 0]
                score = np.floor(total * 1e6 + 0.5) / 1e6
                if h == k:
                    better = score > best[q, k - 1]
                    at, score = at[better], score[better]
                elif len(at) > k:
                    good = score >= np.partition(score, -k)[-k]
                    at, score = at[good], score[good]
                if not len(at):
                    continue
                score, at = np.concatenate((best[q, :h], score)), np.concatenate((place[q, :h], at + begin))
                first = np.argsort(-score, kind="stable")[:k]
                have[q] = h = len(first)
                best[q, :h], place[q, :h] = score[first], at[first]
            begin += n
        if not keys:
            return
        named = pa.concat_tables(keys)
        for a in range(0, len(wanted), step := max(1, 50_000 // k)):
            q, r = np.nonzero(np.arange(k) < have[a : a + step, None])
            q += a
            found = [*queries.select(by).take(pa.array(q)).columns, *named.take(pa.array(place[q, r])).columns, pa.array(best[q, r])]
            yield from pa.Table.from_arrays(found, names=schema.names).combine_chunks().to_batches()

    return post.mapInArrow(run, schema)


def bm25_topk(rows: DataFrame, key: list[str], queries: DataFrame, k: int = 10, fields: dict[str, float] = FIELDS, most_terms: int | None = None, by: list[str] | None = None, block: int = 32_768, lot: int = 5_000_000) -> DataFrame:
    """(query_id, key, score, rank) of the k best rows of each query (query_id, question). key names each row once, `by` (default query_id) each query. All terms of a question count, unless `most_terms` says otherwise.

    Statistics are of all rows. One reading of the texts writes each row's length and its postings of asked terms into the shared folder, as lengths, document frequencies and scores all
    need them. The questions' terms are sent to all tasks, in lots of about `lot` terms; a task gives its k best rows of each query, and one window ranks those (`block`: see best_rows). Rows
    without any text count as rows of length 0.
    """
    by = by or ["query_id"]
    spark = rows.sparkSession
    told = cut(queries.select(*by, fts_terms(F.col("question"), most_terms).alias("terms")))
    ids = told.select(*by).schema
    asked = told.select(F.explode("terms").alias("term")).distinct().toArrow().column("term").combine_chunks().sort()
    lots = -(-(told.agg(F.sum(F.size("terms"))).first()[0] or 1) // lot)

    exact = all(float(w).is_integer() for w in fields.values())
    post = cut(postings(bags(rows, key, fields), key, asked, exact))
    n, avg_len = post.agg(F.count("*"), F.avg("n_tokens")).first()
    df = np.zeros(len(asked))
    for x in post.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[x.term] = x["count"]
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)
    tasks = max(min(2 * spark.sparkContext.defaultParallelism, -(-n // 4096)), -(-n // (1 << 20)), 1)
    post = post.repartition(tasks, *key).sortWithinPartitions(*key)
    post = post if lots == 1 else cut(post)

    def scored(some: DataFrame) -> DataFrame:
        t = some.toArrow()
        words = t.column("terms").combine_chunks()
        places = pa.ListArray.from_arrays(words.offsets, pc.index_in(words.flatten(), value_set=asked)) if len(words) else pa.array([], pa.list_(pa.int32()))
        return best_rows(post, key, t.select(by).append_column("terms", places), by, ids, idf, avg_len, k, block)

    found = reduce(DataFrame.unionAll, [scored(told.where(F.pmod(F.xxhash64(*by), F.lit(lots)) == i)) for i in range(lots)])
    order = Window.partitionBy(*by).orderBy(F.desc("score"), *key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_score(question_terms: Column, hay: dict[str, tuple[Column, float]]) -> Column:
    """Sum over the terms of the weights of the haystacks that contain them as a substring."""
    def one(t: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.contains(h, t), F.lit(w)).otherwise(F.lit(0.0)) for h, w in hay.values()])

    return F.aggregate(question_terms, F.lit(0.0), lambda acc, t: acc + one(t))
