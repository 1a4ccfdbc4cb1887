import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataloom.operators.lexical import bm25_topk
from strataloom.plans import retrieval
from strataloom.session import first_of_each, parted


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Tables in which every row has nearly all terms of every question: 400 documents, 20 of them questions, and 400 chunks."""
    d = str(tmp_path_factory.mktemp("alike"))
    docs = [(i, " ".join(["aa bb cc dd ee ff gg", "hh" * (i % 3), f"x{i}"]), ["code", "page", "readme"][i % 3]) for i in range(400)]
    spark.createDataFrame(docs, "doc_id bigint, text string, doc_kind string").write.parquet(f"{d}/documents.parquet")
    chunks = [(f"c{i}", "code", "code", f"a{i}.py", "t", docs[i][1], ["s"], 1, 2, [], i) for i in range(400)]
    schema = "chunk_id string, corpus string, kind string, file_path string, title string, text string, symbol_names array<string>, start_line int, end_line int, linked_file_paths array<string>, indexed_at bigint"
    spark.createDataFrame(chunks, schema).write.parquet(f"{d}/chunks.parquet")
    return d


def shuffled(spark) -> int:
    """Rows that all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["balanced_candidates", "bm25_search", "lexical_rescore", "hybrid_merge", "bm25_documents", "reserve_and_fill"])
def test_pairs_of_questions_and_rows_are_not_shuffled(spark, alike, name):
    before = shuffled(spark)
    assert retrieval.QUERIES[name](spark, alike).count() >= 100
    assert shuffled(spark) - before < 5_000  # there are 20 * 400 pairs in each list of questions


@pytest.mark.parametrize("block", [7, 32_768])
@pytest.mark.parametrize("k", [3, 50])
def test_bm25_equals_brute_force(spark, block, k):
    rng = random.Random(block + k)
    words = [f"w{i:02}" for i in range(12)]
    texts = {f"r{i:03}": " ".join(rng.choices(words[: rng.randint(1, 12)], k=rng.randint(0, 9))) for i in range(150)} | {"zz": None}
    asked = {(q, n): " ".join(rng.sample([*words, "none"], 4)) for q in range(9) for n in (1, 2)}
    bags = {r: Counter((t or "").split()) for r, t in texts.items()}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    want = {}
    for q, question in asked.items():
        scores = {}
        for r, b in bags.items():
            for t in {*question.split()} & {*b}:
                idf = max(math.log((len(bags) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6)
                scores[r] = scores.get(r, 0) + idf * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))
        for rank, (r, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k], 1):
            want[(*q, rank)] = (r, round(s, 6))
    rows = spark.createDataFrame(list(texts.items()), "k string, text string").repartition(5)
    queries = spark.createDataFrame([(*q, t) for q, t in asked.items()], "query_id int, n int, question string")
    got = bm25_topk(rows, ["k"], queries, k, {"text": 1.0}, by=["query_id", "n"], block=block).collect()
    assert {(x.query_id, x.n, x["rank"]): (x.k, x.score) for x in got} == want


def test_bm25_without_rows_or_questions(spark):
    rows = spark.createDataFrame([("a", "alpha")], "k string, text string")
    q = spark.createDataFrame([(1, "alpha")], "query_id int, question string")
    assert bm25_topk(rows.limit(0), ["k"], q, 3, {"text": 1.0}).count() == 0
    assert bm25_topk(rows, ["k"], q.limit(0), 3, {"text": 1.0}).count() == 0
    assert bm25_topk(rows, ["k"], q.selectExpr("query_id", "'?' as question"), 3, {"text": 1.0}).count() == 0


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """400 chunks with 10,000 characters of text each, of which two are there twice, and two questions."""
    d, rng = str(tmp_path_factory.mktemp("wide")), random.Random(1)
    docs = [(i, f"aa bb x{i}", "code") for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, doc_kind string").write.parquet(f"{d}/documents.parquet")
    chunks = [(f"c{i}", "code", "code", f"a{i}.py", "t", "aa " * (i % 40 == 0) + f"{rng.getrandbits(40_000):x}", ["s"], 1, 2, [], i) for i in range(400)]
    chunks += [(*chunks[i][:5], "bb late", *chunks[i][6:10], 900) for i in (3, 80)]
    schema = "chunk_id string, corpus string, kind string, file_path string, title string, text string, symbol_names array<string>, start_line int, end_line int, linked_file_paths array<string>, indexed_at bigint"
    spark.createDataFrame(chunks, schema).repartition(4).write.parquet(f"{d}/chunks.parquet")
    return d


def shuffled_bytes(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["bm25_search", "lexical_rescore"])
def test_texts_of_chunks_are_not_shuffled(spark, wide, name):
    before = shuffled_bytes(spark)
    got = {(x.query_id, x.chunk_id) for x in retrieval.QUERIES[name](spark, wide).collect()}
    assert got == {(q, f"c{i}") for q in (0, 20) for i in range(0, 400, 40)}  # "bb late" was indexed later than the first text of its chunk
    assert shuffled_bytes(spark) - before < 1_000_000  # all texts are 4 MB, in hexadecimal digits


def test_first_of_each_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *(f"k{i}" for i in range(300))]), i, f"v{i}") for i in rng.sample(range(10_000), 400)]
    want = {}
    for k, n, v in rows:
        want[k] = min(want.get(k, (n, v)), (n, v))
    got = first_of_each(spark.createDataFrame(rows, "k string, n int, v string").repartition(5), "k", ["n"]).collect()
    assert len(got) == len(want) and {x.k: (x.n, x.v) for x in got} == want


@pytest.mark.parametrize(("n", "most"), [(0, 10), (10, 10), (11, 10)])
def test_parted_gives_each_row_once(spark, n, most):
    ids = spark.range(1_000).select("id", F.xxhash64("id").alias("h"))
    a, b = ({x.id for x in part.collect()} for part in parted(ids, F.col("h"), ids.where(F.col("id") < n).select("h"), most))
    assert a == set(range(n if n <= most else 1_000)) and b == {*range(1_000)} - a


@pytest.fixture(scope="module")
def lettered(spark, tmp_path_factory):
    """40 documents and chunks of which two are questions with 1,200 terms each; row 7 has the last term of the first question and of its first half, row 8 that of the second."""
    d = str(tmp_path_factory.mktemp("lettered"))
    texts = {0: [*(f"a{i:04}" for i in range(600)), "yy", *(f"b{i:04}" for i in range(600)), "zz"], 20: [*(f"c{i:04}" for i in range(600)), "yyy", *(f"d{i:04}" for i in range(600)), "zzz"], 7: ["zz", "yy"], 8: ["zzz", "yyy"]}
    docs = [(i, " ".join(texts.get(i, [f"x{i}"])), "code") for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, doc_kind string").write.parquet(f"{d}/documents.parquet")
    chunks = [(f"c{i}", "code", "code", f"p{i}", "t", docs[i][1] if i % 20 else "", [], 1, 2, [], i) for i in range(40)]
    schema = "chunk_id string, corpus string, kind string, file_path string, title string, text string, symbol_names array<string>, start_line int, end_line int, linked_file_paths array<string>, indexed_at bigint"
    spark.createDataFrame(chunks, schema).write.parquet(f"{d}/chunks.parquet")
    return d


@pytest.mark.parametrize("name", ["bm25_documents", "bm25_search", "hybrid_merge", "lexical_rescore"])
def test_all_terms_of_a_question_count(spark, lettered, name):
    got = {(x.query_id, x[1]) for x in retrieval.QUERIES[name](spark, lettered).collect()}
    assert got == ({(0, "c7"), (20, "c8")} if name in ("bm25_search", "lexical_rescore") else {(0, 0), (0, 7), (20, 20), (20, 8)})
    if name == "lexical_rescore":  # "zz" is the 1,202nd term of its question
        assert {(x.query_id, x.score) for x in retrieval.lexical_rescore(spark, lettered).collect()} == {(0, 1.0), (20, 1.0)}


def test_bm25_of_long_questions_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i:03}" for i in range(200)]
    texts = {i: rng.choices(words, weights=[200 / (j + 1) ** 1.1 for j in range(200)], k=rng.randint(40, 120)) for i in range(300)}
    bags = {i: Counter(t) for i, t in texts.items()}
    mean, df = sum(map(len, texts.values())) / 300, Counter(t for b in bags.values() for t in b)
    assert sum(n > 150 for n in df.values()) > 5  # terms of the least weight
    want = {}
    for q in range(0, 300, 20):
        scores = {i: sum(max(math.log((300.5 - df[t]) / (df[t] + 0.5)), 1e-6) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * len(texts[i]) / mean)) for t in {*texts[q]} & {*b}) for i, b in bags.items()}
        for rank, (i, s) in enumerate(sorted(((i, round(s, 6)) for i, s in scores.items() if s), key=lambda x: (-x[1], x[0]))[:10], 1):
            want[q, rank] = (i, s)
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "k int, text string").repartition(5)
    queries = rows.where("k % 20 = 0").select(F.col("k").alias("query_id"), F.col("text").alias("question"))
    for more in ({}, {"block": 64}, {"lot": 150}):
        got = {(x.query_id, x["rank"]): (x.k, x.score) for x in bm25_topk(rows, ["k"], queries, 10, {"text": 1.0}, **more).collect()}
        assert {p: x[0] for p, x in got.items()} == {p: x[0] for p, x in want.items()} and all(abs(got[p][1] - want[p][1]) < 2e-6 for p in want)
