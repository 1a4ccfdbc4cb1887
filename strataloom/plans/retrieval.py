"""Queries over retrieval rows: windows, search, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import source_kind, trust_score
from ..functions.text import STOPWORDS, content_hash, file_references, line_count, token_estimate, token_set
from ..operators import chunking, hybrid
from ..operators.lexical import bm25_topk, fts_terms, lexical_score
from ..operators.vector import vector_topk
from ..session import cut, first_of_each, parted, table

_PAT = "checkpoint|snapshot"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chunk_id: the first indexed."""
    c = table(spark, d, "chunks").select("chunk_id", "corpus", "kind", "file_path", "title", "text", "symbol_names", "start_line", "end_line", "linked_file_paths", "indexed_at")
    return first_of_each(c, "chunk_id", ["indexed_at", "file_path", "start_line", "end_line", "corpus"])


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose id is divisible by 20 is a question."""
    return table(spark, d, "documents").where("doc_id % 20 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))


def bm25_search(spark, d):
    rows = _chunks(spark, d).select("chunk_id", "file_path", "title", F.array_join("symbol_names", " ").alias("symbols"), "text")
    return bm25_topk(rows, ["chunk_id"], _questions(spark, d), 10)


def _bm25_plain(spark, d, k=20, most_terms=8):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return bm25_topk(rows, ["doc_id"], _questions(spark, d), k, {"text": 1.0}, most_terms)


def bm25_documents(spark, d):
    return _bm25_plain(spark, d, 10, None)


def lexical_rescore(spark, d):
    """BM25 candidates scored anew by the terms that path, title and text contain. Rows that are no candidate are left out before the join moves texts; each text is put in lower case once."""
    rows = _chunks(spark, d).select("chunk_id", "file_path", "title", F.array_join("symbol_names", " ").alias("symbols"), "text")
    q = _questions(spark, d)
    hits = cut(bm25_topk(rows, ["chunk_id"], q, 10).select("query_id", "chunk_id"))
    h = F.xxhash64("chunk_id")
    low = parted(rows, h, hits.select(h))[0].select("chunk_id", F.lower("file_path").alias("p"), F.lower("title").alias("t"), F.lower("text").alias("x"))
    asked = q.select("query_id", fts_terms(F.col("question")).alias("terms"))
    score = lexical_score(F.col("terms"), {"p": (F.col("p"), 2.0), "t": (F.col("t"), 1.5), "x": (F.col("x"), 0.5)})
    return hits.join(low, "chunk_id").join(asked, "query_id").select("query_id", "chunk_id", score.alias("score"))


def vector_search(spark, d):
    e = table(spark, d, "embeddings")
    return vector_topk(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


def vector_label_vote(spark, d):
    """Of each query the best label among its hits by summed score, with a confidence band and an out-of-domain mark."""
    e = table(spark, d, "embeddings")
    hits = vector_search(spark, d).join(e.select("vec_id", "label"), "vec_id")
    gate = hybrid.out_of_domain(hits, "query_id", "score", F.lit(False)).withColumn("band", hybrid.confidence_band(F.col("best"), F.col("mean")))
    votes = hits.groupBy("query_id", "label").agg(F.sum("score").alias("v"))
    top = votes.groupBy("query_id").agg(F.max_by("label", F.struct(F.round("v", 6), -F.col("label"))).alias("label"))
    return top.join(gate.select("query_id", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"), "out_of_domain", "band"), "query_id")


def hybrid_merge(spark, d):
    """BM25 hits of the whole question and of its first half, the better score for each document."""
    q = _questions(spark, d)
    half = q.select("query_id", F.substring("question", F.lit(1), (F.char_length("question") / 2).cast("int")).alias("question"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    lists = q.withColumn("list_no", F.lit(1)).unionByName(half.withColumn("list_no", F.lit(2)))
    hits = bm25_topk(rows, ["doc_id"], lists, 20, {"text": 1.0}, by=["query_id", "list_no"])
    return hybrid.merge_hits(hits, "query_id", ["doc_id"], "score", ["list_no", "rank"]).select("query_id", "doc_id", "score", "list_no")


def reserve_and_fill(spark, d):
    hits = _bm25_plain(spark, d).join(table(spark, d, "documents").select("doc_id", "doc_kind"), "doc_id").drop("rank")
    return hybrid.reserve_and_fill(hits, "query_id", [F.desc("score"), F.col("doc_id")], F.col("doc_kind") == "code", 2, 5).select("query_id", "doc_id", "score", "is_reserved", "rank")


def balanced_candidates(spark, d):
    hits = _bm25_plain(spark, d).join(table(spark, d, "documents").select("doc_id", "doc_kind"), "doc_id").drop("rank")
    return hybrid.balanced(hits, "query_id", "doc_kind", ["code", "page", "readme", "answer"], [F.desc("score"), F.col("doc_id")], 2, 12).select("query_id", "doc_id", "doc_kind", "score", "rank")


def neighbour_expand(spark, d):
    """Chunks of the files that evidence points to, two of each file."""
    e = table(spark, d, "evidence_items").where("file_path <> ''").select("answer_id", F.col("confidence").alias("score"), F.array("file_path").alias("links"))
    c = _chunks(spark, d).where("kind = 'code' and file_path <> ''").select("chunk_id", "file_path", "start_line")
    return hybrid.expand_neighbours(e, "answer_id", "links", c, "file_path", 2, ["start_line", "chunk_id"]).select("answer_id", "chunk_id", "file_path", F.round("score", 6).alias("score"))


def stitch_adjacent(spark, d):
    """Code chunks next to one that mentions a checkpoint, in file order."""
    c = _chunks(spark, d).where("corpus = 'code' and file_path <> ''").select("chunk_id", "file_path", "start_line", "end_line", F.contains(F.lower("text"), F.lit("checkpoint")).alias("hit"))
    return hybrid.stitch(c, ["file_path"], ["start_line", "end_line", "chunk_id"], F.col("hit"), 1).select("chunk_id", "file_path", "distance")


def prompt_budget(spark, d):
    """Evidence of each answer that fits 300 estimated tokens, most confident first."""
    e = table(spark, d, "evidence_items").select("answer_id", "id", "confidence", "snippet").dropDuplicates(["answer_id", "id"])
    items = e.select("answer_id", (-F.col("confidence")).alias("neg"), "id", token_estimate(F.coalesce("snippet", F.lit(""))).alias("n_tokens"))
    return hybrid.fits_budget(items, ["answer_id"], ["neg", "id"], "n_tokens", 300).select("answer_id", "id", "n_tokens")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "path", "doc_kind").where("text is not null")


def line_windows(spark, d):
    return chunking.line_windows(_docs(spark, d), "text", ["doc_id"], 12, 3).select("doc_id", F.col("start_line"), F.col("end_line"), "text")


def symbol_windows(spark, d):
    """Windows of 8 lines over every range that evidence shows, in the text of its chunk's file rows."""
    c = _chunks(spark, d).where("start_line > 0 and end_line > 0").select("chunk_id", "text", F.array(F.struct(F.lit(2).alias("start_line"), (F.col("end_line") - F.col("start_line") + 3).alias("end_line"), F.lit("body").alias("name"))).alias("ranges"))
    return chunking.range_windows(c, "text", ["chunk_id"], "ranges", 30, 5).select("chunk_id", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"))


def overlap_dedupe(spark, d):
    """Ranges shown of each file after dropping those that mostly repeat the one before."""
    e = table(spark, d, "evidence_items").where("file_path <> '' and start_line > 0 and end_line >= start_line").select("file_path", "start_line", "end_line", F.size("symbol_names").alias("w")).distinct()
    return chunking.drop_overlaps(e, ["file_path"], 0.5, "w")


def grep_lines(spark, d):
    return chunking.grep(_docs(spark, d), "text", ["doc_id"], _PAT).select("doc_id", "line_no", "line")


def context_windows(spark, d):
    return chunking.context_windows(_docs(spark, d), "text", ["doc_id"], _PAT, 2, 3)


def read_slices(spark, d):
    c = _chunks(spark, d).select("chunk_id", "text", F.lit(3).alias("a"), F.lit(9).alias("b"))
    return chunking.read_slice(c, "text", ["chunk_id"], "a", "b")


def markdown_sections(spark, d):
    return chunking.markdown_sections(_docs(spark, d).where("doc_kind in ('page', 'readme')"), "text", ["doc_id"]).select("doc_id", "section_no", "level", "title", "start_line", "end_line")


def text_facts(spark, d):
    """Hash, lines, tokens and estimate of each document."""
    return _docs(spark, d).select("doc_id", content_hash("text").alias("content_hash"), line_count("text").alias("n_lines"), F.size(token_set("text")).alias("n_tokens"), token_estimate("text").alias("estimate"))


def token_document_frequency(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(token_set("text")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def path_facts(spark, d):
    """Kind and trust of every path in the archive."""
    f = table(spark, d, "files").select("file_path").distinct()
    return f.select("file_path", source_kind("file_path").alias("kind"), F.round(trust_score(source_kind("file_path")), 3).alias("trust"))


def file_mentions(spark, d):
    """Files that a document names in backticks, with or without a line."""
    return _docs(spark, d).select("doc_id", F.explode(file_references("text")).alias("file_path"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search, bm25_documents, lexical_rescore, vector_search, vector_label_vote, hybrid_merge, reserve_and_fill, balanced_candidates, neighbour_expand, stitch_adjacent, prompt_budget,
        line_windows, symbol_windows, overlap_dedupe, grep_lines, context_windows, read_slices, markdown_sections, text_facts, token_document_frequency, path_facts, file_mentions,
    )
}
# The same queries in SQL.
_C = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at, file_path, start_line, end_line, corpus) AS rn FROM chunks) WHERE rn = 1)"


def _terms(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '([\p{{L}}\p{{N}}_]+)', 1), lambda t: length(t) >= 2)"


def _lines(x: str) -> str:
    return rf"CASE WHEN {x} = '' THEN [] ELSE string_split(regexp_replace({x}, '\n\z', ''), chr(10)) END"


def _bm25(parts: str, k: int, question: str = "text", name: str = "hits", most: int | None = 8) -> str:
    """CTEs down to `name`; parts gives (key, term, w) rows of all fields. most: so many terms of a question only."""
    asked = f"list_distinct({_terms(question)})" if most is None else f"list_slice(list_sort(list_distinct({_terms(question)})), 1, {most})"
    return f"""q{name} AS (SELECT DISTINCT doc_id AS query_id, unnest({asked}) AS term FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
p{name} AS ({parts}), l{name} AS (SELECT key, count(*) AS n_tokens FROM p{name} GROUP BY key),
s{name} AS (SELECT (SELECT count(*) FROM keys) AS n, (SELECT count(*) FROM p{name}) / (SELECT count(*) FROM keys)::DOUBLE AS avg_len),
t{name} AS (SELECT p.key, p.term, sum(p.w) AS tf, max(n_tokens) AS n_tokens FROM p{name} p JOIN l{name} l ON l.key = p.key WHERE p.term IN (SELECT term FROM q{name}) GROUP BY 1, 2),
d{name} AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 0.000001) AS idf, max(avg_len) AS avg_len FROM t{name}, s{name} GROUP BY term, n),
r{name} AS (SELECT query_id, key, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_len))), 6) AS score
  FROM q{name} q JOIN t{name} t ON t.term = q.term JOIN d{name} d ON d.term = q.term GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM r{name}) WHERE rank <= {k})"""


_CHUNK_PARTS = (
    f"SELECT chunk_id AS key, unnest({_terms('file_path')}) AS term, 5.0::DOUBLE AS w FROM c UNION ALL SELECT chunk_id, unnest({_terms('title')}), 3.0 FROM c "
    f"UNION ALL SELECT chunk_id, unnest({_terms(chr(34) + 'symbols' + chr(34))}), 2.0 FROM (SELECT chunk_id, array_to_string(symbol_names, ' ') AS symbols FROM c) "
    f"UNION ALL SELECT chunk_id, unnest({_terms('text')}), 1.0 FROM c"
)
_DOC_KEYS = "keys AS (SELECT doc_id AS key FROM documents WHERE text IS NOT NULL)"
_DOC_PARTS = f"SELECT doc_id AS key, unnest({_terms('text')}) AS term, 1.0::DOUBLE AS w FROM documents WHERE text IS NOT NULL"
_CHUNK_HITS = f"WITH {_C}, keys AS (SELECT chunk_id AS key FROM c), {_bm25(_CHUNK_PARTS, 10, most=None)}"
_DOC_HITS = f"WITH {_DOC_KEYS}, {_bm25(_DOC_PARTS, 20)}"
_KINDS_SQL = (
    "CASE WHEN regexp_matches(lower(file_path), '(^|/)(__generated__|generated|gen|dist|build)/|\\.min\\.|_pb2?\\.') THEN 'generated' WHEN regexp_matches(lower(file_path), '(^|/)(vendor|third_party|node_modules|bower_components|external)/') THEN 'vendor' "
    "WHEN regexp_matches(lower(file_path), '(^|/)(tests?|spec|__tests__)/|(^|/)test_|[._](test|spec)\\.') THEN 'test' WHEN regexp_matches(lower(file_path), '(^|/)(examples?|samples?|demo)/') THEN 'example' "
    "WHEN regexp_matches(lower(file_path), '(^|/)docs?/|\\.(md|mdx|rst)$') THEN 'docs' WHEN regexp_matches(lower(file_path), '(^|/)(deploy|ops|infra|helm|\\.github)/|(^|/)dockerfile') THEN 'ops' "
    "WHEN regexp_matches(lower(file_path), '(^|/)(scripts?|tools?|bin)/') THEN 'tooling' WHEN regexp_matches(lower(file_path), '(^|/)config/|\\.(json|ya?ml|toml|ini|env)$') THEN 'config' ELSE 'core' END"
)
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = rf"list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '([a-z0-9_+\-]+)', 1), lambda t: regexp_replace(t, '^[_\-+]+|[_\-+]+$', '', 'g')), lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], t)))"
_VEC = """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM u),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v) / (CASE WHEN a.len = 0 THEN 1 ELSE a.len END * CASE WHEN b.len = 0 THEN 1 ELSE b.len END), 6) AS score
  FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10)"""

ORACLES = {
    "bm25_search": _CHUNK_HITS + " SELECT query_id, key AS chunk_id, score, rank FROM hits",
    "bm25_documents": f"WITH {_DOC_KEYS}, {_bm25(_DOC_PARTS, 10, most=None)} SELECT query_id, key AS doc_id, score, rank FROM hits",
    "lexical_rescore": _CHUNK_HITS
    + f""", asked AS (SELECT doc_id AS query_id, unnest(list_distinct({_terms('text')})) AS term FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL)
SELECT h.query_id, c.chunk_id, coalesce(sum(CASE WHEN contains(lower(c.file_path), term) THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(c.title), term) THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(c.text), term) THEN 0.5 ELSE 0 END), 0)::DOUBLE AS score
FROM hits h JOIN c ON c.chunk_id = h.key JOIN asked a ON a.query_id = h.query_id GROUP BY 1, 2""",
    "vector_search": _VEC + " SELECT query_id, vec_id, score, rank FROM hits",
    "vector_label_vote": _VEC
    + """, v AS (SELECT query_id, e.label, round(sum(score), 6) AS v FROM hits h JOIN embeddings e ON e.vec_id = h.vec_id GROUP BY 1, 2),
t AS (SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, label) AS rn FROM v) WHERE rn = 1),
g AS (SELECT query_id, max(score) AS b, avg(score) AS m FROM hits GROUP BY 1)
SELECT t.query_id, t.label, round(b, 6) AS best, round(m, 6) AS mean, b < 0.35 AS out_of_domain,
  CASE WHEN b >= 0.7 AND m >= 0.5 THEN 'high' WHEN b >= 0.5 AND m >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM t JOIN g ON g.query_id = t.query_id""",
    "hybrid_merge": f"WITH {_DOC_KEYS}, {_bm25(_DOC_PARTS, 20, most=None)}, {_bm25(_DOC_PARTS, 20, 'substr(text, 1, length(text) // 2)', 'half', None)}"
    + """, u AS (SELECT query_id, key, score, rank, 1 AS list_no FROM hits UNION ALL SELECT query_id, key, score, rank, 2 FROM half)
SELECT query_id, key AS doc_id, score, list_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, list_no, rank) AS rn FROM u) WHERE rn = 1""",
    "reserve_and_fill": _DOC_HITS
    + """, a AS (SELECT query_id, key AS doc_id, score, doc_kind = 'code' AS r FROM hits h JOIN documents d ON d.doc_id = h.key),
b AS (SELECT *, r AND row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, doc_id) <= 2 AS is_reserved FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_reserved DESC, score DESC, doc_id) AS rank FROM b)
SELECT query_id, doc_id, score, is_reserved, rank FROM f WHERE rank <= 5""",
    "balanced_candidates": _DOC_HITS
    + """, a AS (SELECT query_id, key AS doc_id, doc_kind, score, list_position(['code', 'page', 'readme', 'answer'], doc_kind) AS k FROM hits h JOIN documents d ON d.doc_id = h.key WHERE doc_kind IN ('code', 'page', 'readme', 'answer')),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_kind ORDER BY score DESC, doc_id) AS n FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n > 2, CASE WHEN n <= 2 THEN k ELSE n END, CASE WHEN n <= 2 THEN n ELSE k END) AS rank FROM b)
SELECT query_id, doc_id, doc_kind, score, rank FROM f WHERE rank <= 12""",
    "neighbour_expand": f"""WITH {_C}, e AS (SELECT answer_id, file_path, max(confidence) AS score FROM evidence_items WHERE file_path <> '' GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT chunk_id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_id) AS n FROM c WHERE kind = 'code' AND file_path <> '') WHERE n <= 2)
SELECT answer_id, chunk_id, e.file_path, round(greatest(0.1, score - 0.05), 6) AS score FROM e JOIN r ON r.file_path = e.file_path""",
    "stitch_adjacent": f"""WITH {_C}, a AS (SELECT chunk_id, file_path, contains(lower(text), 'checkpoint') AS hit, row_number() OVER (PARTITION BY file_path ORDER BY start_line, end_line, chunk_id) AS n
  FROM c WHERE corpus = 'code' AND file_path <> '')
SELECT a.chunk_id, a.file_path, min(abs(a.n - b.n)) AS distance FROM a JOIN a b ON a.file_path = b.file_path AND b.hit GROUP BY 1, 2 HAVING min(abs(a.n - b.n)) <= 1""",
    "prompt_budget": """WITH RECURSIVE e AS (SELECT DISTINCT answer_id, id, confidence, greatest(1, ceil(length(coalesce(snippet, '')) / 3.0))::INT AS n FROM evidence_items),
t AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY -confidence NULLS FIRST, id) AS rn FROM e),
w AS (SELECT answer_id, rn, id, n, n <= 300 AS ok, CASE WHEN n <= 300 THEN 300 - n ELSE 300 END AS room FROM t WHERE rn = 1
  UNION ALL SELECT t.answer_id, t.rn, t.id, t.n, t.n <= w.room, CASE WHEN t.n <= w.room THEN w.room - t.n ELSE w.room END FROM w JOIN t ON t.answer_id = w.answer_id AND t.rn = w.rn + 1)
SELECT answer_id, id, n::BIGINT AS n_tokens FROM w WHERE ok""",
    "line_windows": f"""WITH d AS (SELECT doc_id, {_lines('text')} AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, l, len(l) AS n, unnest(range(0, ceil(greatest(len(l) - 12, 0) / 9.0)::BIGINT + 1)) * 9 AS s FROM d WHERE len(l) > 0)
SELECT doc_id, s + 1 AS start_line, least(s + 12, n) AS end_line, array_to_string(list_slice(l, s + 1, least(s + 12, n)), chr(10)) AS text FROM s""",
    "symbol_windows": f"""WITH {_C}, d AS (SELECT chunk_id, {_lines('text')} AS l, 2 AS a, least(end_line - start_line + 3, len({_lines('text')})) AS b FROM c WHERE start_line > 0 AND end_line > 0),
s AS (SELECT chunk_id, l, a, b, unnest(range(0, ceil(greatest(b - a + 1 - 30, 0) / 25.0)::BIGINT + 1)) * 25 AS o FROM d WHERE a <= b)
SELECT chunk_id, a + o AS start_line, least(a + o + 29, b) AS end_line, sha256(array_to_string(list_slice(l, a + o, least(a + o + 29, b)), chr(10))) AS text_hash FROM s""",
    "grep_lines": f"""WITH d AS (SELECT doc_id, {_lines('text')} AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM d)
SELECT doc_id, line_no, line FROM x WHERE regexp_matches(line, '(?i)checkpoint|snapshot')""",
    "context_windows": f"""WITH d AS (SELECT doc_id, {_lines('text')} AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, l, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM d),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM x WHERE regexp_matches(line, '(?i)checkpoint|snapshot'))
SELECT doc_id, line_no, greatest(line_no - 2, 1) AS start_line, least(line_no + 2, len(l)) AS end_line, array_to_string(list_slice(l, greatest(line_no - 2, 1), least(line_no + 2, len(l))), chr(10)) AS text FROM h WHERE n <= 3""",
    "read_slices": f"WITH {_C}, d AS (SELECT chunk_id, {_lines('text')} AS l FROM c) SELECT chunk_id, coalesce(array_to_string(list_slice(l, 3, 9), chr(10)), '') AS text FROM d",
    "markdown_sections": f"""WITH d AS (SELECT doc_id, {_lines('text')} AS l FROM documents WHERE text IS NOT NULL AND doc_kind IN ('page', 'readme')), x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM d),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s{{0,3}}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM x),
h AS (SELECT *, fences % 2 = 0 AND regexp_matches(line, '^#{{1,6}} +\\S') AS is_head FROM f), s AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM h)
SELECT doc_id, section_no, coalesce(max(CASE WHEN is_head THEN length(regexp_extract(line, '^(#+)', 1)) END), 0) AS level,
  coalesce(max(CASE WHEN is_head THEN regexp_replace(line, '^#+\\s*|\\s*#*\\s*$', '', 'g') END), '') AS title, min(line_no) AS start_line, max(line_no) AS end_line FROM s GROUP BY 1, 2""",
    "text_facts": f"""SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, len({_lines('text')}) AS n_lines, len({_TOKENS}) AS n_tokens, greatest(1, ceil(length(text) / 3.0))::BIGINT AS estimate FROM documents WHERE text IS NOT NULL""",
    "token_document_frequency": f"SELECT token, count(*) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "path_facts": f"""SELECT file_path, kind, round(greatest(0.1, 1.0 - CASE WHEN kind IN ('test', 'example', 'docs', 'tooling', 'ops') THEN 0.2 WHEN kind IN ('generated', 'vendor') THEN 0.35 ELSE 0 END
  - CASE WHEN kind IN ('generated', 'vendor', 'test') THEN 0.35 ELSE 0 END), 3)::DOUBLE AS trust FROM (SELECT DISTINCT file_path, {_KINDS_SQL} AS kind FROM files)""",
    "file_mentions": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '`([\\w./\\-]+\\.[A-Za-z0-9]+)(?::\\d+)?`', 1)) AS file_path FROM documents WHERE text IS NOT NULL",
}
