"""Queries over links between files, pages and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_test
from ..functions.text import jaccard, token_set
from ..operators import graph, planning
from ..operators.orphans import path_key
from ..session import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    """From the file that a relationship row is about to its neighbours."""
    c = table(spark, d, "chunks").where("kind = 'relationship'").select(path_key(F.try_element_at("owned_files", F.lit(1))).alias("src"), F.explode("owned_files").alias("l"))
    return c.select("src", path_key(F.col("l")).alias("dst")).where("trim(src) <> '' and trim(dst) <> '' and src <> dst").distinct()


def _entries(links):
    return links.where(F.col("src").rlike("/(scripts|tests|examples)/")).select(F.col("src").alias("node")).distinct()


def _nodes(links):
    return links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()


def _supply(spark, d):
    """Edges between suppliers: from each to the one that its part's number falls on."""
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    e = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    return e.join(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), (F.pmod("l_partkey", "n") + 1).alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line_no"))


def file_degrees(spark, d):
    return graph.degrees(_links(spark, d))


def supply_degrees(spark, d):
    return graph.degrees(_supply(spark, d))


def edge_dedupe(spark, d):
    """The first edge between two suppliers."""
    return graph.first_edges(_supply(spark, d), ["src", "dst"], ["ord", "line_no", "kind"]).select("src", "dst", "kind")


def edge_kinds(spark, d):
    """Edges out of each supplier by kind."""
    return _supply(spark, d).groupBy("src").pivot("kind", ["A", "N", "R"]).count().fillna(0).select("src", F.col("A").alias("n_a"), F.col("N").alias("n_n"), F.col("R").alias("n_r"))


def foundational_files(spark, d):
    return graph.foundational(graph.degrees(_links(spark, d)), 0.05, 2).select("node", "in_degree")


def call_depth(spark, d):
    """Steps from the nearest script, test or example to each file, 999 where none leads there."""
    links = _links(spark, d)
    return graph.with_unreached(_nodes(links), graph.depths(links, _entries(links)))


def execution_chain(spark, d):
    links = _links(spark, d)
    return graph.execution_chain(links, _entries(links), 4)


def _labelled(links, most=4):
    return graph.propagate_labels(links, _entries(links).withColumn("label", F.col("node")), most)


def label_clusters(spark, d):
    return _labelled(_links(spark, d))


def cluster_rollup(spark, d):
    links = _links(spark, d)
    return graph.rollup_clusters(_labelled(links), graph.degrees(links))


def orphan_attach(spark, d):
    """Files that no label reached within one step, given to the label they are linked to most."""
    links = _links(spark, d)
    return graph.attach_orphans(_nodes(links), _labelled(links, 1), links.withColumn("weight", F.when(is_test("src"), 0.5).otherwise(2.0)))


def cluster_density(spark, d):
    links = _links(spark, d)
    return graph.cluster_links(links, _labelled(links))


def _page_files(spark, d):
    return table(spark, d, "ledger").select("slug", F.explode(F.map_keys("file_hashes")).alias("file")).distinct()


def scope_closure(spark, d):
    """Pages and files that hang together with the files archived in December."""
    start = table(spark, d, "files").where("archived_at >= timestamp_ntz'2025-12-01'").select(F.col("file_path").alias("item"))
    return graph.closure(_page_files(spark, d).select(F.col("slug").alias("grp"), F.col("file").alias("item")), start)


def reachable_within(spark, d):
    """What a file links to in at most 3 steps, with the distance."""
    return graph.ancestors(_links(spark, d), 3)


def similar_pages(spark, d):
    """Pairs of pages whose files overlap by 0.6 or more."""
    return graph.flow_pairs(_page_files(spark, d).select(F.col("slug").alias("flow"), "file"), 0.6)


def shared_file_pages(spark, d):
    """Files that several pages cover, with the first three other pages."""
    return planning.shared_owners(_page_files(spark, d), "file", "slug")


def token_overlap_assign(spark, d):
    """Of each document the test item with the most tokens in common."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), token_set("text").alias("tokens"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), token_set("text").alias("tokens"))
    return planning.overlap_assign(docs, items).select(F.col("item").alias("doc_id"), F.col("grp").alias("item_id"), "overlap")


def title_similarity(spark, d):
    """Jaccard of a page's title and section tokens, 1 where both are empty."""
    return table(spark, d, "ledger").select("slug", "title", "section").distinct().select("slug", "title", F.round(jaccard(token_set("title"), token_set("section")), 6).alias("similarity"))


def coverage_gaps(spark, d):
    """Archived files that no page covers, tests left out."""
    files = table(spark, d, "files").select(F.col("file_path").alias("file"))
    return planning.coverage(files, _page_files(spark, d), files.where(is_test("file")), "file")


def coverage_by_repo(spark, d):
    files = table(spark, d, "files").select("repo", F.col("file_path").alias("file")).distinct()
    have = _page_files(spark, d).select("file").distinct().withColumn("_c", F.lit(1))
    g = files.join(have, "file", "left").groupBy("repo").agg(F.count("*").alias("n_files"), F.count("_c").alias("n_covered"))
    return g.withColumn("percent", planning.coverage_rate(F.col("n_files"), F.col("n_covered")))


def folded_languages(spark, d):
    """Files by language, languages of under 12 files together."""
    f = table(spark, d, "files").select("file_path", F.lower(F.trim("language")).alias("lang")).distinct()
    return planning.fold_small_groups(f, "lang", 12).groupBy("lang").agg(F.count("*").alias("n_files"))


def merged_evidence(spark, d):
    """Evidence by answer and file: symbols united, the first title and reason that say something."""
    e = table(spark, d, "evidence_items").select("answer_id", "file_path", "symbol_names", "title", "reason", "id")
    return planning.merge_groups(e, ["answer_id", "file_path"], ["symbol_names"], ["title", "reason"], ["id"])


def duplicate_keys(spark, d):
    p = table(spark, d, "ledger")
    return planning.duplicate_keys({"slug": (p, ["slug"]), "doc_path": (p, ["doc_path"]), "slug and time": (p, ["slug", "generated_at"])})


def longest_root(spark, d):
    """The longest directory with pages of its own above each file."""
    roots = table(spark, d, "ledger").select(F.regexp_replace("doc_path", r"/[^/]*$", "").alias("root")).distinct().withColumn("service", F.col("root"))
    return planning.longest_prefix(table(spark, d, "files").select("file_path").distinct(), roots, "file_path", "root", "service")


_PK = r"regexp_replace(replace(regexp_replace({}, '#.*$', ''), '\', '/'), '^(\./|/)+', '')"
_L = f"""links AS (SELECT DISTINCT src, dst FROM (SELECT {_PK.format('f')} AS src, {_PK.format('l')} AS dst FROM (SELECT owned_files[1] AS f, unnest(owned_files) AS l FROM chunks WHERE kind = 'relationship'))
  WHERE trim(src) <> '' AND trim(dst) <> '' AND src <> dst), nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links), entries AS (SELECT DISTINCT src AS node FROM links WHERE regexp_matches(src, '/(scripts|tests|examples)/'))"""
_S = "sup AS (SELECT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) + 1 AS dst, l_returnflag AS kind, l_orderkey AS ord, l_linenumber AS line_no FROM lineitem)"


def _deg(name: str) -> str:
    return f"""deg AS (SELECT coalesce(i.node, o.node) AS node, coalesce(in_degree, 0) AS in_degree, coalesce(n_calls, 0) AS n_calls, coalesce(out_degree, 0) AS out_degree
  FROM (SELECT dst AS node, count(DISTINCT src) AS in_degree, count(*) AS n_calls FROM {name} WHERE src <> dst GROUP BY 1) i FULL JOIN (SELECT src AS node, count(DISTINCT dst) AS out_degree FROM {name} WHERE src <> dst GROUP BY 1) o ON i.node = o.node)"""


def _bfs(most: int) -> str:
    return f"walk(node, depth) AS (SELECT node, 0 FROM entries UNION SELECT l.dst, w.depth + 1 FROM walk w JOIN links l ON l.src = w.node WHERE w.depth < {most}), reached AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)"


def _walk(most: int) -> str:
    return f"""seed AS (SELECT node, node AS label FROM entries), w0(node, label, depth) AS (SELECT node, label, 0 FROM seed UNION SELECT l.dst, w.label, w.depth + 1 FROM w0 w JOIN links l ON l.src = w.node WHERE w.depth < {most}),
lab AS (SELECT node, min(label) AS label, min(depth) AS depth FROM (SELECT *, min(depth) OVER (PARTITION BY node) AS m FROM w0) WHERE depth = m GROUP BY 1)"""


_FILES = "pf AS (SELECT DISTINCT slug, unnest(map_keys(file_hashes)) AS file FROM ledger)"


def _tokens(x: str) -> str:
    from .retrieval import _TOKENS

    return _TOKENS.replace("lower(text)", f"lower({x})")


ORACLES = {
    "file_degrees": f"WITH {_L}, {_deg('links')} SELECT node, in_degree, out_degree, n_calls FROM deg",
    "supply_degrees": f"WITH {_S}, {_deg('sup')} SELECT node, in_degree, out_degree, n_calls FROM deg",
    "edge_dedupe": f"WITH {_S} SELECT src, dst, kind FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ord, line_no, kind) AS rn FROM sup) WHERE rn = 1",
    "edge_kinds": f"WITH {_S} SELECT src, count(*) FILTER (kind = 'A') AS n_a, count(*) FILTER (kind = 'N') AS n_n, count(*) FILTER (kind = 'R') AS n_r FROM sup GROUP BY 1",
    "foundational_files": f"WITH {_L}, {_deg('links')} SELECT node, in_degree FROM deg WHERE in_degree >= greatest(2, floor((SELECT count(*) FROM deg) * 0.05))",
    "call_depth": f"WITH RECURSIVE {_L}, {_bfs(200)} SELECT n.node, coalesce(r.depth, 999) AS depth FROM nodes n LEFT JOIN reached r ON r.node = n.node",
    "execution_chain": f"WITH RECURSIVE {_L}, {_bfs(3)} SELECT l.src, l.dst, r.depth + 1 AS depth FROM links l JOIN reached r ON r.node = l.src",
    "label_clusters": f"WITH RECURSIVE {_L}, {_walk(4)} SELECT node, label, depth FROM lab",
    "cluster_rollup": f"""WITH RECURSIVE {_L}, {_walk(4)}, {_deg('links')} SELECT label, count(*) AS n_nodes, min(depth) AS min_depth, max(depth) AS max_depth, round(avg(coalesce(in_degree, 0)), 6) AS avg_in_degree, count(*) FILTER (depth = 0) AS n_seeds
FROM lab LEFT JOIN deg ON deg.node = lab.node GROUP BY 1""",
    "cluster_density": f"""WITH RECURSIVE {_L}, {_walk(4)}, n AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), e AS (SELECT x.label AS a, y.label AS b, count(*) AS n_edges FROM links l JOIN lab x ON x.node = l.src JOIN lab y ON y.node = l.dst WHERE x.label <> y.label GROUP BY 1, 2)
SELECT a, b, n_edges, round(n_edges / (p.n * q.n)::DOUBLE, 6) AS density FROM e JOIN n p ON p.label = a JOIN n q ON q.label = b""",
    "orphan_attach": f"""WITH RECURSIVE {_L}, {_walk(1)}, lone AS (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM lab)), w AS (SELECT src, dst, CASE WHEN regexp_matches(lower(src), '(^|/)(tests?|spec|__tests__)/|(^|/)test_|[._](test|spec)\\.') THEN 0.5 ELSE 2.0 END::DOUBLE AS weight FROM links),
both_ways AS (SELECT src AS node, dst AS other, weight FROM w UNION ALL SELECT dst, src, weight FROM w), v AS (SELECT b.node, lab.label, sum(weight) AS score FROM both_ways b JOIN lone USING (node) JOIN lab ON lab.node = b.other GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, label) AS rn FROM v) WHERE rn = 1), big AS (SELECT label FROM lab GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1)
SELECT l.node, coalesce(b.label, (SELECT label FROM big)) AS label, coalesce(b.score, 0.0)::DOUBLE AS score FROM lone l LEFT JOIN best b ON b.node = l.node""",
    "scope_closure": f"""WITH RECURSIVE {_FILES}, items(item) AS (SELECT file_path FROM files WHERE archived_at >= TIMESTAMP '2025-12-01' UNION SELECT b.file FROM items i JOIN pf a ON a.file = i.item JOIN pf b ON b.slug = a.slug)
SELECT slug AS grp, file AS item FROM pf WHERE file IN (SELECT item FROM items)""",
    "reachable_within": f"""WITH RECURSIVE {_L}, w(node, ancestor, distance) AS (SELECT src, dst, 1 FROM links UNION SELECT w.node, l.dst, w.distance + 1 FROM w JOIN links l ON l.src = w.ancestor WHERE w.distance < 3 AND w.node <> l.dst)
SELECT node, ancestor, min(distance) AS distance FROM w GROUP BY 1, 2""",
    "similar_pages": f"""WITH {_FILES}, n AS (SELECT slug, count(*) AS n FROM pf GROUP BY 1), s AS (SELECT x.slug AS a, y.slug AS b, count(*) AS s FROM pf x JOIN pf y ON x.file = y.file AND x.slug < y.slug GROUP BY 1, 2)
SELECT a, b, round(s / (p.n + q.n - s)::DOUBLE, 6) AS jaccard FROM s JOIN n p ON p.slug = a JOIN n q ON q.slug = b WHERE s / (p.n + q.n - s)::DOUBLE >= 0.6""",
    "shared_file_pages": f"WITH {_FILES}, g AS (SELECT file, list_sort(list(slug)) AS all_ FROM pf GROUP BY 1 HAVING count(*) > 1) SELECT slug, pf.file, len(all_) AS n_owners, list_slice(list_filter(all_, lambda x: x <> slug), 1, 3) AS others FROM pf JOIN g ON g.file = pf.file",
    "token_overlap_assign": f"""WITH d AS (SELECT doc_id, unnest({_tokens('text')}) AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, unnest({_tokens('text')}) AS t FROM benchmark),
n AS (SELECT doc_id, item_id, count(*) AS overlap FROM d JOIN b ON d.t = b.t GROUP BY 1, 2)
SELECT doc_id, item_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, item_id) AS rn FROM n) WHERE rn = 1""",
    "title_similarity": f"""WITH p AS (SELECT DISTINCT slug, title, section FROM ledger), t AS (SELECT slug, title, {_tokens('title')} AS a, {_tokens('section')} AS b FROM p)
SELECT slug, title, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) END::DOUBLE AS similarity FROM t""",
    "coverage_gaps": f"WITH {_FILES} SELECT DISTINCT file_path AS file FROM files WHERE file_path NOT IN (SELECT file FROM pf) AND NOT regexp_matches(lower(file_path), '(^|/)(tests?|spec|__tests__)/|(^|/)test_|[._](test|spec)\\.')",
    "coverage_by_repo": f"""WITH {_FILES}, f AS (SELECT DISTINCT repo, file_path AS file FROM files)
SELECT repo, count(*) AS n_files, count(p.file) AS n_covered, round(count(p.file) * 100.0 / count(*), 2)::DOUBLE AS percent FROM f LEFT JOIN (SELECT DISTINCT file FROM pf) p ON p.file = f.file GROUP BY 1""",
    "folded_languages": """WITH f AS (SELECT DISTINCT file_path, lower(trim(language)) AS lang FROM files), n AS (SELECT lang, count(*) AS n FROM f GROUP BY 1)
SELECT CASE WHEN n < 12 THEN 'misc' ELSE lang END AS lang, sum(n)::BIGINT AS n_files FROM n GROUP BY 1""",
    "duplicate_keys": """SELECT 'slug' AS name, slug AS key, count(*) AS n FROM ledger GROUP BY slug HAVING count(*) > 1 UNION ALL SELECT 'doc_path', doc_path, count(*) FROM ledger GROUP BY doc_path HAVING count(*) > 1
UNION ALL SELECT 'slug and time', concat_ws('|', slug, generated_at), count(*) FROM ledger GROUP BY 2 HAVING count(*) > 1""",
    "longest_root": """WITH r AS (SELECT DISTINCT regexp_replace(doc_path, '/[^/]*$', '') AS root FROM ledger), f AS (SELECT DISTINCT file_path FROM files)
SELECT file_path, coalesce((SELECT root FROM r WHERE f.file_path = root OR starts_with(f.file_path, root || '/') ORDER BY length(root) DESC LIMIT 1), '') AS service FROM f""",
    "merged_evidence": """WITH s AS (SELECT answer_id, file_path, list_sort(list_distinct(flatten(list(symbol_names)))) AS symbol_names, coalesce(min_by(title, id) FILTER (title <> ''), '') AS title, coalesce(min_by(reason, id) FILTER (reason <> ''), '') AS reason FROM evidence_items GROUP BY 1, 2)
SELECT answer_id, file_path, symbol_names, title, reason FROM s""",
}
QUERIES = {
    f.__name__: f
    for f in (
        file_degrees, supply_degrees, edge_dedupe, edge_kinds, foundational_files, call_depth, execution_chain, label_clusters, cluster_rollup, orphan_attach, cluster_density, scope_closure, reachable_within, similar_pages,
        shared_file_pages, token_overlap_assign, title_similarity, coverage_gaps, coverage_by_repo, folded_languages, merged_evidence, duplicate_keys, longest_root,
    )
}
