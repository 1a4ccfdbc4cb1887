"""Queries over roles, plans, routes and resolutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import SUPPORTING, is_test, normal_route, route_family, source_kind
from ..functions.text import fraction, int_or, version_array
from ..operators import chunking, evidence, graph, hybrid, outline, validation
from ..session import table
from ..sources import archive, parsers
from .graphs import _L, _entries, _links, _nodes
from .retrieval import _KINDS_SQL


def path_roles(spark, d):
    """Role and operational kind of every path in the archive."""
    f = table(spark, d, "files").select("file_path").distinct()
    return f.select("file_path", outline.role_of(F.col("file_path")).alias("role"), outline.artifact_kind(F.col("file_path")).alias("artifact"))


def truncated_texts(spark, d):
    """Documents cut at a line break within 400 characters."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.sha2(outline.truncate_lines(F.col("text"), 400), 256).alias("text_hash"))


def chunk_semantic_ids(spark, d):
    """An id of each chunk's files that doesn't depend on their order."""
    c = table(spark, d, "chunks").where("size(owned_files) > 0").select("chunk_id", "owned_files").groupBy("chunk_id").agg(F.min("owned_files").alias("f"))
    return c.select("chunk_id", outline.semantic_id(F.col("f")).alias("semantic_id"))


def entry_files(spark, d):
    """Scripts, tests and examples, and files nothing links to."""
    links = _links(spark, d)
    return outline.entry_points(_nodes(links), links, _entries(links), graph.foundational(graph.degrees(links), 0.05, 2), is_test("node"))


def linked_files(spark, d):
    """Of each file how many it links to, and the first 12."""
    return outline.capped_callees(_links(spark, d))


def two_hop_files(spark, d):
    return outline.two_hops(_links(spark, d))


def repo_tiers(spark, d):
    """Repositories by whether more of their files support the product than are it."""
    f = table(spark, d, "files").select("repo", "file_path").distinct().select("repo", source_kind("file_path").alias("kind"))
    return outline.tier_by_majority(f, "repo", "kind", list(SUPPORTING))


def plan_reuse(spark, d):
    """Pages nine tenths of whose files are still archived."""
    live = table(spark, d, "files").where("deleted_at is null").select(F.col("file_path").alias("file"))
    return outline.reuse_ratio(table(spark, d, "ledger").select("slug", F.map_keys("file_hashes").alias("f")), "slug", "f", live, "file")


def index_health(spark, d):
    """Corpora against the number of their distinct chunk ids."""
    c = table(spark, d, "chunks")
    return outline.corpus_health(c, "corpus", "chunk_id", "text", c.groupBy("corpus").agg(F.countDistinct("chunk_id").alias("n")))


def merged_plans(spark, d):
    """Pages of before and after July in one plan."""
    p = table(spark, d, "ledger").select("slug", F.array_sort(F.map_keys("file_hashes")).alias("files"), "success", (F.col("generated_at") < "2025-07").alias("old")).where("size(files) > 0 and old is not null")
    plan = p.groupBy("slug", "old").agg(F.min("files").alias("files"), F.min(F.when(F.col("success"), 1.0).otherwise(0.5)).alias("confidence")).withColumn("semantic_id", outline.semantic_id(F.col("files")))
    cols = ["slug", "semantic_id", "files", "confidence"]
    return outline.merge_plans(plan.where("old").select(*cols), plan.where("not old").select(*cols)).select("slug", "semantic_id", F.array_join("files", "|").alias("files"), "confidence")


def orphan_repair(spark, d):
    """Files that no page owns, given to the page of the nearest directory."""
    owned = table(spark, d, "ledger").select("slug", F.explode(F.map_keys("file_hashes")).alias("file")).distinct()
    return outline.nearest_directory(table(spark, d, "files").select(F.col("file_path").alias("file")).distinct(), owned, "file", "slug")


def route_claims(spark, d):
    """Routes that documents name and no other document of their repository's code declares; known are those in code."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "doc_kind")
    m = docs.where("doc_kind = 'code'").select(F.explode(F.regexp_extract_all("text", F.lit(r"\b((?:GET|POST|PUT|PATCH|DELETE)\s+/[\w\-/{}:.]*)"), 1)).alias("r"))
    known = m.select(F.regexp_extract("r", r"^(\w+)", 1).alias("method"), normal_route(F.regexp_extract("r", r"\s(/\S*)$", 1)).alias("path"))
    return outline.route_claims(docs.where("doc_kind <> 'code'"), "doc_id", "text", known)


def abstentions(spark, d):
    """Answers that say that they know nothing."""
    return table(spark, d, "documents").where("doc_kind = 'answer' and text is not null").select("doc_id", F.col("text").rlike(outline.ABSTAINS).alias("abstains"))


def pages_by_day(spark, d):
    """Generated pages by day, newest first, with their sections."""
    p = table(spark, d, "ledger").where("success and generated_at is not null and trim(generated_at) <> ''").select(F.substring(F.trim("generated_at"), 1, 10).alias("day"), "slug", "section").distinct()
    return p.groupBy("day").agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"))


def evidence_priority(spark, d):
    """Shown passages by an additive priority: confidence, kind, whether lines and symbols are known, source kind."""
    e = table(spark, d, "evidence_items").select("answer_id", "id", "confidence", "kind", "start_line", "symbol_names", "source_kind").dropDuplicates(["answer_id", "id"])
    p = F.coalesce("confidence", F.lit(0.0)) + F.when(F.col("start_line") > 0, 0.2).otherwise(0.0) + F.when(F.size("symbol_names") > 0, 0.1).otherwise(0.0) - F.when(F.col("source_kind").isin("test", "generated", "vendor"), 0.3).otherwise(0.0)
    return e.groupBy("answer_id", "id").agg(F.round(F.max(p), 6).alias("priority"))


# Small cases: rows with a known outcome.
def _rows(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def case_followed_exports(spark, d):
    """Imported names through renamings, re-exports and a cycle."""
    names = _rows(spark, "file string, name string, from_file string, from_name string", ("app", "run", "pkg", "start"), ("app", "h", "lib", "helper"), ("app", "x", "c1", "x"), ("app", "gone", "lib", "nothing"), ("web", "deep", "r1", "deep"))
    exports = _rows(spark, "file string, name string, from_file string, from_name string", ("pkg", "start", "pkg/core", "run"), ("c1", "x", "c2", "x"), ("c2", "x", "c1", "x"), ("r1", "deep", "r2", "deep"), ("r2", "deep", "r3", "deeper"), ("r3", "deeper", "r4", "deepest"))
    defs = _rows(spark, "file string, name string", ("pkg/core", "run"), ("lib", "helper"), ("r4", "deepest"))
    return outline.follow_exports(names, exports, defs)


def case_resolved_members(spark, d):
    """Calls through self, super, an inherited method, an imported class and an unknown receiver."""
    sites = _rows(spark, "site int, file string, cls string, receiver string, method string", (1, "a", "Child", "self", "save"), (2, "a", "Child", "super", "save"), (3, "a", "Child", "self", "load"), (4, "a", "", "repo", "find"), (5, "a", "", "who", "find"), (6, "a", "Loop1", "self", "go"))
    methods = _rows(spark, "cls string, method string", ("Child", "save"), ("Base", "save"), ("Root", "load"), ("Repo", "find"))
    up = graph.ancestors(_rows(spark, "src string, dst string", ("Child", "Base"), ("Base", "Root"), ("Loop1", "Loop2"), ("Loop2", "Loop1")), 5)
    every = _rows(spark, "cls string", *[(x,) for x in ("Child", "Base", "Root", "Repo", "Loop1", "Loop2")])
    ancestors = up.select(F.col("node").alias("cls"), "ancestor", "distance").unionByName(every.select("cls", F.col("cls").alias("ancestor"), F.lit(0).alias("distance")))
    return outline.resolve_members(sites, methods, ancestors, _rows(spark, "file string, receiver string, cls string", ("a", "repo", "Repo")))


def case_routes(spark, d):
    """Declarations of several frameworks with their full paths: mounts composed, families named."""
    src = _rows(spark, "file string, language string, text string", ("users.js", "javascript", "router.get('/users', auth, list)\nrouter.post(\"/users\", create)\n"), ("api.py", "python", "@app.get('/items/{id}')\ndef item(id): pass\n"), ("urls.py", "python", "urlpatterns = [path('reports/<slug:slug>/', v)]\n"), ("none.py", "python", "x = 1\n"))
    mounts = _rows(spark, "parent string, node string, path string", ("app", "v1", "/api/v1"), ("v1", "users.js", "/"), ("v1", "admin", "admin"), ("app", "api.py", "/"), ("app", "urls.py", ""))
    full = evidence.compose_prefixes(mounts, _rows(spark, "node string, prefix string", ("app", "")))
    r = parsers.routes(src, ["file"]).join(full.withColumnRenamed("node", "file"), "file").withColumn("route", normal_route(F.concat_ws("/", "prefix", "path")))
    return r.select("file", "line_no", "framework", "method", "route", route_family("route").alias("family"))


def case_constants(spark, d):
    """Names followed to their literals; a cycle and a dead end give null."""
    return evidence.resolve_constants(_rows(spark, "name string, value string", ("A", "@B"), ("B", "@C"), ("C", "/api"), ("X", "@Y"), ("Y", "@X"), ("Z", "@nowhere"), *[(f"n{i}", f"@n{i + 1}") for i in range(12)], ("n12", "end")))


def case_openapi(spark, d):
    spec = '{"paths": {"/users": {"get": {"summary": "List", "operationId": "listUsers"}, "post": {}}, "/x": {"parameters": {}, "delete": {"summary": "Drop"}}}}'
    return archive.openapi_endpoints(_rows(spark, "file string, text string", ("a.json", spec), ("bad.json", "{"), ("none.json", None)))


def case_renames(spark, d):
    rows = (("M", "a", None, 1), ("R100", "b", "c", 2), ("C75", "d", "e", 3), ("A", "f", None, 4), ("D", "f", None, 5))
    return archive.expand_renames(_rows(spark, "status string, path string, new_path string, pos int", *rows))


def case_json_rows(spark, d):
    rows = ((1, '[{"q": "a", "s": 1}, {"q": "b"}]'), (2, '{"cases": [{"q": "c", "s": 3}]}'), (3, '{"results": [{"q": "d"}]}'), (4, "nothing"), (5, None))
    return archive.json_cases(_rows(spark, "id int, text string", *rows), "q string, s int").fillna(-1, ["s"])


def case_symbol_ranges(spark, d):
    """Ends of symbols and the class each lies in."""
    s = _rows(spark, "file string, name string, kind string, start_line int, end_line int, total int", ("a", "C", "class", 1, 20, 30), ("a", "m", "method", 3, 0, 30), ("a", "n", "method", 9, 0, 30), ("a", "D", "class", 21, 30, 30), ("a", "z", "method", 25, 0, 30), ("b", "f", "function", 2, 0, 4))
    return parsers.enclosing(chunking.symbol_ends(s, ["file"], "total"), ["file"]).select("file", "name", "start_line", "end_line", "owner")


def case_sections(spark, d):
    t = _rows(spark, "id int, text string", (1, "one two\n\nthree four\n\nfive"), (2, "a" * 25), (3, ""), (4, None), (5, "x\ny\n\n\n  \nz"))
    return chunking.split_sections(t, "text", ["id"], 20)


def case_budget(spark, d):
    """Texts in order until ten characters are used."""
    t = _rows(spark, "g string, pos int, text string", ("a", 1, "12345"), ("a", 2, "1234567"), ("a", 3, "x"), ("b", 1, "123456789012"), ("c", 1, None), ("c", 2, "12"))
    return hybrid.trim_budget(t, ["g"], ["pos"], "text", 10)


def case_followup_terms(spark, d):
    h = _rows(spark, "q int, score double, id int, terms array<string>", (1, 0.9, 1, ["b", "a", ""]), (1, 0.8, 2, ["a", "c", "d"]), (1, 0.1, 3, ["e"]), (2, 0.5, 4, []), (3, 0.5, 5, None))
    return hybrid.first_seen_terms(h, "q", "terms", [F.desc("score"), F.col("id")], 2, 3)


def case_numbers(spark, d):
    r = _rows(spark, "s string", ("true",), ("false",), ("0.5",), ("95",), ("500",), ("-1",), ("junk",), (None,), (" 7 ",), ("1.10.2",))
    return r.select("s", fraction("s").alias("share"), int_or("s", -1).alias("n"), F.array_join(version_array("s").cast("array<string>"), ".").alias("version"), F.coalesce(version_array("s") > version_array(F.lit("1.9")), F.lit(False)).alias("newer"))


def case_settings(spark, d):
    """Nested settings of three layers under dotted names, the last layer's value of each."""
    t = _rows(spark, "layer int, text string", (1, '{"a": {"b": 1, "c": {"d": "x"}}, "e": [1, 2]}'), (2, '{"a": {"b": 2}}'), (3, '{"f": true}'), (4, "junk"))
    flat = outline.flatten_json(t, "layer", "text")
    return outline.merge_settings(flat, "name", "value", "layer")


def case_missing_links(spark, d):
    pairs = _rows(spark, "src string, dst string", ("a", "b"), ("a", "a"), ("a", "gone"), ("b", "a"), ("b", "a"), ("c", "a"))
    return outline.missing_links(pairs, _rows(spark, "slug string", ("a",), ("b",), ("c",)), _rows(spark, "src string, dst string", ("c", "a")))


def case_removed_files(spark, d):
    """Plans after files went: what is left of each, and whether it is dropped."""
    plans = _rows(spark, "slug string, files array<string>", ("p", ["a", "b", "c"]), ("q", ["b"]), ("r", []), ("s", None))
    kept, dropped = evidence.remove_files(plans, "files", _rows(spark, "file string", ("b",)), "file")
    return kept.withColumn("dropped", F.lit(False)).unionByName(dropped.withColumn("dropped", F.lit(True))).select("slug", F.array_join("files", "|").alias("files"), "dropped")


def case_sections_wanted(spark, d):
    pages = _rows(spark, "page string, text string", ("p", "# Quick start\n\ntext\n\n## Error handling and retries\n"), ("q", "none"))
    return validation.missing_sections(pages, "page", "text", _rows(spark, "page string, section string", ("p", "Quick Start Guide"), ("p", "Retries"), ("p", "Deployment"), ("q", "Errors")))


def case_flow_order(spark, d):
    """Flows by score, then title."""
    f = _rows(spark, "id int, title string, e int, f int, s int, x int, r int", (1, "b", 1, 2, 0, 0, 1), (2, "a", 1, 2, 0, 0, 1), (3, "c", 2, 5, 1, 1, 0), (4, "d", 0, 0, 0, 0, 0))
    s = f.withColumn("score", outline.flow_score(F.col("e"), F.col("f"), F.col("s"), F.col("x"), F.col("r")))
    return hybrid.top_per_group(s.withColumn("g", F.lit(1)), ["g"], [F.desc("score"), F.col("title"), F.col("id")], 3).select("id", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        path_roles, truncated_texts, chunk_semantic_ids, entry_files, linked_files, two_hop_files, repo_tiers, plan_reuse, index_health, merged_plans, orphan_repair, route_claims, abstentions, pages_by_day, evidence_priority,
        case_followed_exports, case_resolved_members, case_routes, case_constants, case_openapi, case_renames, case_json_rows, case_symbol_ranges, case_sections, case_budget, case_followup_terms, case_numbers, case_settings,
        case_missing_links, case_removed_files, case_sections_wanted, case_flow_order,
    )
}


def _case(rules, otherwise, test):
    return "CASE " + " ".join(f"WHEN {test(r)} THEN '{n}'" for n, r in rules) + f" ELSE '{otherwise}' END"


def _values(cols: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({cols})"


_ROUTE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace('/' || {}, '[?#].*$', ''), '<[^>/]*>|:[A-Za-z_]\w*|\{{[^}}/]*\}}|\[[^\]/]*\]', '{{}}', 'g'), '/{{2,}}', '/', 'g'), '(.)/$', '\1')"
_NAMED = r"unnest(regexp_extract_all(text, '\b((?:GET|POST|PUT|PATCH|DELETE)\s+/[\w\-/{}:.]*)', 1)) AS r"

ORACLES = {
    "path_roles": f"SELECT file_path, {_case(outline.ROLES, 'module', lambda r: f'contains(lower(file_path), {chr(39)}{r}{chr(39)})')} AS role, {_case(outline.ARTIFACTS, '', lambda r: f'regexp_matches(lower(file_path), {chr(39)}{r}{chr(39)})')} AS artifact FROM (SELECT DISTINCT file_path FROM files)",
    "truncated_texts": """WITH h AS (SELECT doc_id, text, substr(text, 1, 400) AS h FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, text, h, length(h) - length(regexp_extract(h, '([^\\n]*)$', 1)) AS n FROM h)
SELECT doc_id, sha256(CASE WHEN length(text) <= 400 THEN text ELSE (CASE WHEN n > 0 THEN substr(h, 1, n - 1) ELSE h END) || chr(10) || '[truncated]' END) AS text_hash FROM k""",
    "chunk_semantic_ids": "SELECT chunk_id, substr(sha1(array_to_string(list_slice(list_sort(list_distinct(f)), 1, 20), '|')), 1, 12) AS semantic_id FROM (SELECT chunk_id, min(owned_files) AS f FROM chunks WHERE len(owned_files) > 0 GROUP BY 1)",
    "entry_files": f"""WITH {_L}, n AS (SELECT src AS node FROM links UNION SELECT dst FROM links), e AS (SELECT DISTINCT src AS node FROM links WHERE regexp_matches(src, '/(scripts|tests|examples)/')),
g AS (SELECT node, (SELECT count(DISTINCT src) FROM links l WHERE l.dst = n.node) AS k FROM n), f AS (SELECT node FROM g WHERE k >= greatest(2, floor((SELECT count(*) FROM n) * 0.05)))
SELECT node, 'declared' AS why FROM e UNION ALL SELECT node, 'root' FROM n WHERE node NOT IN (SELECT dst FROM links) AND node NOT IN (SELECT node FROM e) AND node NOT IN (SELECT node FROM f)
  AND NOT regexp_matches(lower(node), '(^|/)(tests?|spec|__tests__)/|(^|/)test_|[._](test|spec)\\.')""",
    "linked_files": f"WITH {_L} SELECT src, count(*) AS n, list_slice(list(dst ORDER BY dst), 1, 12) AS callees FROM links GROUP BY 1",
    "two_hop_files": f"""WITH {_L}, t AS (SELECT DISTINCT a.src, b.dst FROM links a JOIN links b ON a.dst = b.src WHERE a.src <> b.dst), f AS (SELECT src, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.src = t.src AND l.dst = t.dst) GROUP BY 1)
SELECT l.src AS node, count(*) AS n_near, coalesce(max(f.n), 0) AS n_far FROM links l LEFT JOIN f ON f.src = l.src GROUP BY 1""",
    "repo_tiers": f"""WITH k AS (SELECT repo, {_KINDS_SQL} AS kind FROM (SELECT DISTINCT repo, file_path FROM files)), g AS (SELECT repo, count(*) AS n, count(*) FILTER (kind IN ({', '.join(f"'{x}'" for x in SUPPORTING)})) AS s FROM k GROUP BY 1)
SELECT repo, n - s AS n_product, s AS n_supporting, CASE WHEN s > n - s THEN 'supporting' ELSE 'product' END AS tier FROM g""",
    "plan_reuse": """WITH e AS (SELECT DISTINCT slug, unnest(map_keys(file_hashes)) AS f FROM ledger), h AS (SELECT DISTINCT file_path AS f FROM files WHERE deleted_at IS NULL)
SELECT slug, count(*) AS n_files, count(h.f) AS n_present, count(h.f) >= count(*) * 0.9 AS reusable FROM e LEFT JOIN h ON h.f = e.f GROUP BY 1""",
    "index_health": """SELECT corpus, count(*) AS n_records, count(DISTINCT chunk_id) AS n_keys, round(avg(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1.0 ELSE 0.0 END), 6) AS filled,
CASE WHEN count(*) <> count(DISTINCT chunk_id) THEN 'count differs' WHEN avg(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1.0 ELSE 0.0 END) < 1 THEN 'empty texts' ELSE 'healthy' END AS health FROM chunks GROUP BY 1""",
    "merged_plans": """WITH p AS (SELECT slug, list_sort(map_keys(file_hashes)) AS files, success, generated_at < '2025-07' AS old FROM ledger), g AS (SELECT slug, old, min(files) AS files, min(CASE WHEN success THEN 1.0 ELSE 0.5 END) AS confidence FROM p WHERE len(files) > 0 AND old IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, substr(sha1(array_to_string(list_slice(list_distinct(files), 1, 20).list_sort(), '|')), 1, 12) AS semantic_id FROM g), o AS (SELECT * FROM s WHERE old), i AS (SELECT semantic_id, min(slug) AS slug FROM o GROUP BY 1),
n AS (SELECT s.*, coalesce(o.slug, i.slug, s.slug) AS k FROM s LEFT JOIN o ON o.slug = s.slug LEFT JOIN i ON i.semantic_id = s.semantic_id WHERE NOT s.old),
m AS (SELECT k, first(semantic_id ORDER BY slug, semantic_id) AS semantic_id, list_sort(list_distinct(flatten(list(files)))) AS files, min(confidence) AS confidence FROM n GROUP BY 1)
SELECT coalesce(o.slug, m.k) AS slug, coalesce(m.semantic_id, o.semantic_id) AS semantic_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.files, []), coalesce(m.files, [])))), '|') AS files, least(o.confidence, m.confidence)::DOUBLE AS confidence FROM o FULL JOIN m ON m.k = o.slug""",
    "orphan_repair": """WITH o AS (SELECT DISTINCT slug, unnest(map_keys(file_hashes)) AS f FROM ledger), u AS (SELECT DISTINCT file_path AS f FROM files WHERE file_path NOT IN (SELECT f FROM o)),
d AS (SELECT slug, array_to_string(p[1:i], '/') AS dir FROM (SELECT slug, string_split(f, '/') AS p, unnest(range(1, len(string_split(f, '/')))) AS i FROM o)),
b AS (SELECT dir, slug FROM (SELECT dir, slug, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, slug) AS rn FROM d GROUP BY 1, 2) WHERE rn = 1),
x AS (SELECT f, i, array_to_string(p[1:i], '/') AS dir FROM (SELECT f, string_split(f, '/') AS p, unnest(range(1, len(string_split(f, '/')))) AS i FROM u))
SELECT f AS file, slug, i::INT AS depth FROM (SELECT f, slug, i, row_number() OVER (PARTITION BY f ORDER BY i DESC) AS rn FROM x JOIN b ON b.dir = x.dir) WHERE rn = 1""",
    "route_claims": f"""WITH c AS (SELECT doc_id, doc_kind, {_NAMED} FROM documents WHERE text IS NOT NULL), s AS (SELECT DISTINCT doc_id, doc_kind, regexp_extract(r, '^(\\w+)', 1) AS method, {_ROUTE.format("regexp_extract(r, '[[:space:]](/[^[:space:]]*)$', 1)")} AS path FROM c)
SELECT DISTINCT doc_id AS page, method, path FROM s WHERE doc_kind <> 'code' AND NOT EXISTS (SELECT 1 FROM s k WHERE k.doc_kind = 'code' AND k.method = s.method AND k.path = s.path)""",
    "abstentions": f"SELECT doc_id, regexp_matches(text, '{outline.ABSTAINS.replace(chr(39), chr(39) * 2)}') AS abstains FROM documents WHERE doc_kind = 'answer' AND text IS NOT NULL",
    "pages_by_day": """WITH p AS (SELECT DISTINCT substr(trim(generated_at), 1, 10) AS day, slug, section FROM ledger WHERE success AND generated_at IS NOT NULL AND trim(generated_at) <> '')
SELECT day, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT section)), '|') AS sections FROM p GROUP BY 1""",
    "evidence_priority": """SELECT answer_id, id, round(max(coalesce(confidence, 0) + CASE WHEN start_line > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(symbol_names) > 0 THEN 0.1 ELSE 0 END - CASE WHEN source_kind IN ('test', 'generated', 'vendor') THEN 0.3 ELSE 0 END), 6)::DOUBLE AS priority
FROM evidence_items GROUP BY 1, 2""",
    "case_followed_exports": _values("file, name, at_file, at_name", "('app', 'run', 'pkg/core', 'run')", "('app', 'h', 'lib', 'helper')", "('app', 'x', '', 'x')", "('app', 'gone', '', 'gone')", "('web', 'deep', 'r4', 'deepest')"),
    "case_resolved_members": _values("site, owner, method", "(1, 'Child', 'save')", "(2, 'Base', 'save')", "(3, 'Root', 'load')", "(4, 'Repo', 'find')", "(5, '', 'find')", "(6, '', 'go')"),
    "case_routes": _values("file, line_no, framework, method, route, family", "('users.js', 1, 'express', 'GET', '/api/v1/users', 'users')", "('users.js', 2, 'express', 'POST', '/api/v1/users', 'users')", "('api.py', 1, 'fastapi', 'GET', '/items/{}', 'items')", "('urls.py', 1, 'django', 'ANY', '/reports/{}', 'reports')"),
    "case_constants": _values("name, value", "('A', '/api')", "('B', '/api')", "('C', '/api')", "('X', NULL)", "('Y', NULL)", "('Z', NULL)", *[f"('n{i}', 'end')" for i in range(13)]),
    "case_openapi": _values("file, path, method, summary, operation_id", "('a.json', '/users', 'GET', 'List', 'listUsers')", "('a.json', '/users', 'POST', '', '')", "('a.json', '/x', 'DELETE', 'Drop', '')"),
    "case_renames": _values("path, status", "('a', 'M')", "('b', 'D')", "('c', 'A')", "('e', 'A')", "('f', 'D')"),
    "case_json_rows": _values("id, q, s", "(1, 'a', 1)", "(1, 'b', -1)", "(2, 'c', 3)", "(3, 'd', -1)"),
    "case_symbol_ranges": _values("file, name, start_line, end_line, owner", "('a', 'C', 1, 20, '')", "('a', 'm', 3, 8, 'C')", "('a', 'n', 9, 20, 'C')", "('a', 'D', 21, 30, '')", "('a', 'z', 25, 30, 'D')", "('b', 'f', 2, 4, '')"),
    "case_sections": _values("id, part, n_parts, text", "(1, 1, 2, 'one two' || chr(10) || chr(10) || 'three four')", "(1, 2, 2, 'five')", f"(2, 1, 2, '{'a' * 20}')", "(2, 2, 2, 'aaaaa')", "(5, 1, 1, 'x' || chr(10) || 'y' || chr(10) || chr(10) || 'z')"),
    "case_budget": _values("g, pos, text", "('a', 1, '12345')", "('a', 2, '12345')", "('b', 1, '1234567890')", "('c', 2, '12')"),
    "case_followup_terms": _values("q, n, term", "(1, 1, 'b')", "(1, 2, 'a')", "(1, 3, 'c')"),
    "case_numbers": _values("s, share, n, version, newer", "('true', 1.0::DOUBLE, -1, '', false)", "('false', 0.0, -1, '', false)", "('0.5', 0.5, -1, '0.5', false)", "('95', 0.95, 95, '95', true)", "('500', 1.0, 500, '500', true)", "('-1', 0.0, -1, '1', false)", "('junk', 0.0, -1, '', false)", "(NULL, 0.0, -1, NULL, false)", "(' 7 ', 0.07, 7, '7', true)", "('1.10.2', 0.0, -1, '1.10.2', true)"),
    "case_settings": _values("name, value, layer", "('a.b', '2', 2)", "('a.c.d', 'x', 1)", "('e', '[1,2]', 1)", "('f', 'true', 3)"),
    "case_missing_links": _values("src, dst", "('a', 'b')", "('b', 'a')"),
    "case_removed_files": _values("slug, files, dropped", "('p', 'a|c', false)", "('q', '', true)", "('r', '', false)", "('s', '', false)"),
    "case_sections_wanted": "SELECT page, 'missing_section' AS \"check\", 'warning' AS severity, detail FROM (VALUES ('p', 'Deployment'), ('q', 'Errors')) t(page, detail)",
    "case_flow_order": _values("id, score, rank", "(3, 14.5::DOUBLE, 1)", "(2, 8.0, 2)", "(1, 8.0, 3)"),
}
