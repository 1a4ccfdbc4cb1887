"""The reference's kinds of operators on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.functions import paths, text
from strataloom.operators import chunking, graph, hybrid, incremental, planning, quality
from strataloom.operators.lexical import bm25_topk
from strataloom.operators.vector import l2_normalise, vector_topk
from strataloom.sources import archive, parsers


def col(spark, value, c, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(c(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert col(spark, "The --Quick_brown-- fox, the fox", text.token_set) == ["quick_brown", "fox"]
    assert col(spark, "a\nb\n", text.line_array) == ["a", "b"] and col(spark, "", text.line_array) == [] and col(spark, "a\n\n", text.line_array) == ["a", ""]
    assert [col(spark, x, text.line_count) for x in ("", "a", "a\n", "a\nb", "\n\n")] == [0, 1, 1, 2, 2]
    assert col(spark, "x", text.content_hash) == "2d711642b726b044"
    assert col(spark, " Ünder the -- Hood!", text.slug) == "nder-the-hood"
    assert col(spark, "getHTTPUser_id", text.camel_words)[0] == "get"
    assert [col(spark, x, text.fraction) for x in ("true", "0.4", "85", "x", None, "-3", "400")] == [1.0, 0.4, 0.85, 0.0, 0.0, 0.0, 1.0]
    assert col(spark, "---\na: 1\n---\nbody", text.strip_front_matter) == "body"
    assert col(spark, "x = 'it''s' # foo('bar')", text.strip_code_noise).strip() == "x = ''''"
    assert col(spark, "see [E1] and [E2], [E1]", text.evidence_ids) == ["E1", "E2"]
    assert col(spark, "`a/b.py:12` and `c.md`", text.file_references) == ["a/b.py", "c.md"]
    assert col(spark, "v1.20.3", text.version_array) == [1, 20, 3]
    assert col(spark, "ab\ncd\nef", lambda c: text.line_of_offset(c, F.lit(4))) == 2
    both = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [x[0] for x in both.select(text.jaccard("a", "b")).collect()] == [1.0, 0.0, pytest.approx(1 / 3)]


def test_path_functions(spark):
    kinds = {"src/a.py": "core", "tests/x.py": "test", "vendor/a/b.go": "vendor", "docs/a.md": "docs", "app/config/x.toml": "config", "dist/a.min.js": "generated", "scripts/run.sh": "tooling", "deploy/x.yml": "ops", "examples/a.py": "example"}
    for p, k in kinds.items():
        assert col(spark, p, paths.source_kind) == k, p
    assert col(spark, "//api/v1/users/<id>/?x=1", paths.normal_route) == "/api/v1/users/{}"
    assert col(spark, "/api/v2/users/:id", paths.route_family) == "users" and col(spark, "/", paths.route_family) == "root"
    assert col(spark, "a/node_modules/x.js", lambda c: paths.matches_any(c, ["node_modules", "*.log"])) and not col(spark, "a/x.js", lambda c: paths.matches_any(c, ["node_modules", "*.log"]))


def _windows(n, size, overlap):
    step, out, s = max(size - overlap, 1), [], 0
    while True:
        out.append((s + 1, min(s + size, n)))
        if s + size >= n:
            return out
        s += step


@pytest.mark.parametrize("size,overlap", [(4, 1), (3, 0), (5, 5), (120, 20)])
def test_line_windows(spark, size, overlap):
    rows = [(n, "\n".join(f"l{i}" for i in range(n)) + "x") for n in range(1, 14)]
    got = chunking.line_windows(spark.createDataFrame(rows + [(99, ""), (98, None)], "n int, t string"), "t", ["n"], size, overlap)
    by = {}
    for r in got.collect():
        by.setdefault(r.n, []).append((r.start_line, r.end_line))
    assert by.keys() == {n for n, _ in rows}
    assert all(sorted(by[n]) == _windows(n, size, overlap) for n, _ in rows)


def test_drop_overlaps_matches_fold(spark):
    r = random.Random(5)
    rows = [(k, a, a + r.randrange(12), r.randrange(3)) for k in range(6) for a in (r.randrange(40) for _ in range(15))]
    got = {}
    for x in chunking.drop_overlaps(spark.createDataFrame(rows, "k int, start_line int, end_line int, w int"), ["k"], 0.5, "w").collect():
        got.setdefault(x.k, []).append((x.start_line, x.end_line, x.weight))
    for k in range(6):
        kept = []
        for a, b, w in sorted((a, b, w) for q, a, b, w in rows if q == k):
            if kept:
                la, lb, lw = kept[-1]
                if min(lb, b) - max(la, a) + 1 > 0.5 * (min(lb - la, b - a) + 1):
                    if w > lw:
                        kept[-1] = (a, b, w)
                    continue
            kept.append((a, b, w))
        assert sorted(got[k]) == sorted(kept)


def test_fits_budget_skips_what_is_too_large(spark):
    df = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (1, 4, 1), (2, 1, 500)], "g int, o int, s int")
    assert sorted((x.g, x.o) for x in hybrid.fits_budget(df, ["g"], ["o"], "s", 100).collect()) == [(1, 1), (1, 3)]


def test_vector_topk_matches_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(0)
    m = r.normal(size=(60, 8))
    m[5] = m[4]
    m[9] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(60, None)], "vec_id bigint, embedding array<float>")
    q = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    u = m.astype(np.float32).astype(float)
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    for block in (2, 4096):
        got = {(x.query_id, x["rank"]): x.vec_id for x in vector_topk(rows, q, 5, block).collect()}
        for i in (0, 20, 40):
            order = sorted((j for j in range(60) if j != i), key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:5]
            assert [got[(i, k)] for k in range(1, 6)] == order
    assert vector_topk(rows, q.limit(0)).count() == 0
    assert rows.where("vec_id = 9").select(l2_normalise("embedding")).first()[0] == [0.0] * 8


def test_bm25_ranks_the_rare_term_first(spark):
    rows = spark.createDataFrame([("a", "alpha beta"), ("b", "beta beta gamma"), ("c", "gamma"), ("d", None)], "k string, text string")
    q = spark.createDataFrame([(1, "alpha gamma"), (2, "nothing here")], "query_id int, question string")
    got = bm25_topk(rows, ["k"], q, 3, {"text": 1.0}).orderBy("rank").collect()
    assert [x.k for x in got][0] == "a" and {x.query_id for x in got} == {1}


def test_graph_traversal(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 4), (1, 2)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "node int")
    assert {x.node: x.depth for x in graph.depths(e, start).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {(x.src, x.dst, x.depth) for x in graph.execution_chain(e, start, 4).collect()} == {(1, 2, 1), (2, 3, 2), (3, 1, 3), (3, 4, 3)}
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node int")
    assert {x.node: x.depth for x in graph.with_unreached(nodes, graph.depths(e, start)).collect()}[7] == 999
    lab = graph.propagate_labels(e, spark.createDataFrame([(1, "b"), (6, "a")], "node int, label string"))
    assert {x.node: x.label for x in lab.collect()} == {1: "b", 6: "a", 2: "b", 3: "b", 4: "a"}
    up = graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string"), 5)
    assert {(x.node, x.ancestor): x.distance for x in up.collect()} == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 2, ("b", "a"): 2, ("c", "b"): 2}
    m = spark.createDataFrame([("g1", "x"), ("g1", "y"), ("g2", "y"), ("g2", "z"), ("g3", "w")], "grp string, item string")
    assert {(x.grp, x.item) for x in graph.closure(m, spark.createDataFrame([("x",)], "item string")).collect()} == {("g1", "x"), ("g1", "y"), ("g2", "y"), ("g2", "z")}


def test_flow_pairs_matches_all_pairs(spark):
    r = random.Random(2)
    flows = {f: {r.randrange(12) for _ in range(r.randrange(1, 7))} for f in range(40)}
    want = {(a, b) for a in flows for b in flows if a < b and len(flows[a] & flows[b]) / len(flows[a] | flows[b]) >= 0.6}
    got = graph.flow_pairs(spark.createDataFrame([(f, str(x)) for f, s in flows.items() for x in s], "flow int, file string"), 0.6)
    assert {(x.a, x.b) for x in got.collect()} == want


def test_incremental_pieces(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "h1"), ("b", "hx"), ("d", "h4")], "path string, content_hash string")
    assert {(x.path, x.status) for x in archive.name_status(old, new).collect()} == {("b", "M"), ("c", "D"), ("d", "A")}
    ch = spark.createDataFrame([("R90", "x", "y", 1), ("C100", "p", "q", 2), ("M", "y", None, 3)], "status string, path string, new_path string, pos int")
    assert {(x.path, x.status) for x in archive.expand_renames(ch).collect()} == {("x", "D"), ("y", "M"), ("q", "A")}
    runs = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("t", 1, False), ("t", 2, False)], "slug string, n int, ok boolean")
    assert {(x.slug, x.n) for x in incremental.keep_last_good(runs, ["slug"], ["n"], F.col("ok")).collect()} == {("s", 1), ("t", 2)}
    a = spark.createDataFrame([("k", "me", "x")], "k string, owner string, v string")
    b = spark.createDataFrame([("k", "you", "y"), ("z", "you", "y")], "k string, owner string, v string")
    assert {tuple(x) for x in incremental.set_once(a, b, ["k"], ["owner"]).collect()} == {("k", "me", "y"), ("z", "you", "y")}


def test_planning_and_quality(spark):
    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"])], "id int, tokens array<string>")
    groups = spark.createDataFrame([(9, ["a"]), (8, ["b", "a", "a"]), (7, ["q"])], "id int, tokens array<string>")
    assert [tuple(x) for x in planning.overlap_assign(items, groups).collect()] == [(1, 8, 2)]
    roots = spark.createDataFrame([("a", "A"), ("a/b", "B")], "root string, name string")
    got = planning.longest_prefix(spark.createDataFrame([("a/b/c.py",), ("a/bc.py",), ("x",)], "p string"), roots, "p", "root", "name")
    assert {x.p: x.name for x in got.collect()} == {"a/b/c.py": "B", "a/bc.py": "A", "x": ""}
    m = spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"a": 1.0},)], "d map<string,double>")
    assert {x.metric: x.average for x in quality.detail_averages(m, "d").collect()} == {"a": 1.0, "b": 1.0}
    g = quality.gates(spark.createDataFrame([(0.5, 0.9)], "x double, y double"), {"x": 0.6, "y": 0.9}).collect()
    assert {x.gate: x.passed for x in g} == {"x": False, "y": True, "all": False}


def test_parsers(spark):
    src = {"a/x.py": ("python", "import os\nfrom b.y import helper\n\nclass A:\n    def go(self):\n        return helper('f(x)')\n\ndef _p():\n    pass\n@app.get('/users/{id}')\n"), "b/y.py": ("python", "def helper():\n    pass\n"), "c.zz": ("", "def f():\n")}
    df = spark.createDataFrame([(k, *v) for k, v in src.items()], "file_path string, language string, text string")
    s = {(x.file_path, x.name, x.start_line, x.end_line, x.visibility) for x in parsers.symbols(df, ["file_path"]).collect()}
    assert s == {("a/x.py", "A", 4, 4, "public"), ("a/x.py", "go", 5, 7, "public"), ("a/x.py", "_p", 8, 10, "private"), ("b/y.py", "helper", 1, 2, "public")}
    e = parsers.resolve_calls(parsers.calls(df, ["file_path"]), parsers.symbols(df, ["file_path"]), "file_path").collect()
    assert ("a/x.py", "b/y.py", "helper", "local", 1) in {tuple(x) for x in e} and not any(x.callee_symbol == "f" for x in e)
    i = parsers.resolve_imports(parsers.imports(df, ["file_path"]), df.select("file_path"), "file_path").collect()
    assert {tuple(x) for x in i} == {("a/x.py", "b/y.py")}
    assert [(x.framework, x.method, x.path) for x in parsers.routes(df, ["file_path"]).collect()][0][1:] == ("GET", "/users/{id}")


def test_sources(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text("print(1)\n")
    (root / "blank.py").write_text(" \n")
    (root / "bin.dat").write_bytes(b"ab\0cd")
    (root / "node_modules" / "x.js").write_text("x")
    found = archive.scan_directory(spark, str(root), ["node_modules"])
    assert {x.path for x in found.collect()} == {"a.py", "blank.py", "bin.dat"}
    kept = archive.archiveable(found)
    assert [x.path for x in kept.collect()] == ["a.py"]
    files, blobs = archive.build_archive(kept.select("path", "text"))
    assert files.first().language == "python" and blobs.count() == 1
    out = str(tmp_path / "t")
    archive.write_swapped(files, out)
    archive.write_swapped(files, out)
    assert spark.read.parquet(out).count() == 1 and len([p for p in tmp_path.iterdir() if p.name.startswith("t")]) == 1
    archive.write_jsonl(files, str(tmp_path / "j"))
    assert archive.read_jsonl(spark, str(tmp_path / "j"), "file_path string, total_lines int").first().total_lines == 1
    spec = spark.createDataFrame([('{"paths": {"/u": {"get": {"summary": "s"}, "parameters": {}}}}',), ("nonsense",)], "text string")
    assert [(x.method, x.path, x.summary) for x in archive.openapi_endpoints(spec).collect()] == [("GET", "/u", "s")]


def test_closure_over_a_long_chain(spark):
    m = spark.createDataFrame([(g, g + k) for g in range(103) for k in (0, 1)], "grp int, item int").coalesce(1)
    assert graph.closure(m, spark.createDataFrame([(0,)], "item int")).select("grp").distinct().count() == 103


@pytest.mark.parametrize("n", [1, 7])
def test_same_result_for_any_number_of_partitions(spark, data, n):
    from strataloom.plans import retrieval

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = {tuple(x) for x in retrieval.bm25_documents(spark, data).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    asked = {x.doc_id for x in spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 20 = 0 and text is not null").collect()}
    assert asked and {x[0] for x in got} <= asked and 5 * len(asked) < len(got) <= 10 * len(asked)
    assert got == {tuple(x) for x in retrieval.bm25_documents(spark, data).collect()}


def test_bounded_sample(spark):
    from strataloom.session import bounded_sample

    df = spark.range(5000).withColumnRenamed("id", "k")
    a = [x.k for x in bounded_sample(df, ["k"], 300).collect()]
    b = [x.k for x in bounded_sample(df.repartition(7), ["k"], 300).collect()]
    assert sorted(a) == sorted(b) and 200 < len(a) <= 300
    assert bounded_sample(df.limit(20), ["k"], 300).count() == 20 and bounded_sample(df.limit(0), ["k"], 300).count() == 0


def test_enclosing_and_import_evidence(spark):
    s = spark.createDataFrame([("f", "A", "class", 1, 20), ("f", "B", "class", 5, 10), ("f", "m", "function", 6, 7), ("f", "n", "function", 12, 13), ("f", "z", "function", 30, 31)], "file_path string, name string, kind string, start_line int, end_line int")
    assert {x.name: x.owner for x in parsers.enclosing(s, ["file_path"]).collect()} == {"A": "", "B": "A", "m": "B", "n": "A", "z": ""}
    syms = spark.createDataFrame([("a", "go"), ("b", "go"), ("c", "run"), ("d", "run"), ("c", "solo")], "file_path string, name string")
    calls = spark.createDataFrame([("x", "go"), ("x", "run"), ("x", "solo"), ("a", "go"), ("x", "none")], "file_path string, callee string")
    links = spark.createDataFrame([("x", "b"), ("x", "c"), ("x", "d")], "file_path string, target string")
    got = {(x.caller_file, x.callee_symbol): x.callee_file for x in parsers.resolve_calls(calls, syms, "file_path", links).collect()}
    assert got == {("x", "go"): "b", ("x", "run"): "", ("x", "solo"): "c", ("a", "go"): "a", ("x", "none"): ""}


@pytest.mark.parametrize("limit", [5, 12, 40])
def test_split_sections(spark, limit):
    texts = ["one\n\ntwo three\n\n" + "x" * 30 + "\nshort\n\nend", "a", "", "\n\n", None, "word " * 20]
    got = {}
    for x in chunking.split_sections(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t", ["k"], limit).orderBy("k", "part").collect():
        got.setdefault(x.k, []).append(x.text)
        assert 0 < len(x.text) <= limit
    assert got.keys() == {0, 1, 5}
    for k, parts in got.items():
        assert "".join("".join(parts).split()) == "".join(texts[k].split())


def test_budgets_and_follow_ups(spark):
    t = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc"), (2, 1, None)], "g int, o int, t string")
    assert [x.t for x in hybrid.trim_budget(t, ["g"], ["o"], "t", 6).orderBy("o").collect()] == ["aaaa", "bb"]
    h = spark.createDataFrame([(1, 0.9, ["b", "a"]), (1, 0.8, ["a", "", "c", "d"])], "q int, s double, terms array<string>")
    assert [x.term for x in hybrid.first_seen_terms(h, "q", "terms", [F.desc("s")], 10, 3).orderBy("n").collect()] == ["b", "a", "c"]
    j = spark.createDataFrame([(1, '[{"a": 1}]'), (2, '{"cases": [{"a": 2}, {"a": 3}]}'), (3, '{"results": [{"a": 4}]}'), (4, "x"), (5, "{}")], "k int, text string")
    assert {(x.k, x.a) for x in archive.json_cases(j, "a int").collect()} == {(1, 1), (2, 2), (2, 3), (3, 4)}
