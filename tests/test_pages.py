from pyspark.sql import functions as F

from strataloom.operators import evidence, validation


def test_validation(spark):
    good = "# Setup and use\n\n" + "word " * 120 + "`run()` lives in `a/b.py:3`.\n```\nx\n```\n"
    p = spark.createDataFrame([(1, good), (2, "# X\nTODO\n```\n`x/y.py` `z.py` `run()`"), (3, None), (4, "")], "id int, t string")
    known = spark.createDataFrame([("r/a/b.py",)], "f string")
    assert {x.page for x in validation.too_short(p, "id", "t").collect()} == {2, 4}
    assert [(x.page, x.detail) for x in validation.placeholders(p, "id", "t").collect()] == [(2, "todo")]
    assert [x.page for x in validation.unclosed_fences(p, "id", "t").collect()] == [2]
    assert [(x.page, x.detail) for x in validation.unknown_paths(p, "id", "t", known, "f", 1).collect()] == [(2, "2")]
    req = spark.createDataFrame([(1, "Setup"), (1, "Internal limits"), (2, "x")], "page int, section string")
    assert {(x.page, x.detail) for x in validation.missing_sections(p, "id", "t", req).collect()} == {(1, "Internal limits")}
    assert {x.id: (x.n_mentions, x.n_cited) for x in validation.citation_rate(p.where("id < 3"), "id", "t").collect()} == {1: (1, 1), 2: (1, 0)}


def test_rollups(spark):
    h = spark.createDataFrame([(1, f"f{i}", i / 10) for i in range(12)], "g int, f string, s double")
    r = evidence.primary_and_supporting(h, "g", "f", "s").orderBy("rank").collect()
    assert [x.role for x in r] == ["primary"] * 4 + ["supporting"] * 6 and r[0].f == "f11"
    c = evidence.capped_lists(spark.createDataFrame([(1, "a", x) for x in "dbca"] + [(1, "z", "q")], "g int, k string, v string"), ["g"], "k", "v", [F.col("v")], {"a": 2, "b": 1}).first()
    assert c.a == ["a", "b"] and c.b == []
    s = evidence.signals(spark.createDataFrame([("f", "x = os.getenv('HOME_DIR')\nlog.info('a')\nlog.info('b')"), ("g", None)], "f string, t string"), "f", "t")
    assert {(x.signal, x.value, x.n) for x in s.collect()} == {("environment", "HOME_DIR", 1), ("logger", "log.info", 2)}
    ln = spark.createDataFrame([(1, ["u", "", "u", "v"], ["t", None, "x", None])], "g int, urls array<string>, titles array<string>")
    assert [(x.url, x.title) for x in evidence.first_links(ln, "g", "urls", "titles").orderBy("rank").collect()] == [("u", "t"), ("v", "")]


def test_recursion(spark):
    m = spark.createDataFrame([("app", "api", "/api"), ("api", "users", "users/"), ("users", "api", "/loop")], "parent string, node string, path string")
    roots = spark.createDataFrame([("app", "")], "node string, prefix string")
    got = {(x.node, x.prefix) for x in evidence.compose_prefixes(m, roots, 2).collect()}
    assert got == {("app", ""), ("api", "/api"), ("users", "/api/users/")}
    v = spark.createDataFrame([("A", "@B"), ("B", "@C"), ("C", "lit"), ("X", "@Y"), ("Y", "@X"), ("D", "@none")], "name string, value string")
    assert {x.name: x.value for x in evidence.resolve_constants(v).collect()} == {"A": "lit", "B": "lit", "C": "lit", "X": None, "Y": None, "D": None}


def test_repairs(spark):
    p = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", [])], "slug string, files array<string>")
    kept, dropped = evidence.remove_files(p, "files", spark.createDataFrame([("x",)], "f string"), "f")
    assert {x.slug: x.files for x in kept.collect()} == {"a": ["y"], "c": []} and [x.slug for x in dropped.collect()] == ["b"]
    j = spark.createDataFrame([(1, 'Sure:\n```json\n{"a": [1, 2,],}\n```'), (2, "none"), (3, None), (4, "[1] {")], "k int, t string")
    assert {x.k: x.json for x in evidence.repair_json(j, "k", "t").collect()} == {1: '{"a": [1, 2]}', 2: None, 3: None, 4: "[1]"}
    a = spark.createDataFrame([(1, "app.get('/a,b', auth(x, y), [1, 2])"), (2, "none"), (3, None)], "k int, t string")
    assert [(x.k, x.argument) for x in evidence.split_arguments(a, "k", "t").orderBy("k", "pos").collect()] == [(1, "'/a,b'"), (1, "auth(x, y)"), (1, "[1, 2]")]
    f = spark.createDataFrame([("a\n```\nx",), ("[t] (https://x)",)], "t string").select(evidence.close_fences("t"))
    assert [x[0] for x in f.collect()] == ["a\n```\nx\n```\n", "[t](https://x)"]
    n = spark.createDataFrame([(1, '{"cells": [{"cell_type": "code", "source": ["a\\n", "b"]}]}'), (2, "x")], "k int, t string")
    assert [(x.cell_no, x.cell_type, x.source) for x in evidence.notebook_cells(n, "k", "t").collect()] == [(1, "code", "a\nb")]
