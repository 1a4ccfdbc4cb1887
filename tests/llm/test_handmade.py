import base64
import gzip
import os

import pytest

from strataloom.llm.handmade import FAMILIES, RANGES, classify_files, inflate, layout, made_report, valleys

HAND = "// Copyright (c) the shop maintainers.\n" + "".join(f"function f{i}(a, b) {{\n  // writes the DO NOT EDIT notice\n  return a + {i};\n}}\n\n" for i in range(30))
MINI = "!function(a,b){a.x=1}(),var c=d.map(e=>e.f*3),function g(h){return h.i(5)}" * 60
CASES = {
    "r/a/src/hand.js": (HAND, None),
    "r/a/src/generated_report.js": ("const HEADER = 'Code generated by x. DO NOT EDIT.';\n" + HAND, None),
    "r/a/src/long_lines.js": (HAND + "const q = '" + "select a, b, c from d; " * 80 + "';\n", None),
    "r/a/src/gen1.go": ("// SPDX-License-Identifier: MIT\n//\n// Autogenerated from a.proto, manual changes will be overwritten\npackage a\n" + HAND, "generated"),
    "r/a/src/b.py": ("# eslint-disable\n# @generated by tool\n" + HAND, "generated"),
    "r/a/src/c.py": ("# Diese Datei wurde von x automatisch erzeugt - nicht von Hand ändern.\n" + HAND, "generated"),
    "r/a/src/d.php": ("<?php\n// Fichier généré par x, ne pas modifier\n" + HAND, "generated"),
    "r/a/src/e.js": ("// Vendored from upstream thing, release 5.1.0+57fe. Local edits will be lost.\n" + HAND, "vendored"),
    "r/a/src/f.go": ("// Thing v2.3.0+4384d410cd\n// (c) Thing contributors. Released under the MIT License.\n" + HAND, "vendored"),
    "r/a/vendor/x/g.go": (HAND, "vendored"),
    "r/a/gen/h.py": (HAND, "generated"),
    "r/a/public/i.js": (MINI, "minified"),
    "r/a/src/j.ts": ("export const T = [\n" + "  12, 34, 56, 78, 90, 11,\n" * 200 + "];\n", "data"),
    "r/a/src/k.py": ('D = "' + base64.b64encode(os.urandom(4000)).decode() + '"\n', "data"),
    "r/a/config/l.json": ("[" + "1,2,3,4," * 900 + "5]", None),
    "r/a/vendor/README.md": ("generated by x", None),
    "r/a/src/empty.py": ("", None),
}


@pytest.fixture(scope="module")
def got(spark):
    files = [(p, f"H{i:02d}", "x") for i, p in enumerate(CASES)] * 2 + [("r/a/vendor/y/missing.go", "nope", "x"), ("r/a/src/missing.go", "nope", "x"), ("r/a/dist/a.min.js", None, "x"), (None, "H00", "x"), ("r/a/src/cut.py", "cut", "x"), ("r/a/src/noend", "H01", None)]
    blobs = [(f"h{i:02d}", bytearray(gzip.compress(t.encode())), 1.0) for i, (t, _) in enumerate(CASES.values())]
    cut = gzip.compress(("# @generated by tool\n" + HAND * 20).encode())
    blobs += [blobs[0], ("cut", bytearray(cut[: len(cut) - 40]), 1.0), (None, None, None), ("nil", None, None)]
    f = spark.createDataFrame(files, "file_path string, content_hash string, size string")
    b = spark.createDataFrame(blobs, "content_hash string, compressed_content binary, white double")
    rows = classify_files(f, b).collect()
    assert classify_files(f.limit(0), b).count() == 0 and classify_files(f, b.limit(0)).where("file_path like '%vendor/x%' and made = 'vendored'").count() == 1
    assert len(rows) == len({x.file_path for x in rows})
    return {x.file_path: x.made for x in rows}


@pytest.mark.parametrize("path", CASES)
def test_cases(got, path):
    assert got[path] == CASES[path][1]


def test_unreadable_contents_are_judged_by_path(got):
    assert got["r/a/vendor/y/missing.go"] == "vendored" and got["r/a/src/missing.go"] is None and got["r/a/dist/a.min.js"] == "minified" and got["r/a/src/cut.py"] == "generated"
    assert None not in got and got["r/a/src/noend"] is None


def test_layout_of_odd_contents():
    assert inflate(None) is None and inflate(b"") is None and inflate(b"junk") is None
    assert layout(b"")[0] == 0 and layout("﻿".encode())[0] == 0 and layout(b"\xff\xfe\x00" * 50)[2] == 150
    assert layout(b"a" * 3_000_000)[2] == 3_000_000


@pytest.mark.parametrize("top", ["// line of a licence\n" * 40, "/*\n" + "Redistribution and use in source and binary forms are permitted.\n" * 300 + "*/\n", "# " + "x" * 9000 + "\n", "\n//\n" * 20_000])
def test_notice_after_a_long_licence(top):
    assert layout((top + "// Code generated by tool. DO NOT EDIT.\n" + HAND).encode())[7:] == (True, False)
    assert layout((top + "// Thing v2.3.0+4384d410cd\n" + HAND).encode())[7:] == (False, True)
    assert layout((top + HAND + "// Code generated by tool. DO NOT EDIT.\n").encode())[7:] == (False, False)


def test_short_files_need_no_rule(spark):
    texts = ["x = 1\n", "VERSION = '1.0'\n", "1", "a", "export default 3;\n", "module.exports = require('./lib/very/long/path/of/a/module/in/another/folder');"]
    f = spark.createDataFrame([(f"r/{i}.{e}", f"h{i}") for i in range(len(texts)) for e in ("py", "js")], "file_path string, content_hash string")
    b = spark.createDataFrame([(f"h{i}", bytearray(gzip.compress(t.encode()))) for i, t in enumerate(texts)], "content_hash string, compressed_content binary")
    assert classify_files(f, b, most=1).where("made is not null").count() == 0
    assert {(x.made, x.reason) for x in made_report(classify_files(f, b)).collect()} == {("hand-written", "")}


def test_thresholds_lie_in_the_valleys_of_each_language(spark):
    rows = [("py", 100, float(m), 400, 0.06, 0.2, 0.6, 0.9) for m in (115, 120, 130, 140, 480, 490)] * 3 + [("go", 100, 450.0, 400, 0.06, 0.2, 0.6, 0.9)]
    got = valleys(spark.createDataFrame(rows, "fam string, size int, mean_line double, max_line int, white double, numeric double, encoded double, alnum double"))
    assert 140 < got["py"]["mean_line"] < 480 and got["go"]["mean_line"] < 450 and all(RANGES[c][0] < got[f][c] < RANGES[c][1] for f in FAMILIES for c in RANGES)
