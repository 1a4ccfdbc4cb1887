import random

import pytest
from pyspark.sql import functions as F

from strataloom.llm.split import pieces, split_oversized
from strataloom.llm.units import definitions, headings, unit_lines


def cut(text, symbols=(), kind="code", path="a.py", limit=4000, lines=20, chars=200, start=0):
    return list(pieces(text, kind, list(symbols), path, None, start, limit, lines, chars))


def joined(ps):
    return "".join(p[2][p[9] :] for p in ps)


@pytest.mark.parametrize("seed", range(12))
def test_pieces_join_to_the_text_and_keep_the_limit(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "Satz. ", "\n", "\n\n", "x" * r.randrange(1, 400), "ünï ", "# H\n", "    def f():\n"]) for _ in range(r.randrange(1, 300)))
    limit = r.choice([2, 10, 57, 300, 4000])
    ps = cut(text, ["f"], r.choice(["code", "doc_full", None]), limit=limit, lines=r.choice([0, 3, 20]), chars=r.choice([0, 5, 200]))
    assert joined(ps) == text and all(0 < len(p[2]) <= limit or not text for p in ps)
    assert all(p[5] <= p[6] for p in ps) and [p[0] for p in ps] == list(range(1, len(ps) + 1))


def test_cut_at_units_without_overlap():
    body = "".join(f"def f{i}():\n" + "    pass  # filler line\n" * 60 + "\n" for i in range(6))
    text = "File: a.py\nLines: 11-400\n\n" + body
    ps = cut(text, [f"f{i}" for i in range(6)], start=11)
    assert [p[8] for p in ps[:-1]] == ["unit"] * (len(ps) - 1) and all(p[9] == 0 for p in ps)
    assert ps[1][3] == 11 + text[: text.index(ps[1][2])].count("\n") - 3 and ps[0][7] == ["f0", "f1"]


def test_overlap_of_lines_and_characters():
    ps = cut("\n".join(f"line {i} " + "y" * 40 for i in range(300)), kind="artifact")
    for a, b in zip(ps, ps[1:]):
        assert a[8] == "line" and b[2][: b[9]].count("\n") == 20 and a[2].endswith(b[2][: b[9]])
    ps = cut("z" * 9000, kind="artifact")
    assert [p[8] for p in ps] == ["character", "character", "end"] and ps[1][9] == 200
    ps = cut("word and. " * 900, kind="artifact")
    assert ps[0][8] == "sentence" and ps[1][9] == 200


def test_overlap_of_long_lines():
    ps = cut("\n".join(f"line {i:03} " + "y" * 150 for i in range(100)), kind="artifact")  # 20 lines have 3,200 characters
    assert all(a[8] == "line" and b[2][: b[9]].count("\n") == 20 for a, b in zip(ps, ps[1:]))
    ps = cut("\n".join(f"line {i:03} " + "y" * 290 for i in range(60)), kind="artifact")  # 13 have 3,900
    assert all(b[2][: b[9]].count("\n") == 12 for b in ps[1:])
    ps = cut("\n".join("z" * 3000 for _ in range(5)), kind="artifact")
    assert {p[8] for p in ps[:-1]} == {"line"} and {p[9] for p in ps[1:]} == {200}
    ps = cut("\n".join(("z" * 3000, "short") * 5), kind="artifact")
    assert len(ps) > 2 and all(p[9] >= 200 for p in ps[1:])
    text = "".join(f"# H{i}\n" + f"text {i}\n" * 30 + "\n" for i in range(3)) + "# Last\n\n" + "y" * 3999 + "\n"
    ps = cut(text, kind="doc_full")  # a piece of two lines, of which 20 lines before the cut are more
    assert [p[8] for p in ps[:2]] == ["unit", "paragraph"] and ps[2][2][: ps[2][9]].count("\n") == 20
    assert all(p[9] == 0 for p in cut("\n".join("z" * 3000 for _ in range(5)), kind="artifact", lines=0, chars=0))


PY = '''import os
# def a():
class K(Base):
    """def m(): in a docstring"""
    def m(self):
        a()
        x.m(1)
    async def n(
        self):
        pass

def other():
    def m(): pass
class L:
    def m(self): pass
def a() -> int:
    pass'''.split("\n")
JS = """export default class K {
  // m() {
  static async m(a) {
    if (a) {
      go(a, () => {});
    }
  }
  get n() {
  }
}
/* function a() {
*/
const a = async (x) => {
  const b = 1;
  m(x);
};
export function b(x) {
}
type T = {
}""".split("\n")


def test_definitions():
    assert definitions(PY, 0, ["K", "K.m", "K.n", "a", "missing"], "py") == {2: "K", 4: "K.m", 7: "K.n", 15: "a"}
    assert definitions(JS, 0, ["K", "K.m", "K.n", "a", "b", "T"], "js") == {0: "K", 2: "K.m", 7: "K.n", 12: "a", 16: "b", 18: "T"}
    go = "type S struct {\n}\nfunc (s *S) Run(a int) error {\n\trun()\n}\nfunc run() {\n}\nfunc (t *T) Run() {\n}".split("\n")
    assert definitions(go, 0, ["S", "S.Run", "run"], "go") == {0: "S", 2: "S.Run", 5: "run"}
    java = "public class S {\n    public List<Row> run(String a) {\n        return run(a);\n    }\n    S() {}\n}".split("\n")
    assert definitions(java, 0, ["S", "S.run"], "java") == {0: "S", 1: "S.run"}
    php = "<?php\nfinal class S {\n    // function run()\n    private static function run($a)\n    {\n        $this->run();\n    }\n}".split("\n")
    assert definitions(php, 0, ["S", "S.run"], "php") == {1: "S", 3: "S.run"}
    assert definitions(["class K:", "    def delete(self):", "    async def lock(self):", "        if x(1):"], 0, ["K.delete", "K.lock", "K.if"], "py") == {1: "K.delete", 2: "K.lock"}
    assert definitions(["class K {", "  delete(a) {", "    if (a) {", "  with(a) {"], 0, ["K.delete", "K.if", "K.with"], "js") == {1: "K.delete"}
    assert definitions(["    def m(self):", "        pass"], 0, ["K.m"], "py") == {0: "K.m"}  # its header lies outside


def test_headings():
    md = "# A\n#tag\n- #17\n```\n# no\n~~~\n```\n~~~~ md\n# no\n~~~\n~~~~\nTwo words\n---\n\n---\n- item\n---\n| a |\n---\n    # code\n####### seven\n## B ##\nC\n=".split("\n")
    assert [md[i] for i in headings(md, 0)] == ["# A", "Two words", "## B ##", "C"]
    assert set(unit_lines("Document: x\nPath: y\n\n# A\n", "doc_full", [], None, None)) == {0, 3}


def test_split_over_odd_rows(spark):
    long = "# H\n" + "text word.\n" * 800
    rows = [("a", "doc_full", long, [], "a.md", None, 0, "1"), ("a", "doc_full", long, [], "a.md", None, 0, "2"), ("b", None, "y" * 9001, None, None, None, None, "1"), ("c", "code", "short", ["f"], "a.py", "python", 1, "1"), ("d", "code", None, None, None, None, 1, "1"), (None, "code", long, [], "a", "b", 1, "1"), ("e", "code", "", [], "a", "b", 1, "1"), ("f", "code", "ü" * 4000, [], "a", "b", 1, "1")]
    df = spark.createDataFrame(rows, "chunk_id string, kind string, text string, symbol_names array<string>, file_path string, language string, start_line int, piece_no string")
    got = split_oversized(df)
    assert {x.chunk_id for x in got.collect()} == {"a", "b"}
    assert got.where("chunk_id = 'a'").groupBy("piece_no").count().where("count > 1").count() == 0  # repeated rows give one set
    assert got.agg(F.max(F.char_length("text"))).first()[0] <= 4000
    assert split_oversized(df.limit(0)).count() == 0
