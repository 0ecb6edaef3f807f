"""Comments, strings, brackets and stacks that reach over many lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from waymark.functions import lexer as lx
from waymark.functions.scan import scan
from waymark.operators import build as bd

DOCS = "file_path string, language string, text string"


def plain_lexer(text):
    """Typescript read character by character: rows as `code_lines` gives them."""
    state, stack, out = "", "", []
    for number, raw in enumerate(text.split("\n")):
        line = re.sub(r"\\.", "__", raw)
        code, kept, first, i = "", "", stack, 0
        while i < len(line):
            two = line[i : i + 2]
            if state == "":
                if two == "//":
                    code, kept, i = code + " " * (len(line) - i), kept + " " * (len(line) - i), len(line)
                    continue
                if two == "/*":
                    state, code, kept, i = "/*", code + "  ", kept + "  ", i + 2
                    continue
                c = line[i]
                if c in "\"'`":
                    state, code, kept = c, code + " ", kept + c
                else:
                    code, kept = code + c, kept + c
                    if c in "([{":
                        stack += c
                    elif c in ")]}":
                        stack = stack[:-1]
                i += 1
            elif state == "/*":
                n = 2 if two == "*/" else 1
                state = "" if n == 2 else state
                code, kept, i = code + " " * n, kept + " " * n, i + n
            else:
                code, kept = code + " ", kept + line[i]
                state = "" if line[i] == state else state
                i += 1
        if state in ("'", '"'):
            state = ""
        touched = any(c in raw for c in "\"'`#/<=") or code != line
        row = [number, code if touched else raw, kept if touched else raw, first.count("{")]
        if first.endswith("("):
            out[-1][1] += " " + row[1]
            out[-1][2] += " " + row[2]
        else:
            out.append(row)
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_equal_a_reading_by_character(spark, seed):
    rng = random.Random(seed)
    parts = ["/*", "*/", "//", '"', "'", "`", "{", "}", "(", ")", "[", "]", "a", "é", "😀", " ", "\n", "\n", "\n", "\n", "x = 1", "\\n", "/", "*"]
    # Many lines, so that states pass several chunks.
    rare = [p for p in parts for _ in range(1 if p in ("/*", "`", "(", ")", "'") else 4)]
    texts = {f"/{i}": "".join(rng.choice(rare) for _ in range(rng.choice([0, 5, 60, 900, 4000]))) for i in range(25)}
    texts["/long"] = "a {\n/* x\n" + "class B {\n" * 300 + "*/ }\nb ` \n" + "{\n" * 200 + "` {\nc(\n" + "d,\n" * 150 + ") {\n e"
    rows = lx.code_lines(spark.createDataFrame([(p, "typescript", t) for p, t in texts.items()], DOCS), "file_path").collect()
    got = {}
    for r in rows:
        got.setdefault(r["file_path"], []).append((r["line"], r["code"], r["kept"], r["depth"]))
    for path, text in texts.items():
        assert sorted(got[path]) == plain_lexer(text), path


def test_unknown_languages_nulls_and_nothing(spark):
    docs = spark.createDataFrame([("/a", "prolog", "a /* {\n }"), ("/b", None, "x"), ("/c", "go", None), ("/d", "go", "")], DOCS)
    got = sorted((r["file_path"], r["line"], r["code"], r["depth"]) for r in lx.code_lines(docs, "file_path").collect())
    assert got == [("/a", 0, "a /* {", 0), ("/a", 1, " }", 1), ("/b", 0, "x", 0), ("/d", 0, "", 0)]
    assert lx.code_lines(docs.limit(0), "file_path").count() == 0


def test_names_after_comments_and_strings_with_braces(spark):
    text = 'class A {\n  // class Ghost {\n  s() {\n    const t = "class Fake {";\n  }\n}\nconst f = 1;\nclass B {\n  m() {\n  }\n}\n'
    docs = spark.createDataFrame([("/a.ts", "a.ts", "typescript", text)], "file_path string, relative_path string, language string, text string")
    got = {(r["line"], r["full_name"]) for r in bd.code_symbols(docs).collect()}
    assert got == {(0, "A"), (2, "A.s"), (3, "A.t"), (6, "f"), (7, "B"), (8, "B.m")}


def test_arrow_properties_and_split_declarations(spark):
    text = "class A {\n  run = (x) => {\n  }\n  async load(\n    a,\n    b\n  ) {\n    go(function () {\n    })\n  }\n  #own = async x => x\n}\n"
    docs = spark.createDataFrame([("/a.js", "a.js", "javascript", text)], "file_path string, relative_path string, language string, text string")
    got = {(r["line"], r["full_name"], r["type"]) for r in bd.code_symbols(docs).collect()}
    assert got == {(0, "A", "class"), (1, "A.run", "property"), (3, "A.load", "method"), (10, "A.#own", "property")}


def test_attributes_over_two_lines(spark):
    text = 'public class U : Base\n{\n    [HttpGet(\n      "one")]\n    public void One() {}\n    [HttpGet("two")]\n    public void Two() {}\n}\n'
    got = {(r["name"], r["line"]) for r in bd.controller_endpoints(spark.createDataFrame([("/c.cs", text)], "file_path string, text string")).collect()}
    assert got == {("[GET] one", 2), ("[GET] two", 5)}


# ------------------------------------------------------------------------ scan


@pytest.mark.parametrize("width", [2, 7, 64])
def test_scan_equals_a_walk(spark, width):
    rng = random.Random(width)
    rows = [(k, i, rng.choice("abcdef")) for k, n in (("x", 1), ("y", 200), ("z", 33)) for i in rng.sample(range(1000), n)]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    got = {(r["k"], r["at"]): r["before"] for r in scan(df, ["k"], ["at"], F.col("v"), lambda a, b: F.concat(a, b), width=width).collect()}
    for k in "xyz":
        seen = None
        for _, at, v in sorted(r for r in rows if r[0] == k):
            assert got[k, at] == seen
            seen = (seen or "") + v
    assert len(got) == len(rows)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_deep_nests_need_no_larger_plan(spark):
    def nest(depth):
        rows = [("/f", i, i, f"t{i}", "class") for i in range(depth)] + [("/f", depth + i, depth - i, "x", "method") for i in range(0, depth, 50)]
        return spark.createDataFrame(rows, "file_path string, line int, depth int, name string, type string")

    deep = bd.qualify_names(nest(500))
    names = {(r["line"]): r["container"] for r in deep.collect()}
    assert names[499] == ".".join(f"t{i}" for i in range(499)) and names[0] is None
    assert names[500] == ".".join(f"t{i}" for i in range(500)) and names[550] == ".".join(f"t{i}" for i in range(450))
    # Both lie between 64 and 64 * 64 rows.
    assert exchanges(bd.qualify_names(nest(500))) == exchanges(bd.qualify_names(nest(70)))


def test_rows_of_one_line_keep_their_order(spark):
    rows = [("/f", 0, 0, 0, "A", "class"), ("/f", 0, 1, 1, "m", "method"), ("/f", 0, 2, 0, "B", "class"), ("/f", 0, 3, 1, "n", "method")]
    s = spark.createDataFrame(rows, "file_path string, line int, nth int, depth int, name string, type string")
    assert [r["full_name"] for r in bd.qualify_names(s).orderBy("nth").collect()] == ["A", "A.m", "B", "B.n"]
    assert bd.qualify_names(s.limit(0)).count() == 0
