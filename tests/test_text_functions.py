"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import text as tx
from waymark.functions.fuzzy import fuzzy_score, highlights_text, match_positions, query_chars, to_highlights
from waymark.operators.build import classify_node, relative_path
from waymark.operators.queries import parse_line_suffix, parse_scope_prefix
from waymark.sources.corpus import parse_exclude_list


def values(spark, rows, ddl, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def one(spark, fn, inputs):
    return [r[0] for r in values(spark, [(i,) for i in inputs], "v string", fn(F.col("v")))]


def mask(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    return [r.m for r in tx.with_mask(df, F.col("v"), "m").collect()]


def test_masks(spark):
    a, z, digit, other, wide = 1, 1 << 25, 1 << 26, 1 << 30, 1 << 31
    got = mask(spark, ["a", "Z", "a z", "07", " ", "", "_", "é", "e\u0301", "漢", "😀", "a1-é", None])
    e = 1 << 4
    assert got == [a, z, a | z, digit, 0, 0, other, e, e, wide, wide, a | digit | other | e, 0]


def test_normalize_path(spark):
    got = one(spark, tx.normalize_path, ["/a/./b/../c", "a\\b\\c", "/a//b/", "/../x", "../x/..", "a", "", "."])
    assert got == ["/a/c", "a/b/c", "/a/b", "/x", "..", "a", ".", "."]


def test_uri_to_path(spark):
    got = one(spark, tx.uri_to_path, ["file:///usr/a%20b", "file:///c%3A/x/../y", "file://host/x", "/plain+1", "file:///a+b"])
    assert got == ["/usr/a b", "c:/y", "host/x", "/plain+1", "/a+b"]


def test_language_of(spark):
    got = one(spark, tx.language_of, ["a.ts", "x/B.TSX", "a.b/c", ".py", "m.hpp", "a.rb", "n.unknown"])
    assert got == ["typescript", "typescriptreact", "", "", "cpp", "ruby", ""]


def test_titles(spark):
    ids = ["workbench.action.files.save", "editor.action.formatDocument", "vscode.open", "my.URLApp", "a..b.", "x1Y", "getHTTPStatus"]
    assert one(spark, tx.id_to_title, ids) == ["Files Save", "Format Document", "Open", "My URL App", "A B", "X1Y", "Get HTTP Status"]


def test_routes_helpers(spark):
    rows = [("api/", "/x"), ("api", "x"), ("", "x"), ("api", ""), (None, "x"), ("api", None)]
    got = [r[0] for r in values(spark, rows, "a string, b string", tx.combine_routes(F.col("a"), F.col("b")))]
    assert got == ["api/x", "api/x", "x", "api", "x", "api"]
    rows = [("api/[controller]", "UserController"), ("[controller]/[controller]", "Home"), ("x", "A")]
    got = [r[0] for r in values(spark, rows, "p string, c string", tx.resolve_controller_token(F.col("p"), F.col("c")))]
    assert got == ["api/User", "Home/[controller]", "x"]


def test_escape_and_clamp(spark):
    assert one(spark, tx.escape_literal, ["a.b*c", "(x)[y]{z}", "a\\b", "$^|?+", "plain"]) == [
        "a\\.b\\*c", "\\(x\\)\\[y\\]\\{z\\}", "a\\\\b", "\\$\\^\\|\\?\\+", "plain"]
    clamp = lambda c: tx.clamp_or_default(c, 1, 1000, 100)
    assert one(spark, clamp, ["5", "0", "5000", "x", None, "NaN"]) == [5.0, 1.0, 1000.0, 100.0, 100.0, 100.0]


@pytest.mark.parametrize(
    "pattern,path,expected",
    [
        ("**/node_modules/**", "a/node_modules/b.js", True),
        ("**/node_modules/**", "node_modules/.bin/x", True),
        ("**/node_modules/**", "a/node_modules_x/b.js", False),
        ("**/dist/**", "dist", False),
        ("*.log", "a.log", True),
        ("*.log", "b/a.log", False),
        ("src/*/x", "src//x", False),
        ("a/{b,c}/?.ts", "a/c/z.ts", True),
        ("[!a]x", "bx", True),
    ],
)
def test_globs(pattern, path, expected):
    import re

    assert bool(re.match(tx.any_glob_regex([pattern]), path)) is expected


def test_exclude_list():
    assert parse_exclude_list("{a, b,,c }") == ["a", "b", "c"]
    assert parse_exclude_list("a,b") == [] and parse_exclude_list(None) == []


def test_relative_time(spark):
    s = 1_000_000
    ages = [59 * s, 60 * s, 59 * 60 * s, 3600 * s, 23 * 3600 * s, 24 * 3600 * s, 48 * 3600 * s]
    got = [r[0] for r in values(spark, [(a,) for a in ages], "v bigint", tx.relative_time(F.col("v")))]
    assert got == ["just now", "1m ago", "59m ago", "1h ago", "23h ago", "yesterday", "2d ago"]


def test_durations_and_labels(spark):
    got = [r[0] for r in values(spark, [(0.5,), (12.345,), (2500.0,)], "v double", tx.format_duration(F.col("v")))]
    assert got == ["500.00μs", "12.35ms", "2.50s"] or got == ["500.00μs", "12.34ms", "2.50s"]
    got = [r[0] for r in values(spark, [(0,), (1,), (7,)], "v int", tx.count_label(F.col("v"), "reference"))]
    assert got == ["no references", "1 reference", "7 references"]


def fuzzy(spark, q, texts):
    df = spark.createDataFrame([(q, t) for t in texts], "q string, t string")
    df = df.select(tx.fold(F.col("q")).alias("q"), tx.fold(F.col("t")).alias("t")).withColumn("c", query_chars("q"))
    df = df.withColumn("s", fuzzy_score("q", "c", "t")).withColumn("p", match_positions("q", "c", "t"))
    df = df.withColumn("r", to_highlights("p")).select("s", highlights_text("r").alias("h"))
    return [(r.s, r.h) for r in df.collect()]


def test_fuzzy(spark):
    got = fuzzy(spark, "empserv", ["EmployeeService.cs", "empserv", "serviceemp", "xEmpServ", None])
    assert 0 < got[0][0] < 0.6 and got[0][1] == "0-3,8-12"
    assert got[1] == (1.0, "0-7")
    assert got[2][0] is None
    assert got[3][0] == pytest.approx(0.70 + 0.25 * 7 / 8) and got[3][1] == "1-8"
    assert got[4][0] is None
    assert fuzzy(spark, "usebas", ["useCallback"])[0][0] is None
    assert fuzzy(spark, "FCC", ["File100Component.ts"])[0][0] is None
    assert fuzzy(spark, "user", ["userService"])[0][0] == pytest.approx(0.70 + 0.25 * 4 / 11 + 0.04)


def test_query_forms(spark):
    rows = ["/txt x", "/t x", "#x", ">x", "/txt", "/CLASSES y", "plain"]
    scope, text = parse_scope_prefix(F.col("v"))
    got = values(spark, [(r,) for r in rows], "v string", scope, text)
    assert got == [("text", "x"), ("types", "x"), ("symbols", "x"), ("commands", "x"), (None, "/txt"), ("types", "y"), (None, "plain")]
    text, line = parse_line_suffix(F.col("v"))
    got = values(spark, [("a:200",), ("a:0",), ("a",), ("a:b:7",)], "v string", text, line)
    assert got == [("a", 199), ("a", None), ("a", None), ("a:b", 6)]


def test_nodes_and_roots(spark):
    rows = [("abstract_class_declaration", "csharp"), ("struct", "c"), ("trait_definition", "php"), ("method_definition", "typescript"),
            ("function_definition", "python"), ("type_declaration", "go"), ("type_declaration", "java"), ("singleton_method", "ruby"),
            ("variable_declarator", "javascript"), ("block", "c")]
    got = [r[0] for r in values(spark, rows, "k string, l string", classify_node("k", "l"))]
    assert got == ["class", "class", "interface", "method", "function", "class", None, "method", "variable", None]
    rel = lambda c: relative_path(c, ["/w/a", "/w"])
    assert one(spark, rel, ["/w/a/x.ts", "/w/b/y.ts", "/z"]) == ["x.ts", "b/y.ts", "/z"]
