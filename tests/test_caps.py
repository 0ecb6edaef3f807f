"""No operator cuts what its caller did not ask it to cut."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import build, grep, ranking, relations, results  # noqa: F401
from waymark.operators.answers import answer
from waymark.operators.commands import suggest_commands
from waymark.operators.index import item_features
from waymark.schema import conform_items

QUERY = "qid int, query string, scope string, max_results int"


def items_of(spark, n, kind="class"):
    raw = spark.range(n).selectExpr(
        "id as seq", "concat('i', id) as id", "concat('Widget', id) as name", f"'{kind}' as type", "concat('/f', id, '.ts') as file_path"
    )
    return item_features(conform_items(raw))


def test_as_many_results_as_asked_for(spark):
    asked = spark.createDataFrame([(1, "widget", "everything", 1400)], QUERY)
    assert ranking.search(asked, items_of(spark, 1500)).count() == 1400


def test_names_and_settings_at_any_depth(spark):
    rows = [("/f", i, i, f"n{i}", "class") for i in range(13)]
    named = build.qualify_names(spark.createDataFrame(rows, "file_path string, line long, depth int, name string, type string"))
    assert named.filter("depth = 12").first()["full_name"] == ".".join(f"n{i}" for i in range(13))
    json = "".join(f'{{"k{i}":' for i in range(10)) + "1" + "}" * 10
    flat = build.flatten_settings(spark.createDataFrame([("o", 1, json)], "owner string, ord int, json string")).collect()
    assert [(r["key"], r["value"]) for r in flat] == [(".".join(f"k{i}" for i in range(10)), "1")]


def test_cycles_are_refused(spark):
    nodes = [("a", None, "A", 4), ("b", "a", "B", 4), ("a", "b", "A", 4)]
    with pytest.raises(ValueError, match="cycle"):
        build.flatten_symbol_tree(spark.createDataFrame(nodes, "id string, parent_id string, name string, kind int"))


def test_long_lines_and_big_files_are_searched(spark):
    docs = spark.createDataFrame([(1, "/a", 31457280, "x" * 10004 + " needle"), (2, "/b", 1, "needle\0needle")], "seq int, file_path string, size long, text string")
    asked = spark.createDataFrame([(1, "needle", None)], "qid int, query string, max_results int")
    assert grep.grep(docs, asked).count() == 2
    assert grep.grep(docs, asked, max_bytes=20 << 20).count() == grep.grep(docs, asked, max_line=10000).count() == 1
    hit = grep.grep_submatches(docs.filter("seq = 2"), asked).first()["submatches"]
    assert [(m["start"], m["end"]) for m in hit] == [(0, 6), (7, 13)]


def test_catalogs_of_any_size(spark):
    commands = spark.range(1200).selectExpr("cast(id as int) as ord", "concat('/c', id) as name", "concat('c', id) as short_name", "'' as description", "array('') as aliases", "'x' as category", "'y' as scope")
    recent = spark.createDataFrame([("/c7", 2), ("/c7", 1)], "name string, recent_pos int")
    typed = spark.createDataFrame([(1, "")], "qid int, typed string")
    out = suggest_commands(typed, commands, recent)
    assert out.count() == 1200 and out.orderBy("rank").first()["name"] == "/c7"


def test_one_entry_answers_every_kind(spark):
    asked = spark.createDataFrame([(1, "widget3", "everything", 5), (2, " ", "everything", 5), (3, "hello", "text", 5), (4, None, "open", 5)], QUERY)
    docs = spark.createDataFrame([(1, "/f1.ts", 1, "say Hello\nagain hello")], "seq int, file_path string, size long, text string")
    used = spark.createDataFrame([("i4", 1.0), ("i9", 0.5)], "item_id string, score double").withColumn("last_accessed", F.lit("2024-01-01").cast("timestamp_ntz"))
    opened = spark.createDataFrame([("/f9.ts",)], "file_path string")
    out = answer(asked, items_of(spark, 20), used, F.lit("2024-01-02").cast("timestamp_ntz"), docs, opened).collect()
    kinds = {}
    for r in out:
        kinds.setdefault(r["qid"], []).append((r["kind"], r["id"]))
    assert ("ranked", "i3") in kinds[1] and sorted(kinds[2]) == [("recent", "i4"), ("recent", "i9")]
    assert len(kinds[3]) == 2 and kinds[3][0][0] == "text" and kinds[4] == [("recent", "i9")]


def test_declaration_forms(spark):
    text = ["readonly int A(int x)", "Map<T>(T x) {", "extern void B();", "return C();"]
    lines = spark.createDataFrame([("/f", i, t) for i, t in enumerate(text)], "file_path string, line int, text string")
    assert [r["name"] for r in relations.declaration_marks(lines).orderBy("line").collect()] == ["A", "Map", "B"]


def test_generic_methods_without_a_modifier(spark):
    text = ["Pair<K, V>(K key, Func<V> make = f()) {", "Sort<T>(T[] all) where T : IComparable, new() {", "Call<int>(x);", "a < b > (c) d", "Fill<T>(T x) where T : class {", "Deep<A.B?>(int[] y){"]
    lines = spark.createDataFrame([("/f", i, t) for i, t in enumerate(text)], "file_path string, line int, text string")
    got = {r["line"]: r["name"] for r in relations.declaration_marks(lines).collect()}
    assert got == {0: "Pair", 1: "Sort", 4: "Fill", 5: "Deep"}
