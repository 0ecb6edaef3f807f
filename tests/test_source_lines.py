"""Only the lines that results point to are fetched."""

from waymark.operators import results as rs


def test_lines_of_documents_equal_those_of_all_lines(spark):
    docs = spark.createDataFrame([("/a", "x\ny\n\nz"), ("/b", "one"), ("/c", None), ("/d", "unused")], "file_path string, text string")
    rows = [(1, "/a", 0), (2, "/a", 3), (3, "/a", 3), (4, "/a", 2), (5, "/a", 9), (6, "/b", 0), (7, "/c", 0), (8, "/none", 1), (9, "/b", None), (10, "/b", -1)]
    results = spark.createDataFrame(rows, "qid int, file_path string, line int")
    lines = docs.selectExpr("file_path", "posexplode(split(text, '\\n')) as (line, text)")
    got = sorted((r["qid"], r["text"]) for r in rs.source_lines(results, docs).collect())
    assert got == [(1, "x"), (2, "z"), (3, "z"), (4, ""), (6, "one")]
    assert got == sorted((r["qid"], r["text"]) for r in rs.source_lines(results, lines).collect())
    assert sorted((r["file_path"], r["line"]) for r in rs.needed_lines(results, docs).collect()) == [("/a", 0), ("/a", 2), ("/a", 3), ("/b", 0)]
    assert rs.source_lines(results.limit(0), docs).count() == 0
