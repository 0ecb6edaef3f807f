"""The index under changes: the base stays where it lies."""

from waymark.streaming import upkeep as up

ITEMS = "id string, file_path string"


def test_reads_do_not_move_the_base(spark, tmp_path):
    root = str(tmp_path / "index")
    up.replace_items(spark.createDataFrame([("a", "/x/./a.ts"), ("b", "/b.ts"), ("c", "/c.ts")], ITEMS), root)
    spark.createDataFrame([("/x/a.ts",), ("/c.ts",)], "file_path string").write.parquet(f"{root}/removals/version=1")
    spark.createDataFrame([("a2", "/x/a.ts")], ITEMS).write.parquet(f"{root}/adds/version=1")
    spark.createDataFrame([("/c.ts",), ("/d.ts",)], "file_path string").write.parquet(f"{root}/removals/version=2")
    spark.createDataFrame([("d", "/d.ts")], ITEMS).write.parquet(f"{root}/adds/version=2")
    live = up.live_items(spark, root)
    assert sorted(r["id"] for r in live.collect()) == ["a2", "b", "d"] and live.columns == ["id", "file_path"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = up.live_items(spark, root)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "bucketed_" in x)
    indent, above = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        depth = len(line) - len(line.lstrip(" :+-"))
        if depth < indent:
            above.append(line)
            indent = depth
    assert any("Join" in x for x in above) and not any("Exchange" in x for x in above), "\n".join(lines)
    up.compact(spark, root, str(tmp_path / "small"))
    again, n = up.base_of(spark, str(tmp_path / "small"))
    assert n == 4 and sorted(r["id"] for r in again.collect()) == ["a2", "b", "d"]
