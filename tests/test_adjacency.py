"""Caller paths over stored edges: hubs are split, a level moves its tips only."""

import random

from waymark.operators import relations as rl

EDGES = "callee string, caller string, call_site int"


def walk(edges, root, depth):
    out, level = [(root,)], [(root,)]
    for _ in range(depth):
        level = [path + (caller,) for path in level if path.count(path[-1]) == 1 for callee, caller, _ in edges if callee == path[-1]]
        out += level
    return sorted(out)


def test_paths_equal_a_walk_whatever_is_a_hub(spark):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(12)]
    rows = [(rng.choice(names), rng.choice(names), i) for i in range(30)] + [("n0", f"x{i}", 100 + i) for i in range(60)] + [("n1", "n0", 999)]
    edges = spark.createDataFrame(rows, EDGES)
    roots = spark.createDataFrame([("n1",), ("n5",), ("none",)], "node string")
    want = sorted(p for r in ("n1", "n5", "none") for p in walk(rows, r, 3))
    for hub in (1, 7, 50_000):
        got = rl.caller_paths(rl.adjacency(edges, hub), roots, 3).collect()
        assert sorted(tuple(r["path"]) for r in got) == want
    split = rl.adjacency(edges, 7)
    assert {r["callee"] for r in split.hubs.collect()} >= {"n0"} and split.edges.filter("callee = 'n0'").select("part").distinct().count() > 4
    assert rl.caller_paths(edges.limit(0), roots, 3).count() == 3


def test_edges_are_not_moved_by_a_level(spark):
    edges = rl.adjacency(spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], EDGES))
    tips = spark.createDataFrame([("r", ["a"], "a")], "root string, path array<string>, callee string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = rl.step_up(tips, edges)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "caller" in x)
    indent = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    above = []
    for line in reversed(lines[:at]):
        depth = len(line) - len(line.lstrip(" :+-"))
        if depth < indent:
            above.append(line)
            indent = depth
    assert any("Join" in x for x in above) and not any("Exchange" in x for x in above), "\n".join(lines)
