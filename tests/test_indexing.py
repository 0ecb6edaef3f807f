"""The index build as one job: its rows are those of its parts, and searches read it."""

from pyspark.sql import functions as F

from waymark.operators import build as bd
from waymark.operators import fast as fs
from waymark.operators import indexing as ixg
from waymark.operators import ranking as rk
from waymark.plans import build_plans as bp
from waymark.schema import conform_items
from waymark.sources import corpus as cp

LISTING = "seq bigint, file_path string, relative_path string, size bigint, text string"


def test_items_are_the_union_of_the_parts(spark, sf):
    files, verdicts, commands = bp.workspaces(spark, sf)
    items = ixg.index_items(files, verdicts, commands)
    kept = ixg.kept_files(files, verdicts).cache()
    parts = [cp.file_items(kept).select("id"), bd.code_symbols(kept).select("id"), commands.filter("command_id not like '\\\\_%'").selectExpr("concat('command:', command_id) as id")]
    sharp = kept.filter("language = 'csharp'")
    parts += [bd.controller_endpoints(sharp).select("id"), bd.minimal_api_endpoints(sharp).select("id")]
    want = sorted(r["id"] for p in parts for r in p.collect())
    rows = items.collect()
    assert sorted(r["id"] for r in rows) == want and len({r["seq"] for r in rows}) == len(rows)
    # Files before declarations before endpoints before commands, each in the order of the listing and its lines.
    kinds = ["file" if r["type"] == "file" else r["type"] if r["type"] in ("endpoint", "command") else "symbol" for r in sorted(rows, key=lambda r: r["seq"])]
    assert sorted(set(kinds), key=kinds.index) == ["file", "symbol", "endpoint", "command"] and kinds == sorted(kinds, key=["file", "symbol", "endpoint", "command"].index)
    own = [(r["file_path"], r["line"]) for r in sorted(rows, key=lambda r: r["seq"]) if r["type"] in ("class", "method") and r["file_path"].startswith("/ws1/") and r["file_path"].endswith("a.cs")]
    assert own == sorted(own)


def test_odd_listings(spark):
    rows = [(1, "/a/x.ts", "x.ts", 3, "class A {"), (2, "/a/./x.ts", "x.ts", 3, "class B {"), (3, "/a/n.ts", "n.ts", None, None), (4, "/a/README", "README", 0, ""),
            (5, "/a/g.cs", "g.cs", 9, "/* <auto-generated> */ public class G {}")]
    listing = spark.createDataFrame(rows, LISTING)
    got = {(r["type"], r["file_path"], r["name"]) for r in ixg.index_items(listing).collect()}
    assert got == {("file", "/a/./x.ts", "x.ts"), ("class", "/a/./x.ts", "B"), ("file", "/a/n.ts", "n.ts"), ("file", "/a/README", "README")}
    assert ixg.index_items(listing.limit(0)).count() == 0


def test_searches_read_a_built_index(spark):
    rows = [(i, f"/w/f{i}.ts", f"f{i}.ts", 9, f"class Widget{i} {{\n  paint{i}() {{\n  }}\n}}\n") for i in range(12)]
    rows.append((99, "/w/c.cs", "c.cs", 9, bp.src.CONTROLLER.replace("§", "1")))
    index = ixg.build_index(spark.createDataFrame(rows, LISTING), grams=True)
    asked = spark.createDataFrame([(1, "widget7", "everything", 3), (2, "paint3", "symbols", 3), (3, "POST api/S1/two", "endpoints", 3)], "qid int, query string, scope string, max_results int")
    best = {r["qid"]: r["name"] for r in rk.search(asked, index.features, route_keys=index.routes).filter("rank = 1").collect()}
    assert best == {1: "Widget7", 2: "paint3", 3: "[POST] api/S1/two"}
    quick = {r["qid"]: r["name"] for r in fs.fast_search(asked, index.features, route_keys=index.routes, grams=index.grams).filter("rank = 1").collect()}
    assert quick[1] == "Widget7" and quick[2] == "paint3"
    assert set(conform_items(index.features).columns) <= set(index.features.columns) and index.features.select(F.count_distinct("id")).first()[0] == index.features.count()
