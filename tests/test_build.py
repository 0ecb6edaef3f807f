"""Listings, extraction, relations, usage and streams on small fixtures."""

import pytest
from pyspark.sql import functions as F

from waymark.functions.prefix import number_chunk, running, spread_chunk, time_chunk
from waymark.operators import activity as act
from waymark.operators import build as bd
from waymark.operators import commands as cm
from waymark.operators import relations as rl
from waymark.operators import results as rs
from waymark.operators import routes as rt
from waymark.operators import stats as st
from waymark.plans import catalog, stream_plans
from waymark.sources import corpus as cp
from waymark.streaming import signals as sg


def df(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# --------------------------------------------------------------------- routes

ROUTES = [
    ("api/Users/{id}", "api/users/5", 2.2),
    ("[GET] api/users", "GET /api/users/", 2.2),
    ("api/users/{id:int}", "api/users/abc", 2.2),
    ("api/users/{id?}", "api/users", 0.0),
    ("api/users/{id}", "users/5", 1.1),
    ("api/users/list", "api/users/li", 2.25),
    ("api/users/list", "users", 0.0),
    ("api/users", "api/users/5", 0.0),
    ("files/{*path}", "files/a/b/c", 2.1),
    ("files/{*path}", "files", 1.0),
    ("{*all}", "x/y", 2.0),
    ("en/{id}.html", "en/7.html", 2.2),
    ("a/{x}/b", "a//b", 0.0),
    ("{id}", "x", 2.0),
    ("a.b/c", "aXb/c", 0.0),
]


def test_route_scores(spark):
    p = rt.prepare_path(df(spark, [(i, r[1]) for i, r in enumerate(ROUTES)], "pid int, typed string"), "typed")
    t = rt.compile_template(df(spark, [(i, r[0]) for i, r in enumerate(ROUTES)], "tid int, template string"), "template")
    rows = rt.route_scores(p, t).filter("pid = tid").collect()
    got = {r.pid: r.route_score for r in rows}
    assert len(got) == len(rows)
    for i, (template, path, want) in enumerate(ROUTES):
        assert got.get(i, 0.0) == pytest.approx(want), (template, path)


def test_best_route_equals_cut_of_all(spark):
    paths = [(i, p) for i, p in enumerate(["api/u/1", "api/u", "x/y.html", "u/1", "api/v/2/e", "1"])]
    temps = ["api/u/{id}", "api/{x}/{id}", "{a}/{b}.html", "api/u", "{*r}", "v/{id}/e", "api/v/{id}/edit", "[POST] api/u/{id}"]
    p = rt.prepare_path(df(spark, paths, "pid int, typed string"), "typed").cache()
    t = rt.compile_template(df(spark, [(i, x) for i, x in enumerate(temps)], "tid int, template string"), "template").cache()
    every = sorted((r.pid, -round(r.route_score, 6), r.tid) for r in rt.route_scores(p, t).collect())
    want = [x for i in range(len(paths)) for x in [e for e in every if e[0] == i][:2]]
    got = sorted((r.pid, -round(r.route_score, 6), r.tid) for r in rt.best_routes(p, t, "pid", "tid", 2).collect())
    assert got == want
    verbs = df(spark, [(1, "post api/u/3"), (2, "get api/u/3")], "pid int, typed string")
    gated = rt.method_gate(rt.route_scores(rt.prepare_path(verbs, "typed"), t)).filter("tid = 7").collect()
    assert [(r.pid, round(r.route_score, 6)) for r in gated] == [(1, 2.7)]


# --------------------------------------------------------- extraction, settings

CONTROLLER = '''[ApiController]
[Route("api/[controller]")]
public class UsersController : ControllerBase
{
    [HttpGet("{id}")]
    public async Task<User> GetUser(int id) { return null; }

    [HttpPost]
    [Route("create")]
    public IActionResult Create() => Ok();

    [Obsolete]
    public void Helper() {}
}
'''


def test_controller(spark):
    d = df(spark, [("/c.cs", CONTROLLER)], "file_path string, text string")
    got = {(r.name, r.full_name, r.line) for r in bd.controller_endpoints(d).collect()}
    assert got == {
        ("[GET] api/Users/{id}", "UsersController.GetUser", 4),
        ("[POST] api/Users/create", "UsersController.Create", 7),
    }


def test_extract_and_qualify(spark):
    code = "export class A {\n  go() {}\n}\ninterface B {\n}\nexport async function f() {\n}\n"
    d = df(spark, [("/a.ts", "a.ts", "typescript", code)], "file_path string, relative_path string, language string, text string")
    found = bd.extract_symbols(d)
    assert [(r.name, r.type, r.line) for r in found.orderBy("line").collect()] == [("A", "class", 0), ("go", "method", 1), ("B", "interface", 3), ("f", "function", 5)]
    depth = {r.line: r.depth for r in bd.brace_depth(d.select("file_path", "text")).collect()}
    assert (depth[0], depth[1], depth[3]) == (0, 1, 0)
    rows = [("/f", 0, 0, "A", "class"), ("/f", 1, 1, "m", "method"), ("/f", 2, 2, "x", "variable"), ("/f", 3, 1, "I", "enum"),
            ("/f", 4, 2, "v", "property"), ("/f", 5, 0, "g", "function"), ("/f", 6, 2, "stray", "variable")]
    s = df(spark, rows, "file_path string, line int, depth int, name string, type string")
    for width in (1, 100):
        out = bd.qualify_names(s, chunk=number_chunk(F.col("line"), width)).orderBy("line").collect()
        assert [r.full_name for r in out] == ["A", "A.m", "A.x", "A.I", "A.I.v", "g", "stray"]


def test_settings(spark):
    rows = [(1, 1, '{"a":{"b":1,"c":[1,{"x":2}]},"n":null,"e":{}}'), (1, 2, '{"a":{"b":5}}'), (1, 3, "broken")]
    got = {(r.key, r.value) for r in bd.flatten_settings(df(spark, rows, "owner int, ord int, json string")).collect()}
    assert got == {("a.b", "5"), ("a.c", '[1,{"x":2}]'), ("n", None)}


def test_ignored_and_generated(spark):
    v = df(spark, [("/r", ".gitignore\x001\x00*.o\x00a.o\x00\x00\x00\x00b.c\x00x\x002\x00p\x00/abs/c\x00")], "root string, text string")
    assert {r.file_path for r in cp.ignored_paths(v).collect()} == {"/r/a.o", "/abs/c"}
    f = df(spark, [("/p/obj/A.cs",), ("/p/A.g.cs",), ("/p/A.Designer.CS",), ("/p/obj/a.ts",), ("/p/ok.cs",)], "file_path string")
    assert [r.file_path for r in cp.drop_generated_paths(f).collect()] == ["/p/A.Designer.CS", "/p/obj/a.ts", "/p/ok.cs"]
    t = df(spark, [("é" * 506 + "<auto-generated",), ("x" * 1009 + "<auto-generated",), ("x" * 1010 + "<auto-generated",)], "text string")
    assert cp.drop_generated_content(t).count() == 2


# -------------------------------------------------------------------- relations


def test_enclosing_declaration(spark):
    code = ["class A {", "  public void Run() {", "    call();", "  }", "  // public int Old()", "}", "class B {", "  call();", ""]
    lines = df(spark, [("/a.cs", i, t) for i, t in enumerate(code)], "file_path string, line int, text string")
    refs = df(spark, [("r1", "/a.cs", 2), ("r2", "/a.cs", 7), ("r3", "/b.cs", 4)], "ref_id string, file_path string, line int")
    for width in (1, 1000):
        out = rl.enclosing_declaration(refs, rl.declaration_marks(lines), number_chunk(F.col("line"), width))
        got = {r.ref_id: (r.owner, r.owner_line) for r in out.collect()}
        assert got == {"r1": ("Run", 1), "r2": ("call at line 8", 7), "r3": ("call at line 5", 4)}


def test_enclosing_symbol_is_outermost(spark):
    s = df(spark, [("/f", 0, 0, 9, 0, "outer", 1), ("/f", 2, 0, 4, 0, "inner", 2), ("/f", 20, 0, 22, 5, "late", 3)],
           "file_path string, line int, col int, end_line int, end_col int, name string, ord int")
    p = df(spark, [(1, "/f", 3, 1), (2, "/f", 9, 1), (3, "/f", 22, 5), (4, "/g", 3, 0)], "pos_id int, file_path string, line int, col int")
    got = {r.pos_id: r.symbol for r in rl.enclosing_symbol(p, s, number_chunk(F.col("line"), 2)).collect()}
    assert got == {1: "outer", 2: None, 3: "late", 4: None}


def test_caller_paths_with_cycle(spark):
    e = df(spark, [("a", "b", 1), ("a", "b", 2), ("b", "c", 3), ("c", "a", 4), ("c", "d", 5), ("d", "e", 6)], "callee string, caller string, call_site int")
    roots = df(spark, [("a",)], "node string")
    got = sorted("".join(r.path) for r in rl.caller_paths(e, roots).collect())
    assert got == sorted(["a", "ab", "ab", "abc", "abc", "abca", "abca", "abcd", "abcd", "abcde", "abcde"])
    named = e.select("callee", "caller", "call_site", F.lit("n").alias("name")).dropDuplicates(["callee", "caller"])
    got = sorted("".join(r.path) for r in rl.caller_paths_from_refs(named, roots).collect())
    assert got == sorted(["", "b", "bc", "bca", "bcd", "bcde"])


# ------------------------------------------------------------- usage, summaries


def test_running_matches_a_plain_window(spark):
    rows = [(i % 3, (i * 7) % 50, i, None if i % 4 == 0 else i) for i in range(100)]
    d = df(spark, rows, "k int, t int, id int, v int")
    specs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "g": ("lag", F.col("v"))}
    got = running(d, ["k"], ["t", "id"], number_chunk(F.col("t"), 5), specs)
    w = "(partition by k order by t, id"
    want = d.selectExpr("*", f"sum(v) over {w} rows unbounded preceding) as s", f"max(v) over {w} rows unbounded preceding) as m",
                        f"last(v, true) over {w} rows unbounded preceding) as l", f"lag(v) over {w}) as g")
    order = lambda x: sorted(map(str, x.select("k", "t", "id", "v", "s", "m", "l", "g").collect()))
    assert order(got) == order(want)


def test_chunks_follow_the_order_and_the_load(spark):
    secs = [i for i in range(400)] + [100_000 + i // 50 for i in range(400)]
    d = df(spark, [(s,) for s in secs], "s int").selectExpr("s", "cast(timestamp_seconds(s) as timestamp_ntz) as ts")
    rows = d.select("s", time_chunk(d, rows=20).alias("c")).orderBy("s").collect()
    chunks = [r.c for r in rows]
    assert chunks == sorted(chunks) and len(set(chunks)) > 15
    assert d.select(time_chunk(d).alias("c")).distinct().collect()[0].c == 0
    one = df(spark, [(5,), (7,)], "v bigint").select(spread_chunk("v", 100, [5, 5, 5], 10).alias("c"))
    assert {r.c for r in one.collect()} == {0}


def test_activity(spark):
    base = "2024-01-10 00:00:00"
    rows = [("a", base, 1), ("a", base, 2), ("b", "2024-01-09 00:00:00", 3), ("c", "2023-11-01 00:00:00", 4)]
    acc = df(spark, rows, "item_id string, t string, event_id int").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    now = F.lit(base).cast("timestamp_ntz")
    got = {r.item_id: r.score for r in act.activity_score(act.access_counts(acc), now).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == pytest.approx(0.5)
    kept = act.load_activity(act.access_counts(acc), act.access_counts(acc), now)
    assert {(r.item_id, r.access_count) for r in kept.collect()} == {("a", 4), ("b", 2)}
    empty = act.clear(act.activity_score(act.access_counts(acc), now))
    assert act.activity_stats(empty).first().average_score == 0.0


def test_nearest_rank(spark):
    rows = [("x", float(i)) for i in range(1, 1001)] + [("y", 5.0)] + [("z", 1.0)] * 500 + [("z", 2.0)] * 20
    got = {r.name: r.percentile for r in st.nearest_rank(df(spark, rows, "name string, value double"), 0.95).collect()}
    assert got == {"x": 950.0, "y": 5.0, "z": 1.0}


def test_reports(spark):
    m = df(spark, [("idle", 1234.567, 10.0, None, 0.5)], "name string, rss double, heap_total double, heap_used double, external double")
    assert st.memory_report(m).first().text == "| idle | 1234.57 | 10.00 |  | 0.50 |"
    one = st.latency_summary(df(spark, [("a", 0.25), ("a", 0.75)], "name string, value double"))
    row = st.latency_report({"suite": one}).first()
    assert row.text == "| a | 500.00μs | 1.00ms | 250.00μs | 750.00μs | 750.00μs | 250.00μs |"


# --------------------------------------------------------------- shown results


def test_result_rows(spark):
    r = df(spark, [(1, "i", "Run", "method", "/a.ts", "a.ts", 4, 2, "Svc", "det", 0.98765)],
           "qid int, id string, name string, type string, file_path string, relative_path string, line int, col int, container string, detail string, score double")
    assert rs.client_rows(r).first().unique_key == "/a.ts:5:Run:Method" and rs.client_rows(r).first().score == 9876
    d = rs.display_rows(r).first()
    assert (d.description, d.detail, d.reference) == ("Svc - det", "a.ts:5", "Svc.Run")
    loc = rs.symbol_locations(r).first()
    assert (loc.kind, loc.start_col, loc.end_col) == (6, 2, 5)
    t = df(spark, [(1, "/a", 0, "Foo", "x = FOO", 1), (2, "/a", 0, "zip", "x = FOO", 9)], "qid int, file_path string, line int, name string, text string, col int")
    assert [(x.start_col, x.end_col) for x in rs.locate_symbol(t).orderBy("qid").collect()] == [(4, 7), (7, 7)]


def test_commands(spark):
    catalog_rows = cm.slash_commands(spark)
    recent = df(spark, [("/FILES", 1), ("/grep", 2), ("/file", 3)], "used string, pos bigint")
    used = cm.recent_commands(catalog_rows, recent)
    assert {(r.name, r.recent_pos) for r in used.collect()} == {("/f", 1), ("/txt", 2)}
    typed = df(spark, [(1, "/f"), (2, "")], "qid int, typed string")
    out = cm.suggest_commands(typed, catalog_rows, used).orderBy("qid", "rank").collect()
    assert [r.name for r in out if r.qid == 1][:2] == ["/f", "/txt"]
    assert len([r for r in out if r.qid == 2]) == 10
    asked = df(spark, [(1, "#"), (2, "/API"), (3, "/none")], "qid int, asked string")
    assert {(r.qid, r.name) for r in cm.resolve_alias(asked, catalog_rows).collect()} == {(1, "/s"), (2, "/e")}


# ---------------------------------------------------------------------- streams


def test_guard(spark):
    secs = [0, 30, 60, 61, 100, 121, 122, 1000]
    rows = [("k", s, i) for i, s in enumerate(secs)]
    d = df(spark, rows, "key string, s int, event_id bigint").selectExpr("key", "cast(timestamp_seconds(s) as timestamp_ntz) as ts", "event_id")
    for rows in (1, 1000):
        got = sorted(r.event_id for r in sg.rebuild_guard(d, 60, chunk=time_chunk(d, rows=rows)).collect())
        assert got == [0, 3, 6, 7]


def test_changes_and_cooldown_over_many_chunks(spark, sf):
    from waymark.plans import tables as tb

    e = tb.load(spark, sf, "events").selectExpr("user_id as key", "ts", "event_id", "event_type as value", "event_type as kind").cache()
    fine = time_chunk(e, rows=20)
    pick = lambda d: sorted(r.event_id for r in d.collect())
    assert pick(sg.changes_only(e, chunk=fine)) == pick(sg.changes_only(e))
    marks, rest = e.filter("kind = 'purchase'"), e.filter("kind <> 'purchase'")
    assert pick(sg.cooldown(rest, marks, 900, fine)) == pick(sg.cooldown(rest, marks, 900))


@pytest.mark.parametrize("name", ["changes_only", "cooldown", "rebuild_guard"])
def test_stream_equals_batch(spark, sf, name, monkeypatch):
    monkeypatch.setattr(stream_plans, "FILES_PER_TRIGGER", 1)
    rows = lambda q: sorted(map(str, catalog.QUERIES[q](spark, sf).collect()))
    assert rows(name) == rows(f"{name}_stream")


def test_every_query_has_a_twin_with_the_same_columns(spark, sf):
    import duckdb
    from pathlib import Path

    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name, sql in catalog.ORACLES.items():
        con.execute(sql)


def test_enclosing_symbol_by_more_tasks_than_partitions(spark):
    s = spark.range(300).selectExpr("concat('f', id % 7) as file_path", "id * 100 as line", "0 as col", "id * 100 + 50 as end_line", "0 as end_col", "concat('s', id) as name", "id as ord")
    p = spark.range(300).selectExpr("id as pos_id", "concat('f', id % 7) as file_path", "id * 100 + if(id % 3 = 0, 60, 20) as line", "0 as col")
    out = rl.enclosing_symbol(p, s, number_chunk(F.col("line"), 1000), task_rows=20)
    assert {r.pos_id: r.symbol for r in out.collect()} == {i: None if i % 3 == 0 else f"s{i}" for i in range(300)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    # 600 rows of which a task takes 20, in a session of 4 shuffle partitions.
    assert "REPARTITION_BY_NUM" in plan and ", 30), REPARTITION_BY_NUM" in plan


def test_texts_of_few_rows_are_lexed_by_many_tasks(spark, sf, tmp_path):
    from waymark.operators.indexing import index_items
    from waymark.plans import build_plans
    from waymark.plans import sources as src

    texts = build_plans.keyed_sources(spark, sf, src.SOURCES)
    assert texts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    files = spark.range(1, numPartitions=1).selectExpr("id as seq", "'/a.py' as file_path", "'a.py' as relative_path", "cast(5 as bigint) as size", "'def go():' as text")
    assert [r["name"] for r in index_items(files).collect() if r["type"] == "function"] == ["go"]
