"""Ranked and fast search on small item sets, and their properties."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import fast, ranking
from waymark.operators import pairing
from waymark.operators.grep import first_hits, grep, grep_submatches
from waymark.operators.index import item_features
from waymark.operators.queries import live, query_context
from waymark.plans.tables import QUERIES_DDL
from waymark.schema import conform_items


def catalog(spark, rows):
    """rows: (name, type[, path[, full_name]])"""
    full = []
    for i, r in enumerate(rows):
        name, kind, path, fn = (list(r) + [None] * 4)[:4]
        path = path or f"src/{name}.ts"
        full.append((i, f"{kind}:{i}", name, kind, "/" + path, path, fn))
    df = spark.createDataFrame(full, "seq bigint, id string, name string, type string, file_path string, relative_path string, full_name string")
    return item_features(conform_items(df)).cache()


def ask(spark, *queries):
    rows = [(i, q if isinstance(q, str) else q[0], "everything" if isinstance(q, str) else q[1], 10 if isinstance(q, str) else q[2])
            for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, QUERIES_DDL)


def names(df, qid=0):
    return [r.name for r in df.filter(F.col("qid") == qid).orderBy("rank").collect()]


def test_boost_order(spark):
    items = catalog(spark, [("user", "file"), ("user", "class"), ("user", "variable"), ("user", "function")])
    got = ranking.search(ask(spark, "user"), items).orderBy("rank").select("type").collect()
    assert [r.type for r in got] == ["class", "function", "variable", "file"]


def test_prefixed_class_beats_equal_file(spark):
    items = catalog(spark, [("user", "file", "x/user"), ("userService", "class")])
    assert names(ranking.search(ask(spark, "user"), items))[0] == "userService"


def test_line_suffix_and_blank(spark):
    items = catalog(spark, [("alpha", "class")])
    got = ranking.search(ask(spark, "alpha:200", "alpha:0", "  "), items).orderBy("qid").select("qid", "line").collect()
    assert [(r.qid, r.line) for r in got] == [(0, 199), (1, None)]


def test_full_name_and_path_match(spark):
    items = catalog(spark, [("run", "method", "core/engine.ts", "Engine.run"), ("other", "method", "deep/zebra.ts")])
    got = ranking.search(ask(spark, "Engine.run", "zebra"), items)
    assert names(got, 0) == ["run"] and names(got, 1) == ["other"]


def test_routes_in_search(spark):
    items = catalog(spark, [("[GET] api/users/{id}", "endpoint"), ("[POST] api/users/{id}", "endpoint"), ("api", "class")])
    got = ranking.search(ask(spark, ("GET /api/users/5", "endpoints", 10), ("api/users/5", "endpoints", 10)), items)
    first = got.filter("qid = 0").collect()
    assert [r.name for r in first] == ["[GET] api/users/{id}"] and first[0].score == pytest.approx(2.7)
    assert got.filter("qid = 1").count() == 2


def test_activity_only_reorders(spark):
    items = catalog(spark, [("alpha", "class"), ("alphaa", "class"), ("alphab", "class")])
    activity = spark.createDataFrame([("class:1", 1.0), ("class:2", 1.0)], "item_id string, score double")
    q = ask(spark, ("alpha", "everything", 2))
    plain, mixed = names(ranking.search(q, items)), names(ranking.search(q, items, activity))
    assert plain == ["alpha", "alphaa"] and set(mixed) == set(plain)


def test_fast_search_takes_first_not_best(spark):
    rows = [(f"xab{i}", "class") for i in range(3)] + [("ab", "class")]
    items = catalog(spark, rows)
    got = fast.fast_search(ask(spark, ("ab", "everything", 3)), items)
    assert "ab" not in names(got) and len(names(got)) == 3


def test_fast_scope_order(spark):
    items = catalog(spark, [("ab.ts", "file"), ("ab", "property"), ("ab", "method"), ("ab", "class")])
    got = fast.fast_search(ask(spark, ("ab", "everything", 2)), items)
    assert {r.type for r in got.collect()} == {"class", "method"}


def brute(q, t):
    at = -1
    for ch in q.replace(" ", ""):
        at = t.find(ch, at + 1)
        if at < 0:
            return False
    return True


def test_mask_never_loses_a_match_and_both_pairings_agree(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcde1_é") for _ in range(rnd.randint(1, 8))) for _ in range(120)]
    items = catalog(spark, [(t, "class", "p") for t in texts])
    asked = ask(spark, *["".join(rnd.choice("abcde1_é") for _ in range(rnd.randint(1, 3))) for _ in range(15)])
    context = live(query_context(asked))
    small = ranking.field_cascade(ranking.mask_prefilter(items, context, F.lit(True), small=True))
    large = ranking.field_cascade(ranking.mask_prefilter(items, context, F.lit(True), small=False))
    a = {(r.qid, r.seq, round(r.score, 9)) for r in small.collect()}
    assert a == {(r.qid, r.seq, round(r.score, 9)) for r in large.collect()}
    found = {(q, s) for q, s, _ in a}
    fold = str.maketrans("é", "e")
    qs = {r.qid: r.q_low for r in context.collect()}
    for qid, q in qs.items():
        for seq, t in enumerate(texts):
            if brute(q, t.translate(fold)) and q == t.translate(fold):
                assert (qid, seq) in found
    for qid, seq in found:
        low = texts[seq].translate(fold)
        assert brute(qs[qid], low) or brute(qs[qid], "p")


def test_substring_pairings_agree(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(80)]
    items = catalog(spark, [(t, "class", "p") for t in texts])
    context = live(query_context(ask(spark, "a", "ab", "abc", "cabc", "bb")))
    got = [
        {(r.qid, r.seq) for r in fast.tier_pairs(context, items, small=s).collect()} for s in (True, False)
    ]
    want = {(i, s) for i, q in enumerate(["a", "ab", "abc", "cabc", "bb"]) for s, t in enumerate(texts) if q in t}
    assert got[0] == got[1] == want


def test_top_k_is_a_sort_cut(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 3), i, rnd.choice([0.2, 0.5, 0.9, 0.005]), 4) for i in range(200)]
    df = spark.createDataFrame(rows, "qid int, seq bigint, score double, k int")
    got = sorted((r.qid, r.rank, r.seq) for r in ranking.top_k(df, ["qid"]).collect())
    want = []
    for q in range(4):
        best = sorted((-s, i) for qq, i, s, _ in rows if qq == q and s > 0.01)[:4]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(best)]
    assert got == sorted(want)


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"/d/{i}", None, t) for i, t in enumerate(texts)], "seq bigint, file_path string, size bigint, text string")


def test_grep_offsets(spark):
    d = docs(spark, "    const FOO = 1;\nnothing\n\n  foo foo", "x" * 10001 + "foo", "last foo")
    q = spark.createDataFrame([(1, "foo", 10)], "qid int, query string, max_results int")
    got = [(r.file_path, r.line, r.column, r.name, r.hl_start, r.hl_end) for r in grep(d, q, max_line=10000).orderBy("seq", "line").collect()]
    assert got == [("/d/0", 0, 10, "const FOO = 1;", 6, 9), ("/d/0", 3, 2, "foo foo", 0, 3), ("/d/2", 0, 5, "last foo", 5, 8)]
    subs = [[(s.start, s.end) for s in r.submatches] for r in grep_submatches(d, q, max_line=10000).orderBy("seq", "line").collect()]
    assert subs == [[(6, 9)], [(0, 3), (4, 7)], [(5, 8)]]
    large = {(r.file_path, r.line) for r in grep(d, q, small=False, max_line=10000).collect()}
    assert large == {(g[0], g[1]) for g in got}
    opened = spark.createDataFrame([("/d/2",)], "file_path string")
    order = [(r.file_path, r.line) for r in first_hits(grep(d, q, max_line=10000), opened).orderBy("pos").collect()]
    assert order == [("/d/2", 0), ("/d/0", 0), ("/d/0", 3)]


def test_slices_hold_each_query_once(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BROADCAST_QUERIES", 100)
    asked = spark.range(1000).selectExpr("cast(id as int) as qid")
    parts = pairing.slices(asked)
    assert len(parts) == 10 and sorted(r.qid for p in parts for r in p.collect()) == list(range(1000))
    assert len(pairing.slices(asked.limit(50))) == 1
