"""Posting lists give the rows of a scan."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.functions import windows as win
from waymark.operators import fast as fs
from waymark.operators import grep as gr
from waymark.operators import postings as po
from waymark.operators.queries import live, query_context
from waymark.plans import tables as tb
from waymark.schema import ITEM_DDL
from waymark.operators.index import item_features
from waymark.sources.bucketed import open_bucketed, write_bucketed

DOCS = "seq bigint, file_path string, size bigint, text string"
QUERIES = "qid bigint, query string, max_results int"


def found(hits):
    return sorted((r["qid"], r["seq"], r["line"], r["raw"], r["name"], r["indent"]) for r in hits.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    alphabet = ["a", "b", "c", "A", " ", "é", "É", "日", "😀", ".", "\t"]
    rows = []
    for i in range(60):
        lines = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 50))]
        rows.append((i, f"/f{i}", len(lines), "\n".join(lines)))
    rows += [(100, "/null", 0, None), (101, "/empty", 0, ""), (102, "/short", 2, "a\nb\n\nab\nabc"), (103, "/blank", 1, "   "), (104, "/long", 9, "abc" * 3000 + "é😀日")]
    return spark.createDataFrame(rows, DOCS)


def some_queries(spark):
    rng = random.Random(12)
    alphabet = ["a", "b", "c", " ", "é", "日", "😀", "."]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(1 + i % 6)), 5) for i in range(120)]
    rows += [(900, "ABC", None), (901, "É", 3), (902, "", 3), (903, "  ", 3), (904, "abc" * 3000, 3), (905, "a\nb", 3), (906, "nowhere", 3), (907, "abc", None), (908, None, 1)]
    return spark.createDataFrame(rows, QUERIES)


@pytest.mark.parametrize("lines", [1, 16])
def test_lines_by_postings_equal_a_scan(spark, texts, lines):
    index, asked = po.text_index(texts, lines), some_queries(spark)
    scan = found(gr.matching_lines(texts, asked))
    assert found(gr.matching_lines(index, asked)) == scan and len(scan) > 1000
    assert found(gr.matching_lines(index, asked, max_line=20, max_bytes=30)) == found(gr.matching_lines(texts, asked, max_line=20, max_bytes=30))


def test_every_part_of_a_text_lies_in_a_gram(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("ab😀é") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", po.grams_of(F.array("w", F.lit(None))).alias("g")).collect()
    for r in rows:
        w, grams = r["w"], r["g"]
        assert all(any(w[i : i + n] in g for g in grams) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        assert len(set(grams)) == len(grams) and "" not in grams


def test_hot_grams_are_left_out(spark):
    counts = spark.createDataFrame([("abc", 3), ("bcd", 90), ("cde", 5000), ("xyz", 7)], "gram string, n bigint")
    asked = spark.createDataFrame([("abcde",), ("cde",), ("abcx",), ("ab",)], "q_low string")
    got = sorted(tuple(r) for r in po.rarest_grams(asked, counts).collect())
    assert got == [("abcde", 2, "abc"), ("abcde", 2, "bcd"), ("cde", 1, "cde")]


def test_a_common_gram_is_spread_over_lists(spark):
    rows = spark.range(20_000).selectExpr("id as seq", "concat('common', id) as t")
    index = po.gram_index(rows, "seq", F.array("t"))
    sizes = [r["n"] for r in index.lists.filter("gram = 'mmo'").selectExpr("size(ids) as n").collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 1 << po.RANGE_BITS
    assert po.candidates(spark.createDataFrame([("mmon1999",)], "q_low string"), index).count() < 500


def test_texts_are_not_shuffled(spark, texts):
    index = po.text_index(texts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = po.found_lines(index, some_queries(spark).selectExpr("lower(query) as q_low"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(i for i, x in enumerate(plan.split("\n")) if "segment" in x and "Join" in x)
    depth = {}
    # The scan of the segments hangs below the join without an exchange between them.
    for line in plan.split("\n")[join:]:
        depth[len(line) - len(line.lstrip(" :+-"))] = line
        if "FileScan" in line and "lines" in line:
            level = len(line) - len(line.lstrip(" :+-"))
            above = [x for d, x in depth.items() if d <= level]
            assert not any("Exchange" in x for x in above), plan
            return
    raise AssertionError(plan)


def test_fast_search_by_postings_equals_a_scan(spark, sf):
    index, grams = tb.index(spark, sf), fs.name_grams(tb.index(spark, sf))
    part = tb.load(spark, sf, "part")
    asked = part.selectExpr("substr(p_name, 2, 5) as query", "'everything' as scope").distinct().limit(40)
    asked = asked.selectExpr("crc32(query) as qid", "query", "scope", "7 as max_results").unionByName(tb.queries(spark).selectExpr("cast(qid as bigint) qid", "query", "scope", "max_results"))
    opened = tb.open_files(spark, sf)
    cols = ["qid", "rank", "id", "score", "line", "highlights"]
    scan = fs.fast_search(asked, index, open_files=opened).select(*cols)
    by_lists = fs.fast_search(asked, index, open_files=opened, grams=grams).select(*cols)
    assert sorted(map(str, by_lists.collect())) == sorted(map(str, scan.collect())) and scan.count() > 50


def test_many_queries_read_the_rows_once(spark, sf):
    index, grams = tb.index(spark, sf), fs.name_grams(tb.index(spark, sf))
    asked = spark.range(20_000).selectExpr("id as q_id", "concat('steel ', id % 977) as q_low")
    plan = po.candidates(asked, grams)
    assert plan.count() >= 0
    context = live(query_context(asked.selectExpr("q_id as qid", "q_low as query", "'everything' as scope", "10 as max_results"), fast=True))
    pairs = fs.tier_pairs(context, grams.rows, found=po.candidates(context, grams).withColumnRenamed("id", "id_"))
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in x and "name_low" in x for x in text.split("\n")) == 1
    assert not any("NestedLoop" in x or "Cartesian" in x for x in text.split("\n"))
    assert index.count() > 0


def test_nothing_indexed(spark):
    none = item_features(spark.createDataFrame([], ITEM_DDL))
    grams = fs.name_grams(none)
    asked = spark.createDataFrame([(1, "abc", "everything", 5)], tb.QUERIES_DDL)
    assert fs.fast_search(asked, none, grams=grams).count() == 0


def test_bucketed_tables_open_again(spark, tmp_path):
    path = str(tmp_path / "b")
    write_bucketed(spark.range(100).selectExpr("id", "id % 7 as k"), path, ["k"], 4)
    again = open_bucketed(spark, path, ["k"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = again.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and sorted(r["id"] for r in again.collect()) == list(range(100))


def test_texts_found_by_windows_equal_those_by_lists(spark, texts):
    index = po.text_index(texts)
    asked = some_queries(spark).selectExpr("lower(query) as q_low")
    lengths = po.dense_lengths(asked.distinct(), index.counts, 0)
    assert set(lengths) >= {3, 4} and min(lengths) >= po.GRAM
    by_lists = po.found_lines(index, asked, dense=1e9)
    by_windows = po.found_lines(index, asked, dense=0)
    key = lambda rows: sorted(map(str, rows.select("q_low", "seq", "line", "raw", "raw_low").collect()))
    assert key(by_lists) == key(by_windows) and by_lists.count() > 500


def test_many_texts_of_one_length_meet_windows_not_candidates(spark):
    rng = random.Random(14)
    docs = [(i, f"/f{i}", 0, "\n".join("".join(rng.choice("ab") for _ in range(40)) for _ in range(3))) for i in range(50)]
    index = po.text_index(spark.createDataFrame(docs, DOCS))
    words = [f"{i:07b}".translate(str.maketrans("01", "ab")) for i in range(128)]
    asked = spark.createDataFrame([(w,) for w in [*words, "abababab"]], "q_low string")
    assert po.dense_lengths(asked, index.counts) == [7]
    want = sum(w in line for w in [*words, "abababab"] for d in docs for line in d[3].split("\n"))
    assert po.found_lines(index, asked).count() == want


def test_an_index_holds_its_texts_once_and_ids_in_two_bytes(spark, texts):
    index = po.text_index(texts)
    assert dict(index.lists.dtypes)["ids"] == "array<smallint>"
    assert {c for c, kind in index.rows.dtypes if "string" in kind} == {"file_path", "lines"}


def test_windows_meet_texts_where_the_lines_lie(spark, texts):
    index = po.text_index(texts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = po.window_hits(index.rows, some_queries(spark).selectExpr("lower(query) as q_low").filter("length(q_low) > 2"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x for x in plan.split("\n") if x.lstrip(" :").startswith(("+-", ":-"))]
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "lines" in x)
    level = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, low = [], level(lines[scan])
    for x in reversed(lines[:scan]):
        if level(x) < low:
            above, low = [*above, x], level(x)
    # Neither windows nor what they found are dealt out between the lines and the result.
    assert any("BroadcastHashJoin" in x for x in above) and not any("Exchange" in x or "SortMergeJoin" in x for x in above), plan


def test_passes_over_the_lines_find_what_one_finds(spark, texts, monkeypatch):
    index, asked = po.text_index(texts), some_queries(spark)
    monkeypatch.setattr(po, "DENSE", 0)
    monkeypatch.setattr(po.found_lines, "__defaults__", (0, None))
    one = found(gr.matching_lines(index, asked))
    monkeypatch.setattr(po, "AT_ONCE", 30)
    assert found(gr.matching_lines(index, asked)) == one == found(gr.matching_lines(texts, asked))


def test_rows_of_one_text_are_answered_each(spark, texts):
    asked = spark.createDataFrame([(1, "abc", 1), (2, "ABC", None), (2, "abc", None), (3, "   ", 9)], QUERIES)
    index = po.text_index(texts)
    got = po.found_lines(index, asked.selectExpr("lower(query) as q_low", "qid"), dense=0, blanks=F.expr(gr.BLANKS))
    want = gr.matching_lines(texts, asked)
    key = lambda rows: sorted(map(str, rows.select("q_low", "qid", "seq", "line", "raw").collect()))
    assert key(got.filter("q_low = 'abc'")) == key(want) and want.count() > 9
    # A line of blanks holds a text of blanks only where no blanks are left out.
    assert got.filter("file_path = '/blank'").count() == 0
    assert po.found_lines(index, asked.selectExpr("lower(query) as q_low"), dense=0).filter("file_path = '/blank'").count() == 1


def test_lists_hold_the_grams_of_their_rows(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("ab\n\0é日😀\U0010ffff") for _ in range(rng.randint(0, 9)))
    rows = [(rng.randrange(20_000), [rng.choice([None, word(), word()]) for _ in range(rng.randint(0, 4))]) for _ in range(400)]
    rows += [(7, ["ab"]), (7, ["abab"]), (None, ["ab"]), (8, None), (9, []), (10, [""])]
    df = spark.createDataFrame(rows, "id bigint, t array<string>")
    ids = F.explode(F.transform("ids", lambda x: F.shiftleft("part", 12) + x)).alias("id")
    got = sorted(map(tuple, win.gram_lists(df, "id", F.col("t"), 12).select("gram", ids).distinct().collect()))
    assert got == sorted(map(tuple, df.filter("id is not null").select(F.explode(po.grams_of(F.col("t"))).alias("gram"), "id").distinct().collect()))
    index = po.gram_index(df, "id", F.col("t"))
    assert sorted(map(tuple, index.lists.select("gram", ids).collect())) == got


def test_too_many_characters_for_a_number_are_taken_in_halves():
    chars = "".join(chr(c) for c in range(0x20, 0x110000, 16) if not 0xD800 <= c < 0xE000)
    texts = [chars[i : i + 7] for i in range(0, len(chars), 7)]
    row = np.arange(len(texts))
    want = sum(max(1, len(x) - 2) for x in texts)
    got = sum(len(x) for b in win._gram_lists(pa.array(texts), row, row, 12) for x in b.column("ids").to_pylist())
    assert 3 * len(chars).bit_length() + len(texts).bit_length() > 64 and got == want


def test_windows_of_any_length_are_told_apart():
    rng = random.Random(16)
    morse = "a"
    for _ in range(11):
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    words = sorted({"".join(rng.choice("abcé😀") for _ in range(n)) for n in range(1, 40) for _ in range(60)} | {morse, other})
    lines = ["".join(rng.choice("abcé😀x") for _ in range(rng.randint(0, 300))) for _ in range(40)] + [morse + other, "x" + morse, other, *words[::50]]
    text = pa.array(["".join(x + "\n" for x in lines[:17]), "".join(x + "\n" for x in lines[17:])])
    row, at, which = win._held(text, np.array([17, len(lines) - 17]), win.Texts(pa.array(words)))
    got = sorted(zip((row * 17 + at).tolist(), which.tolist()))
    assert got == [(i, k) for i, x in enumerate(lines) for k, w in enumerate(words) if w in x] and len(got) > 1000


def test_keys_that_share_a_cell_are_found():
    rng = np.random.default_rng(17)
    wanted = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    keys = np.concatenate([rng.permutation(wanted), rng.integers(0, 1 << 63, 5000).astype(np.uint64), np.zeros(3, np.uint64)])
    at, which = (table := win.KeyTable(wanted)).find(keys)
    assert len(table.rest) > 100 and sorted(which.tolist()) == list(range(len(wanted)))
    assert (keys[at] == wanted[which]).all()
