"""Keyed state of streams: equal to the batch rows, bounded, with late rows as stated."""

import json
import random
import re

import pytest

from waymark.streaming import keyed as kd
from waymark.streaming import signals as sg
from waymark.streaming import state as st

DAY = 86_400


def files(spark, path, batches, ddl):
    """One file per micro-batch, read in this order."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, ddl).selectExpr("*", "cast(timestamp_seconds(s) as timestamp_ntz) as ts").drop("s")
        df.coalesce(1).write.mode("append").parquet(str(path))
        schema = df.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(stream, path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(path.name).option("checkpointLocation", str(path / "progress")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return [tuple(r) for r in stream.sparkSession.table(path.name).collect()], [json.loads(p.json) for p in q.recentProgress]


@pytest.fixture(autouse=True)
def one_task(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_state_is_bounded_over_many_batches(spark, tmp_path):
    # Each session is seen on one day only; state goes a day after.
    batches = [[(f"s{b}-{i}", (2 * b + 1) * DAY + i, b * 10 + i, f"q{b}") for i in range(5)] for b in range(20)]
    stream = files(spark, tmp_path / "in", batches, "session string, s long, event_id long, query string")
    rows, progress = run(kd.latest_query_stream(stream, retention_days=1), tmp_path, "update")
    assert len(rows) == 100
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # State, timer and the timer's own entries of the sessions of two days, not of forty.
    assert len(held) >= 20 and max(held) <= 5 * 2 * 6 and held[-1] <= max(held[:6])


def test_late_rows_and_repeated_values(spark, tmp_path):
    batches = [
        [("a", 100, 1, "x"), ("a", 200, 2, "y"), ("b", 100, 3, None)],
        [("a", 150, 4, "z"), ("a", 300, 5, "y"), ("b", 200, 6, "v")],  # event 4 is late
        [("a", 400, 7, "x"), ("b", 300, 8, "w"), ("b", 300, 9, "w")],
    ]
    stream = files(spark, tmp_path / "in", batches, "key string, s long, event_id long, value string")
    rows, _ = run(kd.changes_only_stream(stream), tmp_path)
    assert sorted((r[0], r[2], r[3], r[4]) for r in rows) == [("a", 2, "y", "x"), ("a", 7, "x", "y"), ("b", 8, "w", "v")]


def test_guard_by_doubled_steps(spark):
    rng = random.Random(5)
    rows = [("dense", i, i) for i in range(3000)] + [("odd", s, 10_000 + i) for i, s in enumerate(sorted(rng.choices(range(9000), k=700)))] + [("one", 5, 20_000)]
    df = spark.createDataFrame(rows, "key string, s long, event_id long").selectExpr("key", "cast(timestamp_seconds(s) as timestamp_ntz) as ts", "event_id")
    want, free = set(), {}
    for key, s, event in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in free or s > free[key]:
            want.add(event)
            free[key] = s + 60
    assert {r["event_id"] for r in sg.rebuild_guard(df, 60).collect()} == want
    first = df.filter("event_id < 100")
    state = sg.rebuild_guard(first, 60).groupBy("key").agg({"ts": "max", "event_id": "max"}).selectExpr("key", "`max(ts)` as ts", "`max(event_id)` as event_id")
    later = sg.rebuild_guard(df.filter("event_id >= 100"), 60, state)
    assert {r["event_id"] for r in later.collect()} | {e for e in want if e < 100} == want
    assert sg.rebuild_guard(df.limit(0), 60).count() == 0


def test_a_dense_key_uses_all_tasks(spark):
    df = spark.range(0, 20_000).selectExpr("'k' as key", "cast(timestamp_seconds(id) as timestamp_ntz) as ts", "id as event_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = sg.rebuild_guard(df, 60)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Python" not in plan and "MapInPandas" not in plan
    # Rows of the one key are dealt by key and number.
    assert re.search(r"hashpartitioning\(key#\d+L?, at#", plan)


def test_merged_versions_hold_the_latest_rows(spark, tmp_path):
    for v, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("c", 3)]]):
        spark.createDataFrame(rows, "k string, n int").write.parquet(str(tmp_path / f"out/version={v}"))
    st.merge_versions(spark, str(tmp_path / "out"), str(tmp_path / "merged"), ["k"])
    assert sorted((r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "merged")).collect()) == [("a", 2), ("b", 1), ("c", 3)]


def test_buckets_merge_late_rows_and_forget_after_the_retention(spark, tmp_path):
    batches = [
        [("a", 100, 1, "x"), ("a", 200, 2, "y"), (None, 100, 3, None), ("b", 50, 4, "p")],
        [("a", 150, 5, "z"), ("b", 50, 6, "q"), (None, 300, 7, "n"), ("c", 300, 8, "c")],  # event 5 is late, but within the delay
        [("c", 2 * DAY, 9, "d")],
        [("c", 2 * DAY + 1, 10, "e")],
        [("a", 2 * DAY + 5, 11, "w")],  # comes back after its state went
    ]
    ddl = "session string, s long, event_id long, query string"
    rows, _ = run(kd.latest_query_stream(files(spark, tmp_path / "in", batches, ddl), retention_days=1), tmp_path, "update")
    first = [("a", 2, "y"), (None, 3, None), ("b", 4, "p")]
    then = [("a", 2, "y"), ("b", 6, "q"), (None, 7, "n"), ("c", 8, "c"), ("c", 9, "d"), ("c", 10, "e"), ("a", 11, "w")]
    assert sorted((str(r[0]), r[2], r[3]) for r in rows) == sorted(((str(s), e, q) for s, e, q in first + then), key=lambda r: (r[0], r[1]))


def test_counts_of_buckets_start_again_after_the_retention(spark, tmp_path):
    batches = [[("a", 1, 1), ("a", 2, 2), ("b", 3, 3), (None, 4, 9)], [("a", DAY, 4), (None, DAY, 10)], [("b", 4 * DAY, 5)], [("b", 4 * DAY + 1, 6)], [("a", 4 * DAY + 9, 7), ("b", 4 * DAY + 9, 8)]]
    stream = files(spark, tmp_path / "in", batches, "item_id string, s long, event_id long")
    rows, progress = run(kd.access_counts_stream(stream, retention_days=2), tmp_path / "counts", "update")
    assert [(r[0], r[2]) for r in rows if r[0] == "a"] == [("a", 2), ("a", 3), ("a", 1)]
    assert [r[2] for r in rows if r[0] is None] == [1, 2]
    assert [(r[0], r[2]) for r in rows if r[0] == "b"] == [("b", 1), ("b", 2), ("b", 3), ("b", 4)]


def test_slices_of_several_files_lose_no_rows(spark, tmp_path, monkeypatch):
    from waymark.plans import catalog, stream_plans

    # Every file of the table spans the whole month.
    events = spark.range(0, 3000, 1, 6).selectExpr(
        "id as event_id", "cast(timestamp_seconds(1704067200 + (id % 500) * 5180 + id) as timestamp_ntz) as ts",
        "id % 97 as user_id", "'view' as event_type", "1.0D as value", "'{}' as props",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(stream_plans, "FILE_ROWS", 300, raising=False)
    newest = {}
    for r in events.collect():
        newest[r.user_id] = max(newest.get(r.user_id, ()), (r.ts, r.event_id))
    got = {r.session: r.event_id for r in catalog.QUERIES["latest_query"](spark, str(tmp_path)).collect()}
    assert got == {k: v[1] for k, v in newest.items()}
    counts = {r.item_id: r.access_count for r in catalog.QUERIES["stream_activity"](spark, str(tmp_path)).collect()}
    assert counts == {f"part:{k}": 3000 // 97 + (k < 3000 % 97) for k in range(97)}
