"""Queries on usage history and run summaries."""

from pyspark.sql import functions as F

from waymark.functions.text import relative_time
from waymark.operators import activity as act
from waymark.operators import stats as st
from waymark.plans import tables as tb
from waymark.plans.registry import query
from waymark.plans.search_plans import ACTIVITY_SQL
from waymark.session import fresh_dir, micros_between

R6 = lambda c: F.round(F.col(c), 6)
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"
US_SQL = "epoch_us({})"
SPLIT = "2024-01-20"


def scored(spark, sf):
    return act.activity_score(act.access_counts(tb.accesses(spark, sf)), tb.as_of(spark, sf))


@query(
    "access_counts",
    """SELECT 'part:'||user_id AS item_id, epoch_us(max(ts)) AS last_us, count(*) AS access_count,
    arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id""",
)
def access_counts_query(spark, sf):
    out = act.latest_items(tb.accesses(spark, sf), F.col("event_type"))
    return out.selectExpr("item_id", f"{MICROS.format('last_accessed')} as last_us", "access_count", "item as last_type")


@query("activity_score", f"WITH {ACTIVITY_SQL} SELECT item_id, access_count, round(score, 6) AS score FROM activity")
def activity_score_query(spark, sf):
    return scored(spark, sf).select("item_id", "access_count", R6("score").alias("score"))


@query(
    "running_max_count",
    """WITH c AS (SELECT event_id, ts, 'part:'||user_id AS item_id,
      count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS access_count FROM events)
    SELECT event_id, item_id, access_count, max(access_count) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
      AS max_access_count FROM c""",
)
def running_max_query(spark, sf):
    return act.running_max_count(tb.accesses(spark, sf)).select("event_id", "item_id", "access_count", "max_access_count")


@query(
    "activity_lookup",
    f"WITH {tb.ITEMS_SQL}, {ACTIVITY_SQL} SELECT id, round(coalesce(a.score, 0.0), 6) AS activity_score FROM items LEFT JOIN activity a ON id = item_id",
)
def lookup_query(spark, sf):
    from waymark.operators.ranking import activity_lookup

    out = activity_lookup(tb.items(spark, sf).select("id"), scored(spark, sf))
    return out.select("id", R6("activity_score").alias("activity_score"))


@query(
    "retain",
    f"WITH {ACTIVITY_SQL} SELECT item_id FROM activity WHERE date_diff('microsecond', last_accessed, TIMESTAMP '2024-02-29 20:00:00') <= 30 * 86400000000",
)
def retain_query(spark, sf):
    later = F.lit("2024-02-29 20:00:00").cast("timestamp_ntz")
    return act.retain(act.access_counts(tb.accesses(spark, sf)), later).select("item_id")


LOAD_SQL = f"""saved AS (SELECT 'part:'||user_id AS item_id, max(ts) AS last_accessed, count(*) AS access_count FROM events
    WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY 1),
cur AS (SELECT 'part:'||user_id AS item_id, max(ts) AS last_accessed, count(*) AS access_count FROM events
    WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY 1),
merged AS (SELECT coalesce(c.item_id, s.item_id) AS item_id, coalesce(c.last_accessed, s.last_accessed) AS last_accessed,
    coalesce(c.access_count, 0) + coalesce(s.access_count, 0) AS access_count FROM saved s FULL JOIN cur c USING (item_id)),
loaded AS (SELECT item_id, access_count, 0.6::DOUBLE / (1 + date_diff('microsecond', last_accessed, (SELECT max(ts) FROM events)) / 86400000000.0::DOUBLE)
    + 0.4::DOUBLE * access_count / (SELECT max(access_count) FROM merged) AS score FROM merged)"""


def saved_and_current(spark, sf):
    acc = tb.accesses(spark, sf)
    at = F.lit(SPLIT).cast("timestamp_ntz")
    return act.access_counts(acc.filter(F.col("ts") < at)), act.access_counts(acc.filter(F.col("ts") >= at))


@query("load_activity", f"WITH {LOAD_SQL} SELECT item_id, access_count, round(score, 6) AS score FROM loaded")
def load_query(spark, sf):
    saved, current = saved_and_current(spark, sf)
    out = act.load_activity(saved, current, tb.as_of(spark, sf))
    return out.select("item_id", "access_count", R6("score").alias("score"))


@query("save_activity", f"WITH {ACTIVITY_SQL} SELECT item_id, access_count, round(score, 6) AS score FROM activity")
def save_query(spark, sf):
    path = fresh_dir(spark, "activity")
    act.save_activity(act.access_counts(tb.accesses(spark, sf)), tb.as_of(spark, sf), path)
    return spark.read.parquet(path).select("item_id", "access_count", R6("score").alias("score"))


@query(
    "top_ids",
    f"WITH {ACTIVITY_SQL} SELECT item_id, round(score, 6) AS score FROM activity ORDER BY score DESC, item_id LIMIT 20",
)
def top_ids_query(spark, sf):
    return act.top_ids(scored(spark, sf), 20).select("item_id", R6("score").alias("score"))


AGE_SQL = """CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago'
  WHEN s // 86400 = 1 THEN 'yesterday' ELSE (s // 86400) || 'd ago' END"""


@query(
    "recent_items",
    f"""WITH {tb.ITEMS_SQL}, {ACTIVITY_SQL}, r AS (SELECT id, name, detail, last_accessed,
      date_diff('microsecond', last_accessed, (SELECT max(ts) FROM events)) // 1000000 AS s
      FROM activity JOIN items ON id = item_id ORDER BY last_accessed DESC, item_id LIMIT 20)
    SELECT id, name, CASE WHEN detail <> '' THEN detail || ' • ' ELSE '' END || 'Accessed ' || {AGE_SQL} AS detail, 2.0::DOUBLE AS score FROM r""",
)
def recent_items_query(spark, sf):
    out = act.recent_items(scored(spark, sf), tb.items(spark, sf), tb.as_of(spark, sf), 20)
    return out.select("id", "name", "detail", "score")


@query(
    "blank_query",
    f"""WITH {tb.ITEMS_SQL}, {ACTIVITY_SQL}, {tb.QUERIES_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY last_accessed DESC, item_id) AS n
      FROM activity JOIN items ON id = item_id)
    SELECT qid, id, 2.0::DOUBLE AS score, n::INTEGER AS rank FROM queries, r WHERE trim(query) = '' AND n <= max_results""",
)
def blank_query_query(spark, sf):
    from waymark.operators.queries import blank
    from waymark.operators.recent import blank_results

    return blank_results(blank(tb.queries(spark)), scored(spark, sf), tb.items(spark, sf), tb.as_of(spark, sf)).select(
        "qid", "id", "score", "rank"
    )


@query(
    "relative_time",
    f"WITH t AS (SELECT event_id, date_diff('microsecond', ts, (SELECT max(ts) FROM events)) // 1000000 AS s FROM events) SELECT event_id, {AGE_SQL} AS age FROM t",
)
def relative_time_query(spark, sf):
    e = tb.load(spark, sf, "events")
    return e.select("event_id", relative_time(micros_between(F.col("ts"), tb.as_of(spark, sf))).alias("age"))


@query(
    "activity_stats",
    f"WITH {ACTIVITY_SQL} SELECT count(*) AS total_records, round(coalesce(avg(score), 0), 6) AS average_score FROM activity",
)
def activity_stats_query(spark, sf):
    return act.activity_stats(scored(spark, sf)).select("total_records", R6("average_score").alias("average_score"))


@query(
    "forget",
    f"WITH {ACTIVITY_SQL} SELECT item_id FROM activity WHERE item_id NOT IN (SELECT 'part:'||user_id FROM events WHERE event_type = 'error' AND value > 95)",
)
def forget_query(spark, sf):
    # Items whose use ended in a costly error are forgotten.
    gone = tb.load(spark, sf, "events").filter("event_type = 'error' and value > 95").selectExpr("concat('part:', user_id) as item_id")
    return act.forget(scored(spark, sf), gone).select("item_id")


def opened(spark, sf):
    return tb.load(spark, sf, "events").selectExpr(
        "concat('/u/', user_id) as file_path", "ts", "event_id", "if(event_type = 'purchase', 'Command', event_type) as kind"
    )


MRU_SQL = """m AS (SELECT '/u/'||user_id AS file_path, ts, event_id, event_type AS kind, row_number() OVER
    (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'purchase'),
history AS (SELECT * FROM m WHERE r = 1 ORDER BY ts DESC, event_id DESC LIMIT 20)"""


@query("mru", f"WITH {MRU_SQL} SELECT file_path, event_id, kind FROM history")
def mru_query(spark, sf):
    return act.mru(opened(spark, sf), "file_path").select("file_path", "event_id", "kind")


@query(
    "recent_or_history",
    f"""WITH {MRU_SQL} SELECT 'history' AS list, file_path, 'history' AS source FROM history
    UNION ALL SELECT 'recent', '/u/'||user_id, 'recent' FROM events GROUP BY user_id""",
)
def recent_or_history_query(spark, sf):
    # Once with recent items, once with a history that was just cleared.
    recent = act.access_counts(opened(spark, sf).withColumnRenamed("file_path", "item_id")).selectExpr("item_id as file_path")
    history = act.mru(opened(spark, sf), "file_path").select("file_path")
    with_recent = act.recent_or_history(recent, history).withColumn("list", F.lit("recent"))
    cleared = act.recent_or_history(act.clear(recent), history).withColumn("list", F.lit("history"))
    return with_recent.unionByName(cleared).select("list", "file_path", "source")


# --------------------------------------------------------------- run summaries

def samples(spark, sf):
    return tb.load(spark, sf, "events").selectExpr("event_type as name", "value")


SUMMARY_SQL = """s AS (SELECT event_type AS name, count(value) AS samples, avg(value) AS avg_ms, sum(value) AS total_ms, min(value) AS min_ms,
    max(value) AS max_ms, stddev_pop(value) AS std_dev_ms,
    percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95_ms FROM events GROUP BY 1)"""


@query(
    "latency_summary",
    f"""WITH {SUMMARY_SQL} SELECT name, samples, round(avg_ms, 6) AS avg_ms, round(total_ms, 4) AS total_ms, min_ms, max_ms,
    p95_ms, round(std_dev_ms, 6) AS std_dev_ms FROM s""",
)
def summary_query(spark, sf):
    return st.latency_summary(samples(spark, sf)).select(
        "name", "samples", R6("avg_ms").alias("avg_ms"), F.round("total_ms", 4).alias("total_ms"), "min_ms", "max_ms",
        "p95_ms", R6("std_dev_ms").alias("std_dev_ms"),
    )


def _fmt(c):
    return f"CASE WHEN {c} < 1 THEN printf('%.2f', {c} * 1000) || 'μs' WHEN {c} < 1000 THEN printf('%.2f', {c}) || 'ms' ELSE printf('%.2f', {c} / 1000) || 's' END"


@query(
    "latency_report",
    f"""WITH {SUMMARY_SQL} SELECT 'events' AS suite, name, '| ' || name || ' |' || {" || ".join(f"' ' || {_fmt(c)} || ' |'" for c in st.REPORT_COLUMNS)} AS text FROM s
    UNION ALL SELECT 'orders', o_orderstatus, '| ' || o_orderstatus || ' |' || {" || ".join(f"' ' || {_fmt(c)} || ' |'" for c in ["avg(o_totalprice / 1000)", "sum(o_totalprice / 1000)", "min(o_totalprice / 1000)", "max(o_totalprice / 1000)", "percentile_disc(0.95) WITHIN GROUP (ORDER BY o_totalprice / 1000)", "stddev_pop(o_totalprice / 1000)"])}
    FROM orders GROUP BY o_orderstatus""",
)
def report_query(spark, sf):
    orders = tb.load(spark, sf, "orders").selectExpr("o_orderstatus as name", "o_totalprice / 1000 as value")
    return st.latency_report({
        "events": st.latency_summary(samples(spark, sf)),
        "orders": st.latency_summary(orders),
    })


_MB = lambda c: f"coalesce(printf('%.2f', {c}), '')"


@query(
    "memory_report",
    f"""WITH m AS (SELECT o_orderpriority AS name, count(*) / 4 AS rss, max(o_custkey) / 4 AS heap_total,
      CASE WHEN o_orderpriority > '3' THEN min(o_orderkey) / 4 END AS heap_used, max(o_orderkey) / 4 AS external FROM orders GROUP BY 1)
    SELECT name, '| ' || name || ' | ' || {" || ' | ' || ".join(_MB(c) for c in ["rss", "heap_total", "heap_used", "external"])} || ' |' AS text FROM m""",
)
def memory_report_query(spark, sf):
    o = tb.load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        (F.count("*") / 4).alias("rss"), (F.max("o_custkey") / 4).alias("heap_total"),
        F.when(F.col("o_orderpriority") > "3", F.min("o_orderkey") / 4).alias("heap_used"), (F.max("o_orderkey") / 4).alias("external"),
    )
    return st.memory_report(o)
