"""Streaming queries. Each reads the event files as a stream, runs to the end of
what is there, and is compared with SQL over the whole table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import normalize_path
from waymark.operators import activity as act
from waymark.plans import tables as tb
from waymark.plans.registry import query
from waymark.plans.search_plans import ACTIVITY_SQL, SEARCH_SQL, activity_table
from waymark.plans.usage_plans import MICROS
from waymark.session import fresh_dir
from waymark.streaming import keyed as kd
from waymark.streaming import signals as sg
from waymark.streaming import state as st
from waymark.streaming import upkeep as up

R6 = lambda c: F.round(F.col(c), 6)
_SLICES: dict = {}
CUTS = ["2024-01-09", "2024-01-16", "2024-01-23"]


FILE_ROWS = 1_000_000
#: Slices that arrive at once; each has as many files as any other.
FILES_PER_TRIGGER = 1


def event_slices(spark, sf) -> tuple[str, object, int]:
    """The events as four sets of files that arrive one after the other, by time, and the number of files of each.

    All files of a slice come in one micro-batch: those of a later one would be late by
    the watermark of the first. A file has about `FILE_ROWS` rows.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SLICES:
        path = fresh_dir(spark, "arrivals")
        events = tb.load(spark, sf, "events")
        edges = ["1970-01-01", *CUTS, "9999-01-01"]
        parts = [events.filter(f"ts >= timestamp_ntz'{low}' and ts < timestamp_ntz'{high}'") for low, high in zip(edges, edges[1:])]
        sizes = [part.count() for part in parts]
        # Dealt row by row, so each file has rows once some task reads as many as there are files.
        tasks = events.rdd.getNumPartitions()
        n = max(1, min(-(-max(sizes) // FILE_ROWS), min(sizes) // tasks))
        for part in parts:
            part.repartition(n).write.mode("append").parquet(path)
        _SLICES[key] = (path, events.schema, n)
    return _SLICES[key]


def event_stream(spark, sf) -> DataFrame:
    """The arrival files as a stream, one slice in each micro-batch: state is handed over between them."""
    path, schema, files = event_slices(spark, sf)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER * files).parquet(path)


def us(c, name):
    return f"{MICROS.format(c)} as {name}"


def run_to_table(frame: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame into a parquet table and read it back."""
    spark = frame.sparkSession
    path, checkpoint = fresh_dir(spark, label), fresh_dir(spark, f"{label}-progress")
    writer = frame.writeStream.outputMode(mode).format("parquet").option("path", path)
    st.run_available(writer, checkpoint)
    return spark.read.schema(frame.schema).parquet(path)


def run_steps(stream: DataFrame, label: str, each, mode: str = "append") -> None:
    writer = stream.writeStream.outputMode(mode).foreachBatch(each)
    st.run_available(writer, fresh_dir(stream.sparkSession, f"{label}-progress"))


# --------------------------------------------------------- event-time windows

GAP, DELAY = "6 hours", "10 minutes"


@query(
    "debounce",
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g),
    b AS (SELECT user_id AS key, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, arg_max(event_type, (ts, event_id)) AS value, count(*) AS n FROM s GROUP BY user_id, burst)
    SELECT * FROM b""",
)
def debounce_query(spark, sf):
    form = ["user_id as key", "ts", "event_id", "event_type as value"]
    out = run_to_table(sg.debounce(event_stream(spark, sf).selectExpr(*form), "key", GAP, DELAY), "debounce")
    out = out.unionByName(sg.debounce_rest(tb.load(spark, sf, "events").selectExpr(*form), out, "key", GAP))
    return out.selectExpr("key", us("start", "start_us"), us("end", "end_us"), "value", "n")


@query(
    "batch_window",
    f"""WITH b AS (SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type AS folder, user_id AS item, count(*) AS n FROM events GROUP BY 1, 2, 3)
    SELECT * FROM b""",
)
def batch_window_query(spark, sf):
    form = ["event_type as folder", "user_id as item", "ts"]
    out = run_to_table(sg.batch_window(event_stream(spark, sf).selectExpr(*form), "folder", "item", "1 hour", DELAY), "batches")
    out = out.unionByName(sg.batch_window_rest(tb.load(spark, sf, "events").selectExpr(*form), out, "folder", "item", "1 hour"))
    return out.selectExpr(us("start", "start_us"), "folder", "item", "n")


# ------------------------------------------------------ steps with keyed state

CHANGES_SQL = """WITH l AS (SELECT event_id, user_id AS key, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    SELECT event_id, key, value, previous FROM l WHERE previous <> value"""


@query("changes_only", CHANGES_SQL)
def changes_query(spark, sf):
    e = tb.load(spark, sf, "events").selectExpr("user_id as key", "ts", "event_id", "event_type as value")
    return sg.changes_only(e).select("event_id", "key", "value", "previous")


@query("changes_only_stream", CHANGES_SQL)
def changes_stream_query(spark, sf):
    e = event_stream(spark, sf).selectExpr("user_id as key", "ts", "event_id", "event_type as value")
    return run_to_table(kd.changes_only_stream(e), "changes").select("event_id", "key", "value", "previous")


KINDS = "CASE event_type WHEN 'purchase' THEN 'rebuild' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' ELSE 'change' END"
COOLDOWN_SQL = f"""WITH e AS (SELECT event_id, ts, {KINDS} AS kind FROM events)
    SELECT event_id, kind FROM e WHERE kind <> 'rebuild' AND (kind = 'delete' OR NOT EXISTS (SELECT 1 FROM e r WHERE r.kind = 'rebuild'
      AND e.ts >= r.ts AND e.ts <= r.ts + INTERVAL 300 SECONDS))"""


@query("cooldown", COOLDOWN_SQL)
def cooldown_query(spark, sf):
    e = tb.load(spark, sf, "events").selectExpr("ts", "event_id", f"{KINDS} as kind")
    return sg.cooldown(e.filter("kind <> 'rebuild'"), e.filter("kind = 'rebuild'"), 300).select("event_id", "kind")


@query("cooldown_stream", COOLDOWN_SQL)
def cooldown_stream_query(spark, sf):
    e = event_stream(spark, sf).selectExpr("ts", "event_id", f"{KINDS} as kind")
    return run_to_table(kd.cooldown_stream(e, 300), "cooldown").select("event_id", "kind")


# One accepted request at a time: the next is the first one after the pause.
GUARD_SQL = """WITH RECURSIVE e AS (SELECT event_type AS key, ts, event_id FROM events),
    g AS (SELECT key, min(ts) AS ts FROM e GROUP BY key
      UNION ALL SELECT g.key, (SELECT min(e.ts) FROM e WHERE e.key = g.key AND e.ts > g.ts + INTERVAL 4 HOURS) FROM g WHERE g.ts IS NOT NULL)
    SELECT g.key, epoch_us(g.ts) AS us FROM g WHERE g.ts IS NOT NULL"""


@query("rebuild_guard", GUARD_SQL)
def guard_query(spark, sf):
    e = tb.load(spark, sf, "events").selectExpr("event_type as key", "ts", "event_id")
    return sg.rebuild_guard(e, 4 * 3600).selectExpr("key", us("ts", "us"))


@query("rebuild_guard_stream", GUARD_SQL)
def guard_stream_query(spark, sf):
    e = event_stream(spark, sf).selectExpr("event_type as key", "ts", "event_id")
    return run_to_table(kd.rebuild_guard_stream(e, 4 * 3600), "guard").select("key", "us")


@query(
    "progress_counts",
    """WITH p AS (SELECT event_id, event_type AS token, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done,
      count(*) OVER (PARTITION BY event_type) AS total FROM events)
    SELECT token, event_id, done, total, floor(100.0 * done / total + 0.5)::INTEGER AS percentage,
      CASE WHEN done = total THEN 'end' WHEN done = 1 THEN 'start' ELSE 'report' END AS state FROM p""",
)
def progress_query(spark, sf):
    e = tb.load(spark, sf, "events").selectExpr("event_type as token", "ts", "event_id", "1 as processed")
    totals = e.groupBy("token").agg(F.count("*").alias("total"))
    return sg.progress_counts(e, totals)


# ------------------------------------------------------------ streamed upserts

LATEST_SQL = "SELECT user_id AS session, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type || event_id, (ts, event_id)) AS query FROM events GROUP BY user_id"


def typed_queries(e):
    return e.selectExpr("user_id as session", "ts", "event_id", "concat(event_type, event_id) as query")


@query("latest_query", LATEST_SQL)
def latest_query_query(spark, sf):
    frame = kd.latest_query_stream(typed_queries(event_stream(spark, sf)))
    path = fresh_dir(spark, "latest")
    run_steps(frame, "latest", st.upsert_versions(path), "update")
    return st.latest(spark.read.parquet(path), ["session"]).select("session", "event_id", "query")


@query("stream_activity", f"WITH {ACTIVITY_SQL} SELECT item_id, access_count, round(score, 6) AS score FROM activity")
def stream_activity_query(spark, sf):
    accesses = event_stream(spark, sf).selectExpr("concat('part:', user_id) as item_id", "ts", "event_id")
    path, merged = fresh_dir(spark, "usage"), fresh_dir(spark, "usage-merged")
    run_steps(kd.access_counts_stream(accesses), "usage", st.upsert_versions(path), "update")
    st.merge_versions(spark, path, merged, ["item_id"])
    counts = spark.read.parquet(merged).withColumn("last_accessed", F.timestamp_micros("last_us").cast("timestamp_ntz"))
    return act.activity_score(counts, tb.as_of(spark, sf)).select("item_id", "access_count", R6("score").alias("score"))


# --------------------------------------------------------------- index upkeep

USER_PATH = "concat('/u/', user_id % 2, '/', if(user_id < 20, 'node_modules/', ''), user_id, '.ts')"
CHANGE_KIND = "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' ELSE 'change' END"


def base_index(spark, sf):
    """One file row and one symbol row per user seen, as of before the stream."""
    u = tb.load(spark, sf, "events").selectExpr(f"{USER_PATH} as file_path").distinct()
    return u.selectExpr("concat('file:', file_path) as id", "file_path", "cast(0 as bigint) as built_by").unionByName(
        u.selectExpr("concat('symbol:', file_path) as id", "file_path", "cast(0 as bigint) as built_by")
    )


def rebuilt(rows):
    return rows.selectExpr("concat('file:', file_path) as id", "file_path", "event_id as built_by")


UPKEEP_SQL = """WITH p AS (SELECT *, '/u/' || (user_id % 2) || '/' || CASE WHEN user_id < 20 THEN 'node_modules/' ELSE '' END || user_id || '.ts' AS file_path FROM events),
    l AS (SELECT file_path, any_value(user_id) AS u, arg_max(event_type, (ts, event_id)) AS kind, max((ts, event_id))[2] AS event_id FROM p GROUP BY 1)
    SELECT 'file:' || file_path AS id, file_path, CASE WHEN u < 20 THEN 0 ELSE event_id END AS built_by FROM l WHERE u < 20 OR kind <> 'error'
    UNION ALL SELECT 'symbol:' || file_path, file_path, 0 FROM l WHERE u < 20"""


def kept_index(spark, sf) -> str:
    root = fresh_dir(spark, "upkeep")
    up.replace_items(base_index(spark, sf), root)
    changes = event_stream(spark, sf).selectExpr(f"{USER_PATH} as file_path", f"{CHANGE_KIND} as kind", "ts", "event_id")
    run_steps(changes, "upkeep", up.apply_changes(root, rebuilt))
    return root


@query("apply_changes", UPKEEP_SQL)
def apply_changes_query(spark, sf):
    return up.live_items(spark, kept_index(spark, sf)).select("id", "file_path", "built_by")


@query("removals_before_adds", UPKEEP_SQL)
def compacted_query(spark, sf):
    root = kept_index(spark, sf)
    # A removal of the first batch that arrives after the paths were added again must not delete these rows.
    fresh = spark.read.parquet(f"{root}/adds").filter("version > 1").select(normalize_path(F.col("file_path")).alias("file_path")).distinct()
    fresh.write.mode("append").parquet(f"{root}/removals/version=1")
    target = fresh_dir(spark, "compacted")
    up.compact(spark, root, target)
    return up.live_items(spark, target).select("id", "file_path", "built_by")


@query(
    "append_items",
    "SELECT 'e:' || event_id AS id, '/u/' || user_id AS file_path FROM events UNION ALL SELECT DISTINCT 'base', '/u/' || user_id FROM events",
)
def append_query(spark, sf):
    root = fresh_dir(spark, "append")
    u = tb.load(spark, sf, "events").selectExpr("'base' as id", "concat('/u/', user_id) as file_path").distinct()
    up.replace_items(u, root)
    rows = event_stream(spark, sf).selectExpr("concat('e:', event_id) as id", "concat('/u/', user_id) as file_path")
    run_steps(rows, "append", up.append_items(root))
    return up.live_items(spark, root).select("id", "file_path")


# ------------------------------------------------------------- streamed search

@query(
    "stream_search",
    f"""WITH {SEARCH_SQL} SELECT qid, id, rank::INTEGER AS rank, round(score, 6) AS score FROM final WHERE rank <= k AND q_scope NOT IN ('open', 'modified')""",
)
def stream_search_query(spark, sf):
    source = fresh_dir(spark, "typed")
    tb.queries(spark).filter("scope not in ('open', 'modified')").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(tb.QUERIES_DDL).parquet(source)
    path = fresh_dir(spark, "answers")
    run_steps(stream, "answers", up.answer_queries(tb.index(spark, sf), path, activity_table(spark, sf)))
    return spark.read.parquet(path).select("qid", "id", "rank", R6("score").alias("score"))
