"""Debouncing, batching, change detection and guards over event streams."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.prefix import running, time_chunk
from waymark.session import cut

# ------------------------------------------------- event-time aggregates (JVM)


def _event_time(df: DataFrame, delay: str) -> DataFrame:
    """Event time as the watermark needs it: a timestamp, not a local one."""
    timed = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay) if df.isStreaming else timed


def _local(name: str) -> Column:
    return F.col(f"w.{name}").cast("timestamp_ntz").alias(name)


def debounce(events: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """One row per burst of `events(key, ts, value)`: the last value after a
    quiet gap. In a stream a burst is emitted once the watermark passes it."""
    return (
        _event_time(events, delay).groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))
        .select(key, _local("start"), _local("end"), "value", "n")
    )


def batch_window(requests: DataFrame, folder: str, item: str, width: str, delay: str) -> DataFrame:
    """Distinct items per folder and fixed window, as rows (aligned windows)."""
    return (
        _event_time(requests, delay).groupBy(F.window("ts", width).alias("w"), folder, item)
        .agg(F.count("*").alias("n"))
        .select(_local("start"), _local("end"), folder, item, "n")
    )


def debounce_rest(events: DataFrame, emitted: DataFrame, key: str, gap: str) -> DataFrame:
    """Bursts still open when a run of the stream `debounce` ended, from the same events as a batch.

    Bursts of a key do not overlap, so only rows after its last emitted one are read.
    """
    last = emitted.groupBy(key).agg(F.max("end").alias("_end"))
    rest = events.join(last, key, "left").filter(F.col("_end").isNull() | (F.col("ts") >= F.col("_end"))).drop("_end")
    return debounce(rest, key, gap, "0 seconds")


def batch_window_rest(requests: DataFrame, emitted: DataFrame, folder: str, item: str, width: str) -> DataFrame:
    """Windows still open when a run of the stream `batch_window` ended: those after the last emitted one."""
    closed = emitted.agg(F.max("end")).scalar()
    return batch_window(requests.filter(closed.isNull() | (F.col("ts") >= closed)), folder, item, width, "0 seconds")


def latest_query(typed: DataFrame) -> DataFrame:
    """The newest query per session `(session, ts, event_id, query)`."""
    return typed.groupBy("session").agg(F.max(F.struct("ts", "event_id", "query")).alias("last")).select(
        "session", "last.event_id", "last.query"
    )


# ---------------------------------------------- steps along the order of a key


def changes_only(events: DataFrame, state: DataFrame | None = None, chunk: Column | None = None) -> DataFrame:
    """Rows of `(key, ts, event_id, value)` whose value differs from the row before.

    The first value of a key is its baseline. `state` holds the last row of each
    key seen earlier.
    """
    rows = events.select("key", "ts", "event_id", "value", F.lit(True).alias("_new"))
    if state is not None:
        rows = rows.unionByName(state.select("key", "ts", "event_id", "value", F.lit(False).alias("_new")))
    part = time_chunk(rows) if chunk is None else chunk
    seen = running(rows, ["key"], ["ts", "event_id"], part, {"previous": ("lag", F.col("value"))})
    return seen.filter(F.col("_new") & (F.col("previous") != F.col("value"))).drop("_new")


def cooldown(events: DataFrame, rebuilds: DataFrame, seconds: float = 5.0, chunk: Column | None = None) -> DataFrame:
    """Drop creates and changes that follow a rebuild within `seconds`.

    Deletes pass. A backward as-of lookup over time chunks finds the latest
    rebuild at or before each event; no range join.
    """
    extra = [c for c in events.columns if c not in ("ts", "event_id", "kind")]
    e = events.select("ts", "event_id", "kind", *extra, F.lit(1).alias("_side"), F.lit(None).cast(rebuilds.schema["ts"].dataType).alias("_r"))
    r = rebuilds.select(
        "ts", "event_id", F.lit(None).cast("string").alias("kind"),
        *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in extra],
        F.lit(0).alias("_side"), F.col("ts").alias("_r"),
    )
    part = time_chunk(events) if chunk is None else chunk
    seen = running(e.unionByName(r), [], ["ts", "_side", "event_id"], part, {"_last": ("last", F.col("_r"))})
    age = F.timestamp_diff("MICROSECOND", F.col("_last"), F.col("ts"))
    quiet = F.col("_last").isNull() | (age > int(seconds * 1_000_000))
    return seen.filter((F.col("_side") == 1) & (quiet | (F.col("kind") == "delete"))).select(*events.columns)


def rebuild_guard(
    requests: DataFrame, seconds: float = 60.0, state: DataFrame | None = None, chunk: Column | None = None
) -> DataFrame:
    """Requests `(key, ts, event_id)` that start a rebuild: more than `seconds`
    after the last accepted one of the key. `state` holds accepted ones from before.

    Rows of a key are numbered by time, and each is given the number of the first one
    after its pause, by counting. The accepted ones are those on the way from the first
    row along these successors. Steps are doubled: with the rows 0 to n - 1 of the way and the
    successors n steps on, both double in one equality join on key and number, so a key of
    any density is spread over all tasks and the rounds grow with the logarithm of the way.
    """
    gap = int(seconds * 1_000_000)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz"))
    rows = requests.select("key", "ts", "event_id", F.lit(False).alias("prior"))
    if state is not None:
        rows = rows.unionByName(state.select("key", "ts", "event_id", F.lit(True).alias("prior")))
    rows = rows.withColumn("us", us)
    chunk = time_chunk(rows) if chunk is None else chunk
    # Each row asks, at the end of its pause, how many rows lie up to there.
    asks = rows.select("key", F.expr(f"ts + interval {gap} microseconds").alias("ts"), "event_id", "prior", (F.col("us") + gap).alias("us"))
    both = rows.withColumn("_side", F.lit(0)).unionByName(asks.withColumn("_side", F.lit(1)))
    counted = running(both, ["key"], ["us", "_side", "event_id", "prior"], chunk, {"n": ("sum", (1 - F.col("_side")).cast("bigint"))})
    counted = cut(counted.select("key", "event_id", "prior", "us", "_side", "n"), "guard")
    numbered = counted.filter("_side = 0").select("key", "event_id", "prior", "us", (F.col("n") - 1).alias("at"))
    asked = counted.filter("_side = 1").select("key", "event_id", "prior", (F.col("us") - gap).alias("us"), F.col("n").alias("to"))
    last = numbered.groupBy("key").agg(F.max("at").alias("last"))
    # The counts of a row and of its question meet again; a way ends where nothing follows.
    own = numbered.join(asked, ["key", "us", "event_id", "prior"])
    steps = own.join(last, "key").filter(F.col("to") <= F.col("last")).select("key", "at", "to")
    way = numbered.filter("at = 0").select("key", "at")
    while True:
        steps, way = cut(steps, "guard"), cut(way, "guard")
        if steps.isEmpty():
            break
        way = way.unionByName(way.join(steps, ["key", "at"]).select("key", F.col("to").alias("at")))
        onward = steps.select("key", F.col("at").alias("to"), F.col("to").alias("further"))
        steps = steps.join(onward, ["key", "to"]).select("key", "at", F.col("further").alias("to"))
    chosen = numbered.filter("not prior").join(way, ["key", "at"])
    return chosen.select("key", "event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))


def progress_counts(batches: DataFrame, totals: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Processed count, rounded percentage and state after each finished batch.

    `batches(token, ts, event_id, processed)`, `totals(token, total)`.
    """
    part = time_chunk(batches) if chunk is None else chunk
    done = running(batches, ["token"], ["ts", "event_id"], part, {"done": ("sum", F.col("processed").cast("bigint"))})
    state = (
        F.when(F.col("done") >= F.col("total"), F.lit("end"))
        .when(F.col("done") == F.col("processed"), F.lit("start"))
        .otherwise(F.lit("report"))
    )
    return done.join(totals, "token").select(
        "token", "event_id", "done", "total",
        F.floor(F.lit(100.0) * F.col("done") / F.col("total") + 0.5).cast("int").alias("percentage"),
        state.alias("state"),
    )
