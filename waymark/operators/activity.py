"""Usage history: counts, decayed scores, recent items."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.prefix import running, time_chunk
from waymark.functions.text import relative_time
from waymark.schema import RETENTION_DAYS
from waymark.session import micros_between

DAY_MICROS = 86_400_000_000


def access_counts(accesses: DataFrame) -> DataFrame:
    """Accesses `(item_id, ts)` -> last access and count per item."""
    return accesses.groupBy("item_id").agg(
        F.max("ts").alias("last_accessed"), F.count("*").alias("access_count")
    )


def latest_items(accesses: DataFrame, row: Column) -> DataFrame:
    """As `access_counts`, keeping the item row of the latest access."""
    return accesses.groupBy("item_id").agg(
        F.max("ts").alias("last_accessed"),
        F.count("*").alias("access_count"),
        F.max_by(row, F.struct("ts", "event_id")).alias("item"),
    )


def activity_score(activity: DataFrame, as_of: Column) -> DataFrame:
    """0.6 / (1 + days since last access) + 0.4 * count / largest count."""
    top = activity.agg(F.greatest(F.max("access_count"), F.lit(1))).scalar()
    days = micros_between(F.col("last_accessed"), as_of) / DAY_MICROS
    score = F.lit(0.6) / (F.lit(1.0) + days) + F.lit(0.4) * F.col("access_count") / top
    return activity.withColumn("score", score)


def running_max_count(accesses: DataFrame) -> DataFrame:
    """After each access: the item's count so far and the largest count so far.

    Both run over time chunks, so neither a hot item nor the global order ends
    up in one task.
    """
    order = ["ts", "event_id"]
    chunk = time_chunk(accesses)
    counted = running(accesses, ["item_id"], order, chunk, {"access_count": ("sum", F.lit(1).cast("bigint"))})
    return running(counted, [], order, chunk, {"max_access_count": ("max", F.col("access_count"))})


def retain(activity: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Drop records last used more than `days` ago."""
    return activity.filter(micros_between(F.col("last_accessed"), as_of) <= days * DAY_MICROS)


def load_activity(saved: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """Merge a saved snapshot with the running session, then retain and rescore.

    Counts add up; the session's last access wins.
    """
    s, c = saved.alias("s"), current.alias("c")
    merged = s.join(c, F.col("s.item_id") == F.col("c.item_id"), "full_outer").select(
        F.coalesce("c.item_id", "s.item_id").alias("item_id"),
        F.coalesce("c.last_accessed", "s.last_accessed").alias("last_accessed"),
        (F.coalesce("c.access_count", F.lit(0)) + F.coalesce("s.access_count", F.lit(0))).alias("access_count"),
    )
    return activity_score(retain(merged, as_of), as_of)


def save_activity(activity: DataFrame, as_of: Column, path: str) -> None:
    """Rescore and persist a snapshot."""
    activity_score(activity, as_of).write.mode("overwrite").parquet(path)


def top_ids(activity: DataFrame, n: int) -> DataFrame:
    """The `n` ids with the highest score; ties by id."""
    return activity.orderBy(F.desc("score"), F.asc("item_id")).limit(n).select("item_id", "score")


def recent_items(activity: DataFrame, items: DataFrame, as_of: Column, n: int = 20) -> DataFrame:
    """The `n` latest used known items, their age appended to the detail."""
    known = activity.join(items, F.col("item_id") == F.col("id"))
    best = known.orderBy(F.desc("last_accessed"), F.asc("item_id")).limit(n)
    age = F.concat(F.lit("Accessed "), relative_time(micros_between(F.col("last_accessed"), as_of)))
    detail = F.when(F.col("detail") != "", F.col("detail"))
    return best.select(
        "id", "name", "type", "file_path", "last_accessed",
        F.concat_ws(" • ", detail, age).alias("detail"),
        F.lit(2.0).alias("score"),
    )


def activity_stats(activity: DataFrame) -> DataFrame:
    """Record count and average score, 0 when empty."""
    return activity.agg(
        F.count("*").alias("total_records"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
    )


def forget(activity: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove the records of some ids."""
    return activity.join(ids.select("item_id").distinct(), "item_id", "left_anti")


def clear(activity: DataFrame) -> DataFrame:
    """An empty history with the same columns."""
    return activity.limit(0)


def mru(opened: DataFrame, key: str, n: int = 20, skip_kind: str | None = "Command") -> DataFrame:
    """Most recently used first, one row per key, commands left out."""
    rows = opened if skip_kind is None else opened.filter(~F.col("kind").eqNullSafe(skip_kind))
    last = rows.groupBy(key).agg(F.max(F.struct("ts", "event_id", "kind")).alias("last"))
    return (
        last.select(key, "last.*")
        .orderBy(F.desc("ts"), F.desc("event_id"))
        .limit(n)
    )


def recent_or_history(recent: DataFrame, history: DataFrame) -> DataFrame:
    """Recent items, or the history list when there are none.

    The test is one row: whether any recent item exists.
    """
    any_recent = recent.agg(F.count("*") > 0).scalar()
    cols = recent.columns
    return (
        recent.withColumn("source", F.lit("recent"))
        .unionByName(history.select(*cols).filter(~any_recent).withColumn("source", F.lit("history")))
    )
