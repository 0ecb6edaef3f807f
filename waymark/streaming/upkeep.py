"""Index upkeep from a stream of file changes.

The index is a base, in buckets of the path, and a set of version folders: `adds` holds item
rows, `removals` holds paths. A row is live when no removal of its path has a later version, so
removals of a version always come before its additions, and a late removal
never deletes fresh rows. A micro-batch writes only what it changed; the base is
not rewritten until `compact`.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import any_glob_regex, normalize_path, slashes
from waymark.operators.answers import answer
from waymark.sources.bucketed import open_bucketed, write_bucketed
from waymark.sources.corpus import DEFAULT_EXCLUDES, is_generated_path

#: Column of the base that holds the normalized path.
PATH = "_path"


def replace_items(items: DataFrame, root: str, buckets: int | None = None) -> None:
    """Start an index, or a full rebuild, in a fresh folder; the base lies in buckets of the normalized path."""
    spark = items.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    # The number of buckets is part of the folder's name, so that another session can open it.
    write_bucketed(items.withColumn(PATH, normalize_path(F.col("file_path"))), f"{root}/base/{n}", [PATH], n)
    paths = items.select(normalize_path(F.col("file_path")).alias("file_path")).limit(0)
    paths.write.mode("overwrite").parquet(f"{root}/removals/version=0")
    items.limit(0).write.mode("overwrite").parquet(f"{root}/adds/version=0")


def append_items(root: str):
    """A `foreachBatch` function that adds item batches; batch n is version n + 1."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/adds/version={epoch + 1}")

    return each


def live_items(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the index as it stands.

    The base meets the removed paths in its buckets, so it is read in place; only the rows
    of later versions and the paths are shuffled.
    """
    base, n = base_of(spark, root)
    removals = spark.read.parquet(f"{root}/removals").groupBy("file_path").agg(F.max("version").alias("removed_at"))
    removals = removals.withColumnRenamed("file_path", PATH)
    adds = spark.read.parquet(f"{root}/adds").withColumn(PATH, normalize_path(F.col("file_path"))).join(removals, PATH, "left")
    fresh = adds.filter(F.col("version") >= F.coalesce("removed_at", F.lit(-1))).drop("removed_at", "version")
    kept = base.join(removals.select(PATH), PATH, "left_anti")
    return kept.unionByName(fresh).drop(PATH)


def base_of(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The base of an index, and its number of buckets."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/base")
    (entry,) = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    n = int(entry.getPath().getName())
    return open_bucketed(spark, f"{root}/base/{n}", [PATH], n), n


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Write the live rows as the only version of a new index folder."""
    replace_items(live_items(spark, root), target, base_of(spark, root)[1])


def resolve_changes(
    changes: DataFrame, excludes=DEFAULT_EXCLUDES, ignored: DataFrame | None = None
) -> DataFrame:
    """One row per path of a batch `(file_path, kind, ts, event_id)`.

    The last event counts. Creates and changes of excluded, ignored or generated
    paths are skipped; a delete is only checked against the excludes.
    """
    last = changes.groupBy("file_path").agg(F.max_by(F.struct("kind", "ts", "event_id"), F.struct("ts", "event_id")).alias("e"))
    rows = last.select("file_path", "e.*")
    if excludes:
        inside = F.regexp_replace(slashes(F.col("file_path")), "^/", "")
        rows = rows.filter(~inside.rlike(any_glob_regex(excludes)))
    deleted = F.col("kind") == "delete"
    generated = F.endswith(F.col("file_path"), F.lit(".cs")) & is_generated_path(F.col("file_path"))
    rows = rows.filter(deleted | ~generated)
    if ignored is not None:
        marks = ignored.select("file_path", F.lit(True).alias("_ignored")).distinct()
        rows = rows.join(marks, "file_path", "left").filter(deleted | F.col("_ignored").isNull()).drop("_ignored")
    return rows


def apply_changes(root: str, build: Callable[[DataFrame], DataFrame], excludes=DEFAULT_EXCLUDES, ignored=None):
    """A `foreachBatch` function: remove every touched path, then add what the
    paths hold now (`build`: rows of `resolve_changes` -> item rows)."""

    def each(batch: DataFrame, epoch: int) -> None:
        version = epoch + 1
        now = resolve_changes(batch, excludes, ignored).persist()  # written twice
        now.select(normalize_path(F.col("file_path")).alias("file_path")).write.mode("overwrite").parquet(
            f"{root}/removals/version={version}"
        )
        build(now.filter("kind <> 'delete'")).write.mode("overwrite").parquet(f"{root}/adds/version={version}")
        now.unpersist()

    return each


def answer_queries(features: DataFrame, path: str, activity: DataFrame | None = None, **sources):
    """A `foreachBatch` function: the answers to each batch of queries, of every kind (see `answer`)."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        answer(batch, features, activity, **sources).write.mode("overwrite").parquet(f"{path}/version={epoch}")
        batch.unpersist()

    return each
