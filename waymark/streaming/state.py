"""Updates of micro-batches as plain tables.

Every micro-batch writes its own version folder and overwrites it when it is
run again, so a retry changes nothing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest version per key."""
    cols = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*cols), "version").alias("r"))
        .select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols if c != "version"])
    )


def upsert_versions(path: str):
    """A `foreachBatch` function that keeps each batch of updates as a version."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return each


def merge_versions(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """Write the latest row of each key as the only version of a new folder, for a stream that starts there."""
    latest(spark.read.parquet(path), keys).write.parquet(f"{target}/version=0")


def run_available(stream_writer, checkpoint: str) -> None:
    """Process everything that is there, then stop."""
    q = stream_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
