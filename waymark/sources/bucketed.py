"""Tables stored in hash buckets, so that a join on their key shuffles the other side only."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(
    df: DataFrame, path: str, keys: list[str], buckets: int | None = None, within: Callable[[DataFrame], DataFrame] | None = None, **options: str
) -> DataFrame:
    """Write `df` below `path`, one file per bucket of `keys`, and give it back as a table.

    `buckets` is the number of shuffle partitions where not given: the other side of a join
    is then dealt alike. `within` is what happens to rows dealt out already, such as a grouping by `keys`.
    `options` are those of the writer.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *keys)
    dealt = (dealt if within is None else within(dealt)).sortWithinPartitions(*keys)
    dealt.write.format("parquet").options(**options).option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A table that another session wrote with `write_bucketed`."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
