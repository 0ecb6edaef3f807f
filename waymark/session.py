"""Session helpers: defaults for local runs, the shared folder, size checks."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of sessions that name none, and the tables written to cut lineage, by application.
_OWN_DIR: dict[str, str] = {}
_CUTS: dict[str, list[str]] = {}


def local_session(app: str = "waymark", cores: str = "*", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and benches, which name the shared folder; clusters bring their own."""
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Call sites of every column cost milliseconds; only error texts use them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WAYMARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by `spark.checkpoint.dir`.

    Where that is unset, a local master, which has no other machines, gets one of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="waymark-")
    return _OWN_DIR[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut", **options: str) -> DataFrame:
    """Cut lineage through a table written to the shared folder.

    The data survives lost executors, and later stages read it back instead of
    computing it again. `options` are those of the writer.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.options(**options).parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_cuts(spark: SparkSession) -> None:
    """Delete the tables that `cut` wrote in this application; results that read them are over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in _CUTS.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when `df` has at most `max_rows` rows; reads no more than it must."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt evenly to as many tasks as the session uses: for a small table whose rows each make much work."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def scalar(df: DataFrame):
    """One-row, one-column frame as a scalar subquery (no join in the plan)."""
    return df.scalar()


def union_all(frames) -> DataFrame:
    """Union by name of one or more frames."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def micros_between(start, end):
    """Elapsed microseconds between two timestamps of the same kind."""
    return F.timestamp_diff("MICROSECOND", start, end)
