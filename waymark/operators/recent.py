"""Answers to blank queries."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import normalize_path
from waymark.operators.activity import recent_items
from waymark.schema import DEFAULT_RESULTS


def blank_results(
    queries: DataFrame,
    activity: DataFrame,
    items: DataFrame,
    as_of,
    paths: DataFrame | None = None,
) -> DataFrame:
    """Recent items for each blank query `(qid, query, scope, max_results)`.

    `paths` restricts the answers to open or modified files. As many recent items
    are ranked as the largest query asks for, and each query takes its own count.
    """
    asked = queries.select("qid", F.coalesce("max_results", F.lit(DEFAULT_RESULTS)).alias("k")).filter("k > 0")
    most = asked.agg(F.coalesce(F.max("k"), F.lit(0)).alias("k")).first()["k"]
    if paths is not None:
        wanted = paths.select(normalize_path(F.col("file_path")).alias("_p")).distinct()
        items = items.join(wanted, normalize_path(F.col("file_path")) == F.col("_p"), "left_semi")
    recent = recent_items(activity, items, as_of, most)
    w = Window.orderBy(F.desc("last_accessed"), F.asc("id"))
    ranked = recent.withColumn("rank", F.row_number().over(w))
    return asked.withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("k")))).join(ranked, "rank").drop("k")
