"""Index columns of items and filters on item sets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import fold, mask_of_folded, normalize_path, slashes
from waymark.schema import scope_of


def item_features(items: DataFrame) -> DataFrame:
    """Feature columns, computed once at index build and stored with the rows.

    The full name counts only where it differs from name and path.
    """
    own_full = (
        F.col("full_name").isNotNull()
        & (F.col("full_name") != F.col("name"))
        & ~F.col("full_name").eqNullSafe(F.col("relative_path"))
    )
    full = F.when(own_full, F.col("full_name"))
    # Folded once, then read by every mask test.
    folded = items.select(
        "*",
        scope_of(F.col("type")).alias("scope"),
        fold(F.col("name")).alias("name_low"),
        fold(full).alias("full_low"),
        fold(slashes(F.col("relative_path"))).alias("path_low"),
        F.length("name").alias("name_len"),
    )
    masks = [mask_of_folded(f"{part}_low").alias(f"{part}_mask") for part in ("name", "full", "path")]
    return folded.select("*", *masks).withColumn("item_mask", F.expr("name_mask | full_mask | path_mask"))


def filter_scope(items: DataFrame, scope: str) -> DataFrame:
    """Items of one static scope; a partition filter on a stored index."""
    return items if scope == "everything" else items.filter(F.col("scope") == scope)


def filter_paths(items: DataFrame, paths: DataFrame) -> DataFrame:
    """Items whose normalized path is in a set (open or modified files)."""
    wanted = paths.select(normalize_path(F.col("file_path")).alias("_p")).distinct()
    return items.join(wanted, normalize_path(F.col("file_path")) == F.col("_p"), "left_semi")


def remove_by_files(items: DataFrame, paths: DataFrame) -> DataFrame:
    """Items outside a set of paths; unknown or repeated paths are harmless."""
    gone = paths.select(normalize_path(F.col("file_path")).alias("_p")).distinct()
    return items.join(gone, normalize_path(F.col("file_path")) == F.col("_p"), "left_anti")


def resolve_items(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Requested ids `(req_id, ids)` in order; missing dropped, repeats kept."""
    wanted = requests.select("req_id", F.posexplode("ids").alias("pos", "_id"))
    return (
        wanted.join(items, F.col("_id") == F.col("id"))
        .select("req_id", "pos", "id", "name", "type", F.lit(1.0).alias("score"),
                scope_of(F.col("type")).alias("scope"))
    )


def dedupe_files(items: DataFrame) -> DataFrame:
    """One row per normalized path: the latest row, listed at its first position."""
    row = F.struct(*items.columns)
    return (
        items.groupBy(normalize_path(F.col("file_path")).alias("norm_path"))
        .agg(F.max_by(row, "seq").alias("r"), F.min("seq").alias("listed_at"),
             F.count("*").alias("copies"))
        .select("norm_path", "listed_at", "copies", "r.*")
    )


def index_stats(items: DataFrame) -> DataFrame:
    """One row of totals in one pass."""
    t = F.col("type")
    return items.agg(
        F.count("*").alias("total_items"),
        F.count_if(t == "file").alias("total_files"),
        F.count_if(t.isin("class", "interface", "enum")).alias("total_types"),
        F.count_if(t.isin("method", "function", "property")).alias("total_symbols"),
    )


def index_is_empty(stats: DataFrame) -> DataFrame:
    """True when there are neither items nor files."""
    return stats.select(
        ((F.col("total_items") == 0) & (F.col("total_files") == 0)).alias("is_empty")
    )
