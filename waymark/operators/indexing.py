"""From a listing of files to a stored index, as one job."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import language_of
from waymark.operators import fast
from waymark.operators.build import code_symbols, controller_endpoints, minimal_api_endpoints
from waymark.operators.commands import command_items
from waymark.operators.index import dedupe_files, item_features
from waymark.operators.postings import GramIndex
from waymark.operators.routes import route_index
from waymark.schema import conform_items
from waymark.session import cut, fresh_dir, spread, union_all
from waymark.sources.corpus import DEFAULT_EXCLUDES, drop_generated_content, drop_generated_paths, drop_ignored, exclude_globs, file_items

#: Kinds of items come one after the other in the order of the index.
KIND_STEP = 1 << 56


class Index(NamedTuple):
    """What searches read: feature rows, route keys of the endpoints, and posting lists of the names if asked for."""

    features: DataFrame
    routes: DataFrame
    grams: GramIndex | None


def kept_files(listing: DataFrame, verdicts: DataFrame | None = None, excludes=DEFAULT_EXCLUDES) -> DataFrame:
    """Files of `listing(seq, file_path, relative_path, size, text)` that are indexed, once for each normalized path.

    Left out are paths that a glob excludes, C# sources that are generated by their path or
    say so in their first kilobyte, and those that a verdict of the ignore rules names. The
    latest row of a path counts, at its first place.
    """
    files = drop_generated_paths(exclude_globs(listing, excludes))
    sharp = F.coalesce(F.endswith("file_path", F.lit(".cs")), F.lit(False)) & F.col("text").isNotNull()
    files = files.filter(~sharp).unionByName(drop_generated_content(files.filter(sharp)))
    if verdicts is not None:
        files = drop_ignored(files, verdicts)
    # Texts are not shuffled to find the latest row of a path: its number is enough.
    once = dedupe_files(files.select("seq", "file_path")).select(F.col("seq").alias("_seq"), F.col("listed_at"))
    return files.join(once, F.col("seq") == F.col("_seq")).drop("_seq").withColumn("language", language_of(F.col("file_path")))


def index_items(listing: DataFrame, verdicts: DataFrame | None = None, commands: DataFrame | None = None, excludes=DEFAULT_EXCLUDES) -> DataFrame:
    """All items of a listing: files, declarations, endpoints of C# sources, and commands, with their place `seq`.

    Within a kind, items come in the order of the listing and of their lines. `seq` of a
    listing must be unique; a null text has no declarations.
    """
    # Texts are small files when written, but lexing them is the work of the job.
    files = cut(spread(kept_files(listing, verdicts, excludes)), "listing")
    place = files.select("file_path", F.col("listed_at").alias("_at"))
    texts = files.filter("text is not null")
    sharp = texts.filter("language = 'csharp'")
    arms = [
        file_items(files).join(files.select("file_path", "size"), "file_path"),
        code_symbols(texts).withColumn("line", F.col("line").cast("int")),
        controller_endpoints(sharp).unionByName(minimal_api_endpoints(sharp), allowMissingColumns=True),
    ]
    paths = files.select("file_path", F.col("relative_path").alias("_relative"))
    ordered = []
    for arm in arms:
        if "relative_path" not in arm.columns:
            arm = arm.join(paths, "file_path").withColumnRenamed("_relative", "relative_path")
        # Numbers follow a sort by ranges, so no task sees a whole kind.
        lines = [c for c in ("line", "nth") if c in arm.columns]
        ordered.append(arm.join(place, "file_path").orderBy("_at", *lines, "id"))
    if commands is not None:
        ordered.append(command_items(commands).withColumn("file_path", F.lit(None).cast("string")).orderBy("id"))
    numbered = [
        conform_items(cut(x, "items").withColumn("seq", F.monotonically_increasing_id() + k * KIND_STEP)) for k, x in enumerate(ordered)
    ]
    return union_all(numbered)


def build_index(
    listing: DataFrame, verdicts: DataFrame | None = None, commands: DataFrame | None = None, excludes=DEFAULT_EXCLUDES, grams: bool = False
) -> Index:
    """Build and store the index of a listing (see `index_items`): features spread by id and sorted by scope, route keys, posting lists."""
    spark = listing.sparkSession
    features = item_features(index_items(listing, verdicts, commands, excludes))
    path = fresh_dir(spark, "index")
    features.repartition("id").sortWithinPartitions("scope", "seq").write.parquet(path)
    stored = spark.read.schema(features.schema).parquet(path)
    routes = cut(route_index(stored.filter("scope = 'endpoints'")), "routes")
    return Index(stored, routes, fast.name_grams(stored) if grams else None)
