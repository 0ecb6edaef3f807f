"""One entry for every kind of query: blank, text and ranked."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.grep import first_hits, grep, text_items
from waymark.operators.queries import blank
from waymark.operators.ranking import search
from waymark.operators.recent import blank_results
from waymark.schema import DEFAULT_RESULTS
from waymark.session import union_all

COLUMNS = ["qid", "kind", "rank", "id", "name", "type", "file_path", "line", "score"]


def answer(
    queries: DataFrame,
    features: DataFrame,
    activity: DataFrame | None = None,
    as_of: Column | None = None,
    docs: DataFrame | None = None,
    open_files: DataFrame | None = None,
    modified_files: DataFrame | None = None,
    route_keys: DataFrame | None = None,
) -> DataFrame:
    """Rows `(qid, kind, rank, id, name, type, file_path, line, score)`.

    Blank queries get recent items (`recent`; of open or modified files for those
    scopes), queries of the scope `text` the lines of `docs` that hold them, open
    files first (`text`), all others the ranked search (`ranked`). A kind whose
    source is not given has no answers.
    """
    text = (F.col("scope") == "text") & (F.trim(F.coalesce(F.col("query"), F.lit(""))) != "")
    ranked = search(
        queries.filter(~F.coalesce(text, F.lit(False))), features, activity, open_files, modified_files, route_keys
    )
    arms = [ranked.withColumn("kind", F.lit("ranked"))]
    if activity is not None and as_of is not None:
        asked = blank(queries)
        of_set = F.coalesce(F.col("scope").isin("open", "modified"), F.lit(False))
        recent = [blank_results(asked.filter(~of_set), activity, features, as_of)]
        for scope, paths in (("open", open_files), ("modified", modified_files)):
            if paths is not None:
                recent.append(blank_results(asked.filter(F.col("scope") == scope), activity, features, as_of, paths))
        arms.append(union_all(recent).withColumn("kind", F.lit("recent")).withColumn("line", F.lit(None).cast("int")))
    if docs is not None:
        asked = queries.filter(text).withColumn("max_results", F.coalesce("max_results", F.lit(DEFAULT_RESULTS)))
        hits = first_hits(grep(docs, asked), open_files).withColumn("rank", F.col("pos"))
        arms.append(text_items(hits, "rank").withColumn("kind", F.lit("text")))
    return union_all([a.select(*COLUMNS) for a in arms])
