"""Query preparation: prefixes, line suffixes, derived columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.fuzzy import query_chars
from waymark.functions.routes import clean_path, is_potential_url, path_verb, segments
from waymark.functions.text import fold, mask_of_folded, slashes
from waymark.schema import DEFAULT_FAST_RESULTS, DEFAULT_RESULTS

# Typed prefix -> scope, first match wins.
SCOPE_PREFIXES = [
    ("/t ", "types"),
    ("/classes ", "types"),
    ("/types ", "types"),
    ("/c ", "types"),
    ("/txt ", "text"),
    ("/text ", "text"),
    ("/s ", "symbols"),
    ("/symbols ", "symbols"),
    ("/f ", "files"),
    ("/files ", "files"),
    ("/cmd ", "commands"),
    ("/commands ", "commands"),
    ("/p ", "properties"),
    ("/properties ", "properties"),
    ("/e ", "endpoints"),
    ("/endpoints ", "endpoints"),
    ("/a ", "everything"),
    ("/all ", "everything"),
    ("/everything ", "everything"),
    ("/o ", "open"),
    ("/open ", "open"),
    ("/m ", "modified"),
    ("/modified ", "modified"),
    ("/git ", "modified"),
    ("#", "symbols"),
    (">", "commands"),
]


def parse_scope_prefix(query: Column) -> tuple[Column, Column]:
    """(scope or NULL, remaining text) of a typed query."""
    table = ", ".join(f"named_struct('p', '{p}', 's', '{s}')" for p, s in SCOPE_PREFIXES)
    low = F.lower(query)
    hit = F.try_element_at(
        F.filter(F.expr(f"array({table})"), lambda e: F.startswith(low, e["p"])), F.lit(1)
    )
    text = F.when(hit.isNotNull(), F.substr(query, F.length(hit["p"]) + 1)).otherwise(query)
    return hit["s"], text


def parse_line_suffix(query: Column) -> tuple[Column, Column]:
    """(text, 0-based target line or NULL) of `text:NN`; `:0` sets no line."""
    has = query.rlike(r"^.*?:\d+$")
    text = F.when(has, F.regexp_extract(query, r"^(.*?):(\d+)$", 1)).otherwise(query)
    number = F.when(has, F.regexp_extract(query, r"^(.*?):(\d+)$", 2).try_cast("int"))
    return text, F.when(number > 0, number - 1)


def query_context(queries: DataFrame, fast: bool = False) -> DataFrame:
    """Derived columns of a query table `(qid, query, scope, max_results)`.

    Adds the effective text, its folded form, characters, mask, result count,
    target line and, for queries that look like a path, the route parts.
    """
    default_k = DEFAULT_FAST_RESULTS if fast else DEFAULT_RESULTS
    text, line = parse_line_suffix(F.trim(F.col("query")))
    q = queries.select(
        "qid",
        F.col("query").alias("raw_query"),
        F.coalesce(F.col("scope"), F.lit("everything")).alias("q_scope"),
        F.coalesce(F.col("max_results"), F.lit(default_k)).cast("int").alias("k"),
        slashes(text).alias("q_text"),
        line.alias("target_line"),
    )
    url = is_potential_url(F.col("q_text")) & F.col("q_scope").isin("everything", "endpoints")
    return q.withColumn("q_low", fold(F.col("q_text"))).select(
        "*",
        query_chars("q_low").alias("q_chars"),
        mask_of_folded("q_low").alias("q_mask"),
        url.alias("is_url"),
        path_verb(F.col("q_text")).alias("q_verb"),
        segments(F.lower(clean_path(F.col("q_text")))).alias("q_segments"),
    )


def live(context: DataFrame) -> DataFrame:
    """Queries with text; blank ones are answered from history instead."""
    return context.filter(F.trim(F.col("q_text")) != "")


def blank(queries: DataFrame) -> DataFrame:
    """Queries whose text is empty or only spaces."""
    return queries.filter(F.trim(F.coalesce(F.col("query"), F.lit(""))) == "")


def about_queries(context: DataFrame):
    """One row about a query set: count, bytes of text, largest k, whether any looks like a path,
    which scopes occur, and which of these are file sets. It decides which arms to plan."""
    return context.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length("raw_query") + F.octet_length("q_text") + F.octet_length("q_low")), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("k"), F.lit(1)).alias("k"),
        F.coalesce(F.bool_or("is_url"), F.lit(False)).alias("urls"),
        F.collect_set(F.when(F.col("q_scope").isin("open", "modified"), F.col("q_scope"))).alias("sets"),
        F.collect_set("q_scope").alias("scopes"),
    ).first()
