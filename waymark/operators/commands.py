"""Commands: catalog rows, search, slash commands and their suggestions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.fuzzy import fuzzy_score
from waymark.functions.text import fold, id_to_title, mask_of_folded
from waymark.operators.pairing import pair_by_mask
from waymark.operators.ranking import keep_scored, top_k
from waymark.session import fits

# Slash commands (name, short name, description, aliases,
# category, scope), in their display order.
SLASH_COMMANDS = [
    ("/all", "all", "Search everywhere across all scopes", ["/a"], "Search", "everything"),
    ("/t", "t", "Find classes, interfaces, and types", ["/classes", "/types", "/type", "/c"], "Search", "types"),
    ("/s", "s", "Find methods, functions, and variables", ["/symbols", "/symbol", "#"], "Search", "symbols"),
    ("/f", "f", "Find files by name or path", ["/files", "/file"], "Files", "files"),
    ("/txt", "txt", "Search text content across files", ["/text", "/find", "/grep"], "Search", "text"),
    ("/e", "e", "Find API endpoints and routes", ["/endpoints", "/endpoint", "/routes", "/api"], "Search", "endpoints"),
    ("/o", "o", "Search in currently open files", ["/open", "/opened"], "Navigation", "open"),
    ("/m", "m", "Search in modified or untracked files", ["/modified", "/mod", "/git", "/changed"], "Files", "modified"),
    ("/p", "p", "Find properties and fields", ["/properties", "/prop", "/field"], "Search", "properties"),
    ("/cmd", "cmd", "Search and execute VS Code commands", ["/commands", "/action", "/run", ">"], "Actions", "commands"),
]
#: Catalog rows up to which it is sent to the tasks.
BROADCAST_CATALOG = 1000
SLASH_DDL = "ord int, name string, short_name string, description string, aliases array<string>, category string, scope string"


def slash_commands(spark) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(SLASH_COMMANDS)], SLASH_DDL)


def command_items(ids: DataFrame) -> DataFrame:
    """Catalog rows of command ids; internal ones (leading `_`) are dropped."""
    title = id_to_title(F.col("command_id"))
    return ids.filter(~F.startswith(F.col("command_id"), F.lit("_"))).select(
        F.concat(F.lit("command:"), F.col("command_id")).alias("id"),
        title.alias("name"),
        F.lit("command").alias("type"),
        F.col("command_id").alias("detail"),
        F.concat(title, F.lit(" ("), F.col("command_id"), F.lit(")")).alias("full_name"),
        "command_id",
    )


def command_features(commands: DataFrame) -> DataFrame:
    """Folded title and id, and the mask of both together."""
    low = commands.withColumn("c_name", fold(F.col("name"))).withColumn("c_id", fold(F.col("command_id")))
    return low.withColumn("c_mask", mask_of_folded("c_name").bitwiseOR(mask_of_folded("c_id")))


def search_commands(context: DataFrame, commands: DataFrame, limit: int = 20) -> DataFrame:
    """Best of title and id score per query; `commands` carry a `seq`."""
    pairs = pair_by_mask(command_features(commands), context, "c_mask", "q_mask", F.lit(True))
    score = F.greatest(fuzzy_score("q_low", "q_chars", "c_name"), fuzzy_score("q_low", "q_chars", "c_id"))
    scored = keep_scored(pairs, score).withColumn("k", F.lit(limit))
    return top_k(scored, ["qid"], limit=limit)


def merge_commands(results: DataFrame, commands: DataFrame) -> DataFrame:
    """Append command hits for the scopes everything and commands, once.

    Everything is sorted again by score; for the other scope commands follow.
    """
    cols = ["qid", "q_scope", "seq", "id", "name", "type", "score", "rank"]
    extra = commands.filter(F.col("q_scope").isin("everything", "commands"))
    both = results.select(*cols).withColumn("late", F.lit(0)).unionByName(
        extra.select(*cols).withColumn("late", F.lit(1))
    )
    resort = F.col("q_scope") == "everything"
    w = Window.partitionBy("qid").orderBy(
        F.when(resort, -F.col("score")).otherwise(F.lit(0.0)),
        F.when(resort, F.lit(0)).otherwise(F.col("late")),
        F.when(resort, F.col("late")).otherwise(F.col("rank")),
        "seq",
    )
    return both.withColumn("rank", F.row_number().over(w))


def _slash_match(typed: str = "typed") -> str:
    """Condition: the typed text picks a command; an empty text picks all."""
    low = f"lower({typed})"
    bare = f"regexp_replace({low}, '^[/#>]', '')"
    return f"""({typed} = '' or startswith(name, {low})
      or exists(aliases, a -> startswith(lower(a), {low}))
      or contains(lower(description), {bare}) or startswith(lower(short_name), {bare}))"""


def suggest_commands(typed: DataFrame, commands: DataFrame, recent: DataFrame) -> DataFrame:
    """Ranked slash commands per typed text `(qid, typed)`.

    `recent(name, recent_pos)` is the usage list, newest first. Recent commands
    whose name or alias starts with the text come first, in usage order; the
    others follow: equal name, recent, prefix, name order. A name that repeats in
    `recent` counts at its first position. The catalog is sent to the tasks after a
    check of its size; beyond it, the planner chooses.
    """
    used = recent.groupBy("name").agg(F.min("recent_pos").alias("recent_pos"))
    catalog = commands.join(used, "name", "left")
    pairs = typed.join(F.broadcast(catalog) if fits(commands, BROADCAST_CATALOG) else catalog, F.expr(_slash_match()))
    low = F.lower("typed")
    starts = F.expr("startswith(lower(name), lower(typed)) or exists(aliases, a -> startswith(lower(a), lower(typed)))")
    flagged = F.col("recent_pos").isNotNull() & starts
    typed_empty = F.col("typed") == ""
    w = Window.partitionBy("qid").orderBy(
        F.when(flagged, 0).otherwise(1),
        F.when(flagged, F.col("recent_pos")),
        F.when(typed_empty, F.col("ord")).otherwise(F.lit(0)),
        F.when(F.col("name") == low, 0).otherwise(1),
        F.when(F.col("recent_pos").isNotNull(), 0).otherwise(1),
        F.when(F.startswith(F.col("name"), low), 0).otherwise(1),
        "name",
    )
    return pairs.select("qid", "typed", "name", "scope", flagged.alias("recent"), F.row_number().over(w).alias("rank"))


def resolve_alias(asked: DataFrame, commands: DataFrame) -> DataFrame:
    """Name or alias in any case `(qid, asked)` -> command."""
    names = commands.select(
        F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), F.transform("aliases", F.lower)))).alias("alias"),
        "name", "scope", "category",
    )
    return asked.join(names, F.lower("asked") == F.col("alias")).select("qid", "asked", "name", "scope", "category")


def commands_by_category(commands: DataFrame) -> DataFrame:
    """Unique commands in groups; groups and members keep their first order.

    Rows stay rows: a group is never gathered into one value.
    """
    unique = commands.groupBy("name").agg(F.min_by(F.struct("category", "scope"), "ord").alias("c"), F.min("ord").alias("ord"))
    groups = commands.groupBy("category").agg(F.min("ord").alias("group_ord"))
    return unique.select("name", "ord", "c.*").join(groups, "category").select("category", "group_ord", "name", "ord", "scope")


def recent_commands(commands: DataFrame, recent: DataFrame) -> DataFrame:
    """Usage list `(used, pos)` resolved to commands, first position kept."""
    hits = resolve_alias(recent.selectExpr("pos as qid", "used as asked"), commands)
    return hits.groupBy("name").agg(F.min("qid").alias("recent_pos"))
