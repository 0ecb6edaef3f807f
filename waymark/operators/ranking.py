"""Ranked search: scoring, top-k, activity blend, provider groups."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.fuzzy import fuzzy_score, match_positions, to_highlights
from waymark.operators.index import filter_paths
from waymark.operators.pairing import count_slices, pair_by_mask
from waymark.operators.queries import about_queries, live, query_context
from waymark.operators.routes import cut_keys, endpoint_hits, route_index
from waymark.schema import (
    ACTIVITY_FLOOR,
    ACTIVITY_WEIGHT,
    FULL_NAME_WEIGHT,
    MIN_SCORE,
    NAME_GOOD_ENOUGH,
    PATH_GATE,
    PATH_WEIGHT,
    boost_of,
)
from waymark.session import cut, union_all

# What a scored row carries through the cut.
CARRY = [
    "seq", "id", "name", "type", "file_path", "relative_path", "line", "col",
    "container", "full_name", "detail", "name_low", "name_mask", "scope",
]


def _in_scope() -> Column:
    return F.expr(
        "q_scope not in ('open', 'modified', 'text') and (q_scope = 'everything' or q_scope = scope)"
    )


def mask_prefilter(
    items: DataFrame, context: DataFrame, condition: Column | None = None, small: bool | None = None
) -> DataFrame:
    """Query x item pairs whose item holds every character class of the query."""
    return pair_by_mask(
        items, context, "item_mask", "q_mask",
        _in_scope() if condition is None else condition, small,
    )


def keep_scored(pairs: DataFrame, score: Column) -> DataFrame:
    """Add `score` and keep the pairs above the minimum.

    The score is emitted by a generator. A plain filter would be pushed into the
    join condition with the whole scoring expression copied into it.
    """
    kept = F.filter(F.array(score), lambda s: s > MIN_SCORE)
    return pairs.select("*", F.explode(kept).alias("score"))


def field_cascade(pairs: DataFrame) -> DataFrame:
    """Score a pair on name, then full name, then path, each only if needed."""

    def on(field: str, weight: float) -> Column:
        # A field that lacks a character class cannot match: skip its scan.
        holds = F.expr(f"{field}_mask & q_mask = q_mask")
        return F.when(holds, fuzzy_score("q_low", "q_chars", f"{field}_low") * weight)

    named = pairs.withColumn("_n", on("name", 1.0))
    name = F.expr(f"if(_n > {MIN_SCORE}, _n, -1.0D)")
    by_full = F.when(name < NAME_GOOD_ENOUGH, on("full", FULL_NAME_WEIGHT))
    best = named.withColumn("_b", F.greatest(name, by_full))
    by_path = F.when(F.col("_b") < PATH_GATE, on("path", PATH_WEIGHT))
    return keep_scored(best, F.greatest(F.col("_b"), by_path)).drop("_n", "_b")


def type_boost(scored: DataFrame) -> DataFrame:
    """Multiply scores (all above the minimum) by the boost of the item type."""
    return scored.withColumn("score", F.col("score") * boost_of(F.col("type")))


def within(position: str, k: str, limit: int | None) -> Column:
    """`position` <= `k`; a literal bound beside it lets each task cut its own rows before the shuffle."""
    fits = F.col(position) <= F.col(k)
    return fits if limit is None else (F.col(position) <= limit) & fits


def top_k(scored: DataFrame, keys: list[str], k: str = "k", limit: int | None = None) -> DataFrame:
    """Best `k` rows per key above the minimum score; ties go to the earlier item.

    `k` is a column; `limit`, where given, is the largest `k` of all.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("seq"))
    return (
        scored.filter(F.col("score") > MIN_SCORE)
        .withColumn("rank", F.row_number().over(w))
        .filter(within("rank", k, limit))
    )


def activity_lookup(results: DataFrame, activity: DataFrame, id_col: str = "id") -> DataFrame:
    """Add the activity score of each row's item, 0 when it has none."""
    scores = activity.select(F.col("item_id").alias("_aid"), F.col("score").alias("activity_score"))
    return (
        results.join(scores, F.col(id_col) == F.col("_aid"), "left")
        .withColumn("activity_score", F.coalesce("activity_score", F.lit(0.0)))
        .drop("_aid")
    )


def blend_activity(results: DataFrame, activity: DataFrame, weight: float = ACTIVITY_WEIGHT) -> DataFrame:
    """Mix usage into the scores of rows that already made the cut."""
    # The results are few and were written by now: the engine sees their size
    # and can send their ids to the activity table instead of shuffling it.
    used = activity.join(results.select("id").distinct(), F.col("item_id") == F.col("id"), "left_semi")
    mixed = activity_lookup(results, used)
    apply = (F.col("activity_score") > 0) & (F.col("score") > ACTIVITY_FLOOR)
    return mixed.withColumn(
        "score",
        F.when(apply, F.col("score") * (1 - weight) + F.col("activity_score") * weight).otherwise(F.col("score")),
    )


def rerank(results: DataFrame, keys: list[str], k: str | None = None) -> DataFrame:
    """Rank again after scores changed; optionally cut again."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("seq"))
    out = results.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= F.col(k))


ROW = ["qid", "k", "q_scope", "target_line", "q_low", "q_chars", "q_mask", "provider", *CARRY, "score"]


def merge_route_score(fuzzy: DataFrame, routes: DataFrame) -> DataFrame:
    """The route score replaces the fuzzy one of an endpoint where it is greater.

    Both sides arrive cut to k rows per query. That is exact: a row outside the
    k best of both sides cannot be among the k best of their maximum. A
    (query, item) group holds two rows at most.
    """
    both = fuzzy.select(*ROW).unionByName(routes.select(*ROW))
    rest = [c for c in ROW if c not in ("qid", "seq", "score")]
    return (
        both.groupBy("qid", "seq")
        .agg(F.max("score").alias("score"), F.first(F.struct(*rest)).alias("r"))
        .select("qid", "seq", "score", *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def with_highlights(results: DataFrame) -> DataFrame:
    """Highlight ranges of the name match, for the few rows that made the cut."""
    hit = F.expr("name_mask & q_mask = q_mask") & (fuzzy_score("q_low", "q_chars", "name_low") > MIN_SCORE)
    marked = results.withColumn("_p", F.when(hit, match_positions("q_low", "q_chars", "name_low")))
    return marked.withColumn("highlights", to_highlights("_p")).drop("_p")


def apply_target_line(results: DataFrame) -> DataFrame:
    """A `:NN` suffix of the query overrides the line of every result."""
    return results.withColumn("line", F.coalesce(F.col("target_line"), F.col("line")))


def score_items(
    context: DataFrame,
    items: DataFrame,
    condition: Column | None = None,
    provider: Column | None = None,
    routes: bool = True,
    small: bool | None = None,
    limit: int | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Best k rows per (query, provider): boosted fuzzy scores and route scores.

    Items are read in place; only the k best rows of each task are shuffled.
    `keys` is the stored route index of the endpoints among the items.
    """
    group = F.lit("all") if provider is None else provider
    fuzzy = type_boost(field_cascade(mask_prefilter(items, context, condition, small)))
    best = top_k(fuzzy.withColumn("provider", group), ["qid", "provider"], limit=limit)
    if not routes:
        return best.select(*ROW)
    keys = route_index(items.filter("scope = 'endpoints'")) if keys is None else keys
    if limit is not None:
        keys = cut_keys(keys, limit, F.desc("key_score"), F.asc("seq"))
    hits = endpoint_hits(context.filter("is_url"), keys).withColumn("type", F.lit("endpoint"))
    hits = top_k(hits.withColumn("provider", group).drop("type"), ["qid", "provider"], limit=limit)
    # The items of the few hits that are left.
    hits = items.filter("scope = 'endpoints'").select(*CARRY).join(hits, "seq")
    return top_k(merge_route_score(best, hits), ["qid", "provider"], limit=limit).select(*ROW)


Provider = Callable[[DataFrame, DataFrame], DataFrame]


class Providers:
    """Named result sources: functions of (query context, items) -> scored rows.

    A source returns rows as `score_items` does, at most k per query.
    """

    def __init__(self):
        self._sources: list[tuple[int, str, Provider]] = []

    def register(self, name: str, source: Provider, priority: int = 0) -> "Providers":
        self._sources.append((priority, name, source))
        return self

    def run(self, context: DataFrame, items: DataFrame) -> DataFrame:
        ordered = sorted(self._sources, key=lambda s: -s[0])
        frames = [
            source(context, items).withColumn("provider", F.lit(name)) for _, name, source in ordered
        ]
        return union_all(frames)


def file_source(context: DataFrame, items: DataFrame) -> DataFrame:
    """File rows, for the scopes everything and files."""
    wanted = context.filter(F.col("q_scope").isin("everything", "files"))
    return score_items(wanted, items.filter(F.col("scope") == "files"), routes=False)


def symbol_source(context: DataFrame, items: DataFrame) -> DataFrame:
    """All rows that are neither files nor text."""
    wanted = context.filter(~F.col("q_scope").isin("files", "text"))
    return score_items(wanted, items.filter(~F.col("scope").isin("files", "text")))


def merge_providers(results: DataFrame) -> DataFrame:
    """Merge per-source results: sort and cut to k per query."""
    return rerank(results, ["qid"], "k")


def search(
    queries: DataFrame,
    features: DataFrame,
    activity: DataFrame | None = None,
    open_files: DataFrame | None = None,
    modified_files: DataFrame | None = None,
    route_keys: DataFrame | None = None,
) -> DataFrame:
    """The whole ranked search over a feature table (see `item_features`).

    Files and the other items are cut to k separately, usage is blended into
    each group, the groups are merged and cut again. The scopes `open` and
    `modified` search the items of those files as one group.
    """
    context = live(query_context(queries))
    # One row about the query set decides which arms are worth planning.
    about = about_queries(context)
    small, limit = count_slices(about["n"], about["bytes"]) == 1, about["k"]
    # Both groups come from one pass over the items.
    group = F.when(F.col("type") == "file", "files").otherwise("symbols")
    found = features.filter(F.col("scope") != "text")
    if "everything" not in about["scopes"]:
        # Reaches the scan: row groups of other scopes are skipped.
        found = found.filter(F.col("scope").isin([*about["scopes"], *(["endpoints"] if about["urls"] else [])]))
    arms = [score_items(context, found, provider=group, routes=about["urls"], small=small, limit=limit, keys=route_keys)]
    for scope, paths in (("open", open_files), ("modified", modified_files)):
        if paths is not None and scope in about["sets"]:
            asked = context.filter(F.col("q_scope") == scope)
            of_files = filter_paths(features, paths)
            arms.append(score_items(asked, of_files, F.lit(True), F.lit(scope), False, small, limit))
    # At most k rows per query and group are left; the rest works on these.
    best = cut(union_all(arms), "search")
    if activity is not None:
        best = blend_activity(best, activity)
    merged = apply_target_line(merge_providers(best))
    return with_highlights(merged)
