"""Fast search: substring tiers, the first k hits in scope order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.index import filter_paths
from waymark.operators.pairing import count_slices, pair_by_substring
from waymark.operators.postings import GramIndex, candidates, gram_index
from waymark.operators.queries import about_queries, live, query_context
from waymark.operators.ranking import _in_scope, apply_target_line, blend_activity, search, within
from waymark.operators.routes import cut_keys, endpoint_hits, route_index
from waymark.schema import FAST_SCOPE_ORDER, boost_of
from waymark.session import cut, union_all

ROW = [
    "qid", "k", "q_scope", "target_line", "q_low", "seq", "id", "name", "type", "file_path",
    "line", "container", "full_name", "name_low", "scope", "score",
]


def tier_match(pairs: DataFrame) -> DataFrame:
    """Tier of a pair: name equal 1.0, prefix 0.9, inside 0.8; full name 0.1 less."""
    return pairs.withColumn(
        "tier",
        F.expr(
            """CASE WHEN name_low = q_low THEN 1.0D WHEN startswith(name_low, q_low) THEN 0.9D
            WHEN contains(name_low, q_low) THEN 0.8D
            WHEN full_low = q_low THEN 0.9D WHEN startswith(full_low, q_low) THEN 0.8D
            WHEN contains(full_low, q_low) THEN 0.7D ELSE 0.0D END"""
        ),
    )


def scope_rank():
    """Position of a scope in the fixed visiting order; the rest come last."""
    tests = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(FAST_SCOPE_ORDER, 1))
    last = len(FAST_SCOPE_ORDER) + 1
    return F.expr(f"CASE WHEN q_scope <> 'everything' THEN 0 ELSE CASE scope {tests} ELSE {last} END END")


def first_k_by_priority(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """The first k matches in scope and index order - not the best k."""
    w = Window.partitionBy("qid").orderBy("scope_rank", "seq")
    return (
        matches.withColumn("scope_rank", scope_rank())
        .withColumn("pos", F.row_number().over(w))
        .filter(within("pos", "k", limit))
    )


def name_grams(features: DataFrame) -> GramIndex:
    """The stored index over the names and full names of items, for batches of fast searches."""
    return gram_index(features, "seq", F.array("name_low", "full_low"))


def tier_pairs(context: DataFrame, features: DataFrame, condition=None, small: bool | None = None, found: DataFrame | None = None):
    """Matching (query, item) pairs of the substring tiers.

    `found(q_low, id)` holds the candidates of each text, where an index gave them.
    """
    asked = _in_scope() if condition is None else condition
    if found is None:
        pairs = pair_by_substring(features, context, ["name_low", "full_low"], "q_low", asked, small)
    else:
        pairs = features.join(found, F.col("seq") == F.col("id_")).join(context, "q_low").filter(asked)
    return tier_match(pairs).filter("tier > 0")


def add_routes(
    found: DataFrame, context: DataFrame, features: DataFrame, route_keys: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Fill up to k with endpoints that match the path; no verb gate, no boost. `limit`: the largest k, if known."""
    keys = route_index(features.filter("scope = 'endpoints'")) if route_keys is None else route_keys
    if limit is not None:
        # Up to `limit` of a key may be found already.
        keys = cut_keys(keys, 2 * limit, F.asc("seq"))
    hits = endpoint_hits(context.filter("is_url"), keys, gate=False)
    fresh = hits.join(found.select("qid", "seq"), ["qid", "seq"], "left_anti")
    w = Window.partitionBy("qid").orderBy("seq")
    fresh = fresh.withColumn("n", F.row_number().over(w)).filter(within("n", "k", limit)).drop("n")
    items = features.filter("scope = 'endpoints'").select([c for c in ROW if c in features.columns])
    fresh = items.join(fresh, "seq")
    # Old rows keep their places, new ones follow in index order.
    both = found.select(*ROW).withColumn("late", F.lit(0)).unionByName(
        fresh.select(*ROW).withColumn("late", F.lit(1))
    )
    w = Window.partitionBy("qid").orderBy("late", "seq")
    return (
        both.withColumn("n", F.row_number().over(w))
        .filter((F.col("late") == 0) | (F.col("n") <= F.col("k")))
        .drop("n", "late")
    )


def fast_search(
    queries: DataFrame,
    features: DataFrame,
    activity: DataFrame | None = None,
    open_files: DataFrame | None = None,
    modified_files: DataFrame | None = None,
    route_keys: DataFrame | None = None,
    grams: GramIndex | None = None,
) -> DataFrame:
    """The whole fast search: tiers, first k, routes, usage, order by score.

    With `grams` (see `name_grams`, over the same items) candidates come from posting
    lists, so any number of queries reads the items once.
    """
    context = live(query_context(queries, fast=True))
    found = None
    if grams is not None:
        context = cut(context, "context")
        found = candidates(context, grams).withColumnRenamed("id", "id_")
        features = grams.rows
    about = about_queries(context)
    small, limit = count_slices(about["n"], about["bytes"]) == 1, about["k"]
    arms = [tier_pairs(context, features, small=small, found=found)]
    for scope, paths in (("open", open_files), ("modified", modified_files)):
        if paths is not None and scope in about["sets"]:
            asked = context.filter(F.col("q_scope") == scope)
            arms.append(tier_pairs(asked, filter_paths(features, paths), F.lit(True), small, found))
    first = first_k_by_priority(union_all(arms), limit)
    # At most k rows per query are left; the rest works on these.
    results = cut(first.withColumn("score", F.col("tier") * boost_of(F.col("type"))).select(*ROW), "fast")
    if about["urls"]:
        results = cut(add_routes(results, context, features, route_keys, limit), "fast")
    if activity is not None:
        results = blend_activity(results, activity)
    results = apply_target_line(results)
    at = F.expr("instr(name_low, q_low) - 1")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("seq"))
    return results.withColumn("rank", F.row_number().over(w)).withColumn(
        "highlights",
        F.when(
            at >= 0,
            F.array(F.struct(at.alias("start"), (at + F.length("q_low")).alias("end"))),
        ),
    )


def staged_search(
    queries: DataFrame, features: DataFrame, activity: DataFrame | None = None, stages=(10, 30)
) -> DataFrame:
    """Fast results at growing counts, then the ranked search, labelled by stage.

    All fast stages run in one pass: a query becomes one row per stage.
    """
    wide = queries.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in stages])))
    asked = wide.select(F.struct("qid", "_k").alias("qid"), "query", "scope", F.col("_k").alias("max_results"))
    fast = fast_search(asked, features, activity)
    full = search(queries, features, activity)
    cols = ["id", "rank", "score"]
    return fast.select(F.col("qid._k").cast("string").alias("stage"), F.col("qid.qid").alias("qid"), *cols).unionByName(
        full.select(F.lit("full").alias("stage"), "qid", *cols)
    )
