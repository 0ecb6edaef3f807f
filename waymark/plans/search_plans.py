"""Queries on index features, ranked search and fast search."""

from pyspark.sql import functions as F

from waymark.functions.fuzzy import fuzzy_score, highlights_text
from waymark.functions.text import with_mask
from waymark.operators import activity as act
from waymark.operators import fast as fs
from waymark.operators import index as ix
from waymark.operators import ranking as rk
from waymark.operators.answers import answer
from waymark.operators.queries import live, query_context
from waymark.plans import tables as tb
from waymark.plans.registry import query
from waymark.plans.text_plans import DOCS_SQL, NEEDLES_SQL, documents, lines_sql
from waymark.schema import boost_of
from waymark.session import union_all

R6 = lambda c: F.round(F.col(c), 6)


# ------------------------------------------------------------- index features

@query("char_mask", f"SELECT p_partkey, {tb.mask_sql('p_name')} AS mask FROM part")
def char_mask_query(spark, sf):
    return with_mask(tb.load(spark, sf, "part"), F.col("p_name"), "mask").select("p_partkey", "mask")


@query("char_mask_text", f"SELECT doc_id, {tb.mask_sql('text')} AS mask FROM documents")
def char_mask_text(spark, sf):
    return with_mask(tb.load(spark, sf, "documents"), F.col("text"), "mask").select("doc_id", "mask")


@query(
    "item_features",
    f"""WITH {tb.FEATURES_SQL} SELECT id, scope, name_low, full_low, path_low,
    length(name)::INTEGER AS name_len, name_mask, item_mask FROM features""",
)
def item_features_query(spark, sf):
    return tb.features(spark, sf).select(
        "id", "scope", "name_low", "full_low", "path_low", "name_len", "name_mask", "item_mask"
    )


# --------------------------------------------------------------- ranked search

PAIRS_SQL = f"""{tb.FEATURES_SQL}, {tb.CONTEXT_SQL},
masked AS (SELECT * FROM context JOIN features ON (item_mask & q_mask) = q_mask
  AND q_scope NOT IN ('open','modified','text') AND (q_scope = 'everything' OR q_scope = scope))"""

CASCADE_TAIL = f"""s1 AS (SELECT *, coalesce(CASE WHEN (name_mask & q_mask) = q_mask
    THEN {tb.score_sql('q_low', 'q_chars', 'name_low')} END, -1) AS n0 FROM masked),
s2 AS (SELECT *, CASE WHEN n0 > 0.01 THEN n0 ELSE -1 END AS n FROM s1),
s3 AS (SELECT *, greatest(n, coalesce(CASE WHEN n < 0.9
    THEN {tb.score_sql('q_low', 'q_chars', 'full_low')} * 0.9 END, -1)) AS b FROM s2),
cascade AS (SELECT *, greatest(b, coalesce(CASE WHEN b < 0.8
    THEN {tb.score_sql('q_low', 'q_chars', 'path_low')} * 0.8 END, -1)) AS raw_score FROM s3),
boosted AS (SELECT *, CASE WHEN raw_score > 0.01 THEN raw_score * {tb.BOOST_SQL} ELSE raw_score END AS score FROM cascade)"""


@query("mask_prefilter", f"WITH {PAIRS_SQL} SELECT qid, id FROM masked")
def mask_prefilter_query(spark, sf):
    context = live(query_context(tb.queries(spark)))
    return rk.mask_prefilter(tb.index(spark, sf), context).select("qid", "id")


@query(
    "fuzzy_match",
    f"""WITH {PAIRS_SQL}, f AS (SELECT qid, id, {tb.score_sql('q_low', 'q_chars', 'name_low')} AS s FROM masked)
    SELECT qid, id, round(s, 6) AS score FROM f WHERE s IS NOT NULL""",
)
def fuzzy_match_query(spark, sf):
    context = live(query_context(tb.queries(spark)))
    pairs = rk.mask_prefilter(tb.index(spark, sf), context)
    score = fuzzy_score("q_low", "q_chars", "name_low")
    return pairs.select("qid", "id", F.round(score, 6).alias("score")).filter("score is not null")


@query(
    "field_cascade",
    f"WITH {PAIRS_SQL}, {CASCADE_TAIL} SELECT qid, id, round(raw_score, 6) AS score FROM cascade WHERE raw_score > 0.01",
)
def field_cascade_query(spark, sf):
    context = live(query_context(tb.queries(spark)))
    pairs = rk.field_cascade(rk.mask_prefilter(tb.index(spark, sf), context))
    return pairs.filter("score > 0.01").select("qid", "id", R6("score").alias("score"))


@query(
    "type_boost",
    f"WITH {PAIRS_SQL}, {CASCADE_TAIL} SELECT qid, id, type, round(score, 6) AS score FROM boosted WHERE score > 0.01",
)
def type_boost_query(spark, sf):
    context = live(query_context(tb.queries(spark)))
    scored = rk.type_boost(rk.field_cascade(rk.mask_prefilter(tb.index(spark, sf), context)))
    return scored.filter("score > 0.01").select("qid", "id", "type", R6("score").alias("score"))


@query(
    "top_k",
    f"""WITH {PAIRS_SQL}, {CASCADE_TAIL}, r AS (SELECT qid, id, k, score,
      row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM boosted WHERE score > 0.01)
    SELECT qid, id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= k""",
)
def top_k_query(spark, sf):
    context = live(query_context(tb.queries(spark)))
    scored = rk.type_boost(rk.field_cascade(rk.mask_prefilter(tb.index(spark, sf), context)))
    return rk.top_k(scored, ["qid"]).select("qid", "id", "rank", R6("score").alias("score"))


# Usage of items as of the latest event.
ACTIVITY_SQL = """acc AS (SELECT 'part:'||user_id AS item_id, max(ts) AS last_accessed, count(*) AS access_count
    FROM events GROUP BY 1),
activity AS (SELECT item_id, last_accessed, access_count,
    0.6::DOUBLE / (1 + date_diff('microsecond', last_accessed, (SELECT max(ts) FROM events)) / 86400000000.0::DOUBLE)
    + 0.4::DOUBLE * access_count / (SELECT greatest(max(access_count), 1) FROM acc) AS score FROM acc)"""


def score_activity(spark, sf):
    return act.activity_score(act.access_counts(tb.accesses(spark, sf)), tb.as_of(spark, sf))


def activity_table(spark, sf):
    """The saved activity snapshot, as searches read it."""
    return tb.stored(spark, sf, "activity", score_activity)


OPEN_SQL = """open_files AS (SELECT file_path FROM doc_paths WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
modified_files AS (SELECT file_path FROM doc_paths WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""

ROUTE_FOR_QUERIES = tb.route_score_sql(
    "(SELECT qid, q_verb, q_path AS p_path FROM context WHERE is_url)", "qid, q_verb",
    "(SELECT * FROM features WHERE type = 'endpoint')", "seq", "name",
)
GATED_SQL = """gated AS (SELECT qid, t_seq, route_score + CASE WHEN q_verb IS NULL OR t_verb IS NULL THEN 0.0 ELSE 0.5 END AS route_score
    FROM route WHERE route_score > 0 AND (q_verb IS NULL OR t_verb IS NULL OR starts_with(t_verb, q_verb)
      OR starts_with(q_verb, t_verb)))"""

SEARCH_SQL = f"""{tb.FEATURES_SQL}, {tb.CONTEXT_SQL}, {OPEN_SQL}, {ACTIVITY_SQL},
masked AS (
  SELECT *, CASE WHEN q_scope IN ('open','modified') THEN q_scope WHEN type = 'file' THEN 'files' ELSE 'symbols' END AS grp
  FROM context JOIN features ON
    ((q_scope = 'open' AND file_path IN (SELECT file_path FROM open_files))
    OR (q_scope = 'modified' AND file_path IN (SELECT file_path FROM modified_files))
    OR q_scope = 'everything' OR q_scope = scope)
  WHERE (item_mask & q_mask) = q_mask OR (is_url AND type = 'endpoint')),
{CASCADE_TAIL.replace('CASE WHEN (name_mask', "CASE WHEN (item_mask & q_mask) = q_mask AND (name_mask")
 .replace("CASE WHEN n < 0.9", "CASE WHEN n < 0.9 AND (item_mask & q_mask) = q_mask")
 .replace("CASE WHEN b < 0.8", "CASE WHEN b < 0.8 AND (item_mask & q_mask) = q_mask")},
{ROUTE_FOR_QUERIES}, {GATED_SQL},
scored AS (SELECT b.* EXCLUDE (score), greatest(b.score, coalesce(g.route_score, -1)) AS score
  FROM boosted b LEFT JOIN gated g ON b.qid = g.qid AND b.seq = g.t_seq),
cut AS (SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY score DESC, seq) AS r FROM scored WHERE score > 0.01),
blended AS (SELECT c.* EXCLUDE (score), CASE WHEN a.score > 0 AND c.score > 0.05 THEN c.score * 0.7::DOUBLE + a.score * 0.3::DOUBLE
  ELSE c.score END AS score, c.score AS base_score FROM cut c LEFT JOIN activity a ON c.id = a.item_id WHERE r <= k),
final AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM blended)"""

def search_frame(spark, sf):
    return rk.search(
        tb.queries(spark), tb.index(spark, sf), activity_table(spark, sf),
        tb.open_files(spark, sf), tb.modified_files(spark, sf), tb.route_keys(spark, sf),
    )


@query(
    "search",
    f"""WITH {SEARCH_SQL} SELECT qid, rank::INTEGER AS rank, id, scope, coalesce(target_line, line) AS line,
    round(score, 6) AS score FROM final WHERE rank <= k""",
)
def search_query(spark, sf):
    return search_frame(spark, sf).select("qid", "rank", "id", "scope", "line", R6("score").alias("score"))


@query(
    "search_everything",
    f"WITH {SEARCH_SQL} SELECT qid, id, rank::INTEGER AS rank, round(score, 6) AS score FROM final WHERE rank <= k AND q_scope = 'everything'",
)
def search_everything(spark, sf):
    q = tb.queries(spark).filter("scope = 'everything'")
    out = rk.search(q, tb.index(spark, sf), activity_table(spark, sf))
    return out.select("qid", "id", "rank", R6("score").alias("score"))


# Ranges of the matched positions, found again with a lazy expression.
HIGHLIGHT_SQL = """h0 AS (SELECT qid, id, name_low, q_low, q_chars FROM final WHERE rank <= k
  AND (name_mask & q_mask) = q_mask AND {score} > 0.01),
h1 AS (SELECT *, CASE WHEN contains(name_low, q_low)
    THEN range(instr(name_low, q_low) - 1, instr(name_low, q_low) - 1 + length(q_low))
    ELSE list_transform(range(1, len(q_chars) + 1), lambda i: length(regexp_extract(name_low,
      '(?s)^.*?' || array_to_string(list_transform(q_chars[1:i], lambda ch: '\\Q' || ch || '\\E'), '.*?'))) - 1) END AS ps
  FROM h0),
h2 AS (SELECT qid, id, unnest(ps) AS p FROM h1),
h3 AS (SELECT qid, id, p, p - row_number() OVER (PARTITION BY qid, id ORDER BY p) AS island FROM h2),
h4 AS (SELECT qid, id, min(p) AS a, max(p) + 1 AS b FROM h3 GROUP BY qid, id, island)
SELECT qid, id, string_agg(a || '-' || b, ',' ORDER BY a) AS highlights FROM h4 GROUP BY qid, id""".replace(
    "{score}", tb.score_sql("q_low", "q_chars", "name_low")
)


@query("to_highlights", f"WITH {SEARCH_SQL}, {HIGHLIGHT_SQL}")
def highlights_query(spark, sf):
    found = search_frame(spark, sf).filter("highlights is not null")
    return found.select("qid", "id", highlights_text("highlights").alias("highlights"))


@query(
    "merge_route_score",
    f"""WITH {SEARCH_SQL} SELECT qid, id, round(base_score, 6) AS score FROM blended WHERE type = 'endpoint'
    AND q_scope = 'endpoints'""",
)
def merge_route_query(spark, sf):
    context = live(query_context(tb.queries(spark))).filter("q_scope = 'endpoints'")
    best = rk.score_items(context, tb.index(spark, sf))
    return best.select("qid", "id", R6("score").alias("score"))


@query(
    "blend_activity",
    f"""WITH {SEARCH_SQL} SELECT qid, id, round(base_score, 6) AS base_score, round(score, 6) AS score,
    row_number() OVER (PARTITION BY qid, grp ORDER BY score DESC, seq)::INTEGER AS rank FROM blended
    WHERE grp IN ('files', 'symbols')""",
)
def blend_query(spark, sf):
    context = live(query_context(tb.queries(spark)))
    group = F.when(F.col("type") == "file", "files").otherwise("symbols")
    best = rk.score_items(context, tb.index(spark, sf), provider=group).withColumn("base_score", F.col("score"))
    out = rk.rerank(rk.blend_activity(best, activity_table(spark, sf)), ["qid", "provider"])
    return out.select("qid", "id", R6("base_score").alias("base_score"), R6("score").alias("score"), "rank")


@query(
    "merge_providers",
    f"""WITH {SEARCH_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base_score DESC, seq) AS mr
      FROM blended WHERE grp IN ('files', 'symbols'))
    SELECT qid, id, grp AS provider, mr::INTEGER AS rank, round(base_score, 6) AS score FROM m WHERE mr <= k""",
)
def providers_query(spark, sf):
    context = live(query_context(tb.queries(spark)))
    sources = rk.Providers().register("files", rk.file_source, 200).register("symbols", rk.symbol_source, 100)
    merged = rk.merge_providers(sources.run(context, tb.index(spark, sf)))
    return merged.select("qid", "id", "provider", "rank", R6("score").alias("score"))


@query(
    "apply_target_line",
    f"WITH {SEARCH_SQL} SELECT qid, id, target_line AS line FROM final WHERE rank <= k AND target_line IS NOT NULL",
)
def target_line_query(spark, sf):
    q = tb.queries(spark).filter("query like '%:%'")
    return rk.search(q, tb.index(spark, sf), activity_table(spark, sf)).select("qid", "id", "line")


# --------------------------------------------------------- filters on item sets

@query(
    "filter_scope",
    f"WITH {tb.FEATURES_SQL} SELECT scope, id FROM features WHERE scope IN ('types', 'symbols')",
)
def filter_scope_query(spark, sf):
    f = tb.index(spark, sf)
    out = ix.filter_scope(f, "types").unionByName(ix.filter_scope(f, "symbols"))
    return out.select("scope", "id")


@query(
    "scope_of",
    f"WITH {tb.FEATURES_SQL} SELECT type, scope, count(*) AS n FROM features GROUP BY 1, 2",
)
def scope_of_query(spark, sf):
    return tb.index(spark, sf).groupBy("type", "scope").agg(F.count("*").alias("n"))


@query(
    "filter_open",
    f"WITH {tb.ITEMS_SQL}, {OPEN_SQL} SELECT id FROM items WHERE file_path IN (SELECT file_path FROM open_files)",
)
def filter_open_query(spark, sf):
    return ix.filter_paths(tb.items(spark, sf), tb.open_files(spark, sf)).select("id")


@query(
    "filter_modified",
    f"WITH {tb.ITEMS_SQL}, {OPEN_SQL} SELECT id FROM items WHERE file_path IN (SELECT file_path FROM modified_files)",
)
def filter_modified_query(spark, sf):
    return ix.filter_paths(tb.items(spark, sf), tb.modified_files(spark, sf)).select("id")


@query(
    "remove_by_files",
    f"WITH {tb.ITEMS_SQL}, {OPEN_SQL} SELECT id FROM items WHERE file_path NOT IN (SELECT file_path FROM modified_files)",
)
def remove_by_files_query(spark, sf):
    return ix.remove_by_files(tb.items(spark, sf), tb.modified_files(spark, sf)).select("id")


@query(
    "resolve_items",
    """WITH r AS (SELECT l_orderkey AS req_id, l_linenumber - 1 AS pos, 'part:'||l_partkey AS id FROM lineitem)
    SELECT req_id, pos::INTEGER AS pos, id, p_name AS name, 1.0::DOUBLE AS score
    FROM r JOIN part ON id = 'part:'||p_partkey""",
)
def resolve_items_query(spark, sf):
    # One request per order: the ids of its lines, in line order.
    lines = tb.load(spark, sf, "lineitem").selectExpr(
        "l_orderkey as req_id", "l_linenumber as n", "concat('part:', l_partkey) as id"
    )
    asked = lines.select("req_id", F.array("id").alias("ids"), "n")
    found = ix.resolve_items(asked.select(F.struct("req_id", "n").alias("req_id"), "ids"), tb.part_items(spark, sf))
    return found.select(
        F.col("req_id.req_id").alias("req_id"), (F.col("req_id.n") - 1 + F.col("pos")).alias("pos"), "id", "name", "score"
    )


@query(
    "dedupe_files",
    """WITH d AS (SELECT md5(text) AS p, doc_id FROM documents)
    SELECT '/' || p AS norm_path, min(doc_id) AS listed_at, max(doc_id) AS seq, count(*) AS copies FROM d GROUP BY p""",
)
def dedupe_query(spark, sf):
    # Documents of equal content stand in for repeated listings of one path.
    docs = tb.load(spark, sf, "documents").selectExpr(
        "doc_id as seq", "concat('/./', md5(text)) as file_path", "lang"
    )
    return ix.dedupe_files(docs).select("norm_path", "listed_at", "seq", "copies")


@query(
    "index_stats",
    f"""WITH {tb.ITEMS_SQL} SELECT count(*) AS total_items, count(*) FILTER (type = 'file') AS total_files,
    count(*) FILTER (type IN ('class','interface','enum')) AS total_types,
    count(*) FILTER (type IN ('method','function','property')) AS total_symbols FROM items""",
)
def index_stats_query(spark, sf):
    return ix.index_stats(tb.items(spark, sf))


@query(
    "index_is_empty",
    f"WITH {tb.ITEMS_SQL} SELECT count(*) = 0 AND count(*) FILTER (type = 'file') = 0 AS is_empty FROM items",
)
def index_is_empty_query(spark, sf):
    return ix.index_is_empty(ix.index_stats(tb.items(spark, sf)))


# ----------------------------------------------------------------- fast search

TIER_SQL = """tiered AS (SELECT *, CASE WHEN name_low = q_low THEN 1.0::DOUBLE WHEN starts_with(name_low, q_low) THEN 0.9
    WHEN contains(name_low, q_low) THEN 0.8 WHEN full_low = q_low THEN 0.9 WHEN starts_with(full_low, q_low) THEN 0.8
    WHEN contains(full_low, q_low) THEN 0.7 ELSE 0.0 END AS tier
  FROM context JOIN features ON (item_mask & q_mask) = q_mask
    AND ((q_scope = 'open' AND file_path IN (SELECT file_path FROM open_files))
    OR (q_scope = 'modified' AND file_path IN (SELECT file_path FROM modified_files))
    OR q_scope = 'everything' OR q_scope = scope))"""
FIRST_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN q_scope <> 'everything' THEN 0
    ELSE CASE scope WHEN 'types' THEN 1 WHEN 'symbols' THEN 2 WHEN 'endpoints' THEN 3 WHEN 'files' THEN 4 ELSE 5 END END, seq) AS pos
  FROM tiered WHERE tier > 0), first AS (SELECT * FROM ranked WHERE pos <= k)"""
FAST_SQL = f"""{tb.FEATURES_SQL}, {tb.CONTEXT_SQL}, {OPEN_SQL}, {ACTIVITY_SQL}, {TIER_SQL}, {FIRST_SQL},
{ROUTE_FOR_QUERIES},
late AS (SELECT r.qid, f.id, f.seq, f.type, f.line, r.route_score AS score FROM route r JOIN features f ON f.seq = r.t_seq
  WHERE r.route_score > 0 AND NOT EXISTS (SELECT 1 FROM first x WHERE x.qid = r.qid AND x.id = f.id)),
used AS (SELECT qid, count(*) AS n FROM first GROUP BY 1),
late2 AS (SELECT l.*, row_number() OVER (PARTITION BY l.qid ORDER BY seq) + coalesce(u.n, 0) AS n, c.k, c.target_line
  FROM late l LEFT JOIN used u ON l.qid = u.qid JOIN context c ON l.qid = c.qid),
both_arms AS (SELECT qid, id, seq, coalesce(target_line, line) AS line, tier * {tb.BOOST_SQL} AS score FROM first
  UNION ALL SELECT qid, id, seq, coalesce(target_line, line), score FROM late2 WHERE n <= k),
fast AS (SELECT b.* EXCLUDE (score), b.score AS base_score, CASE WHEN a.score > 0 AND b.score > 0.05
  THEN b.score * 0.7::DOUBLE + a.score * 0.3::DOUBLE ELSE b.score END AS score
  FROM both_arms b LEFT JOIN activity a ON b.id = a.item_id)"""


@query(
    "tier_match",
    f"WITH {tb.FEATURES_SQL}, {tb.CONTEXT_SQL}, {OPEN_SQL}, {TIER_SQL} SELECT qid, id, tier FROM tiered WHERE tier > 0 AND q_scope NOT IN ('open','modified')",
)
def tier_query(spark, sf):
    context = live(query_context(tb.queries(spark)))
    return fs.tier_pairs(context, tb.index(spark, sf)).select("qid", "id", "tier")


@query(
    "first_k_by_priority",
    f"""WITH {tb.FEATURES_SQL}, {tb.CONTEXT_SQL}, {OPEN_SQL}, {TIER_SQL}, {FIRST_SQL}
    SELECT qid, id, pos::INTEGER AS pos, tier FROM first WHERE q_scope NOT IN ('open','modified')""",
)
def first_k_query(spark, sf):
    context = live(query_context(tb.queries(spark)))
    return fs.first_k_by_priority(fs.tier_pairs(context, tb.index(spark, sf))).select("qid", "id", "pos", "tier")


def fast_frame(spark, sf):
    return fs.fast_search(
        tb.queries(spark), tb.index(spark, sf), activity_table(spark, sf),
        tb.open_files(spark, sf), tb.modified_files(spark, sf), tb.route_keys(spark, sf),
    )


@query(
    "burst_search",
    f"""WITH {FAST_SQL} SELECT qid, id, line, round(score, 6) AS score,
    row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq)::INTEGER AS rank FROM fast""",
)
def fast_search_query(spark, sf):
    return fast_frame(spark, sf).select("qid", "id", "line", R6("score").alias("score"), "rank")


BURST_BATCH_SQL = """q AS (SELECT DISTINCT substr(p_name, 1, 4) AS t FROM part UNION SELECT DISTINCT substr(p_name, -3) FROM part
    UNION SELECT DISTINCT lower(p_brand) FROM part UNION SELECT DISTINCT left(CAST(p_partkey AS VARCHAR), 2) FROM part)"""


def burst_batch(spark, sf):
    """Pieces of names, brands and numbers of the data as queries of a fast search for five results."""
    part = tb.load(spark, sf, "part")
    texts = [part.selectExpr(f"{e} as t") for e in ("substr(p_name, 1, 4)", "substr(p_name, -3)", "lower(p_brand)", "left(cast(p_partkey as string), 2)")]
    return union_all(texts).distinct().selectExpr("t as qid", "t as query", "'everything' as scope", "5 as max_results")


@query(
    "burst_postings",
    f"""WITH {tb.FEATURES_SQL}, {BURST_BATCH_SQL}, qs AS (SELECT t AS qid, {tb.fold_sql("trim(t)")} AS q FROM q WHERE trim(t) <> '' AND NOT contains(t, '/')),
    tiers AS (SELECT qid, seq, id, CASE WHEN name_low = q THEN 1.0 WHEN starts_with(name_low, q) THEN 0.9 WHEN contains(name_low, q) THEN 0.8
      WHEN full_low = q THEN 0.9 WHEN starts_with(full_low, q) THEN 0.8 WHEN contains(full_low, q) THEN 0.7 END::DOUBLE AS tier,
      {tb.BOOST_SQL} AS boost, CASE scope WHEN 'types' THEN 1 WHEN 'symbols' THEN 2 WHEN 'endpoints' THEN 3 WHEN 'files' THEN 4 ELSE 5 END AS visit
      FROM qs JOIN features ON scope <> 'text' AND (contains(name_low, q) OR contains(full_low, q))),
    first AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY visit, seq) AS pos FROM tiers)
    SELECT qid, id, round(tier * boost, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY tier * boost DESC, seq)::INTEGER AS rank
    FROM first WHERE pos <= 5""",
)
def burst_postings_query(spark, sf):
    asked = burst_batch(spark, sf).filter("not contains(query, '/')")
    out = fs.fast_search(asked, tb.index(spark, sf), grams=tb.name_grams(spark, sf))
    return out.select("qid", "id", R6("score").alias("score"), "rank")


@query(
    "burst_routes",
    f"WITH {FAST_SQL} SELECT qid, id, round(base_score, 6) AS score FROM fast WHERE qid IN (SELECT qid FROM context WHERE is_url)",
)
def fast_routes_query(spark, sf):
    context = live(query_context(tb.queries(spark), fast=True)).filter("is_url")
    f = tb.index(spark, sf)
    first = fs.first_k_by_priority(fs.tier_pairs(context, f))
    found = first.withColumn("score", F.col("tier") * boost_of(F.col("type")))
    return fs.add_routes(found, context, f).select("qid", "id", R6("score").alias("score"))


@query(
    "burst_blend",
    f"""WITH {FAST_SQL} SELECT qid, id, round(base_score, 6) AS base_score, round(score, 6) AS score FROM fast
    WHERE base_score <> score""",
)
def fast_blend_query(spark, sf):
    plain = fs.fast_search(tb.queries(spark), tb.index(spark, sf), None, tb.open_files(spark, sf),
                           tb.modified_files(spark, sf)).withColumn("base_score", F.col("score"))
    out = rk.blend_activity(plain, activity_table(spark, sf)).filter("base_score <> score")
    return out.select("qid", "id", R6("base_score").alias("base_score"), R6("score").alias("score"))


STAGED = [(i * 100 + k, q, s, k) for i, q, s, _ in tb.QUERIES for k in (10, 30) if s not in ("open", "modified")]
STAGED_SQL = FAST_SQL.replace(
    tb.QUERIES_SQL,
    "queries(qid, query, scope, max_results) AS (VALUES "
    + ", ".join(f"({i}, '{q}', '{s}', {k})" for i, q, s, k in STAGED) + ")",
)


@query(
    "staged_results",
    f"""WITH s AS (WITH {STAGED_SQL} SELECT (qid % 100)::VARCHAR AS stage, qid // 100 AS qid, id, score,
      row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq)::INTEGER AS rank FROM fast),
    f AS (WITH {SEARCH_SQL} SELECT 'full' AS stage, qid, id, score, rank::INTEGER AS rank FROM final
      WHERE rank <= k AND q_scope NOT IN ('open', 'modified'))
    SELECT stage, qid::INTEGER AS qid, id, rank, round(score, 6) AS score FROM s UNION ALL
    SELECT stage, qid::INTEGER, id, rank, round(score, 6) FROM f""",
)
def staged_query(spark, sf):
    q = tb.queries(spark).filter("scope not in ('open', 'modified')")
    out = fs.staged_search(q, tb.index(spark, sf), activity_table(spark, sf))
    return out.select("stage", "qid", "id", "rank", R6("score").alias("score"))


def _asked_sql(rows):
    return "queries(qid, query, scope, max_results) AS (VALUES " + ", ".join(f"({i}, '{q}', '{s}', {k})" for i, q, s, k in rows) + ")"


ALL_KINDS = [*tb.QUERIES, (16, "license", "text", 50), (17, "The ", "text", 25), (18, " ", "modified", 5), (19, "", "files", 3)]
ALL_SQL = SEARCH_SQL.replace(tb.QUERIES_SQL, _asked_sql([q for q in ALL_KINDS if q[2] != "text"]))
TEXT_KINDS = "needles(qid, query, k) AS (VALUES " + ", ".join(f"({i}, '{q}', {k})" for i, q, s, k in ALL_KINDS if s == "text") + ")"
ALL_KINDS_SQL = f"""WITH s AS (WITH {ALL_SQL} SELECT qid, 'ranked' AS kind, rank::INTEGER AS rank, id, round(score, 6) AS score FROM final
    WHERE rank <= k),
t AS (WITH {lines_sql(DOCS_SQL).replace(NEEDLES_SQL, TEXT_KINDS)}, {OPEN_SQL.replace("doc_paths", "(SELECT doc_id, file_path FROM (SELECT seq AS doc_id, file_path FROM docs)) p")},
    p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY file_path IN (SELECT file_path FROM open_files) DESC, seq, line) AS pos FROM hits)
    SELECT qid, 'text' AS kind, pos::INTEGER AS rank, 'text:'||file_path||':'||line||':'||col AS id, 1.0::DOUBLE AS score FROM p WHERE pos <= k),
b AS (WITH {tb.ITEMS_SQL}, {ACTIVITY_SQL}, {_asked_sql(ALL_KINDS)},
    m AS (SELECT '/'||source||'/'||lang||'/'||doc_id||'.txt' AS file_path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    r AS (SELECT id, file_path, last_accessed, item_id FROM activity JOIN items ON id = item_id),
    n AS (SELECT qid, id, max_results, row_number() OVER (PARTITION BY qid ORDER BY last_accessed DESC, item_id) AS n FROM queries JOIN r
      ON scope <> 'modified' OR file_path IN (SELECT file_path FROM m) WHERE trim(query) = '')
    SELECT qid, 'recent' AS kind, n::INTEGER AS rank, id, 2.0::DOUBLE AS score FROM n WHERE n <= max_results)
SELECT * FROM s UNION ALL SELECT * FROM t UNION ALL SELECT * FROM b"""


@query("search_all_kinds", ALL_KINDS_SQL)
def all_kinds_query(spark, sf):
    asked = spark.createDataFrame(ALL_KINDS, tb.QUERIES_DDL)
    out = answer(
        asked, tb.index(spark, sf), activity_table(spark, sf), tb.as_of(spark, sf), documents(spark, sf),
        tb.open_files(spark, sf), tb.modified_files(spark, sf), tb.route_keys(spark, sf),
    )
    return out.select("qid", "kind", "rank", "id", R6("score").alias("score"))


LARGE = [(1, "ri", "everything", 1400), (2, "txt", "files", 1400)]


@query(
    "top_k_large",
    f"""WITH {SEARCH_SQL.replace(tb.QUERIES_SQL, _asked_sql(LARGE))} SELECT qid, rank::INTEGER AS rank, id, round(score, 6) AS score
    FROM final WHERE rank <= k""",
)
def top_k_large_query(spark, sf):
    out = rk.search(spark.createDataFrame(LARGE, tb.QUERIES_DDL), tb.index(spark, sf), activity_table(spark, sf))
    return out.select("qid", "rank", "id", R6("score").alias("score"))
