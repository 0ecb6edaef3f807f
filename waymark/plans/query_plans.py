"""Queries on query preparation, commands and shown results."""

from pyspark.sql import functions as F

from waymark.functions.routes import is_potential_url
from waymark.functions.text import clamp_or_default, id_to_title
from waymark.operators import commands as cm
from waymark.operators import queries as qp
from waymark.operators import ranking as rk
from waymark.operators import results as rs
from waymark.plans import tables as tb
from waymark.plans.registry import query
from waymark.plans.search_plans import SEARCH_SQL, search_frame

R6 = lambda c: F.round(F.col(c), 6)


# ----------------------------------------------------------- query preparation

# Typed queries made from part rows: a prefix by type, a suffix by size.
TYPED = """concat(CASE p_type WHEN 'ECONOMY' THEN '/t ' WHEN 'STANDARD' THEN '/TXT ' WHEN 'PROMO' THEN '#'
  WHEN 'MEDIUM' THEN '/git ' WHEN 'SMALL' THEN '>' ELSE '/t' END, p_name)"""
PREFIX_SQL = "CASE " + " ".join(
    f"WHEN starts_with(lower(typed), '{p}') THEN '{{}}'".replace("{}", s) for p, s in qp.SCOPE_PREFIXES
) + " END"
REST_SQL = "CASE " + " ".join(
    f"WHEN starts_with(lower(typed), '{p}') THEN substr(typed, {len(p) + 1})" for p, _ in qp.SCOPE_PREFIXES
) + " ELSE typed END"


@query(
    "parse_scope_prefix",
    f"WITH t AS (SELECT p_partkey, {TYPED} AS typed FROM part) SELECT p_partkey, {PREFIX_SQL} AS scope, {REST_SQL} AS text FROM t",
)
def scope_prefix_query(spark, sf):
    typed = tb.load(spark, sf, "part").selectExpr("p_partkey", f"{TYPED} as typed")
    scope, text = qp.parse_scope_prefix(F.col("typed"))
    return typed.select("p_partkey", scope.alias("scope"), text.alias("text"))


SUFFIXED = "concat(p_name, if(p_type = 'LARGE', '', concat(':', p_size - 1)))"


@query(
    "parse_line_suffix",
    """WITH t AS (SELECT p_partkey, p_name || CASE WHEN p_type = 'LARGE' THEN '' ELSE ':' || (p_size - 1) END AS q, p_name, p_type, p_size FROM part)
    SELECT p_partkey, p_name AS text, CASE WHEN p_type <> 'LARGE' AND p_size - 1 > 0 THEN p_size - 2 END::INTEGER AS target_line FROM t""",
)
def line_suffix_query(spark, sf):
    typed = tb.load(spark, sf, "part").selectExpr("p_partkey", f"{SUFFIXED} as typed")
    text, line = qp.parse_line_suffix(F.col("typed"))
    return typed.select("p_partkey", text.alias("text"), line.alias("target_line"))


@query(
    "query_context",
    f"""WITH queries AS (SELECT p_partkey AS qid, ' ' || p_name || CASE WHEN p_type = 'LARGE' THEN '' ELSE ':' || (p_size - 1) END AS query,
      CASE WHEN p_type = 'LARGE' THEN 'everything' ELSE 'types' END AS scope, CASE WHEN p_size > 25 THEN p_size END AS max_results FROM part),
    c AS (SELECT qid, scope AS q_scope, coalesce(max_results, 20)::INTEGER AS k, regexp_replace(trim(query), ':[0-9]+$', '') AS q_text FROM queries)
    SELECT qid, q_scope, k, q_text, {tb.fold_sql('q_text')} AS q_low, {tb.mask_sql('q_text')} AS q_mask,
      {tb.potential_url_sql('q_text')} AND q_scope IN ('everything', 'endpoints') AS is_url FROM c""",
)
def context_query(spark, sf):
    asked = tb.load(spark, sf, "part").selectExpr(
        "p_partkey as qid", f"concat(' ', {SUFFIXED}) as query", "if(p_type = 'LARGE', 'everything', 'types') as scope",
        "if(p_size > 25, p_size, null) as max_results",
    )
    return qp.query_context(asked).select("qid", "q_scope", "k", "q_text", "q_low", "q_mask", "is_url")


URL_FORMS = """CASE WHEN url LIKE '%#%' THEN {path} WHEN url LIKE '%?%' THEN 'get ' || {path}
  WHEN url LIKE '%.html' THEN 'FETCH ' || {path} ELSE substr({path}, 2, 2) END"""


@query(
    "is_potential_url",
    f"""WITH t AS (SELECT page_id, {URL_FORMS.format(path=tb.PATH_SQL)} AS q FROM pages)
    SELECT page_id, q, {tb.potential_url_sql('q')} AS is_url FROM t""",
)
def potential_url_query(spark, sf):
    forms = URL_FORMS.format(path=tb.URL_PATH)
    q = tb.load(spark, sf, "pages").selectExpr("page_id", f"{forms} as q")
    return q.select("page_id", "q", is_potential_url(F.col("q")).alias("is_url"))


@query(
    "clamp_or_default",
    """SELECT c_custkey, greatest(1.0, least(1000.0, c_acctbal))::DOUBLE AS from_number,
    CASE WHEN try_cast(substr(c_mktsegment || c_custkey, length(c_mktsegment) + 1 - c_nationkey % 2, 2) AS DOUBLE) IS NULL THEN 0.3
      ELSE greatest(0.0, least(9.0, try_cast(substr(c_mktsegment || c_custkey, length(c_mktsegment) + 1 - c_nationkey % 2, 2) AS DOUBLE))) END::DOUBLE AS from_text
    FROM customer""",
)
def clamp_query(spark, sf):
    c = tb.load(spark, sf, "customer").selectExpr(
        "c_custkey", "c_acctbal", "substr(concat(c_mktsegment, c_custkey), length(c_mktsegment) + 1 - c_nationkey % 2, 2) as t"
    )
    return c.select(
        "c_custkey",
        clamp_or_default(F.col("c_acctbal"), 1, 1000, 100).alias("from_number"),
        clamp_or_default(F.col("t"), 0, 9, 0.3).alias("from_text"),
    )


# -------------------------------------------------------------------- commands

COMMAND_IDS = """SELECT DISTINCT 'workbench.action.' || event_type || '.runAll' AS command_id FROM events
  UNION SELECT 'editor.action.' || lower(n_name) FROM nation UNION SELECT DISTINCT '_internal.' || event_type FROM events"""


def command_ids(spark, sf):
    e = tb.load(spark, sf, "events").selectExpr("event_type")
    n = tb.load(spark, sf, "nation").selectExpr("concat('editor.action.', lower(n_name)) as command_id")
    kinds = e.distinct()
    return (
        kinds.selectExpr("concat('workbench.action.', event_type, '.runAll') as command_id")
        .unionByName(n)
        .unionByName(kinds.selectExpr("concat('_internal.', event_type) as command_id"))
    )


COMMANDS_SQL = f"""ids AS ({COMMAND_IDS}),
commands AS (SELECT 'command:' || command_id AS id, CASE WHEN command_id LIKE 'workbench%'
    THEN upper(substr(split_part(command_id, '.', 3), 1, 1)) || substr(split_part(command_id, '.', 3), 2) || ' Run All'
    ELSE upper(substr(split_part(command_id, '.', 3), 1, 1)) || substr(split_part(command_id, '.', 3), 2) END AS name, command_id
  FROM ids WHERE NOT starts_with(command_id, '_'))"""


@query(
    "command_items",
    f"WITH {COMMANDS_SQL} SELECT id, name, 'command' AS type, command_id AS detail, name || ' (' || command_id || ')' AS full_name FROM commands",
)
def command_items_query(spark, sf):
    return cm.command_items(command_ids(spark, sf)).select("id", "name", "type", "detail", "full_name")


@query(
    "id_to_title",
    """SELECT event_id, 'App ' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' My URL Value' || event_id AS title FROM events""",
)
def id_to_title_query(spark, sf):
    e = tb.load(spark, sf, "events").selectExpr("event_id", "concat('vscode.app..', event_type, '.myURLValue', event_id, '.') as cid")
    return e.select("event_id", id_to_title(F.col("cid")).alias("title"))


# Distinct customer segments and event types make the typed command queries.
def typed_commands(spark, sf):
    e = tb.load(spark, sf, "events").select("event_type").distinct()
    asked = e.selectExpr("crc32(event_type) as qid", "substr(event_type, 2, 4) as query", "'everything' as scope", "cast(null as int) as max_results")
    n = tb.load(spark, sf, "nation").selectExpr(
        "cast(n_nationkey as bigint) as qid", "concat('nation ', n_nationkey) as query",
        "if(n_regionkey = 0, 'types', 'commands') as scope", "cast(null as int) as max_results",
    )
    return asked.unionByName(n)


def seq_commands(spark, sf):
    """Catalog rows with an order column (the hash of the id keeps it stable)."""
    return cm.command_items(command_ids(spark, sf)).withColumn("seq", F.conv(F.substring(F.md5("command_id"), 1, 8), 16, 10).cast("long"))


TYPED_COMMANDS_SQL = f"""{COMMANDS_SQL},
asked AS (SELECT DISTINCT event_type AS qkey, substr(event_type, 2, 4) AS q, 'everything' AS scope FROM events
  UNION ALL SELECT n_nationkey::VARCHAR, 'nation ' || n_nationkey, CASE WHEN n_regionkey = 0 THEN 'types' ELSE 'commands' END FROM nation),
qc AS (SELECT *, list_filter(str_split(q, ''), lambda ch: ch <> '' AND ch <> ' ') AS chars FROM asked),
cs AS (SELECT qkey, scope, id, command_id, greatest(coalesce({tb.score_sql('q', 'chars', 'lower(name)')}, -1),
  coalesce({tb.score_sql('q', 'chars', 'lower(command_id)')}, -1)) AS score FROM qc, commands),
chit AS (SELECT * FROM cs WHERE score > 0.01)"""


@query(
    "search_commands",
    f"""WITH {TYPED_COMMANDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY score DESC, ('0x' || substr(md5(command_id), 1, 8))::BIGINT) AS n FROM chit)
    SELECT qkey, id, round(score, 6) AS score FROM r WHERE n <= 20""",
)
def search_commands_query(spark, sf):
    asked = typed_commands(spark, sf)
    context = qp.live(qp.query_context(asked))
    found = cm.search_commands(context, seq_commands(spark, sf))
    keys = asked.selectExpr("qid as kq", "query as kquery").join(
        tb.load(spark, sf, "events").selectExpr("event_type", "crc32(event_type) as h").distinct(), F.col("kq") == F.col("h"), "left"
    ).selectExpr("kq", "coalesce(event_type, cast(kq as string)) as qkey")
    return found.join(keys, F.col("qid") == F.col("kq")).select("qkey", "id", R6("score").alias("score"))


@query(
    "merge_commands",
    f"""WITH {SEARCH_SQL}, {COMMANDS_SQL},
    cs AS (SELECT qid, q_scope, id, greatest(coalesce({tb.score_sql('q_low', 'q_chars', 'lower(name)')}, -1),
      coalesce({tb.score_sql('q_low', 'q_chars', 'lower(command_id)')}, -1)) AS score FROM context, commands
      WHERE q_scope IN ('everything', 'commands'))
    SELECT qid, id, round(score, 6) AS score FROM final WHERE rank <= k UNION ALL
    SELECT qid, id, round(score, 6) AS score FROM cs WHERE score > 0.01""",
)
def merge_commands_query(spark, sf):
    context = qp.live(qp.query_context(tb.queries(spark))).filter("q_scope in ('everything', 'commands')")
    found = cm.search_commands(context, seq_commands(spark, sf), limit=1000)
    return cm.merge_commands(search_frame(spark, sf), found).select("qid", "id", R6("score").alias("score"))


# Slash commands typed by users: one text per customer, from its segment.
SLASH_TYPED = "lower(concat(if(c_nationkey < 12, '/', ''), substr(c_mktsegment, 1, 1)))"
SLASH_SQL = "slash(ord, name, short_name, description, aliases, category, scope) AS (VALUES " + ", ".join(
    f"({i}, '{n}', '{s}', '{d}', {a!r}, '{c}', '{sc}')" for i, (n, s, d, a, c, sc) in enumerate(cm.SLASH_COMMANDS)
) + ")"


def recent_usage(spark, sf):
    """Slash commands used lately: one per event type, newest first."""
    e = tb.load(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("ts"))
    used = "CASE event_type WHEN 'click' THEN '/files' WHEN 'view' THEN '/M' WHEN 'error' THEN '/txt' WHEN 'signup' THEN '/file' ELSE '/run' END"
    return e.selectExpr(f"{used} as used", "cast(row_number() over (order by ts desc) as bigint) as pos")


RECENT_SQL = """used AS (SELECT CASE event_type WHEN 'click' THEN '/files' WHEN 'view' THEN '/M' WHEN 'error' THEN '/txt'
    WHEN 'signup' THEN '/file' ELSE '/run' END AS used, row_number() OVER (ORDER BY max(ts) DESC) AS pos FROM events GROUP BY event_type),
recent AS (SELECT name, min(pos) AS recent_pos FROM used JOIN slash ON lower(used) = name
    OR list_contains(list_transform(aliases, lambda a: lower(a)), lower(used)) GROUP BY name)"""


@query(
    "suggest_commands",
    f"""WITH {SLASH_SQL}, {RECENT_SQL},
    typed AS (SELECT c_custkey AS qid, lower((CASE WHEN c_nationkey < 12 THEN '/' ELSE '' END) || substr(c_mktsegment, 1, 1)) AS typed FROM customer),
    m AS (SELECT t.qid, t.typed, s.name, s.ord, r.recent_pos, starts_with(s.name, typed) OR len(list_filter(s.aliases, lambda a: starts_with(lower(a), typed))) > 0 AS starts
      FROM typed t JOIN slash s ON starts_with(s.name, typed) OR len(list_filter(s.aliases, lambda a: starts_with(lower(a), typed))) > 0
        OR contains(lower(description), regexp_replace(typed, '^[/#>]', '')) OR starts_with(lower(short_name), regexp_replace(typed, '^[/#>]', ''))
      LEFT JOIN recent r ON s.name = r.name)
    SELECT qid, typed, name, recent_pos IS NOT NULL AND starts AS recent, row_number() OVER (PARTITION BY qid ORDER BY
      CASE WHEN recent_pos IS NOT NULL AND starts THEN recent_pos ELSE 1000000 END, name <> typed, recent_pos IS NULL,
      NOT starts_with(name, typed), name)::INTEGER AS rank FROM m""",
)
def suggest_query(spark, sf):
    typed = tb.load(spark, sf, "customer").selectExpr("c_custkey as qid", f"{SLASH_TYPED} as typed")
    catalog = cm.slash_commands(spark)
    recent = cm.recent_commands(catalog, recent_usage(spark, sf))
    return cm.suggest_commands(typed, catalog, recent).select("qid", "typed", "name", "recent", "rank")


@query(
    "commands_by_category",
    f"""WITH {SLASH_SQL}, {RECENT_SQL} SELECT s.category, g.group_ord, s.name, s.ord, r.recent_pos FROM slash s
    JOIN (SELECT category, min(ord) AS group_ord FROM slash GROUP BY 1) g ON s.category = g.category LEFT JOIN recent r ON r.name = s.name""",
)
def by_category_query(spark, sf):
    catalog = cm.slash_commands(spark)
    recent = cm.recent_commands(catalog, recent_usage(spark, sf))
    return cm.commands_by_category(catalog).join(recent, "name", "left").select("category", "group_ord", "name", "ord", "recent_pos")


@query(
    "resolve_alias",
    f"""WITH {SLASH_SQL}, a AS (SELECT c_custkey AS qid, CASE WHEN c_nationkey < 12 THEN '/' ELSE '' END || substr(c_mktsegment, 1, 1) AS asked FROM customer)
    SELECT qid, asked, name, scope FROM a JOIN slash ON lower(asked) = name OR list_contains(aliases, lower(asked))""",
)
def resolve_alias_query(spark, sf):
    asked = tb.load(spark, sf, "customer").selectExpr(
        "c_custkey as qid", "concat(if(c_nationkey < 12, '/', ''), substr(c_mktsegment, 1, 1)) as asked"
    )
    return cm.resolve_alias(asked, cm.slash_commands(spark)).select("qid", "asked", "name", "scope")


# --------------------------------------------------------------- shown results

SHOWN = f"WITH {SEARCH_SQL}, shown AS (SELECT *, coalesce(target_line, line) AS at_line FROM final WHERE rank <= k)"


@query(
    "client_rows",
    f"""{SHOWN}, c AS (SELECT qid, name, upper(substr(type, 1, 1)) || substr(type, 2) AS kind, file_path, coalesce(at_line, 0) + 1 AS line, container,
      floor(score * 10000)::INTEGER AS score FROM shown)
    SELECT qid, name, kind, file_path, line, container AS container_name, score,
      file_path || ':' || line || ':' || name || ':' || kind AS unique_key FROM c""",
)
def client_query(spark, sf):
    return rs.client_rows(search_frame(spark, sf))


@query(
    "symbol_locations",
    f"""{SHOWN} SELECT qid, id, name, CASE type WHEN 'file' THEN 1 WHEN 'class' THEN 5 WHEN 'method' THEN 6 WHEN 'property' THEN 7 WHEN 'enum' THEN 10
      WHEN 'interface' THEN 11 WHEN 'function' THEN 12 WHEN 'variable' THEN 13 ELSE 19 END AS kind, 'file://' || file_path AS uri,
      coalesce(at_line, 0) AS line, coalesce(col, 0) AS start_col, (coalesce(col, 0) + length(name))::INTEGER AS end_col,
      container AS container_name FROM shown""",
)
def locations_query(spark, sf):
    return rs.symbol_locations(search_frame(spark, sf))


@query(
    "display_rows",
    f"""{SHOWN} SELECT qid, id, name AS label, CASE WHEN container <> '' AND detail <> '' THEN container || ' - ' || detail
      ELSE coalesce(nullif(container, ''), nullif(detail, ''), '') END AS description,
      CASE WHEN at_line IS NULL THEN relative_path ELSE relative_path || ':' || (at_line + 1) END AS detail,
      CASE WHEN container <> '' THEN container || '.' || name ELSE name END AS reference FROM shown""",
)
def display_query(spark, sf):
    return rs.display_rows(search_frame(spark, sf))


@query(
    "register_provider",
    f"""WITH {tb.FEATURES_SQL}, {tb.CONTEXT_SQL} SELECT qid, id, 'brands' AS provider, 1.0::DOUBLE AS score FROM context
    JOIN features ON lower(container) = q_low""",
)
def register_query(spark, sf):
    # A source of our own: items whose container is the query.
    def brands(context, items):
        hit = items.join(context, F.lower("container") == F.col("q_low")).withColumn("score", F.lit(1.0))
        return rk.top_k(hit.withColumn("provider", F.lit("brands")).withColumn("k", F.lit(1000)), ["qid"]).select(*rk.ROW)

    context = qp.live(qp.query_context(tb.queries(spark)))
    out = rk.Providers().register("brands", brands, 10).run(context, tb.index(spark, sf))
    return out.select("qid", "id", "provider", "score")
