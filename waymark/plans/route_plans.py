"""Queries on concrete paths and route templates."""

from pyspark.sql import functions as F

from waymark.operators import routes as rt
from waymark.plans import tables as tb
from waymark.plans.registry import query

R6 = lambda c: F.round(F.col(c), 6)

# Paths typed with a verb now and then.
TYPED_PATH = "concat(if(startswith(url, 'https'), 'get ', ''), {path})"
TYPED_PATH_SQL = f"(CASE WHEN starts_with(url, 'https') THEN 'get ' ELSE '' END || {tb.PATH_SQL})"

# Templates of four forms derived from the paths: as they are, with one more
# parameter, with a literal tail, and a catch-all.


def paths(spark, sf):
    """All page paths with the prepared columns."""
    p = tb.load(spark, sf, "pages").selectExpr("page_id", f"{TYPED_PATH.format(path=tb.URL_PATH)} as typed")
    return rt.prepare_path(p, "typed")


TEMPLATE_FORMS = """explode(array({t}, concat('[POST] ', substr({t}, 7), '/{{x}}'), concat({t}, '/edit'),
  concat('[GET] ', regexp_replace({p}, '^/[a-z]+/.*', '/{{lang}}/{{*rest}}')))) as template"""


def templates(spark, sf):
    """Distinct templates, numbered by their text."""
    t = tb.load(spark, sf, "pages").selectExpr(
        TEMPLATE_FORMS.format(t=tb.URL_TEMPLATE, p=tb.URL_PATH)
    ).distinct()
    return rt.compile_template(t, "template")


TEMPLATES_SQL = f"""raw_t AS (SELECT {tb.TEMPLATE_SQL} AS t, {tb.PATH_SQL} AS p FROM pages),
templates AS (SELECT t AS template FROM raw_t UNION SELECT '[POST] ' || substr(t, 7) || '/{{x}}' FROM raw_t UNION SELECT t || '/edit' FROM raw_t
  UNION SELECT '[GET] ' || regexp_replace(p, '^/[a-z]+/.*', '/{{lang}}/{{*rest}}') FROM raw_t)"""
PATHS_SQL = f"""paths AS (SELECT page_id, {TYPED_PATH_SQL} AS typed, nullif(upper(regexp_extract(trim({TYPED_PATH_SQL}), '^(?i:({tb.VERBS_SQL})) .', 1)), '') AS p_verb,
  {tb.clean_path_sql(TYPED_PATH_SQL)} AS p_clean FROM pages)"""
ROUTES_SQL = f"""{PATHS_SQL}, {TEMPLATES_SQL},
{tb.route_score_sql("(SELECT page_id, p_verb, lower(p_clean) AS p_path FROM paths)", "page_id, p_verb", "templates", "template", "template")}"""


@query(
    "prepare_path",
    f"""WITH {PATHS_SQL} SELECT page_id, p_verb, p_clean, CASE WHEN p_clean = '' THEN 0 ELSE len(str_split(p_clean, '/')) END::INTEGER AS n_segments,
    array_to_string(str_split(lower(p_clean), '/'), '|') AS lower_segments FROM paths""",
)
def prepare_query(spark, sf):
    return paths(spark, sf).selectExpr(
        "page_id", "p_verb", "p_clean", "size(p_segments) as n_segments", "array_join(p_segments, '|') as lower_segments"
    )


@query(
    "compile_template",
    f"""WITH {TEMPLATES_SQL}, {tb.route_score_sql("(SELECT '' AS p_path)", "1 AS one", "templates", "template", "template")}
    SELECT t_name AS template, t_verb, t_clean, len(t_segs)::INTEGER AS n_segments,
      len(list_filter(t_segs, lambda s: regexp_matches(s, '^\\{{.*\\}}$')))::INTEGER AS n_params, contains(t_clean, '{{*') AS catch_all, t_regex AS regex FROM tmpl2""",
)
def compile_query(spark, sf):
    return templates(spark, sf).selectExpr(
        "template", "t_verb", "t_clean", "size(t_segments) as n_segments", "size(filter(t_params, p -> p)) as n_params",
        "t_catch_all as catch_all", "t_regex as regex",
    )


@query(
    "score_route",
    f"WITH {ROUTES_SQL} SELECT page_id, t_name AS template, round(route_score, 6) AS route_score FROM route WHERE route_score > 0",
)
def score_query(spark, sf):
    out = rt.route_scores(paths(spark, sf), templates(spark, sf))
    return out.select("page_id", "template", R6("route_score").alias("route_score"))


@query(
    "method_gate",
    f"""WITH {ROUTES_SQL} SELECT page_id, t_name AS template, round(route_score + CASE WHEN p_verb IS NULL OR t_verb IS NULL THEN 0 ELSE 0.5 END, 6)
    AS route_score FROM route WHERE route_score > 0 AND (p_verb IS NULL OR t_verb IS NULL OR starts_with(p_verb, t_verb) OR starts_with(t_verb, p_verb))""",
)
def gate_query(spark, sf):
    out = rt.method_gate(rt.route_scores(paths(spark, sf), templates(spark, sf)))
    return out.select("page_id", "template", R6("route_score").alias("route_score"))


@query(
    "best_route",
    f"""WITH {ROUTES_SQL}, r AS (SELECT page_id, t_name AS template, route_score, row_number() OVER (PARTITION BY page_id
      ORDER BY round(route_score, 6) DESC, t_name) AS rank FROM route WHERE route_score > 0)
    SELECT page_id, template, rank::INTEGER AS rank, round(route_score, 6) AS route_score FROM r WHERE rank <= 2""",
)
def best_query(spark, sf):
    out = rt.best_routes(paths(spark, sf), templates(spark, sf), "page_id", "template", 2)
    return out.select("page_id", "template", "rank", R6("route_score").alias("route_score"))
